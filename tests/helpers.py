from datetime import datetime, timedelta

from signalbox import schemas as S

T0 = datetime(2024, 5, 1, 12, 0, 0)
H2S, S2H = S.HOST_TO_SERVER, S.SERVER_TO_HOST


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def raw(spark, rows):
    """Rows are (direction, payload) or (direction, payload, session, seconds)."""
    full = []
    for i, r in enumerate(rows):
        direction, payload, *rest = r
        session = rest[0] if rest else "s1"
        seconds = rest[1] if len(rest) > 1 else i
        full.append((i, at(seconds), session, direction, payload))
    return spark.createDataFrame(full, S.RAW_MESSAGES)


def by_seq(df, *cols):
    return {r["seq"]: (r[cols[0]] if len(cols) == 1 else tuple(r[c] for c in cols)) for r in df.collect()}


def call(tool, id_=1, args="{}"):
    return f'{{"jsonrpc":"2.0","id":{id_},"method":"tools/call","params":{{"name":"{tool}","arguments":{args}}}}}'


def list_request(id_=1):
    return f'{{"jsonrpc":"2.0","id":{id_},"method":"tools/list"}}'


def list_response(tools, id_=1):
    return f'{{"jsonrpc":"2.0","id":{id_},"result":{{"tools":[{",".join(tools)}],"nextCursor":"abc"}}}}'


def named(*names):
    return [f'{{"name":"{n}","description":"{n} tool"}}' for n in names]
