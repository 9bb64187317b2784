import random

import duckdb

from signalbox.llm import hostrules


def metrics(text):
    text = text or ""
    for c in "\t\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.replace("\n", " ").split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" ")]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    )


def corpus():
    rnd = random.Random(2)
    texts = []
    for _ in range(60):
        words = [rnd.choice(["a", "bé", "c#", "dd", "eee", " x", "y|"]) if rnd.random() < 0.5 else f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 90))]
        texts.append("".join(w + rnd.choice([" ", "\n", "\t", " \x0b", "  "]) for w in words))
    texts += [None, "", "  \n\n ", "one two", "a a a a", "x " * 3000, "\n".join(["same line here"] * 4)]
    return [(i, t, f"s{i % 4}" if i % 9 else None) for i, t in enumerate(texts)]


def test_metrics(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "k", True) for r in rows], "doc_id long, text string, source string, kept string, base_failed boolean")
    got = hostrules.judged(df, carry=("doc_id",)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: metrics(t) for i, t, _ in rows}
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert hostrules.accepted(df).columns == df.columns
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    rel = con.execute(hostrules.ORACLE)
    names = [d[0] for d in rel.description]
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(rel.fetchall())


def test_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [("a", good)] * 300 + [("b", bad)] * 280 + [("b", good)] * 20 + [("c", bad)] + [("d", good)] * 95 + [("d", bad)] * 5 + [("e", good)]
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    rates = {r.host: r for r in hostrules.host_rates(hostrules.with_metrics(df)).collect()}
    raw = {h: rates[h].n_failed / rates[h].n_docs for h in rates}
    m = sum(raw.values()) / 5
    v = sum((x - m) ** 2 for x in raw.values()) / 5
    s = max(m * (1 - m) / v - 1, 0) or 1
    for h, r in rates.items():
        assert abs(r.fail_rate - (r.n_failed + m * s) / (r.n_docs + s)) < 1e-9
    got = hostrules.judged(df).collect()
    assert {r.source for r in got if r.host_rejected} >= {"b"}
    assert not any(r.host_rejected for r in got if r.source in "ad")
    assert all(not r.kept for r in got if r.source == "b") and any(r.kept for r in got)
    assert hostrules.judged(df.limit(0)).count() == 0
