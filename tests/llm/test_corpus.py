import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalbox.llm import decontaminate, disclosure, mixing, packing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, end string")


def test_word_count(spark):
    rows = [(i, t, "s", "x") for i, t in enumerate([None, "", " \n", "a", " a\tb\n\nc ", "é é x"])]
    got = docs(spark, rows).select(mixing.word_count(F.col("text")).alias("n")).collect()
    assert [r.n for r in got] == [0, 0, 0, 1, 3, 2]


def mixing_rows():
    rnd = random.Random(1)
    sizes = {"big": 400, "mid": 100, "small": 60, None: 40}
    rows = [(s, " ".join("w" for _ in range(rnd.randint(1, 30)))) for s, n in sizes.items() for _ in range(n)]
    rows = [(i, t, s, "e") for i, (s, t) in enumerate(rows)] + [(5000, None, "big", "e"), (5001, " ", "other", "e")]
    return rows + rows[:2] + [(None, "a b", "mid", "e")]


@pytest.mark.parametrize("options", [{"repetition": 2.5}, {"entropy": 0.95}, {"repetition": 100.0}, {"budget": 3000}, {}])
def test_mixing(spark, options):
    rows = mixing_rows()
    got = mixing.mix_sources(docs(spark, rows), block_docs=50, **options).collect()
    tokens = collections.Counter()
    for _, t, s, _ in rows:
        tokens[s] += len((t or "").split())
    del tokens["other"]
    total = sum(tokens.values())
    p = {s: n / total for s, n in tokens.items()}
    entropy = lambda q: -sum(x * math.log(x) for x in q.values())

    def shares(x):
        z = sum(v**x for v in p.values())
        return {s: v**x / z for s, v in p.items()}

    x = 1.0
    if options.get("repetition"):
        x = max(0.0, 1 - math.log(options["repetition"]) / math.log(max(p.values()) / min(p.values())))
    if options.get("entropy"):
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if entropy(shares(mid)) >= options["entropy"] * math.log(len(p)) else (low, mid)
        x = low
    want = shares(x)
    budget = options.get("budget") or max(tokens[s] / want[s] for s in want)
    seen = collections.Counter()
    copies = collections.Counter()
    for r in got:
        if r._tokens:
            seen[r.source] += r._tokens
            assert abs(r._weight - want[r.source]) < 1e-4
        copies[r.doc_id] += 1
    for s, q in want.items():
        assert abs(seen[s] - q * budget) <= 15 * 10 + 1e-3 * budget  # half a document in each block
        times = q * budget / tokens[s]
        own = [copies[i] for i, t, source, _ in rows if source == s and t and t.strip() and i is not None and i > 1]
        assert min(own) >= math.floor(times - 1e-3) and max(own) <= math.ceil(times + 1e-3)
    assert copies[5000] == copies[5001] == 1
    assert len({r._order for r in got if r.doc_id and r.doc_id > 1}) == sum(n for i, n in copies.items() if i and i > 1)


def test_mixing_empty(spark):
    assert mixing.mix_sources(docs(spark, []), repetition=2.0).count() == 0


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row), row.index(min(row))


def test_nearest():
    rnd = random.Random(3)
    for _ in range(200):
        item = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 90)))
        text = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60)))
        assert decontaminate.nearest(item, text) == distance(item, text)


def test_leaks(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(12, 30)))) for i in range(12)]
    rows = []
    for i in range(80):
        text = " ".join(word() for _ in range(40))
        if i % 3 == 0:
            item = list(rnd.choice(items)[1])
            for _ in range(rnd.randint(0, int(len(item) * 0.09))):
                k = rnd.randrange(len(item))
                item[k : k + 1] = rnd.choice([[], ["z"], [item[k], "y"]])
            text += " " + "".join(item).upper().replace(" ", "\n ") + " " + text[:50]
        rows.append((i, text, "s", "x"))
    rows += [(None, items[0][1], "s", "x"), (80, None, "s", "x"), (81, "", "s", "x"), rows[0]]
    benchmark = items + [items[3], (99, None), (98, "  ")]
    df, bench = docs(spark, rows), spark.createDataFrame(benchmark, "item_id long, text string")
    want = []
    for i, text, *_ in rows:
        for j, item in benchmark:
            if item and item.strip():
                item = decontaminate.normalised(item)
                d, _ = distance(item, decontaminate.normalised(text or ""))
                if d <= int(len(item) * decontaminate.RATE):
                    want.append((-1 if i is None else i, j, d))
    assert len(want) > 10
    for chars in (1 << 20, 200):
        got = decontaminate.find_leaks(df, bench, block_chars=chars).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id, r.distance) for r in got) == sorted(want)
    texts = {i: decontaminate.normalised(t or "") for i, t, *_ in rows}
    for r in got:
        item = decontaminate.normalised(dict(items)[r.item_id])
        found = texts[r.doc_id][r.start : r.end]
        assert distance(item, found)[0] == r.distance and abs(len(found) - len(item)) <= r.distance
    left = decontaminate.decontaminated(df, bench)
    assert left.columns == df.columns
    gone = {i for i, _, _ in want}
    assert left.count() == sum(i is None or i not in gone for i, *_ in rows)
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0 == decontaminate.find_leaks(df.limit(0), bench).count()


def test_best_fit_decreasing():
    rnd = random.Random(6)
    for width in (1, 7, 64, 100):
        sizes = [rnd.randint(0, width) for _ in range(200)]
        bins = packing.best_fit_decreasing(sizes, width)
        assert sorted(i for b in bins for i in b) == list(range(200))
        assert all(sum(sizes[i] for i in b) <= width for b in bins)
        free = []
        for s in sorted(sizes, reverse=True):  # the same by linear search
            fits = [f for f in free if f >= s]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - s)
            else:
                free.append(width - s)
        assert sorted(width - sum(sizes[i] for i in b) for b in bins) == sorted(free)


def test_packing_round_trip(spark):
    rows = [(i, t, "s", "x") for i, t in enumerate([None, "", "Hello  world's\n\n 123", "é" * 50, "<|endoftext|>", "word " * 3000])] + [(None, "x y", "s", "x")]
    packed = packing.packed_rows(docs(spark, rows), width=64, block_tokens=500)
    for r in packed.collect():
        assert len(r.ids) == 128 and r.cu_seqlens[-1] == r.n_tokens <= 64 and r.position_resets == r.cu_seqlens[:-1]
        assert set(np.frombuffer(r.ids, "<u2")[r.n_tokens :]) <= {packing.END_ID}
    parts = collections.defaultdict(list)
    for r in packing.segments(packed).collect():
        parts[r.doc_id].append((r.doc_offset, r.ids))
    assert set(parts) == {r[0] for r in rows}
    for i, text, *_ in rows:
        ids = [x for at, part in sorted(parts[i]) for x in part]
        assert ids[-1] == packing.END_ID
        assert packing._tokenizer(packing.VOCABULARY).decode(ids[:-1]) == (text or "")
    assert packing.packed_rows(docs(spark, []), width=8).count() == 0
    bare = packing.packed_rows(docs(spark, rows[:2]), end_id=None)
    assert bare.count() == 0


def test_disclosure(spark):
    line = "Please ask {} now: bo.b@mail.example.com, thanks"
    rows = [(i, line.format("Quorvax"), "s", "x") for i in range(4)]
    rows += [(10 + i, "please say thanks now to all " + "filler " * i, "s", "x") for i in range(30)]
    rows += [(50, "Quorvax alone", "s", "x"), (51, None, "s", "x"), (51, "", "s", "x"), (None, "+1 (234) 567-8901 and 4111 1111 1111 1111.", "s", "x")]
    rows += [(60, "x 4111-1111-1111-1112 999.1.1.1 10.0.0.256 010.0.0.1 1.2.3.4.5.6.7.8 a@b.c_d@e.f --@x.y\n5 6", "s", "x")]
    df = docs(spark, rows)
    got = disclosure.sanitised(df, generalise=0.5, remove=0.95).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    first = by[0]
    assert (first.n_email, first.n_ip) == (1, 0)
    kinds = dict((s.split(":", 1)[1], s.split(":")[0]) for s in first.spans.split(","))
    at = line.index("{}")
    assert kinds[f"{at}:{at + 7}"] in ("general", "remove") and "Quorvax" not in first.safe_text and "[EMAIL]" in first.safe_text
    assert "thanks" in first.safe_text and by[50].safe_text == "Quorvax alone" and by[51].safe_text == ""
    assert by[None].n_phone == 1 and by[None].n_card == 1 and by[None].safe_text == "[PHONE] and [CARD]."
    assert (by[60].n_email, by[60].n_ip, by[60].n_card) == (3, 3, 0)
    assert disclosure.sanitised(df.limit(0)).count() == 0


def test_disclosure_of_unique_entities(spark):
    common = "the report was sent to all of them"
    rows = [(i, f"{common} again", "s", "x") for i in range(1500)]
    text = f"Dear Quorvax,\n{common}. {'filler ' * 60}\n{common} by quorvax\n\nzelmira.quorvax@mail.example.com"
    rows += [(2000, text, "s", "x"), (2001, "Dear Umbrell, no entity stands here", "s", "x")]
    rows += [(3000 + i, f"Yendor wrote {common} to 10.1.2.3\n", "s", "x") for i in range(60)]
    by = {r.doc_id: r for r in disclosure.sanitised(docs(spark, rows)).collect()}
    marks = [s.split(":") for s in by[2000].spans.split(",")]
    marked = [(k, text[int(a) : int(b)]) for k, a, b in marks]
    assert [v for k, v in marked if v.lower() == "quorvax"] == ["Quorvax", "quorvax"]
    assert {k for k, v in marked if v.lower() == "quorvax"} == {"general"}
    assert marked[-1] == ("email", "zelmira.quorvax@mail.example.com")
    assert not {v for _, v in marked} & set(common.split()) and common in by[2000].safe_text
    assert by[2001].spans == "" and by[2001].safe_text == rows[1501][1]
    assert all(by[3000 + i].safe_text == f"[...] [...] {common} to [IP]\n" for i in range(60))
