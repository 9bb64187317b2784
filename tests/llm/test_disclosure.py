import collections
import math
import random
import re
import time

from pyspark.sql import functions as F

from signalbox.llm import disclosure

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
TERM = re.compile(r"[^\W\d_]{3,}")


def brute(texts, generalise, remove):
    """Shares by (row, term) and all spans by row, from dictionaries over whole texts."""
    n = len(texts)
    base = [[(m.start(), 0, "email", m.end(), m.group()) for m in EMAIL.finditer(t)] for t in texts]
    for row, t in enumerate(texts):
        base[row] += [(m.start(), 1, "ip", m.end(), m.group()) for m in IP.finditer(t) if all(int(x) < 256 for x in m.group().split("."))]
    masked = [EMAIL.sub(lambda m: "0" * len(m.group()), t) for t in texts]
    terms = [{w.lower() for w in TERM.findall(t)} for t in masked]
    held = [{f"{k}:{v.lower()}" for _, _, k, _, v in spans} for spans in base]
    n_term = collections.Counter(w for words in terms for w in words)
    n_entity = collections.Counter(e for found in held for e in found)
    both = collections.Counter((e, w) for found, words in zip(held, terms) for e in found for w in words)
    cases, hits = collections.Counter(), collections.Counter()
    band = lambda w: max(1, int(math.log2(n_term[w])))
    for found, words in zip(held, terms):
        for e in found:
            for w in words:
                if n_term[w] > 1:
                    cases[band(w)] += 1
                    hits[band(w)] += (both[e, w] - 1) / (n_term[w] - 1)
    q_all = (sum(hits.values()) + 0.5) / (sum(cases.values()) + 1)
    shares = {}
    for row, (found, words) in enumerate(zip(held, terms)):
        for e in found:
            for w in words:
                q = (hits[band(w)] + q_all) / (cases[band(w)] + 1)
                shrink, p, b = (1 - q) / q, n_entity[e] / n, both[e, w]
                given, chance = (b + shrink * p) / (n_term[w] + shrink), n_term[w] * p
                tail = math.exp(b - chance) * (chance / b) ** b if chance < b else 1
                share = max(math.log(given / p), 0) / -math.log(p) * (1 - min(len(n_entity) * tail, 1)) if p < 1 else 0
                shares[row, w] = max(shares.get((row, w), 0), share)
    spans = []
    for row, t in enumerate(masked):
        out = list(base[row])
        for m in TERM.finditer(t):
            share = shares.get((row, m.group().lower()), 0)
            if share >= generalise:
                out.append((m.start(), 4, "remove", m.end()) if share >= remove else (m.start(), 5, "general", m.end()))
        spans.append(sorted(s[:4] for s in out))
    return shares, spans


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(200)]
    texts = []
    for i in range(150):
        text = " ".join(rnd.choices(words, weights=[1 / (1 + k) for k in range(200)], k=rnd.randint(0, 30)))
        if i % 5 == 0:
            who = rnd.randint(0, 8)
            text = f"Owner{chr(65 + who)} {text}\nжитьbob{who}@mail.example.com, {text[:20]} owner{chr(97 + who)}"
        elif i % 7 == 0:
            text += f" from 10.0.0.{rnd.randint(0, 300)} 😀 Tail"
        texts.append(text)
    return texts + ["", texts[0], texts[0]]


def test_counts_shares_and_spans_by_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        shares, want = brute(texts, 0.5, 0.8)
        got = {r.doc_id: r for r in disclosure.sanitised(df, generalise=0.5, remove=0.8).collect()}
        for row, spans in enumerate(want):
            assert got[row].spans == ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans), row
        kinds = {s[2] for spans in want for s in spans}
        assert kinds == {"email", "ip", "remove", "general"}

        base = disclosure.with_entities(df, "text")
        keys = F.array_distinct(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], F.lower(e["value"]))))
        held = base.where(F.size("entities") > 0).select(
            F.col("doc_id").alias("_row"), keys.alias("entities"), disclosure._terms(disclosure._masked(F.col("text"))).alias("terms")
        )
        found = {(r._row, r.term): r.share for r in disclosure.disclosing_terms(df, held, len(texts), 0.3).collect()}
        expected = {k: v for k, v in shares.items() if v >= 0.3}
        assert found.keys() == expected.keys()
        assert all(abs(found[k] - expected[k]) < 1e-9 for k in found)


def rewritten(text, spans):
    out, at = [], 0
    for start, _, kind, end in spans:
        put = text[start : start + 2] + "*" if kind == "general" else "[...]" if kind == "remove" else f"[{kind.upper()}]"
        if start >= at:
            out += [text[at:start], put]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_safe_text_by_brute_force(spark):
    texts = corpus(3)
    # Spans over the borders of pieces and of blocks.
    texts += ["😀" * 1020 + " a@b.cc " + "x" * 3000 + " 10.1.1.1", "y@z.org " * 2000, "1.2.3.4", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, want = brute(texts, 0.5, 0.8)
    got = {r.doc_id: r.safe_text for r in disclosure.sanitised(df, generalise=0.5, remove=0.8).collect()}
    assert got == {row: rewritten(text, want[row]) for row, text in enumerate(texts)}


def test_a_text_of_many_matches(spark):
    many = " ".join(f"u{i}@h{i % 7}.org name{'abcdefghij'[i % 10]}" for i in range(200_000))
    df = spark.createDataFrame([(1, many), (2, "plain text"), (3, None)], "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r for r in disclosure.sanitised(df).collect()}
    assert time.monotonic() - began < 60
    assert got[1].n_email == 200_000 and got[1].safe_text.count("[EMAIL]") == 200_000
    assert got[1].spans.startswith("email:0:9,") and got[2].safe_text == "plain text" and got[3].safe_text == ""


def test_other_columns_and_repeated_rows(spark):
    rows = [(1, "ask a@b.cc now", "t", 1, "m")] * 3 + [(None, "x", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string, _row long, term string")
    got = disclosure.sanitised(df)
    assert got.columns[0] == "doc_id" and got.count() == 4 and got.where("n_email = 1").count() == 3
