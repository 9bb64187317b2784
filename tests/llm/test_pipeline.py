import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from signalbox.llm import packing
from tests.llm.test_minhash import brute, shingles


def test_pipeline(spark, tmp_path):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 7)))
    item = " ".join(word() for _ in range(15))
    rows = []
    for i in range(40):
        rows.append((i, " ".join(word() for _ in range(80)), "big" if i < 30 else "small"))
    rows += [(50 + i, rows[i][1], "small") for i in range(5)] + [(60, rows[9][1] + " more", "big")]
    rows += [(70, rows[12][1] + " " + item + " " + word(), "big"), (71, "too short", "big"), (72, "again and again " * 40, "big"), (73, None, "big")]
    columns = {"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": ["en"] * len(rows), "source": [r[2] for r in rows], "n_chars": [len(r[1] or "") for r in rows]}
    pq.write_table(pa.table(columns), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [item]}), tmp_path / "benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append([r.doc_id for r in docs.collect()])
    rules = [r for r in rows if r[0] not in (71, 72, 73)]
    assert sorted(kept[0]) == sorted(r[0] for r in rules)
    assert all(len(shingles(t, 5)) > 0 for _, t, _ in rules)
    unique = [i for i, _, _, keep in brute([(i, t) for i, t, _ in rules], 5) if keep]
    assert sorted(kept[1]) == unique
    assert sorted(kept[2]) == [i for i in unique if i != 70]
    assert set(kept[3]) == set(kept[2]) and len(kept[3]) > len(kept[2])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r[0]: r[1] for r in rows}
    total = sum(len(packing.token_ids(texts[i])) + 1 for i in kept[3])
    assert sum(r.n_tokens for r in out) == total
    assert {i for r in out for i in r.doc_ids} == set(kept[2])
    assert all(len(np.frombuffer(r.ids, "<u2")) == 2048 for r in out)


def test_mixed_rows_come_in_random_order(spark):
    rows = [(i, f"text number {i}", "big" if i < 200 else "small") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.source_mixing(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r.doc_id, r.source) for r in out.collect()]
    assert len(got) > 300 and len(set(got)) == 300
    changes = sum(a[1] != b[1] for a, b in zip(got, got[1:]))
    assert changes > len(got) / 4
    assert sum(a == b for a, b in zip(got, got[1:])) < 10
