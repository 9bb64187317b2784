import duckdb

from signalbox.llm import quotes

ROWS = [
    (1, 0, "a", "Is the build green?\nAnd the docs?"),
    (1, 1, "b", "Build yes.\nDocs no."),
    (1, 2, "c", "b wrote:\n> Docs no.\nI fix the docs."),
    (1, 3, "a", "> > Docs no.\n>  I FIX  the docs.\nThanks"),
    (1, 4, "b", "> is the build green?\n> and the docs?\n> build yes.\nStill so."),
    (1, 5, "d", "> never said\n"),
    (2, 0, "a", "Docs no."),
    (2, 2000, "b", "> Docs no.\n> > deep\nok"),
    (2, 2001, "b", "Docs no.\n\n"),
    (2, 2002, "b", ">Docs no."),
    (2, 2003, "b", None),
    (2, 2004, "b", ""),
]


def test_links(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(df).collect()}
    assert len(got) == len(ROWS)
    assert got[1, 2].reply_to == 1 and got[1, 2].text == "I fix the docs."
    assert got[1, 3].reply_to == 2 and got[1, 3].anchor_turn == 1 and got[1, 3].quote_levels == 2
    assert got[1, 4].reply_to == 0
    assert got[1, 5].reply_to is None and got[1, 5].anchor_turn == 5
    assert got[2, 2000].reply_to == 0 and got[2, 2002].reply_to == 2001
    assert got[2, 2003].text == "" and got[2, 2004].quoted_lines == 0


def test_against_sql(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    rel = con.execute(quotes.ORACLE)
    names = [d[0] for d in rel.description]
    from pyspark.sql import functions as F

    ours = quotes.link_quotes(df).withColumn("text_md5", F.md5("text")).select(*names)
    assert sorted(map(repr, map(tuple, ours.collect()))) == sorted(map(repr, rel.fetchall()))


def test_odd_rows(spark):
    rows = [(None, 0, "> x", "k"), (1, None, "> x", "k"), (1, 0, "x", None), (1, 0, "x", None), (1, 1, "> x", "k")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, reply_to string")
    got = quotes.link_quotes(df).collect()
    assert len(got) == 5 and [r.reply_to for r in got if r.turn == 1] == [0]
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_columns_of_any_name(spark):
    """Names that the operator uses on its way come through unchanged."""
    names = ["anchor", "h", "slot", "origin", "level", "own", "n", "b", "o", "_lines", "_hashes", "_carried", "next", "moved", "last", "near"]
    rows = [(1, 1, "one line", *range(16)), (1, 2, "> one line\nyes", *range(20, 36)), (1, 3, "> yes\n>> one line", *range(40, 56))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, " + ", ".join(f"{n} int" for n in names))
    got = sorted(quotes.link_quotes(df).collect(), key=lambda r: r.turn)
    assert [tuple(r[n] for n in names) for r in got] == [r[3:] for r in rows]
    assert [(r.text, r.reply_to, r.anchor_turn) for r in got] == [("one line", None, 1), ("yes", 1, 1), ("", 2, 1)]
