"""Personal data, and terms that give it away by the company they keep, in column expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions.plan import once
from signalbox.llm.staging import staged

#: Kinds in the order of the contract, with patterns equal to the plain ones but linear in time:
#: a match can only begin where a run of its first characters begins (or the last match ended), and
#: loops whose next character is not their own do not give back what they took.
#: A card pattern matches whole runs of 14 to 19 digits only, as all others are dropped anyway.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_TERM = r"\p{L}{3,}+"
#: Shares of an entity's information from which on a term is generalised or removed.
GENERALISE, REMOVE = 0.7, 0.9
#: Items of a block by level of a fold, and characters of a piece of text, see `_folded`.
_BLOCKS = (65536, 2048, 32)
_PIECE = 1024
_SPANS = "array<struct<start:int,end:int,value:string>>"


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def weigh(i: Column) -> Column:
        twice = F.substring(turned, i + 1, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), weigh), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return _luhn(F.regexp_replace(value, "[ -]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]+", "")).between(10, 15)
    return F.lit(True)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of `value`, which is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _folded(items: Column, step, leaf: tuple, above: tuple, at: Column | None = None, done=None, sizes=_BLOCKS) -> Column:
    """A fold of `step` over `items` with a state (at, out), by nested blocks; the merged `out`, or `done` of the last state.

    Appending copies an array, and a slice unpacks all of the array that it is taken from: one level would
    cost the square of the items. `out` of each block begins empty. `leaf` and `above` are the type of `out` and
    the function that merges it, in the innermost blocks and in those above them.
    """
    done = done or (lambda last: last["out"])
    kind, merge = above if sizes else leaf
    start = F.struct((F.lit(0) if at is None else at).alias("at"), F.array().cast(kind).alias("out"))

    def finish(acc: Column) -> Column:
        return done(F.struct(acc["at"].alias("at"), merge(acc["out"]).alias("out")))

    if not sizes:
        return F.aggregate(items, start, step, finish)

    def block(acc: Column, number: Column) -> Column:
        def add(last: Column) -> Column:
            return F.struct(last["at"].alias("at"), F.array_append(acc["out"], last["out"]).alias("out"))

        own = F.slice(items, number * sizes[0] + 1, F.lit(sizes[0]))
        return _bound(own, lambda some: _folded(some, step, leaf, above, acc["at"], lambda last: _bound(last, add), sizes[1:]))

    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / sizes[0]).cast("int"))
    return F.aggregate(numbers, start, block, finish)


def placed(text: Column, pattern: str, found: Column) -> Column:
    """`found`, all matches of `pattern` in `text`, with their places, from the lengths of what lies between."""
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda g: F.length(g))
    pairs = F.arrays_zip(gaps.alias("p"), found.alias("v"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["p"]
        b = a + F.length(x["v"])
        return F.struct(b.alias("at"), F.array_append(acc["out"], F.struct(a.alias("start"), b.alias("end"), x["v"].alias("value"))).alias("out"))

    leaf, above = (_SPANS, lambda out: out), (f"array<{_SPANS}>", F.flatten)
    return F.when(F.size(found) > 0, _bound(pairs, lambda all_: _folded(all_, step, leaf, above))).otherwise(F.array().cast(_SPANS))


def _kind_spans(text: str, rank: int, kind: str) -> Column:
    spans = F.filter(placed(F.col(text), PATTERNS[kind], F.col(f"_{kind}")), lambda s: _valid(kind, s["value"]))
    number, name = F.lit(rank).alias("rank"), F.lit(kind).alias("kind")
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), number, name, s["end"].alias("end"), s["value"].alias("value")))


def with_entities(rows: DataFrame, text: str, into: str = "entities") -> DataFrame:
    """`rows` with an array of (kind, start, end, value) of the valid base matches, by start and kind."""
    columns = rows.columns
    for kind in KINDS:
        found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        need = {"email": "@", "phone": "+"}.get(kind)
        if need:
            found = F.when(F.contains(F.col(text), F.lit(need)), found).otherwise(F.array().cast("array<string>"))
        rows = rows.withColumn(f"_{kind}", once(found))
    parts = [_kind_spans(text, rank, kind) for rank, kind in enumerate(KINDS)]
    return rows.select(*columns, once(F.array_sort(F.concat(*parts))).alias(into))


def _number_of(kind: str) -> Column:
    return F.size(F.filter("entities", lambda s: s["kind"] == kind)).cast("long")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked(text: Column) -> Column:
    """The text with e-mail addresses as zeros of the same length: only they have letters among entities, and places stay."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0))
    parts = F.arrays_zip(F.split(text, PATTERNS["email"], -1).alias("p"), found.alias("v"))
    bare = F.transform(parts, lambda x: F.concat(x["p"], F.repeat(F.lit("0"), F.length(F.coalesce(x["v"], F.lit(""))))))
    return F.when(F.contains(text, F.lit("@")), F.array_join(bare, "")).otherwise(text)


def _terms(masked: Column) -> Column:
    """The different terms outside entities, in small letters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(masked, F.lit(_TERM), F.lit(0)), lambda t: F.lower(t)))


def _share(both: Column, n_entity: Column, n_term: Column, n: int, n_entities: int, shrink: Column) -> Column:
    """What a term tells of an entity, as a share of the entity's information; see `disclosing_terms`."""
    p = n_entity / F.lit(float(n))
    given = (both + shrink * p) / (n_term + shrink)
    chance = n_term * p
    tail = F.when(chance < both, F.exp(both - chance + both * F.log(chance / both))).otherwise(1.0)
    luck = F.least(n_entities * tail, F.lit(1.0))
    return F.when(p < 1, F.greatest(F.log(given / p), F.lit(0.0)) / -F.log(p) * (1 - luck))


def _band(n_term: Column) -> Column:
    """Terms by how many documents hold them: 1 to 3, 4 to 7, 8 to 15, ..."""
    return F.greatest(F.floor(F.log2(n_term.cast("double"))), F.lit(1)).cast("int")


def fitted_shrink(terms: DataFrame, pairs: DataFrame) -> list[float]:
    """The shrinkage of each band of terms, from held-out co-occurrence.

    Take a term out of one of its entity's documents, and look at the other documents that hold the
    term: how often does the entity stand there too? Over all (entity, term, document) whose term
    stands in a further document, the mean of (n(both) - 1) / (n(term) - 1) is that rate q. A term that
    met its entity once in one document predicts it with 1 / (1 + shrink), so shrink = (1 - q) / q.
    Bands with few cases lean on the rate of all: q = (hits + q_all) / (cases + 1).

    `terms` has (term, n_term, n_pairs), n_pairs being the sum of n(both) over entities; `pairs` has
    (n_term, both) of the pairs whose entity stands in several documents, as others never meet again.
    At most 64 rows reach the driver.
    """
    cases = terms.where("n_term > 1").select(_band(F.col("n_term")).alias("band"), F.col("n_pairs").alias("cases"), F.lit(0.0).alias("hits"))
    hits = F.col("both") * (F.col("both") - 1) / (F.col("n_term") - 1)
    again = pairs.where("both > 1").select(_band(F.col("n_term")).alias("band"), F.lit(0).cast("long").alias("cases"), hits.alias("hits"))
    rows = cases.union(again).groupBy("band").agg(F.sum("cases").alias("cases"), F.sum("hits").alias("hits")).collect()
    q_all = (sum(r.hits for r in rows) + 0.5) / (sum(r.cases for r in rows) + 1)
    q = {r.band: (r.hits + q_all) / (r.cases + 1) for r in rows}
    return [(1 - x) / x for x in (q.get(band, q_all) for band in range(64))]


def disclosing_terms(docs: DataFrame, held: DataFrame, n: int, generalise: float = GENERALISE) -> DataFrame:
    """(_row, term, share) for the terms that give `generalise` or more of an entity of their document away.

    `held` has (_row, entities, terms) of the rows with entities. Of n documents, an entity stands in
    n(entity), a term in n(term), both in n(both). The share is log(p(entity | term) / p(entity)) /
    -log p(entity), the pointwise mutual information over the entity's information content, with
    p(entity) = n(entity) / n. p(entity | term) is drawn towards p(entity), as if `shrink` documents
    without news of the entity had the term too: (n(both) + shrink p(entity)) / (n(term) + shrink),
    with the shrinkage that held-out co-occurrence gives for terms of that frequency (`fitted_shrink`).
    The share is weighted by how far the pair departs from chance, 1 - min(1, entities * tail): how many of
    the corpus's different entities such a term would meet so by luck. The tail exp(b - c) (c / b)^b bounds the
    Poisson probability of b = n(both) or more meetings where c = n(term) p(entity) are expected.
    It is 1 at most, and the largest over the document's entities counts.

    Entities of one document share their terms' n(both) = 1, so no pair of theirs is a row.
    """
    one = docs.select(F.explode(_terms(_masked(F.coalesce("text", F.lit(""))))).alias("term"), F.lit(1).alias("one"), F.lit(0).alias("met"))
    own = held.select(F.explode("terms").alias("term"), F.lit(0).alias("one"), F.size("entities").alias("met"))
    terms = one.union(own).groupBy("term").agg(F.sum("one").alias("n_term"), F.sum("met").alias("n_pairs"))
    terms = staged(terms.where("n_pairs > 0"), "terms")
    entities = held.select("_row", F.explode("entities").alias("entity")).groupBy("entity")
    entities = staged(entities.agg(F.count(F.lit(1)).alias("n_entity"), F.min("_row").alias("_row")), "entity_counts")

    n_entities = entities.count()
    again = held.select("_row", F.explode("entities").alias("entity")).join(entities.where("n_entity > 1").select("entity"), "entity")
    again = again.groupBy("_row").agg(F.collect_list("entity").alias("entities"))
    again = staged(again.join(held.select("_row", "terms"), "_row"), "repeated")
    met = again.select("_row", "terms", F.explode("entities").alias("entity")).select("_row", "entity", F.explode("terms").alias("term"))
    pairs = met.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"))
    pairs = staged(pairs.join(terms.select("term", "n_term"), "term"), "pairs")

    by_band = F.array(*map(F.lit, fitted_shrink(terms, pairs)))
    shrink = F.get(by_band, _band(F.col("n_term")))
    share = _share(F.lit(1), F.lit(1), F.col("n_term"), n, n_entities, shrink)
    rare = staged(terms.select("term", share.alias("share")).where(F.col("share") >= generalise), "rare_terms")
    alone = entities.where("n_entity = 1").select("_row").distinct()
    marks = held.select("_row", F.explode("terms").alias("term")).join(rare, "term").join(alone, "_row", "left_semi")

    pairs = pairs.join(entities.select("entity", "n_entity"), "entity")
    share = _share(F.col("both"), F.col("n_entity"), F.col("n_term"), n, n_entities, shrink)
    pairs = staged(pairs.select("entity", "term", share.alias("share")).where(F.col("share") >= generalise), "shares")
    marks = marks.select("_row", "term", "share").union(met.join(pairs, ["entity", "term"]).select("_row", "term", "share"))
    return marks.groupBy("_row", "term").agg(F.max("share").alias("share"))


def sanitised(docs: DataFrame, with_text: bool = True, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans[, safe_text]) of every row of `docs` (doc_id, text).

    `spans` lists kind:start:end in code points: the base kinds, and `remove` or `general` for every
    occurrence of a term that gives `remove` (`generalise`) or more of the information of one of the
    document's entities away, wherever it stands in the document. In
    `safe_text` base spans become their kind in brackets, removed terms `[...]`, generalised
    terms their first two letters and `*`; a span that begins inside an earlier one goes with it.
    A null text reads as empty (`safe_text` too). doc_id may be null or repeat: rows are told apart
    by a number given when the entities are first written down. Further columns are not looked at.

    Only rows with entities are looked at again. Counts of pairs and terms are aggregated before
    they move, and an entity in a third of all documents is one row of each partial count. The
    time for a text grows with its length: folds go by nested blocks, and the occurrences of
    marked terms are found by a join on (row, term).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = docs.select("doc_id", once(F.coalesce("text", F.lit(""))).alias("_text"))
    base = with_entities(base, "_text")
    kept_text = F.col("_text") if with_text else F.when(F.size("entities") > 0, F.col("_text"))
    base = staged(base.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "entities", kept_text.alias("_text")), "entities")
    keys = F.array_distinct(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], F.lower(e["value"]))))
    held = base.where(F.size("entities") > 0).select("_row", keys.alias("entities"), _terms(_masked(F.col("_text"))).alias("terms"))
    marks = staged(disclosing_terms(docs, staged(held, "held"), base.count(), generalise), "marks")
    out = base.join(_marked_spans(base, marks, remove), "_row", "left")
    spans = F.when(F.col("_found").isNull(), F.col("entities")).otherwise(F.array_sort(F.concat("entities", "_found")))
    out = out.withColumn("_spans", once(spans))
    counts = [_number_of(k).alias(f"n_{k}") for k in KINDS]
    columns = ["doc_id", *counts, F.sha2(_joined(F.col("entities")), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans")]
    if with_text:
        columns.append(_rewritten().alias("safe_text"))
    return out.select(*columns)


def _marked_spans(base: DataFrame, marks: DataFrame, remove: float) -> DataFrame:
    """(_row, _found) with every place of a marked term, for rows that have one."""
    rows = base.join(marks.select("_row").distinct(), "_row", "left_semi")
    rows = rows.select("_row", once(_masked(F.col("_text"))).alias("_masked"))
    rows = rows.withColumn("_words", once(F.regexp_extract_all("_masked", F.lit(_TERM), F.lit(0))))
    words = rows.select("_row", F.explode(placed(F.col("_masked"), _TERM, F.col("_words"))).alias("at"))
    words = words.select("_row", "at.start", "at.end", F.lower("at.value").alias("term"))
    gone = F.col("share") >= remove
    rank = F.when(gone, len(KINDS)).otherwise(len(KINDS) + 1)
    kind = F.when(gone, "remove").otherwise("general")
    span = F.struct("start", rank.alias("rank"), kind.alias("kind"), "end", F.lit(None).cast("string").alias("value"))
    return words.join(marks, ["_row", "term"]).groupBy("_row").agg(F.collect_list(span).alias("_found"))


def _rewritten() -> Column:
    text = F.col("_text")
    # Pieces of equal length, as finding a place in one long text means counting from its beginning.
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))

    def between(pieces: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / _PIECE).cast("int")
        last = F.floor(b / _PIECE).cast("int")
        two = F.concat(*(F.coalesce(F.get(pieces, first + i), F.lit("")) for i in (0, 1)))
        some = F.when(last <= first + 1, two).otherwise(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""))
        return F.substring(some, a - first * _PIECE + 1, F.greatest(b - a, F.lit(0)))

    def rewritten(parts: Column) -> Column:
        pieces = parts["pieces"]

        def step(acc: Column, s: Column) -> Column:
            put = F.when(s["kind"] == "general", F.concat(between(pieces, s["start"], s["start"] + 2), F.lit("*"))).when(s["kind"] == "remove", "[...]")
            put = put.otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
            made = F.array_append(acc["out"], F.concat(between(pieces, acc["at"], s["start"]), put))
            inside = s["start"] < acc["at"]
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(made).alias("out"))

        def rest(last: Column) -> Column:
            return F.concat(last["out"], between(pieces, last["at"], F.length(text)))

        strings = ("array<string>", lambda out: F.array_join(out, ""))
        return _folded(parts["spans"], step, strings, strings, done=rest)

    parts = F.struct(cut.alias("pieces"), F.transform("_spans", lambda s: s).alias("spans"))
    return F.when(F.size("_spans") > 0, _bound(parts, rewritten)).otherwise(text)
