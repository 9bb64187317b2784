"""Column expressions over one JSON-RPC message held as a VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JSON_SPACE = " \t\r\n"


def part(v: Column, path: str) -> Column:
    """A sub-value; JSON null stays a value, a missing field is NULL."""
    return F.try_variant_get(v, path, "variant")


def type_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_text_or_absent(v: Column, path: str) -> Column:
    return F.coalesce(type_of(part(v, path)), F.lit("VOID")).isin("STRING", "VOID")


def text_at(v: Column, path: str) -> Column:
    """A JSON string's content; NULL for anything else."""
    return F.when(type_of(part(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def unless_empty(text: Column) -> Column:
    """For plain columns only: the expression is used twice."""
    return F.when(text != "", text)


def is_object(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "map<string,variant>").isNotNull()


def wrapped(payload: Column, mark: Column) -> Column:
    """The payload parsed as `[payload, mark]`.

    The parser stops after the first complete value and ignores what follows, so
    parsing the bare text would accept `{"id":1} x`. Inside the array any such
    rest either breaks the syntax or displaces the mark.
    """
    return F.try_parse_json(
        F.concat(F.lit("["), payload, F.lit(","), mark.cast("string"), F.lit("]"))
    )


def is_whole(w: Column, mark: Column) -> Column:
    return F.coalesce(
        (F.try_variant_get(w, "$[1]", "bigint") == mark) & part(w, "$[2]").isNull(),
        F.lit(False),
    )


def starts_object(payload: Column) -> Column:
    return F.ltrim(payload, F.lit(JSON_SPACE)).startswith("{")


def json_text(text: Column) -> Column:
    """A string as a JSON string literal."""
    arr = F.when(text.isNotNull(), F.to_json(F.array(text)))
    return arr.substr(F.lit(2), F.length(arr) - 2)


def nonempty(text: Column) -> Column:
    return text.isNotNull() & (text != "")
