"""The few fields of a JSON text that matter, read at any depth and length, in one pass over its tokens.

The plain parser refuses nesting beyond 1,000 levels and numbers beyond 1,000 digits. Here the text is
cut into tokens and folded with a state of fixed size, so the cost follows the text's length and no
recursion can run out of stack. Whether the text is JSON at all is for `is_json` to say: the folds
assume it. Expressions are SQL text, which builds faster than columns of this size; they take
and give SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# No repeated group: a matcher needs no stack for it. A string comes in pieces, escapes as pairs; brackets open together.
_TOKENS = r'\\[\s\S]|["\]}:,]|[\[{]+|[^\\"\[\]{}:,]+'
#: Longer keys are none that anyone looks for, and are not kept whole.
_LONGEST_KEY = 200
_BLANKS = r"' \t\r\n'"
_SPAN = "CAST(NULL AS STRUCT<a: INT, b: INT>)"
# Strict JSON, whatever its size: the reader's leniencies are off.
_STRICT = {
    "maxNestingDepth": "2000000000",
    "maxNumLen": "2000000000",
    "maxStringLen": "2000000000",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "allowUnquotedFieldNames": "false",
    "allowNumericLeadingZeros": "false",
    "allowUnquotedControlChars": "false",
    "allowBackslashEscapingAnyCharacter": "false",
    "allowComments": "false",
}


def is_json(text: Column, mark: Column) -> Column:
    """True if `text` is one JSON value and nothing else; `mark` is any number that `text` decides."""
    parts = F.from_json(F.concat(F.lit("["), text, F.lit(',{"_mark":'), mark.cast("string"), F.lit("}]")), "array<struct<_mark:bigint>>", _STRICT)
    return F.coalesce((F.size(parts) == 2) & (F.get(parts, F.lit(1))["_mark"] == mark), F.lit(False))


def _struct(parts: dict[str, str]) -> str:
    return f"named_struct({', '.join(f"'{k}', {v}" for k, v in parts.items())})"


def _let(value: str, name: str, body: str) -> str:
    """`body` of a value computed once: otherwise an expression grows with every use, and planning with it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _fold(text: str, own: dict[str, str], step: dict[str, str]) -> str:
    """Folds the tokens of `text`: a place, a depth, the last string, and the state `own`.

    `step` renews `own` from the state `s` (its own part in `s.keep`) before a token and what the token is: `now.ends` (it ends a member at this
    depth, else 0), `now.colon` (it follows a key at this depth, else 0) and the place `now.at` after it.
    """
    unescaped = """CASE WHEN contains(s.keep.text, '\\\\') THEN get_json_object(concat('{"k":"', s.keep.text, '"}'), '$.k') ELSE s.keep.text END"""
    start = {"at": "0", "depth": "0", "inside": "false", "keep": _struct({"text": "''"} | own)}
    place = {
        "at": "s.at + length(t)",
        "depth": "s.depth + CASE WHEN s.inside THEN 0 WHEN startswith(t, '{') OR startswith(t, '[') THEN length(t) WHEN t IN ('}', ']') THEN -1 ELSE 0 END",
        "inside": "if(t = '\"', NOT s.inside, s.inside)",
    }
    now = place | {
        "ends": "if(NOT s.inside AND t IN (',', '}', ']'), s.depth, 0)",
        "colon": "if(NOT s.inside AND t = ':', s.depth, 0)",
        "text": f"CASE WHEN t = '\"' THEN if(s.inside, {unescaped}, '') WHEN s.inside AND length(s.keep.text) < {_LONGEST_KEY} THEN concat(s.keep.text, t) ELSE s.keep.text END",
    }
    renewed = {k: f"now.{k}" for k in place} | {"keep": _struct({"text": "now.text"} | step)}
    # Below the second level, and where brackets open below the first, nothing is to be kept: only the place moves.
    passing = "s.depth > 2 OR (NOT s.inside AND s.depth > 0 AND (startswith(t, '{') OR startswith(t, '[')))"
    moved = f"if({passing}, {_struct(place | {'keep': 's.keep'})}, {_let(_struct(now), 'now', _struct(renewed))})"
    return f"aggregate(regexp_extract_all({text}, r'{_TOKENS}', 0), {_struct(start)}, (s, t) -> {moved}, s -> s.keep)"


def _name(path: str) -> str:
    return path.replace(".", "__")


def _part(text: str, span: str) -> str:
    return f"trim(BOTH {_BLANKS} FROM substring({text}, {span}.a + 1, {span}.b - {span}.a))"


def fields(text: str, paths: tuple[str, ...]) -> str:
    """The raw JSON texts of `paths` (`a` or `a.b`) in an object's text, as a struct with a field per path, dots as `__`.

    Of repeated keys the last one counts, with what is in it. A missing field is NULL, a JSON null the text `null`.
    """
    own, step = {}, {}
    for n in (1, 2):
        own |= {f"k{n}": "CAST(NULL AS STRING)", f"v{n}": "0"}
        step[f"k{n}"] = f"CASE WHEN now.colon = {n} THEN s.keep.text WHEN now.ends = {n} THEN NULL ELSE s.keep.k{n} END"
        step[f"v{n}"] = f"if(now.colon = {n}, now.at, s.keep.v{n})"
    for p in paths:
        first, _, second = p.partition(".")
        n = 2 if second else 1
        is_it = f"s.keep.k1 = '{first}'" + (f" AND s.keep.k2 = '{second}'" if second else "")
        # A repeated object starts anew.
        anew = f"WHEN now.colon = 1 AND s.keep.text = '{first}' THEN {_SPAN}" if second else ""
        own[_name(p)] = _SPAN
        step[_name(p)] = f"CASE WHEN now.ends = {n} AND {is_it} THEN named_struct('a', s.keep.v{n}, 'b', s.at) {anew} ELSE s.keep.{_name(p)} END"
    return _let(_fold(text, own, step), "e", _struct({_name(p): _part(text, f"e.{_name(p)}") for p in paths}))


def members(text: str) -> str:
    """An object's or array's direct members, in order, as array<struct<key, text>>; `key` is NULL in an array.

    `text` should be a column: it is read for each member. The members are collected one by one, which
    costs the square of their number in copies of places.
    """
    own = {"key": "CAST(NULL AS STRING)", "begin": "0", "found": "CAST(array() AS ARRAY<STRUCT<key: STRING, a: INT, b: INT>>)"}
    step = {
        "key": "CASE WHEN now.colon = 1 THEN s.keep.text WHEN now.ends = 1 THEN NULL ELSE s.keep.key END",
        "begin": "if(now.ends = 1 OR now.colon = 1 OR s.depth = 0, if(s.depth = 0, s.at + 1, now.at), s.keep.begin)",
        "found": "if(now.ends = 1, concat(s.keep.found, array(named_struct('key', s.keep.key, 'a', s.keep.begin, 'b', s.at))), s.keep.found)",
    }
    texts = f"transform({_fold(text, own, step)}.found, m -> named_struct('key', m.key, 'text', {_part(text, 'm')}))"
    return f"filter({texts}, m -> m.text <> '')"


def last_of_each(found: str) -> str:
    """Of `members` that repeat a key the last one."""
    return _let(found, "all", "filter(all, (m, i) -> array_position(reverse(transform(all, x -> x.key)), m.key) = size(all) - i)")


def _object(parts: dict[str, str]) -> str:
    present = ", ".join(f"""concat('"{key}":', {text})""" for key, text in parts.items())
    return f"concat('{{', array_join(array_compact(array({present})), ','), '}}')"


def _plain(text: str) -> str:
    """A value of which the type alone matters: containers are an empty array."""
    return f"if(startswith({text}, '{{') OR startswith({text}, '['), '[]', {text})"


_ENVELOPE = ("jsonrpc", "id", "method", "error", "error.code", "error.message", "params.name", "result.tools")


def envelope(text: str) -> str:
    """A message's text reduced to an envelope that the plain parser takes, as struct<text, id>.

    Values whose type alone matters are an empty array where they are containers. An id too long or too deep for the
    parser stands as an empty array, and its text is given beside it.
    """
    error = _object({k: _plain(f"x.f.error__{k}") for k in ("code", "message")})
    tools = _object({"tools": "if(startswith(x.f.result__tools, '['), '[]', 'null')"})
    odd = "x.f.id IS NOT NULL AND x.odd"
    whole = _object(
        {
            "jsonrpc": _plain("x.f.jsonrpc"),
            "id": f"if({odd}, '[]', x.f.id)",
            "method": _plain("x.f.method"),
            "error": f"if(startswith(x.f.error, '{{'), {error}, {_plain('x.f.error')})",
            "params": f"if(x.f.params__name IS NULL, NULL, {_object({'name': _plain('x.f.params__name')})})",
            "result": f"if(x.f.result__tools IS NULL, NULL, {tools})",
        }
    )
    # One after the other: equal plans with more lambdas inside lambdas are not known as equal, and their shuffles not shared.
    found = f"transform(array({fields(text, _ENVELOPE)}), f -> named_struct('f', f, 'odd', try_parse_json(f.id) IS NULL))"
    return f"transform({found}, x -> named_struct('text', {whole}, 'id', if({odd}, x.f.id, NULL)))[0]"


def tool_list(tools: str) -> str:
    """The raw texts of the entries in the text of `result.tools`, a column."""
    return f"transform({members(tools)}, m -> m.text)"


def entry(text: str) -> str:
    """A listing's entry as a value; one that is too deep as its name and description alone, or as an empty array."""
    short = _let(fields(text, ("name", "description")), "f", _object({k: _plain(f"f.{k}") for k in ("name", "description")}))
    return f"coalesce(try_parse_json({text}), CASE WHEN startswith({text}, '{{') THEN try_parse_json({short}) WHEN startswith({text}, '[') THEN parse_json('[]') END)"
