"""Patterns as users write them (linear-time RE2 syntax) for Spark's Java matcher.

The two dialects agree on most syntax. The differences handled here change
matches silently if left alone: word boundaries, `$`, `.`, `\\s`, case folding,
named groups, POSIX classes and what `[` or `&&` mean inside a class.
Constructs only Java knows are refused, so that a pattern means one thing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
_NO_BOUNDARY = f"(?:(?<!{WORD})(?!{WORD})|(?<={WORD})(?={WORD}))"
_SPACE = r"\t\n\f\r "

# POSIX class names and the Java classes that equal them.
_POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}",
    "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}",
    "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}",
    "punct": r"\p{Punct}", "space": r"\s\x0B", "upper": r"\p{Upper}",
    "word": r"\w", "xdigit": r"\p{XDigit}",
}

_TOKEN = re.compile(
    r"""
      \\Q(?P<quoted>.*?)(?:\\E|\Z)
    | (?P<escape>\\(?:[pP]\{[^}]*\}|x\{[^}]*\}|.))
    | (?P<class>\[\^?\]?(?:\[:\^?\w+:\]|\\[pP]\{[^}]*\}|\\.|[^\]\\])*\])
    | (?P<group>\(\?(?:P?<(?![=!])\w+>|[imsU]*(?:-[imsU]+)?[:)]|.))
    | (?P<repeat>(?:[*+?]|\{\d+(?:,\d*)?\})[+?]?)
    | (?P<char>.)
    """,
    re.X | re.S,
)


class PatternError(ValueError):
    """The pattern is not valid, or not expressible in both dialects."""


def to_java(pattern: str) -> str:
    """The Java pattern that finds what `pattern` finds in RE2."""
    out = ["(?d)"]  # only \n ends a line, as in RE2
    multiline = False
    for tok in _TOKEN.finditer(pattern):
        text, kind = tok.group(0), tok.lastgroup
        if kind == "quoted":
            out.append("".join(_literal(c) for c in tok.group("quoted")))
        elif kind == "escape":
            out.append(_escape(text))
        elif kind == "class":
            out.append(_char_class(text))
        elif kind == "group":
            if re.match(r"\(\?P?<\w", text):
                out.append(text.replace("(?P<", "(?<"))
            elif re.fullmatch(r"\(\?[ims]*(?:-[ims]+)?[:)]", text):
                enabled = text.split("-")[0]
                multiline = multiline or "m" in enabled
                out.append(_unicode_folding(text))
            else:
                raise PatternError(f"unsupported group {text!r}")
        elif kind == "repeat":
            if text.endswith("+") and len(text) > 1:
                raise PatternError(f"possessive or doubled repeat {text!r}")
            out.append(text)
        elif text == "$" and not multiline:
            out.append(r"\z")
        elif text == "[":
            raise PatternError("missing closing ]")
        else:
            out.append(text)
    return "".join(out)


def _unicode_folding(flags: str) -> str:
    on, dash, off = flags.partition("-")
    on = on.replace("i", "iu")
    off = off.replace("i", "iu")
    return on + dash + off


def _literal(char: str) -> str:
    return char if char.isalnum() or char == "_" or ord(char) > 127 else "\\" + char


def _escape(text: str) -> str:
    code = text[1]
    if code == "b":
        return _BOUNDARY
    if code == "B":
        return _NO_BOUNDARY
    if code == "s":
        return f"[{_SPACE}]"
    if code == "S":
        return f"[^{_SPACE}]"
    if code == "v":
        return r"\x0B"
    if code in "pP":
        return _property(text)
    if code.isdigit() and code != "0":
        raise PatternError(f"backreference {text!r}")
    if code.isalpha() and code not in "AadDwWzfnrtx":
        raise PatternError(f"unsupported escape {text!r}")
    return text


def _property(text: str) -> str:
    """General categories keep their name; scripts need the Is prefix in Java."""
    name = text[3:-1]
    if len(text) > 3 and len(name.lstrip("^")) > 2:
        negated = name.startswith("^")
        head = ("\\P" if (text[1] == "p") == negated else "\\p") if negated else text[:2]
        return f"{head}{{Is{name.lstrip('^')}}}"
    return text


def _char_class(text: str) -> str:
    head = "[^" if text.startswith("[^") else "["
    body = text[len(head):-1]
    out = []
    for tok in re.finditer(r"\[:(\^?)(\w+):\]|\\[pP]\{[^}]*\}|\\.|.", body, re.S):
        item = tok.group(0)
        if tok.group(2):
            if tok.group(2) not in _POSIX:
                raise PatternError(f"unknown class {item!r}")
            inner = _POSIX[tok.group(2)]
            out.append(f"[^{inner}]" if tok.group(1) else inner)
        elif item == r"\s":
            out.append(_SPACE)
        elif item == r"\S":
            out.append(f"[^{_SPACE}]")
        elif item == r"\v":
            out.append(r"\x0B")
        elif item[0] == "\\" and item[1] in "pP":
            out.append(_property(item))
        elif item[0] == "\\" and item[1].isalnum() and item[1] not in "adDwWfnrtx0":
            raise PatternError(f"unsupported escape {item!r} in a class")
        elif item in ("[", "]", "&", "^"):
            out.append("\\" + item)
        else:
            out.append(item)
    return head + "".join(out) + "]"


#: From so many patterns on, one expression compiles all of them; if it fails, they are tried one by one to name the bad one.
_MANY = 20


def _all_compile(spark: SparkSession, java: list[str]) -> bool:
    every = F.from_json(F.lit(json.dumps(java)), "array<string>")
    try:
        spark.range(1).select(F.size(F.filter(every, lambda p: F.rlike(F.lit(""), p)))).collect()
    except PySparkException:
        return False
    return True


def checked(spark: SparkSession, patterns: Iterable[str]) -> list[str]:
    """Translate and compile on the driver, before any job starts."""
    patterns = list(patterns)
    if len(patterns) >= _MANY:
        out = [to_java(pattern) for pattern in patterns]
        if _all_compile(spark, out):
            return out
    compiler = spark._jvm.java.util.regex.Pattern
    out = []
    for pattern in patterns:
        java = to_java(pattern)
        try:
            compiler.compile(java)
        except Exception as exc:  # py4j wraps the Java error
            reason = str(getattr(exc, "java_exception", exc)).splitlines()[0]
            raise PatternError(f"{pattern!r}: {reason}") from None
        out.append(java)
    return out


def required_literals(pattern: str) -> list[str]:
    """Texts that every match of `pattern` contains, as far as they are easily seen.

    Seen are plain characters and escapes in a row outside of groups, in a pattern without alternatives and flags.
    """
    runs, run, depth, last = [], "", 0, ""
    for tok in _TOKEN.finditer(pattern):
        text, kind = tok.group(0), tok.lastgroup
        char = None
        if kind == "group":
            if not re.match(r"\(\?(?::|P?<\w)", text):
                return []
            depth += 1
        elif kind == "char" and text == "(":
            depth += 1
        elif kind == "char" and text == ")":
            depth -= 1
        elif kind == "char" and text == "|":
            if depth == 0:
                return []
        elif depth:
            pass
        elif kind == "repeat":
            if last and _times(text)[0] == 0:
                run = run[: -len(last)]
        elif kind == "quoted":
            run, last = run + tok.group("quoted"), tok.group("quoted")[-1:]
            continue
        elif kind == "char" and text not in "^$.":
            char = text
        elif kind == "escape" and len(text) == 2 and not text[1].isalnum():
            char = text[1]
        elif text in ("^", "$", r"\b", r"\B", r"\A", r"\z"):
            last = ""
            continue
        if char is not None:
            run, last = run + char, char
            continue
        runs.append(run)
        run, last = "", ""
    return [r for r in dict.fromkeys([*runs, run]) if r]


_MOST_COPIES = 64


def _times(repeat: str) -> tuple[int, float]:
    head = repeat.rstrip("?") if len(repeat) > 1 else repeat
    if head in "*+?":
        return {"*": (0, float("inf")), "+": (1, float("inf")), "?": (0, 1)}[head]
    low, comma, high = head.strip("{}").partition(",")
    return int(low), int(high) if high else (float("inf") if comma else int(low))


@dataclass(frozen=True)
class _Piece:
    """One element of a pattern in a row: the characters it takes, and whether it must and how long it may."""

    chars: frozenset[int]
    needed: bool
    unlimited: bool


#: ASCII, and one number for all other characters.
_OTHERS = 128
_ALL = frozenset(range(_OTHERS + 1))


@lru_cache(maxsize=10_000)
def _chars(token: str, folded: bool) -> frozenset[int]:
    """The characters that a class, an escape or a character takes; all of them if that is not easily seen."""
    if re.search(r"\[:|\\[pPxabfv0-9Q]|&&", token) or token == ".":
        return _ALL
    if token.startswith("\\") and token[1].isalpha() and token[1] not in "dDsSwWnrt":
        return _ALL
    try:
        found = re.compile(token if token[0] in "\\[" else re.escape(token), re.A | (re.I if folded else 0))
    except re.error:
        return _ALL
    taken = {i for i in range(_OTHERS) if found.fullmatch(chr(i))}
    if ord(token[0]) >= _OTHERS or any(found.fullmatch(c) for c in "\x85é中🙂") or (token[0] == "[" and not token.isascii()) or (folded and taken & {ord("k"), ord("s")}):
        taken.add(_OTHERS)
    return frozenset(taken)


def _rows(pattern: str) -> list[list[_Piece | None]] | None:
    """The alternatives of a pattern as pieces in a row, None for a test without width; None for a shape not looked into.

    Plain groups are read as what is in them; a group that is repeated or has alternatives is one piece of any characters.
    """
    folded = bool(re.search(r"\(\?[a-zA-Z]*i", pattern))
    rows: list[list[_Piece | None]] = [[]]
    opened: list[dict] = []  # open groups: where they began, and whether they have alternatives
    last: int | None = None  # from here on the row is what a repeat would repeat
    for tok in _TOKEN.finditer(pattern):
        text, kind = tok.group(0), tok.lastgroup
        row = rows[-1]
        if kind == "repeat":
            if last is None:
                continue
            low, high = _times(text)
            body = row[last:]
            if len(body) == 1 and body[0] is not None:
                one = body[0]
                row[last:] = [_Piece(one.chars, one.needed and low > 0, one.unlimited or high > _MOST_COPIES)]
            elif body:
                if any(p is not None and p.unlimited for p in body):
                    return None
                row[last:] = [_Piece(_ALL, False, high > _MOST_COPIES)]
            last = None
        elif kind == "group" and text.endswith(")"):
            continue
        elif kind == "group" or (kind == "char" and text == "("):
            opened.append({"at": len(row), "either": False})
            last = None
        elif kind == "char" and text == ")" and opened:
            group = opened.pop()
            if group["either"]:
                if any(p is not None and p.unlimited for p in row[group["at"] :]):
                    return None
                row[group["at"] :] = [_Piece(_ALL, False, False)]
            last = group["at"]
        elif kind == "char" and text == "|":
            if opened:
                opened[-1]["either"] = True
            else:
                rows.append([])
            last = None
        elif text in ("^", "$", r"\b", r"\B", r"\A", r"\z"):
            row.append(None)
            last = None
        elif kind == "quoted":
            row.extend(_Piece(_chars(c, folded), True, False) for c in tok.group("quoted"))
            last = len(row) - 1 if tok.group("quoted") else None
        else:
            row.append(_Piece(_chars(text, folded), True, False))
            last = len(row) - 1
    return rows


def _in_proportion(row: list[_Piece | None]) -> bool:
    """Proves that a backtracking search for a row of pieces takes time in proportion to the text.

    Two unlimited pieces must not share characters, or something between them must stop the first one: then there is one way
    only to divide a run between them. And what is tried at every place must not read one run again and again: unless nothing
    after an unlimited piece can fail, a needed piece before it must stop attempts that begin within its run.
    """
    long = [i for i, p in enumerate(row) if p is not None and p.unlimited]
    stops = lambda a, b, chars: any(p is not None and p.needed and not p.chars & chars for p in row[a:b])
    for n, i in enumerate(long):
        own = row[i].chars
        if any(own & row[j].chars and not stops(i + 1, j, own) for j in long[n + 1 :]):
            return False
        fails = any(p is None or p.needed for p in row[i + 1 :])
        if fails and not stops(0, i, own):
            return False
    return True


def needs_linear_matcher(pattern: str) -> bool:
    """True unless it is sure that a backtracking matcher takes time in proportion to the text, and little stack.

    Not sure are groups repeated without limit, many times, or with a body that can be
    empty or is itself unlimited, and whatever `_in_proportion` cannot prove.
    """
    if _repeats_groups(pattern):
        return True
    rows = _rows(pattern)
    return rows is None or not all(_in_proportion(row) for row in rows)


def _repeats_groups(pattern: str) -> bool:
    frames = [{"unlimited": False, "can_be_empty": False, "needed": False}]
    last = None
    for tok in _TOKEN.finditer(pattern):
        text, kind = tok.group(0), tok.lastgroup
        if kind == "repeat" and last is not None:
            low, high = _times(text)
            unlimited = high == float("inf")
            if last["group"] and (unlimited or (high > 1 and (last["unlimited"] or last["empty"] or high > _MOST_COPIES))):
                return True
            frames[-1]["unlimited"] |= unlimited
            last["empty"] |= low == 0
            continue
        if last is not None:
            frames[-1]["needed"] |= not last["empty"]
            frames[-1]["unlimited"] |= last["unlimited"]
            last = None
        if (kind == "group" and not text.endswith(")")) or (kind == "char" and text == "("):
            frames.append({"unlimited": False, "can_be_empty": False, "needed": False})
        elif kind == "char" and text == "|":
            frames[-1]["can_be_empty"] |= not frames[-1]["needed"]
            frames[-1]["needed"] = False
        elif kind == "char" and text == ")" and len(frames) > 1:
            done = frames.pop()
            last = {"group": True, "unlimited": done["unlimited"], "empty": done["can_be_empty"] or not done["needed"], "text": text}
        elif kind != "group" and text not in ("^", "$") and text not in (r"\b", r"\B", r"\A", r"\z"):
            last = {"group": False, "unlimited": False, "empty": False, "text": text}
    return False


def linear_match(pattern: str, text: Column) -> Column:
    """`text` contains `pattern`, found in linear time: whole Arrow batches by the dialect's own matcher."""

    @F.pandas_udf("boolean")
    def found(values: pd.Series) -> pd.Series:
        return pc.match_substring_regex(pa.array(values, pa.large_string()), pattern).to_pandas()

    return found(text)


def linear_match_all(patterns: Column, text: Column) -> Column:
    """`text` contains every pattern of its row's array, found in linear time; a null text contains none."""

    @F.pandas_udf("boolean")
    def found(lists: pd.Series, values: pd.Series) -> pd.Series:
        rows: dict[str, list[int]] = {}
        for i, own in enumerate(lists):
            for pattern in own if own is not None else ():
                rows.setdefault(pattern, []).append(i)
        texts, out = pa.array(values, pa.large_string()), pd.Series(True, index=range(len(values)))
        for pattern, at in rows.items():
            met = pc.fill_null(pc.match_substring_regex(texts.take(pa.array(at)), pattern), False)
            out.iloc[at] = out.iloc[at].to_numpy() & met.to_numpy(zero_copy_only=False)
        return out

    return found(patterns, text)


def linear_count(pattern: str, text: Column) -> Column:
    """How often `pattern` is found in `text`, in linear time."""

    @F.pandas_udf("int")
    def counted(values: pd.Series) -> pd.Series:
        return pc.count_substring_regex(pa.array(values, pa.large_string()), pattern).to_pandas()

    return counted(text)


def linear_replace(pattern: str, by: str, text: Column) -> Column:
    """`text` with every find of `pattern` replaced by the plain text `by`, in linear time."""

    @F.pandas_udf("string")
    def replaced(values: pd.Series) -> pd.Series:
        return pc.replace_substring_regex(pa.array(values, pa.large_string()), pattern, by.replace("\\", r"\\")).to_pandas()

    return replaced(text)


def _each(values: pd.Series, compute) -> pa.ListArray:
    lists = pa.array(values, pa.list_(pa.large_string()))
    inner = compute(lists.values)
    return pa.ListArray.from_arrays(lists.offsets, inner, mask=lists.is_null() if lists.null_count else None)


def linear_count_each(pattern: str, texts: Column) -> Column:
    """How often `pattern` is found in all strings of an array together."""

    @F.pandas_udf("int")
    def counted(values: pd.Series) -> pd.Series:
        lists = _each(values, lambda inner: pc.fill_null(pc.count_substring_regex(inner, pattern), 0))
        return pd.Series([0 if x is None else int(sum(x)) for x in lists.to_pylist()])

    return counted(texts)


def linear_replace_each(pattern: str, by: str, texts: Column) -> Column:
    """`linear_replace` on every string of an array."""

    @F.pandas_udf("array<string>")
    def replaced(values: pd.Series) -> pd.Series:
        lists = _each(values, lambda inner: pc.replace_substring_regex(inner, pattern, by.replace("\\", r"\\")))
        return pd.Series(lists.to_pylist(), dtype=object)

    return replaced(texts)


def is_context_free(pattern: str) -> bool:
    """True if a match does not depend on the text around it (no anchor, no boundary)."""
    plain = re.sub(r"\\[^bBAz]", "", pattern)
    plain = re.sub(r"\[\^", "[", plain)
    return not re.search(r"\^|\$|\\[bBAz]", plain)
