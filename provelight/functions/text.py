"""Column helpers whose results equal those of the usual text functions of Python.

Java's ``\\w``, ``\\b`` and ``\\s`` are ASCII (or differ otherwise), so patterns are
translated here: ``\\b`` becomes look-arounds over letters, numbers and the
underscore, ``\\s`` the Unicode white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = r"[\p{L}\p{N}_]"
SPACE = r"\t\n\x0B\f\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x85\u2028\u2029]"


def java(pattern: str, ignore_case: bool = False) -> str:
    """A pattern with Unicode word boundaries and white space, for Java's engine."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "b" and not in_class:
                out.append(f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))")
            elif nxt == "s":
                out.append(SPACE if in_class else f"[{SPACE}]")
            elif nxt == "S" and not in_class:
                out.append(f"[^{SPACE}]")
            elif nxt == "d":
                out.append(r"\p{Nd}")
            elif nxt == "w":
                out.append(r"\p{L}\p{N}_" if in_class else _W)
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[":
            # Java reads a second [ inside a class as a nested class
            out.append("\\[" if in_class else ch)
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
            out.append(ch)
        elif ch == "&" and in_class:
            out.append("\\&")
        else:
            out.append(ch)
        i += 1
    return ("(?iud)" if ignore_case else "(?d)") + "".join(out)


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(java(pattern, ignore_case))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(java(pattern)))


def all_of(text: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern, ignore_case)), F.lit(group))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE}]")


def lines_of(text: Column) -> Column:
    """The lines of a text; a final line end opens no further line, an empty text has none."""
    ended = F.regexp_replace(text, f"(?:{LINE_END})\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(ended, LINE_END))


def bracket_depth(text: Column, openers: str, closers: str) -> Column:
    """Deepest nesting; a closer without opener does not count below zero."""
    every = "".join("\\" + c for c in openers + closers)
    only = F.regexp_replace(text, f"[^{every}]", "")
    step = lambda acc, c: F.struct(
        F.when(F.lit(openers).contains(c), acc["d"] + 1).otherwise(F.greatest(F.lit(0), acc["d"] - 1)).alias("d"),
        F.when(F.lit(openers).contains(c), F.greatest(acc["best"], acc["d"] + 1)).otherwise(acc["best"]).alias("best"),
    )
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("best"))
    return F.when(only == "", 0).otherwise(F.aggregate(F.split(only, ""), start, step)["best"])


def open_brackets(text: Column, openers: str, closers: str) -> Column:
    """Openers minus closers."""
    n = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    return n(openers) - n(closers)


def indent_depth(text: Column) -> Column:
    """Deepest indentation of a line that is not blank, in steps of two blanks."""
    full = F.filter(lines_of(text), lambda x: ~is_blank(x))
    return F.coalesce(F.array_max(F.transform(full, lambda x: ((F.length(x) - F.length(F.ltrim(x))) / 2).cast("int"))), F.lit(0))
