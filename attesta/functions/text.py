"""Text predicates and normalisers as Column expressions."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What UTF-8 letters and signs look like after a detour through a one-byte code page.
MOJIBAKE = [
    "â€", "Ã©", "Ã¨", "Ã¡", "Ã³", "Ãº", "Ã±", "Ã¤", "Ã¶", "Ã¼",
    "Ã§", "Ã‰", "Â·", "Â³", "Â°", "Â»", "Â«", "Â½", "Â¼", "â„¢",
]
#: What begins a logical line, and what a one-line path looks like.
OPENER = r"^\s*(?:[-*+]\s|\d+[.)]\s|#{1,6}\s|\||>|```)"
PATH = r"^(?:[A-Za-z]:[\\/]|\\\\|/|\.\.?[\\/]|~[\\/])\S+$"
#: Device names no file may have on some systems.
DEVICES = "con|prn|aux|nul|com[1-9]|lpt[1-9]"
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def strip(c: Column) -> Column:
    """All white space off both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def terms(query: str) -> list[str]:
    """Lower-case words of a query, split at any Unicode white space."""
    return query.lower().split()


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def body_of(c: Column) -> Column:
    """Text without a leading `---` block; a block that is never closed is text."""
    end = F.locate("\n---\n", c, 5)
    return F.when(c.startswith("---\n") & (end > 0), F.substring(c, end + 5, F.length(c))).otherwise(c)


def header_of(c: Column) -> Column:
    """What stands in a leading `---` block, else null."""
    end = F.locate("\n---\n", c, 5)
    return F.when(c.startswith("---\n") & (end > 0), F.substring(c, F.lit(5), end - 5))


def quotes(c: Column) -> Column:
    """Straight quotes, single spaces: what quotations are compared in."""
    return strip(F.regexp_replace(F.translate(c, "“”‘’", "\"\"''"), rf"{BLANK}+", " "))


def is_id(c: Column) -> Column:
    good = c.rlike(r"^[a-z0-9][a-z0-9._-]{0,127}$") & ~c.contains("..") & ~c.endswith(".")
    return F.coalesce(good & ~c.rlike(rf"^(?:{DEVICES})(?:\..*)?$"), F.lit(False))


def garbled(c: Column) -> Column:
    out = F.lit(False)
    for m in MOJIBAKE:
        out = out | c.contains(m)
    return F.coalesce(out, F.lit(False))


def is_path(c: Column) -> Column:
    """One line without white space that looks like a file path."""
    one = strip(c)
    return F.coalesce(one.rlike(PATH), F.lit(False))


def locator(c: Column) -> Column:
    """Repository part of a reference: before the first `#`."""
    return F.substring_index(c, "#", 1)


def repo_path(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(c, "\\", "/"), "^/+|/+$", ""))


def suffix(c: Column) -> Column:
    """Lower-case file suffix with its dot; '' if there is none."""
    return F.lower(F.regexp_extract(c, r"(\.[^./\\]+)$", 1))


#: Hours in the units of an age.
HOURS = {"h": 1, "d": 24, "": 24, "w": 168}


def before(as_of: str, age: str) -> str:
    """The stamp that lies `<number>[h|d|w]` (a bare number: days, fractions too) before a day or stamp."""
    found = re.fullmatch(r"\s*(\d+(?:\.\d*)?|\.\d+)([hdw]?)\s*", age.lower())
    if not found:
        raise ValueError(f"not an age: {age}")
    at = datetime.fromisoformat(as_of.removesuffix("Z")) - timedelta(hours=float(found[1]) * HOURS[found[2]])
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


def logical_units(c: Column) -> Column:
    """Array of logical lines: wrapped lines are joined by a space; a blank line ends one, and a list
    item, heading, table row, quotation or fence begins one."""
    def piece(line: Column) -> Column:
        one = strip(line)
        opened = F.concat(F.lit("\n"), one)
        return F.when(one == "", "\n").when(line.rlike(OPENER), opened).otherwise(F.concat(F.lit(" "), one))

    # a line end now only stands where a unit ends, so one split finds them
    joined = F.array_join(F.transform(F.split(newlines(c), "\n"), piece), "")
    return F.filter(F.transform(F.split(joined, "\n"), lambda u: F.ltrim(u)), lambda u: u != "")


def chunks(c: Column) -> Column:
    """Contents of fenced blocks, else the whole body, as an array; an unclosed fence runs to the end."""
    fenced = F.regexp_extract_all(newlines(c), F.lit(r"(?m)^```[^\n]*\n([\s\S]*?)(?:\n```[ \t]*$|\z)"), F.lit(1))
    return F.when(F.size(fenced) > 0, fenced).otherwise(F.array(newlines(c)))


def holds_all(haystack: Column, parts: Column) -> Column:
    """Whether the haystack (newlines alike, byte order mark off) holds every part."""
    clean = F.regexp_replace(newlines(haystack), "^﻿", "")
    return F.forall(parts, lambda p: F.contains(clean, p))


def overlapping(c: Column, needle: str, cap: int = 20) -> Column:
    """1-based positions of a literal, overlapping ones too, the first `cap`."""
    if not needle:
        return F.array().cast("array<int>")
    last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))
    # each step looks on from the last hit; 0 says that there is none
    step = lambda acc, _: F.when((F.size(acc) > 0) & (last(acc) == 0), acc).otherwise(
        F.array_append(acc, F.call_function("locate", F.lit(needle), c, last(acc) + 1))
    )
    hits = F.aggregate(F.sequence(F.lit(1), F.lit(cap)), F.array().cast("array<int>"), step)
    return F.filter(hits, lambda p: p > 0)
