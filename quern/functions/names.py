"""Dotted-name algebra as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_segment(name: Column) -> Column:
    """What follows the last dot; the whole name when that is empty."""
    tail = F.substring_index(name, ".", -1)
    return F.when(tail == "", name).otherwise(tail)


def strip_line_tag(name: Column) -> Column:
    """The name without an ``@digits`` suffix."""
    return F.regexp_replace(name, r"@\d+$", "")


def base_key(name: Column) -> Column:
    """The last segment without line tag, by which names are bucketed."""
    return last_segment(strip_line_tag(name))


def module_of(name: Column) -> Column:
    """The name less its last component; empty without a dot."""
    return F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)


def is_local(name: Column) -> Column:
    """Names tagged with a line are local definitions."""
    return name.rlike(r"@\d+$")


def is_module_prefix(prefix: Column, module: Column) -> Column:
    """Segment-aligned: ``A.B`` is a prefix of ``A.B`` and ``A.B.C``, not of ``A.BC``."""
    return (prefix == module) | module.startswith(F.concat(prefix, F.lit(".")))


def module_prefixes(module: Column) -> Column:
    """All segment-aligned prefixes of a module, the module itself included."""
    parts = F.split(module, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def is_foundational(module: Column, pattern: str = r"^[^.]+\.(Builtin\.|Primitive(\.|$))") -> Column:
    """Modules of the language's own base, by pattern."""
    return module.rlike(pattern)


def is_tagged(name: Column, words: tuple[str, ...] = ("theorem", "thm", "main")) -> Column:
    """Names marked as results: a word as prefix, suffix or, set off by a dash, within; case does not count."""
    low = F.lower(last_segment(name))
    out = F.lit(False)
    for w in words:
        out = out | low.startswith(w) | low.endswith(w) | low.contains(f"-{w}-")
    return out


def glob_regex(glob: str) -> str:
    """An anchored regex of a glob: ``**`` any text, ``*`` any but a slash, ``?`` one but a slash."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return f"^{out}$"


def glob_match(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob))


def family(name: Column) -> Column:
    """The stem of a ``stem-digits`` short name, else null."""
    stem = F.regexp_extract(last_segment(name), r"^(.+)-(\d+)$", 1)
    return F.when(stem != "", stem)
