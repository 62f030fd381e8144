"""Text predicates and rewrites, all of them built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of the files that take part.
SOURCE_SUFFIXES = (".py", ".sh", ".java", ".php", ".js", ".htm", ".html", ".vue")

# Fixed value: marks a withdrawn requirement.
DELETED_MARK = "[DELETED"

# White space as Python sees it: Unicode white space and the four separators.
_BLANK = r"[\s\x1c-\x1f]"


def is_source_file(path: Column, suffixes: tuple[str, ...] = SOURCE_SUFFIXES) -> Column:
    """Case-sensitive suffix test on the whole name."""
    return reduce(Column.__or__, (path.endswith(s) for s in suffixes))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_active(requirement: Column) -> Column:
    return ~requirement.contains(DELETED_MARK)


def without_parentheses(text: Column) -> Column:
    """Drop every ``(...)`` with the blanks before it; nesting leaves a tail."""
    cut = F.regexp_replace(text, rf"(?U){_BLANK}*\([^)]*\)", "")
    return F.when(text.contains("("), cut).otherwise(text)


def is_blank(text: Column) -> Column:
    return text.rlike(rf"(?U)^{_BLANK}*$")


def fill(template: str, **values: Column) -> Column:
    """Concatenate ``template`` with its ``{name}`` slots replaced by columns."""
    parts: list[Column] = []
    rest = template
    while True:
        slots = [(at, n) for n in values if (at := rest.find("{" + n + "}")) >= 0]
        if not slots:
            break
        at, name = min(slots)
        parts += [F.lit(rest[:at]), values[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts, F.lit(rest))
