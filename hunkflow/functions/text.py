"""Column macros for the string and number semantics of the rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


SPACE = " \t\n\x0b\f\r"


def trim(c: Column) -> Column:
    """Strip ASCII white space of any kind, not only spaces."""
    return F.btrim(c, F.lit(SPACE))


def indent(c: Column) -> Column:
    """Characters before the first that is no white space; -1 if there is none."""
    rest = F.char_length(F.ltrim(c, F.lit(SPACE)))
    return F.when(rest == 0, -1).otherwise(F.char_length(c) - rest)


def matches(c: Column, patterns: list[str] | str) -> Column:
    if not patterns:
        return F.lit(False)
    return F.rlike(c, F.lit(patterns if isinstance(patterns, str) else rules.any_of(patterns)))


def by_language(lang: Column, table: dict, build) -> Column:
    """The value that ``build`` makes of the entry for the row's language."""
    out = None
    for name, entry in table.items():
        if name is not None:
            out = F.when(lang == name, build(entry)) if out is None else out.when(lang == name, build(entry))
    return out.otherwise(build(table[None])) if None in table else out


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def language(path: Column) -> Column:
    """Of the extension, which begins at the last dot: one look-up, no match per language."""
    names = F.create_map(*(F.lit(x) for name, extensions in rules.EXTENSIONS.items() for e in extensions for x in (e, name)))
    return F.when(path.contains("."), F.element_at(names, F.concat(F.lit("."), F.substring_index(F.lower(path), ".", -1))))


def is_test(lang: Column, path: Column) -> Column:
    return F.coalesce(by_language(lang, rules.TEST_PATHS, lambda p: matches(path, p)), F.lit(False))


def importance(path: Column) -> Column:
    return F.when(matches(path, rules.TEST_FILE), "test").when(matches(path, rules.SOURCE_FILE), "source").when(matches(path, rules.CONFIG_FILE), "config").otherwise("docs")


def confidence_weight(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)
