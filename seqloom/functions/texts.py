"""Names, ids and loosely structured text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.protein import col

#: Words that stand for no disease. Fixed values.
NO_DISEASE = ("", "unknown", "nan")


def valid_disease(c: str | Column) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.lower(F.trim(c)).isin(*NO_DISEASE)


def disease_list(c: str | Column) -> Column:
    """Parts of a text at commas and semicolons, trimmed, blanks dropped; `unknown` and null: empty."""
    c = col(c)
    parts = F.filter(F.transform(F.split(F.translate(c, ";", ","), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(c.isNull() | (F.lower(F.trim(c)) == "unknown"), F.array().cast("array<string>")).otherwise(parts)


def fusion_genes(c: str | Column) -> Column:
    """Partners of a fusion name, those of more than two letters."""
    return F.filter(F.split(F.replace(col(c), F.lit("--"), F.lit("-")), "-"), lambda x: F.length(x) > 2)


def read_base(c: str | Column) -> Column:
    """Id shared by both mates of a read pair."""
    return F.regexp_replace(col(c), r"[./][12]$", "")


def parent_of(c: str | Column) -> Column:
    """Id without its last _n."""
    return F.regexp_replace(col(c), r"_[^_]*$", "")


def family_of(c: str | Column) -> Column:
    return F.substring_index(col(c), "_", 1)


def preview(c: str | Column, n: int = 15) -> Column:
    return F.concat(F.left(col(c), F.lit(n)), F.lit("..."))


def json_block(c: str | Column, brackets: str = "[]") -> Column:
    """From the first opening to the last closing bracket; '' if there is none."""
    a, z = (f"\\{b}" for b in brackets)
    return F.regexp_extract(col(c), f"(?s)({a}.*{z})", 1)


def stripped_of(c: str | Column, suffixes: list[str]) -> Column:
    """The text without each of the suffixes, tried once each, in order, case ignored."""
    out = F.trim(col(c))
    for s in suffixes:
        out = F.trim(F.regexp_replace(out, f"(?i)\\Q{s}\\E$", ""))
    return out


def stamp(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyyMMdd_HHmmss")
