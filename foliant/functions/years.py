"""Years written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_strict(c: Column) -> Column:
    """The year of `1840` or `Ano 1840`; null for anything else."""
    bare = F.trim(F.regexp_replace(c, "(?i)^ano ", ""))
    return F.when(bare.rlike("^[0-9]{4}$"), bare.cast("int"))


def year_any(c: Column) -> Column:
    """The first four digits anywhere that can be a year (1000 to 2099)."""
    return F.nullif(F.regexp_extract(c, "(1[0-9]{3}|20[0-9]{2})", 1), F.lit("")).cast("int")


def period(first: Column, last: Column) -> Column:
    """`y`, `a a b`, `desde a`, `até b` or null."""
    a, b = first.cast("string"), last.cast("string")
    return (
        F.when(first.isNotNull() & (first == last), a)
        .when(first.isNotNull() & last.isNotNull(), F.concat(a, F.lit(" a "), b))
        .when(first.isNotNull(), F.concat(F.lit("desde "), a))
        .when(last.isNotNull(), F.concat(F.lit("até "), b))
    )


def years_compatible(a: Column, b: Column, max_gap: int = 60) -> Column:
    """True where a year is missing or both are at most `max_gap` apart."""
    return F.coalesce(F.abs(a - b) <= max_gap, F.lit(True))


def decade(c: Column) -> Column:
    return (F.floor(c / 10) * 10).cast("int")
