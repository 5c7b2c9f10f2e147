"""Finding time columns among text columns by counting, for every format, the values that fit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.columns import col

# The orders of date parts that logs use; the first of equally good ones wins.
DATES = ("yyyy-MM-dd", "yyyy.MM.dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "dd-MM-yyyy")
TIME_FORMATS = tuple(
    f"{date}{clock}" for date in DATES for clock in ("", "['T'][ ]HH:mm[:ss][.SSSSSS]", "['T'][ ]HH:mm:ss[.SSSSSS][ ][XXX][XX]")
)
# Share of a column's values that a format must fit.
TIME_SHARE = 1.0
_LIKE_A_DATE = r"^\s*\d{1,4}[-./]\d{1,2}[-./]\d{1,4}"


def format_counts(names: Sequence[str], good: Column) -> list[Column]:
    """Aggregates over rows that parsed: values of each column, and those each format fits.

    Text that does not begin like a date is not parsed at all.
    """
    out = []
    for i, name in enumerate(names):
        value = F.when(good, col(name))
        dated = F.when(value.rlike(_LIKE_A_DATE), F.trim(value))
        out.append(F.count(value).alias(f"_{i}"))
        out += [F.count(F.try_to_timestamp(dated, F.lit(fmt))).alias(f"_{i}_{j}") for j, fmt in enumerate(TIME_FORMATS)]
    return out


def chosen_formats(names: Sequence[str], seen: Mapping[str, int], share: float = TIME_SHARE) -> dict[str, list[str]]:
    """The format of each column that holds times: the one that fits most values, if it fits enough of them."""
    out = {}
    for i, name in enumerate(names):
        fits = [seen[f"_{i}_{j}"] for j in range(len(TIME_FORMATS))]
        best = max(fits)
        if best and best >= share * seen[f"_{i}"]:
            out[name] = [TIME_FORMATS[fits.index(best)]]
    return out


def parsed_time(text: Column, formats: Sequence[str]) -> Column:
    """A time without zone by the first format that fits; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(fmt)) for fmt in formats]).cast("timestamp_ntz")
