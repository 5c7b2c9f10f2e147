"""Expressions with the null, padding and bucket rules of the event-log operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_HOUR = 3_600_000_000


def col(name: str) -> Column:
    """Column by its literal name; dots and colons in it are not parsed."""
    return F.col("`" + name.replace("`", "``") + "`")


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(float(MICROS_PER_SECOND))


def hours_between(start: Column, end: Column) -> Column:
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(float(MICROS_PER_HOUR))


def is_true(predicate: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(predicate, F.lit(False))


def member(column: Column, values: Iterable) -> Column:
    """``isin`` that is false, not null, for a null value."""
    return is_true(column.isin(list(values)))


def text_or_token(column: Column, null_token: str) -> Column:
    return F.coalesce(column.cast("string"), F.lit(null_token))


def similarity(left: Column, right: Column) -> Column:
    """Edit similarity 0 to 100; two empty strings are alike."""
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest == 0, F.lit(100.0)).otherwise(100.0 * (1 - F.levenshtein(left, right) / longest))


def letters(number: Column, width: int = 14) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA; a number is spelled with at most ``width`` letters (14 hold every bigint)."""

    def step(done: Column, _: Column) -> Column:
        rest = done["rest"]
        digit = F.pmod(rest - 1, F.lit(26))
        left = F.floor((rest - 1).cast("decimal(20,0)") / 26).cast("bigint")
        more = F.struct(left.alias("rest"), F.concat(F.char(digit + 65), done["text"]).alias("text"))
        return F.when(rest > 0, more).otherwise(done)

    start = F.struct(number.cast("bigint").alias("rest"), F.lit("").alias("text"))
    return F.when(number.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(width)), start, step)["text"])


def left_pad(sequence: Column, length: int, token: Column) -> Column:
    """Exactly ``length`` elements: the newest ones, with ``token`` in front of a shorter sequence."""
    newest = F.when(F.size(sequence) > length, F.slice(sequence, -length, length)).otherwise(sequence)
    missing = F.greatest(F.lit(length) - F.size(sequence), F.lit(0))
    return F.concat(F.array_repeat(token, missing), newest)


def prefix_bucket(length: Column, max_bucket: int = 10) -> Column:
    """A prefix longer than ``max_bucket`` belongs to the open bucket."""
    return F.when(length > max_bucket, F.lit(f"{max_bucket}+")).otherwise(length.cast("string"))


def time_units(seconds: Column) -> dict[str, Column]:
    return {
        "seconds": seconds,
        "minutes": seconds / 60.0,
        "hours": seconds / 3600.0,
        "days": seconds / 86400.0,
    }


def split_activities(text: Column) -> Column:
    """Comma-separated request text to trimmed activity names; empty text gives an empty array."""
    parts = F.transform(F.split(text, ","), lambda part: F.trim(part))
    return F.filter(parts, lambda part: part != "")


def outcome_label(outcome: Column) -> Column:
    return F.when(F.upper(outcome) == "UNKNOWN", F.lit("Standard Processing")).otherwise(outcome)


# Outcome classes of the billing log, by class index.
BILLING_OUTCOMES = ("A", "B", "C", "E", "H", "O", "UNKNOWN", "W")


def outcome_by_index(index: Column) -> Column:
    classes = F.array(*[F.lit(name) for name in BILLING_OUTCOMES])
    return F.try_element_at(classes, (index + 1).cast("int"))


def md5_test_share(key: Column) -> Column:
    """True for about a fifth of the keys (51 of 256 first bytes), the same ones on every run."""
    return F.substring(F.md5(key.cast("string")), 1, 2) < "33"
