"""Scores, ids, clocks and vectors as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000.0)


def recency(age_days: Column, divergent: bool = False) -> Column:
    f = F.exp(F.lit(-0.01) * F.greatest(age_days, F.lit(0.0)))
    f = F.lit(1.01) - f if divergent else f
    return F.when(F.isnan(f) | f.isNull(), 0.0).otherwise(f)


def half_life(value: Column, idle_days: Column, days: float) -> Column:
    return value * F.pow(F.lit(0.5), idle_days / days)


def brier(confidence: Column, matched: Column) -> Column:
    return F.pow(confidence - matched.cast("double"), F.lit(2.0))


def clamp01(c: Column, default: float = 0.5) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(default))))


def mean_of_known(parts: Column) -> Column:
    """The mean of an array's values that aren't null, to 4 digits; null if there are none."""
    known = F.filter(parts, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.round(F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known), 4))


def hex_of(c: Column) -> Column:
    return F.lower(F.hex(c))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A unit vector from SHA-256 of the text and a counter: 8 words of 32 bits a digest, each scaled to [-1, 1)."""
    digests = F.transform(F.sequence(F.lit(0), F.lit((dim + 7) // 8 - 1)), lambda k: F.sha2(F.concat(text, F.lit(":"), k.cast("string")), 256))
    words = F.flatten(F.transform(digests, lambda d: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(F.substring(d, k * 8 + 1, F.lit(8)), 16, 10).cast("double") / 2147483648.0 - 1.0)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    # Bound by lambdas, or the digests and the norm would be made anew for each component.
    bound = F.transform(F.array(F.slice(words, 1, dim)), lambda v: F.struct(v.alias("v"), norm(v).alias("norm")))
    return F.element_at(F.transform(bound, lambda b: F.transform(b["v"], lambda x: x / b["norm"])), 1)


def is_typed_id(c: Column, prefix: str | None = None) -> Column:
    return c.rlike(rf"^{prefix or '[a-z]+'}_[{L.CROCKFORD}]{{26}}$")


def id_prefix(c: Column) -> Column:
    return F.split_part(c, F.lit("_"), F.lit(1))


def id_millis(c: Column) -> Column:
    """The time in the first ten characters of an id."""
    body = F.substring(F.substring_index(c, "_", -1), 1, 10)
    digits = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: (F.instr(F.lit(L.CROCKFORD), F.substring(body, k, F.lit(1))) - 1).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda s, x: s * 32 + x)


def next_due(kind: Column, after: Column, last_fired: Column, minutes: Column, hhmm: Column, weekdays: Column, month_day: Column) -> Column:
    """When a job with a cadence is next due after `after`. weekdays: array of 0 (Monday) to 6. month_day: 1 to 28."""
    midnight = F.date_trunc("day", after).cast("timestamp_ntz")
    clock = F.make_dt_interval(F.lit(0), F.substring(hhmm, 1, 2).cast("int"), F.substring(hhmm, 4, 2).cast("int"), F.lit(0))
    days = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: midnight + F.make_dt_interval(k, F.lit(0), F.lit(0), F.lit(0)) + clock)
    ahead = F.filter(days, lambda d: d > after)
    weekly = F.filter(ahead, lambda d: F.array_contains(weekdays, F.weekday(d)))
    month = F.date_trunc("month", after).cast("timestamp_ntz")
    this = month + F.make_dt_interval(month_day - 1, F.lit(0), F.lit(0), F.lit(0)) + clock
    following = F.add_months(month.cast("date"), 1).cast("timestamp_ntz") + F.make_dt_interval(month_day - 1, F.lit(0), F.lit(0), F.lit(0)) + clock
    every = F.make_dt_interval(F.lit(0), F.lit(0), F.greatest(minutes, F.lit(5)), F.lit(0))
    return (
        F.when(kind == "every", F.when(last_fired.isNull(), after).otherwise(last_fired + every))
        .when(kind == "daily", F.try_element_at(ahead, F.lit(1)))
        .when(kind == "weekly", F.try_element_at(weekly, F.lit(1)))
        .when(kind == "monthly", F.when(this > after, this).otherwise(following))
    )


def cadence_error(kind: Column, hhmm: Column, weekdays: Column, month_day: Column) -> Column:
    """What is wrong with a job's cadence, or null."""
    bad_time = ~F.coalesce(hhmm.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d$"), F.lit(False))
    bad_days = (F.coalesce(F.size(weekdays), F.lit(0)) <= 0) | F.exists(F.coalesce(weekdays, F.array()), lambda x: (x < 0) | (x > 6))
    return (
        F.when(~kind.isin("every", "daily", "weekly", "monthly"), "unknown_cadence")
        .when((kind == "weekly") & bad_days, "bad_weekdays")
        .when((kind == "monthly") & ~month_day.between(1, 28), "bad_day")
        .when((kind != "every") & bad_time, "bad_time")
    )
