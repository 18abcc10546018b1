"""Rates and their bounds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054  # normal quantile at 0.975


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.when(whole != 0, part / whole)


def wilson(successes: Column, total: Column, z: float = Z95) -> Column:
    """Wilson score interval: struct of low and high; null where total is 0."""
    p, n = successes / total, total
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(total > 0, F.struct(F.greatest(F.lit(0.0), mid - half).alias("low"), F.least(F.lit(1.0), mid + half).alias("high")))


def zero_failure_bound(total: Column, confidence: float = 0.95) -> Column:
    """Exact upper bound of a failure rate after ``total`` trials without a failure; null where total is 0."""
    return F.when(total > 0, -F.expm1(F.log1p(F.lit(-confidence)) / total))


def rate(part: Column, whole: Column) -> Column:
    """A ratio with its parts and its Wilson interval: struct of successes, total, rate, low, high; the last three null where total is 0."""
    bound = wilson(part, whole)
    return F.struct(part.alias("successes"), whole.alias("total"), ratio(part, whole).alias("rate"), bound["low"].alias("low"), bound["high"].alias("high"))


def selective(attempts: Column, accepted: Column, wrong: Column, in_scope: Column, correct: Column) -> Column:
    """Rates of attempts of which some are accepted: coverage, wrong among accepted, wrong per attempt, yield of those in scope, and the
    bound of the error where none is wrong. Null where the counts don't fit: accepted ones are the correct ones in scope and the wrong ones."""
    within = lambda a, b: (a >= 0) & (a <= b)
    fits = within(accepted, attempts) & within(wrong, accepted) & within(in_scope, attempts) & within(correct, in_scope) & (correct == accepted - wrong)
    return F.when(fits, F.struct(
        rate(accepted, attempts).alias("coverage"), rate(wrong, accepted).alias("wrong_among_accepted"), rate(wrong, attempts).alias("wrong_accepts_per_attempt"), rate(correct, in_scope).alias("correct_lock_yield"),
        F.when(wrong == 0, zero_failure_bound(accepted)).alias("zero_wrong_accepts_upper_95"),
    ))


def fitness(map50: Column, map50_95: Column) -> Column:
    return 0.1 * map50 + 0.9 * map50_95
