"""Metric column expressions (M1-M5) and output rounding.

The formulas are the reference's as implemented, not the textbook ones:
F is (1+b^2) P R / (b^2 (P + R)) and the ranking score is (4 F + s) / 5.
Division follows ANSI mode (raises on zero) unless ``safe`` is set, which is
only needed for stale counters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litrank.constants import F_BETA, RANK_DENOMINATOR, RANK_F_WEIGHT


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _div(a: Column, b: Column, safe: bool) -> Column:
    return F.try_divide(a, b) if safe else a / b


def true_positives(tp) -> Column:
    """M1: TP is the item's link count inside Q."""
    return _c(tp)


def false_positives(tp, total) -> Column:
    """M1: FP = total - TP."""
    return _c(total) - _c(tp)


def false_negatives(tp, n_query) -> Column:
    """M1: FN = |Q| - TP."""
    return _c(n_query) - _c(tp)


def precision(tp, total, safe: bool = False) -> Column:
    """M2: TP / (TP + FP) = TP / total."""
    tp = _c(tp).cast("double")
    return _div(tp, tp + false_positives(tp, total).cast("double"), safe)


def recall(tp, n_query, safe: bool = False) -> Column:
    """M3: TP / (TP + FN) = TP / |Q|."""
    tp = _c(tp).cast("double")
    return _div(tp, tp + false_negatives(tp, n_query).cast("double"), safe)


def f_beta(p, r, beta: float = F_BETA, safe: bool = False) -> Column:
    """M4 in the reference's operand order."""
    b2 = beta ** 2
    num = F.lit(1 + b2) * _c(p) * _c(r)
    den = F.lit(b2) * (_c(p) + _c(r))
    return _div(num, den, safe)


def ranking_score(f, sentiment) -> Column:
    """M5: (4 F + sentiment) / 5."""
    return (F.lit(RANK_F_WEIGHT) * _c(f) + _c(sentiment)) / F.lit(RANK_DENOMINATOR)


def r6(c) -> Column:
    """Round a double for output: 6 digits, and ``+ 0.0`` turns -0.0 into 0.0."""
    return F.round(_c(c), 6) + F.lit(0.0)
