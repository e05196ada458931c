"""Weights, basis points and the status of a document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10_000


def weight(confidence: Column) -> Column:
    """A confidence as a vote's weight: null is 1, NaN and infinities are 0, the rest is clamped to [0, 1]."""
    c = confidence.cast("float")
    odd = F.isnan(c) | (c == float("inf")) | (c == float("-inf"))
    return F.when(c.isNull(), 1.0).when(odd, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))).cast("float")


def bps(part: Column, total: Column) -> Column:
    """part / total in basis points, in single precision, halves away from zero, clamped; 0 unless total is positive."""
    share = (part.cast("float") / F.when(total > 0, total.cast("float"))).cast("float")
    scaled = (share * F.lit(float(SCALE)).cast("float")).cast("double")
    return F.when(total > 0, F.greatest(F.lit(0), F.least(F.lit(SCALE), F.round(scaled).cast("int")))).otherwise(0)


def status(pages: Column, convergence: Column, ambiguity: Column) -> Column:
    """Converged, Ambiguous or Failed; a document without pages has failed."""
    return (
        F.when(pages.isNull() | (pages == 0), "Failed")
        .when((ambiguity <= 1000) & (convergence >= 9000), "Converged")
        .when(convergence >= 5000, "Ambiguous")
        .otherwise("Failed")
    )


def confidence(convergence: Column) -> Column:
    return (convergence / F.lit(SCALE)).cast("float")


def invalid(status: Column, confidence: Column, severity: Column, reason: Column) -> Column:
    """What is wrong with an observation; null if nothing is."""
    return (
        F.when(confidence.isNotNull() & (F.isnan(confidence) | (confidence < 0) | (confidence > 1)), "confidence_out_of_range")
        .when((status == "Converged") & (severity.isNotNull() | reason.isNotNull()), "converged_with_reason")
        .when((status != "Converged") & reason.isNull(), "reason_missing")
    )
