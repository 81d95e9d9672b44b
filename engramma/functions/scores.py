"""Scores and traces as integer expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramma import params as P


def structural_score(shared: str, n_source: str, n_target: str) -> Column:
    """floor(shared * gain / union) in parts per million, 0 without a shared cue."""
    return F.expr(f"CASE WHEN {shared} = 0 THEN 0L ELSE ({shared} * {P.STRUCTURAL_GAIN_PPM}L) div ({n_source} + {n_target} - {shared}) END")


def learned_score(bits: str, samples: str) -> Column:
    """Signed projection of a trace, truncated toward zero."""
    top = f"{P.LEARNED_GAIN_PPM}L * (2 * bit_count({bits}) - {samples}) * {P.FEEDBACK_HISTORY_CAPACITY + P.FEEDBACK_PRIOR_MASS}L"
    return F.expr(f"({top}) div ({P.FEEDBACK_HISTORY_CAPACITY}L * ({samples} + {P.FEEDBACK_PRIOR_MASS}L))")


def activation(structural: Column, learned: Column) -> Column:
    """The two contributions are rounded apart, then added and clamped."""
    return F.least(F.greatest(structural + learned, F.lit(0).cast("long")), F.lit(P.MAX_SCORE).cast("long"))


def ppm_is_valid(ppm: Column) -> Column:
    return ppm.between(0, P.SCALE)


def checked_ppm(ppm: Column) -> Column:
    message = F.concat(F.lit("fixed-point value "), ppm.cast("string"), F.lit(f" exceeds {P.SCALE}"))
    return F.when(ppm_is_valid(ppm), ppm).otherwise(F.raise_error(message).cast("long"))


def helpful_count(bits: Column) -> Column:
    return F.bit_count(bits).cast("long")


def unhelpful_count(bits: Column, samples: Column) -> Column:
    return (samples - F.bit_count(bits)).cast("long")


def trace_is_valid(bits: Column, samples: Column) -> Column:
    """1 to 16 samples, and no bit above them."""
    one = F.lit(1).cast("long")
    limit = F.call_function("shiftleft", one, samples.cast("int"))
    return F.coalesce(samples.between(1, P.FEEDBACK_HISTORY_CAPACITY) & (bits >= 0) & (bits.cast("long") < limit), F.lit(False))


def pushed(bits: Column, samples: Column, helpful: Column) -> tuple[Column, Column]:
    """A trace after one more sample; null traces start with it."""
    old = F.coalesce(bits.cast("long"), F.lit(0).cast("long"))
    new = F.shiftleft(old, 1).bitwiseOR(helpful.cast("long")).bitwiseAND(F.lit(P.HISTORY_MASK).cast("long"))
    return new, F.least(F.coalesce(samples.cast("long"), F.lit(0).cast("long")) + 1, F.lit(P.FEEDBACK_HISTORY_CAPACITY).cast("long"))
