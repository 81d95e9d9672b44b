"""Feedback: events to bounded traces, upserts, and the difference of two states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramma import params as P
from engramma.functions.scores import trace_is_valid
from engramma.operators.episodes import dangling

EDGE = ("from_seq", "to_seq")


def event_targets(events: DataFrame, most: int = P.MAX_FEEDBACK_TARGETS) -> tuple[DataFrame, DataFrame]:
    """(samples, rejected events) of events (event_id, source, targets, helpful).

    The length limit counts targets as given; then repeats and the source itself drop out.
    """
    too_many = F.size("targets") > most
    samples = events.where(~too_many).select("event_id", F.col("source").alias("from_seq"), F.explode(F.array_distinct("targets")).alias("to_seq"), F.col("helpful").cast("int").alias("x")).where("from_seq <> to_seq")
    return samples, events.where(too_many).select("event_id", F.size("targets").alias("count"))


def fold(samples: DataFrame, order: str = "event_id") -> DataFrame:
    """Samples (from_seq, to_seq, x, order) to one trace per edge: bit 0 is the newest, 16 at most.

    The rank limit is applied before the shuffle too, so an edge sends at most 16
    samples per task, however many it has.
    """
    newest = Window.partitionBy(*EDGE).orderBy(F.desc(order))
    last = samples.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= P.FEEDBACK_HISTORY_CAPACITY)
    return last.groupBy(*EDGE).agg(F.expr("bit_or(shiftleft(cast(x AS BIGINT), _rn - 1))").alias("history_bits"), F.count("*").alias("sample_count"))


def fold_with_resets(log: DataFrame, order: str = "event_id") -> DataFrame:
    """A log that also sets traces: rows with ``set_bits`` and ``set_count`` replace what came before on their edge.

    Only the last set and the samples after it count. The last set is found by an
    aggregate with map-side combining, then samples fold as ever.
    """
    sets = log.where("set_count is not null").groupBy(*EDGE).agg(F.max(F.struct(order, "set_bits", "set_count")).alias("_set"))
    after = log.where("set_count is null").join(sets, list(EDGE), "left").where(F.col("_set").isNull() | (F.col(order) > F.col(f"_set.{order}")))
    new = fold(after.select(*EDGE, order, "x"), order)
    out = sets.join(new, list(EDGE), "full")
    k = F.coalesce("sample_count", F.lit(0)).cast("int")
    base = F.coalesce(F.col("_set.set_bits"), F.lit(0)).cast("long")
    bits = F.call_function("shiftleft", base, k).bitwiseOR(F.coalesce("history_bits", F.lit(0)).cast("long")).bitwiseAND(F.lit(P.HISTORY_MASK).cast("long"))
    count = F.least(F.coalesce(F.col("_set.set_count"), F.lit(0)).cast("long") + k, F.lit(P.FEEDBACK_HISTORY_CAPACITY).cast("long"))
    return out.select(*EDGE, bits.alias("history_bits"), count.alias("sample_count"))


def folded_onto(edges: DataFrame, samples: DataFrame, order: str = "event_id") -> DataFrame:
    """Existing traces with new samples appended: new ones shift the old ones up, the oldest fall off."""
    new = fold(samples, order).select(*EDGE, F.col("history_bits").alias("_b"), F.col("sample_count").alias("_n"))
    k = F.coalesce("_n", F.lit(0)).cast("int")
    old = F.coalesce("history_bits", F.lit(0)).cast("long")
    bits = F.call_function("shiftleft", old, k).bitwiseOR(F.coalesce("_b", F.lit(0)).cast("long")).bitwiseAND(F.lit(P.HISTORY_MASK).cast("long"))
    count = F.least(F.coalesce("sample_count", F.lit(0)).cast("long") + k, F.lit(P.FEEDBACK_HISTORY_CAPACITY).cast("long"))
    return edges.join(new, list(EDGE), "full").select(*EDGE, bits.alias("history_bits"), count.alias("sample_count"))


def upserted(edges: DataFrame, traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with ``traces`` put in, what they replaced)."""
    kept = edges.join(traces.select(*EDGE), list(EDGE), "left_anti")
    previous = edges.join(traces.select(*EDGE), list(EDGE), "left_semi")
    return kept.unionByName(traces.select(*edges.columns)), previous


def reconciled(persisted: DataFrame, wanted: DataFrame) -> DataFrame:
    """Inserts, updates and deletes that turn one state into the other."""
    a = persisted.select(*EDGE, F.struct("history_bits", "sample_count").alias("_old"))
    b = wanted.select(*EDGE, F.struct("history_bits", "sample_count").alias("_new"))
    op = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    trace = F.coalesce("_new", "_old")
    return a.join(b, list(EDGE), "full").select(*EDGE, op.alias("op"), trace["history_bits"].alias("history_bits"), trace["sample_count"].alias("sample_count")).where("op is not null")


def invalid_edges(edges: DataFrame, episodes: DataFrame) -> DataFrame:
    """Edges that may not be stored, with the first reason: unknown endpoint, self edge, bad trace."""
    unknown = dangling(edges.select(F.explode(F.array(*EDGE)).alias("v")), "v", episodes)
    rows = edges.join(unknown.withColumnRenamed("value", "from_seq").withColumn("_f", F.lit(True)), "from_seq", "left").join(unknown.withColumnRenamed("value", "to_seq").withColumn("_t", F.lit(True)), "to_seq", "left")
    detail = F.when(F.col("_f") | F.col("_t"), "unknown endpoint").when(F.col("from_seq") == F.col("to_seq"), "self edge").when(~trace_is_valid(F.col("history_bits"), F.col("sample_count")), "trace is not canonical")
    return rows.select(*EDGE, "history_bits", "sample_count", detail.alias("detail")).where("detail is not null")
