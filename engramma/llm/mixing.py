"""Mixing sources to target weights by systematic sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramma.llm.common import documents, fresh, join_spread, row_keyed, staged, text_of

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = 3
MOST = 3
SEED = "engramma-mix"
#: Offsets drawn per source.
OFFSETS = 16
#: Rows of a part of a source on average, and how many times as many make a part that is split.
PART_ROWS = 1000
HEAVY = 16
#: The most pieces of the equal rows of a part that is split.
TIES = 4096


def source_targets(sizes: DataFrame) -> DataFrame:
    """Target of each source: shares by weight, none above MOST times the source's size.

    ``sizes``: _source (null is a source), _words. One row per source, so the
    windows over all sources are small. Resharing the excess by weight until no
    target is too high ends where a level L has min(L * weight, cap) summing to
    the total; sources sorted by cap / weight give it from running sums.
    """
    order = Window.orderBy(F.col("_source").isNull(), "_source")
    whole = Window.partitionBy()
    s = sizes.withColumn("_w", (F.pmod(F.row_number().over(order) - 1, F.lit(CYCLE)) + 1).cast("long")).withColumn("_cap", F.col("_words") * MOST)
    s = s.withColumn("_total", F.sum("_words").over(whole)).withColumn("_weights", F.sum("_w").over(whole))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").isNull(), "_source").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_caps", F.coalesce(F.sum("_cap").over(by_level), F.lit(0))).withColumn("_used", F.coalesce(F.sum("_w").over(by_level), F.lit(0)))
    # Capped: its cap is at most its weight times the level of those not capped before it.
    s = s.withColumn("_capped", F.col("_cap") * (F.col("_weights") - F.col("_used")) <= F.col("_w") * (F.col("_total") - F.col("_caps")))
    s = s.withColumn("_over", F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0)).over(whole)).withColumn("_out", F.sum(F.when(F.col("_capped"), F.col("_w")).otherwise(0)).over(whole))
    level = (F.col("_w") * (F.col("_total") - F.col("_over"))).cast("double") / (F.col("_weights") - F.col("_out"))
    return s.select("_source", "_words", F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(level).alias("_target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, offsets: int = OFFSETS, carry: dict[str, Column] | None = None) -> DataFrame:
    """How often each document enters the mix: systematic sampling within its source.

    Documents of a source stand in the order of a hash of their id; the running sum of
    their expected copies, target / size of the source each, plus one offset in
    [0, 1) crosses an integer once per copy. Of ``offsets`` offsets drawn from ``seed`` and the source the one whose words
    end nearest to the target is taken, the first of equal ones. In the order of their sizes, all offsets would take or leave
    the longest documents alike; in this one they differ. The running sum is found from counts per (source, part),
    so that no source, however large, is ranked by one task. Only rows that repeat an id, or have none, can fill a part: a part
    of over HEAVY times the mean falls into pieces by size, and rows equal in id and size, whose order is free, into up to TIES.

    Returns id, ``size`` (words), ``source_size``, ``target``, ``copies``,
    ``taken`` (copies times size) and the ``carry`` expressions. A null text has no words; a null source is a
    source, the last one. Repeated rows are documents of their own; reruns agree. Empty table: no rows. Other columns are ignored.
    """
    carry = carry or {}
    key = F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("n")).alias("_key")
    words = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("_size")
    rows = staged(docs.select(F.monotonically_increasing_id().alias("_at"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), words, *[e.alias(f"_carry_{c}") for c, e in carry.items()]), "mix")
    total = rows.count()
    parts = max(1, min(1 << 20, total // PART_ROWS))
    rows = rows.select("*", key, F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")).cast("binary")).alias("_order"))
    rows = rows.withColumn("_part", F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * parts / (1 << 32)))
    cells = staged(rows.groupBy("_key", "_part").agg(F.count("*").alias("_n"), F.sum("_size").alias("_sum")), "cells")
    sources = cells.groupBy("_key").agg(F.sum("_sum").alias("_words")).withColumn("_source", F.when(F.col("_key") != "n", F.substring("_key", 2, 1 << 30)))
    targets = source_targets(sources).select(key, "_words", "_target")
    # Fewer than parts / HEAVY parts can be that large, which bounds what is broadcast.
    least = HEAVY * max(PART_ROWS, total // parts)
    heavy = cells.where(F.col("_n") > least).select("_key", "_part", F.least(F.ceil(F.col("_n") / PART_ROWS), F.lit(TIES)).alias("_ties"))
    rows = rows.join(F.broadcast(heavy), ["_key", "_part"], "left")
    is_heavy = F.col("_ties").isNotNull()
    split = {
        "_same": F.when(is_heavy, F.concat("_order", F.col("_id").isNotNull().cast("string"))).otherwise(""),
        "_long": F.when(is_heavy, F.col("_size")).otherwise(0),
        "_tie": F.when(is_heavy, F.pmod(F.xxhash64("_at"), "_ties")).otherwise(0),
    }
    rows = rows.withColumns(split)
    cell = ["_key", "_part", *split]
    before = Window.partitionBy("_key").orderBy(*cell[1:]).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*cell).agg(F.count("*").alias("_n")).select(*cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    cells = starts.join(targets, "_key")
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("_order", "_id", "_size"))
    rate = F.when(F.col("_words") > 0, F.col("_target") / F.col("_words")).otherwise(0.0)
    place = (F.col("_start") + F.col("_rank")).cast("double")
    rows = rows.withColumn("_rank", rank).join(cells, cell).select("_id", "_key", "_size", "_words", "_target", rate.alias("_rate"), place.alias("_place"), *[f"_carry_{c}" for c in carry])
    rows = staged(rows, "ranked")
    # One number per source and offset: how far the words that it takes end from the target.
    drawn = lambda k: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}{k}"), F.col("_key")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    crossed = lambda o: F.floor(F.col("_place") * F.col("_rate") + o) - F.floor((F.col("_place") - 1) * F.col("_rate") + o)
    ends = rows.groupBy("_key").agg(F.first("_target").alias("_t"), *[F.sum(crossed(drawn(k)) * F.col("_size")).alias(f"_end{k}") for k in range(offsets)])
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"_end{k}") - F.col("_t")).alias("far"), F.lit(k).alias("k"), drawn(k).alias("offset")) for k in range(offsets)]))
    chosen = ends.select("_key", nearest["offset"].alias("_offset"))
    copies = crossed(F.col("_offset")).cast("long")
    # One row per source, with no list of rows in it: a join by source would deal a hot source to one task.
    out = join_spread(rows, rows.groupBy("_key").agg(F.count("*").alias("_rows")).join(chosen, "_key"), "_key", "_rows", total, "_place")
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_words").alias("source_size"), F.col("_target").alias("target"), copies.alias("copies"), (copies * F.col("_size")).alias("taken"), *[F.col(f"_carry_{c}").alias(c) for c in carry])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it.

    Rows that repeat an id, or have none, are taken each by its own count; a null text has no words and a null source is
    a source. Columns pass through, whatever their names; empty table: no rows.
    """
    key, copies, copy = (fresh(docs, name) for name in ("_row", "_copies", "_copy"))
    docs = row_keyed(docs, key)
    counts = mix(docs, carry={key: F.col(key)}).where("copies > 0").select(key, F.col("copies").cast("int").alias(copies))
    out = docs.join(counts.hint("shuffle_hash"), key)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(key, copies, copy)


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS words, sum(size)::BIGINT * 3 AS cap,
         ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT AS w
  FROM d GROUP BY source
), s1 AS (
  SELECT *, (sum(words) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS weights,
         coalesce(sum(cap) OVER lower, 0)::BIGINT AS caps, coalesce(sum(w) OVER lower, 0)::BIGINT AS used
  FROM s0 WINDOW lower AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s2 AS (SELECT *, cap * (weights - used) <= w * (total - caps) AS capped FROM s1),
s3 AS (
  SELECT *, (sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::BIGINT AS over_, (sum(CASE WHEN capped THEN w ELSE 0 END) OVER ())::BIGINT AS out_ FROM s2
), s4 AS (
  SELECT source, words, CASE WHEN capped THEN cap::DOUBLE ELSE (w * (total - over_))::DOUBLE / (weights - out_)::DOUBLE END AS target
  FROM s3
), r AS (
  SELECT d.*, s4.words, s4.target, CASE WHEN s4.words > 0 THEN s4.target / s4.words::DOUBLE ELSE 0.0::DOUBLE END AS rate
  FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source
), k AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size))::DOUBLE AS place FROM r
), o AS (
  SELECT source, n, ('0x' || substr(md5('engramma-mix' || n || coalesce('s' || source, 'n')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS o
  FROM s4, range(16) t(n)
), e AS (
  SELECT k.source, o.n, o.o, abs(sum((floor(place * rate + o) - floor((place - 1) * rate + o))::BIGINT * size)::DOUBLE - any_value(target)) AS far
  FROM k JOIN o ON k.source IS NOT DISTINCT FROM o.source GROUP BY k.source, o.n, o.o
), b AS (SELECT source, o FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY far, n) = 1)
SELECT doc_id, size, words AS source_size, target, ((floor(place * rate + o) - floor((place - 1) * rate + o)) * size)::BIGINT AS taken
FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source
"""
