"""The symbol catalog: interning, resolving, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramma.functions.symbols import normalised
from engramma.sources.stage import numbered

#: The greatest id: ids are signed 64-bit numbers inside.
MAX_ID = (1 << 63) - 1


def normalised_batch(texts: DataFrame, text: str = "text", pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(rows (pos, value), rejected rows (pos, detail)) of a batch; each distinct text is normalised once."""
    unique = texts.select(F.col(text).alias("_t")).distinct().withColumn("_n", normalised(F.col("_t")))
    rows = texts.join(unique, texts[text].eqNullSafe(F.col("_t"))).select(F.col(pos).alias("pos"), "_n.value", "_n.detail")
    return rows.where("detail is null").select("pos", "value"), rows.where("detail is not null").select("pos", "detail")


def batch_positions(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unique values (place, value) by first occurrence, (pos, place) of every row) of normalised rows (pos, value)."""
    first = batch.groupBy("value").agg(F.min("pos").alias("_first"))
    unique = numbered(first, "place", "_first").select("place", "value")
    return unique, batch.join(unique, "value").select("pos", "place")


def allocated(tail: Column, count: Column, most: int = MAX_ID) -> Column:
    """struct(first, last) of ``count`` ids after ``tail`` of them are taken; null if the ids up to ``most`` do not suffice."""
    wide = lambda c: c.cast("decimal(20,0)")
    last = wide(tail) + wide(count) - 1
    return F.when((count > 0) & (last <= F.lit(str(most)).cast("decimal(20,0)")), F.struct(tail.cast("long").alias("first"), last.cast("long").alias("last")))


def tail_of(table: DataFrame, id_col: str = "id") -> DataFrame:
    """(rows, tail): how many rows, and the id that follows the greatest; equal for an exact prefix."""
    return table.agg(F.count("*").alias("rows"), F.coalesce(F.max(id_col) + 1, F.lit(0)).cast("long").alias("tail"))


def interned(batch: DataFrame, catalog: DataFrame, tail: int) -> tuple[DataFrame, DataFrame]:
    """(ids (pos, id), new symbols (id, value)) of normalised rows (pos, value).

    Known values keep their id; new ones follow the tail in the order of their first place.
    """
    first = batch.groupBy("value").agg(F.min("pos").alias("_first"))
    new = numbered(first.join(catalog.select("value"), "value", "left_anti"), "id", "_first", start=tail).select("id", "value")
    every = catalog.select("id", "value").unionByName(new)
    return batch.join(every, "value").select("pos", "id"), new


def resolved(ids: DataFrame, catalog: DataFrame) -> DataFrame:
    """(pos, id, value) of rows (pos, id); unknown ids have a null value."""
    return ids.join(catalog.select("id", "value"), "id", "left").select("pos", "id", "value")


def invalid_symbols(catalog: DataFrame, count: int) -> DataFrame:
    """Rows that break the catalog: ids not 0..count-1 once each, values repeated or not canonical."""
    checked = catalog.withColumn("_n", normalised(F.col("value")))
    bad = checked.where(F.col("_n.value").isNull() | (F.col("_n.value") != F.col("value"))).select("id", F.coalesce("_n.detail", F.lit("symbol value is not canonical")).alias("detail"))
    ids = catalog.groupBy("id").agg(F.count("*").alias("n")).where(f"n > 1 or id < 0 or id >= {count} or id is null").select("id", F.lit("identifiers are not contiguous").alias("detail"))
    twice = catalog.groupBy("value").agg(F.count("*").alias("n"), F.max("id").alias("id")).where("n > 1").select("id", F.lit("symbol value is repeated").alias("detail"))
    return bad.unionByName(ids).unionByName(twice)
