"""Episodes: canonical form, key-value rows, appending and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramma.errors import EmptyAttributeValues, EmptyEpisodeAttributes
from engramma.sources.stage import numbered

ATTRIBUTES = "array<struct<key:bigint,values:array<bigint>>>"


def canonical_attributes(attributes: list[tuple[int, list[int]]]) -> list[tuple[int, list[int]]]:
    """Keys ascending and once, values ascending and once; repeated keys are united."""
    if not attributes:
        raise EmptyEpisodeAttributes
    united: dict[int, set[int]] = {}
    for key, values in attributes:
        if not values:
            raise EmptyAttributeValues
        united.setdefault(key, set()).update(values)
    return [(k, sorted(united[k])) for k in sorted(united)]


def canonical_episodes(kv: DataFrame, *by: str) -> DataFrame:
    """Rows (by..., key, value) to one row per episode with canonical ``attributes``."""
    by = by or ("seq",)
    per_key = kv.groupBy(*by, "key").agg(F.sort_array(F.collect_set("value")).alias("values"))
    return per_key.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("key", "values"))).alias("attributes"))


def canonical_column(attributes: str = "attributes") -> F.Column:
    """The canonical form of a nested attribute list, within the row."""
    keys = F.array_sort(F.array_distinct(F.transform(attributes, lambda a: a["key"])))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(attributes, lambda a: a["key"] == k), lambda a: a["values"])))).alias("values")))


def key_values(episodes: DataFrame) -> DataFrame:
    """Nested episodes to distinct rows (seq, key, value)."""
    return episodes.select("seq", F.explode("attributes").alias("a")).select("seq", F.col("a.key").alias("key"), F.explode("a.values").alias("value")).distinct()


def empty_parts(drafts: DataFrame) -> DataFrame:
    """Drafts that break a rule: no attribute, or an attribute without values."""
    bare = F.exists("attributes", lambda a: F.coalesce(F.size(a["values"]), F.lit(0)) <= 0)
    detail = F.when(F.coalesce(F.size("attributes"), F.lit(0)) <= 0, str(EmptyEpisodeAttributes())).when(bare, str(EmptyAttributeValues()))
    return drafts.withColumn("detail", detail).where("detail is not null")


def unknown_symbols(episodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct keys and values (value) of episodes that the catalog (id) lacks."""
    return dangling(key_values(episodes).select(F.explode(F.array("key", "value")).alias("v")), "v", symbols, "id")


def scanned(episodes: DataFrame, reverse: bool = False) -> DataFrame:
    """All episodes in the order of their sequence, or against it."""
    return episodes.orderBy(F.desc("seq") if reverse else F.asc("seq"))


def appended(drafts: DataFrame, tail: int, *order: str) -> DataFrame:
    """Give drafts the sequences tail, tail + 1, ... in batch order; equal contents stay distinct."""
    return numbered(drafts, "seq", *order, start=tail)


def sequence_gaps(episodes: DataFrame, count: int, column: str = "seq") -> DataFrame:
    """Sequences that break the exact prefix 0..count-1: out of range or repeated (value, n).

    Of ``count`` rows, all in range and none repeated, none can be missing.
    """
    return episodes.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where((F.col("n") > 1) | (F.col("value") < 0) | (F.col("value") >= count) | F.col("value").isNull())


def dangling(rows: DataFrame, column: str, episodes: DataFrame, key: str = "seq") -> DataFrame:
    """Distinct values of ``column`` that no episode (or symbol) has."""
    return rows.select(F.col(column).alias("value")).distinct().join(episodes.select(F.col(key).alias("value")), "value", "left_anti")
