"""The analytical tables as episodes, feedback events and symbol batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kv(df: DataFrame, seq: str, key: str, value: str) -> DataFrame:
    return df.select(F.col(seq).cast("long").alias("seq"), F.lit(key).alias("key"), F.lower(F.col(value).cast("string")).alias("value")).where("value is not null")


def customer_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as episodes: segment, nation, region, and the statuses and priorities of their orders."""
    c, n, r, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    placed = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    orders = o.select("o_custkey", "o_orderstatus", "o_orderpriority").distinct().join(c.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    parts = [_kv(c, "c_custkey", "segment", "c_mktsegment"), _kv(placed, "c_custkey", "nation", "n_name"), _kv(placed, "c_custkey", "region", "r_name"), _kv(orders, "o_custkey", "status", "o_orderstatus"), _kv(orders, "o_custkey", "priority", "o_orderpriority")]
    return reduce(DataFrame.unionByName, parts).distinct()


def part_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as episodes: brand, type, size, and the words of their names."""
    p = table(spark, sf_dir, "part")
    words = p.select("p_partkey", F.explode(F.split("p_name", " ")).alias("w")).where("w <> ''")
    return reduce(DataFrame.unionByName, [_kv(p, "p_partkey", "brand", "p_brand"), _kv(p, "p_partkey", "type", "p_type"), _kv(p, "p_partkey", "size", "p_size"), _kv(words, "p_partkey", "name", "w")]).distinct()


def samples(spark: SparkSession, sf_dir: str, modulus: int | None = None) -> DataFrame:
    """Feedback samples of the events: user -> props.k, helpful for purchase and click, unhelpful for error; self edges drop out."""
    fold = lambda c: c % modulus if modulus else c
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "click", "error", "signup"))
    x = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") != "signup", 1)
    rows = e.select(F.col("event_id").cast("long").alias("event_id"), fold(F.col("user_id").cast("long")).alias("from_seq"), fold(F.get_json_object("props", "$.k").cast("long")).alias("to_seq"), x.cast("int").alias("x"))
    return rows.where("from_seq <> to_seq")


def customer_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples whose both ends are customers."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"))
    rows = samples(spark, sf_dir).where("x is not null")
    return rows.join(ids.withColumnRenamed("id", "from_seq"), "from_seq", "left_semi").join(ids.withColumnRenamed("id", "to_seq"), "to_seq", "left_semi")
