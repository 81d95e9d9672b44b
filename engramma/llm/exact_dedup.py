"""Exact dedup by progressive refinement; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.llm.common import BLANKS, documents, fresh, join_spread, keep_rows, row_keyed, staged, text_of

#: Code points of the normalised text that the prefix hash covers.
PREFIX = 64
#: Rows that one piece of the bitmap of surviving rows covers, and its bytes.
PIECE_ROWS, PIECE_BYTES = 1 << 15, 1 << 12
#: Pieces of the bitmap that may be broadcast: 128 MiB, a thousand million rows. Beyond, texts are joined by their row keys.
MOST_PIECES = 1 << 15


def normalised(text: Column) -> Column:
    for blank in reversed(BLANKS):  # the frequent one last: where a character does not occur, the text is not copied
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def _survivors(rows: DataFrame) -> DataFrame:
    """(length, prefix hash) of the groups of two rows or more: lengths are grouped, then prefix hashes within shared lengths."""
    by_prefix = rows.groupBy("_len", "_pre").agg(F.count("*").alias("_n"))
    lengths = by_prefix.groupBy("_len").agg(F.sum("_n").alias("_rows")).where("_rows > 1").select("_len")
    return by_prefix.where("_n > 1").join(lengths, "_len", "left_semi").select("_len", "_pre", F.col("_n").alias("_in"))


def bitmap_of(keys: DataFrame, total: int) -> DataFrame | None:
    """Pieces (_file, _bucket, _bits) of a bitmap of the rows ``_row`` (file, at) in ``keys``, of ``total`` rows in all; None if it would have more than MOST_PIECES."""
    if total // PIECE_ROWS + keys.select("_row.file").distinct().count() > MOST_PIECES:
        return None
    at = F.col("_row.at") + 1
    return keys.groupBy(F.col("_row.file").alias("_file"), F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))


def marked(df: DataFrame, keys: DataFrame, pieces: DataFrame | None) -> DataFrame:
    """``df`` with ``_survives``: whether its ``_row`` is in ``keys``, by a broadcast bitmap or else by a join."""
    if pieces is None:
        return df.join(keys.select("_row", F.lit(True).alias("_survives")).hint("shuffle_hash"), "_row", "left").withColumn("_survives", F.coalesce("_survives", F.lit(False)))
    at = F.col("_row.at") + 1
    position = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)).eqNullSafe(F.lit(1))
    out = df.join(F.broadcast(pieces), (F.col("_row.file") == F.col("_file")) & (F.bitmap_bucket_number(at) == F.col("_bucket")), "left")
    return out.withColumn("_survives", F.col("_bits").isNotNull() & bit).drop("_file", "_bucket", "_bits")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, carry: dict[str, Column] | None = None, row_col: str | None = None) -> DataFrame:
    """Mark all but one of the rows whose texts are equal without white space.

    Refinement: lengths are grouped first, then, within lengths that two rows share, the hashes of the texts' beginnings;
    only the content of rows in a group of two or more is read again for a full hash, and only equal full hashes make a group
    of copies. A bitmap of row positions, one bit a row, carries the surviving rows to that second scan, so
    no text is shuffled; where it would exceed MOST_PIECES, the rows are joined by their keys instead.

    Returns one row per input row: id, ``keep_id``, ``group_size``, ``kept``,
    ``full_hash`` (null where the refinement ended before) and the ``carry``
    expressions over the input's columns. ``row_col`` names a key made by ``row_keyed``, if the rows have one.

    Of equal texts the row with most code points stays, then the smallest id (null last), then the first row: exactly one
    row of each group, whether or not rows repeat an id. A null text is an empty one; all empty texts are one group.
    Empty table: no rows. Other columns are ignored, whatever their names.
    """
    carry = carry or {}
    if row_col is None:
        row_col = fresh(docs, "_row")
        docs = row_keyed(docs, row_col)
    norm, kept = normalised(text_of(text_col)), [e.alias(f"_carry_{c}") for c, e in carry.items()]
    narrow = [F.col(row_col).alias("_row"), F.col(id_col).alias("_id"), F.length(text_of(text_col)).alias("_points")]
    rows = staged(docs.select(*narrow, F.length(norm).alias("_len"), F.xxhash64(F.substring(norm, 1, prefix)).alias("_pre"), *kept), "signs")
    total, groups = rows.count(), _survivors(rows)
    sign = F.xxhash64("_len", "_pre")
    keyed = rows.select("_row", sign.alias("_sign"))
    keys = staged(join_spread(keyed, groups.select(sign.alias("_sign"), "_in").groupBy("_sign").agg(F.sum("_in").alias("_in")), "_sign", "_in", total, "_row").where("_in is not null").select("_row"), "survivors")
    pieces = bitmap_of(keys, total)
    cols = ["_row", "_id", "_points", *[f"_carry_{c}" for c in carry]]
    # Only the key is looked at before the join; texts of rows that do not survive are not normalised.
    texts = docs.select(F.col(row_col).alias("_row"), F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), *kept)
    full = marked(texts, keys, pieces).where("_survives").select("_row", "_id", F.length("_text").alias("_points"), *cols[3:], F.unhex(F.sha2(normalised(F.col("_text")), 256)).alias("_full"))
    full = staged(full, "full")
    best = F.min(F.struct((-F.col("_points")).alias("points"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    same = full.groupBy("_full").agg(F.count("*").alias("_size"), best.alias("_best")).where("_size > 1").select("_full", "_size", F.col("_best.id").alias("_keep"), F.col("_best.row").alias("_stays"))
    copies = join_spread(full, same, "_full", "_size", total, "_row").drop("_points")
    single = marked(rows.select(*cols), keys, pieces).where("not _survives").select("_row", "_id", *cols[3:], F.lit(None).cast("binary").alias("_full"), F.lit(None).cast("long").alias("_size"), F.col("_id").alias("_keep"), F.col("_row").alias("_stays"))
    out = copies.unionByName(single)
    lone = F.col("_size").isNull()
    return out.select(
        F.col("_id").alias(id_col),
        F.when(lone, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (lone | (F.col("_row") == F.col("_stays"))).alias("kept"),
        F.lower(F.hex("_full")).alias("full_hash"),
        *[F.col(f"_carry_{c}").alias(c) for c in carry],
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    digest = F.sha2(normalised(text_of("text")), 256)
    return exact_dedup(docs, carry={"text_sha256": digest}).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts, also where rows repeat an id or have none.

    Null and empty texts are one group; columns pass through, whatever their names; empty table: no rows.
    """
    key = fresh(docs, "_row")
    docs = row_keyed(docs, key)
    kept = exact_dedup(docs, row_col=key, carry={key: F.col(key)}).where("kept").select(key)
    return keep_rows(docs, kept, key)


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
