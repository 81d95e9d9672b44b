"""Helpers shared by the corpus operators: staging, skew-safe joins, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot when it holds more than one row in HOT_SHARE; so fewer
#: than HOT_SHARE keys can be hot, which bounds what is broadcast for them.
HOT_SHARE = 1000
#: The six characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"

#: Rows and bytes of the Arrow batches that Python workers hold, where the session has no bounds of its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set and all run in one process (tests).

    A cluster without a shared folder is an error: each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="engramma-")
    return _own[context.applicationId]


def folder_for(spark: SparkSession, name: str) -> str:
    """A new folder for a table of this application, deleted when the application ends."""
    path = f"{shared_dir(spark)}/engramma/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = made.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(made)
    files.deleteOnExit(made)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    A lost executor then costs no recomputation of what lies before, and a
    table that is read several times is computed once.
    """
    path = folder_for(df.sparkSession, name) + "/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        made = spark._jvm.org.apache.hadoop.fs.Path(path)
        made.getFileSystem(spark._jsc.hadoopConfiguration()).delete(made, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of whole texts, unless the session was given bounds."""
    given = spark.conf.getAll
    for name, value in BATCH.items():
        if name not in given:
            spark.conf.set(name, value)


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or it with as many underscores as make it no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _is_scan(docs: DataFrame) -> bool:
    """Whether a table is one scan with projections and deterministic filters, whose rows are found again by their place."""
    node = docs._jdf.queryExecution().analyzed()
    while node.children().size() == 1:
        if node.nodeName() not in ("Project", "Filter", "SubqueryAlias", "View") or not node.deterministic():
            return False
        node = node.children().head()
    return node.children().isEmpty()


def row_keyed(docs: DataFrame, name: str = "_row") -> DataFrame:
    """``docs`` with a key of each row that every later scan repeats: its file and its place in it.

    So rows that are equal in every column are told apart without writing the
    texts again. A table that is not read from files, or is more than a scan of them, is written first.
    """
    try:
        if _is_scan(docs):
            place = docs.metadataColumn("_metadata")
            out = docs.withColumn(name, F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at")))
            out.schema  # noqa: B018 - resolved here, or not at all
            return out
    except AnalysisException:
        pass
    written = staged(docs, "rows")
    place = written.metadataColumn("_metadata")
    return written.withColumn(name, F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def join_spread(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, by: str) -> DataFrame:
    """``rows`` left join ``groups`` on ``key``, whatever share of the rows a key holds.

    ``groups`` has one row per key with ``size``, the key's number of rows in
    ``rows`` or less, summing up to ``total`` or less. Keys over ``total / HOT_SHARE``, of which there
    are fewer than HOT_SHARE, are broadcast; their rows are spread by ``by`` over
    all tasks of the shuffled join that serves the other keys.
    """
    cols = [c for c in groups.columns if c != key]
    is_hot = F.col(size) * HOT_SHARE > F.lit(total)
    hot = groups.where(is_hot).select(F.col(key).alias("_hk"), F.struct(*cols).alias("_hot"))
    # Zero, but not a literal: of a constant Catalyst would make a filter, and deal the rows by the key alone.
    zero = F.pmod(F.xxhash64(key), F.lit(1))
    cold = groups.where(~is_hot).select(F.col(key).alias("_ck"), zero.alias("_cs"), F.struct(*cols).alias("_cold"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    out = out.withColumn("_s", F.when(F.col("_hk").isNull() & F.col(key).isNotNull(), 0).otherwise((F.pmod(F.xxhash64(by), F.lit(1 << 20)) + 1).cast("long")))
    out = out.join(cold, (F.col(key) == F.col("_ck")) & (F.col("_s") == F.col("_cs")), "left")
    got = F.coalesce("_hot", "_cold")
    return out.select(*rows.columns, *[got[c].alias(c) for c in cols])


def keep_rows(docs: DataFrame, kept: DataFrame, key: str = "_row") -> DataFrame:
    """The rows of ``docs`` whose ``key`` is in ``kept`` (narrow, one row per key), without the key.

    The hash table is built of keys, so texts are dealt but never sorted.
    """
    return docs.join(kept.select(F.col(key)).hint("shuffle_hash"), key, "left_semi").drop(key)
