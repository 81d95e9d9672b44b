"""Feedback as a stream: bounded traces per edge, kept in Spark's state or in a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engramma import params as P
from engramma.operators import feedback

TRACE = "from_seq long, to_seq long, history_bits long, sample_count long"
#: Micro-batches after which one writes all traces, so that readers need no more segments than that.
WHOLE = 16


def traces_at(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The traces that ``fold_stream`` has written, up to the micro-batch before ``before``: the newest of each edge."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
    done = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))
    done = [n for n in done if before is None or n < before]
    done = [n for n in done if n >= max((w for w in done if w % WHOLE == 0), default=0)]
    if not done:
        return spark.createDataFrame([], TRACE)
    rows = spark.read.schema(f"{TRACE}, written long").parquet(*[f"{path}/batch={n}" for n in done])
    return rows.groupBy(*feedback.EDGE).agg(F.max(F.struct("written", "history_bits", "sample_count")).alias("_t")).select(*feedback.EDGE, "_t.history_bits", "_t.sample_count")


def fold_stream(samples: DataFrame, path: str) -> DataStreamWriter:
    """A writer that folds a stream of samples (event_id, from_seq, to_seq, x) onto a table of traces; without Python per row.

    Each micro-batch writes the traces it changed under its number, every WHOLE-th all of them; run again after a failure, it
    writes the same once more. Within a micro-batch samples apply in the order of their event id, which
    tells them apart; a sample that comes later than a batch that held newer ones counts as the newest.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = traces_at(spark, path, number)
        if number % WHOLE:
            known = known.join(batch.select(*feedback.EDGE).distinct(), list(feedback.EDGE), "left_semi")
        feedback.folded_onto(known, batch).withColumn("written", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return samples.where("from_seq <> to_seq").writeStream.foreachBatch(write)


def stream_traces(samples: DataFrame) -> DataFrame:
    """A stream of samples (event_id, from_seq, to_seq, x) to a stream of updated traces, kept in Spark's own state.

    Within a micro-batch samples apply in the order of their event id; a sample
    that comes later than a batch that held newer ones counts as the newest.
    Update mode: each batch emits the traces it changed.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bits, n = state.get if state.exists else (0, 0)
        new = pd.concat(list(batches)).sort_values("event_id", kind="stable")
        last = new["x"].to_numpy()[-P.FEEDBACK_HISTORY_CAPACITY :]
        for x in last.tolist():
            bits = (bits << 1 | int(x)) & P.HISTORY_MASK
        n = min(P.FEEDBACK_HISTORY_CAPACITY, n + len(new))
        state.update((bits, n))
        yield pd.DataFrame({"from_seq": [key[0]], "to_seq": [key[1]], "history_bits": [bits], "sample_count": [n]})

    return samples.where("from_seq <> to_seq").groupBy("from_seq", "to_seq").applyInPandasWithState(update, TRACE, "history_bits long, sample_count long", "update", GroupStateTimeout.NoTimeout)
