"""Quality by compression: sizes under dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.llm.common import documents, small_batches, text_of
from engramma.llm.language_id import fold

#: Labelled rows that a fit takes at most of each class, and code points of text of each of those, in PARTS parts of a longer text.
SAMPLE = 1500
SAMPLE_BYTES = 1 << 16
PARTS = 32
DICTIONARY = 112_640
#: Bytes that are compressed at once: a long text's own beginning must not replace the dictionary.
CHUNK = 2048
LEVEL = 3
THRESHOLD = 0.3


def chunks(data: bytes) -> list[bytes]:
    return [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]


def dictionary(texts: list[bytes]):
    """A zstandard dictionary of the texts; of plain content where they are too few to train one."""
    import zstandard

    samples = [c for t in texts for c in chunks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


class Sizer:
    """Compressed sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.both = []
        for d in (good, bad):
            data = zstandard.ZstdCompressionDict(d) if len(d) >= 8 else None
            if data:
                data.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False))

    def difference(self, text: str) -> float:
        """(bad - good) / (bad + good): over 0 if the good dictionary explains the text better; 0 for an empty text."""
        parts = chunks(text.encode("utf-8", "surrogatepass"))
        good, bad = (sum(len(z.compress(p)) for p in parts) for z in self.both)
        return (bad - good) / (bad + good) if parts else 0.0


class QualityModel:
    def __init__(self, good: bytes, bad: bytes, slope: float, offset: float):
        self.good, self.bad, self.slope, self.offset = good, bad, slope, offset

    def probability(self, difference: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * difference + self.offset, -30, 30))))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Weighted logistic regression of one input by Newton's method, lightly regularised."""
    spread = float(x.std()) or 1.0
    a = np.stack([x / spread, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (y - p)) - 1e-3 * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(hess, grad)
    return float(w[0] / spread), float(w[1])


def train_model(good: list[str], bad: list[str], n_good: int, n_bad: int) -> QualityModel:
    """Dictionaries from every other text, calibration on the rest, weighted to the classes' true numbers.

    With no text of a class the score is the share of good labels, or 0.5.
    """
    if not good or not bad:
        prior = (n_good + 1) / (n_good + n_bad + 2)
        return QualityModel(b"", b"", 0.0, float(np.log(prior / (1 - prior))))
    some = lambda texts, k: texts[k::2] or texts
    d_good, d_bad = (dictionary([t.encode("utf-8", "surrogatepass") for t in some(texts, 0)]) for texts in (good, bad))
    sizer = Sizer(d_good, d_bad)
    left = [(sizer.difference(t), y) for y, texts in ((1, good), (0, bad)) for t in some(texts, 1)]
    x, y = np.array([v for v, _ in left]), np.array([v for _, v in left])
    share = {1: n_good / max(1, (y == 1).sum()), 0: n_bad / max(1, (y == 0).sum())}
    weight = np.array([share[v] for v in y])
    slope, offset = calibrate(x, y, weight / weight.mean())
    return QualityModel(d_good, d_bad, slope, offset)


def bounded(text: F.Column) -> F.Column:
    """A text of at most SAMPLE_BYTES code points whole; of a longer one so many in PARTS parts, evenly spread."""
    size = SAMPLE_BYTES // PARTS
    step = (F.length(text) - size) / (PARTS - 1)
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.substring(text, (i * step).cast("int") + 1, F.lit(size)))
    return F.when(F.length(text) > SAMPLE_BYTES, F.array_join(parts, "")).otherwise(text)


def fit_quality_model(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Fit on at most ``sample`` labelled texts per class, those with the least hashes of their ids.

    Of a text over SAMPLE_BYTES code points as many are taken, from PARTS places all over it. Labels other
    than 0 and 1, and null ids, are ignored; an id with several labels counts with each; rows that repeat an id
    count as one, the least by text. So at most 2 x ``sample`` bounded texts come to the driver. No label: every score is 0.5.
    """
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").withColumn("_h", F.xxhash64("_id"))
    totals = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    chosen = rows.where("_y = 1").orderBy("_h", "_id").limit(sample).unionByName(rows.where("_y = 0").orderBy("_h", "_id").limit(sample)).select("_id", "_y").distinct()
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    got = texts.join(F.broadcast(chosen), "_id").select("_id", "_y", bounded(F.col("_text")).alias("_text")).groupBy("_id", "_y").agg(F.min("_text").alias("_text")).collect()
    got = sorted(got, key=lambda r: (str(r["_id"]), r["_text"]))
    return train_model([r["_text"] for r in got if r["_y"] == 1], [r["_text"] for r in got if r["_y"] == 0], totals.get(1, 0), totals.get(0, 0))


def score_quality(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``size_difference`` and ``score`` of every whole text, compressed chunk by chunk.

    A null text is an empty one, whose difference is 0. Repeated rows are scored
    each; other columns are ignored; empty table: no rows.
    """
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(model.good, model.bad)
        for b in batches:
            d = [sizer.difference(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d, pa.float64()), pa.array([model.probability(v) for v in d], pa.float64())], names=["_id", "size_difference", "score"])

    plain = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    return plain.mapInArrow(score, f"_id {dict(docs.dtypes)[id_col]}, size_difference double, score double").withColumnRenamed("_id", id_col)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality_model(docs, labels.where(~fold(5, 0)))
    found = score_quality(docs, model)
    return found.select("doc_id", fold(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
