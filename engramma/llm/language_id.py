"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.llm.common import documents, fresh, small_batches, text_of

BUCKETS = 1 << 13
WIDTHS = (1, 2, 3)
#: Labelled rows that a fit takes at most, those with the least hash of their id.
SAMPLE = 4000
EMBED = 16
UNKNOWN = "und"
#: Share of training examples that are thinned to a short text's few subwords.
SHORT = 0.5
#: Code points that are counted at once.
PIECE = 1 << 16


def letter_table() -> np.ndarray:
    """Which code points are letters; all beyond the basic plane count as letters."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)] + [True])


def subword_counts(text: str, letter: np.ndarray) -> np.ndarray:
    """How often each bucket occurs among a text's runs of one to three characters.

    Runs of other characters than letters count as one space.
    """
    out = np.zeros(BUCKETS, np.int64)
    lowered = text.lower()
    for at in range(0, len(lowered), PIECE):
        part = lowered[at : at + PIECE + max(WIDTHS) - 1]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letter[np.minimum(points, 1 << 16)]
        points = np.where(is_letter, points, np.uint32(32))[is_letter | np.r_[True, is_letter[:-1]]]
        h = np.zeros(len(points), np.uint32)
        for n in range(1, max(WIDTHS) + 1):
            h = (h[: max(0, len(points) - n + 1)] + points[n - 1 :]) * np.uint32(0x9E3779B1)
            if n in WIDTHS:
                out += np.bincount((h[: min(PIECE, len(h))] >> np.uint32(19)), minlength=BUCKETS)
    return out


class LanguageModel:
    """Subword embeddings, averaged over a text, a linear softmax, a temperature and a bound for rejection."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, reject_below: float):
        self.languages, self.weights, self.bias = languages, weights, bias
        self.temperature, self.reject_below = temperature, reject_below

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        total = counts.sum()
        if not self.languages or not total:
            return UNKNOWN, 0.0
        logits = (counts @ self.weights / total + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        return self.languages[int(logits.argmax())], float(p.max() / p.sum())


def thinned(row: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A few subwords drawn from a text's, as a short text would hold."""
    at = np.flatnonzero(row)
    if not len(at):
        return row
    p = row[at].astype(np.float64)
    n = int(rng.integers(20, 200))
    out = np.zeros_like(row)
    out[at] = rng.multinomial(n, p / p.sum()) / n
    return out


def train_model(counts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 20, batch: int = 32, rate: float = 0.5, seed: int = 3) -> LanguageModel:
    """Fit by stochastic gradient descent on sparse counts; a fifth calibrates.

    The temperature is the one of least log loss on that fifth; texts count as
    rejected under a bound which 99.9 % of its rightly named texts reach, 0.5 at most. Up to 1,000 such texts, as with
    SAMPLE rows at most, that is the least score of them.
    """
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)

    def dense(idx: np.ndarray) -> np.ndarray:
        """Shares of a few rows; all at once would take SAMPLE x BUCKETS numbers."""
        x = np.zeros((len(idx), BUCKETS), np.float32)
        for row, i in zip(x, idx, strict=True):
            row[counts[i][0]] = counts[i][1]
        x /= np.maximum(x.sum(1, keepdims=True), 1)
        return x

    y = np.array([languages.index(v) for v in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = order[: len(y) // 5] if len(y) >= 50 else order
    fit = order[len(y) // 5 :] if len(y) >= 50 else order
    embed = rng.normal(0, 0.5, (BUCKETS, EMBED)).astype(np.float32)
    out, bias = np.zeros((EMBED, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    share = (sum(dense(fit[at : at + batch]).sum(0) for at in range(0, len(fit), batch)) / np.float32(len(fit)) + 1e-5) ** 0.25
    scale = (1 / share)[:, None].astype(np.float32)  # rare subwords count as much as frequent ones
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(fit), batch):
            idx = fit[at : at + batch] if epoch == 0 else rng.choice(fit, min(batch, len(fit)), replace=False)
            xs = dense(idx)
            short = rng.random(len(idx)) < SHORT
            for i in np.flatnonzero(short):
                xs[i] = thinned(xs[i], rng)
            used = np.flatnonzero(xs.any(0))
            xs = xs[:, used] * scale[used].T
            mean = xs @ embed[used]
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(idx)), y[idx]] -= 1
            p /= len(idx)
            grad = mean.T @ p
            embed[used] -= step * (xs.T @ (p @ out.T))
            out -= step * grad
            bias -= step * p.sum(0)
    weights = ((embed * scale) @ out).astype(np.float64)
    logits = np.concatenate([dense(held[at : at + batch]) @ weights for at in range(0, len(held), batch)]) + bias

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(held)), y[held]]))

    best = min((2.0**k for k in np.arange(-3, 4, 0.25)), key=loss)
    z = logits / best
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right = np.sort(p.max(1)[p.argmax(1) == y[held]])
    return LanguageModel(languages, weights, bias.astype(np.float64), best, float(min(0.5, right[len(right) // 1000])) if len(right) else 0.0)


def fit_language_model(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Fit on at most ``sample`` rows with text and language, those with the least hash of their id.

    Rows that repeat an id count as one, the least by language and text; so no more than
    ``sample`` rows are collected. Rows without an id are left out. Executors turn whole texts into subword counts (BUCKETS numbers a row at
    most), and only those reach the driver. No labelled row: a model that names no language.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang")).where("_text is not null and _lang is not null and _id is not null")
    chosen = rows.select("_id", F.xxhash64("_id").alias("_h")).orderBy("_h", "_id").limit(sample)
    taken = rows.join(F.broadcast(chosen.select("_id").distinct()), "_id", "left_semi").groupBy("_id").agg(F.min(F.struct("_lang", "_text")).alias("_r")).select("_id", "_r._text", "_r._lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letter_table()
        for b in batches:
            found = [subword_counts(t.as_py(), letter) for t in b.column("_text")]
            at = [np.flatnonzero(c) for c in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("_lang"), pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([c[a].astype("<i8").tobytes() for a, c in zip(at, found, strict=True)], pa.binary())], names=["_id", "_lang", "at", "n"]
            )

    got = taken.mapInArrow(counted, f"_id {dict(docs.dtypes)[id_col]}, _lang string, at binary, n binary").collect()
    got = sorted(got, key=lambda r: (str(r["_id"]), r["_lang"]))
    return train_model([(np.frombuffer(r["at"], "<u2"), np.frombuffer(r["n"], "<i8")) for r in got], [r["_lang"] for r in got])


def language_of(model: LanguageModel):
    """Arrow function: text -> (language, score, rejected). Only the texts travel to Python, a batch at a time."""

    def named(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letter = letter_table()
        for texts in batches:
            languages, scores, rejected = [], [], []
            for item in texts:
                text = item.as_py()
                spelled = text is not None and any(map(str.isalpha, text))
                language, score = model.predict(subword_counts(text, letter)) if spelled else (UNKNOWN, 0.0)
                languages.append(language)
                scores.append(score)
                rejected.append(not spelled or (bool(model.languages) and (language == UNKNOWN or score < model.reject_below)))
            yield pa.StructArray.from_arrays([pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang_pred", "lang_score", "lang_rejected"])

    # Not deterministic, so that Catalyst never evaluates it once for a filter and again for a column.
    return F.arrow_udf(named, "struct<lang_pred:string,lang_score:double,lang_rejected:boolean>").asNondeterministic()


def identify_languages(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``lang_score`` (0 to 1), ``lang_rejected``.

    A null text or one without a letter is ``und`` with score 0 and rejected. Rejected too: a score under the
    model's calibrated bound. A model that knows no language names every text ``und`` and rejects none that has a letter.
    Rows keep their number; columns of ``docs`` that bear one of the three names are replaced. Empty table: no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    named = fresh(docs, "_named")
    out = docs.withColumn(named, language_of(model)(F.col(text_col).cast("string")))
    return out.select(*docs.columns, *[F.col(named)[c].alias(c) for c in ("lang_pred", "lang_score", "lang_rejected")])


def fold(modulus: int, rest: int, id_col: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves ``rest``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_language_model(docs.where(~fold(4, 2)))
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", fold(4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_rejected")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language identification rejects.

    Null texts and texts without a letter go. Without a labelled document the model knows no language and rejects nothing
    else. Repeated rows meet the same fate; all columns stay as they are, whatever their names; empty table: no rows.
    """
    small_batches(spark)
    return docs.where(~language_of(fit_language_model(docs))(F.col("text").cast("string"))["lang_rejected"])
