"""Winnowing fingerprints of documents and of edited documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.llm.common import documents, small_batches, text_of

GRAM = 16
WINDOW = 32
#: Code points that are hashed at once; longer texts go piece by piece.
PIECE = 1 << 20
#: Bytes of text that a range of ids holds, about, and ranges at most.
RANGE_BYTES, MOST_RANGES = 1 << 28, 50_000
PLACE = np.uint64((1 << 24) - 1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _piece_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    base = 0x9E3779B97F4A7C15
    out, span, todo = None, points.astype(np.uint64) + np.uint64(1), gram
    width, done = 1, 0
    while todo:
        n = len(points) - gram + 1
        if todo & 1:
            part = span[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(base, width, 1 << 64)) + part
            done += width
        todo >>= 1
        if todo:
            span = span[:-width] * np.uint64(pow(base, width, 1 << 64)) + span[width:]
            width *= 2
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out >> np.uint64(24)


def gram_hashes(points: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """40-bit hashes of all runs of ``gram`` code points (one of the whole text if shorter).

    A polynomial rolling hash, doubled in width until it spans the gram; PIECE runs at a time.
    """
    if not len(points):
        return np.zeros(0, np.uint64)
    gram = min(gram, len(points))
    return np.concatenate([_piece_hashes(points[at : at + PIECE + gram - 1], gram) for at in range(0, len(points) - gram + 1, PIECE)])


def winnow(hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of each window's least hash, the rightmost of equal ones.

    Any run of ``window + gram - 1`` code points that two texts share puts one
    hash into both fingerprints. Fewer hashes than a window are one window.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), hashes
    window, chosen = min(window, n), []
    step = PIECE
    for start in range(0, n - window + 1, step):
        part = hashes[start : start + step + window - 1]
        key = (part << np.uint64(24)) | (PLACE - np.arange(len(part), dtype=np.uint64))
        width = 1
        while width * 2 <= window:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if window > width:
            key = np.minimum(key[: len(key) - (window - width)], key[window - width :])
        place = (PLACE - (key & PLACE)).astype(np.int64) + start
        chosen.append(place[np.r_[True, place[1:] != place[:-1]]])
    at = np.unique(np.concatenate(chosen))
    return at, hashes[at]


def spelled(at: np.ndarray, hashes: np.ndarray) -> str:
    """Twelve hex digits per entry: the hash (10), then the distance from the position before (2)."""
    if not len(at):
        return ""
    step = np.diff(at, prepend=0).astype(np.uint64)
    return ((hashes << np.uint64(8)) | step).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes, given unique and sorted; 1 if both are empty."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited_hashes(own: np.ndarray, nxt: np.ndarray, own_points: np.ndarray, next_points: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points and gram hashes of the edited text, from the hashes of its two halves."""
    half = len(own_points) // 2
    keep, take = len(own_points) - half, min(half, len(next_points))
    points = np.concatenate([own_points[:keep], next_points[:take]])
    if keep < gram or take < gram:
        return points, gram_hashes(points, gram)
    seam = gram_hashes(points[keep - gram + 1 : keep + gram - 1], gram)
    return points, np.concatenate([own[: keep - gram + 1], seam, nxt[: take - gram + 1]])


def _bucket_bounds(ids: DataFrame, parts: int) -> list[int]:
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    found = ids.agg(F.percentile_approx("_id", F.lit(at), F.lit(max(10_000, 20 * parts))).alias("b")).first()["b"]
    return sorted(set(found or []))


def fingerprint_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprint each document and its edited text, and compare with the next document.

    Next: by descending id, equal ids by text; after the last the first (a sole
    document is its own next one). The edited text has the last half of the code
    points, rounded down, replaced by the first as many, or all, of the next.

    Documents are dealt by ranges of ids, one range per task; the first document
    of each range is sent a second time, to the range before it. So each text is
    shuffled once. Bounds and first ids are one number per task.

    A null text is empty; texts under ``gram`` code points have one hash, empty
    ones an empty fingerprint. Rows without an id come last. Repeated rows are documents of their own. Empty
    table: no rows. Other columns are ignored.
    """
    if not 1 < window < 256:
        raise ValueError("window must be between 2 and 255")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_id"), F.col(id_col).isNull().alias("_null"), text_of(text_col).alias("_text"))
    size = docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, size // RANGE_BYTES))
    bounds = np.array(_bucket_bounds(rows.select("_id"), parts), np.int64)

    def heads_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, int] = {}
        for b in batches:
            ids = np.asarray(b.column(0))
            for bucket, i in zip(np.searchsorted(bounds, ids).tolist(), ids.tolist(), strict=True):
                most[bucket] = max(i, most.get(bucket, i))
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int32()), pa.array(list(most.values()), pa.int64())], names=["_bucket", "_id"])

    heads = {r["_bucket"]: r["_id"] for r in rows.select("_id").mapInArrow(heads_of, "_bucket int, _id long").groupBy("_bucket").agg(F.max("_id").alias("_id")).collect()}
    full = sorted(heads)
    #: Buckets by which a bucket's first document is awaited: the next one above, the lowest for the highest.
    awaited = {b: full[(k + 1) % len(full)] for k, b in enumerate(full)}
    is_head, goes_to = {heads[b] for b in full}, {heads[b]: awaited[b] for b in full}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column("_id"))
            buckets = np.searchsorted(bounds, ids)
            again = [i for i, x in enumerate(ids.tolist()) if x in is_head]
            for idx, where, ghost in ((np.arange(len(ids)), buckets, False), (again, [goes_to[int(ids[i])] for i in again], True)):
                if len(idx):
                    part = b.take(pa.array(idx, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.asarray(where), pa.int32()), pa.array([ghost] * len(idx))], names=["_id", "_null", "_text", "_bucket", "_ghost"])

    dealt = rows.mapInArrow(deal, "_id long, _null boolean, _text string, _bucket int, _ghost boolean")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("_bucket")).sortWithinPartitions("_ghost", F.desc("_id"), "_text")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "_null", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        before, out, size = None, [], 0

        def made(text: str) -> tuple:
            points = code_points(text)
            hashes = gram_hashes(points, gram)
            at, chosen = winnow(hashes, window)
            return points, hashes, spelled(at, chosen), np.unique(chosen)

        for b in batches:
            for i, null, text, ghost in zip(b.column("_id").to_pylist(), b.column("_null").to_pylist(), b.column("_text").to_pylist(), b.column("_ghost").to_pylist(), strict=True):
                if before is None and ghost:
                    continue
                here = (i, null, *made(text))
                if before is not None:
                    own_id, own_null, points, hashes, own, marks = before
                    e_points, e_hashes = edited_hashes(hashes, here[3], points, here[2], gram)
                    at, chosen = winnow(e_hashes, window)
                    e_text = e_points.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
                    sha = hashlib.sha256(e_text.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((own_id, own_null, len(points), sha, own, spelled(at, chosen), likeness(marks, np.unique(chosen)), likeness(marks, here[5])))
                    size += len(points)
                before = here if not ghost else None
                if size > PIECE * 4:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, size = [], 0
                if ghost:
                    break
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    schema = "_id long, _null boolean, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    found = dealt.mapInArrow(prints, schema)
    return found.select(F.when(~F.col("_null"), F.col("_id")).alias(id_col), *found.columns[2:])


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(documents(spark, sf_dir))
