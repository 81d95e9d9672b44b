"""Packing of tokenised documents into sequences by multiway differencing."""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.llm.common import documents, small_batches, text_of

CAPACITY = 1024
#: The rest of a document beyond its full windows is cut into pieces of so many tokens at most.
PIECE = 256
END = 0
#: Pieces that are partitioned together, at most.
BATCH = 1024
SPECIAL = "<|endoftext|>"
#: Code points that are encoded at once, where the text can be cut.
STEP = 1 << 16
SAFE = re.compile(r"\S(?= )")
#: Equal rows that one task deals to a batch before it deals them by their place too.
EQUAL = 64


def safe_cuts(text: str, step: int = STEP) -> Iterator[str]:
    """Parts of a text, about ``step`` long, whose ids joined are the ids of the whole.

    The vocabulary's pattern never lets a piece of other characters run on into a blank, and looks
    nowhere back; so a text may be cut between a character that is no white space and a blank.
    """
    at = 0
    while len(text) - at > step:
        found = SAFE.search(text, at + step)
        if not found:
            break
        yield text[at : found.start() + 1]
        at = found.start() + 1
    yield text[at:]


def encoder(folder: str | None = None):
    """text -> ids as ``tokenizers`` gives them for byte_bpe_50k.json.

    The same vocabulary as ranks is five times as fast in ``tiktoken``; what that refuses (very long runs of white
    space) or would read otherwise (the special token's string) goes to ``tokenizers`` itself. Long texts go part by part.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = (lambda name: f"{folder}/{name}") if folder else public_tokenizers.path
    with open(path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole: list = []

    def exact(text: str) -> np.ndarray:
        if not whole:
            whole.append(Tokenizer.from_file(str(path("byte_bpe_50k.json"))))
        return np.array(whole[0].encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(text: str) -> np.ndarray:
        out = []
        for part in safe_cuts(text):
            try:
                out.append(exact(part) if len(part) > 2 * STEP or SPECIAL in part else fast.encode_to_numpy(part, disallowed_special=()))
            except ValueError:
                out.append(exact(part))
        return out[0] if len(out) == 1 else np.concatenate(out)

    return encode


def differencing(sizes: list[int], ways: int) -> list[int]:
    """Karmarkar-Karp: the window, 0 to ``ways`` - 1, of each piece.

    Partial partitions are kept by the gap between their largest and smallest
    window. The two widest are merged, the largest windows of one with the
    smallest of the other, until one partition is left.
    """
    if ways == 1:
        return [0] * len(sizes)
    left: list[int] = []
    right: list[int] = []
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i, s in enumerate(sizes):
        sums, nodes = np.zeros(ways, np.int64), np.full(ways, -1, np.int64)
        sums[0], nodes[0] = s, i
        heap.append((-s, i, sums, nodes))
    heapq.heapify(heap)
    n, tick = len(sizes), len(sizes)
    while len(heap) > 1:
        _, _, a_sums, a_nodes = heapq.heappop(heap)
        _, _, b_sums, b_nodes = heapq.heappop(heap)
        b_sums, b_nodes = b_sums[::-1], b_nodes[::-1]
        sums, nodes = a_sums + b_sums, np.maximum(a_nodes, b_nodes)
        met = np.flatnonzero((a_nodes >= 0) & (b_nodes >= 0))
        nodes[met] = np.arange(n + len(left), n + len(left) + len(met))
        left += a_nodes[met].tolist()
        right += b_nodes[met].tolist()
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        tick += 1
        heapq.heappush(heap, (int(sums[-1] - sums[0]), tick, sums, nodes))
    out = [0] * n
    for window, node in enumerate(heap[0][3].tolist() if heap else []):
        todo = [node] if node >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                out[x] = window
            else:
                todo += (left[x - n], right[x - n])
    return out


def pack_pieces(lengths: list[int], capacity: int) -> tuple[list[int], int]:
    """Windows of pieces: as few as hold all tokens, one more whenever one exceeds its capacity."""
    ways = max(1, -(-sum(lengths) // capacity))
    while True:
        at = differencing(lengths, ways)
        if not lengths or np.bincount(at, weights=lengths, minlength=ways).max() <= capacity:
            return at, ways
        ways += 1


def cut(length: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of full windows, then near equal pieces of the rest."""
    full, rest = divmod(length, capacity)
    out = [(i * capacity, capacity) for i in range(full)]
    at, n = full * capacity, -(-rest // piece)
    for k in range(n):
        size = rest // n + (k < rest % n)
        out.append((at, size))
        at += size
    return out


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer_dir: str | None = None) -> DataFrame:
    """Pack all documents, each followed by id 0, into sequences of ``capacity`` tokens.

    Full windows of a document are sequences of their own. The rests, cut into
    pieces of a quarter window, are dealt by a hash of the id into batches of
    bounded size, and each batch is partitioned into near equal windows by
    Karmarkar-Karp differencing. Texts stay where they are read; only (id, start,
    length, checksum) per piece is shuffled. Texts that share an id, or have none, are told apart by their
    ids' checksum, and very many equal rows by their place.

    One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. A null text is empty: its one token is the final id 0. Repeated rows
    are packed each. ``sequence_id`` follows from the batch, so reruns agree.
    Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    piece = max(1, capacity // 4)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(tokenizer_dir), TaskContext.get().partitionId(), Counter()
        for b in batches:
            at, start, length, crc, whole, salt = [], [], [], [], [], []
            for i, (key, text) in enumerate(zip(b.column("_id"), b.column("_text"), strict=True)):
                ids = np.append(encode(text.as_py()), np.uint32(END)).astype("<u4", copy=False)
                mark = zlib.crc32(ids)
                seen[key.as_py(), mark] += 1
                again = seen[key.as_py(), mark] // EQUAL
                mark = (mark << 31) + (zlib.crc32(b"%d %d" % (part, again)) >> 1 if again else 0)
                for s, n in cut(len(ids), capacity, piece):
                    at.append(i)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n]))
                    whole.append(len(ids))
                    salt.append(mark)
            yield pa.RecordBatch.from_arrays([b.column("_id").take(pa.array(at, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, whole, salt)]], names=["_id", "start", "length", "ids_crc32", "doc_tokens", "_mark"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    batches = max(1, -(-docs.count() // (BATCH // 4)))
    pieces = rows.mapInArrow(tokenise, f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, _mark long")
    # The mark tells texts apart that share an id, and rows that are equal in both beyond the first few of a task.
    pieces = pieces.withColumn("_batch", F.pmod(F.xxhash64("_id", "_mark", F.when(F.col("length") < capacity, 0).otherwise(F.col("start"))), F.lit(batches))).drop("_mark")

    def place(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_id", "start", "ids_crc32", "doc_tokens"], ignore_index=True)
        sequence = np.zeros(len(group), np.int64)
        full = group["length"].to_numpy() == capacity
        sequence[full] = np.arange(full.sum())
        used, rest = int(full.sum()), np.flatnonzero(~full)
        for at in range(0, len(rest), BATCH):
            idx = rest[at : at + BATCH]
            windows, n = pack_pieces(group["length"].to_numpy()[idx].tolist(), capacity)
            sequence[idx] = used + np.array(windows, np.int64)
            used += n
        group["sequence_id"] = (np.int64(key[0]) << np.int64(32)) + sequence
        group["offset"] = group.groupby("sequence_id")["length"].cumsum() - group["length"]
        return group.drop(columns="_batch")

    out = pieces.groupBy("_batch").applyInPandas(place, f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("_id", id_col)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, packed; see ``pack``.

    A null text is the final id alone; rows that repeat an id are packed each, so their pieces share it; other columns
    are ignored, whatever their names; empty table: no rows.
    """
    return pack(docs)
