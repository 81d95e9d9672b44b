"""Minimax contiguous sharding; DataFrame functions only."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramma.llm.common import documents, row_keyed, staged, text_of

#: Bits of a group's hash that its first range has, and bits by which a range that may hold a cut is split.
FIRST_BITS, MORE_BITS = 16, 8
#: Ranges and groups held on the driver at most; a search that would need more ends with the ranges it has.
MOST_ATOMS = 1 << 20
#: Rows of a file that are numbered together.
CELL = 1 << 13


def feasible(ends: list[int], capacity: int, shards: int) -> bool:
    """Whether greedy filling needs at most ``shards`` runs of ``capacity``; ``ends``: prefix sums."""
    start = 0
    for _ in range(shards):
        if start >= len(ends):
            return True
        before = ends[start - 1] if start else 0
        nxt = bisect_right(ends, before + capacity)
        if nxt == start:
            return False
        start = nxt
    return start >= len(ends)


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search for the least capacity with which ``shards`` runs hold all sizes."""
    ends = list(accumulate(sizes))
    low, high = max(sizes, default=0), ends[-1] if ends else 0
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(ends, middle, shards) else (middle + 1, high)
    return low


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """First index of shards 1, 2, ...: contiguous runs whose largest is as small as can be.

    Under that capacity each run ends next to an equal share of what is left,
    as long as the rest still fits.
    """
    if not sizes:
        return [0] * (shards - 1)
    capacity, ends = smallest_capacity(sizes, shards), list(accumulate(sizes))
    need = [0] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        need[i] = 1 + need[bisect_right(ends, (ends[i - 1] if i else 0) + capacity)]
    cuts, start = [], 0
    for left in range(shards - 1, 0, -1):
        before = ends[start - 1] if start else 0
        last = bisect_right(ends, before + capacity)
        share = before + (ends[-1] - before) / (left + 1)
        cut = min(bisect_right(ends, share), last)
        if cut < last and (cut == 0 or ends[cut] - share < share - ends[cut - 1]):
            cut += 1
        while need[cut] > left and cut < last:
            cut += 1
        cuts.append(cut)
        start = cut
    return cuts


def _ends(ends: list[int], splits: list[bool], capacity: int, shards: int, inside: bool) -> list[int]:
    """Where greedy runs of ``capacity`` end, in bytes: at ends of atoms; with ``inside`` also anywhere in an atom that can be split."""
    at, out = 0, []
    for _ in range(shards):
        i = bisect_right(ends, at + capacity)
        at = max(at, ends[i - 1] if i else 0)
        if inside and i < len(ends) and splits[i]:
            at = max(at, out[-1] if out else 0, min((out[-1] if out else 0) + capacity, ends[i]))
        out.append(at)
    return out


def _least(ends: list[int], splits: list[bool], shards: int, inside: bool) -> int:
    """Least capacity whose greedy runs reach the end."""
    low, high = 0, ends[-1]
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if _ends(ends, splits, middle, shards, inside)[-1] >= ends[-1] else (middle + 1, high)
    return low


def open_atoms(sizes: list[int], splits: list[bool], shards: int) -> list[int]:
    """Atoms to split before the smallest capacity over the groups is known; none if it is.

    It lies between the least capacity if cuts could fall anywhere in an atom of several groups, and the least with
    cuts between atoms. The k-th cut of every capacity in between lies between those of the two.
    """
    if not sizes:
        return []
    ends = list(accumulate(sizes))
    low, high = _least(ends, splits, shards, True), _least(ends, splits, shards, False)
    if low == high:
        return []
    first, last = _ends(ends, splits, low, shards, False), _ends(ends, splits, high, shards, True)
    out: set[int] = set()
    for a, b in zip(first, last, strict=True):
        out |= set(range(bisect_right(ends, a), min(len(ends), bisect_right(ends, b) + 1)))
    return sorted(i for i in out if splits[i])


def group_cuts(groups: DataFrame, shards: int) -> list[int]:
    """First hash of shards 1, 2, ...: minimax runs over the groups (_h, _bytes) in the order of their hash.

    The groups are summed by ranges of the hash; only ranges in which a cut may fall are split,
    until the smallest feasible capacity over the groups is found, at ranges as narrow as it takes.
    """

    def summed(df: DataFrame, bits: int) -> list[tuple[int, int, int, bool]]:
        """(first hash, bits, bytes, several groups) of ranges."""
        got = df.groupBy(F.shiftright("_h", 64 - bits).alias("_p")).agg(F.sum("_bytes").alias("b"), F.count("*").alias("n")).collect()
        return [(r["_p"] << (64 - bits), bits, r["b"], r["n"] > 1 and bits < 64) for r in got]

    atoms = sorted(summed(groups, FIRST_BITS))
    while True:
        at = open_atoms([a[2] for a in atoms], [a[3] for a in atoms], shards)
        if not at or len(atoms) + (len(at) << MORE_BITS) > MOST_ATOMS:
            break
        split, by_bits = set(at), {}
        for i in at:
            by_bits.setdefault(atoms[i][1], []).append(atoms[i][0] >> (64 - atoms[i][1]))
        atoms = [a for i, a in enumerate(atoms) if i not in split]
        for bits, prefixes in by_bits.items():
            wanted = groups.sparkSession.createDataFrame([(p,) for p in prefixes], "_w long")
            atoms += summed(groups.join(F.broadcast(wanted), F.shiftright("_h", 64 - bits) == F.col("_w"), "left_semi"), min(64, bits + MORE_BITS))
        atoms.sort()
    cuts = minimax_cuts([a[2] for a in atoms], shards)
    return [atoms[c][0] if c < len(atoms) else 1 << 63 for c in cuts]


def giants(largest: list[tuple[int, int]], total: int, shards: int) -> list[int]:
    """Groups, of the (group, bytes) of the largest ones, that exceed an equal share of what the larger ones leave."""
    out: list[int] = []
    for group, size in sorted(largest, key=lambda g: (-g[1], g[0])):
        if shards - len(out) <= 1 or size * (shards - len(out)) <= total:
            break
        out.append(group)
        total -= size
    return out


def shard(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents into shards of near equal bytes; equal texts share a shard.

    The atoms are groups of equal texts. In their order, those above an equal share come first, by size, each a shard
    of its own (fewer than ``shards`` can be); the others follow by their hash. Over these the smallest feasible
    capacity is found by binary search with a greedy check, and the cuts are made.

    Returns id, ``size`` (UTF-8 bytes plus 8), ``text_crc32``, ``shard`` and
    ``slot``, gapless from 0 in each shard in the order of the files; reruns over the same files agree. A null
    text is empty. Rows that repeat an id are documents of their own. Empty table:
    no rows. Other columns are ignored.
    """
    text = text_of(text_col)
    keyed = row_keyed(docs.select(F.col(id_col).alias("_id"), F.col(text_col)))
    rows = staged(keyed.select("_row", "_id", (F.octet_length(text).cast("long") + 8).alias("_size"), F.crc32(text.cast("binary")).alias("_crc"), F.xxhash64(text).alias("_h")), "shard")
    groups = staged(rows.groupBy("_h").agg(F.sum("_size").alias("_bytes")), "groups")
    largest = [(r["_h"], r["_bytes"]) for r in groups.orderBy(F.desc("_bytes"), "_h").limit(shards).collect()]
    alone = giants(largest, groups.agg(F.sum("_bytes")).first()[0] or 0, shards)
    cuts = group_cuts(groups.where(~F.col("_h").isin(alone)) if alone else groups, shards - len(alone))
    at = F.lit(len(alone))
    for cut in cuts:
        at = at + (F.col("_h") >= cut).cast("int") if cut < 1 << 63 else at
    for own, group in enumerate(alone):
        at = F.when(F.col("_h") == group, own).otherwise(at)
    # Slots: place among a shard's rows of a stretch of a file, plus the shard's rows before it; no stretch is longer than CELL.
    cell = ["_shard", "_file", "_part"]
    rows = rows.select("_id", "_size", "_crc", at.alias("_shard"), F.col("_row.file").alias("_file"), F.col("_row.at").alias("_at"), F.floor(F.col("_row.at") / CELL).alias("_part"))
    counts = rows.groupBy(*cell).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_file", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*cell).orderBy("_at")))
    return ranked.join(starts, cell).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_shard").cast("int").alias("shard"), (F.col("_start") + F.col("_rank") - 1).cast("long").alias("slot")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
