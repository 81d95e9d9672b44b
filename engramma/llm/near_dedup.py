"""Near-duplicate detection: Order MinHash sketches, verified by banded alignment."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.llm.common import documents, dropped, fresh, join_spread, keep_rows, row_keyed, small_batches, staged, text_of
from engramma.llm.exact_dedup import bitmap_of, marked

SHINGLE = 5
SIMILARITY = 0.8
#: Sketches per document, each of the ORDER least occurrence-labelled shingles in text order.
#: At Jaccard similarity 0.8 one agrees with probability 0.64, none of twelve with 5e-6.
SKETCHES = 12
ORDER = 2
#: Texts that are compared with one another at once; larger buckets are split.
BLOCK = 256
#: Places that are looked at in one step of an alignment.
STEP = 1 << 18
#: The widest band that goes by diagonals; beyond it bits of whole rows are cheaper.
WIDEST = 4096
#: The band after which an alignment through anchors is tried.
NARROW = 32
#: Words whose codes a worker remembers.
REMEMBERED = 200_000
MULT = np.uint64(0x9E3779B97F4A7C15)


class WordCodes(dict):
    """Word -> 32-bit hash, remembered for the words seen last."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        code = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little")
        return code


def words_of(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def word_codes(words: list[str], codes: WordCodes) -> np.ndarray:
    return np.fromiter(map(codes.__getitem__, words), np.uint32, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def labelled_shingles(codes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of all k-word shingles in text order, each labelled with its occurrence.

    A text of fewer words has one shingle, all its words; one of none has none.
    """
    codes = codes.astype(np.uint64)
    if not len(codes):
        return codes
    k = min(k, len(codes))
    n = len(codes) - k + 1
    h = codes[:n].copy()
    for j in range(1, k):
        h = h * MULT + codes[j : j + n]
    h = mixed(h)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    nth = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    h[order] = ranked + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return h


def order_sketches(shingles: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """Per sketch a hash of the ORDER shingles that its hash function makes least, in text order."""
    n, out = len(shingles), []
    seeds = (np.arange(sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
    step = max(1, (1 << 19) // n)
    for at in range(0, sketches, step):
        some = seeds[at : at + step, None]
        if n > ORDER:
            v = mixed((shingles[None, :] ^ some) * MULT)
            least = np.sort(np.argpartition(v, ORDER - 1, axis=1)[:, :ORDER], axis=1)
        else:
            least = np.broadcast_to(np.arange(n), (len(some), n))
        value = some[:, 0]
        for j in range(least.shape[1]):
            value = mixed((value * np.uint64(0x100000001B3)) ^ shingles[least[:, j]])
        out.append(value)
    return np.concatenate(out).astype(np.int64)


def run_lengths(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words are equal from place ``i`` of ``a`` and ``j`` of ``b`` on, for many places at once.

    ``a`` and ``b`` end in WIDEST words each that are equal to none of the other's.
    """
    length, live, width = np.zeros(len(i), np.int64), np.arange(len(i)), 8
    while len(live):
        reach = np.arange(width)
        same = a[(i[live] + length[live])[:, None] + reach] == b[(j[live] + length[live])[:, None] + reach]
        whole = same.all(1)
        length[live] += np.where(whole, width, same.argmin(1))
        live = live[whole]
        width = max(8, min(4 * width, WIDEST, STEP // max(1, len(live))))
    return length


def distance_within(a: np.ndarray, b: np.ndarray, band: int) -> int | None:
    """Edit distance of two code sequences if it is at most ``band``.

    Only the diagonals within the band are looked at: per number of edits the
    furthest place on each diagonal, from where it runs on to the diagonal's next mismatch.
    """
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return None
    a = np.concatenate([a.astype(np.int64), np.full(WIDEST, -1)])
    b = np.concatenate([b.astype(np.int64), np.full(WIDEST, -2)])
    ks = np.arange(-band, band + 1)
    low, high = np.maximum(0, -ks), np.minimum(n, m - ks)
    place = np.full(2 * band + 3, -2 * (n + m + 2))
    place[band + 1] = 0
    for edits in range(band + 1):
        if edits:
            step = np.maximum(np.maximum(place[1:-1] + 1, place[2:] + 1), place[:-2])
            place[1:-1] = np.minimum(step, high)
        live = np.flatnonzero((high >= low) & (place[1:-1] >= low))
        place[1 + live] += run_lengths(a, b, place[1 + live], place[1 + live] + ks[live])
        if place[1 + band + m - n] >= n:
            return edits
    return None


def distance_by_bits(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """The same by whole rows of the table, whose steps are the bits of two long integers.

    Its time does not depend on the distance: for long texts that differ much.
    """
    if abs(len(a) - len(b)) > limit:
        return None
    n = len(a)
    if not n:
        return len(b)
    full, top = (1 << n) - 1, n - 1
    order = np.argsort(a, kind="stable")
    values, first, counts = np.unique(a[order], return_index=True, return_counts=True)
    where = {v: (f, c) for v, f, c in zip(values.tolist(), first.tolist(), counts.tolist(), strict=True)}
    held: dict[int, int] = {}

    def places(code: int) -> int:
        """The places of a word in ``a`` as bits; those of frequent words are kept."""
        if code in held:
            return held[code]
        f, c = where.get(code, (0, 0))
        if not c:
            return 0
        marks = np.zeros(n // 8 + 1, np.uint8)
        at = order[f : f + c]
        np.bitwise_or.at(marks, at >> 3, (1 << (at & 7)).astype(np.uint8))
        bits = int.from_bytes(marks.tobytes(), "little")
        if c * 64 > n:  # fewer than 64 words are so frequent
            held[code] = bits
        return bits

    up, down, distance = full, 0, n
    for left, code in zip(range(len(b) - 1, -1, -1), b.tolist(), strict=True):
        match = places(code) | down
        diagonal = ((((match & up) + up) ^ up) | match) & full
        rise, fall = (down | ~(diagonal | up)) & full, diagonal & up
        distance += (rise >> top & 1) - (fall >> top & 1)
        if distance - left > limit:
            return None
        rise = (rise << 1 | 1) & full
        up, down = ((fall << 1) | ~(diagonal | rise)) & full, diagonal & rise
    return distance if distance <= limit else None


def distance_by_anchors(a: np.ndarray, b: np.ndarray, k: int = SHINGLE) -> int:
    """Edits of one alignment, so no fewer than the edit distance: through the longest rising chain of k-word runs that occur once in both texts."""

    def runs(codes: np.ndarray) -> np.ndarray:
        h = codes[: max(0, len(codes) - k + 1)].astype(np.uint64)
        for j in range(1, k):
            h = h * MULT + codes[j : j + len(h)]
        return mixed(h)

    def once(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, at, n = np.unique(h, return_index=True, return_counts=True)
        return values[n == 1], at[n == 1]

    (left, i), (right, j) = once(runs(a)), once(runs(b))
    _, x, y = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    i, j = i[x], j[y]
    order = np.argsort(i)
    i, j = i[order], j[order]
    tails: list[int] = []
    last, before = [], np.full(len(j), -1, np.int64)
    for at, v in enumerate(j.tolist()):
        place = bisect_left(tails, v)
        tails[place : place + 1] = [v]
        last[place : place + 1] = [at]
        before[at] = last[place - 1] if place else -1
    chain, at = [], last[-1] if last else -1
    while at >= 0:
        chain.append(at)
        at = before[at]
    chain = np.array(chain[::-1], np.int64)
    # Two matches in a row share what lies within both. Of what is between them the longer side is edited, or on one diagonal what differs.
    i, j = np.r_[-k, i[chain], len(a)], np.r_[-k, j[chain], len(b)]
    di, dj = np.diff(i), np.diff(j)
    cost = np.maximum(di, dj) - np.minimum(np.minimum(di, dj), k)
    gaps = np.flatnonzero((di == dj) & (cost > 0))
    size = cost[gaps]
    owner = np.repeat(gaps, size)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    differ = a[i[owner] + k + step] != b[j[owner] + k + step]
    cost[gaps] = np.bincount(owner, weights=differ, minlength=len(cost))[gaps].astype(np.int64)
    return int(cost.sum())


def banded_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """1 - edit distance / longer length of two code sequences; 0 if that is under ``least``.

    The band is widened until the distance lies in it, up to the widest that
    ``least`` allows; beyond WIDEST the same distance is found by rows of bits. Where narrow bands fail and an
    alignment through anchors reaches ``least``, its value is returned, which is no more than the true one.
    """
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    limit, band = int((1 - least) * longer + 1e-9), 8
    while True:
        dist = distance_within(a, b, min(band, limit)) if band <= WIDEST else distance_by_bits(a, b, limit)
        if dist is None and band == NARROW and (found := distance_by_anchors(a, b)) <= limit:
            dist = found
        if dist is not None:
            return 1 - dist / longer
        if band >= limit or band > WIDEST:
            return 0.0
        band *= 4


def shared_counts(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of a block, by products of bounded matrices."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    _, ids, counts = np.unique(values, return_inverse=True, return_counts=True)
    kept = counts > 1
    rank = np.cumsum(kept) - 1
    use = kept[ids]
    owner, ids = owner[use], rank[ids[use]]
    order = np.argsort(ids, kind="stable")
    owner, ids = owner[order], ids[order]
    out = np.zeros((n, n), np.float32)
    for low in range(0, int(kept.sum()), columns):
        a, b = np.searchsorted(ids, [low, low + columns])
        part = np.zeros((n, columns), np.float32)
        part[owner[a:b], ids[a:b] - low] = 1
        out += part @ part.T
    return out


def linked(seqs: list[np.ndarray], similarity: float = SIMILARITY, shingle: int = SHINGLE, asks: np.ndarray | None = None) -> tuple[list[tuple[int, int]], list[int]]:
    """A spanning forest of a block's links, pairs of similar shingles whose words align, and the root of each text.

    Every pair is judged by its shared shingles (with ``asks``: every pair with one of the texts marked there);
    pairs that links found before connect already are not aligned, so there are fewer links than texts.
    """
    sets = [labelled_shingles(s, shingle) for s in seqs]
    sizes = np.array([len(s) for s in sets])
    both = shared_counts(sets)
    close = np.triu(both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-4, 1) & (both > 0)
    if asks is not None:
        close &= asks[:, None] | asks[None, :]
    parent = list(range(len(seqs)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in range(len(seqs)):
        for j in np.flatnonzero(close[i]).tolist():
            a, b = root(i), root(j)
            if a != b and banded_similarity(seqs[i], seqs[j], similarity) >= similarity:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return out, [root(i) for i in range(len(seqs))]


def signed_texts(docs: DataFrame, id_col: str, text_col: str, sketches: int, shingle: int, carry: dict[str, Column]) -> DataFrame:
    """_node (a number of its own for each row), _id, _class (a hash of the words; of the text if it has none), _sketch, _codes of each row."""

    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codes = WordCodes()
        for b in batches:
            classes, found, spelled = [], [], []
            for item in b:
                text = item.as_py()
                words = words_of(text)
                whole = "\n".join(words) if words else "\0" + text
                classes.append(hashlib.blake2b(whole.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                seq = word_codes(words, codes)
                spelled.append(seq.astype("<u4").tobytes())
                found.append(order_sketches(labelled_shingles(seq, shingle), sketches) if words else [])
            yield pa.StructArray.from_arrays([pa.array(classes, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(spelled, pa.binary())], names=["_class", "_sketch", "_codes"])

    made = F.arrow_udf(sign, "struct<_class:binary,_sketch:array<bigint>,_codes:binary>").asNondeterministic()
    plain = docs.select(F.col(id_col).alias("_id"), *[e.alias(f"_carry_{c}") for c, e in carry.items()], made(text_of(text_col)).alias("_s"))
    return staged(plain.select(F.monotonically_increasing_id().alias("_node"), "_id", *[f"_carry_{c}" for c in carry], "_s._class", "_s._sketch", "_s._codes"), "signed")


def components(links: DataFrame) -> DataFrame:
    """_id, _label (least id of its component) for all ids in the links (_a, _b).

    Alternating large and small stars: each pass ties every node's neighbours to
    the least of them, until every component is a star around its least id. A
    node with very many neighbours is spread like any hot key. Every pass is
    written to the shared folder, and deleted when the next one is.
    """

    def star(edges: DataFrame, small: bool) -> DataFrame:
        both = edges.select(F.col("_a").alias("_u"), F.col("_b").alias("_v")).unionByName(edges.select(F.col("_b").alias("_u"), F.col("_a").alias("_v")))
        side = both.where("_v < _u") if small else both
        least = side.groupBy("_u").agg(F.least(F.col("_u"), F.min("_v")).alias("_m"), F.count("*").alias("_deg"))
        rows = side if small else both.where("_v > _u")
        tied = join_spread(rows, least, "_u", "_deg", 2 * total, "_v")
        out = tied.select(F.col("_m").alias("_a"), F.col("_v").alias("_b"))
        if small:
            out = out.unionByName(least.select(F.col("_m").alias("_a"), F.col("_u").alias("_b")))
        return out.where("_a <> _b").select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct()

    edges = staged(links.where("_a <> _b").select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct(), "links")
    while True:
        ends = edges.select(F.col("_b").alias("_n"), F.lit(1).alias("_up")).unionByName(edges.select(F.col("_a").alias("_n"), F.lit(0).alias("_up")))
        nodes = ends.groupBy("_n").agg(F.sum("_up").alias("_up"), F.count("*").alias("_deg"))
        if not nodes.where("_up > 0 and _deg > 1").count():  # every node is a root, or tied to one root and to nothing else
            break
        total = edges.count()
        large = staged(star(edges, False), "large")
        dropped(edges)
        edges = staged(star(large, True), "small")
        dropped(large)
    stars = edges.select(F.col("_b").alias("_id"), F.col("_a").alias("_label"))
    return stars.unionByName(edges.select(F.col("_a").alias("_id"), F.col("_a").alias("_label")).distinct())


def near_links(reps: DataFrame, codes: DataFrame, total: int, similarity: float, block: int = BLOCK, shingle: int = SHINGLE) -> DataFrame:
    """Links (_a, _b) between the representatives (_node, _sketch) of different texts, whose words ``codes`` (``total`` rows) holds.

    A bucket is the set of texts that share a sketch. Each text goes once to the block of the
    least node of each of its buckets, its pivot, so a block holds whole buckets. First, a block falls into parts of about
    ``block`` texts, each with the pivot, and all pairs of a part are judged. What a part's links connect with the
    pivot needs no more comparison with the like of other parts; only the others, the loose texts, meet the parts that
    they have not met, ``block`` of them at a time. So no pair of a bucket that could add a link is left out, a bucket of
    copies of one text costs no more than its size, and no task grows with a bucket.
    """
    sketches = reps.select("_node", F.posexplode("_sketch").alias("_i", "_value"))
    sketches = sketches.select("_node", F.xxhash64("_i", "_value").alias("_bucket"))
    buckets = sketches.groupBy("_bucket").agg(F.min("_node").alias("_pivot"), F.count("*").alias("_size")).where("_size > 1")
    inside = join_spread(sketches, buckets, "_bucket", "_size", sketches.count(), "_node").where("_pivot is not null")
    members = staged(inside.select("_pivot", "_node").distinct(), "members")
    sizes = members.groupBy("_pivot").agg(F.count("*").alias("_size"))
    parts = F.ceil(F.col("_size") / block).cast("int")
    own = F.when(F.col("_node") == F.col("_pivot"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("_node"), parts).cast("int")))
    sized = join_spread(members, sizes, "_pivot", "_size", members.count(), "_node")
    dealt = staged(sized.select("_pivot", "_node", parts.alias("_parts"), F.explode(own).alias("_part")), "parts")

    def read(group: pd.DataFrame) -> tuple[pd.Series, list[np.ndarray]]:
        return group["_node"], [np.frombuffer(c, "<u4") for c in group["_codes"]]

    def first(group: pd.DataFrame) -> pd.DataFrame:
        """Links, and as (node, null) the loose texts of a split block."""
        group = group.sort_values("_node", ignore_index=True)
        nodes, seqs = read(group)
        pairs, roots = linked(seqs, similarity, shingle)
        a, b = [int(nodes[i]) for i, _ in pairs], [int(nodes[j]) for _, j in pairs]
        loose = []
        if group["_parts"][0] > 1:
            at = int(np.flatnonzero(nodes == group["_pivot"][0])[0])
            loose = [int(n) for n, r in zip(nodes, roots, strict=True) if r != roots[at]]
        out = pd.DataFrame({"_a": a + loose, "_b": pd.array(b + [None] * len(loose), "Int64")})
        return out.assign(_pivot=group["_pivot"][0], _part=group["_part"][0], _parts=group["_parts"][0])

    def second(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_node", "_asks"], ignore_index=True).drop_duplicates("_node", keep="last", ignore_index=True)
        nodes, seqs = read(group)
        pairs, _ = linked(seqs, similarity, shingle, group["_asks"].to_numpy(bool))
        return pd.DataFrame({"_a": [nodes[i] for i, _ in pairs], "_b": [nodes[j] for _, j in pairs]}, dtype="int64")

    def spelled(tasks: DataFrame) -> DataFrame:
        """``tasks`` with the words of their texts. A bitmap picks those texts out where they lie, so that the words of others are not dealt."""
        row = F.struct(F.shiftright("_node", 33).alias("file"), F.col("_node").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")).alias("_row")
        keys = tasks.select(row)
        pieces = bitmap_of(keys, total)
        wanted = codes if pieces is None else marked(codes.select(row, "_node", "_codes"), keys, pieces).where("_survives").select("_node", "_codes")
        return wanted.join(tasks.hint("shuffle_hash"), "_node")

    schema = "_a long, _b long, _pivot long, _part int, _parts int"
    one = staged(spelled(dealt).groupBy("_pivot", "_part").applyInPandas(first, schema), "first")
    links, loose = one.where("_b is not null").select("_a", "_b"), one.where("_b is null").select("_pivot", F.col("_a").alias("_node"), F.col("_part").alias("_own"), "_parts")
    per_block = loose.groupBy("_pivot").agg(F.count("*").alias("_loose"))
    if not per_block.limit(1).count():
        return links
    # Loose texts of a block by chunks; each chunk meets every part. A loose text is with its own part once more, where it finds nothing new.
    chunks = F.ceil(F.col("_loose") / block).cast("int")
    asking = join_spread(loose, per_block, "_pivot", "_loose", loose.count(), "_node").withColumn("_chunk", F.pmod(F.xxhash64("_node", F.lit(1)), chunks).cast("int"))
    asking = asking.select("_pivot", "_chunk", "_node", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(True).alias("_asks"))
    split = dealt.where("_parts > 1")
    asked = join_spread(split, per_block, "_pivot", "_loose", split.count(), "_node").where("_loose is not null")
    asked = asked.select("_pivot", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("_chunk"), "_node", "_part", F.lit(False).alias("_asks"))
    two = spelled(staged(asking.unionByName(asked), "asked")).groupBy("_pivot", "_part", "_chunk").applyInPandas(second, "_a long, _b long")
    return links.unionByName(two)


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, sketches: int = SKETCHES, block: int = BLOCK, shingle: int = SHINGLE, carry: dict[str, Column] | None = None) -> DataFrame:
    """Groups of near-duplicate documents: id, ``group_id``, ``group_size``, ``kept`` and the ``carry`` expressions.

    Two texts are linked if they share an Order MinHash sketch, the multisets of
    their five-word shingles (lower case, letters and digits) have a Jaccard similarity of 0.8 or more, and so
    has the banded alignment of their words. Groups are the connected components;
    texts of equal words are one class beforehand, so copies are never paired.
    Of each group one row stays, the one with the least id (null last), then the first row; ``group_id`` is its id.

    A null text is an empty one. Texts without a word are alike only if equal, character by
    character; shorter texts than a shingle if their words are equal. Rows that repeat an id, or
    have none, are documents of their own, grouped by their texts alone. Words are compared by 32-bit hashes.
    Empty table: no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    carry = carry or {}
    signed = signed_texts(docs, id_col, text_col, sketches, shingle, carry)
    total = signed.count()
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_node").alias("node")))
    classes = staged(signed.groupBy("_class").agg(first.alias("_first"), F.count("*").alias("_copies")).withColumn("_node", F.col("_first.node")), "classes")
    reps = staged(signed.select("_node", "_sketch").where("size(_sketch) > 0").join(classes.select("_node").hint("shuffle_hash"), "_node"), "reps")
    labels = components(near_links(reps, signed.select("_node", "_codes"), total, similarity, block, shingle))
    found = staged(classes.join(labels.withColumnRenamed("_id", "_node"), "_node", "left").withColumn("_label", F.coalesce("_label", "_node")), "labels")
    groups = found.groupBy("_label").agg(F.sum("_copies").alias("_all"), F.min("_first").alias("_best"), F.count("*").alias("_n"))
    found = join_spread(found, groups, "_label", "_n", found.count(), "_node")
    plain = signed.drop("_sketch", "_codes")
    out = join_spread(plain, found.select("_class", "_best", "_all", "_copies"), "_class", "_copies", total, "_node")
    return out.select(F.col("_id").alias(id_col), F.col("_best.id").alias("group_id"), F.col("_all").cast("long").alias("group_size"), (F.col("_node") == F.col("_best.node")).alias("kept"), *[F.col(f"_carry_{c}").alias(c) for c in carry])


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates, also where rows repeat an id or have none.

    Null and empty texts are one group; columns pass through, whatever their names; empty table: no rows.
    """
    key = fresh(docs, "_row")
    docs = row_keyed(docs, key)
    return keep_rows(docs, near_dedup(docs, carry={key: F.col(key)}).where("kept").select(key), key)
