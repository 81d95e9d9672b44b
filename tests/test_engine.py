"""Golden values, properties and corruption tests of the memory engine."""

import io
import itertools
import json
import os
import random
import re
from concurrent.futures import ThreadPoolExecutor

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engramma import cli, errors
from engramma.functions import codec, ids, scores
from engramma.functions.symbols import normalise
from engramma.operators import cues, episodes, feedback, recall
from engramma.plans import registry as plans
from engramma.sources.stage import numbered, staged
from engramma.sources.store import SCHEMAS, MemoryStore
from engramma.streaming import feedback as streaming
from engramma.streaming.feedback import stream_traces


def fold(bits):
    h, n = 0, 0
    for b in bits:
        h, n = (h << 1 | b) & 65535, min(n + 1, 16)
    return h, n


def hits(spark, contents, source, limit=10, edges=()):
    kv = spark.createDataFrame([(s, k, v) for s, attrs in enumerate(contents) for k, vs in attrs for v in vs], "seq long, key long, value long").distinct()
    index = cues.episode_cues(kv)
    traces = spark.createDataFrame([(source, t, h, n) for t, h, n in edges], "from_seq long, to_seq long, history_bits long, sample_count long")
    return [(r["tgt"], r["ppm"]) for r in recall.recall_one(index, cues.cue_counts(index), traces, source, limit).collect()]


def test_cold_structural(spark):
    rows = [[(10, [100])], [(10, [100])], [(10, [100]), (30, [300])], [(10, [200])], [(20, [100])], [(20, [200])]]
    assert hits(spark, rows, 0) == [(1, 400000), (2, 200000), (3, 80000), (4, 80000)]


def test_pairs_keys_and_values_differ(spark):
    rows = [[(10, [100, 200])], [(10, [200, 100])], [(10, [100, 999])], [(20, [100, 200])], [(100, [10])]]
    assert hits(spark, rows, 0) == [(1, 400000), (2, 171428), (3, 100000)]


def test_learned_and_structural_merge(spark):
    rows = [[(10, [100])], [(10, [100])], [(10, [200])], [(20, [300])]]
    assert hits(spark, rows, 0, edges=[(2, 1, 1), (3, 1, 1)]) == [(1, 400000), (2, 151875), (3, 71875)]
    assert hits(spark, rows, 0, edges=[(3, 1, 2), (2, 0, 4)]) == [(1, 400000)]


def test_learned_curve(spark):
    cases = {(1, 1): 71875, (3, 2): 127777, (7, 3): 172500, (15, 4): 209090, (255, 8): 306666, (65535, 16): 400000, (65534, 16): 350000, (65280, 16): 0, (65024, 16): -50000, (0, 16): -400000}
    got = spark.createDataFrame([(h, n) for h, n in cases], "history_bits long, sample_count long").select("history_bits", "sample_count", scores.learned_score("history_bits", "sample_count").alias("v")).collect()
    assert {(r[0], r[1]): r["v"] for r in got} == cases


def test_trace_rules(spark):
    cases = {(0, 0): False, (0, 17): False, (2, 1): False, (65535, 15): False, (0, 1): True, (65535, 16): True, (1, 1): True}
    got = spark.createDataFrame(list(cases), "b long, n long").select("b", "n", scores.trace_is_valid(F.col("b"), F.col("n")).alias("v")).collect()
    assert {(r["b"], r["n"]): r["v"] for r in got} == cases
    new, n = scores.pushed(F.col("b"), F.col("n"), F.lit(True))
    got = spark.createDataFrame([(0xAAAA, 16), (0x8000, 16), (None, None)], "b long, n long").select(new.alias("h"), n.alias("n")).collect()
    assert [tuple(r) for r in got] == [(0x5555, 16), (1, 16), (1, 1)]


def test_folds_equal_sequential_folds(spark):
    rng, log = random.Random(7), []
    for e in range(3000):
        kind = rng.random()
        log.append((e, rng.randrange(6), rng.randrange(6), None if kind < 0.02 else rng.randrange(2), 5 if kind < 0.02 else None, 3 if kind < 0.02 else None))
    want, plain = {}, {}
    for _, a, b, x, h, n in log:
        if x is None:
            want[a, b] = (h, n)
        else:
            h, n = want.get((a, b), (0, 0))
            want[a, b] = ((h << 1 | x) & 65535, min(n + 1, 16))
            plain.setdefault((a, b), []).append(x)
    frame = spark.createDataFrame(log, "event_id long, from_seq long, to_seq long, x int, set_bits long, set_count long")
    assert {(r[0], r[1]): (r[2], r[3]) for r in feedback.fold_with_resets(frame).collect()} == want
    assert {(r[0], r[1]): (r[2], r[3]) for r in feedback.fold(frame.where("x is not null")).collect()} == {k: fold(v) for k, v in plain.items()}


def test_event_targets(spark):
    events = spark.createDataFrame([(1, 0, [2, 0, 1, 2, 1], True), (2, 0, list(range(6)), False)], "event_id long, source long, targets array<long>, helpful boolean")
    good, bad = feedback.event_targets(events, 5)
    assert sorted(tuple(r)[1:] for r in good.collect()) == [(0, 1, 1), (0, 2, 1)] and [tuple(r) for r in bad.collect()] == [(2, 6)]


def test_normalisation():
    same = [("  KELVIN\t\nNAME  ", "kelvin name"), ("Kelvin", "kelvin"), ("ＣＡＦÉ", "café"), ("İ", "i̇"), ("left\u0085right", "left right"), ("Straße", "straße"), ("ΟΔΟΣ", "οδοσ"), ("é" * 2048, "é" * 2048)]
    assert [normalise(a) for a, _ in same] == [(b, None) for _, b in same]
    for bad, part in ((" \t", "empty"), ("a\0b", "control"), ("x\x1cy", "control"), ("x" * 4097, "exceeds"), ("é" * 2048 + "x", "exceeds")):
        assert normalise(bad)[0] is None and part in normalise(bad)[1]


@given(st.text(max_size=30))
@settings(max_examples=300, deadline=None)
def test_normalisation_is_idempotent(text):
    once, _ = normalise(text)
    assert once is None or normalise(once) == (once, None)


ATTRS = st.lists(st.tuples(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=4)), min_size=1, max_size=4)


@given(st.integers(-(2**63), 2**63 - 1), ATTRS)
@settings(max_examples=200, deadline=None)
def test_codec_round_trip_and_prefixes(timestamp, attributes):
    canonical = episodes.canonical_attributes(attributes)
    blob = codec.encode(timestamp, canonical)
    assert codec.decode(blob) == (timestamp, canonical)
    for bad in [blob[:i] for i in range(len(blob))] + [blob + b"\0"]:
        with pytest.raises(errors.EpisodeDecodeError):
            codec.decode(bad)


def test_codec_golden():
    assert codec.encode(-1, [(1, [2])]).hex() == "ff" * 8 + "01" + "0000000000000001" + "01" + "0000000000000002"
    assert codec.uleb128(127) == b"\x7f" and codec.uleb128(128) == b"\x80\x01"
    head = bytes(8)
    for blob, detail in ((head + b"\0", codec.EMPTY_ATTRIBUTES), (head + b"\x81\0", codec.NON_CANONICAL_COUNT), (head + b"\xff" * 9 + b"\2", codec.OVERFLOWING_COUNT), (head + b"\x09" + bytes(20), codec.ATTRIBUTE_COUNT_EXCEEDS_REST)):
        with pytest.raises(errors.EpisodeDecodeError, match=detail):
            codec.decode(blob)


def test_ids(spark):
    raw = ids.memory_id(0x0123456789ABCDEFFEDCBA9876543210)
    assert ids.atom_display(raw, 7) == "0123456789abcdeffedcba9876543210:7"
    with pytest.raises(errors.ZeroMemoryId):
        ids.memory_id(0)
    r = spark.sql("select cast('18446744073709551615' as decimal(20,0)) x, cast(0 as decimal(20,0)) y").select(ids.biased(F.col("x")).alias("x"), ids.biased(F.col("y")).alias("y")).first()
    assert (r["x"], r["y"]) == (2**63 - 1, -(2**63))


def test_numbering_is_dense(spark):
    got = numbered(spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")), "n", "v", start=5).collect()
    assert sorted((r["v"], r["n"]) for r in got) == [(i, i + 5) for i in range(1000)]


@pytest.fixture
def store(spark, tmp_path):
    return MemoryStore.create(spark, f"{tmp_path}/store")


def test_store_life(spark, store):
    assert store.insert_texts([(5, [("repository", ["r"]), ("Build  Status", ["failed"])]), (6, [("repository", ["R"]), ("incident status", ["open"])])]) == [0, 1]
    assert store.recall_from(0) == [(1, 133333)]
    store.apply_feedback(0, [1, 1, 0], True)
    assert store.recall_from(0) == [(1, 205208)] and store.feedback_trace(0, 1) == (1, 1)
    stale = MemoryStore.open(spark, store.path)
    assert store.save() == 1
    stale.intern_symbols(["other"])
    with pytest.raises(errors.ConcurrentModification):
        stale.save()
    again = MemoryStore.open(spark, store.path)
    assert again.recall_from(0) == [(1, 205208)] and again.symbol_values([2, 0, 99]) == ["build status", "repository", None]
    assert again.intern_symbols(["REPOSITORY", "new"]) == [0, 6] or again.intern_symbols(["repository"]) == [0]
    assert again.save() == 2
    with pytest.raises(errors.UnknownAtom):
        again.recall_from(9, 0)
    with pytest.raises(errors.SelfEdge):
        again.set_feedback_trace(1, 1, 1, 1)
    with pytest.raises(errors.FeedbackTargetLimitExceeded):
        again.apply_feedback(0, [1] * 10_001, True)
    with pytest.raises(errors.InvalidSymbolValue, match="index 1"):
        again.intern_symbols(["fine", " "])
    assert again.recall_from(0, 0) == []


def tamper(spark, store, manifest=None, **tables):
    """Write tables beside a saved store's own and put them, and other changes, into its newest manifest."""
    name = f"{store.path}/_manifest.{store.revision:010d}.json"
    found = json.load(open(name))
    for table, (rows, schema) in tables.items():
        tag = f"v{99:010d}-{'a' * 12}"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{store.path}/{tag}/{table}")
        found[table] = [f"{tag}/{table}"]
        if table != "feedback":
            found[table[:-1] + "_count"] = len(rows)
    found |= manifest or {}
    os.remove(name)
    json.dump({k: v for k, v in found.items() if v is not ...}, open(name, "w"))


EDGES, SYMBOLS, EPISODES = (SCHEMAS[t] for t in ("feedback", "symbols", "episodes"))
BROKEN = [
    ({"feedback": ([(0, 0, 1, 1, 1)], EDGES)}, errors.InvalidFeedback, "self edge"),
    ({"feedback": ([(0, 7, 1, 1, 1)], EDGES)}, errors.InvalidFeedback, "0->7: unknown endpoint"),
    ({"feedback": ([(0, 1, 2, 1, 1)], EDGES)}, errors.InvalidFeedback, "trace is not canonical"),
    ({"feedback": ([(0, 1, 1, 1)], "from_seq long, to_seq long, history_bits long, sample_count long")}, errors.InvalidEncoding, "feedback.revision"),
    ({"feedback": ([("0", 1, 1, 1, 1)], EDGES.replace("from_seq long", "from_seq string"))}, errors.InvalidEncoding, "feedback.from_seq"),
    ({"symbols": ([(0, "a"), (2, "b")], SYMBOLS)}, errors.NonContiguousSymbolId, "expected symbol identifier 1, found 2"),
    ({"symbols": ([(0, "A"), (1, "b")], SYMBOLS)}, errors.InvalidSymbol, "symbol 0: symbol value is not canonical"),
    ({"symbols": ([(0, "a"), (1, "a")], SYMBOLS)}, errors.InvalidSymbol, "repeated"),
    ({"symbols": ([(0, "a", 1), (1, "b", 1)], SYMBOLS + ", more int")}, errors.InvalidMetadata, "schema differs"),
    ({"symbols": ([(0, "a")], SYMBOLS)}, errors.InvalidEpisode, "episode 0: unknown symbol 1"),
    ({"episodes": ([(0, 5, [(0, [1])]), (2, 5, [(0, [1])])], EPISODES)}, errors.NonContiguousEpisodeSequence, "expected episode sequence 1, found 2"),
    ({"episodes": ([(0, 5, [(0, [1, 0])])], EPISODES)}, errors.InvalidEpisode, "not canonical"),
    ({"episodes": ([(0, 5, [])], EPISODES)}, errors.InvalidEpisode, "not canonical"),
    ({"manifest": {"memory_id": "0" * 32}}, errors.InvalidMemoryId, "invalid persisted memory ID"),
    ({"manifest": {"revision": -1}}, errors.InvalidMetadata, "negative"),
    ({"manifest": {"revision": 5}}, errors.InvalidMetadata, "manifest's name"),
    ({"manifest": {"symbol_count": ...}}, errors.InvalidEncoding, "manifest.symbol_count"),
    ({"manifest": {"format_version": 5}}, errors.UnsupportedFormatVersion, "5"),
    ({"manifest": {"format_version": ...}}, errors.MissingMetadata, "row is missing"),
    ({"manifest": {"episode_count": 9}}, errors.InvalidMetadata, "row counts"),
    ({"manifest": {"more": 1}}, errors.InvalidMetadata, "schema differs"),
    ({"manifest": {"symbols": ["v0000000077-aaaaaaaaaaaa/symbols"]}}, errors.Unreadable, "v0000000077"),
]


@pytest.mark.parametrize("broken", range(len(BROKEN)))
def test_store_rejects_corruption(spark, store, broken):
    change, kind, message = BROKEN[broken]
    store.insert_texts([(5, [("a", ["b"])]), (5, [("a", ["b"])])])
    store.save()
    tamper(spark, store, **change)
    with pytest.raises(kind, match=message):
        MemoryStore.open(spark, store.path)

def test_store_schema_is_closed(spark, store):
    spark.range(1).write.parquet(f"{store.path}/strange")
    with pytest.raises(errors.InvalidMetadata, match="schema differs"):
        MemoryStore.open(spark, store.path)


def test_one_of_eight_creators_wins(spark, tmp_path):
    def create(_):
        try:
            return MemoryStore.create(spark, f"{tmp_path}/shared").memory_id
        except errors.EngrammaError:
            return None

    with ThreadPoolExecutor(8) as pool:
        made = [m for m in pool.map(create, range(8)) if m]
    assert len(made) == 1 and MemoryStore.open(spark, f"{tmp_path}/shared").memory_id == made[0]


def test_a_half_written_manifest_is_never_seen(spark, store):
    open(f"{store.path}/_aside-{'0' * 32}", "w").write("{")
    assert MemoryStore.open(spark, store.path).revision == 0


def test_saves_write_only_changed_edges(spark, store):
    store.insert_texts([(i, [("key", [f"value {i}"])]) for i in range(1000)])
    for i in range(999):
        store.apply_feedback(i, [i + 1], i % 2 == 0)
    assert store.save() == 1
    again = MemoryStore.open(spark, store.path)
    assert again.feedback_edges().count() == 999 and [r["seq"] for r in again.scan(reverse=True).limit(3).collect()] == [999, 998, 997]
    again.apply_feedback(3, [4, 5], True)
    again.set_feedback_trace(0, 1, 1, 1)  # as it is: nothing to write
    assert again.set_feedback_trace(6, 7, 5, 3) == (1, 1) and again.feedback_trace(6, 7) == (5, 3)
    assert sorted(tuple(r) for r in again.changed_edges().collect()) == [(3, 4, 1, 2), (3, 5, 1, 1), (6, 7, 5, 3)]
    assert again.save() == 2
    last = spark.read.parquet(f"{store.path}/{again._manifest['feedback'][-1]}")
    assert last.count() == 3 and MemoryStore.open(spark, store.path).feedback_edges().count() == 1000
    assert again.save() == 3 and len(again._manifest["feedback"]) == 2


def test_failed_saves_keep_local_state(spark, store):
    store.insert_texts([(5, [("a", ["b"])])])
    store.save()
    other = MemoryStore.open(spark, store.path)
    other.save()
    store.insert_texts([(6, [("a", ["c"])])])
    with pytest.raises(errors.ConcurrentModification) as e:
        store.save()
    assert (e.value.expected_revision, e.value.actual_revision) == (1, 2) and store.episode_count == 2 and store.symbol_values([2]) == ["c"]


def test_exhaustion(spark, store, monkeypatch):
    monkeypatch.setattr(store, "_manifest", store._manifest | {"symbol_count": (1 << 63) - 1})
    store.spark = spark
    monkeypatch.setattr(store, "_table", lambda name, checked=False: spark.createDataFrame([], SCHEMAS[name]))
    assert store.intern_symbols(["one"]) == [(1 << 63) - 1]
    with pytest.raises(errors.SymbolIdExhausted):
        store.intern_symbols(["two"])
    monkeypatch.setattr(store, "_manifest", store._manifest | {"episode_count": 1 << 63})
    with pytest.raises(errors.IdExhausted):
        store.insert_episode(0, [(0, [0])])


def test_warm_index_takes_new_episodes(spark, store):
    store.insert_texts([(5, [("a", ["b"])]), (5, [("a", ["c"])])])
    assert store.recall_from(0) == [(1, 80000)]
    known = store._index[0]
    store.insert_texts([(5, [("a", ["b"])])])
    assert store.recall_from(0) == [(2, 400000), (1, 80000)] and store._index[0] is not known
    store.save()
    assert store.recall_from(2) == [(0, 400000), (1, 80000)]


def test_eleven_hits_and_wide_episodes(spark):
    rows = [[(i, [100 + i])] for i in range(12)]
    samples = [16, 15, 14, 13, 12, 11, 10, 9, 8, 8, 7]
    edges = [(i + 1, (1 << n) - 1, n) for i, n in enumerate(samples)]
    want = [400000, 392045, 383333, 373750, 363157, 351388, 338235, 323437, 306666, 306666, 287500]
    assert hits(spark, rows, 0, 11, edges) == [(i + 1, v) for i, v in enumerate(want)] and len(hits(spark, rows, 0, edges=edges)) == 10
    assert hits(spark, [[(1, [2])], [(1, list(range(2, 904)))]], 0) == [(1, 664)]


def test_recall_of_all_equals_recall_of_each(spark):
    rng = random.Random(11)
    for case in (0, 3):
        contents = [sorted({(k, v) for k in rng.sample(range(4), rng.randrange(1, 4)) for v in rng.sample(range(100, 100 + 3 + 4 * case), rng.randrange(1, 3))}) for _ in range(60)]
        kv = spark.createDataFrame([(s, k, v) for s, c in enumerate(contents) for k, v in c] + [(60, 77, 78), (61, 0, 100)], "seq long, key long, value long")
        edges = spark.createDataFrame(list({(a, b): (a, b, rng.randrange(1 << 4), 4) for a, b in ((rng.randrange(62), rng.randrange(62)) for _ in range(150)) if a != b}.values()), "from_seq long, to_seq long, history_bits long, sample_count long")
        index = cues.episode_cues(kv).cache()
        for limit in (2, 50):
            want = recall.recall(index, cues.cue_counts(index), edges, kv.select(F.col("seq").alias("src")), limit)
            assert sorted(map(tuple, recall.recall_all(index, edges, limit).collect())) == sorted(map(tuple, want.collect()))


def test_command_line(spark, tmp_path):
    path = f"{tmp_path}/cli"

    def run(*args, stdin=""):
        out, err = io.StringIO(), io.StringIO()
        return cli.main(list(args), lambda: spark, io.StringIO(stdin), out, err), out.getvalue(), err.getvalue()

    assert run("init", path) == (0, "", "")
    assert run("init", path)[0] == 1
    many = "# note\n\n--timestamp 1 --attribute category --value seven --value eight\r\n--timestamp 2 --attribute category --value 'seven' --value \"nine\"\n"
    assert run("add", path, "--many", stdin=many)[1] == "0\n1\n"
    assert run("recall", path, "--from", "0")[1] == "sequence 1\nactivation_ppm 171428\ntimestamp 2\nattribute category\nvalue seven\nvalue nine\n"
    assert run("feedback", path, "--from", "0", "--unhelpful", "1") == (0, "", "")
    assert "activation_ppm 99553" in run("recall", path, "--from", "0", "--limit", "1")[1]
    for args, code in ((["add", path, "--value", "x"], 2), (["recall", path, "--limit", "1"], 2), (["feedback", path, "--from", "0", "--helpful", "1_0"], 2), ([], 2), (["nope"], 2), (["recall", path, "--from", "77"], 1)):
        assert run(*args)[0] == code
    assert run("add", path, "--many", stdin="--attribute a\n")[0] == 1 and run("add", path, "--many", stdin="'open\n")[0] == 1


def test_add_many_is_all_or_nothing(spark, tmp_path):
    path = f"{tmp_path}/cli"
    cli.main(["init", path], lambda: spark, io.StringIO(), io.StringIO(), io.StringIO())
    err = io.StringIO()
    many = "--attribute a --value b\n\n--attribute a --value ' '\n"
    assert cli.main(["add", path, "--many"], lambda: spark, io.StringIO(many), io.StringIO(), err) == 1 and "index 3" in err.getvalue()
    store = MemoryStore.open(spark, path)
    assert (store.revision, store.episode_count) == (0, 0)


FLAGS = [
    ("--attribute a", "attribute requires at least one `--value` value"), ("--attribute a --attribute b --value c", "attribute requires at least one `--value` value"), ("--attribute a --timestamp 1", "attribute requires at least one `--value` value"),
    ("--value x", "`--value` must immediately follow its attribute and values"), ("--attribute a --value b --timestamp 1 --value c", "`--value` must immediately follow its attribute and values"),
    ("--attribute", "`--attribute` requires a value"), ("--attribute a --value", "`--value` requires a value"), ("--quiet --quiet", "`--quiet` may be specified only once"), ("--timestamp 1 --timestamp 2", "`--timestamp` may be specified only once"),
    ("--timestamp x --bad y", "invalid Unix timestamp"), ("--bad y", "unknown episode option `--bad`"), ("--bad", "`--bad` requires a value"), ("--attribute a --bad y", "attribute requires at least one `--value` value"), ("--timestamp 3", "episode requires at least one `--attribute`"), ("", "episode requires at least one `--attribute`"),
    ("--attribute a --quiet", "attribute requires at least one `--value` value"), ("--quiet --attribute a --value b --quiet", "`--quiet` may be specified only once"),
]


@pytest.mark.parametrize("line,message", FLAGS)
def test_episode_flag_faults(line, message):
    with pytest.raises(cli.Usage) as e:
        cli.episode_flags(line.split(), False)
    assert str(e.value) == message


def test_episode_flags():
    assert cli.episode_flags("--timestamp 0 --attribute --value --value --quiet --value x --quiet".split(), False) == ((0, [("--value", ["--quiet", "x"])]), True)
    assert cli.episode_flags("--attribute a --value b --timestamp -7 --attribute a --value c".split(), True) == ((-7, [("a", ["b"]), ("a", ["c"])]), False)
    with pytest.raises(cli.Usage, match="not valid inside"):
        cli.episode_flags("--attribute a --quiet".split(), True)
    for options, message in ((["--many"], "only once"), (["--value"], "cannot be combined"), (["--quiet", "--quiet"], "only once")):
        with pytest.raises(cli.Usage, match=message):
            cli.many_flags(options)
    assert cli.many_flags(["--quiet"]) and not cli.many_flags([])


def test_shell_words():
    assert cli.shell_words("a 'b c' \"d\\\"e\" f\\ g h#i # rest") == ["a", "b c", 'd"e', "f g", "h#i"]
    assert cli.shell_words("'x") is None and cli.shell_words("x\\") is None and cli.shell_words("''") == [""]


@pytest.mark.parametrize("words", [recall.WORDS, 0])
def test_structural_pairs_equal_joined_pairs(spark, monkeypatch, words):
    monkeypatch.setattr(recall, "WORDS", words)
    rng = random.Random(4)
    kv = spark.createDataFrame([(s, "all", "x") for s in range(0, 80, 2)] + [(s, rng.choice("abc"), str(rng.randrange(60))) for s in range(80) for _ in range(rng.randrange(5))], "seq long, key string, value string").distinct()
    index = cues.episode_cues(kv)
    counts, sources = cues.cue_counts(index), spark.createDataFrame([(s,) for s in [*range(0, 80, 3), 0, 999]], "src long")
    none = spark.createDataFrame([], "from_seq long, to_seq long, history_bits long, sample_count long")
    want = sorted(tuple(r) for r in recall.scored(index, counts, none, sources).select("src", "tgt", "ppm").collect())
    assert index.select("kind", "a", "b").distinct().count() > 64 and len(want) > 100
    assert sorted(tuple(r) for r in recall.structural_pairs(index, counts, sources).collect()) == want


def test_pairs_of_parts_are_neither_dealt_nor_summed(spark, tmp_path):
    parts = [(i, f"{'red' if i % 2 else 'old'} ring", f"Brand#{i % 7}", "LARGE", i % 5) for i in range(100)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    pairs = plans.recall_all_pairs_score(spark, str(tmp_path))
    assert pairs.count() == 5 * 99 and pairs.where("src = 20 and tgt = 90").first()["ppm"] == 400000
    plan = pairs._jdf.queryExecution().optimizedPlan()
    assert not any("tgt" in line for line in plan.toString().split("\n") if "Aggregate" in line)


def test_pairs_come_in_blocks_and_runs(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(recall, "BLOCK", 16)
    index = staged(cues.episode_cues(spark.createDataFrame([(s, "kind", str(s * 7919 % 5)) for s in range(400)], "seq long, key string, value string")), "cues")
    pairs = recall.structural_pairs(index, cues.cue_counts(index), spark.range(0, 400, 2).select(F.col("id").alias("src")))
    pairs.write.parquet(f"{tmp_path}/pairs")
    files = [pq.read_table(f).to_pylist() for f in sorted(tmp_path.glob("pairs/part-*.parquet"))]
    assert sum(map(len, files)) == 200 * 399
    assert max(len(list(rows)) for f in files for _, rows in itertools.groupby(f, key=lambda r: r["src"])) <= 16
    for column in ("src", "ppm"):
        assert sum(len(list(itertools.groupby(f, key=lambda r: r[column]))) for f in files) < 200 * 399 / 8
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"[+:]- Generate inline\(transform", plan)


def test_streamed_traces(spark, tmp_path):
    rng = random.Random(1)
    rows = [(e, rng.randrange(3), 5, rng.randrange(2)) for e in range(120)]
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], "event_id long, from_seq long, to_seq long, x int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("event_id long, from_seq long, to_seq long, x int").parquet(f"{tmp_path}/in")
        query = stream_traces(stream).writeStream.outputMode("update").foreachBatch(lambda d, i, k=k: d.write.mode("overwrite").parquet(f"{tmp_path}/out{k}")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = {r["from_seq"]: (r["history_bits"], r["sample_count"]) for r in spark.read.parquet(f"{tmp_path}/out2").collect()}
    assert got == {s: fold([x for _, f, _, x in rows if f == s]) for s in range(3)}


def test_streamed_table_of_traces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "WHOLE", 3)
    rng = random.Random(2)
    rows = [(e, rng.randrange(4), rng.randrange(4, 6), rng.randrange(2)) for e in range(150)]
    for k in range(5):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], "event_id long, from_seq long, to_seq long, x int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("event_id long, from_seq long, to_seq long, x int").parquet(f"{tmp_path}/in")
        streaming.fold_stream(stream, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
    got = {(r[0], r[1]): (r[2], r[3]) for r in streaming.traces_at(spark, f"{tmp_path}/out").collect()}
    assert got == {k: fold([x for _, f, t, x in rows if (f, t) == k]) for k in {(f, t) for _, f, t, _ in rows}}
