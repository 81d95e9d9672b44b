"""Registered queries of the memory engine, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma import cli, errors
from engramma.functions import codec, ids, scores
from engramma.functions.symbols import normalised
from engramma.operators import catalog, cues, episodes, feedback, recall
from engramma.sources import tables
from engramma.sources.stage import folder_for, numbered, staged
from engramma.sources.store import MemoryStore

SOURCES = (0, 1, 2, 3, 5, 8, 13, 21)


_warm: dict[tuple, tuple] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> tuple:
    """Derived tables, built on first use and kept for the application: cue indexes are private caches of immutable episodes."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _warm:
        _warm[key] = make()
    return _warm[key]


def _index(kv: DataFrame) -> tuple[DataFrame, DataFrame]:
    index = staged(cues.episode_cues(kv), "cues", "kind", "a", "b")
    return index, staged(cues.cue_counts(index), "counts")


def _sources(spark: SparkSession, ids=SOURCES) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "src long")


def _customers(spark: SparkSession, sf_dir: str):
    return *_once(spark, sf_dir, "customers", lambda: _index(tables.customer_kv(spark, sf_dir))), _customer_edges(spark, sf_dir)


def _customer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "customer edges", lambda: (staged(feedback.fold(tables.customer_samples(spark, sf_dir)), "edges"),))[0]


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _once(spark, sf_dir, "parts", lambda: _index(tables.part_kv(spark, sf_dir)))


def _no_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "from_seq long, to_seq long, history_bits long, sample_count long")


def recall_topk(spark, sf_dir):
    return recall.recall(*_customers(spark, sf_dir), _sources(spark))


def recall_structural(spark, sf_dir):
    index, counts, _ = _customers(spark, sf_dir)
    return recall.recall(index, counts, _no_edges(spark), _sources(spark))


def recall_learned(spark, sf_dir):
    none = spark.createDataFrame([], "seq long, kind int, a string, b string")
    return recall.recall(none, spark.createDataFrame([], "seq long, n long"), _customer_edges(spark, sf_dir), _sources(spark))


def recall_limit_sweep(spark, sf_dir):
    best = staged(recall.ranked(recall.scored(*_customers(spark, sf_dir), _sources(spark)), 25), "best")
    parts = [best.where(F.col("rk") <= k).select(F.lit(k).cast("long").alias("k"), "src", "tgt", "ppm", "rk") for k in (0, 1, 3, 25)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def recall_all_sources(spark, sf_dir):
    index, _, edges = _customers(spark, sf_dir)
    return recall.recall_all(index, edges, 3)


def recall_all_pairs_score(spark, sf_dir):
    """Scores of every part whose id is divisible by 20 against all parts."""
    index, counts = _parts(spark, sf_dir)
    return recall.structural_pairs(index, counts, counts.where("seq % 20 = 0").select(F.col("seq").alias("src")))


def recall_decoded(spark, sf_dir):
    hits = recall_topk(spark, sf_dir)
    text = tables.customer_kv(spark, sf_dir).groupBy("seq", "key").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("value_text"))
    return hits.join(text, hits["tgt"] == text["seq"]).select("src", "rk", "tgt", "ppm", F.col("key").alias("attribute"), "value_text")


def episode_cues(spark, sf_dir):
    return cues.episode_cues(tables.part_kv(spark, sf_dir)).select("seq", F.col("kind").cast("long").alias("kind"), "a", "b")


def cue_counts(spark, sf_dir):
    return cues.cue_counts(cues.episode_cues(tables.part_kv(spark, sf_dir)))


def cue_postings(spark, sf_dir):
    return cues.cue_postings(cues.episode_cues(tables.part_kv(spark, sf_dir))).withColumn("kind", F.col("kind").cast("long"))


def _order_kv(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").cast("long").alias("seq"), F.col("l_suppkey").cast("long").alias("key"), F.col("l_partkey").cast("long").alias("value"))


def episode_canonical(spark, sf_dir):
    rows = episodes.canonical_episodes(_order_kv(spark, sf_dir)).select("seq", F.posexplode("attributes").alias("place", "a"))
    return rows.select("seq", F.col("place").cast("long").alias("place"), "a.key", F.array_join(F.col("a.values").cast("array<string>"), ",").alias("value_ids"))


def insert_sequences(spark, sf_dir):
    turns = tables.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role")
    return episodes.appended(turns, 1000, "conv_id", "turn", "role")


def seq_dense(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("seq"))
    bad = episodes.sequence_gaps(o, o.count())
    return bad.agg(F.count("*").alias("violations"))


def dangling_refs(spark, sf_dir):
    li, p = (tables.table(spark, sf_dir, t) for t in ("lineitem", "part"))
    return episodes.dangling(li.select(F.col("l_partkey").cast("long").alias("v")), "v", p.where("p_size > 5").select(F.col("p_partkey").cast("long").alias("seq")))


def _folded(spark, sf_dir):
    return feedback.fold(tables.samples(spark, sf_dir, 10).where("x is not null"))


def feedback_fold(spark, sf_dir):
    return _folded(spark, sf_dir)


def feedback_fold_with_resets(spark, sf_dir):
    log = tables.samples(spark, sf_dir, 10)
    reset = F.col("x").isNull()
    log = log.withColumn("set_bits", F.when(reset, F.lit(5).cast("long"))).withColumn("set_count", F.when(reset, F.lit(3).cast("long")))
    return feedback.fold_with_resets(log)


def feedback_edges_scan(spark, sf_dir):
    edges = feedback.fold(tables.customer_samples(spark, sf_dir))
    return edges.orderBy("from_seq", "to_seq")


def feedback_point_lookup(spark, sf_dir):
    return feedback.fold(tables.customer_samples(spark, sf_dir).where("from_seq = 7"))


def feedback_projection(spark, sf_dir):
    return _folded(spark, sf_dir).select("from_seq", "to_seq", scores.learned_score("history_bits", "sample_count").alias("learned"))


def trace_counts(spark, sf_dir):
    bits, n = F.col("history_bits"), F.col("sample_count")
    return _folded(spark, sf_dir).select("from_seq", "to_seq", scores.helpful_count(bits).alias("helpful"), scores.unhelpful_count(bits, n).alias("unhelpful"))


def trace_validity(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("event_id"), (F.col("event_id") % 70).cast("long").alias("bits"), (F.col("event_id") % 19).cast("long").alias("samples"))
    return e.withColumn("valid", scores.trace_is_valid(F.col("bits"), F.col("samples")))


def feedback_targets_set(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("source"), F.to_date("ts").alias("d"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    events = e.groupBy("source", "d").agg(F.collect_list("k").alias("targets")).select(F.concat_ws("/", F.col("source").cast("string"), F.col("d").cast("string")).alias("event_id"), "source", "targets", F.lit(True).alias("helpful"))
    good, _ = feedback.event_targets(events, 40)
    return good.select("event_id", "from_seq", "to_seq")


def feedback_reconcile(spark, sf_dir):
    s = tables.samples(spark, sf_dir).where("x is not null")
    return feedback.reconciled(feedback.fold(s.where("event_id % 5 <> 0")), feedback.fold(s.where("event_id % 7 <> 0")))


def symbol_normalize(spark, sf_dir):
    u = tables.table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("pos"), F.concat(F.lit("  "), F.upper("url"), F.lit("\t \n"), F.col("url")).alias("text"))
    good, _ = catalog.normalised_batch(u)
    return good


def symbol_reject(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("pos"), "text")
    _, bad = catalog.normalised_batch(d)
    return bad


def _name_batch(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.posexplode(F.split("p_name", " ")).alias("i", "text"))
    return p.select((F.col("k") * 100 + F.col("i")).alias("pos"), "text").where("text <> ''")


def _interned(spark, sf_dir):
    good, _ = catalog.normalised_batch(_name_batch(spark, sf_dir))
    good = staged(good, "batch")
    _, first = catalog.interned(good.where("pos < 5000"), spark.createDataFrame([], "id long, value string"), 0)
    ids, new = catalog.interned(good, first, first.count())
    return ids, first.unionByName(new)


def symbol_intern(spark, sf_dir):
    return _interned(spark, sf_dir)[0]


def symbol_resolve(spark, sf_dir):
    ids, symbols = _interned(spark, sf_dir)
    return catalog.resolved(ids.unionByName(spark.createDataFrame([(-1, 1 << 40)], "pos long, id long")), symbols)


def catalog_dense(spark, sf_dir):
    """Rows of a catalog that is broken on purpose: ids repeated and out of range, values repeated and not canonical."""
    c = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), "c_name")
    id = F.when(F.col("k") % 11 == 3, F.col("k") + 1).when(F.col("k") % 13 == 5, -F.col("k")).otherwise(F.col("k"))
    value = F.when(F.col("k") % 7 == 0, F.upper("c_name")).when(F.col("k") % 17 == 4, F.concat(F.lit(" "), F.lower("c_name"))).when(F.col("k") % 19 == 6, F.lit("same")).otherwise(F.lower("c_name"))
    symbols = staged(c.select(id.alias("id"), value.alias("value")), "broken")
    return catalog.invalid_symbols(symbols, symbols.count())


def symbol_batch(spark, sf_dir):
    good, _ = catalog.normalised_batch(_name_batch(spark, sf_dir))
    unique, places = catalog.batch_positions(staged(good, "batch"))
    return places.join(unique, "place")


def symbol_unicode(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(a for a, _, _ in _UNICODE)), "pos long, text string")
    good, bad = catalog.normalised_batch(rows)
    none = F.lit(None).cast("string")
    return good.select("pos", "value", none.alias("detail")).unionByName(bad.select("pos", none.alias("value"), "detail"))


def symbol_allocation(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").cast("long").alias("count"))
    room = o.withColumn("tail", F.when(F.col("k") % 2 == 0, F.col("k")).otherwise(F.lit(catalog.MAX_ID) - F.col("k") % 100))
    return room.withColumn("_r", catalog.allocated(F.col("tail"), F.col("count"))).select("k", "_r.first", "_r.last", F.col("_r").isNull().alias("exhausted"))


def symbol_references(spark, sf_dir):
    eps = episodes.canonical_episodes(_order_kv(spark, sf_dir))
    symbols = tables.table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").cast("long").alias("id"))
    return episodes.unknown_symbols(eps, symbols)


def tail_checks(spark, sf_dir):
    named = {"orders": "o_orderkey", "part": "p_partkey", "lineitem": "l_orderkey"}
    parts = [catalog.tail_of(tables.table(spark, sf_dir, t).select(F.col(c).cast("long").alias("id"))).select(F.lit(t).alias("name"), "rows", "tail", (F.col("rows") == F.col("tail")).alias("exact")) for t, c in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _payloads(spark, sf_dir):
    e = episodes.canonical_episodes(_order_kv(spark, sf_dir))
    return e.withColumn("payload", codec.encoded(F.col("seq"), F.col("attributes")))


def codec_roundtrip(spark, sf_dir):
    d = _payloads(spark, sf_dir).withColumn("_d", codec.decoded(F.col("payload"))).select(F.col("_d.timestamp_ms").alias("seq"), F.posexplode("_d.attributes").alias("place", "a"))
    return d.select("seq", F.col("place").cast("long").alias("place"), "a.key", F.array_join(F.col("a.values").cast("array<string>"), ",").alias("value_ids"))


def codec_payload(spark, sf_dir):
    return _payloads(spark, sf_dir).select("seq", F.octet_length("payload").cast("long").alias("bytes"), F.lower(F.hex("payload")).alias("payload"))


def codec_rejects(spark, sf_dir):
    p, way = _payloads(spark, sf_dir), F.col("seq") % 6
    head, tail = F.substring("payload", 1, 8), F.expr("substring(payload, 10)")
    broken = (
        F.when(way == 0, F.substring("payload", 1, 7)).when(way == 1, F.concat("payload", F.lit(b"\0"))).when(way == 2, F.concat(head, F.lit(b"\0"), tail)).when(way == 3, F.concat(head, F.lit(b"\x80"), F.lit(b"\0"), tail))
        .when(way == 4, F.concat(head, F.lit(b"\x7f"), tail)).otherwise(head)
    )
    return p.select("seq", codec.decoded(broken)["detail"].alias("detail"))


def fixed_width(spark, sf_dir):
    k = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"))
    return k.select("k", F.lower(F.hex(ids.u64_bytes(F.col("k")))).alias("encoded"), F.conv(F.hex(ids.u64_bytes(F.col("k"))), 16, 10).cast("long").alias("decoded"))


def memory_ids(spark, sf_dir):
    raw = F.unhex(F.lpad(F.hex(F.col("c_custkey").cast("long") * 1000003), 32, "0"))
    c = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.when(F.col("c_custkey") % 10 == 9, F.substring(raw, 2, 15)).otherwise(raw).alias("raw"))
    return c.select("k", F.lower(F.hex("raw")).alias("shown"), ids.memory_is_valid(F.col("raw")).alias("valid"))


def atom_order(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    memory = F.unhex(F.lpad(F.hex(F.col("o_custkey").cast("long") + 1), 32, "0"))
    atoms = o.select(ids.atom(memory, F.col("o_orderkey")).alias("atom"), ids.atom_text(memory, F.col("o_orderkey")).alias("shown"))
    return numbered(atoms, "rk", "atom").select("shown", "rk")


def symbol_bias(spark, sf_dir):
    u = (F.lit("18446744073709551615").cast("decimal(20,0)") - F.col("p_partkey").cast("decimal(20,0)") * F.lit(1000003)).cast("decimal(20,0)")
    p = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.when(F.col("p_partkey") % 2 == 0, u).otherwise(F.col("p_partkey").cast("decimal(20,0)")).alias("u"))
    return p.select("k", ids.biased(F.col("u")).alias("biased"), ids.unbiased(ids.biased(F.col("u"))).cast("string").alias("back"))


def timestamps(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select(F.col("event_type"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"))
    return e.groupBy("event_type").agg(F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"), F.sum(F.col("timestamp_ms") % 1000).cast("long").alias("parts"))


def activation_range(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("event_id"), (F.col("event_id").cast("long") * 211 - 1000).alias("ppm"))
    return e.select("event_id", scores.ppm_is_valid(F.col("ppm")).alias("valid"), F.when(scores.ppm_is_valid(F.col("ppm")), scores.checked_ppm(F.col("ppm"))).alias("checked"))


def trace_push(spark, sf_dir):
    new, n = scores.pushed(F.col("history_bits"), F.col("sample_count"), F.col("to_seq") % 2 == 0)
    return _folded(spark, sf_dir).select("from_seq", "to_seq", new.alias("history_bits"), n.alias("sample_count"))


def attribute_rules(spark, sf_dir):
    kv = _order_kv(spark, sf_dir).groupBy("seq", "key").agg(F.sort_array(F.collect_set("value")).alias("values"))
    values = F.when(F.col("key") % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.col("values"))
    drafts = kv.groupBy("seq").agg(F.collect_list(F.struct("key", values.alias("values"))).alias("attributes"))
    drafts = drafts.withColumn("attributes", F.when(F.col("seq") % 9 == 0, F.array().cast(episodes.ATTRIBUTES)).otherwise(F.col("attributes")))
    return episodes.empty_parts(drafts).select("seq", "detail")


def episode_scan(spark, sf_dir):
    eps = episodes.canonical_episodes(_order_kv(spark, sf_dir))
    back = episodes.scanned(eps, reverse=True).select("seq", F.size("attributes").cast("long").alias("keys"))
    return numbered(back.withColumn("_back", -F.col("seq")), "place", "_back").drop("_back")


def episode_lookup(spark, sf_dir):
    eps = episodes.canonical_episodes(_order_kv(spark, sf_dir)).where("seq in (0, 7, 100, 1000000000)")
    return eps.select("seq", F.explode("attributes").alias("a")).select("seq", "a.key", F.size("a.values").cast("long").alias("n_values"))


def feedback_upsert(spark, sf_dir):
    s = tables.samples(spark, sf_dir, 10).where("x is not null")
    now, previous = feedback.upserted(feedback.fold(s.where("event_id % 3 <> 0")), feedback.fold(s.where("event_id % 3 = 0 and from_seq < 5")))
    return now.withColumn("state", F.lit("now")).unionByName(previous.withColumn("state", F.lit("previous")))


def feedback_append(spark, sf_dir):
    s = tables.samples(spark, sf_dir, 10).where("x is not null")
    return feedback.folded_onto(feedback.fold(s.where("event_id < 5000")), s.where("event_id >= 5000"))


def feedback_invalid(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("from_seq"), (F.col("event_id") - F.col("event_id") % 3).cast("long").alias("to_seq"), (F.col("event_id") % 70).cast("long").alias("history_bits"), (F.col("event_id") % 19).cast("long").alias("sample_count"))
    known = tables.table(spark, sf_dir, "events").where("event_id % 7 <> 0").select(F.col("event_id").cast("long").alias("seq"))
    return feedback.invalid_edges(e, known).select("from_seq", "to_seq", "detail")


def recall_warm_index(spark, sf_dir):
    """An index of part of the episodes with the cues of the others added equals one of all."""
    kv = tables.part_kv(spark, sf_dir)
    index, counts = _index(kv.where("seq % 4 <> 0"))
    new = cues.episode_cues(kv.where("seq % 4 = 0"))
    return recall.recall(index.unionByName(new), counts.unionByName(cues.cue_counts(new)), _no_edges(spark), _sources(spark))


def error_texts(spark, sf_dir):
    made = [errors.EmptyAttributeValues(), errors.EmptyEpisodeAttributes(), errors.ZeroMemoryId(), errors.OutOfRange(1000001), errors.IdExhausted(), errors.UnknownAtom("ab:1"), errors.FeedbackTargetLimitExceeded(10001, 10000), errors.SelfEdge("ab:1"), errors.InvalidSymbolValue(3, "x"), errors.UnknownSymbolId(4), errors.ConcurrentModification(1, 2), errors.SymbolIdExhausted(), errors.RevisionExhausted(), errors.MissingMetadata(), errors.InvalidEncoding("symbols", "id"), errors.InvalidMemoryId(), errors.NonContiguousEpisodeSequence(3, 4), errors.NonContiguousSymbolId(5, 6), errors.InvalidSymbol(1, "x"), errors.InvalidEpisode(2, "y"), errors.InvalidFeedback(1, 2, "z")]
    return spark.createDataFrame([(type(e).__name__, str(e)) for e in made], "name string, text string")


def _nation_store(spark, sf_dir) -> MemoryStore:
    """A store of all nations as episodes, saved in two revisions and opened again."""
    store = MemoryStore.create(spark, folder_for(spark, "store") + "/memory")
    rows = tables.table(spark, sf_dir, "nation").join(tables.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()
    drafts = [(r["n_nationkey"] * 10 - 50, [("Name", [r["n_name"]]), ("region", [r["r_name"], r["r_name"].lower()])]) for r in rows]
    store.insert_texts(drafts[:10])
    store.save()
    store.insert_texts(drafts[10:])
    same = {k: [r["n_nationkey"] for r in rows if r["n_regionkey"] == k] for k in {r["n_regionkey"] for r in rows}}
    for r in rows:
        store.apply_feedback(r["n_nationkey"], same[r["n_regionkey"]], r["n_nationkey"] % 3 > 0)
    store.save()
    for r in rows[:5]:
        store.apply_feedback(r["n_nationkey"], same[r["n_regionkey"]], True)
    store.save()
    return MemoryStore.open(spark, store.path)


def store_episodes(spark, sf_dir):
    store = _nation_store(spark, sf_dir)
    kv = store.scan().select("seq", "timestamp_ms", F.explode("attributes").alias("a")).select("seq", "timestamp_ms", "a.key", F.explode("a.values").alias("value"))
    symbols = store._table("symbols")
    named = kv.join(symbols.select(F.col("id").alias("key"), F.col("value").alias("attribute")), "key")
    return named.join(symbols.select(F.col("id").alias("value"), F.col("value").alias("text")), "value").select("seq", "timestamp_ms", F.col("key").alias("key_id"), F.col("value").alias("value_id"), "attribute", "text")


def store_feedback(spark, sf_dir):
    return _nation_store(spark, sf_dir).feedback_edges()


def store_recall(spark, sf_dir):
    store = _nation_store(spark, sf_dir)
    return store.recall(store.episodes().select(F.col("seq").alias("src")), 4)


def add_many_rows(spark, sf_dir):
    """Shell-quoted lines of ``add --many``, parsed where they lie."""
    c = tables.table(spark, sf_dir, "conversations").select(F.concat(F.lit("--timestamp "), F.col("turn").cast("string"), F.lit(" --attribute 'the role' --value "), "role", F.lit(" --value \"n "), F.col("conv_id").cast("string"), F.lit("\" # end")).alias("line"))
    return cli.parsed_lines(c).groupBy("timestamp", "attribute", "value").agg(F.count("*").alias("n"))


# --- SQL of the same queries -------------------------------------------------------------

# Texts that are easy to get wrong, as (text, normalised, reason).
_UNICODE = [
    ("  KELVIN\t\nNAME  ", "kelvin name", None), ("\u212aelvin", "kelvin", None), ("\uff23\uff21\uff26\u00c9", "caf\u00e9", None), ("\u0130", "i\u0307", None), ("left\u0085right", "left right", None), ("Stra\u00dfe", "stra\u00dfe", None),
    ("STRASSE", "strasse", None), ("\u039f\u0394\u039f\u03a3", "\u03bf\u03b4\u03bf\u03c3", None), ("\u2003a\u3000b\u1680", "a b", None), ("\U00010d50", "\U00010d70", None), ("\ua7dc", "\u019b", None), ("\U0001ccd6\U0001ccf1", "a1", None),
    (" \t\u2028", None, "symbol value is empty after normalization"), ("a\x01b", None, "symbol value contains a control character"), ("x\x1cy", None, "symbol value contains a control character"), ("x" * 4097, None, "symbol value exceeds 4096 normalized UTF-8 bytes"), ("\u00e9" * 2048, "\u00e9" * 2048, None),
]


def _quoted(text: str | None) -> str:
    """A text as SQL, whatever it holds."""
    return "NULL" if text is None else "decode(from_hex('{}'))".format(text.encode().hex())


_NATION = """
r AS (SELECT n_nationkey::BIGINT AS seq, lower(n_name) AS n, lower(r_name) AS r, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey),
toks AS (SELECT seq, unnest(['name', n, 'region', r, r]) AS t, unnest([0, 1, 2, 3, 4]) AS i FROM r),
symbols AS (SELECT t, (row_number() OVER (ORDER BY min(seq * 5 + i)) - 1)::BIGINT AS id FROM toks GROUP BY t)"""
_NATION_EDGES = """
edges AS (
  SELECT a.seq AS from_seq, b.seq AS to_seq,
    CASE WHEN a.seq < 5 THEN CASE WHEN a.seq % 3 > 0 THEN 3 ELSE 1 END ELSE CASE WHEN a.seq % 3 > 0 THEN 1 ELSE 0 END END::BIGINT AS history_bits,
    CASE WHEN a.seq < 5 THEN 2 ELSE 1 END::BIGINT AS sample_count
  FROM r a JOIN r b ON a.n_regionkey = b.n_regionkey AND a.seq <> b.seq
)"""
_CUSTOMER = """
kv AS (
  SELECT DISTINCT * FROM (
    SELECT c_custkey::BIGINT AS seq, 'segment' AS key, lower(c_mktsegment) AS value FROM customer
    UNION ALL SELECT c_custkey, 'nation', lower(n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT c_custkey, 'region', lower(r_name) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT o_custkey, 'status', lower(o_orderstatus) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT o_custkey, 'priority', lower(o_orderpriority) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
  ) WHERE value IS NOT NULL
)"""
_PART = """
kv AS (
  SELECT DISTINCT * FROM (
    SELECT p_partkey::BIGINT AS seq, 'brand' AS key, lower(p_brand) AS value FROM part
    UNION ALL SELECT p_partkey, 'type', lower(p_type) FROM part
    UNION ALL SELECT p_partkey, 'size', lower(p_size::VARCHAR) FROM part
    UNION ALL SELECT p_partkey, 'name', w FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE w <> ''
  ) WHERE value IS NOT NULL
)"""
_CUES = """
cues AS (
  SELECT seq, 0 AS kind, key AS a, '' AS b FROM kv UNION SELECT seq, 1, value, '' FROM kv UNION SELECT seq, 2, key, value FROM kv
), counts AS (SELECT seq, count(*) AS n FROM cues GROUP BY seq)"""
_SAMPLES = """
s0 AS (
  SELECT event_id::BIGINT AS event_id, user_id::BIGINT {m} AS from_seq, json_extract_string(props, '$.k')::BIGINT {m} AS to_seq,
         CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'signup' THEN NULL ELSE 1 END AS x
  FROM events WHERE event_type IN ('purchase', 'click', 'error', 'signup')
), s AS (SELECT * FROM s0 WHERE from_seq <> to_seq {w})"""
_FOLD = """
r AS (SELECT *, row_number() OVER (PARTITION BY from_seq, to_seq ORDER BY event_id DESC) AS rn FROM s WHERE x IS NOT NULL),
edges AS (
  SELECT from_seq, to_seq, sum(x * (1 << (rn - 1)::INT))::BIGINT AS history_bits, count(*) AS sample_count FROM r WHERE rn <= 16 GROUP BY from_seq, to_seq
)"""
_ENDS = "AND from_seq IN (SELECT c_custkey FROM customer) AND to_seq IN (SELECT c_custkey FROM customer)"
_CUSTOMER_SAMPLES = _SAMPLES.format(m="", w=_ENDS)
_TEN_SAMPLES = _SAMPLES.format(m="% 10", w="")
_LEARNED = "((400000 * (2 * bit_count(history_bits)::BIGINT - sample_count) * 23) // (16 * (sample_count + 7)))::BIGINT"
_NONE = "edges AS (SELECT 0::BIGINT AS from_seq, 0::BIGINT AS to_seq, 0::BIGINT AS history_bits, 1::BIGINT AS sample_count WHERE false)"


def _score(sources: str, structural: bool = True) -> str:
    return f"""
shared AS (
  SELECT x.seq AS src, y.seq AS tgt, count(*) AS n FROM cues x JOIN cues y ON x.kind = y.kind AND x.a = y.a AND x.b = y.b
  WHERE x.seq IN ({sources}) AND x.seq <> y.seq {"" if structural else "AND false"} GROUP BY 1, 2
), st AS (
  SELECT src, tgt, (shared.n * 400000) // (p.n + q.n - shared.n) AS v FROM shared JOIN counts p ON p.seq = src JOIN counts q ON q.seq = tgt
), le AS (SELECT from_seq AS src, to_seq AS tgt, {_LEARNED} AS v FROM edges WHERE from_seq IN ({sources}) AND from_seq <> to_seq),
sc AS (
  SELECT src, tgt, least(greatest(coalesce(st.v, 0) + coalesce(le.v, 0), 0), 800000)::BIGINT AS ppm FROM st FULL JOIN le USING (src, tgt)
), hits AS (SELECT src, tgt, ppm, row_number() OVER (PARTITION BY src ORDER BY ppm DESC, tgt) AS rk FROM sc WHERE ppm > 0)"""


_EIGHT = ", ".join(map(str, SOURCES))
_BASE = f"WITH {_CUSTOMER}, {_CUES}, {_CUSTOMER_SAMPLES}, {_FOLD}, {_score(_EIGHT)}"
_NORM = r"trim(regexp_replace(lower({}), '[\t\n\x0b\x0c\r ]+', ' ', 'g'))"
_NAMES = """
n0 AS (SELECT p_partkey::BIGINT AS k, string_split(p_name, ' ') AS w FROM part), n1 AS (SELECT k, unnest(range(len(w))) AS i, lower(unnest(w)) AS value FROM n0),
batch AS (SELECT k * 100 + i AS pos, value FROM n1 WHERE value <> ''),
firsts AS (SELECT value, min(pos) AS f FROM batch GROUP BY value), symbols AS (SELECT value, (row_number() OVER (ORDER BY f) - 1)::BIGINT AS id FROM firsts)"""

ORACLES = {
    "recall_topk": f"{_BASE} SELECT src, tgt, ppm, rk FROM hits WHERE rk <= 10",
    "recall_structural": f"WITH {_CUSTOMER}, {_CUES}, {_NONE}, {_score(_EIGHT)} SELECT src, tgt, ppm, rk FROM hits WHERE rk <= 10",
    "recall_learned": f"WITH {_CUSTOMER}, {_CUES}, {_CUSTOMER_SAMPLES}, {_FOLD}, {_score(_EIGHT, False)} SELECT src, tgt, ppm, rk FROM hits WHERE rk <= 10",
    "recall_limit_sweep": f"{_BASE} SELECT k::BIGINT AS k, src, tgt, ppm, rk FROM hits JOIN (VALUES (0), (1), (3), (25)) t(k) ON rk <= k",
    "recall_all_sources": f"WITH {_CUSTOMER}, {_CUES}, {_CUSTOMER_SAMPLES}, {_FOLD}, {_score('SELECT seq FROM counts')} SELECT src, tgt, ppm, rk FROM hits WHERE rk <= 3",
    "recall_all_pairs_score": f"WITH {_PART}, {_CUES}, {_NONE}, {_score('SELECT seq FROM counts WHERE seq % 20 = 0')} SELECT src, tgt, ppm FROM hits",
    "recall_decoded": f"{_BASE}, t AS (SELECT seq, key, string_agg(value, ',' ORDER BY value) AS value_text FROM kv GROUP BY seq, key) SELECT src, rk, tgt, ppm, key AS attribute, value_text FROM hits JOIN t ON seq = tgt WHERE rk <= 10",
    "episode_cues": f"WITH {_PART}, {_CUES} SELECT seq, kind::BIGINT AS kind, a, b FROM cues",
    "cue_counts": f"WITH {_PART}, {_CUES} SELECT seq, n FROM counts",
    "cue_postings": f"WITH {_PART}, {_CUES} SELECT kind::BIGINT AS kind, a, b, count(*) AS episodes, min(seq) AS first_seq, max(seq) AS last_seq FROM cues GROUP BY kind, a, b",
    "episode_canonical": "WITH g AS (SELECT l_orderkey::BIGINT AS seq, l_suppkey::BIGINT AS key, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS x, list_sort(list(DISTINCT l_partkey::BIGINT)) AS v FROM lineitem GROUP BY 1, 2) SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY key) - 1 AS place, key, array_to_string(v, ',') AS value_ids FROM g",
    "insert_sequences": "SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, row_number() OVER (ORDER BY conv_id, turn, role) - 1 + 1000 AS seq FROM conversations",
    "seq_dense": "WITH o AS (SELECT o_orderkey AS seq FROM orders) SELECT count(*) AS violations FROM (SELECT seq, count(*) AS n FROM o GROUP BY seq) WHERE n > 1 OR seq < 0 OR seq >= (SELECT count(*) FROM o) OR seq IS NULL",
    "dangling_refs": "SELECT DISTINCT l_partkey::BIGINT AS value FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)",
    "feedback_fold": f"WITH {_TEN_SAMPLES}, {_FOLD} SELECT * FROM edges",
    "feedback_fold_with_resets": f"""WITH {_TEN_SAMPLES},
last AS (SELECT from_seq, to_seq, max(event_id) FILTER (WHERE x IS NULL) AS e FROM s GROUP BY 1, 2),
r AS (SELECT s.*, e, row_number() OVER (PARTITION BY s.from_seq, s.to_seq ORDER BY event_id DESC) AS rn FROM s JOIN last ON s.from_seq = last.from_seq AND s.to_seq = last.to_seq WHERE x IS NOT NULL AND (e IS NULL OR event_id > e)),
n AS (SELECT from_seq, to_seq, sum(CASE WHEN rn <= 16 THEN x * (1 << least(rn - 1, 16)::INT) ELSE 0 END)::BIGINT AS b, least(count(*), 16) AS k FROM r GROUP BY 1, 2)
SELECT l.from_seq, l.to_seq, (((CASE WHEN e IS NULL THEN 0 ELSE 5 END << coalesce(k, 0)::INT) | coalesce(b, 0)) & 65535)::BIGINT AS history_bits,
  least(CASE WHEN e IS NULL THEN 0 ELSE 3 END + coalesce(k, 0), 16)::BIGINT AS sample_count
FROM last l LEFT JOIN n ON l.from_seq = n.from_seq AND l.to_seq = n.to_seq""",
    "feedback_edges_scan": f"WITH {_CUSTOMER_SAMPLES}, {_FOLD} SELECT * FROM edges",
    "feedback_point_lookup": f"WITH {_CUSTOMER_SAMPLES}, {_FOLD} SELECT * FROM edges WHERE from_seq = 7",
    "feedback_projection": f"WITH {_TEN_SAMPLES}, {_FOLD} SELECT from_seq, to_seq, {_LEARNED} AS learned FROM edges",
    "trace_counts": f"WITH {_TEN_SAMPLES}, {_FOLD} SELECT from_seq, to_seq, bit_count(history_bits)::BIGINT AS helpful, sample_count - bit_count(history_bits)::BIGINT AS unhelpful FROM edges",
    "trace_validity": "WITH e AS (SELECT event_id::BIGINT AS event_id, (event_id % 70)::BIGINT AS bits, (event_id % 19)::BIGINT AS samples FROM events) SELECT *, samples BETWEEN 1 AND 16 AND bits < (1::BIGINT << samples::INT) AS valid FROM e",
    "feedback_targets_set": "WITH e AS (SELECT user_id::BIGINT AS source, ts::DATE AS d, json_extract_string(props, '$.k')::BIGINT AS k FROM events), ok AS (SELECT source, d FROM e GROUP BY 1, 2 HAVING count(k) <= 40) SELECT DISTINCT source::VARCHAR || '/' || d::VARCHAR AS event_id, source AS from_seq, k AS to_seq FROM e JOIN ok USING (source, d) WHERE k <> source",
    "feedback_reconcile": f"""WITH {_SAMPLES.format(m="", w="AND x IS NOT NULL")},
p AS (SELECT from_seq, to_seq, sum(CASE WHEN rn <= 16 THEN x * (1 << least(rn - 1, 16)::INT) ELSE 0 END)::BIGINT AS b, least(count(*), 16) AS n FROM (SELECT *, row_number() OVER (PARTITION BY from_seq, to_seq ORDER BY event_id DESC) AS rn FROM s WHERE event_id % 5 <> 0) GROUP BY 1, 2),
q AS (SELECT from_seq, to_seq, sum(CASE WHEN rn <= 16 THEN x * (1 << least(rn - 1, 16)::INT) ELSE 0 END)::BIGINT AS b, least(count(*), 16) AS n FROM (SELECT *, row_number() OVER (PARTITION BY from_seq, to_seq ORDER BY event_id DESC) AS rn FROM s WHERE event_id % 7 <> 0) GROUP BY 1, 2)
SELECT from_seq, to_seq, CASE WHEN p.n IS NULL THEN 'insert' WHEN q.n IS NULL THEN 'delete' ELSE 'update' END AS op, coalesce(q.b, p.b) AS history_bits, coalesce(q.n, p.n)::BIGINT AS sample_count
FROM p FULL JOIN q USING (from_seq, to_seq) WHERE p.n IS NULL OR q.n IS NULL OR p.b <> q.b OR p.n <> q.n""",
    "symbol_normalize": f"SELECT page_id::BIGINT AS pos, {_NORM.format("upper(url) || ' ' || url")} AS value FROM pages",
    "symbol_reject": f"SELECT doc_id::BIGINT AS pos, 'symbol value exceeds 4096 normalized UTF-8 bytes' AS detail FROM documents WHERE strlen({_NORM.format('text')}) > 4096",
    "symbol_intern": f"WITH {_NAMES} SELECT pos, id FROM batch JOIN symbols USING (value)",
    "symbol_resolve": f"WITH {_NAMES} SELECT pos, id, value FROM batch JOIN symbols USING (value) UNION ALL SELECT -1, 1::BIGINT << 40, NULL",
    "catalog_dense": """
WITH c AS (SELECT c_custkey::BIGINT AS k, c_name FROM customer),
s AS (SELECT CASE WHEN k % 11 = 3 THEN k + 1 WHEN k % 13 = 5 THEN -k ELSE k END AS id,
  CASE WHEN k % 7 = 0 THEN upper(c_name) WHEN k % 17 = 4 THEN ' ' || lower(c_name) WHEN k % 19 = 6 THEN 'same' ELSE lower(c_name) END AS value FROM c)
SELECT id, 'symbol value is not canonical' AS detail FROM s WHERE value <> trim(lower(value))
UNION ALL SELECT id, 'identifiers are not contiguous' FROM s GROUP BY id HAVING count(*) > 1 OR id < 0 OR id >= (SELECT count(*) FROM s)
UNION ALL SELECT max(id), 'symbol value is repeated' FROM s GROUP BY value HAVING count(*) > 1""",
    "codec_roundtrip": "WITH g AS (SELECT l_orderkey::BIGINT AS seq, l_suppkey::BIGINT AS key, list_sort(list(DISTINCT l_partkey::BIGINT)) AS v FROM lineitem GROUP BY 1, 2) SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY key) - 1 AS place, key, array_to_string(v, ',') AS value_ids FROM g",
    "codec_payload": """
WITH k AS (SELECT l_orderkey::BIGINT AS seq, l_suppkey::BIGINT AS key, list_sort(list(DISTINCT l_partkey::BIGINT)) AS v FROM lineitem GROUP BY 1, 2),
a AS (SELECT seq, key, printf('%016x', key) || printf('%02x', len(v)) || array_to_string([printf('%016x', x) for x in v], '') AS h FROM k),
e AS (SELECT seq, printf('%016x', seq) || printf('%02x', count(*)) || string_agg(h, '' ORDER BY key) AS payload FROM a GROUP BY seq)
SELECT seq, (strlen(payload) // 2)::BIGINT AS bytes, payload FROM e""",
    "codec_rejects": """SELECT DISTINCT l_orderkey::BIGINT AS seq, ['episode blob is truncated', 'episode blob has trailing bytes', 'episode has no attributes', 'count ULEB128 is not canonical', 'episode attribute count exceeds remaining bytes', 'count ULEB128 is truncated'][l_orderkey % 6 + 1] AS detail FROM lineitem""",
    "symbol_batch": f"WITH {_NAMES} SELECT pos, id AS place, value FROM batch JOIN symbols USING (value)",
    "symbol_unicode": "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {_quoted(b)}, {_quoted(c)})" for i, (_, b, c) in enumerate(_UNICODE)) + ") t(pos, value, detail)",
    "symbol_allocation": """
WITH o AS (SELECT o_orderkey::BIGINT AS k, o_custkey::HUGEINT AS n, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::HUGEINT ELSE 9223372036854775807::HUGEINT - o_orderkey % 100 END AS tail FROM orders),
r AS (SELECT *, n > 0 AND tail + n - 1 <= 9223372036854775807 AS fits FROM o)
SELECT k, CASE WHEN fits THEN tail::BIGINT END AS first, CASE WHEN fits THEN (tail + n - 1)::BIGINT END AS last, NOT fits AS exhausted FROM r""",
    "symbol_references": "SELECT v::BIGINT AS value FROM (SELECT l_partkey AS v FROM lineitem UNION SELECT l_suppkey FROM lineitem) WHERE v NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)",
    "tail_checks": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows, max({c})::BIGINT + 1 AS tail, count(*) = max({c}) + 1 AS exact FROM {t}" for t, c in (("orders", "o_orderkey"), ("part", "p_partkey"), ("lineitem", "l_orderkey"))),
    "fixed_width": "SELECT o_orderkey::BIGINT AS k, printf('%016x', o_orderkey::BIGINT) AS encoded, o_orderkey::BIGINT AS decoded FROM orders",
    "memory_ids": "WITH c AS (SELECT c_custkey::BIGINT AS k, lpad(printf('%x', c_custkey::BIGINT * 1000003), 32, '0') AS h FROM customer) SELECT k, CASE WHEN k % 10 = 9 THEN substr(h, 3) ELSE h END AS shown, k % 10 <> 9 AND k <> 0 AS valid FROM c",
    "atom_order": "SELECT lpad(printf('%x', o_custkey::BIGINT + 1), 32, '0') || ':' || o_orderkey::VARCHAR AS shown, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS rk FROM orders",
    "symbol_bias": "WITH p AS (SELECT p_partkey::BIGINT AS k, CASE WHEN p_partkey % 2 = 0 THEN 18446744073709551615::HUGEINT - p_partkey::HUGEINT * 1000003 ELSE p_partkey::HUGEINT END AS u FROM part) SELECT k, (u - 9223372036854775808::HUGEINT)::BIGINT AS biased, u::VARCHAR AS back FROM p",
    "timestamps": "SELECT event_type, min(epoch_us(ts) // 1000)::BIGINT AS first_ms, max(epoch_us(ts) // 1000)::BIGINT AS last_ms, sum(epoch_us(ts) // 1000 % 1000)::BIGINT AS parts FROM events GROUP BY event_type",
    "activation_range": "WITH e AS (SELECT event_id::BIGINT AS event_id, event_id::BIGINT * 211 - 1000 AS ppm FROM events) SELECT event_id, ppm BETWEEN 0 AND 1000000 AS valid, CASE WHEN ppm BETWEEN 0 AND 1000000 THEN ppm END AS checked FROM e",
    "trace_push": f"WITH {_TEN_SAMPLES}, {_FOLD} SELECT from_seq, to_seq, ((history_bits << 1 | CASE WHEN to_seq % 2 = 0 THEN 1 ELSE 0 END) & 65535)::BIGINT AS history_bits, least(sample_count + 1, 16)::BIGINT AS sample_count FROM edges",
    "attribute_rules": "SELECT l_orderkey::BIGINT AS seq, CASE WHEN l_orderkey % 9 = 0 THEN 'an episode requires at least one attribute' ELSE 'an attribute requires at least one value' END AS detail FROM lineitem GROUP BY l_orderkey HAVING l_orderkey % 9 = 0 OR bool_or(l_suppkey % 5 = 0)",
    "episode_scan": "SELECT l_orderkey::BIGINT AS seq, count(DISTINCT l_suppkey) AS keys, row_number() OVER (ORDER BY l_orderkey DESC) - 1 AS place FROM lineitem GROUP BY l_orderkey",
    "episode_lookup": "SELECT l_orderkey::BIGINT AS seq, l_suppkey::BIGINT AS key, count(DISTINCT l_partkey) AS n_values FROM lineitem WHERE l_orderkey IN (0, 7, 100, 1000000000) GROUP BY 1, 2",
    "feedback_upsert": f"""WITH {_TEN_SAMPLES},
n AS (SELECT *, event_id % 3 = 0 AS late, row_number() OVER (PARTITION BY from_seq, to_seq, event_id % 3 = 0 ORDER BY event_id DESC) AS rn FROM s WHERE x IS NOT NULL),
t AS (SELECT late, from_seq, to_seq, sum(x * (1 << (rn - 1)::INT))::BIGINT AS history_bits, count(*) AS sample_count FROM n WHERE rn <= 16 AND (NOT late OR from_seq < 5) GROUP BY ALL)
SELECT from_seq, to_seq, history_bits, sample_count, CASE WHEN late OR (from_seq, to_seq) NOT IN (SELECT (from_seq, to_seq) FROM t WHERE late) THEN 'now' ELSE 'previous' END AS state FROM t""",
    "feedback_append": f"WITH {_TEN_SAMPLES}, {_FOLD} SELECT * FROM edges",
    "feedback_invalid": """
WITH e AS (SELECT event_id::BIGINT AS from_seq, (event_id - event_id % 3)::BIGINT AS to_seq, (event_id % 70)::BIGINT AS b, (event_id % 19)::BIGINT AS n FROM events),
d AS (SELECT *, CASE WHEN from_seq % 7 = 0 OR to_seq NOT IN (SELECT event_id FROM events WHERE event_id % 7 <> 0) THEN 'unknown endpoint' WHEN from_seq = to_seq THEN 'self edge' WHEN NOT (n BETWEEN 1 AND 16 AND b < (1::BIGINT << n::INT)) THEN 'trace is not canonical' END AS detail FROM e)
SELECT from_seq, to_seq, detail FROM d WHERE detail IS NOT NULL""",
    "recall_warm_index": f"WITH {_PART}, {_CUES}, {_NONE}, {_score(_EIGHT)} SELECT src, tgt, ppm, rk FROM hits WHERE rk <= 10",
    "error_texts": """SELECT * FROM (VALUES
  ('EmptyAttributeValues', 'an attribute requires at least one value'), ('EmptyEpisodeAttributes', 'an episode requires at least one attribute'), ('ZeroMemoryId', 'a memory identifier must be non-zero'),
  ('OutOfRange', 'fixed-point value 1000001 exceeds 1000000'), ('IdExhausted', 'atom identifier space is exhausted'), ('UnknownAtom', 'unknown atom ab:1'), ('FeedbackTargetLimitExceeded', 'feedback target count 10001 exceeds 10000'),
  ('SelfEdge', 'atom ab:1 cannot have feedback about itself'), ('InvalidSymbolValue', 'invalid symbol at batch index 3: x'), ('UnknownSymbolId', 'unknown symbol identifier 4'), ('ConcurrentModification', 'memory revision changed from 1 to 2'),
  ('SymbolIdExhausted', 'symbol identifier space is exhausted'), ('RevisionExhausted', 'memory snapshot revision is exhausted'), ('MissingMetadata', 'invalid memory store: memory metadata row is missing'), ('InvalidEncoding', 'invalid memory store: invalid encoding in symbols.id'),
  ('InvalidMemoryId', 'invalid memory store: invalid persisted memory ID'), ('NonContiguousEpisodeSequence', 'invalid memory store: expected episode sequence 3, found 4'), ('NonContiguousSymbolId', 'invalid memory store: expected symbol identifier 5, found 6'),
  ('InvalidSymbol', 'invalid memory store: invalid symbol 1: x'), ('InvalidEpisode', 'invalid memory store: invalid episode 2: y'), ('InvalidFeedback', 'invalid memory store: invalid feedback edge 1->2: z')) t(name, text)""",
    "store_episodes": f"WITH {_NATION} SELECT DISTINCT r.seq, r.seq * 10 - 50 AS timestamp_ms, k.id AS key_id, v.id AS value_id, k.t AS attribute, v.t AS text FROM r CROSS JOIN (VALUES ('name'), ('region')) a(k) JOIN symbols k ON k.t = a.k JOIN symbols v ON v.t = CASE a.k WHEN 'name' THEN r.n ELSE r.r END",
    "store_feedback": f"WITH {_NATION}, {_NATION_EDGES} SELECT * FROM edges",
    "store_recall": f"WITH {_NATION}, {_NATION_EDGES}, kv AS (SELECT seq, 'name' AS key, n AS value FROM r UNION SELECT seq, 'region', r FROM r), {_CUES}, {_score('SELECT seq FROM counts')} SELECT src, tgt, ppm, rk FROM hits WHERE rk <= 4",
    "add_many_rows": "SELECT turn::BIGINT AS timestamp, 'the role' AS attribute, v AS value, count(*) AS n FROM (SELECT turn, unnest([role, 'n ' || conv_id]) AS v FROM conversations) GROUP BY ALL",
}

QUERIES = {name: globals()[name] for name in ORACLES}
