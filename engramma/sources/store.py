"""A versioned memory store on Parquet: append-only segments under compare-and-swap manifests.

A save writes new segments first, then the whole manifest of the next revision
aside, and publishes it by giving it its name, which fails if that name is taken:
the only step that others see. Of two writers one finds the name taken and fails.
Readers take the highest manifest, so they see a whole revision or the one before.
On a local disk the name is given by a hard link, elsewhere by a rename that does not
replace; object stores whose rename is a copy give no such promise and need a lock outside.

Feedback segments hold only the edges that a save changed; the newest row of an edge counts.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from engramma import errors as E
from engramma import params as P
from engramma.functions.ids import atom_display, memory_id, new_memory_id
from engramma.functions.scores import trace_is_valid
from engramma.functions.symbols import normalise
from engramma.operators import catalog, cues, episodes, feedback, recall
from engramma.sources.stage import numbered, staged

EDGE_SCHEMA = "from_seq long, to_seq long, history_bits long, sample_count long"
SCHEMAS = {
    "symbols": "id long, value string",
    "episodes": f"seq long, timestamp_ms long, attributes {episodes.ATTRIBUTES}",
    "feedback": f"{EDGE_SCHEMA}, revision long",
}
LOG_SCHEMA = "event_id long, from_seq long, to_seq long, x int, set_bits long, set_count long"
#: Feedback segments after which a save writes all edges into one.
SEGMENTS = 16
#: What a manifest holds, and nothing else.
FIELDS = {"format_version": int, "memory_id": str, "revision": int, "symbols": list, "episodes": list, "feedback": list, "symbol_count": int, "episode_count": int}
_MANIFEST = re.compile(r"_manifest\.(\d{10})\.json$")
_SEGMENTS = re.compile(r"v\d{10}-[0-9a-f]{12}$")
_ASIDE = re.compile(r"_aside-[0-9a-f]{32}$")


class _Files:
    """The store's folder through Hadoop's file systems, so any store Spark can write will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, inside: str = "") -> list[str]:
        at = self._at(inside)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def make(self) -> None:
        self.fs.mkdirs(self._at(""))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write a small file aside and give it its name, unless that is taken."""
        aside = self._at(f"_aside-{uuid.uuid4().hex}")
        local = self.fs.getScheme() == "file"
        raw = self.fs.getRawFileSystem() if local else self.fs
        stream = raw.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if local:
                where = lambda p: self.jvm.java.nio.file.Paths.get(p.toUri().getPath(), self._none(self.jvm.java.lang.String))
                self.jvm.java.nio.file.Files.createLink(where(self._at(name)), where(aside))
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf)
                context.rename(aside, self._at(name), self._none(self.jvm.org.apache.hadoop.fs.Options.Rename))
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        finally:
            if raw.exists(aside):
                raw.delete(aside, False)
        return True

    def _none(self, kind):
        """No further arguments, for a call that takes any number of them."""
        return SparkContext._gateway.new_array(kind, 0)


class MemoryStore:
    """Episodes, symbols and feedback of one memory; changes stay local until ``save``."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self._manifest = spark, path, manifest
        self.memory_id = bytes.fromhex(manifest["memory_id"])
        self.revision = manifest["revision"]
        self._pending_symbols: dict[str, int] = {}
        self._pending_episodes: list[tuple] = []
        self._log: list[tuple] = []
        self._index: tuple[DataFrame, DataFrame, int] | None = None

    # -- life cycle

    @classmethod
    def create(cls, spark: SparkSession, path: str, id: bytes | None = None) -> MemoryStore:
        """A new empty memory; an existing folder with any content is never replaced, and of several creators one succeeds."""
        files = _Files(spark, path)
        if any(not _ASIDE.match(n) for n in files.names()):
            raise E.EngrammaError("the store already exists")
        files.make()
        manifest = {"format_version": P.FORMAT_VERSION, "memory_id": (memory_id(id) if id else new_memory_id()).hex(), "revision": 0, "symbols": [], "episodes": [], "feedback": [], "symbol_count": 0, "episode_count": 0}
        if not files.publish(f"_manifest.{0:010d}.json", json.dumps(manifest)):
            raise E.EngrammaError("the store already exists")
        return cls(spark, path, manifest)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> MemoryStore:
        """Open the newest revision; it is validated whole before anything is shown."""
        store = cls(spark, path, cls._metadata(_Files(spark, path)))
        store.validate()
        return store

    @staticmethod
    def _metadata(files: _Files) -> dict:
        """The newest manifest, checked in the order format, memory id, revision, schema."""
        names = files.names()
        found = sorted(n for n in names if _MANIFEST.match(n))
        if not found:
            raise E.MissingMetadata
        try:
            manifest = json.loads(files.read(found[-1]))
        except ValueError as e:
            raise E.InvalidMetadata("manifest is not JSON") from e
        if not isinstance(manifest, dict) or "format_version" not in manifest:
            raise E.MissingMetadata
        if manifest["format_version"] != P.FORMAT_VERSION:
            raise E.UnsupportedFormatVersion(manifest["format_version"])
        for name, kind in FIELDS.items():
            if type(manifest.get(name)) is not kind:
                raise E.InvalidEncoding("manifest", name)
        if not re.fullmatch("[0-9a-f]{32}", manifest["memory_id"]) or not int(manifest["memory_id"], 16):
            raise E.InvalidMemoryId
        if manifest["revision"] < 0:
            raise E.InvalidMetadata("negative snapshot revision")
        if manifest["revision"] != int(_MANIFEST.match(found[-1])[1]):
            raise E.InvalidMetadata("revision differs from the manifest's name")
        strange = [n for n in names if not any(p.match(n) for p in (_MANIFEST, _SEGMENTS, _ASIDE))]
        inside = [f"{n}/{t}" for n in {s.split("/")[0] for t in SCHEMAS for s in manifest[t]} for t in files.names(n) if t not in SCHEMAS]
        listed = [s for t in SCHEMAS for s in manifest[t] if not (_SEGMENTS.match(s.split("/")[0]) and s.endswith(f"/{t}"))]
        if strange or inside or listed or set(manifest) != set(FIELDS):
            raise E.InvalidMetadata("store schema differs from the contract")
        return manifest

    def _table(self, name: str, checked: bool = False) -> DataFrame:
        wanted, out = StructType.fromDDL(SCHEMAS[name]), None
        parts = [f"{self.path}/{p}" for p in self._manifest[name]]
        if checked:
            for part in parts:
                try:
                    found = self.spark.read.parquet(part).schema
                except PySparkException as e:
                    raise E.Unreadable(part) from e
                plain = {f.name: f.dataType.simpleString() for f in found}
                for f in wanted:
                    if plain.pop(f.name, None) != f.dataType.simpleString():
                        raise E.InvalidEncoding(name, f.name)
                if plain:
                    raise E.InvalidMetadata("store schema differs from the contract")
        out = self.spark.read.schema(wanted).parquet(*parts) if parts else self.spark.createDataFrame([], wanted)
        if name != "feedback":
            return out
        if len(parts) < 2:
            return out.drop("revision")
        newest = F.max(F.struct("revision", "history_bits", "sample_count"))
        return out.groupBy(*feedback.EDGE).agg(newest.alias("_t")).select(*feedback.EDGE, "_t.history_bits", "_t.sample_count")

    def validate(self) -> None:
        """Raise the first broken rule of symbols, episodes, then feedback."""
        symbols, eps, edges = (self._table(t, checked=True) for t in ("symbols", "episodes", "feedback"))
        n_symbols, n_episodes = symbols.count(), eps.count()

        def first_gap(table: DataFrame, column: str):
            return numbered(table.select(F.coalesce(F.col(column), F.lit(-1)).alias(column)), "_n", column).where(F.col("_n") != F.col(column)).orderBy("_n").first()

        for row in catalog.invalid_symbols(symbols, n_symbols).orderBy("id", "detail").limit(1).collect():
            if row["detail"] == "identifiers are not contiguous":
                gap = first_gap(symbols, "id")
                raise E.NonContiguousSymbolId(gap["_n"], gap["id"])
            raise E.InvalidSymbol(row["id"], row["detail"])
        if episodes.sequence_gaps(eps, n_episodes).limit(1).count():
            gap = first_gap(eps, "seq")
            raise E.NonContiguousEpisodeSequence(gap["_n"], gap["seq"])
        if n_symbols != self._manifest["symbol_count"] or n_episodes != self._manifest["episode_count"]:
            raise E.InvalidMetadata("row counts differ from the manifest")
        broken = eps.where(F.col("timestamp_ms").isNull() | ~F.col("attributes").eqNullSafe(episodes.canonical_column()) | (F.size("attributes") < 1) | F.exists("attributes", lambda a: F.size(a["values"]) < 1))
        for row in broken.orderBy("seq").limit(1).collect():
            raise E.InvalidEpisode(row["seq"], "attributes are not canonical")
        for row in episodes.unknown_symbols(eps, symbols).orderBy("value").limit(1).collect():
            one = episodes.key_values(eps).where((F.col("key") == row["value"]) | (F.col("value") == row["value"])).agg(F.min("seq").alias("seq")).first()
            raise E.InvalidEpisode(one["seq"], f"unknown symbol {row['value']}")
        for row in feedback.invalid_edges(edges, eps).orderBy("from_seq", "to_seq").limit(1).collect():
            raise E.InvalidFeedback(row["from_seq"], row["to_seq"], row["detail"])

    def _verify_persisted(self, files: _Files) -> None:
        """Before a save: the newest revision is still ours, and its tables end where we remember."""
        manifest = self._metadata(files)
        if manifest["memory_id"] != self._manifest["memory_id"]:
            raise E.InvalidMemoryId
        if manifest["revision"] != self.revision:
            raise E.ConcurrentModification(self.revision, manifest["revision"])
        if self.revision >= P.MAX_REVISION:
            raise E.RevisionExhausted
        for name, column, count in (("symbols", "id", "symbol_count"), ("episodes", "seq", "episode_count")):
            found, want = catalog.tail_of(self._table(name), column).first(), self._manifest[count]
            if (found["rows"], found["tail"]) != (want, want):
                kind = E.NonContiguousSymbolId if name == "symbols" else E.NonContiguousEpisodeSequence
                raise kind(want, found["tail"])

    def save(self) -> int:
        """Publish local changes as the next revision; also when there are none. A failure keeps them."""
        files = _Files(self.spark, self.path)
        self._verify_persisted(files)
        tail = self._symbol_tail()
        for seq, _, attributes in self._pending_episodes:
            if any(not 0 <= i < tail for k, v in attributes for i in (k, *v)):
                raise E.InvalidEpisode(seq, "unknown symbol")
        new = dict(self._manifest, revision=self.revision + 1)
        tag = f"v{new['revision']:010d}-{uuid.uuid4().hex[:12]}"
        if self._pending_symbols:
            rows = sorted((i, v) for v, i in self._pending_symbols.items())
            self.spark.createDataFrame(rows, SCHEMAS["symbols"]).coalesce(1).write.parquet(f"{self.path}/{tag}/symbols")
            new["symbols"] = [*new["symbols"], f"{tag}/symbols"]
            new["symbol_count"] += len(rows)
        if self._pending_episodes:
            self.spark.createDataFrame(self._pending_episodes, SCHEMAS["episodes"]).write.parquet(f"{self.path}/{tag}/episodes")
            new["episodes"] = [*new["episodes"], f"{tag}/episodes"]
            new["episode_count"] += len(self._pending_episodes)
        if self._log:
            whole = len(new["feedback"]) >= SEGMENTS
            rows = self.feedback_edges() if whole else self.changed_edges()
            rows.withColumn("revision", F.lit(new["revision"]).cast("long")).write.parquet(f"{self.path}/{tag}/feedback")
            new["feedback"] = [*([] if whole else new["feedback"]), f"{tag}/feedback"]
        if not files.publish(f"_manifest.{new['revision']:010d}.json", json.dumps(new)):
            raise E.ConcurrentModification(self.revision, new["revision"])
        self._manifest, self.revision = new, new["revision"]
        self._pending_symbols, self._pending_episodes, self._log = {}, [], []
        return self.revision

    # -- symbols

    def _symbol_tail(self) -> int:
        return self._manifest["symbol_count"] + len(self._pending_symbols)

    def intern_symbols(self, texts: list[str]) -> list[int]:
        """Ids of texts; all or none, and staged until ``save``. Equal normalised text has one id."""
        values = []
        for i, text in enumerate(texts):
            value, detail = normalise(text)
            if detail:
                raise E.InvalidSymbolValue(i, detail)
            values.append(value)
        unknown = list(dict.fromkeys(v for v in values if v not in self._pending_symbols))
        asked = self.spark.createDataFrame([(v,) for v in unknown], "value string")
        known = {r["value"]: r["id"] for r in self._table("symbols").join(asked, "value").collect()} if unknown else {}
        new = [v for v in unknown if v not in known]
        at = self._symbol_tail()
        if at + len(new) - 1 > catalog.MAX_ID:
            raise E.SymbolIdExhausted
        self._pending_symbols |= {v: at + i for i, v in enumerate(new)}
        return [self._pending_symbols.get(v, known.get(v)) for v in values]

    def symbol_values(self, ids: list[int]) -> list[str | None]:
        """Texts of ids, staged ones too; None for an unknown id."""
        asked = self.spark.createDataFrame([(i,) for i in set(ids) if -(1 << 63) <= i < 1 << 63], "id long")
        found = {r["id"]: r["value"] for r in self._table("symbols").join(asked, "id").collect()} if ids else {}
        found |= {i: v for v, i in self._pending_symbols.items()}
        for i in ids:
            if i not in found and 0 <= i < self._manifest["symbol_count"]:
                raise E.NonContiguousSymbolId(i, i)
        return [found.get(i) for i in ids]

    # -- episodes

    @property
    def episode_count(self) -> int:
        return self._manifest["episode_count"] + len(self._pending_episodes)

    def insert_episode(self, timestamp_ms: int, attributes: list[tuple[int, list[int]]]) -> int:
        """Append an episode of symbol ids; equal contents stay distinct. Returns its sequence."""
        canonical = episodes.canonical_attributes(attributes)
        tail = self._symbol_tail()
        for i in sorted({i for k, v in canonical for i in (k, *v)}):
            if not 0 <= i < tail:
                raise E.UnknownSymbolId(i)
        if self.episode_count > catalog.MAX_ID:
            raise E.IdExhausted
        self._pending_episodes.append((self.episode_count, timestamp_ms, canonical))
        return self.episode_count - 1

    def insert_texts(self, drafts: list[tuple[int | None, list[tuple[str, list[str]]]]]) -> list[int]:
        """Intern and append a batch (timestamp, [(key, values)]); missing timestamps share one clock reading."""
        now = int(time.time() * 1000)
        ids = iter(self.intern_symbols([t for _, attrs in drafts for k, vs in attrs for t in (k, *vs)]))
        made = [(now if ts is None else ts, [(next(ids), [next(ids) for _ in vs]) for _, vs in attrs]) for ts, attrs in drafts]
        return [self.insert_episode(ts, attrs) for ts, attrs in made]

    def episodes(self) -> DataFrame:
        """All episodes (seq, timestamp_ms, attributes), appended ones too."""
        new = self.spark.createDataFrame(self._pending_episodes, SCHEMAS["episodes"])
        return self._table("episodes").unionByName(new) if self._pending_episodes else self._table("episodes")

    def scan(self, reverse: bool = False) -> DataFrame:
        """All episodes by sequence, or from the last to the first."""
        return episodes.scanned(self.episodes(), reverse)

    def episode(self, seq: int):
        return next(iter(self.episodes().where(F.col("seq") == seq).limit(1).collect()), None)

    # -- feedback

    def _local(self) -> DataFrame:
        return self.spark.createDataFrame(self._log, LOG_SCHEMA)

    def _folded(self) -> DataFrame:
        """The traces of the edges that this session touched: persisted ones as the log's beginning, then the log."""
        log = self._local()
        old = self._table("feedback").join(F.broadcast(log.select(*feedback.EDGE).distinct()), list(feedback.EDGE), "left_semi")
        begin = old.select(F.lit(-1).cast("long").alias("event_id"), *feedback.EDGE, F.lit(None).cast("int").alias("x"), F.col("history_bits").alias("set_bits"), F.col("sample_count").alias("set_count"))
        return feedback.fold_with_resets(begin.unionByName(log))

    def changed_edges(self) -> DataFrame:
        """The edges that a save would write: touched, and other than persisted."""
        return self._folded().join(self._table("feedback"), [*feedback.EDGE, "history_bits", "sample_count"], "left_anti") if self._log else self.spark.createDataFrame([], EDGE_SCHEMA)

    def feedback_edges(self) -> DataFrame:
        """All edges, with what this session appended; samples wait in a log and are folded once, however many calls made them."""
        if not self._log:
            return self._table("feedback")
        touched = F.broadcast(self._local().select(*feedback.EDGE).distinct())
        return self._table("feedback").join(touched, list(feedback.EDGE), "left_anti").unionByName(self._folded())

    def _require(self, seq: int) -> None:
        if not 0 <= seq < self.episode_count:
            raise E.UnknownAtom(atom_display(self.memory_id, seq))

    def feedback_trace(self, source: int, target: int) -> tuple[int, int] | None:
        rows = self.feedback_edges().where((F.col("from_seq") == source) & (F.col("to_seq") == target)).limit(1).collect()
        return (rows[0]["history_bits"], rows[0]["sample_count"]) if rows else None

    def set_feedback_trace(self, source: int, target: int, bits: int, samples: int) -> tuple[int, int] | None:
        """Insert or replace a trace, after checks of the ends, then of a self edge; returns the old one."""
        self._require(source)
        self._require(target)
        if source == target:
            raise E.SelfEdge(atom_display(self.memory_id, source))
        one = self.spark.createDataFrame([(source, target, bits, samples)], EDGE_SCHEMA)
        if not one.select(trace_is_valid(F.col("history_bits"), F.col("sample_count"))).first()[0]:
            raise ValueError("trace is not canonical")
        old = self.feedback_trace(source, target)
        self._log.append((len(self._log), source, target, None, bits, samples))
        return old

    def apply_feedback(self, source: int, targets: list[int], helpful: bool) -> None:
        """One sample for every distinct target but the source; nothing changes if any check fails."""
        self._require(source)
        if len(targets) > P.MAX_FEEDBACK_TARGETS:
            raise E.FeedbackTargetLimitExceeded(len(targets), P.MAX_FEEDBACK_TARGETS)
        for t in targets:
            self._require(t)
        at = len(self._log)
        self._log += [(at, source, t, int(helpful), None, None) for t in sorted({*targets} - {source})]

    # -- recall

    def cue_index(self) -> tuple[DataFrame, DataFrame]:
        """Cues and their numbers, derived on first use; of episodes appended since, only the new ones are derived."""
        if self._index is None:
            index = staged(cues.episode_cues(episodes.key_values(self.episodes())), "cues", "kind", "a", "b")
            self._index = index, staged(cues.cue_counts(index), "counts"), self.episode_count
        index, counts, known = self._index
        if known < self.episode_count:
            appended = [e for e in self._pending_episodes if e[0] >= known]
            if len(appended) == self.episode_count - known:
                new = cues.episode_cues(episodes.key_values(self.spark.createDataFrame(appended, SCHEMAS["episodes"])))
            else:
                new = cues.episode_cues(episodes.key_values(self.episodes().where(F.col("seq") >= known)))
            self._index = index.unionByName(new), counts.unionByName(cues.cue_counts(new)), self.episode_count
        return self._index[:2]

    def recall(self, sources: DataFrame, limit: int = P.DEFAULT_RECALL_LIMIT) -> DataFrame:
        return recall.recall(*self.cue_index(), self.feedback_edges(), sources, limit)

    def recall_from(self, source: int, limit: int = P.DEFAULT_RECALL_LIMIT) -> list[tuple[int, int]]:
        """[(sequence, ppm)] of one source; the source is checked even for limit 0."""
        self._require(source)
        if limit == 0:
            return []
        return [(r["tgt"], r["ppm"]) for r in recall.recall_one(*self.cue_index(), self.feedback_edges(), source, min(limit, self.episode_count)).collect()]
