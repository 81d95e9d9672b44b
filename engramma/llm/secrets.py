"""Secret scan: fixed patterns, and formats learned as probabilistic automata."""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.llm.common import documents, small_batches, text_of
from engramma.llm.licenses import TEMPLATES

# The base patterns and their least lengths.
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
LEAST_PIECE = 16
#: What joins a credential to its name or to a path within a run of candidate characters.
JOINS = "+/_=-"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
DIGITS = "0123456789"
# Public credential formats as (fixed start, alphabet, lengths of the rest).
FORMATS = {
    "access": ("AKIA", UPPER + DIGITS, (16,)),
    "hex": ("", DIGITS + "abcdef", (32, 40, 64)),
    "code_host": ("ghp_", UPPER + LOWER + DIGITS, (36,)),
    "cloud_api": ("AIza", UPPER + LOWER + DIGITS + "_-", (35,)),
    "payment": ("sk_live_", UPPER + LOWER + DIGITS, (24,)),
    "chat": ("xoxb-", DIGITS + UPPER + LOWER, (40,)),
    "key40": ("", UPPER + LOWER + DIGITS + "+/", (40,)),
    "token": ("", UPPER + LOWER + DIGITS, tuple(range(20, 65))),
}
#: Base hits of the corpus that join the labelled credentials at most, those with the least hash.
SAMPLE = 2000
#: Nats by which a piece of no fixed start must be likelier as a credential than as words: credentials are rare.
MARGIN = 6.0
#: Evidence that a fixed start is worth.
SURE = 1000.0
#: Characters that a piece spans at most, where its automaton has no longest credential.
REACH = 512


def labelled_credentials(per_format: int = 300, seed: int = 7) -> dict[str, list[str]]:
    """Labelled training credentials, drawn from the public formats."""
    rng = random.Random(seed)
    return {name: [start + "".join(rng.choice(letters) for _ in range(rng.choice(lengths))) for _ in range(per_format)] for name, (start, letters, lengths) in FORMATS.items()}


def kind_of(c: str) -> str:
    return "l" if c in LOWER else "L" if c in UPPER else "9" if c in DIGITS else c


def class_of(c: str) -> str:
    """What a state emits for the symbol x: a class of characters, alike likely within."""
    return ("h" if c in "abcdef" else "l") if c in LOWER else ("H" if c in "ABCDEF" else "L") if c in UPPER else "9"


ALPHANUMERIC = frozenset(UPPER + LOWER + DIGITS)
CLASSES = {c: class_of(c) for c in UPPER + LOWER + DIGITS} | {c: c for c in JOINS}
#: Share of a format's characters from which a sign is a symbol of its own; a rarer one is one of the classes of x.
OWN = 0.1
SHARE = {k: math.log(sum(v == k for v in CLASSES.values())) for k in {*CLASSES.values()}}


class Automaton:
    """A probabilistic automaton, learned by merging compatible states of a prefix tree (ALERGIA).

    Letters, digits and rare signs are one symbol, so that merging has counts to test; frequent signs stand for themselves.
    A state has how often each symbol follows, how often a credential ends, and how often each class of characters is meant by x.
    Fixed lengths survive the merging, as ends differ; varied lengths become loops.
    """

    def __init__(self, texts: list[str], alpha: float = 0.005, start: str = ""):
        self.start, self.fixed = start, len(start)
        seen = Counter(c for t in texts for c in t[self.fixed :])
        self.plain = ALPHANUMERIC | {c for c, n in seen.items() if n < OWN * seen.total()}
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.means: list[dict[str, int]] = [defaultdict(int)]
        self.ends = [0]
        for t in texts:
            at = 0
            for s, c in self._symbols(t):
                if s not in self.next[at]:
                    for table, new in ((self.next, {}), (self.count, defaultdict(int)), (self.means, defaultdict(int)), (self.ends, 0)):
                        table.append(new)
                    self.next[at][s] = len(self.next) - 1
                self.count[at][s] += 1
                if s == "x":
                    self.means[at][CLASSES.get(c, c)] += 1
                at = self.next[at][s]
            self.ends[at] += 1
        self._merge(alpha)
        self._prune()

    def _prune(self) -> None:
        """Keep the states that can still be reached."""
        order, at = [0], 0
        while at < len(order):
            order += [q for q in dict.fromkeys(self.next[order[at]].values()) if q not in order]
            at += 1
        new = {q: i for i, q in enumerate(order)}
        self.next = [{c: new[q] for c, q in self.next[o].items()} for o in order]
        self.count, self.means, self.ends = [dict(self.count[o]) for o in order], [dict(self.means[o]) for o in order], [self.ends[o] for o in order]

    def _symbols(self, text: str) -> list[tuple[str, str]]:
        """(symbol, character); the fixed start's characters stand for themselves."""
        return [("^" + c, c) for c in text[: self.fixed]] + [(self._symbol(c), c) for c in text[self.fixed :]]

    def _symbol(self, c: str) -> str:
        return "x" if c in self.plain else c

    def _total(self, q: int) -> int:
        return self.ends[q] + sum(self.count[q].values())

    def _different(self, f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
        """Hoeffding's bound on the difference of two observed frequencies."""
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int, alpha: float) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n1, n2 = self._total(a), self._total(b)
            if not n1 or not n2:
                continue
            if self._different(self.ends[a], n1, self.ends[b], n2, alpha):
                return False
            for table in (self.count, self.means):
                if any(self._different(table[a].get(c, 0), n1, table[b].get(c, 0), n2, alpha) for c in {*table[a], *table[b]}):
                    return False
            todo += [(q, self.next[b][c]) for c, q in self.next[a].items() if c in self.next[b] and q != self.next[b][c]]
            if len(todo) > 10_000:
                return False
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the subtree of ``b`` to ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.means[b].items():
                self.means[a][c] += n
            for c, n in self.count[b].items():
                self.count[a][c] += n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge(self, alpha: float) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            parent, c = blue.pop(0)
            q = self.next[parent][c]
            if q in red:
                continue
            for r in red:
                if self._compatible(r, q, alpha):
                    self.next[parent][c] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)
            held = set(red)
            blue = [(r, x) for r in red for x in sorted(self.next[r]) if self.next[r][x] not in held]

    def prefixes(self, text: str, at: int = 0) -> Iterator[tuple[int, float]]:
        """(place, log likelihood) of every beginning of ``text`` from ``at`` that the automaton spells to an end."""
        q, total = 0, 0.0
        for i in range(at, min(len(text), at + REACH) + 1):
            n = self._total(q)
            if self.ends[q]:
                yield i, total + math.log(self.ends[q] / n)
            if i == len(text):
                return
            c = text[i]
            s = "^" + c if i - at < self.fixed else self._symbol(c)
            if s not in self.next[q]:
                return
            total += math.log(self.count[q][s] / n)
            if s == "x":
                k, meant = CLASSES.get(c, c), self.means[q]
                total += math.log((meant.get(k, 0) + 0.05) / (self.count[q][s] + 0.25)) - SHARE.get(k, 0.0)
            q = self.next[q][s]

    def score(self, text: str) -> float:
        """Log likelihood per character; -99 for a text that no path spells to its end."""
        return next((v / max(1, len(text)) for i, v in self.prefixes(text) if i == len(text)), -99.0)


def start_of(texts: list[str]) -> str:
    """The letters and signs that all credentials of a format begin with, if three or more; credentials drawn at random share none."""
    first, last = min(texts), max(texts)
    n = next((i for i, (a, b) in enumerate(zip(first, last, strict=False)) if a != b), min(len(first), len(last)))
    return first[:n] if 3 <= n < len(first) and len({*texts}) > 1 else ""


def train(credentials: dict[str, list[str]] | None = None) -> dict[str, Automaton]:
    """An automaton per format of labelled credentials; formats without one are left out."""
    return {name: Automaton(texts, start=start_of(texts)) for name, texts in (credentials or labelled_credentials()).items() if texts}


def labelled_words(n: int = 4000, seed: int = 7) -> list[str]:
    """Training text of the background: names, paths and numbers made of the words of licence notices."""
    rng, words = random.Random(seed), re.findall(r"[a-z]+", " ".join(TEMPLATES.values()).lower())
    out = []
    for _ in range(n):
        parts, way = rng.choices(words, k=rng.randrange(2, 8)), rng.randrange(6)
        parts = [w.title() for w in parts] if way < 2 else [w.upper() for w in parts] if way == 2 else parts
        parts = [str(rng.randrange(10 ** rng.randrange(1, 9))) if rng.random() < 0.12 else w for w in parts]
        out.append(("", "", "/", "/", "_", "-")[rng.randrange(6)].join(parts))
    return out


class Background:
    """How likely a text is as words, names, paths and numbers, or as few characters repeated."""

    def __init__(self, texts: list[str]):
        self.kinds: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        self.pairs: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for t in texts:
            for a, b in zip(" " + t, t):
                self.kinds[kind_of(a)][kind_of(b)] += 1
                self.pairs[a.lower()][b.lower()] += 1
        self.kinds, self.pairs = ({a: dict(n) for a, n in x.items()} for x in (self.kinds, self.pairs))

    def _words(self, text: str) -> float:
        total = 0.0
        for a, b in zip(" " + text, text):
            k, n = kind_of(b), self.kinds.get(kind_of(a), {})
            total += math.log((n.get(k, 0) + 1) / (sum(n.values()) + 8))
            if k in "lL9":
                same = DIGITS if k == "9" else LOWER
                m = self.pairs.get(a.lower(), {})
                total += math.log((m.get(b.lower(), 0) + 40 / len(same)) / (sum(m.get(c, 0) for c in same) + 40))
        return total

    def _repeats(self, text: str) -> float:
        seen: dict[str, int] = defaultdict(int)
        total = 0.0
        for i, c in enumerate(text):
            total += math.log((seen[c] + 0.5) / (i + 33))
            seen[c] += 1
        return total

    def unlike(self, text: str) -> bool:
        """Whether letters and digits drawn at random are likelier to be the text."""
        return -len(text) * math.log(62) > self.score(text)

    def score(self, text: str) -> float:
        """Log likelihood; repeats are rare, so that they weigh only where the text is plainly made of them."""
        return max(self._words(text), self._repeats(text) - RARE)


#: Nats by which repeated characters are rarer than words.
RARE = 25.0
#: Evidence, in nats, from which the text next to a piece counts as going on like the piece.
GOES_ON = 20.0
#: What base64 is made of besides letters and digits.
BASE64 = frozenset("+/")


def evidence(run: str, s: int, e: int, likelihood: float, automaton: Automaton, background: Background) -> float:
    """Nats, beyond MARGIN, by which a piece of a run that an automaton spells is likelier a credential than words; none if not over 0.

    With a fixed start it is a credential (SURE). Without, it must not be cut out of a longer run of base64 at a joining
    character; one more credential beside it is none.
    """
    more = likelihood - background.score(run[s:e]) - MARGIN
    if automaton.start:
        return SURE + more
    if more <= 0:
        return 0.0

    def stretch(joined: str) -> str:
        """What base64 reaches to beyond a joining character."""
        n = 0
        while n < len(joined) and (joined[n] in ALPHANUMERIC or joined[n] in BASE64):
            n += 1
        return joined[1:n]

    far = max(2 * (e - s), 70)
    beside = stretch(run[max(0, s - far) : s][::-1])[::-1], stretch(run[e : e + far])
    alike = any(c in BASE64 for c in run[max(0, s - 1) : s] + run[e : e + 1])
    cut = any(t and alike and len(t) != e - s and -len(t) * math.log(64) - background.score(t) > GOES_ON for t in beside)
    return 0.0 if cut else more


def base_spans(text: str, patterns: tuple) -> list[tuple[int, int, str]]:
    assign, access, hexed = patterns
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), "access") for m in access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end(), "hex") for m in hexed.finditer(text)]
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


def compiled() -> tuple:
    # A run of hex digits is taken whole, so its least length can stand in the pattern.
    return re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX[:-1] + "{%d,}" % LEAST["hex"])


def pieces(run: str, automata: dict[str, Automaton], background: Background) -> Iterator[tuple[int, int, float]]:
    """Credentials within a run of candidate characters: start, stop and evidence.

    A piece begins with its format's fixed start, wherever that stands, or else after a joining character or with the run;
    it ends, wherever the automaton may, before a joining character or with the run.
    """
    joins = [i for i, c in enumerate(run) if c in JOINS]
    begins, ends = [0, *(i + 1 for i in joins)], {*joins, len(run)}
    for a in automata.values():
        for s in [m.start() for m in re.finditer(f"(?={re.escape(a.start)})", run)] if a.start else begins:
            for e, likelihood in a.prefixes(run, s):
                if e in ends and e - s >= LEAST_PIECE and run[s:e].strip(JOINS) and (found := evidence(run, s, e, likelihood, a, background)) > 0:
                    yield s, e, found


def chosen(found: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Of pieces that overlap those with the most evidence together; of equal sums the one that ends first."""
    found = sorted(found, key=lambda f: (f[1], f[0]))
    stops, best = [f[1] for f in found], [(0.0, [])]
    for i, (s, e, v) in enumerate(found):
        total, spans = best[bisect_right(stops, s, 0, i)]
        best.append((total + v, (spans, (s, e))) if total + v > best[-1][0] else best[-1])
    out, spans = [], best[-1][1]
    while spans:
        spans, span = spans
        out.append(span)
    return out[::-1]


def scan_text(text: str, patterns: tuple, candidate: re.Pattern, automata: dict[str, Automaton], background: Background) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and the spans that only the automata find (kind ``format``)."""
    base, more = base_spans(text, patterns), []
    for m in candidate.finditer(text):
        at = m.start()
        found = [(s + at, e + at, v) for s, e, v in pieces(m.group(), automata, background)]
        more += [(s, e, "format") for s, e in chosen([f for f in found if not any(a < f[1] and f[0] < b for a, b, _ in base)])]
    return base, more


KINDS = ("assign", "access", "hex", "format")


def harvested(docs: DataFrame, id_col: str, text_col: str, sample: int) -> dict[str, list[str]]:
    """Labelled credentials of the corpus itself: the values of base hits by kind, ``sample`` at most, those with the least hash."""

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        patterns = compiled()
        for b in batches:
            out = []
            for item in b:
                text = item.as_py()
                hits = [(k, patterns[0].match(text, s).group(2) if k == "assign" else text[s:e]) for s, e, k in base_spans(text, patterns)]
                out.append([{"kind": k, "value": v} for k, v in hits if len(v) <= REACH])
            yield pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])))

    hits = F.arrow_udf(found, "array<struct<kind:string,value:string>>")
    rows = docs.select(F.explode(hits(text_of(text_col))).alias("_h")).select("_h.kind", "_h.value").distinct()
    rows = rows.orderBy(F.xxhash64("value"), "kind", "value").limit(sample).collect()
    out: dict[str, list[str]] = defaultdict(list)
    for r in rows:
        shape = "hex" if re.fullmatch("[0-9a-f]+", r["value"]) else "mixed"
        out[f"corpus {r['kind']} {shape}"].append(r["value"])
    return {name: values for name, values in out.items() if len(values) >= 30}


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", credentials: dict[str, list[str]] | None = None, sample: int = SAMPLE) -> DataFrame:
    """Find secrets in whole texts: id, ``base`` and ``added`` spans (kind, start, stop).

    Automata are learned on the driver from labelled credentials: those given (default: drawn
    from public formats) and, unless ``sample`` is 0, the values that the fixed patterns find in the corpus, as many at most. They score every
    candidate: each of the ``pieces`` of a run of 16 or more
    characters of credentials' alphabets. One that has its format's fixed start and is spelled by its
    automaton, or that is likelier as a credential than as words, is added, unless it meets a base span. Of added
    spans that would overlap, those with the most evidence together stay. Places
    count code points, ends are exclusive. Null text: empty, no spans. Repeated
    rows are scanned each; other columns are ignored; empty table: no rows.
    """
    small_batches(docs.sparkSession)
    background = Background(labelled_words())
    labelled = dict(labelled_credentials() if credentials is None else credentials)
    if sample:
        # Words as passwords would teach the automata words: only values that are no likelier as words are labelled.
        more = harvested(docs, id_col, text_col, sample)
        labelled |= {name: kept for name, values in more.items() if len(kept := [v for v in values if background.unlike(v)]) >= 30}
    automata = train(labelled) if labelled else {}

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        patterns, candidate = compiled(), re.compile(CANDIDATE)
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for b in batches:
            found = [scan_text(t.as_py(), patterns, candidate, automata, background) for t in b]
            yield pa.StructArray.from_arrays([pa.array([[{"kind": k, "start": s, "stop": e} for s, e, k in f[i]] for f in found], span) for i in (0, 1)], names=["base", "added"])

    spans = "array<struct<kind:string,start:bigint,stop:bigint>>"
    scanned = F.arrow_udf(scan, f"struct<base:{spans},added:{spans}>").asNondeterministic()
    return docs.select(F.col(id_col), scanned(text_of(text_col)).alias("_s")).select(id_col, "_s.base", "_s.added")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    kinds = F.array(*map(F.lit, KINDS))

    def listed(spans: F.Column) -> F.Column:
        keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))
