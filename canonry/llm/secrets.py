"""Secret scans: rules for known forms, and probabilistic automata learned from the credentials that they find.

What the rules match is a set of labelled credentials, by kind. From a bounded sample of each kind a prefix tree is built,
and states whose futures don't differ statistically are merged into an automaton with chances; so is one of ordinary runs
of characters. Every other run is then scored: one that a kind's automaton finds far likelier than the ordinary one does,
and about as likely as its own credentials, is a secret too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The known forms, in their order; of an assignment the value is the second group.
KINDS = {
    "assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: The kind of spans that automata add.
LEARNED = "format"
#: Runs that are scored, and their least length.
RUN, LEAST_RUN = r"[A-Za-z0-9+/_.=-]", 12
#: Distinct credentials of a kind, and other runs, that automata are learned from at most; what is left of longer ones.
SAMPLE, ORDINARY, SAMPLED_LENGTH = 2_000, 10_000, 128
#: Fewer distinct credentials than this teach nothing.
ENOUGH = 8
#: Bound of the merging test: the smaller, the more is merged.
ALPHA = 0.01
#: A kind must be so many times likelier (natural logarithm) than the ordinary, and a run as likely per character, and as
#: long, as all but this share of the kind's own credentials: merging states into loops forgets lengths.
MARGIN, ATYPICAL = 12.0, 0.01
#: A prefix of PREFIX characters that this share of a kind's credentials has is one symbol.
PREFIX, PREFIX_SHARE = 4, 0.05

_assign = re.compile(KINDS["assign"], re.IGNORECASE | re.ASCII)
_access = re.compile(KINDS["access"])
_hex = re.compile(rf"[0-9a-f]{{{LEAST['hex']},}}")  # a run of fewer fails as a whole, so it needn't be matched
_run = re.compile(rf"{RUN}{{{LEAST_RUN},}}")


def known_spans(text: str) -> list[tuple[int, int, int, str]]:
    """start, number of the kind, end and credential of what the rules match, in order."""
    found = [(m.start(), 0, m.end(), m[2]) for m in _assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end(), m[0]) for m in _access.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), 2, m.end(), m[0]) for m in _hex.finditer(text)]
    return sorted(found)


def other_runs(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, str]]:
    """Start and characters of runs outside the spans."""
    out, at = [], 0
    for m in _run.finditer(text):
        a = m.start()
        while at < len(spans) and spans[at][2] <= a:
            at += 1
        for s in spans[at:]:
            if s[0] >= m.end():
                break
            if s[0] - a >= LEAST_RUN:
                out.append((a, text[a : s[0]]))
            a = max(a, s[2])
        if m.end() - a >= LEAST_RUN:
            out.append((a, text[a : m.end()]))
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    """kind:start:end of spans (start, kind, end), in order."""
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, known array<struct<start:int,kind:int,stop:int,value:string>>, runs array<struct<start:int,value:string>>"


def scanned(documents: DataFrame) -> DataFrame:
    """doc_id, counts and hash of what the rules find in each whole text, known (the spans) and runs (what is left).

    Each text is scanned by itself, whatever its length; a null or empty one has nothing. Repeated rows and null ids each
    keep their row, extra columns are left out, an empty table gives an empty result.
    """
    names = list(KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                spans = known_spans(text or "")
                counts = [sum(s[1] == k for s in spans) for k in range(3)]
                base = joined([(s, names[k], e) for s, k, e, _ in spans])
                rows.append((doc_id, *counts, hashlib.sha256(base.encode()).hexdigest(), [dict(zip(("start", "kind", "stop", "value"), s)) for s in spans], [{"start": a, "value": v} for a, v in other_runs(text or "", spans)]))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("value", pa.string())])), pa.list_(pa.struct([("start", pa.int32()), ("value", pa.string())]))]
            names_ = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "known", "runs"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names_)

    kind = dict(documents.dtypes)["doc_id"]
    return common.documents_only(documents, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, {FOUND}")


# automata

#: Symbols: classes of characters, and how many characters a class has.
CLASSES = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-"]
CLASS = {ord(c): i for i, chars in enumerate(CLASSES) for c in chars}
SIZES = np.log([len(c) for c in CLASSES])
END = len(CLASSES)


def symbols(text: str, prefixes: dict[str, int]) -> list[int]:
    """A run as symbols: one for a prefix of the kind, then one for each character."""
    first = prefixes.get(text[:PREFIX])
    rest = text[PREFIX:] if first is not None else text
    return ([first] if first is not None else []) + [CLASS[ord(c)] for c in rest]


class Tree:
    """Counts of a prefix tree: by state, how many went on with a symbol (END: stopped) and where to."""

    def __init__(self, sequences: list[list[int]], width: int) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.counts = [np.zeros(width, "i8")]
        for sequence in sequences:
            at = 0
            for s in sequence:
                self.counts[at][s] += 1
                if s not in self.next[at]:
                    self.next[at][s] = len(self.next)
                    self.next.append({})
                    self.counts.append(np.zeros(width, "i8"))
                at = self.next[at][s]
            self.counts[at][END] += 1

    def compatible(self, a: int, b: int, bound: float) -> bool:
        """Whether the futures of two states may have the same chances, by Hoeffding's bound at every state reached."""
        open_ = [(a, b)]
        while open_:
            a, b = open_.pop()
            x, y = self.counts[a], self.counts[b]
            n, m = x.sum(), y.sum()
            if not n or not m:
                continue
            if (np.abs(x / n - y / m) > bound * (n**-0.5 + m**-0.5)).any():
                return False
            open_ += [(self.next[a][s], self.next[b][s]) for s in self.next[b] if s in self.next[a]]
        return True

    def fold(self, red: int, blue: int) -> None:
        """Add all that comes after blue to red."""
        open_ = [(red, blue)]
        while open_:
            a, b = open_.pop()
            self.counts[a] = self.counts[a] + self.counts[b]
            for s, to in self.next[b].items():
                if s in self.next[a]:
                    open_.append((self.next[a][s], to))
                else:
                    self.next[a][s] = to


class Automaton:
    """Logarithms of chances by state and symbol, and the state after it; state 0 is the first, the last knows nothing."""

    def __init__(self, moves: np.ndarray, chances: np.ndarray, prefixes: dict[str, int]) -> None:
        self.moves, self.chances, self.prefixes = moves, chances, prefixes
        self.least, self.shortest = -np.inf, 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        """Logarithm of each text's chance, all texts of a length at once, one symbol after the other."""
        out = np.zeros(len(texts))
        coded = [symbols(t, self.prefixes) for t in texts]
        lengths = np.array([len(c) for c in coded])
        for length in np.unique(lengths):
            which = np.flatnonzero(lengths == length)
            grid = np.array([coded[i] for i in which], "i4").reshape(len(which), length).T
            state, total = np.zeros(len(which), "i8"), np.zeros(len(which))
            for s in grid:
                total += self.chances[state, s]
                state = self.moves[state, s]
            out[which] = total + self.chances[state, END]
        return out


def common_prefixes(texts: list[str], share: float = PREFIX_SHARE) -> dict[str, int]:
    """Prefixes that at least ENOUGH texts and this share of them have, as symbols beyond the classes."""
    seen: dict[str, int] = {}
    for t in texts:
        if len(t) > PREFIX:
            seen[t[:PREFIX]] = seen.get(t[:PREFIX], 0) + 1
    return {p: END + 1 + i for i, p in enumerate(sorted(p for p, n in seen.items() if n >= max(ENOUGH, share * len(texts))))}


def infer(texts: list[str], alpha: float = ALPHA) -> Automaton:
    """An automaton of texts: a prefix tree's states are taken breadth-first, and each is merged with the first accepted one
    that it may equal, else accepted itself."""
    prefixes = common_prefixes(texts)
    width = END + 1 + len(prefixes)
    tree = Tree([symbols(t, prefixes) for t in sorted(texts)], width)
    bound = (0.5 * np.log(2 / alpha)) ** 0.5
    red, blue = [0], [(0, s) for s in sorted(tree.next[0])]
    while blue:
        parent, s = blue.pop(0)
        state = tree.next[parent][s]
        if state in red:
            continue
        into = next((r for r in red if tree.compatible(r, state, bound)), None)
        if into is None:
            red.append(state)
            into = state
        else:
            tree.next[parent][s] = into
            tree.fold(into, state)
        # a merge may give accepted states futures that no one has looked at
        blue = sorted({(r, x) for r in red for x, to in tree.next[r].items() if to not in red}, key=lambda e: (red.index(e[0]), e[1]))
    number = {r: i for i, r in enumerate(red)}
    moves = np.full((len(red) + 1, width), len(red))
    counts = np.ones((len(red) + 1, width)) * 0.05
    for r, i in number.items():
        counts[i] += tree.counts[r]
        for s, to in tree.next[r].items():
            moves[i, s] = number[to]
    chances = np.log(counts / counts.sum(1, keepdims=True))
    chances[:, :END] -= SIZES
    return Automaton(moves, chances, prefixes)


class Formats:
    """Automata of the kinds of credentials, and of ordinary runs."""

    def __init__(self, credentials: dict[str, list[str]], ordinary: list[str], margin: float = MARGIN) -> None:
        self.margin = margin
        self.kinds = {k: infer(v) for k, v in credentials.items() if len(v) >= ENOUGH}
        # credentials that no rule names are among the runs; those that begin like known ones aren't taken for ordinary
        known = {p for a in self.kinds.values() for p in a.prefixes}
        ordinary = [t for t in ordinary if t[:PREFIX] not in known]
        self.ordinary = infer(ordinary) if ordinary else infer(["".join(c[0] for c in CLASSES)])
        for k, automaton in self.kinds.items():
            size = np.array([len(t) + 1 for t in credentials[k]])
            automaton.least = float(np.quantile(automaton.scores(credentials[k]) / size, ATYPICAL))
            automaton.shortest = float(np.quantile(size, ATYPICAL))

    def secrets(self, texts: list[str]) -> np.ndarray:
        """Whether each run is formed like a credential."""
        out = np.zeros(len(texts), bool)
        if not texts or not self.kinds:
            return out
        plain, size = self.ordinary.scores(texts), np.array([len(t) + 1 for t in texts])
        for automaton in self.kinds.values():
            score = automaton.scores(texts)
            out |= (score - plain >= self.margin) & (score / size >= automaton.least) & (size >= automaton.shortest)
        return out


def lowest(rows: DataFrame, most: int) -> list[str]:
    """value of at most so many rows (value, h), those with the lowest hashes. Where there are many more, tasks leave out
    hashes that can hardly be among them, so that the driver doesn't get as many from every task."""
    n = rows.count()
    if n > 2 * most:
        rows = rows.where(F.col("h") < -(1 << 63) + int((1 << 64) * 1.5 * most / n))
    return [r["value"] for r in rows.orderBy("h", "value").limit(most).collect()]


def learn(found: DataFrame, sample: int = SAMPLE, ordinary: int = ORDINARY) -> Formats:
    """Automata from at most `sample` distinct credentials of each kind, and `ordinary` other runs as often as they occur,
    chosen by hash, of which the first SAMPLED_LENGTH characters count."""
    begin = lambda c: F.substring(c, 1, SAMPLED_LENGTH).alias("value")
    known = found.select(F.explode("known").alias("k")).select(F.col("k.kind").alias("kind"), begin("k.value"))
    credentials = {}
    for k, name in enumerate(KINDS):
        own = known.where(F.col("kind") == k).select("value").distinct()
        credentials[name] = lowest(own.withColumn("h", F.xxhash64("value")), sample)
    runs = found.select("doc_id", F.explode("runs").alias("r")).select(begin("r.value"), F.xxhash64("doc_id", "r.start", "r.value").alias("h"))
    return Formats(credentials, lowest(runs, ordinary))


def with_formats(found: DataFrame, formats: Formats) -> DataFrame:
    """scanned() with spans: those of the rules and those that automata add, by start, then kind."""
    shared = found.sparkSession.sparkContext.broadcast(formats)  # a few states for each kind
    names = [*KINDS, LEARNED]
    fields = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch["runs"].to_pylist()
            texts = sorted({r["value"] for doc in runs for r in doc})
            secret = {t for t, yes in zip(texts, shared.value.secrets(texts)) if yes}
            spans = []
            for known, doc in zip(batch["known"].to_pylist(), runs):
                all_ = [(s["start"], s["kind"], s["stop"]) for s in known] + [(r["start"], len(KINDS), r["start"] + len(r["value"])) for r in doc if r["value"] in secret]
                spans.append(joined([(s, names[k], e) for s, k, e in sorted(all_)]))
            yield pa.RecordBatch.from_arrays([*[batch[f] for f in fields], pa.array(spans, pa.string())], names=[*fields, "spans"])

    kinds = dict(found.dtypes)
    return found.select(*fields, "known", "runs").mapInArrow(run, ", ".join(f"{f} {kinds[f]}" for f in fields) + ", spans string")


def scan(documents: DataFrame, sample: int = SAMPLE, ordinary: int = ORDINARY) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document; see scanned()."""
    found = common.cut(scanned(documents))
    return with_formats(found, learn(found, sample, ordinary))


def redacted(documents: DataFrame, spans: DataFrame, mask: str = "[secret]") -> DataFrame:
    """doc_id, text of documents (one row for each id) with the spans of scan() replaced."""

    @F.pandas_udf("string")
    def replace(texts, found):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for text, spans in zip(texts, found):
            parts, at = [], 0
            for span in (spans or "").split(",") if spans else []:
                start, stop = map(int, span.split(":")[1:])
                if stop > at:
                    parts += [text[at : max(start, at)], mask] if start >= at else []
                    at = stop
            out.append(None if text is None else "".join(parts) + text[at:])
        return pd.Series(out)

    both = common.documents_only(documents, "doc_id", "text").join(spans.select(F.col("doc_id").alias("_id"), "spans"), F.col("doc_id").eqNullSafe(F.col("_id")))
    return both.select("doc_id", replace("text", "spans").alias("text"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.read_table(spark, sf_dir, "documents"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op13_secret_scan counts, which SQL can check."""
    return scanned(common.read_table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {"op13_secret_scan": op13_secret_scan, "secret_counts": secret_counts}

ORACLE_SQL = {
    "secret_counts": rf"""
SELECT doc_id,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '{KINDS["assign"].replace("'", "''")}', 2, 'i'), lambda x: length(x) >= 12)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '{KINDS["access"]}'), lambda x: length(x) >= 18)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '{KINDS["hex"]}'), lambda x: length(x) >= 16)) AS BIGINT) AS n_hex
FROM documents"""
}
