"""Grouping different spellings of one entity: lookup first, then a pluggable grouper over chunks of similar values.

A run holds at most a few thousand distinct values, so its document lives on the driver; scans, joins and the grouping
of chunks run on executors.
"""

from __future__ import annotations

import copy
import json
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import conventions, naming
from ..functions.normalize import is_blank_value, normalize_value

CHUNK, BACK = 25, 7
RETRY_WAITS = (0, 1, 4)
ONE_TIME_LIMIT = 20_000


@dataclass(frozen=True)
class Item:
    id: int
    literal: str
    frequency: int = 1
    alias: str | None = None  # from the lookup


@dataclass(frozen=True)
class Group:
    """source: lookup_validated, proposed, self_mapped or failed. confidence: h, m or l."""

    name: str | None
    items: tuple[int, ...]
    confidence: str = "m"
    source: str = "proposed"
    needs_review: bool = False


@dataclass(frozen=True)
class Answer:
    """A grouper's answer for a chunk, by places in it; places it doesn't name become groups of their own."""

    groups: tuple[tuple[tuple[int, ...], str | None, str], ...] = ()
    unassigned: tuple[int, ...] = ()


class Grouper(Protocol):
    """group is sent to executors. merge and rename are optional: merge names groups (by place) that are one entity;
    rename proposes names that conform."""

    def group(self, literals: list[str], known_names: list[str]) -> Answer: ...


class FoldingGrouper:
    """Groups spellings that are equal without case, articles, legal suffixes and punctuation, or whose initials are
    another's letters. Deterministic; needs no service."""

    RULES = {"leading_articles": {"value": "strip"}, "corporate_suffix": {"value": "strip"}, "ampersand": {"value": "spell_out"}, "case": {"value": "lower"}}

    def fold(self, literal: str) -> str:
        words = "".join(c if c.isalnum() else " " for c in conventions.apply_rules(literal, self.RULES) or "").split()
        return " ".join(words) or normalize_value(literal)

    def initials(self, folded: str) -> str | None:
        words = folded.split()
        return "".join(w[0] for w in words) if len(words) > 2 else None

    def group(self, literals: list[str], known_names: list[str]) -> Answer:
        by_fold: dict[str, list[int]] = {}
        for i, literal in enumerate(literals):
            by_fold.setdefault(self.fold(literal), []).append(i)
        short = {f.replace(" ", ""): f for f in by_fold if len(f.split()) <= 3 and len(f.replace(" ", "")) <= 5}
        for fold in [f for f in by_fold if self.initials(f) in short and short[self.initials(f)] != f]:
            by_fold[short[self.initials(fold)]] += by_fold.pop(fold)
        known = {self.fold(n): n for n in known_names}
        return Answer(tuple((tuple(places), known.get(fold), "h" if fold in known else "m") for fold, places in by_fold.items()))


def chunks(items: list[Item], size: int = CHUNK, back: int = BACK) -> list[list[Item]]:
    """Items sorted by key in chunks of at most size; a cut moves back to where the first word changes, if near."""
    ordered = sorted(items, key=lambda i: (normalize_value(i.literal), i.literal))
    head = [normalize_value(i.literal).split(" ")[0] for i in ordered]
    out, at = [], 0
    while at < len(ordered):
        end = min(at + size, len(ordered))
        if end < len(ordered):
            end = next((e for e in range(end, max(at, end - back - 1), -1) if head[e] != head[e - 1]), end)
        out.append(ordered[at:end])
        at = end
    return out


def with_retry(call: Callable, waits: Iterable[float] = RETRY_WAITS, retryable: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep):
    """call(), tried again after each wait while errors may pass."""
    last: Exception | None = None
    for wait in waits:
        if wait:
            sleep(wait)
        try:
            return call()
        except Exception as e:  # noqa: BLE001  a grouper may raise anything
            if not retryable(e):
                raise
            last = e
    raise last


def checked(answer: Answer, chunk: list[Item]) -> tuple[list[Group], list[int]]:
    """Groups and unassigned items of an answer: places outside the chunk are dropped, an item's first place counts, and
    items the answer leaves out become groups of their own."""
    seen: set[int] = set()
    groups = []
    for places, name, letter in answer.groups:
        ids = tuple(chunk[p].id for p in dict.fromkeys(places) if isinstance(p, int) and 0 <= p < len(chunk) and p not in seen)
        seen |= {p for p in places if isinstance(p, int)}
        if ids:
            groups.append(Group(naming.proposed_name(name), ids, letter if letter in naming.CONFIDENCE else naming.band(naming.UNKNOWN_CONFIDENCE)))
    loose = [p for p in answer.unassigned if isinstance(p, int) and 0 <= p < len(chunk) and p not in seen]
    seen |= set(loose)
    left = [Group(None, (chunk[p].id,), "l") for p in range(len(chunk)) if p not in seen]
    return groups + left, [chunk[p].id for p in loose]


def group_chunks(spark, parts: list[list[Item]], grouper: Grouper, known_names: list[str]) -> tuple[list[Group], list[int], list[int]]:
    """Groups, unassigned and failed items of all chunks. Chunks are asked from executors, no more at a time than the
    grouper's concurrency, if it has one; what they used is added to its usage. All failed: RuntimeError."""
    if not parts:
        return [], [], []
    rows = [(c, p, item.literal) for c, part in enumerate(parts) for p, item in enumerate(part)]

    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        literals = list(pdf.sort_values("place")["literal"])
        own = copy.copy(grouper)
        own.usage = None if not hasattr(grouper, "usage") else type(grouper.usage)()
        try:
            # a grouper that tells passing errors apart waits by itself
            got = own.group(literals, known_names) if hasattr(own, "ask") else with_retry(lambda: own.group(literals, known_names))
            text = json.dumps({"g": [[list(p), n, c] for p, n, c in got.groups], "u": list(got.unassigned)})
        except Exception as e:  # noqa: BLE001
            text = json.dumps({"error": str(e)})
        return pd.DataFrame({"chunk": [key[0]], "answer": [text], "usage": [list(own.usage.values()) if own.usage is not None else []]})

    tasks = min(len(parts), getattr(grouper, "concurrency", len(parts)))
    table = spark.createDataFrame(rows, "chunk int, place int, literal string").repartition(tasks, "chunk")
    got_rows = table.groupBy("chunk").applyInPandas(answer, "chunk int, answer string, usage array<long>").collect()
    answers = {r["chunk"]: json.loads(r["answer"]) for r in got_rows}
    for r in got_rows:  # of each chunk's task that counted, whatever was tried again
        if r["usage"]:
            grouper.usage += type(grouper.usage)(*r["usage"])
    groups, loose, failed = [], [], []
    for c, part in enumerate(parts):
        got = answers[c]
        if "error" in got:
            failed += [i.id for i in part]
            continue
        some, free = checked(Answer(tuple((tuple(p), n, l) for p, n, l in got["g"]), tuple(got["u"])), part)
        groups, loose = groups + some, loose + free
    if len(failed) == sum(map(len, parts)):
        raise RuntimeError(f"no chunk could be grouped: {answers[0].get('error')}")
    return groups, loose, failed


def fold_name(name: str) -> str:
    return " ".join(name.lower().split())


def merged_by_name(groups: list[Group]) -> list[Group]:
    """Groups whose names differ in case and spaces alone become one, named as the largest; unnamed ones stay."""
    same: dict[str, list[Group]] = {}
    for g in groups:
        if g.name:
            same.setdefault(fold_name(g.name), []).append(g)
    out = [g for g in groups if not g.name]
    for some in same.values():
        largest = max(some, key=lambda g: len(g.items))
        worst = max((g.confidence for g in some), key="hml".index)
        out.append(replace(largest, items=tuple(i for g in some for i in g.items), confidence=worst))
    return out


def apply_merges(groups: list[Group], merges: list[tuple[list[int], str | None]]) -> list[Group]:
    """Groups merged by a plan of places and names: places must exist, be distinct and not be used before."""
    used: set[int] = set()
    out = []
    for places, name in merges:
        ok = [p for p in dict.fromkeys(places) if isinstance(p, int) and 0 <= p < len(groups) and p not in used]
        if len(ok) < 2:
            continue
        used |= set(ok)
        some = [groups[p] for p in ok]
        out.append(replace(some[0], name=naming.proposed_name(name) or next((g.name for g in some if g.name), None), items=tuple(i for g in some for i in g.items), confidence=max((g.confidence for g in some), key="hml".index)))
    return [g for p, g in enumerate(groups) if p not in used] + out


def diverse(literals: list[str]) -> list[str]:
    """Up to three as they are; of more, the shortest, the one with most kinds of characters that the other two lack, and
    the longest."""
    if len(literals) <= 3:
        return list(literals)
    ordered = sorted(literals, key=lambda x: (len(x), x))
    shortest, longest, seen = ordered[0], ordered[-1], set((ordered[0] + ordered[-1]).lower())
    rest = [x for x in ordered if x not in (shortest, longest)]
    return [shortest, *([max(rest, key=lambda x: len(set(x.lower()) - seen))] if rest else []), longest]


def conforming(groups: list[Group], rules: dict | None, grouper, rounds: int = 2) -> tuple[list[Group], list[int]]:
    """Names rewritten by the rules; what still breaks them is renamed by the grouper if it can, else the group's items
    become unassigned."""
    out, loose = [], []
    for g in groups:
        name = conventions.apply_rules(g.name, rules) if g.name else g.name
        for _ in range(rounds):
            problems = conventions.violations(name, rules) if g.name else []
            if not problems or not hasattr(grouper, "rename"):
                break
            name = conventions.apply_rules(naming.proposed_name(grouper.rename(name, problems)) or name, rules)
        if g.name and conventions.violations(name, rules):
            loose += g.items
        else:
            out.append(replace(g, name=name))
    return out, loose


def best_name(literals: list[str]) -> str:
    """For few literals on the driver: as naming.best_names ranks them, without its Spark job, by length where they tie."""
    def words(x: str) -> list[str]:
        return [w for w in "".join(c if c.isalnum() or c in "&-" else " " for c in x).split() if w.lower() not in naming.STOPWORDS]

    counts: dict[str, int] = {}
    for x in literals:
        for w in {w.lower() for w in words(x)}:
            counts[w] = counts.get(w, 0) + 1

    def score(x: str) -> float:
        own = {w.lower() for w in words(x)}
        return sum(counts[w] for w in own) / len(own) if own else 0.0

    return max(literals, key=lambda x: (round(score(x), 9), -len(x), x))


def assemble(groups: list[Group], literals: dict[int, str], rules: dict | None = None) -> list[Group]:
    """Named groups, larger ones first: an item stays in the first, equal names become one, lookup groups absorb others,
    and of two proposed ones the worse confidence stays."""
    placed: set[int] = set()
    by_name: dict[str, Group] = {}
    for g in sorted(groups, key=lambda g: (g.source != "lookup_validated", len(g.items) < 2)):
        ids = tuple(i for i in dict.fromkeys(g.items) if i not in placed)
        if not ids:
            continue
        placed |= set(ids)
        name = g.name or conventions.apply_rules(naming.display_case(best_name([literals[i] for i in ids])), rules) or literals[ids[0]]
        key = normalize_value(name)
        old = by_name.get(key)
        if old is None:
            by_name[key] = replace(g, name=name, items=ids)
        else:
            worse = old.confidence if old.source == "lookup_validated" else naming.worse(old.confidence, g.confidence)
            by_name[key] = replace(old, items=old.items + ids, confidence=worse, needs_review=old.needs_review or g.needs_review)
    return list(by_name.values())


def self_mapped(ids: list[int], literals: dict[int, str], rules: dict | None, source: str) -> list[Group]:
    """Each item a group of its own to be reviewed, under its own spelling."""
    return [Group(conventions.apply_rules(literals[i], rules) or literals[i], (i,), "l", source, True) for i in ids]


@dataclass
class Run:
    """The document of a run. rev counts saves."""

    run_id: int
    spec_id: int | None
    items: list[Item]
    groups: list[Group] = field(default_factory=list)
    status: str = "created"
    rev: int = 0
    changed_at: datetime | None = None

    def literals(self) -> dict[int, str]:
        return {i.id: i.literal for i in self.items}

    def mappings(self) -> list[tuple[str, str]]:
        """(literal, name) of each grouped item, in order."""
        literal = self.literals()
        return [(literal[i], g.name) for g in self.groups for i in g.items]


def run_document(run: Run) -> dict:
    """As JSON values."""
    return asdict(run) | {"changed_at": run.changed_at.isoformat() if run.changed_at else None}


def run_of(d: dict) -> Run:
    groups = [Group(**g | {"items": tuple(g["items"])}) for g in d["groups"]]
    at = datetime.fromisoformat(d["changed_at"]) if d["changed_at"] else None
    return Run(**d | {"items": [Item(**x) for x in d["items"]], "groups": groups, "changed_at": at})


def items_of(values: Iterable[tuple[str, int]], aliases: dict[str, str] | None = None) -> list[Item]:
    """Items numbered from 1, with the lookup's names by key; blanks left out."""
    kept = [(literal, n) for literal, n in values if not is_blank_value(literal)]
    return [Item(i, literal, n, (aliases or {}).get(normalize_value(literal))) for i, (literal, n) in enumerate(kept, 1)]


def auto_group(spark, run: Run, grouper: Grouper, known_names: list[str] = (), rules: dict | None = None, use_lookup: bool = True) -> Run:
    """The run with groups: what the lookup knows under its names; the rest by the grouper in chunks, merged by name,
    made to conform, and what is left under its own spelling, to be reviewed."""
    literals = run.literals()
    hits = [i for i in run.items if use_lookup and i.alias]
    by_alias: dict[str, list[int]] = {}
    for i in hits:
        by_alias.setdefault(i.alias, []).append(i.id)
    groups = [Group(alias, tuple(ids), "h", "lookup_validated") for alias, ids in by_alias.items()]
    rest = [i for i in run.items if not (use_lookup and i.alias)]
    parts = chunks(rest)
    names = list(dict.fromkeys([*by_alias, *known_names]))
    found, loose, failed = group_chunks(spark, parts, grouper, names)
    if len(parts) > 1:
        found = merged_by_name(found)
        if hasattr(grouper, "merge") and len(found) > 1:
            try:
                found = apply_merges(found, grouper.merge([(g.name, diverse([literals[i] for i in g.items])) for g in found]))
            except Exception:  # noqa: BLE001  merging is a bonus
                pass
    found, broken = conforming(found, rules, grouper)
    own = self_mapped(loose + broken, literals, rules, "self_mapped") + self_mapped(failed, literals, rules, "failed")
    return replace(run, groups=assemble(groups + found + own, literals, rules), status="grouped")


def review(run: Run, renames: dict[str, str] | None = None, moves: dict[int, str] | None = None) -> Run:
    """The run after a reviewer renamed groups and moved items (to a name; a new one makes a group). Empty groups go."""
    groups = [replace(g, name=(renames or {}).get(g.name, g.name)) for g in run.groups]
    for item, name in (moves or {}).items():
        groups = [replace(g, items=tuple(i for i in g.items if i != item)) for g in groups]
        at = next((k for k, g in enumerate(groups) if g.name == name), None)
        if at is None:
            groups.append(Group(name, (item,), "h", "reviewed"))
        else:
            groups[at] = replace(groups[at], items=groups[at].items + (item,))
    return replace(run, groups=[g for g in groups if g.items])


def deviations(before: Run, after: Run) -> list[tuple[str, int]]:
    """(case, item): A a looked-up item was moved, B its group was renamed, C an item left a high-confidence group."""
    def place(run: Run) -> dict[int, Group]:
        return {i: g for g in run.groups for i in g.items}

    old, new, out = place(before), place(after), []
    for i, g in old.items():
        now = new.get(i)
        if now is None or now.name == g.name:
            continue
        together = set(now.items) >= set(g.items)
        if g.source == "lookup_validated":
            out.append(("B" if together else "A", i))
        elif g.confidence == "h" and not together:
            out.append(("C", i))
    return out


def review_rows(run: Run) -> list[dict]:
    """What a reviewer sees: each group's literals once, and items without a group as groups of their own to be reviewed."""
    literal, placed = run.literals(), {i for g in run.groups for i in g.items}
    rows = [{"name": g.name, "confidence": g.confidence, "source": g.source, "needs_review": g.needs_review, "literals": list(dict.fromkeys(literal[i] for i in g.items))} for g in run.groups]
    return rows + [{"name": i.literal, "confidence": "l", "source": "ungrouped", "needs_review": True, "literals": [i.literal]} for i in run.items if i.id not in placed]


def numbered_items(items: list[Item]) -> list[Item]:
    """Items whose number is missing (0) or taken get their place, or the next number that is free."""
    used, out = set(), []
    for place, item in enumerate(items, 1):
        number = item.id if item.id and item.id not in used else place
        while number in used:
            number += 1
        used.add(number)
        out.append(replace(item, id=number))
    return out


def premerge(df: DataFrame, name: str) -> DataFrame:
    """Adds folded: the name without differences of case and spaces."""
    return df.withColumn("folded", F.lower(F.regexp_replace(F.trim(F.col(name)), r"\s+", " ")))


def numbered(df: DataFrame, group: str, order: str) -> DataFrame:
    """Adds place, from 1 within each group of a run document."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order)))


def support(df: DataFrame, group: str, confidence: str) -> DataFrame:
    """Mean confidence of each group and its band; missing ones count as unknown."""
    mean = F.avg(F.coalesce(F.col(confidence), F.lit(naming.UNKNOWN_CONFIDENCE)))
    return df.groupBy(group).agg(mean.alias("confidence")).withColumn("band", naming.band_column(F.col("confidence")))
