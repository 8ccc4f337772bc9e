"""Conversation structure repair: the cheapest edits that make a conversation alternate, by dynamic programs over tensors.

A conversation is right if its roles' initials are (s?(ua)+)?. Rows are kept, given another role, deleted or inserted. In
four states (nothing yet, after s, after u, after a) the cheapest way to the end is worked out from the last turn to the
first for all conversations of a length at once (arrays of turn x conversation x state), and edits are traced forwards the
same way. Rows are range-sorted by conversation and turn, without their texts; a conversation that goes over the end of a
partition is joined by its parts' tables of cost from state to state, two parts a partition at most. Texts are shuffled
once, to where a conversation's edits pass in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RIGHT = "(s?(ua)+)?"
START, AFTER_S, AFTER_U, AFTER_A = range(4)
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
INFINITE = 1 << 50
#: The state after a user or assistant turn is put in, whichever may come there.
NEXT = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])
#: The state after a row with this initial (s, u, a, other) is kept; 4: it can't be.
KEPT = np.array([[AFTER_S, 4, 4, 4], [AFTER_U, AFTER_U, 4, AFTER_U], [4, 4, AFTER_A, 4], [4, 4, 4, 4]])
#: Whether initials may stand side by side: su, ua, au.
LEGAL = np.array([[0, 1, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 0]], bool)
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Rows of a partition, and rows that a block of a long conversation has in a tensor.
ROWS, BLOCK = 100_000, 1024
WHITE = r"[\x20\x09-\x0D]"
KEY = ["conv_id", "turn", "role", "digest"]


# faults


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(conv_id:turn) % 20: 0 drops the row, 1 empties its text, 2 removes
    its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    plain = common.documents_only(conversations, "conv_id", "turn", "role", "text")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = plain.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("_time")).drop("_time")


def plain_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the text's digest; a null role or text counts as one space."""
    one = common.documents_only(rows, "conv_id", "turn", "role", "text").na.fill(" ", ["role", "text"])
    return one.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def findings(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, n, initial, fault: a row for all that are equal in the first four, n of them; fault is
    that of the first, the others are duplicates, or blank like it.

    Turns are in order, null ones first; rows of one turn by role and digest.
    """
    ending = F.regexp_extract("text", rf"([^\x20\x09-\x0D]){WHITE}*\z", 1)
    fault = F.when(ending == "", BLANK).when(~ending.isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    found = plain_rows(rows).groupBy(*KEY).agg(F.count("*").alias("n"), F.first(fault).alias("fault"))
    initial = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("s", 0, "u", 1, "a", 2)]), F.substring("role", 1, 1)), F.lit(3))
    found = common.cut(found.withColumn("initial", initial.cast("int")))
    order = F.struct(F.col("turn").isNotNull(), "turn")
    again = found.where(F.col("fault") != BLANK).groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first")
    joined = found.join(again, same("conv_id", "_conv") & same("role", "_role") & same("digest", "_digest"), "left")
    later = (F.col("fault") != BLANK) & F.coalesce(order > F.col("first"), F.lit(False))
    return joined.select(*KEY, "n", "initial", F.when(later, DUPLICATE).otherwise(F.col("fault")).cast("int").alias("fault"))


def laid_out(found: DataFrame, rows: int = ROWS) -> DataFrame:
    """findings range-sorted by conversation and turn, with the number of their partition."""
    n = max(1, -(-found.count() // rows))
    order = [F.asc_nulls_first(c) for c in KEY]
    return common.cut(found.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))


# tensors: turn x conversation (x state)


def closed(costs: np.ndarray) -> np.ndarray:
    """Costs by state where turns may be put in before what follows; two are enough, a third leads back."""
    for _ in range(2):
        costs = np.minimum(costs, costs[:, NEXT] + INSERT)
    return costs


END = closed(np.array([[0, INFINITE, INFINITE, 0]]))[0]


def backward(initial: np.ndarray, fault: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Cheapest costs to the end by turn (one more than there are), conversation and state. end: conversation x state."""
    turns, n = initial.shape
    costs = np.empty((turns + 1, n, 4), "i8")
    costs[turns] = end
    for t in range(turns - 1, -1, -1):
        after = costs[t + 1]
        extra = np.where(fault[t] == TRUNCATED, LEFT_TRUNCATED, 0)[:, None]
        forced = ((fault[t] == BLANK) | (fault[t] == DUPLICATE))[:, None]
        keep = np.take_along_axis(np.concatenate([after, np.full((n, 1), INFINITE)], 1), KEPT[initial[t]], 1)
        stay = np.minimum(keep, after[:, NEXT] + REROLE) + extra
        costs[t] = closed(np.minimum(after + DELETE, np.where(forced, INFINITE, stay)))
    return costs


def trace(initial: np.ndarray, fault: np.ndarray, costs: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """inserts before each turn (one more than there are) and action by turn and conversation, and the states they end in:
    of the cheapest edits those whose initials are ASCII-least. last: whether the conversation ends here."""
    turns, n = initial.shape
    each, state = np.arange(n), state.copy()
    inserts, actions = np.zeros((turns + 1, n), "i1"), np.zeros((turns, n), "u1")
    for t in range(turns):
        after, open_ = costs[t + 1], np.ones(n, bool)
        while open_.any():
            now = costs[t][each, state]
            delete = open_ & (after[each, state] + DELETE == now)
            insert = open_ & ~delete & (costs[t][each, NEXT[state]] + INSERT == now)
            to = KEPT[initial[t], state]
            extra = np.where(fault[t] == TRUNCATED, LEFT_TRUNCATED, 0)
            keep = open_ & ~delete & ~insert & (to < 4) & (after[each, np.minimum(to, 3)] + extra == now)
            rerole = open_ & ~delete & ~insert & ~keep
            actions[t][delete], actions[t][keep], actions[t][rerole] = ord("D"), ord("K"), ord("R")
            inserts[t] += insert
            state = np.where(insert | rerole, NEXT[state], np.where(keep, to, state))
            open_ = insert
    while (more := last & ((state == AFTER_S) | (state == AFTER_U))).any():
        inserts[turns] += more
        state = np.where(more, NEXT[state], state)
    return inserts, actions, state


def blocks(starts: np.ndarray, stops: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row, length and segment of blocks of at most `block` rows of each segment, in order."""
    n = -(-(stops - starts) // block)
    segment = np.repeat(np.arange(len(starts)), n)
    nth = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
    first = starts[segment] + nth * block
    return first, np.minimum(block, stops[segment] - first), segment


def by_length(lengths: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket of blocks of one length, of at most so many rows (or one block)."""
    for length in np.unique(lengths):
        same_length = np.flatnonzero(lengths == length)
        step = max(1, most // int(length))
        for at in range(0, len(same_length), step):
            yield int(length), same_length[at : at + step]


def tables(initial: np.ndarray, fault: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each block, the cheapest cost from a state before it to a state after it."""
    out = np.empty((len(first), 4, 4), "i8")
    for length, which in by_length(lengths):
        rows = first[which] + np.arange(length)[:, None]
        for e in range(4):
            end = np.full((len(which), 4), INFINITE)
            end[:, e] = 0
            out[which, :, e] = backward(initial[rows], fault[rows], end)[0]
    return out


def joined(table: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs by state before a block, from those after it."""
    return np.minimum((table + after[None, :]).min(1), INFINITE)


class Segments:
    """The conversations of one partition, by the rows where each begins and stops."""

    def __init__(self, rows: pa.Table, block: int = BLOCK) -> None:
        self.block = block
        self.initial, self.fault = rows["initial"].to_numpy().astype("i1"), rows["fault"].to_numpy().astype("i1")
        ids = rows["conv_id"].to_pylist()
        new = np.array([i == 0 or ids[i] != ids[i - 1] for i in range(len(ids))], bool)
        self.starts = np.flatnonzero(new)
        self.stops = np.append(self.starts[1:], len(ids))
        self.ids = [ids[i] for i in self.starts]

    def ends(self) -> list[int]:
        """The segments that may go on in other partitions: the first and the last."""
        return sorted({0, len(self.ids) - 1})

    def table(self, segment: int) -> np.ndarray:
        first, lengths, _ = blocks(self.starts[segment : segment + 1], self.stops[segment : segment + 1], self.block)
        each = tables(self.initial, self.fault, first, lengths)
        whole = each[-1]
        for t in each[-2::-1]:
            whole = np.stack([joined(t, whole[:, e]) for e in range(4)], 1)
        return whole

    def solve(self, end: np.ndarray, state: np.ndarray, last: np.ndarray, only: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """inserts before each row, action of each row, inserts after each segment, its cost and the state it ends in.
        By segment, end: costs by state after it; state: before it; last: whether its conversation ends there."""
        chosen = np.arange(len(self.ids)) if only is None else np.array(only)
        first, lengths, of = blocks(self.starts[chosen], self.stops[chosen], self.block)
        of = chosen[of]
        final = np.append(of[1:] != of[:-1], True)
        after = np.where(final[:, None], end[of], 0)
        long = np.flatnonzero(np.isin(of, of[~final]))
        if len(long):
            each = dict(zip(long, tables(self.initial, self.fault, first[long], lengths[long])))
            for b in long[::-1]:
                if not final[b]:
                    after[b] = joined(each[b + 1], after[b + 1])
        inserts, actions = np.zeros(len(self.initial), "i1"), np.zeros(len(self.initial), "u1")
        tail, cost, left = np.zeros(len(self.ids), "i1"), np.zeros(len(self.ids), "i8"), state.copy()
        # blocks of a segment follow each other: the first of each at once, then the second of each, and so on
        nth = np.arange(len(of)) - np.repeat(np.flatnonzero(np.append(True, final[:-1])), np.diff(np.append(np.flatnonzero(np.append(True, final[:-1])), len(of))))
        for k in range(int(nth.max(initial=-1)) + 1):
            now = np.flatnonzero(nth == k)
            for length, which in by_length(lengths[now]):
                b = now[which]
                rows = first[b] + np.arange(length)[:, None]
                costs = backward(self.initial[rows], self.fault[rows], after[b])
                entered = left[of[b]]
                put, did, out = trace(self.initial[rows], self.fault[rows], costs, entered, last[of[b]] & final[b])
                inserts[rows], actions[rows] = put[:-1], did
                tail[of[b]] = put[-1]
                cost[of[b]] += costs[0][np.arange(len(b)), entered] - np.where(last[of[b]] & final[b], 0, after[b][np.arange(len(b)), out])
                left[of[b]] = out
        return inserts, actions, tail, cost, left


def gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """A partition's findings, without texts; ROWS or so, as range partitions are."""
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept) if kept else None


def parts_over_ends(state: DataFrame, block: int = BLOCK) -> dict[tuple[int, int], dict]:
    """By (partition, segment), of conversations that lie in several partitions: costs after the part, the state before
    it, whether it is the last, and the initial of the row before it. Two parts a partition at most, so the driver joins them."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (rows := gathered(batches)) is not None:
            own = Segments(rows, block)
            pid = rows["pid"][0].as_py()
            for s in own.ends():
                table = own.table(s).reshape(-1).tolist()
                at = pa.array([own.ids[s]], rows.schema.field("conv_id").type)
                yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([s], pa.int32()), at, pa.array([table], pa.list_(pa.int64())), pa.array([int(own.initial[own.starts[s]])], pa.int32()), pa.array([int(own.initial[own.stops[s] - 1])], pa.int32())], names=["pid", "segment", "conv_id", "costs", "head", "foot"])

    kind = dict(state.dtypes)["conv_id"]
    got = sorted(state.mapInArrow(ends, f"pid int, segment int, conv_id {kind}, costs array<long>, head int, foot int").collect(), key=lambda r: (r["pid"], r["segment"]))
    chains, chain = [], got[:1]
    for a, b in zip(got, got[1:]):
        if a["conv_id"] == b["conv_id"] and a["pid"] != b["pid"]:
            chain.append(b)
        else:
            chains.append(chain)
            chain = [b]
    chains = [c for c in [*chains, chain] if len(c) > 1]
    info: dict[tuple[int, int], dict] = {}
    for chain in chains:
        end = END
        for i in range(len(chain) - 1, -1, -1):
            info[chain[i]["pid"], chain[i]["segment"]] = {"end": end, "last": i == len(chain) - 1, "before": chain[i - 1]["foot"] if i else None}
            end = joined(np.array(chain[i]["costs"]).reshape(4, 4), end)
    if not chains:
        return info
    shared = state.sparkSession.sparkContext.broadcast(info)  # two entries a partition at most

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (rows := gathered(batches)) is not None:
            own, pid, found = Segments(rows, block), rows["pid"][0].as_py(), []
            for s in own.ends():
                if (pid, s) in shared.value:
                    at = shared.value[pid, s]
                    n = len(own.ids)
                    end, last = np.tile(at["end"], (n, 1)), np.full(n, at["last"])
                    found.append((s, [int(own.solve(end, np.full(n, q), last, [s])[4][s]) for q in range(4)]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([pid] * len(found), pa.int32()), pa.array([s for s, _ in found], pa.int32()), pa.array([x for _, x in found], pa.list_(pa.int32()))], names=["pid", "segment", "exits"])

    to = {(r["pid"], r["segment"]): r["exits"] for r in state.mapInArrow(exits, "pid int, segment int, exits array<int>").collect()}
    for chain in chains:
        q = START
        for part in chain:
            info[part["pid"], part["segment"]]["state"] = q
            q = to[part["pid"], part["segment"]][q]
    return info


# plans


def planned(state: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each of laid_out's rows: inserts, extra, action, after (turns put in before it, its copies, what is done with
    it, turns put in at the conversation's end), nth (of its conversation's parts) and, at the part's first row, cost and
    illegal of the whole part."""
    shared = state.sparkSession.sparkContext.broadcast(parts_over_ends(state, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = gathered(batches)
        if rows is None:
            return
        own, pid = Segments(rows, block), rows["pid"][0].as_py()
        n = len(own.ids)
        end, begin, last, before = np.tile(END, (n, 1)), np.zeros(n, "i8"), np.ones(n, bool), [None] * n
        for s in own.ends():
            if at := shared.value.get((pid, s)):
                end[s], begin[s], last[s], before[s] = at["end"], at["state"], at["last"], at["before"]
        inserts, actions, tail, cost, _ = own.solve(end, begin, last)
        copies = rows["n"].to_numpy() - 1
        bad = np.append(False, ~LEGAL[own.initial[:-1], own.initial[1:]])
        bad[own.starts] = [b is not None and not LEGAL[b, own.initial[i]] for b, i in zip(before, own.starts)]
        illegal = np.add.reduceat(bad + np.where(LEGAL[own.initial, own.initial], 0, copies), own.starts)
        cost = cost + DELETE * np.add.reduceat(copies, own.starts)
        at_first, at_last = np.zeros((2, len(rows)), "i8"), np.zeros(len(rows), "i1")
        at_first[0, own.starts], at_first[1, own.starts], at_last[own.stops - 1] = cost, illegal, tail
        out = rows.select([*KEY, "n", "fault", "pid"]).append_column("inserts", pa.array(inserts)).append_column("action", pa.array(actions.view("S1").astype("U1")))
        out = out.append_column("after", pa.array(at_last)).append_column("cost", pa.array(at_first[0])).append_column("illegal", pa.array(at_first[1]))
        yield from out.to_batches(max_chunksize=10_000)

    kinds = dict(state.dtypes)
    return state.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in KEY) + ", n long, fault int, pid int, inserts byte, action string, after byte, cost long, illegal long")


def summaries(plan: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation that has rows.

    The edits' initials are put together within partitions first; an audit has a letter for each row, so only a
    conversation's own letters meet."""
    faults = {name: F.sum(F.when(F.col("fault") == k, F.col("n") if k == BLANK else F.lit(1)).otherwise(0)) for name, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
    faults["duplicate"] = faults["duplicate"] + F.sum(F.when(F.col("fault") != BLANK, F.col("n") - 1).otherwise(0))

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have, pid = None, None, 0

        def row(kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([pid], pa.int32()), pa.array(["".join(have)])], names=["conv_id", "pid", "letters"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, p, put, act, n, after in zip(*(batch[c].to_pylist() for c in ("conv_id", "pid", "inserts", "action", "n", "after"))):
                if now is None or conv != now[0]:
                    if now is not None:
                        yield row(kind)
                    now, have = (conv,), []
                pid = p
                have.append("I" * put + act + "D" * (n - 1) + "I" * after)
        if now is not None:
            yield row(kind)

    kind = dict(plan.dtypes)["conv_id"]
    pieces = plan.select("conv_id", "pid", "inserts", "action", "n", "after").mapInArrow(letters, f"conv_id {kind}, pid int, letters string")
    audit = pieces.groupBy("conv_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pid", "letters"))), lambda x: x["letters"])).alias("audit"))
    numbers = plan.groupBy("conv_id").agg(*[v.cast("long").alias(k) for k, v in faults.items()], F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    wide = F.col("turn").cast("decimal(20,0)")
    gaps = plan.groupBy("conv_id").agg(F.coalesce(F.max(wide) - F.min(wide) + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    out = numbers
    for more in (audit, gaps):
        out = out.join(more.withColumnRenamed("conv_id", "_conv"), same("conv_id", "_conv")).drop("_conv")
    return out


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """conv_id, n (from 0), role, text and edit (K, R or I) of every repaired conversation's turns.

    Edits and texts meet by conversation, sorted by turn, and pass through one by one: nothing is gathered, however long a
    conversation is. Each conversation's turns come out together and in order.
    """
    edits = plan.where("action <> 'D' or inserts > 0 or after > 0").select(*KEY, F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), "inserts", "action", "after")
    texts = plain_rows(rows).select(*KEY, F.lit(1).alias("kind"), "text", *[F.lit(None).cast(t).alias(c) for c, t in (("inserts", "byte"), ("action", "string"), ("after", "byte"))])
    order = [F.asc_nulls_first(c) for c in (*KEY, "kind")]
    met = edits.unionByName(texts).repartition(F.col("conv_id")).sortWithinPartitions(*order)
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, user, n = None, True, 0
        edit = waiting = None
        for batch in batches:
            out: list[tuple] = []

            def add(role: str, text: str, letter: str) -> None:
                nonlocal n, user
                out.append((now[0], n, role, text, letter))
                n, user = n + 1, not role.startswith("u")

            for conv, turn, role, digest, tag, text, put, act, after in zip(*(batch[c].to_pylist() for c in (*KEY, "kind", "text", "inserts", "action", "after"))):
                if now is None or conv != now[0]:
                    now, user, n = (conv,), True, 0
                if tag == 0:
                    for _ in range(put):
                        add("user" if user else "assistant", "", "I")
                    edit, waiting = (act, after), (turn, role, digest)
                    if act == "D":
                        edit, waiting = None, None
                        for _ in range(after):
                            add("user" if user else "assistant", "", "I")
                elif waiting == (turn, role, digest):  # the first of equal rows; the others are duplicates
                    if edit[0] == "K":
                        add(role, text, "K")
                    else:
                        add("user" if user else "assistant", text, "R")
                    for _ in range(edit[1]):
                        add("user" if user else "assistant", "", "I")
                    edit = waiting = None
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("conv_id").type), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.string()) for c in columns[2:]]], names=["conv_id", "n", "role", "text", "edit"])

    return met.mapInArrow(run, f"conv_id {kind}, n long, role string, text string, edit string")


def repair(rows: DataFrame, per_partition: int = ROWS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The edits of every row (planned) and the repaired conversations' turns (repaired).

    A null conv_id is a conversation of its own; null turns come first; a null role or text is one space; repeated rows
    are duplicates, blank ones blank; an empty table gives empty results; extra columns are left out. Texts of any length
    are read whole, a conversation of any length is repaired as one.
    """
    plan = common.cut(planned(laid_out(findings(rows), per_partition), block))
    return plan, repaired(rows, plan)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and sha256 of role:text, newline-joined, of turns that come by conversation and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text"))):
                fresh = now is None or conv != now[0]
                if fresh:
                    if now is not None:
                        done.append((now[0], digest.hexdigest()))
                    now, digest = (conv,), hashlib.sha256()
                digest.update(f"{'' if fresh else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([d for _, d in done])], names=["conv_id", "sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([digest.hexdigest()])], names=["conv_id", "sha256"])

    return turns.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {dict(turns.dtypes)['conv_id']}, sha256 string")


NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def report(conversations: DataFrame, rows: DataFrame, per_partition: int = ROWS, block: int = BLOCK) -> DataFrame:
    """conv_id of every conversation, what was found in rows and done, and the hash of what came of it."""
    plan, turns = repair(rows, per_partition, block)
    every = conversations.select(F.col("conv_id").alias("_id")).distinct()
    found = every.join(summaries(plan), same("_id", "conv_id"), "left").drop("conv_id")
    found = found.join(digests(turns), same("_id", "conv_id"), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in NUMBERS]
    return found.select(F.col("_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = common.read_table(spark, sf_dir, "conversations")
    return report(given, damaged(given))


def repair_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op11_conversation_repair finds before it repairs, which SQL can check."""
    return op11_conversation_repair(spark, sf_dir).select("conv_id", *NUMBERS[:-1])


QUERIES = {"op11_conversation_repair": op11_conversation_repair, "repair_findings": repair_findings}

#: CRC-32 of a text of ASCII characters, bit by bit, in DuckDB.
CRC32 = """xor(list_reduce(list_transform(string_split({}, ''), lambda c: CAST(ascii(c) AS UBIGINT)), lambda crc, b:
  list_reduce([CAST(0 AS UBIGINT), 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS UBIGINT) ELSE CAST(0 AS UBIGINT) END), xor(crc, b)), CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT))"""

ORACLE_SQL = {
    "repair_findings": rf"""
WITH d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place FROM conversations),
k AS (SELECT *, {CRC32.format("place")} % 20 AS k FROM d),
r AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS c FROM k WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, c) AS n FROM r),
f AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS again, regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS ending,
  lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] AS pair FROM o)
SELECT i.conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (ending = '') AS blank, count(*) FILTER (ending <> '' AND again > 1) AS duplicate,
  count(*) FILTER (ending <> '' AND again = 1 AND ending NOT IN ('.', '!', '?')) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN f ON i.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY i.conv_id"""
}
