"""Conversation repair against one that tries every edit, over partitions and blocks of a few rows too."""

import collections
import functools
import hashlib
import random
import re
import zlib

import pytest

from canonry.llm import common, repair

CONV = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\f\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20, one(role), one(text)
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute_edits(rows, faults):
    """The cheapest edits, of equally cheap ones the ASCII-least, by trying all from every state."""

    def accepts(state, initial):
        return {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    @functools.cache
    def best(i, state, put):
        found = []
        if i == len(rows):
            if state in "0a":
                found.append((0, "", ()))
        else:
            role, text = rows[i]
            extra = 5 if faults[i] == "truncated" else 0
            c, a, t = best(i + 1, state, 0)
            found.append((c + 2, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                if to := accepts(state, role[:1]):
                    c, a, t = best(i + 1, to, 0)
                    found.append((c + extra, "K" + a, ((role, text), *t)))
                for new in ("user", "assistant"):
                    if to := accepts(state, new[0]):
                        c, a, t = best(i + 1, to, 0)
                        found.append((c + 1 + extra, "R" + a, ((new, text), *t)))
        if put < 3:
            for new in ("user", "assistant"):
                if to := accepts(state, new[0]):
                    c, a, t = best(i, to, put + 1)
                    found.append((c + 5, "I" + a, ((new, ""), *t)))
        return min(found, default=(10**9, "~", ()))

    return best(0, "0", 0)


def brute(given, rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = set()
    for conv in {r[0] for r in given}:
        own = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            bare = text.strip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, turns = brute_edits(tuple(r[2:] for r in own), tuple(faults))
        text = "\n".join(f"{role}:{text}" for role, text in turns)
        out.add((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def odd_rows(seed=3):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why", "Why?  ", "", " \t", None, "ok.\n", "a ", "x" * 5000 + "."]
    rows = []
    for conv in [None, -4, *range(150)]:
        for turn in range(rng.randint(1, 14)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]) if rng.random() < 0.3 else ("system", "user", "assistant")[0 if turn == 0 else 1 + turn % 2]
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]) if rng.random() < 0.97 else None, role, rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}."))
    rows += [(7000, 1, "user", "again.")] * 9 + [(7001, t, "user" if t % 2 else "assistant", f"{t}." if t % 5 else "cut") for t in range(300)]
    return rows + rows[:20]


def columns(df):
    return {tuple(r[c] for c in ("conv_id", *repair.NUMBERS, "audit", "repaired_sha256")) for r in df.collect()}


@pytest.mark.parametrize(("per_partition", "block"), [(100_000, 1024), (40, 8), (7, 3)])
def test_repair_against_every_edit(spark, per_partition, block):
    rows = odd_rows()
    given = spark.createDataFrame(rows, CONV)
    for name in ("n", "fault", "digest", "pid", "_conv", "letters"):
        given = given.withColumn(name, repair.F.lit("x"))
    got = repair.report(given, repair.damaged(given), per_partition, block)
    assert got.count() == len({r[0] for r in rows})
    assert columns(got) == brute(rows, brute_damage(rows))


def test_query_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in common.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert columns(repair.op11_conversation_repair(spark, sf_dir)) == brute(rows, brute_damage(rows))


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "And?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "Hello."), (2, 1, "user", "cut")], CONV)
    _, turns = repair.repair(rows)
    got = [(r["conv_id"], r["n"], r["role"], r["text"], r["edit"]) for r in turns.orderBy("conv_id", "n").collect()]
    # one of two users goes; a lone assistant and a cut question cost less to delete than to complete
    assert got == [(1, 0, "user", "And?", "K"), (1, 1, "assistant", "Yes.", "K")]


def test_empty(spark):
    none = spark.createDataFrame([], CONV)
    assert repair.report(none, repair.damaged(none)).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(dropped, 0, "user", "Hi.")], CONV)
    assert columns(repair.report(one, repair.damaged(one))) == {(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
