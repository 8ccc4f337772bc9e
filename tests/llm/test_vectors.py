"""Vector codes against Lloyd's rounds from scratch."""

import hashlib
import math
import random

import numpy as np
import pytest

from canonry.llm import vectors

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """One part after the other, all sums anew in every round; integers of any size."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], (r[2] is not None, r[2] or 0)))
    width = len(kept[0][1]) // parts
    of = [[x[p * width : (p + 1) * width] for _, x, _ in kept] for p in range(parts)]
    books = [part[:entries] for part in of]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            chosen = [near(v, books[p])[1] for v in of[p]]
            for k in range(len(books[p])):
                own = [v for v, c in zip(of[p], chosen) if c == k]
                if own:
                    books[p] = [*books[p][:k], [sum(x) // len(own) for x in zip(*own)], *books[p][k + 1 :]]
    found = [[near(v, books[p]) for v in of[p]] for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, [found[p][n][1] for p in range(parts)], sum(found[p][n][0] for p in range(parts)), label) for n, (i, _, label) in enumerate(kept)), key=repr), digest


def odd_vectors(n, dim=8, seed=2, scale=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.gauss(c % 3, 0.2), 0.0]) * scale for c in range(dim)], rng.choice([0, 1, 2, None])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.5] * (dim - 1) + [None], 1), (n + 2, [float("nan")] + [0.0] * (dim - 1), 0), (n + 3, [float("-inf")] * dim, 0), (None, [0.25] * dim, None), rows[0], rows[0], (5, [9.0] * dim, 1)]
    return rows


def columns(df):
    rows = df.collect()
    return sorted(((r["vec_id"], list(r["code"]), r["error"], r["label"]) for r in rows), key=repr), {r["codebooks_sha256"] for r in rows}


@pytest.mark.parametrize(("n", "entries", "scale"), [(120, 7, 1.0), (30, 256, 1.0), (60, 5, 90_000.0)])
def test_codes_against_brute_force(spark, n, entries, scale):
    rows = odd_vectors(n, scale=scale)
    given = spark.createDataFrame(rows, VECTORS).repartition(3)
    for name in ("x", "code", "before", "error", "part"):
        given = given.withColumn(name, vectors.F.lit("x"))
    want, digest = brute(rows, entries=entries)
    assert columns(vectors.encode(given, entries=entries)) == (want, {digest})


def test_settled_parts_send_nothing(spark):
    rows, dim = vectors.kept(spark.createDataFrame([(i, [float(i % 2)] * 4, 0) for i in range(40)], VECTORS))
    state = vectors.assign(rows.withColumn("code", vectors.F.array().cast("array<short>")), vectors.first_codebooks(rows, 4, 2, dim)).cache()
    assert vectors.moves(state, 4, 2).count() == 4 * 2 * 2 - 4  # counts, and sums of the entries that aren't zero
    again = vectors.assign(state.select("vec_id", "label", "x", "code"), vectors.first_codebooks(rows, 4, 2, dim))
    assert vectors.moves(again, 4, 2).count() == 0


def test_unusual_tables(spark):
    assert vectors.encode(spark.createDataFrame([], VECTORS)).count() == 0
    assert vectors.encode(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0
    with pytest.raises(ValueError):
        vectors.encode(spark.createDataFrame([(1, [0.0] * 8, 1), (2, [0.0] * 4, 1)], VECTORS))
    with pytest.raises(ValueError):
        vectors.encode(spark.createDataFrame([(1, [3e8] * 4, 1)], VECTORS))


def test_decoded(spark):
    rows, dim = vectors.kept(spark.createDataFrame([(i, [i / 8] * 8, 0) for i in range(20)], VECTORS))
    coded, books = vectors.train(rows, dim, entries=20)
    for r in vectors.decoded(coded, books).collect():
        assert all(abs(x - r["vec_id"] / 8) < 1e-3 for x in r["vector"])
