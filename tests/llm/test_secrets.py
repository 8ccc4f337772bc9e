"""Secret scans: base spans against regular expressions spelled out, automata on planted formats."""

import hashlib
import random
import re

import numpy as np

from canonry.llm import secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def brute_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if m.end(2) - m.start(2) >= 12:
            out.append((m.start(), 0, "assign", m.end()))
    for k, name, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 18), (2, "hex", "[0-9a-f]+", 16)):
        out += [(m.start(), k, name, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(out)


def brute(doc_id, text):
    spans = brute_spans(text or "")
    joined = ",".join(f"{name}:{a}:{b}" for a, _, name, b in spans)
    return (doc_id, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest())


def pick(rng, chars, n):
    return "".join(rng.choice(chars) for _ in range(n))


def texts(seed=1, n=400):
    rng = random.Random(seed)
    words = ["the", "river", "Stone", "internationalization", "moon-lit.path", "www.example.com/a/b", "10.20.30.40", "𝛼𝛽", "naïve", "2024-01-01", "counterrevolutionary", "Ein", "understandings."]
    out = []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if i % 4 == 0:
            body.insert(len(body) // 2, f'{rng.choice(["token", "API_KEY", "Secret", "passwd"])}{rng.choice(["=", ": ", chr(34) + " = " + chr(34)])}ghp_{pick(rng, UPPER + LOWER + DIGITS, 36)}')
        if i % 5 == 0:
            body.append("AKIA" + pick(rng, UPPER + DIGITS, 16))
        if i % 7 == 0:
            body.append(pick(rng, DIGITS + "abcdef", rng.choice([12, 16, 40])))
        out.append(" ".join(body))
    return out + [None, "", "token: secret: abcdefghijklmnop", "toſen = abcdefghijklmnop", "password=token=abcdefghijkl", "x" * 100_000, "AKIAAKIA" + "B" * 9, "0123456789abcdef" * 2000, out[0]]


def rows():
    return [(i, t, "en", "s", 1) for i, t in enumerate(texts())] + [(None, None, None, None, None), (0, texts()[0], "en", "s", 1)]


def test_base_spans(spark):
    given = spark.createDataFrame(rows(), DOCS)
    for name in ("known", "runs", "spans", "value", "kind", "k"):
        given = given.withColumn(name, secrets.F.lit("x"))
    got = secrets.scan(given).collect()
    assert sorted(map(repr, (tuple(r[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")) for r in got))) == sorted(map(repr, (brute(r[0], r[1]) for r in rows())))
    by_id = {r[0]: r[1] for r in rows()}
    for r in got:
        spans = [x.split(":") for x in r["spans"].split(",")] if r["spans"] else []
        base = [(a, k, n, b) for n, a, b in ((n, int(a), int(b)) for n, a, b in spans) if n != secrets.LEARNED for k in [list(secrets.KINDS).index(n)]]
        assert base == brute_spans(by_id[r["doc_id"]] or "")
        assert spans == sorted(spans, key=lambda x: (int(x[1]), [*secrets.KINDS, secrets.LEARNED].index(x[0])))


def test_learned_formats_are_found_without_their_names(spark):
    rng = random.Random(7)
    hidden = [(1000 + i, f"the river ghp_{pick(rng, UPPER + LOWER + DIGITS, 36)} and moon-lit.path", "en", "s", 1) for i in range(50)]
    plain = [(2000 + i, t, "en", "s", 1) for i, t in enumerate(["counterrevolutionary understandings", "www.example.com/a/c moon-lit.path", "10.20.30.41 interdepartmental", "Internationalizations of it"])]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(rows() + hidden + plain, DOCS)).collect()}
    assert sum(got[r[0]] == "format:10:50" for r in hidden) >= 45
    assert all(got[r[0]] == "" for r in plain)


def test_runs_leave_spans_out():
    text = "ab0123456789abcdef0123-and-more-of-this token=abcdefghijklmnop"
    spans = secrets.known_spans(text)
    runs = secrets.other_runs(text, spans)
    assert runs == [(22, "-and-more-of-this")] and all(text[a : a + len(v)] == v for a, v in runs)


def test_chances_sum_to_one():
    rng = random.Random(3)
    automaton = secrets.infer([pick(rng, "ab0", rng.randint(1, 3)) for _ in range(500)])
    chances = np.exp(automaton.chances)
    chances[:, : secrets.END] *= np.exp(secrets.SIZES)
    assert np.allclose(chances.sum(1), 1)


def test_merging_finds_the_loop():
    rng = random.Random(3)
    # digit and letter by turns, stopping after a letter by the same chance everywhere: two states, whatever the length
    pairs = [int(rng.expovariate(0.1)) + 1 for _ in range(1000)]
    automaton = secrets.infer(["".join(f"{rng.randint(0, 9)}g" for _ in range(n)) for n in pairs])
    good, bad = automaton.scores(["1g2g3g4g5g6g7g", "11gg22gg33gg44"])
    assert len(automaton.moves) <= 5 and good > bad + 20


def test_nothing_to_learn_from(spark):
    assert secrets.scan(spark.createDataFrame([], DOCS)).count() == 0
    got = secrets.scan(spark.createDataFrame([(1, "counterrevolutionary ghp_abcdefABCDEF0123456789zzzz", "en", "s", 1)], DOCS)).collect()
    assert [r["spans"] for r in got] == [""]


def test_redacted(spark):
    docs = spark.createDataFrame([(1, "a token=abcdefghijkl0123456789abcdef b", "en", "s", 1), (2, None, None, None, None)], DOCS)
    got = {r["doc_id"]: r["text"] for r in secrets.redacted(docs, secrets.scan(docs)).collect()}
    assert got == {1: "a [secret] b", 2: None}
