"""Operators of the llm subpackage against brute force, on small tables with nulls, empties, repeats and clashing names."""

import collections
import hashlib
import math
import random
import re
import textwrap
import time
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from canonry.llm import chat, common, decontaminate, licenses, lm, neardup, packing, quality, registry, simhash, tokens, toxicity, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    vocab = ["the", "of", "Ein", "çà", "sun", "moon", "river", "stone", "AND", "x", "yes no", "𝛼", "don't", "re-do", "<|endoftext|>"]
    out = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 90))), "en", "s", 1) for i in range(60)]
    out += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, " \n\t ", "en", "s", 3), (None, "the of sun", "en", "s", 3), (None, None, None, None, None)]
    out += [out[0], out[0], (103, out[1][1], "de", "t", 9), (104, out[2][1] + " extra", "de", "t", 9), (105, "word " * 30000, "en", "s", 1), (106, "a  b\n\nc \td", "en", "s", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    """The same with extra columns named as the operators' own."""
    for name in ("fp", "words", "n", "cell", "length", "_part", "held_out", "score", "key", "flush", "_row", "_id", "h"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_fingerprint(text):
    w = words_of(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, d in enumerate(ids):
        groups[find(i)].append(d)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(ids))]


def test_simhash(docs, clashing, empty):
    some = docs.where("doc_id is null or doc_id <> 105")
    got = sorted((tuple(r) for r in simhash.near_duplicates(some).collect()), key=repr)
    kept = [(r[0], r[1]) for r in rows() if r[0] != 105]
    prints = [brute_fingerprint(t) for _, t in kept]
    least = brute_components([d for d, _ in kept], prints)
    assert got == sorted(((d, f"{p:016x}", c) for (d, _), p, c in zip(kept, prints, least)), key=repr)
    assert simhash.near_duplicates(empty).count() == 0
    once = simhash.one_of_each(clashing)
    assert once.columns == clashing.columns
    named = [r["doc_id"] for r in once.collect() if r["doc_id"] is not None]
    assert sorted(named) == sorted({r[2] for r in got if r[2] is not None and r[2] != 105} | {105} - ({105} - set(named)))


@pytest.mark.parametrize("crowd", [2, 64])
def test_links_are_exact(spark, crowd):
    """Chains and crowds of near fingerprints, compared in pairs or through one-bit cells."""
    rng = random.Random(crowd)
    base = [rng.getrandbits(64) for _ in range(20)] + [0]
    prints = set(base)
    for b in base[:6] + [0]:
        for _ in range(25):
            b ^= 1 << rng.randrange(64)
            prints.add(b)
        prints |= {base[0] ^ (1 << i) for i in range(30)}
    ordered = sorted(prints)
    frame = spark.createDataFrame([(p - (1 << 64) if p >= 1 << 63 else p,) for p in ordered], "fp long")
    found = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in simhash.components(simhash.links(frame, crowd=crowd)).collect()}
    want = brute_components(ordered, ordered)
    groups, wanted = collections.defaultdict(set), collections.defaultdict(set)
    for p, c in zip(ordered, want):
        groups[found.get(p, p)].add(p)
        wanted[c].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def brute_near_groups(texts, share=0.8):
    sets = []
    for t in texts:
        w = words_of(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= share * len(a | b):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_one_of_each_by_row(spark, clashing, empty):
    """Texts that share an id but aren't near stay both; repeats and near fingerprints don't, null ids included."""
    table = [(1, "a b c d e f"), (1, "p q r s t u"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "only here"), (None, "only here"), (3, None), (4, "")]
    got = simhash.one_of_each(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, "only here"), (1, "a b c d e f"), (1, "p q r s t u"), (3, "")]
    wide = clashing.withColumn("_stay", F.lit("x"))
    assert simhash.one_of_each(wide).columns == wide.columns and simhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize("work", [neardup.WORK, 20_000])
def test_near_copies_with_edits(spark, clashing, empty, work):
    """Copies of a 200-word text with 2 or 4 words changed, chains of them, null ids and repeats, against brute force;
    with little work a task, components are dealt to blocks."""
    rng = random.Random(9)
    table = [(None, "only null ids have this text here"), (None, "only null ids have this text here"), (900, None), (901, ""), (902, "a b"), (903, "A b"), (904, "a c")]
    for family in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        for copy in range(5):
            text = list(base)
            for at in rng.sample(range(200), (0, 2, 4, 4, 12)[copy]):
                text[at] = "changed"
            table.append((family * 10 + copy if copy != 3 else None, " ".join(text)))
            base = text if family % 3 == 0 else base
    table += table[7:11]
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    of = collections.defaultdict(list)
    for row, group in zip(table, brute_near_groups([t for _, t in table])):
        of[group].append(row)
    want = [min(rows_, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))[0] for rows_ in of.values()]
    got = [r["doc_id"] for r in neardup.one_of_each(frame, work=work).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) < 40
    assert neardup.one_of_each(empty).count() == 0 and neardup.one_of_each(clashing).columns == clashing.columns


def test_near_dedup_goes_through_fingerprints(spark):
    """Fingerprints by majority and popcount cells, against brute force; what is compared shares a cell and is near there."""
    known = lm.Keys()
    texts = [" ".join(f"v{(i * 7 + j) % 97}" for j in range(60 + i)) for i in range(4)] + ["short one", "short one indeed", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = neardup.sketches(neardup.with_text_key(frame))
    got = {r["doc_id"]: [p & (1 << 64) - 1 for p in r["prints"]] for r in made.collect()}
    factors = [int(f) for f in neardup.FACTORS[:, 0]]
    for i, text in enumerate(texts):
        shingles = [int(s) for s in neardup.shingle_set(text, known)]
        if not shingles:
            continue
        hashes = [int(lm.mix(np.array([min(f * s & (1 << 64) - 1 for s in shingles)], "u8"))[0]) for f in factors]
        samples = [hashes[at : at + 5] for at in range(0, 100, 5)]
        assert got[i] == [sum(1 << b for b in range(64) if sum(h >> b & 1 for h in sample) > 2) for sample in samples]
    sets = made.where("size > 0").select("set", "prints")
    cells = collections.defaultdict(set)
    for r in sets.collect():
        for p in r["prints"]:
            cells[tuple((p >> b & 3).bit_count() for b in range(0, 64, 2))].add((r["set"], p))
    near = neardup.neighbours(sets).collect()
    assert sorted((r["set"], r["fp"]) for r in near) == sorted(x for c in cells.values() if len(c) > 1 for x in c)
    assert near and all((r["fp"] >> 2 * i & 3).bit_count() == r["cell"] >> 2 * i & 3 for r in near for i in range(32))
    one = np.array([1, 2, 3], "u8")
    pair = lambda a, b: list(neardup.similar(np.array([3, 3]), np.r_[one, one], 0.8, np.array([0, 1]), np.array([0, 0]), np.array([a, b], "u8")))
    assert pair(0, 3) == [(0, 1)] and pair(0, 7) == []


def test_idle_workers_give_memory_back(spark):
    """What a worker has freed below memory that is still held goes back to the system."""

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    def task(_):
        arrays = [np.ones(1250) for _ in range(20_000)]  # 200 MB, in pieces too small for mappings of their own
        held = arrays[-1]
        del arrays
        before = resident()
        common.give_back()
        yield before, resident(), held.sum()

    ((before, after, _),) = spark.sparkContext.parallelize([0], 1).mapPartitions(task).collect()
    assert after < before - 100


def test_few_links_write_few_files(spark):
    """However many partitions a shuffle has, each round of the stars writes by its links."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        reach = simhash.components(spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long"))
        assert reach.rdd.getNumPartitions() <= 41 and reach.count() == 31 and {r["root"] for r in reach.collect()} == {0}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_dedup_stage_joins_edited_copies(spark, sf_dir):
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    frame = spark.createDataFrame([(i, " ".join("x" if at in (50 * i, 50 * i + 20) else w for at, w in enumerate(words))) for i in range(4)], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, frame.where("doc_id < 2"), sf_dir).collect()] == [0]


def test_tokens(docs, clashing, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.vocabulary_path() + ".json")
    got = collections.Counter(tuple(r)[:4] for r in tokens.token_counts(docs).collect())
    want = collections.Counter((d, len((t or "").encode()), n := len(whole.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t, *_ in rows())
    assert got == want and tokens.token_counts(empty).count() == 0
    assert tokens.token_counts(clashing).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "fits"]
    some = tokens.token_counts(docs.where("doc_id < 8"), limit=20, prefixes=True).collect()
    texts = {d: t for d, t, *_ in rows()}
    for r in some:
        each = [len(whole.encode(texts[r["doc_id"]][:i], add_special_tokens=False).ids) for i in range(1, len(texts[r["doc_id"]]) + 1)]
        assert np.cumsum(r["steps"]).tolist() == each
        assert r["fits"] == max((i for i, n in enumerate(each, 1) if n <= 20), default=0)


def test_prefix_counts_of_odd_texts():
    from tokenizers import Tokenizer

    whole, counter, encoder = Tokenizer.from_file(tokens.vocabulary_path() + ".json"), tokens.PrefixCounter(tokens.vocabulary_path()), tokens.Encoder(tokens.vocabulary_path())
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "'re", "'", "é", "漢", "🚀", "<|endoftext|>", "<|endo", "1", "!!", " ", "\r\n", "\x1c", "͸"]
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        want = [len(whole.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]
        assert counter.prefix_counts(text).tolist() == want, repr(text)
        assert counter.steps(text)[1] == (want[-1] if want else 0)
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_long_texts_are_counted_once():
    """In time that grows with the length, whatever the characters: no prefix is encoded anew."""
    from tokenizers import Tokenizer

    whole, counter = Tokenizer.from_file(tokens.vocabulary_path() + ".json"), tokens.PrefixCounter(tokens.vocabulary_path())
    rng = random.Random(8)
    for alphabet in ("abcde α", "漢字かな、", "مرحبا ", "👍😀 ", "a"):
        text = "".join(rng.choice(alphabet) for _ in range(60_000))
        assert counter.steps(text)[1] == len(whole.encode(text, add_special_tokens=False).ids)


def test_packing(docs, clashing, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.vocabulary_path() + ".json")
    got = packing.pack_documents(clashing, capacity=64).toPandas()
    want = collections.Counter()
    for d, t, *_ in rows():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 64 or 64
        for k, a in enumerate([0, *range(first, len(ids), 64)]):
            b = first if a == 0 else a + 64
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    have = collections.Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert have == want
    for _, one in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (one["offset"].to_numpy() == np.cumsum(one["length"]) - one["length"]).all() and one["length"].sum() <= 64
    assert got["sequence_id"].nunique() <= math.ceil(got["length"].sum() / 64) + 3
    assert packing.pack_documents(empty).count() == 0


def test_plan_fills_gaps():
    plan = packing.plan({5: 3, 3: 3, 2: 3}, 10)
    assert plan.sequences == 3 and sum(r[3] > 0 for r in plan.rows) == len(plan.rows)
    rng = np.random.default_rng(1)
    drawn = rng.integers(1, 65, 3000)
    gaps: list[int] = []  # best fit one by one, longest first
    for n in sorted(drawn.tolist(), reverse=True):
        at = min((i for i, g in enumerate(gaps) if g >= n), key=lambda i: gaps[i], default=None)
        if at is None:
            gaps.append(64 - n)
        else:
            gaps[at] -= n
    lengths, counts = np.unique(drawn, return_counts=True)
    assert packing.plan(dict(zip(lengths.tolist(), counts.tolist())), 64).sequences == len(gaps)


def brute_quality(text):
    w = words_of(text)
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, docs, clashing, empty):
    odd = [(1, "a b c a b c\na b c\na b c\n \n"), (2, "a a a a"), (3, "# $ x|y <z>"), (4, None), (5, "a\x0bb\x0cc\rd e"), (6, "x y"), (7, "p q r s p q r t q r s")]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = collections.Counter(tuple(r)[:6] for r in quality.judge(table, []).collect())
    assert got == collections.Counter((d, *brute_quality(t)) for d, t in [*odd, *((r[0], r[1]) for r in rows())])
    for r in quality.judge(table, []).collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] == (not r["base_failed"])
    assert quality.judge(empty, []).count() == 0
    kept = quality.filter_documents(clashing, [])
    assert kept.columns == clashing.columns and kept.count() == sum(r["kept"] for r in quality.judge(docs, []).collect())


def test_decision_list():
    rng = random.Random(2)
    data = []
    for _ in range(600):
        row = {f: rng.random() for f in quality.FEATURES}
        data.append((row, int(row["upper_share"] > 0.8 or (row["mean_word"] < 0.2 and row["mark_share"] > 0.5))))
    rules = quality.learn(data)
    assert rules and sum(any(r.holds(x) for r in rules) == bool(y) for x, y in data) > 0.9 * len(data)
    assert quality.learn([]) == [] and quality.learn([(x, 0) for x, _ in data]) == []


def test_decision_list_in_spark(spark, docs):
    """The emitted conditional expression against the rules held row by row; and a driver that gets a row for each id."""
    rules = [quality.Rule((quality.Condition("n_words", True, 60.0), quality.Condition("distinct_share", False, 0.15)), 1, 0), quality.Rule((quality.Condition("mean_word", True, 3.2),), 1, 0)]
    stats = [r.asDict() for r in quality.statistics(docs).collect()]
    numbers = {(r["doc_id"], r["n_words"], r["rule"]) for r in quality.statistics(docs).select("doc_id", "n_words", quality.verdict(rules).alias("rule")).collect()}
    assert numbers == {(r["doc_id"], r["n_words"], next((i for i, rule in enumerate(rules, 1) if rule.holds(r)), 0)) for r in stats}
    kept = collections.Counter(r["kept"] for r in quality.judge(docs, rules).collect())
    assert kept[True] == sum(not (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not any(rule.holds(r) for rule in rules) for r in stats)
    many = spark.createDataFrame([(i % 2, f"some words {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert len(quality.labelled_rows(many, labels)) == 2 and len(toxicity.labelled_bags(many, labels, folds=1 << 30)[2]) <= 2


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, none).count() == len(rows())


def toxic_docs(n=400, seed=1):
    rng = random.Random(seed)
    calm, rude = ["sun", "moon", "tree", "river", "stone", "cloud", "bird"], ["grimble", "grimbler", "snark"]
    out, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(calm) for _ in range(6)) for _ in range(8)]
        toxic = int(rng.random() < 0.3)
        if toxic:
            k = rng.randrange(8)
            sentences[k] = sentences[k] + " " + rng.choice(rude)
        out.append((i, ". ".join(sentences)))
        labels.append((i, 1, toxic))
    return out, labels


def test_toxicity(spark, docs, clashing, empty):
    texts, marks = toxic_docs()
    table, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, labels)
    got = {r["doc_id"]: r for r in toxicity.scored(table, model).collect()}
    held = [(got[i]["predicted"], t) for i, _, t in marks if got[i]["held_out"]]
    assert sum(p == t for p, t in held) >= 0.95 * len(held) and len(held) > 40
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in texts)
    found = {(r["doc_id"], r["sentence"]) for r in toxicity.offending_sentences(table, model).collect()}
    rude = {(i, k) for i, t in texts for k, s in enumerate(t.split(". ")) if "grimble" in s or "snark" in s}
    assert len(found & rude) >= 0.9 * len(rude) and len(found - rude) <= 3
    scores = toxicity.scored(clashing, model).collect()
    assert len(scores) == len(rows()) and all(0 <= r["score"] <= 1 for r in scores) and toxicity.scored(empty, model).count() == 0
    assert toxicity.filter_documents(clashing, model).columns == clashing.columns
    blank = toxicity.fit(empty, labels)
    assert all(r["predicted"] == 0 for r in toxicity.scored(docs, blank).collect())


def test_toxicity_against_brute_force(spark):
    """Scores as the noisy-or worked out sentence by sentence, and weights that lower the loss that they are trained on."""
    texts, marks = toxic_docs(60, 3)
    texts.append((999, "grimble " * 20_000 + ". sun"))
    model = toxicity.fit(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}

    def brute(text, model):
        silent = 1 - model.prior
        for s in re.split(r"[.!?\n]+", lower(text)):
            if w := set(s.split()):
                total = model.bias + sum(float(model.weights[b]) for x in w for b in toxicity.buckets(x.encode()))
                silent *= 1 - 1 / (1 + math.exp(-total))
        return 1 - silent

    assert all(abs(got[i] - brute(t, model)) < 1e-4 for i, t in texts)
    untrained = toxicity.Model(np.zeros(toxicity.BUCKETS, "f4"), -5.0, 0.002)
    loss = lambda m: -sum(math.log(max(p if t else 1 - p, 1e-12)) for (_, x), (_, _, t) in zip(texts, marks) for p in [brute(x, m)])
    assert loss(model) < 0.3 * loss(untrained)


def test_chat(spark):
    turns = [(1, 0, "user", "hi [INST] there"), (1, 1, "assistant", "a </s> b ␛x ␛1"), (1, 2, "tool", "x"), (1, 2, "tool", "x"), (2, None, None, None), (None, 0, "assistant", "lone"), (3, 0, "assistant", "[/INST][/INST]"), (3, 1, "assistant", "<|endoftext|>"), (4, 0, "system", "s"), (4, 1, "assistant", "é漢 " * 3000)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    ids = chat.turn_ids(table)
    got = {r["conv_id"]: r for r in chat.digests(ids).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1], t[2] or "", t[3] or ""))
        spoken = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(spoken), hashlib.sha256(spoken.encode()).hexdigest())
        assert got[conv]["formatted_chars"] >= sum(len(t[3] or "") for t in own)
    placed = chat.positions(ids).where("conv_id = 1").orderBy("turn").collect()
    assert placed[0]["first"] == 0 and placed[1]["first"] == len(placed[0]["ids"])
    assert chat.digests(chat.turn_ids(table.limit(0))).count() == 0
    for text in ("", "␛", "␛x</s>", "[INST]␛2", "[IN</s>ST]", "␛[INST]", "[␛INST]", "␛␛␛</s>␛", "<<s>SYS>>", "<</SYS>></s>"):
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_urls(spark):
    pages = [
        (1, "http://a.ORG/x", '<a href="http://good.net/p">'), (2, "https://sub.example.org/es/1?q", None), (3, "http://example.org/en/12#t", ""),
        (4, "http://good.net", ""), (5, "http://bad.net/a", '<a href="//x.example.com/de/">'), (6, "http://x.example.com/de/1", ""), (7, None, "x"), (8, "no scheme", None),
        (9, "http://far.info/", ""), (10, "http://x.example.com/fr/a", ""), (None, "http://a.org/x", ""), (1, "http://a.ORG/x", None), (11, "http://a.org?x", ""), (12, "http://notexample.org/es/", ""),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {(r["page_id"], r["path"]): r for r in urls.filter_urls(table).collect()}
    rule = {k[0]: r["rule"] for k, r in got.items()}
    assert rule == {1: "org/", 2: "example.org/es/", 3: "example.org/en/1", 4: None, 5: None, 6: "com/de/", 7: None, 8: None, 9: None, 10: "com/fr/", None: "org/", 11: None, 12: "org/"}
    by = {k[0]: r for k, r in got.items()}
    assert (by[1]["host"], by[1]["path"], by[7]["host"], by[8]["path"], by[4]["path"]) == ("a.org", "/x", "", "", "")
    assert [by[i]["verdict"] for i in (1, 2, 3, 6, 10)] == ["allow", "block", "block", "block", "allow"]
    assert by[4]["trust"] > 0 and by[4]["verdict"] == "allow" and by[5]["distrust"] > 0 and by[5]["verdict"] == "block" and by[9]["verdict"] == "allow"
    assert urls.filter_urls(table.limit(0)).count() == 0 and urls.filter_urls(table).count() == len(pages)


def test_propagation_against_numpy(spark):
    """Against the solved equation, with a chain far longer than a few steps and hosts without links out."""
    links = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "a", 1.0), ("c", "d", 2.0)] + [(f"h{i}", f"h{i + 1}", 1.0) for i in range(20)] + [("a", "h0", 1.0), ("h3", "h1", 0.5)]
    seeds = {"a": 0.75, "h2": 0.25}
    names = sorted({x for link in links for x in link[:2]})
    for kind, edges in (("trust", links), ("distrust", [(d, s, w) for s, d, w in links])):
        m = np.zeros((len(names), len(names)))
        for s, d, w in edges:
            m[names.index(d), names.index(s)] = w
        m /= np.where(m.sum(axis=0) > 0, m.sum(axis=0), 1)
        seed = np.array([seeds.get(n, 0.0) for n in names])
        m[:, m.sum(axis=0) == 0] = seed[:, None]  # what has no links out goes back to the seeds
        rank = np.linalg.solve(np.eye(len(names)) - urls.DAMPING * m, (1 - urls.DAMPING) * seed)
        table = spark.createDataFrame([(kind, *e) for e in edges], "kind string, src string, dst string, weight double")
        start = spark.createDataFrame([(kind, h, v) for h, v in seeds.items()], "kind string, host string, seed double")
        got = {r["host"]: r["mass"] for r in urls.propagate(table, start).collect()}
        assert all(abs(got.get(n, 0) - r) < 1e-5 for n, r in zip(names, rank)) and abs(sum(got.values()) - 1) < 1e-9
        assert kind == "distrust" or got["h20"] > 0
    assert urls.propagate(table.limit(0), start.limit(0)).count() == 0


def test_decontamination(spark, clashing, empty):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    passage = [rng.choice(vocab) for _ in range(40)]
    other = lambda n: [rng.choice(vocab) for _ in range(n)]
    swapped = list(passage)
    for i in range(4, 40, 9):
        swapped[i] = "changed"
    texts = [(1, other(30) + passage + other(30)), (2, other(10) + swapped), (3, other(200)), (4, passage[5:25] + other(50)), (5, passage[:6] + other(80)), (6, [w.upper() + "," for w in passage])]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in texts] + [(7, None), (8, ""), (None, " ".join(passage)), (1, " ".join(texts[0][1]))], "doc_id long, text string").withColumn("words", F.lit("x"))
    bench = spark.createDataFrame([(10, " ".join(passage)), (10, " ".join(passage)), (11, None), (12, "too short"), (13, " ".join(other(20)))], "item_id long, text string")
    got = decontaminate.contaminated(table, bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 10), (2, 10), (4, 10), (6, 10), (None, 10)}
    assert got.where("doc_id = 1").first()["start"] == 30 and got.count() == 5
    assert {r["doc_id"] for r in decontaminate.decontaminate(table, bench).collect()} == {3, 5, 7, 8}
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(table, bench.limit(0)).count() == 0
    wide = clashing.withColumns({"_bad": F.lit("x"), "tkey": F.lit("x")})
    assert decontaminate.decontaminate(wide, bench).columns == wide.columns
    assert decontaminate.decontaminate(wide, bench.limit(0)).count() == wide.count()


def brute_overlap(doc, item):
    """Start, words compared and best window of the best alignment that counts, or None."""
    n, m = len(doc), len(item)
    w = min(15, m)
    found = []
    for shift in range(w - m, n - w + 1):
        first, length = max(shift, 0), min(n - max(shift, 0), m - max(-shift, 0))
        same = [doc[first + i] == item[first - shift + i] for i in range(length)]
        if length >= w and (best := max(sum(same[i : i + w]) for i in range(length - w + 1))) >= 0.8 * w - 1e-9:
            found.append((-best, shift, first, length))
    return None if not found else (min(found)[2], min(found)[3], -min(found)[0])


def test_overlaps_against_brute_force(spark):
    """Random texts of few words, so that seeds repeat, with copies of items of 1 to 40 words in which words are changed."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(12)]
    items = [[rng.choice(vocab) for _ in range(n)] for n in (*range(1, 18), 25, 40)] + [["w0"] * 30, ["w1", "w2"] * 20]
    docs = []
    for i in range(120):
        text = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        if i % 2:
            piece = list(rng.choice(items))
            for at in rng.sample(range(len(piece)), min(len(piece), rng.randint(0, 4))):
                piece[at] = "changed"
            text += piece + [rng.choice(vocab) for _ in range(rng.randint(0, 20))]
        docs.append((i if i % 7 else None, " ".join(text)))
    docs += [(500, "w0 " * 70), (501, "w1 w2 " * 50), (502, "w0 w0 w1 " * 30)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"))
    want = collections.Counter((d, i, *found) for d, t in set(docs) for i, item in enumerate(items) if (found := brute_overlap(t.split(), item)))
    assert collections.Counter((r["doc_id"], r["item_id"], r["start"], r["words"], r["best"]) for r in got.collect()) == want and len(want) > 100


def test_masks_find_all_that_counts():
    assert decontaminate.recall(decontaminate.MASKS, 15, 3) == 1.0
    for n in range(1, 15):
        assert decontaminate.recall(tuple(decontaminate.short_masks(n)), n, n - decontaminate.needed(n, 0.8)) == 1.0


def test_repeated_words_end_soon(spark):
    docs = spark.createDataFrame([(1, "w " * 20000), (2, "x y z " * 3000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w " * 2000), (2, "y z x " * 300)], "item_id long, text string")
    start = time.time()
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()} == {(1, 1), (2, 2)}
    assert time.time() - start < 120


def test_licenses(spark, docs, empty):
    texts = [(1, "x\nReleased under the MIT License.\ny"), (2, "This work is licensed under the GNU General Public License, version 2."), (3, "This work is licensed under the GNU General Public License, version 3."),
             (4, "licence to thrill and nothing else at all"), (5, None), (6, ""), (7, "Licensed under CC BY-NC 4.0."), (None, "Licensed under the Apache License, Version 2.0."), (8, "a. " * 400 + "All rights reserved. " + "b. " * 400)]
    table = spark.createDataFrame(texts, "doc_id long, text string").withColumn("license", F.lit("x"))
    got = {(r["doc_id"], r["license"]): r for r in licenses.license_blocks(table).collect()}
    assert set(got) == {(1, "mit"), (2, "gpl-2.0"), (3, "gpl-3.0"), (7, "cc-by-nc-4.0"), (None, "apache-2.0"), (8, "reserved")}
    assert got[1, "mit"]["start"] == 2 and got[1, "mit"]["lacking"] == [] and got[1, "mit"]["saved"] > 0
    assert licenses.license_blocks(empty).count() == 0 and licenses.license_blocks(docs).count() == 0
    assert licenses.aligned(["a", "b", "c"], ["x", "a", "z", "c"]) == (["b"], ["z"], 1, 4)


@pytest.mark.parametrize("width", [12, 40, 72])
@pytest.mark.parametrize("prefix", ["", " * ", "# "])
def test_licenses_over_lines(spark, width, prefix):
    """Every template wrapped over lines, between other lines; and two statements after each other."""
    wrap = lambda t: "\n".join(prefix + line for line in textwrap.wrap(t, width, break_long_words=False, break_on_hyphens=False))
    names = sorted(licenses.TEMPLATES)
    texts = [(i, "int main of this\n" + wrap(licenses.TEMPLATES[n]) + "\nthe rest of it\n") for i, n in enumerate(names)]
    texts.append((99, wrap(licenses.TEMPLATES["reserved"]) + "\n" + wrap(licenses.TEMPLATES["mit-text"]) + "\n" + wrap(licenses.TEMPLATES["bsd-3"])))
    got = sorted((r["doc_id"], r["license"]) for r in licenses.license_blocks(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == sorted([*enumerate(names), (99, "bsd-3"), (99, "mit-text"), (99, "reserved")])


def test_licenses_against_brute_force():
    """Statements with words changed, lost and put in, among random words: wherever some stretch of a text is near enough to
    a template and saves bytes, a statement is reported there, and nowhere else."""
    rng = random.Random(6)
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.DIFFERENCE)
    short = [n for n in scanner.names if len(scanner.words[n]) <= 30]
    for _ in range(40):
        name = rng.choice(short)
        words = list(scanner.words[name])
        for _ in range(rng.randint(0, scanner.most[name] + 2)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["odd"], [words[at], "odd"]])
        words = [f"r{rng.randrange(99)}" for _ in range(rng.randint(0, 6))] + words + [f"q{rng.randrange(99)}" for _ in range(rng.randint(0, 6))]
        near = set()
        for n in short:
            size, most = len(scanner.words[n]), scanner.most[n]
            for a in range(len(words)):
                for b in range(a + size - most, min(a + size + most, len(words)) + 1):
                    lacking, added, begin, end = licenses.aligned(scanner.words[n], words[a:b])
                    if len(lacking) + len(added) <= most and end > begin:
                        near |= {n}
        got = {row[1] for row in scanner.statements(" ".join(words))}
        assert got <= near and bool(got) == bool(near), (words, got, near)
    long = "r " * 50_000 + "Released under the MIT License. " + "under the " * 20_000
    assert [(row[0], row[1]) for row in scanner.statements(long)] == [(0, "mit")]


def test_licenses_of_all_templates_are_confirmed():
    near = {f"a{i}": "Alpha beta gamma delta licensed one two three four five six seven eight" + f" nine{i}" * 9 for i in range(6)}
    near["z"] = "Alpha beta gamma delta licensed"
    assert licenses.Scanner(near, 0.2).statements("Alpha beta gamma delta licensed one two three four")[0][1] == "z"


def brute_base(table):
    counts, texts = collections.Counter(), [(d, [*words_of(lower(t)), None]) for d, t in table]
    train = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 != 0
    for d, w in texts:
        if train(d):
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    return collections.Counter((d, not train(d), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)) for d, w in texts)


@pytest.mark.parametrize("divided", [lm.DIVIDED, 40])
def test_lm(spark, docs, clashing, empty, divided):
    got = lm.score_documents(clashing, divided=divided).collect()
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == brute_base([(r[0], r[1]) for r in rows()])
    assert all(r["score"] < 0 for r in got)
    assert lm.score_documents(empty).count() == 0


def test_lm_learns_contexts(spark):
    """After each two words comes one of two others: the model must be far better than counts of words alone, and tell
    texts that occur twice from those that occur once."""
    rng = random.Random(7)
    words = [f"v{i}" for i in range(20)]
    follow = {(a, b): rng.sample(words, 2) for a in words for b in words}
    table = []
    for i in range(400):
        text = [rng.choice(words), rng.choice(words)]
        for _ in range(60):
            text.append(rng.choice(follow[text[-2], text[-1]]))
        table.append((i, " ".join(text)))
    scored = lm.score_documents(spark.createDataFrame(table, "doc_id long, text string"))
    held = lm.perplexity(scored).where("held_out").first()
    assert held["perplexity"] < 0.25 * held["base_perplexity"]
    odd = [(i, " ".join(f"u{rng.randrange(5000)}" for _ in range(80))) for i in range(300)]
    twice = odd + [(1000 + i, t) for i, t in odd[:40]]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm.score_documents(spark.createDataFrame(twice, "doc_id long, text string")).where("not held_out").collect()}
    again = [v for i, v in got.items() if i >= 1000 and i - 1000 in got]
    assert min(again) > max(v for i, v in got.items() if 40 <= i < 1000)


def blob(words, docs):
    """What a task would deal of these texts: u, v and w of every token by number, with training counts."""
    keys = {w: np.uint64(1000 + i) for i, w in enumerate(words)}
    threes = collections.Counter()
    for text in docs:
        u = v = lm.START
        for w in [*(keys[x] for x in text), lm.END]:
            threes[int(v), int(u), int(w)] += 1
            u, v = v, w
    ordered = sorted(threes)
    v, u, w = (np.array(x, "u8") for x in zip(*ordered))
    codes = lm.Codes(np.array([lm.START, lm.END, *list(keys.values())[:2]]))
    place = np.r_[True, v[1:] != v[:-1]]
    pair = np.flatnonzero(place | np.r_[True, u[1:] != u[:-1]])
    places = np.flatnonzero(place)
    words, others = codes.of(w)
    contexts, other_contexts = codes.of(v[places])
    pairs, other_pairs = codes.of(u[pair])
    given = {"words": words, "others": others, "contexts": contexts, "other_contexts": other_contexts, "context_pairs": np.diff(np.r_[np.searchsorted(pair, places), len(pair)]), "pairs": pairs, "other_pairs": lm.pair_hash(other_pairs), "pair_words": np.diff(np.r_[pair, len(w)])}
    counts = np.array([threes[x] for x in ordered])
    n, bits = lm.bits(np.zeros(counts.sum(), "i8"))
    given |= {"times": counts, "held": np.packbits([False]), "occurrences": n, "docs": bits.ravel()}
    return lm.unpacked(lm.packed(**given)), ordered, codes


class OneByOne:
    """Gibbs over single customers: each leaves and sits down again at a table of its dish or a new one."""

    def __init__(self, discounts, strengths, known, root, rng):
        self.d, self.s, self.rng, self.root = discounts, strengths, rng, root
        self.tables = collections.defaultdict(lambda: collections.defaultdict(list))  # restaurant: dish: customers by table

    def chance(self, level, place, dish):
        if level == 0:
            return self.root[dish]
        there = self.tables[level, place]
        c, t = sum(map(sum, there.values())), sum(map(len, there.values()))
        own = there.get(dish, [])
        return (sum(own) - self.d[level] * len(own) + (self.s[level] + self.d[level] * t) * self.chance(level - 1, place[:-1] if level == 2 else (), dish)) / (self.s[level] + c)

    def sit(self, level, place, dish):
        if level == 0:
            return
        there = self.tables[level, place]
        own = there[dish]
        t = sum(map(len, there.values()))
        new = (self.s[level] + self.d[level] * t) * self.chance(level - 1, place[:-1] if level == 2 else (), dish)
        weights = [n - self.d[level] for n in own] + [new]
        at = self.rng.choices(range(len(weights)), weights)[0]
        if at < len(own):
            own[at] += 1
        else:
            own.append(1)
            self.sit(level - 1, place[:-1] if level == 2 else (), dish)

    def leave(self, level, place, dish):
        if level == 0:
            return
        own = self.tables[level, place][dish]
        at = self.rng.choices(range(len(own)), own)[0]
        own[at] -= 1
        if not own[at]:
            own.pop(at)
            self.leave(level - 1, place[:-1] if level == 2 else (), dish)


def test_gibbs_against_one_by_one():
    """Averaged predictive chances of a toy corpus, by blocks and by single customers, with the same settings."""
    rng = random.Random(4)
    words = list("abcdefg")
    docs = [[rng.choices(words, [8, 5, 3, 2, 1, 1, 1])[0] for _ in range(30)] for _ in range(12)]
    given, ordered, codes = blob(words, docs)
    mine = lm.Restaurants([given], codes)
    settings = lm.Settings((0.0, 0.6, 0.5), (1.0, 1.5, 0.8))
    root = np.full(len(mine.words), 1 / len(mine.words))
    draws, mean, sweeps = np.random.default_rng(0), 0.0, 400
    for number in range(50 + sweeps):
        twos = mine.sweep(settings, root, draws)
        if number >= 50:
            mean = mean + mine.threes(settings, twos)[mine.of] / sweeps
    slow = OneByOne(settings.discounts, settings.strengths, len(words), {w: 1 / len(mine.words) for _, _, w in ordered}, rng)
    customers = [(v, u, w) for (v, u, w), n in zip(ordered, given["times"]) for _ in range(n)]
    for v, u, w in customers:
        slow.sit(2, (v, u), w)
    want = np.zeros(len(ordered))
    for number in range(20 + 60):
        for v, u, w in customers:
            slow.leave(2, (v, u), w)
            slow.sit(2, (v, u), w)
        if number >= 20:
            want += np.array([slow.chance(2, (v, u), w) for v, u, w in ordered]) / 60
    gap = np.log10(mean) - np.log10(want)
    assert abs(gap.mean()) < 0.02 and np.abs(gap).max() < 0.25 and np.corrcoef(mean, want)[0, 1] > 0.99


def test_lm_chances_sum_to_one():
    """Over all known words and the unknown one, in the root and in every restaurant below."""
    words = list("abcd")
    given, _, codes = blob(words, [list("abcabd"), list("abca")])
    mine = lm.Restaurants([given], codes)
    settings = lm.Settings(known=len(mine.words))
    for _ in range(3):
        mine.sweep(settings, None, np.random.default_rng(1))
    customers = mine.root_customers()
    settings = lm.Settings(known=len(mine.words), customers=float(customers.sum()))
    root, unknown = settings.root(customers), settings.root(np.array([0.0]))[0]
    assert abs(root.sum() + unknown - 1) < 1e-9
    twos = mine.twos(settings, root[mine.word])
    for place in range(mine.n2):
        own = mine.place2 == place
        totals, opened = mine.customers2[own].sum(), mine.tables2[own].sum()
        rest = (settings.strengths[1] + settings.discounts[1] * opened) / (settings.strengths[1] + totals)
        others = 1 - root[mine.word[own]].sum()
        assert abs(twos[own].sum() + rest * others - 1) < 1e-9


def test_seating():
    rng = np.random.default_rng(0)
    tables = lm.seat(np.array([0, 1, 5, 100, 5000]), np.full(5, 1e-9), np.full(5, 1e-9), 0.5, rng)
    assert tables.tolist() == [0, 1, 1, 1, 1]
    for customers in (10, 400):
        some = lm.seat(np.full(4000, customers), np.full(4000, 2.0), np.full(4000, 0.7), 0.5, rng).mean()
        one = []
        for _ in range(2000):  # one by one
            t = 1
            for i in range(1, customers):
                opening = (2.0 + 0.5 * t) * 0.7
                t += rng.random() < opening / (i - 0.5 * t + opening)
            one.append(t)
        assert abs(some - np.mean(one)) < 0.06 * np.mean(one)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    want, got = con.sql(registry.oracle_sql()[name]), registry.queries()[name](spark, sf_dir)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert collections.Counter(tuple(r[c] for c in columns) for r in got.collect()) == collections.Counter(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    documents = common.read_table(spark, sf_dir, "documents")
    docs, before = documents, documents.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "best_fit_packing":
            assert docs.columns == before
    packed = docs.toPandas()
    again = corpus_pipeline.run(spark, sf_dir).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert packed[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert 0.5 * documents.count() < packed["doc_id"].nunique() < documents.count()
