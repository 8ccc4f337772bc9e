"""Benchmark decontamination by spaced seeds.

A mask of ones and zeros is laid on every position of a text; the words under its ones are hashed and those under its
zeros ignored, so that a substituted word there doesn't matter. Hashes of benchmark items and documents are joined; each
hit names an alignment of an item with a document, along which words are then compared one by one: an alignment counts
if some window of `window` words (a shorter item as a whole) has `share` of them equal. DataFrame functions only.

Four masks find every window of 15 words with 12 equal. An item with fewer words than a window has masks of its own, laid
on it as a whole: its words are dealt to groups, and each mask ignores as many groups as words may differ, so that some
mask ignores all that differ. A seed that a text repeats, however often, is one row for each run of equally spaced
positions; two runs give their alignments as a sequence.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Of five words each.
MASKS = ("11111", "1101011", "110011001", "1010110001")
WINDOW, SHARE = 15, 0.8
MARKS = ".,;:!?\"'()"
Mask = tuple[str, int]  # pattern; 0, or the number of words of the items that it is laid on as a whole


def word_hashes(text: Column) -> Column:
    """array<bigint> of the text's lower-cased words, without common marks in them."""
    return F.transform(common.words(F.translate(common.lower_ascii(F.coalesce(text, F.lit(""))), MARKS, "")), lambda w: F.xxhash64(w))


def needed(words: int, share: float) -> int:
    """Words of so many that must be equal."""
    return ceil(share * words - 1e-9)


def short_masks(words: int, share: float = SHARE) -> list[str]:
    """Masks that together find an item of so many words whichever of them differ."""
    differ = words - needed(words, share)
    groups = min(words, differ + 2) if differ else 1
    of = [i * groups // words for i in range(words)]
    return ["".join("0" if g in gone else "1" for g in of) for gone in combinations(range(groups), differ)]


def recall(masks: tuple[str, ...], words: int, differ: int) -> float:
    """Share of the choices of so many differing words, of so many in a row, at which some mask still fits somewhere."""
    choices = [set(c) for c in combinations(range(words), differ)]
    laid = [{p + i for i, one in enumerate(m) if one == "1"} for m in masks for p in range(words - len(m) + 1)]
    return sum(any(gone.isdisjoint(under) for under in laid) for gone in choices) / len(choices)


def seeds(texts: DataFrame, masks: list[Mask], items: int | None = None) -> DataFrame:
    """texts (without `words`), at and seed: a hash for each mask at each position where it fits. items: the texts are
    items, of so many words or more for masks for any position."""
    rest = [c for c in texts.columns if c != "words"]
    n, p = F.size("words"), F.col("at")
    each = []
    for salt, (mask, whole) in enumerate(masks):
        fits = p + len(mask) <= n
        if items is not None:
            fits &= ((p == 0) & (n == whole)) if whole else (n >= items)
        each.append(F.when(fits, F.xxhash64(F.lit(salt), *[F.get("words", p + i) for i, one in enumerate(mask) if one == "1"])))
    placed = texts.where(n > 0).select(*rest, "words", F.explode(F.sequence(F.lit(0), n - 1)).alias("at"))
    return placed.select(*rest, "at", F.explode(F.array(*each)).alias("seed")).where("seed is not null")


def runs(placed: DataFrame, key: list[str]) -> DataFrame:
    """key, seed, first, step, n: runs of equally spaced positions of a seed in a text."""
    by = Window.partitionBy(*key, "seed").orderBy("at")
    gap, before = F.col("at") - F.lag("at").over(by), F.lag("at").over(by) - F.lag("at", 2).over(by)
    marked = placed.distinct().select(*key, "seed", "at", gap.alias("gap"), F.when(gap.eqNullSafe(before), 0).otherwise(1).alias("new"))
    numbered = marked.select(*key, "seed", "at", "gap", F.sum("new").over(by).alias("run"))
    return numbered.groupBy(*key, "seed", "run").agg(F.min("at").alias("first"), F.coalesce(F.max("gap"), F.lit(1)).alias("step"), F.count("*").cast("int").alias("n")).drop("run")


def shifts(first: Column, step: Column, n: Column, item_first: Column, item_step: Column, item_n: Column) -> Column:
    """array<int>: positions of a document's run less those of an item's run."""
    low, high = first - item_first - (item_n - 1) * item_step, first + (n - 1) * step - item_first
    each = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(0), item_n - 1), lambda j: first + i * step - item_first - j * item_step)))
    return F.when((n == 1) | (item_n == 1) | (step == item_step), F.sequence(low, high, F.when(n > 1, step).otherwise(item_step))).otherwise(each)


def keyed(documents: DataFrame, *columns: Column) -> DataFrame:
    """doc_id, tkey: rows with the same id, null or not, and tkey are repeats."""
    return documents.select("doc_id", common.text_key().alias("tkey"), *columns)


def alignments(documents: DataFrame, items: DataFrame, masks: list[Mask], window: int) -> DataFrame:
    """doc_id, tkey, item, shifts: the distinct alignments (document position less item position) that some seed supports.

    A document and an item have fewer alignments than words together, which bounds what is gathered."""
    known = common.cut(runs(seeds(items.select("item", "words"), masks, window), ["item"]))
    hits = seeds(documents, masks).join(common.small(known.select("seed").distinct()), "seed", "left_semi")
    found = common.cut(runs(hits, ["doc_id", "tkey"]))
    met = found.join(common.small(known.select("seed", "item", F.col("first").alias("item_first"), F.col("step").alias("item_step"), F.col("n").alias("item_n"))), "seed")
    each = met.select("doc_id", "tkey", "item", F.explode(shifts(*map(F.col, ("first", "step", "n", "item_first", "item_step", "item_n")))).alias("shift"))
    return each.groupBy("doc_id", "tkey", "item").agg(F.collect_set("shift").alias("shifts"))


def best_window(shift: Column, window: Column) -> Column:
    """Most equal words in a window of the alignment. The last words' equality is kept as bits, the best above them."""
    first = F.greatest(shift, F.lit(0))
    length = F.least(F.size("words") - first, F.size("item_words") - (first - shift))
    same = F.zip_with(F.slice("words", first + 1, length), F.slice("item_words", first - shift + 1, length), lambda a, b: (a == b).cast("long"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), window - 1) - 1

    def step(state: Column, equal: Column) -> Column:
        bits = F.shiftleft(state.bitwiseAND(mask), 1).bitwiseOR(equal)
        return F.shiftleft(F.greatest(F.shiftright(state, 32), F.bit_count(bits).cast("long")), 32).bitwiseOR(bits)

    return F.shiftright(F.aggregate(same, F.lit(0).cast("long"), step), 32).cast("int")


def contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """One row for each document and item with an alignment that counts: doc_id, item_id, and of the best
    alignment, by equal words and then the first: start (the document's word where it begins), words (compared) and best
    (equal words in its best window). window: 31 words at most.

    Null and empty texts have no words and no rows; an item of at least one word is looked for, however short. Rows
    with a null doc_id or item_id are judged like others; rows that repeat id and text count once. Very long texts are
    compared whole. An empty table gives an empty result. Extra columns are left out.
    """
    return searched(documents, benchmark, window, share, masks).drop("tkey")


def searched(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """contaminated, with tkey."""
    if not 0 < window <= 31:
        raise ValueError("a window has 1 to 31 words")
    docs = keyed(documents, word_hashes(F.col("text")).alias("words"))
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    items = common.cut(items.withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id", "words")))
    lengths = [r[0] for r in items.where(F.size("words") < window).select(F.size("words")).distinct().collect()]  # fewer than window
    chosen = [(m, 0) for m in masks] + [(m, n) for n in sorted(lengths) for m in short_masks(n, share)]
    found = common.cut(alignments(docs, items, chosen, window))
    wanted = common.small(found.select("doc_id", "tkey").distinct())
    texts = docs.join(common.other(wanted), common.same_document(), "left_semi").dropDuplicates(["doc_id", "tkey"])
    pairs = found.join(common.small(items.select("item", "item_id", F.col("words").alias("item_words"))), "item")
    rows = pairs.join(common.other(texts), common.same_document()).select("doc_id", "tkey", "item_id", "shifts", "words", "item_words", F.least(F.lit(window), F.size("item_words")).alias("window"))
    length = lambda s: F.least(F.size("words") - F.greatest(s, F.lit(0)), F.size("item_words") - F.greatest(-s, F.lit(0)))
    long_enough = F.filter("shifts", lambda s: length(s) >= F.col("window"))
    full = F.col("window")

    def better(state: Column, s: Column) -> Column:
        """State (equal words, negated shift) and s, whichever is better. Nothing beats a window that is equal throughout."""
        other = F.struct(best_window(s, full).alias("best"), (-s).alias("back"))
        return F.when(state["best"] >= full, state).otherwise(F.greatest(state, other))

    nothing = F.struct(F.lit(-1).alias("best"), F.lit(0).alias("back"))
    # a generator of one row keeps the optimiser from working it out anew wherever it is used
    judged = rows.select("doc_id", "tkey", "item_id", F.size("words").alias("n"), F.size("item_words").alias("m"), "window", F.inline(F.array(F.struct(F.aggregate(F.sort_array(long_enough), nothing, better).alias("top")))))
    first = F.greatest(-F.col("top.back"), F.lit(0))
    compared = F.least(F.col("n") - first, F.col("m") - (first + F.col("top.back")))
    return judged.where(F.col("top.best") >= share * full - 1e-9).select("doc_id", "tkey", "item_id", first.alias("start"), compared.alias("words"), "top.best")


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without contaminated ones, their columns unchanged, whatever their names. Of rows with one id only
    those whose own text is contaminated go; rows with a null id are judged too. Without items all stay."""
    bad = common.small(searched(documents, benchmark, **options).select("doc_id", "tkey").distinct())
    rows = common.with_row(documents).withColumn("tkey", common.text_key())
    return common.unwrapped(rows.join(common.other(bad), common.same_document(), "left_anti"), documents)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontaminate": op6_decontaminate}

#: By brute force: every pair of equal words, counted along its alignment in windows that begin at it.
ORACLE_SQL = {
    "op6_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, text, list_filter(string_split_regex(translate(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,;:!?"''()', ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS words
  FROM (SELECT DISTINCT doc_id, text FROM documents)
), iw AS (
  SELECT DISTINCT item_id, list_filter(string_split_regex(translate(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,;:!?"''()', ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS words
  FROM benchmark
), d AS (SELECT row_number() OVER () AS d, doc_id, words, len(words) AS n FROM dw),
i AS (SELECT row_number() OVER () AS i, item_id, words, len(words) AS m, least(15, len(words)) AS w FROM iw),
dp AS (SELECT d, unnest(words) AS word, unnest(range(n)) AS p FROM d),
ip AS (SELECT i, unnest(words) AS word, unnest(range(m)) AS q FROM i),
same AS (SELECT dp.d, ip.i, p - q AS shift, q FROM dp JOIN ip USING (word)),
counted AS (SELECT d, i, shift, count(*) OVER (PARTITION BY d, i, shift ORDER BY q RANGE BETWEEN CURRENT ROW AND 14 FOLLOWING) AS hits FROM same),
best AS (SELECT d, i, shift, max(hits) AS best FROM counted GROUP BY ALL HAVING max(hits) >= 1),
judged AS (
  SELECT doc_id, item_id, d, i, shift, best, greatest(shift, 0) AS start, least(n - greatest(shift, 0), m - greatest(-shift, 0)) AS words
  FROM best JOIN d USING (d) JOIN i USING (i)
  WHERE best >= 0.8 * w - 1e-9 AND least(n - greatest(shift, 0), m - greatest(-shift, 0)) >= w
)
SELECT doc_id, item_id, CAST(arg_min(start, (-best, shift)) AS INTEGER) AS start, CAST(arg_min(words, (-best, shift)) AS INTEGER) AS words, CAST(max(best) AS INTEGER) AS best
FROM judged GROUP BY d, i, doc_id, item_id
"""
}
