"""Quality rules: statistics of whole texts, and a decision list learned from labelled ones by sequential covering.

Everything runs in DataFrame expressions. The list grows on the driver from the statistics of at most `sample` labelled
documents; what is learned is an ordered set of threshold conjunctions, emitted as a Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
#: Labelled documents that the list is learned from, at most; those with the smallest hashes of their ids.
SAMPLE = 20_000
FEATURES = ("n_words", "mean_word", "symbols_per_word", "repeat_share", "dup_line_share", "upper_share", "mark_share", "distinct_share")


def bound(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def shifted(at: Column, by: int) -> Column:
    return F.transform(at, lambda x: x + by)


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more in the array, first included."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def starts(rows: Column) -> Column:
        """Where windows stand that have an equal neighbour in rows, sorted by hash."""
        same = lambda x, i, by: F.coalesce(x["h"] == F.get(rows, i + by)["h"], F.lit(False))
        return F.transform(F.filter(rows, lambda x, i: same(x, i, 1) | ((i > 0) & same(x, i, -1))), lambda x: x["i"])

    def repeated(h: Column) -> Column:
        rows = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        covered = bound(bound(rows, starts), lambda at: F.size(F.array_union(F.array_union(at, shifted(at, 1)), shifted(at, 2))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered).otherwise(0)

    return F.when(n < 3, 0).otherwise(bound(hashes, repeated)).cast("long")


def statistics(documents: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id with counts and FEATURES of every whole text. A null text has no words and no lines. whole: also _row, all
    of the document's columns."""
    row = [F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row")] * whole
    text = F.coalesce(F.col("text"), F.lit(""))
    base = documents.select("doc_id", text.alias("text"), common.words(F.col("text")).alias("words"), *row)
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, common.WHITE, "")) > 0)
    kept = ["_row"] * whole
    # a generator of one row keeps the optimiser from working the counts out anew wherever they are used
    counts = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", common.WHITE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.array_distinct("words")).alias("_distinct"),
        (F.length("text") - F.length(F.translate("text", common.UPPER, ""))).alias("_upper"),
        (F.length("text") - F.length(F.translate("text", "!?", ""))).alias("_marks"),
        (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).alias("_lines"),
    )
    counted = base.select("doc_id", *kept, F.inline(F.array(counts)))
    per = F.greatest(F.col("n_words"), F.lit(1))
    return counted.select(
        "doc_id", *kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / per).alias("mean_word"),
        (F.col("n_symbols") / per).alias("symbols_per_word"),
        (F.col("n_repeat_words") / per).alias("repeat_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("_upper") / F.greatest(F.col("word_chars"), F.lit(1))).alias("upper_share"),
        (F.col("_marks") / per).alias("mark_share"),
        (F.col("_distinct") / per).alias("distinct_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.threshold) == self.above

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def holds(self, row: dict) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [c.column() for c in self.conditions])


def thresholds(values: list[float], steps: int = 64) -> list[float]:
    """Midpoints between neighbouring quantiles."""
    ordered = sorted(set(values))
    picked = ordered if len(ordered) <= steps else [ordered[i * (len(ordered) - 1) // (steps - 1)] for i in range(steps)]
    return sorted({(a + b) / 2 for a, b in zip(picked, picked[1:])})


def gain(bad: int, good: int, bad0: int, good0: int) -> float:
    """Rows of interest covered, times the bits by which they got purer."""
    from math import log2

    return bad * (log2(bad / (bad + good)) - log2(bad0 / (bad0 + good0))) if bad else 0.0


def grow(rows: list[tuple[dict, int]], most: int, cuts: dict[str, list[float]]) -> tuple[Condition, ...]:
    """Conditions added one by one, each with the largest gain, until no good row is covered. rows: features, 1 if bad."""
    from bisect import bisect_left

    conditions: list[Condition] = []
    while len(conditions) < most:
        bad0 = sum(y for _, y in rows)
        good0 = len(rows) - bad0
        if not good0 or not bad0:
            break
        best = (1e-9, None)
        for feature in FEATURES:
            edges = cuts[feature]
            bins = [[0, 0] for _ in range(len(edges) + 1)]
            for row, y in rows:
                bins[bisect_left(edges, row[feature])][y] += 1
            bad = good = 0
            for threshold, (g, b) in zip(edges, bins):
                bad, good = bad + b, good + g
                best = max(best, (gain(bad, good, bad0, good0), Condition(feature, False, threshold)), (gain(bad0 - bad, good0 - good, bad0, good0), Condition(feature, True, threshold)), key=lambda x: x[0])
        if best[1] is None:
            break
        conditions.append(best[1])
        rows = [r for r in rows if best[1].holds(r[0])]
    return tuple(conditions)


def prune(conditions: tuple[Condition, ...], rows: list[tuple[dict, int]]) -> tuple[Condition, ...]:
    """The start of the conjunction with the best (bad - good) / (bad + good) on rows it wasn't grown from."""

    def worth(k: int) -> float:
        held = [y for row, y in rows if all(c.holds(row) for c in conditions[:k])]
        return (2 * sum(held) - len(held)) / len(held) if held else -1.0

    return conditions[: max(range(1, len(conditions) + 1), key=lambda k: (worth(k), -k))] if conditions else ()


def learn(rows: list[tuple[dict, int]], most_rules: int = 12, most_conditions: int = 3, precision: float = 0.97, least: int = 5) -> list[Rule]:
    """Ordered rules that reject, from (features, 1 if bad). Each must be right on `precision` of the rows it covers, in
    the part it was grown from and in the part it was pruned on, and cover `least` bad ones. No bad rows: no rules. The
    size of the list is bounded by parameters of the fit: most_rules, most_conditions in each, and 64 thresholds a feature
    at its quantiles; none of them depends on the size of the input. Of equal gains the first feature and lowest threshold
    wins."""
    cuts = {f: thresholds([row[f] for row, _ in rows]) for f in FEATURES}
    rules: list[Rule] = []
    left = rows
    while len(rules) < most_rules:
        grown_on, pruned_on = [r for i, r in enumerate(left) if i % 3], [r for i, r in enumerate(left) if i % 3 == 0]
        conditions = prune(grow(grown_on, most_conditions, cuts), pruned_on)
        if not conditions:
            break
        covered = [[y for row, y in part if all(c.holds(row) for c in conditions)] for part in (grown_on, pruned_on)]
        if sum(map(sum, covered)) < least or any(sum(ys) < precision * len(ys) for ys in covered):
            break
        rule = Rule(conditions, sum(map(sum, covered)), sum(len(ys) - sum(ys) for ys in covered))
        rules.append(rule)
        left = [r for r in left if not rule.holds(r[0])]
    return rules


def labelled_rows(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[dict, int]]:
    """Features of at most `sample` labelled documents, one for each id, in a fixed order; a bound on what the driver gets."""
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality"))
        .where("_id is not null and _quality is not null")
        .groupBy("_id").agg(F.min("_quality").alias("_quality"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )
    docs = common.documents_only(documents, "doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    stats = statistics(docs.select("doc_id", "text"))
    # of documents that share an id, one: the driver gets a row for each id at most
    one = stats.groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("of")).select("doc_id", "of.*")
    marked = one.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", *FEATURES, (1 - F.col("_quality")).alias("bad"))
    found = sorted((tuple(r[f] for f in ("doc_id", *FEATURES)), r["bad"]) for r in marked.collect())
    return [(dict(zip(FEATURES, map(float, values[1:]))), int(bad)) for values, bad in found]


def verdict(rules: list[Rule]) -> Column:
    """0 where no rule holds, else the number of the first that does, as an ordered conditional expression."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(rule.column(), i) if out is None else out.when(rule.column(), i)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the counts, base_failed, rule (the learned rule that rejects, 0 if none) and kept of each document.

    Null and empty texts have no words and fail; very long ones are read whole. Rules hold in their order, so there are no
    ties between them. Repeated rows and null ids are each judged; an empty table gives an empty result; extra columns are
    left out.
    """
    return statistics(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & (verdict(rules) == 0)).alias("kept"),
    )


def filter_documents(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that judge keeps, their columns unchanged."""
    kept = statistics(documents, whole=True).where(~base_failed() & (verdict(rules) == 0))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in documents.columns])


def quality(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return judge(documents, learn(labelled_rows(documents, labels, sample)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base verdict of op7_quality_rules alone, which SQL can check."""
    return judge(common.read_table(spark, sf_dir, "documents"), []).drop("kept")


QUERIES = {"op7_quality_rules": op7_quality_rules, "quality_counts": quality_counts}

ORACLE_SQL = {
    "quality_counts": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS lines FROM d),
windows AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS three FROM w WHERE len(words) >= 3),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS t(k) GROUP BY r),
counted AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (r))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM counted"""
}
