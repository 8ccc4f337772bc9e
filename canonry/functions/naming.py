"""Which spelling of a group makes the best name."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no identity.
STOPWORDS = ("the", "a", "an", "and", "of", "for", "to", "in", "on", "by", "from")
#: Scores of confidence letters, and where bands begin.
CONFIDENCE = {"h": 0.90, "m": 0.65, "l": 0.40}
UNKNOWN_CONFIDENCE, HIGH, MEDIUM = 0.50, 0.85, 0.55
LONGEST_PROPOSED = 200


def cleaned(literal: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(literal, r"[^\p{L}\p{N}\s&-]", " "), r"\s+", " "))


def tokens(clean: Column) -> Column:
    return F.array_remove(F.split(clean, " "), "")


def meaningful(tokens_: Column) -> Column:
    return F.filter(tokens_, lambda t: ~F.lower(t).isin(*STOPWORDS))


def signature(tokens_: Column) -> Column:
    """Weight of the distinct tokens, the earlier the heavier, saturating; 0 without tokens."""
    low = F.transform(tokens_, F.lower)
    kinds = F.array_distinct(low)
    total = F.aggregate(kinds, F.lit(0.0), lambda s, t: s + 0.75 + 0.25 / F.pow(F.array_position(low, t), F.lit(0.4)))
    return F.when(F.size(kinds) == 0, 0.0).otherwise(total / (total + 1.0 + 0.2 * (F.size(kinds) - 1.0)))


def cleanliness(literal: Column, tokens_: Column) -> Column:
    noise = F.size(tokens_) - F.size(meaningful(tokens_))
    by_token = F.when(F.size(tokens_) == 0, 1.0).otherwise(1 - noise / F.size(tokens_))
    odd = F.length(F.regexp_replace(literal, r"[a-zA-Z0-9\s&'-]", ""))
    return 0.5 * by_token + 0.5 * (1 - F.least(F.lit(0.5), odd / F.greatest(F.length(literal), F.lit(1))))


def length_sanity(clean: Column) -> Column:
    n = F.length(F.coalesce(clean, F.lit("")))
    return F.when(n < 2, 0.3).when(n <= 60, 1.0).when(n <= 100, 0.7).otherwise(0.4)


def name_scores(members: DataFrame, group: str, literal: str) -> DataFrame:
    """group, literal, name_score of distinct members. A token's support is its share of the group's members; counts are
    summed before any shuffle, so a large group is no more than its distinct tokens."""
    base = members.select(F.col(group).alias("group"), F.col(literal).alias("literal")).where(F.col("literal").isNotNull()).distinct()
    base = base.withColumn("clean", cleaned(F.col("literal"))).withColumn("std", tokens(F.col("clean"))).withColumn("norm", meaningful(F.col("std")))
    kinds = base.select("group", "literal", F.explode(F.array_distinct(F.transform("norm", F.lower))).alias("token"))
    support = kinds.groupBy("group", "token").agg(F.count("*").alias("df"))
    sizes = base.groupBy("group").agg(F.count("*").alias("members"))
    shares = kinds.join(support, ["group", "token"]).groupBy("group", "literal").agg((F.sum("df") / F.count("*")).alias("mean_df"))
    scored = base.join(shares, ["group", "literal"], "left").join(sizes, "group")
    mean = F.coalesce(F.col("mean_df") / F.col("members"), F.lit(0.0))
    score = F.sqrt(signature(F.col("norm")) * cleanliness(F.col("literal"), F.col("std")) * mean * length_sanity(F.col("clean")))
    return scored.select("group", "literal", score.alias("name_score"))


def best_names(scores: DataFrame, digits: int = 12) -> DataFrame:
    """group, literal, name_score: the highest score, then the shortest, then the first literal. One aggregate."""
    rounded = F.round("name_score", digits)
    return scores.groupBy("group").agg(F.min_by(F.struct("literal", "name_score"), F.struct(-rounded, F.length("literal"), "literal")).alias("b")).select("group", "b.literal", "b.name_score")


def is_acronym(literal: str) -> bool:
    letters = re.sub("[^a-zA-Z]", "", literal)
    return 2 <= len(letters) <= 5 and letters.isupper()


def display_case(literal: str) -> str:
    """Acronyms as they are; else each word of ASCII letters, digits and _ begins with a capital."""
    return literal if is_acronym(literal) else re.sub(r"\b\w", lambda m: m[0].upper(), literal.lower(), flags=re.ASCII)


def parse_tokens(value) -> list[str]:
    """A list, or JSON text of one, as trimmed strings; anything else gives none."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return []
    return [t for x in value if (t := str(x).strip())] if isinstance(value, (list, tuple)) else []


def proposed_name(name) -> str | None:
    """Trimmed and at most LONGEST_PROPOSED long; None if there is none or it has line breaks."""
    text = name.strip() if isinstance(name, str) else ""
    return None if not text or "\n" in text or "\r" in text else text[:LONGEST_PROPOSED]


def confidence(letter: str | None) -> float:
    return CONFIDENCE.get(letter or "", UNKNOWN_CONFIDENCE)


def band(score: float) -> str:
    return "h" if score >= HIGH else "m" if score >= MEDIUM else "l"


def band_column(score: Column) -> Column:
    return F.when(score >= HIGH, "h").when(score >= MEDIUM, "m").otherwise("l")


def confidence_column(letter: Column) -> Column:
    out = F.when(letter == "h", CONFIDENCE["h"]).when(letter == "m", CONFIDENCE["m"]).when(letter == "l", CONFIDENCE["l"])
    return out.otherwise(UNKNOWN_CONFIDENCE)


def worse(a: str, b: str) -> str:
    return max(a, b, key="hml".index)
