"""Near duplicates by SimHash, found through a segment-popcount embedding.

A fingerprint of 64 bits is mapped to the number of set bits in each of its segments. Flipping a bit moves one
coordinate by one, so the Manhattan distance of two such points is a lower bound of the fingerprints' Hamming distance.
Points at distance 2 or less have a common neighbour at distance 1 or less from both; so each fingerprint is put into
the unit grid's cells around its point, and what shares a cell is compared exactly. A cell with more fingerprints than
`crowd` isn't compared pair by pair: its fingerprints go to the finest embedding, segments of a single bit, where the
Manhattan distance is the Hamming distance and all that share a cell are within distance 2 of the cell's own centre's
neighbours, hence of each other; there links to the smallest member suffice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, SEED, DISTANCE = 3, 42, 2
SEGMENTS = 16
CROWD = 64


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned. A bit is set if it is in over half the hashes of the text's shingles; no words give zero."""
    words = common.split_words(text)
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)])) if len(words) >= width else [b" ".join(words)]
    total, counts = 0, np.zeros(64, "i8")
    hash_ = xxhash.xxh64_intdigest
    hashes = np.fromiter((hash_(s, seed) for s in shingles), "u8")
    for at in range(0, len(hashes), 1 << 14):  # bits of a long text in bounded memory
        block = hashes[at : at + (1 << 14)]
        bits = np.unpackbits(block.astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype="i8")
        total += len(block)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, tkey (of the text), fp (signed long) of every document; null texts count as empty."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t if isinstance(t, str) else None, width, seed) for t in batch["text"]], "u8")
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tkey": batch["tkey"], "fp": fp.view("i8")})

    return common.documents_only(documents, "doc_id", "text").withColumn("tkey", common.text_key()).mapInPandas(each, "doc_id long, tkey long, fp long")


def segment_counts(fp: Column, segments: int) -> list[Column]:
    width = 64 // segments
    mask = (1 << width) - 1
    return [F.bit_count(F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit(mask).cast("long"))) for i in range(segments)]


def coordinate_bits(segments: int) -> int:
    bits = (64 // segments).bit_length()  # a coordinate runs from 0 to a segment's width
    if bits * segments > 64:
        raise ValueError("a cell's coordinates must fit into 64 bits")
    return bits


def point(fp: Column, segments: int) -> Column:
    """The fingerprint's place in the embedding: its segments' counts of set bits, side by side in a long."""
    bits, out = coordinate_bits(segments), F.lit(0).cast("long")
    for i, c in enumerate(segment_counts(fp, segments)):
        out = out.bitwiseOR(F.shiftleft(c.cast("long"), bits * i))
    return out


def cells(prints: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """fp, cell: the grid cells at Manhattan distance 1 or less from the fingerprint's point."""
    width, bits = 64 // segments, coordinate_bits(segments)
    counts = segment_counts(F.col("fp"), segments)
    out = prints.select("fp", point(F.col("fp"), segments).alias("point"), F.array(*[c.cast("byte") for c in counts]).alias("counts"))
    steps = [F.lit(0).cast("long")]
    for i in range(segments):
        one = F.lit(1 << bits * i).cast("long")
        steps += [F.when(F.col("counts")[i] < width, one), F.when(F.col("counts")[i] > 0, -one)]
    moved = out.select("fp", "point", F.explode(F.array(*steps)).alias("step")).where(F.col("step").isNotNull())
    return moved.select("fp", (F.col("point") + F.col("step")).alias("cell"))


def crowded_links(crowded: DataFrame) -> DataFrame:
    """Links a, b (a < b) that connect whatever crowded fingerprints are at distance 2 or less, through one-bit cells."""
    flips = [F.lit(0).cast("long")] + [F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]
    near = crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(b) for b in flips])).alias("cell"))
    least = near.groupBy("cell").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return near.join(least, "cell").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Links a, b (a < b) that connect exactly the distinct fingerprints whose Hamming distances are distance or less.

    prints: a column fp of distinct fingerprints. distance: 2 at most.
    """
    if distance > 2:
        raise ValueError("cells at distance 1 meet at distance 2 or less")
    grid = cells(prints, segments)
    sizes = grid.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = common.cut(grid.join(sizes, "cell"))
    few = shared.where(F.col("n") <= crowd).groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("fps"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
            for fps in batch["fps"]:
                one = np.asarray(fps, "i8")
                i, j = np.triu_indices(len(one), 1)
                near = np.bitwise_count((one[i] ^ one[j]).view("u8")) <= distance
                a.append(one[i[near]])
                b.append(one[j[near]])
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    found = few.select("fps").mapInPandas(compare, "a long, b long")
    crowded = shared.where(F.col("n") > crowd).select("fp").distinct()
    if distance == 2:
        return found.unionByName(crowded_links(crowded)).distinct()
    # nearer than the cells' reach: flips meet the other fingerprint itself
    flips = [F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64 * distance)]
    near = crowded.select(F.col("fp").alias("a"), F.explode(F.array(F.lit(None).cast("long"), *[F.col("fp").bitwiseXOR(x) for x in flips])).alias("b"))
    exact = near.where("a < b").join(crowded.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b")
    return found.unionByName(exact).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of each node that has a link: the smallest of its component, by alternating large and small stars.

    Both stars only take a minimum for each node, summed up before the shuffle, so that no node's links meet in a task.
    The stars never add links, so that a round's steps have tasks by the links there are: few links write few files.
    """
    links_ = common.cut(edges.select("a", "b").where("a <> b").distinct())
    rows = links_.count()
    links_ = common.fitted(links_, rows)
    while True:  # the stars settle in about the square of the logarithm of the nodes
        both = links_.unionByName(links_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b")
        large = common.fitted(common.fitted(large, rows).distinct(), rows)
        # small star: each node's links to smaller ones, and itself, to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"), F.lit(0).alias("_"))
        small = common.fitted(small.select("e.a", "e.b").where("a <> b"), 2 * rows)
        after = common.cut(common.fitted(small.distinct(), rows))
        left = after.count()
        same = left == rows and after.exceptAll(links_).isEmpty()
        links_, rows = after, left
        if same:
            return links_.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(links_.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def grouped(documents: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """doc_id, tkey, fp, root (a fingerprint) and component_id of every document."""
    prints = common.cut(fingerprints(documents))
    distinct = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    reach = components(links(distinct.select("fp"), distance, segments, crowd))
    linked = common.cut(distinct.join(reach, distinct["fp"] == reach["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = linked.join(roots, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    return prints.join(labels, prints["fp"] == labels["_fp"]).select("doc_id", "tkey", "fp", "root", "component_id")


def near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links, of each document.

    Documents without words, null texts among them, have fingerprint zero and are linked like any other. Very long texts
    are read whole, in bounded memory. Repeated rows are each answered. A null doc_id is no candidate for the smallest; a
    component of null ids alone has a null component_id. An empty table gives an empty result. Extra columns are left out.
    """
    return grouped(documents, **options).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """The documents without those whose fingerprints are near, whatever their texts: common.first_of_each of the
    components, row by row, null ids too."""
    return common.first_of_each(documents, common.cut(grouped(documents, **options).select("doc_id", "tkey", "root")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read_table(spark, sf_dir, "documents"))


QUERIES = {"op2_simhash": op2_simhash}
