"""Chat formatting at token level: segments are encoded on their own and joined by reserved ids.

A turn is  open(role) text close(role)  in ids, where open and close are ids beyond the vocabulary. Rendered, they are
the control strings below; those that occur inside a text are escaped before it is encoded, so that rendered output
can be parsed again, and reserved ids can come from nowhere but the template. Masks come from prefix sums over segment
lengths: +1 where an answer's ids begin, -1 where they end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

RESERVED = 60_000  # above every id of the vocabulary
#: Control strings by their number; their ids are RESERVED + number.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
OPEN = {"system": ("<<SYS>>",), "user": ("<s>", "[INST]"), "assistant": ()}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
ESCAPE = "␛"
LEARNED = "assistant"


def escape(text: str) -> str:
    """Reversible, and never shorter: an escape sign is doubled, and one is put after a control string's first sign."""
    out = text.replace(ESCAPE, 2 * ESCAPE)
    for control in CONTROLS:
        out = out.replace(control, control[0] + ESCAPE + control[1:])
    return out


def unescape(text: str) -> str:
    """Doubled signs come from the text, single ones from escape."""
    return ESCAPE.join(x.replace(ESCAPE, "") for x in text.split(2 * ESCAPE))


def reserved(control: str) -> int:
    return RESERVED + CONTROLS.index(control)


def segments(role: str, text: str, encoder: tokens.Encoder) -> list[tuple[np.ndarray, bool]]:
    """Ids of each segment of a turn, and whether its ids are to be learned. Roles outside the template are spelled out."""
    plain = lambda s: np.frombuffer(encoder.ids(escape(s)), "<u4")
    mark = lambda *controls: np.array([reserved(c) for c in controls], "u4")
    if role in CLOSE:
        return [(mark(*OPEN[role]), False), (plain(text), role == LEARNED), (mark(CLOSE[role]), False)]
    return [(mark("[ROLE]"), False), (plain(role), False), (mark("[/ROLE]"), False), (plain(text), False), (mark("</s>"), False)]


def assemble(parts: list[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and the mask of what is learned by a prefix sum of steps at the segments' ends."""
    ends = np.cumsum([len(ids) for ids, _ in parts])
    steps = np.zeros(ends[-1] + 1, "i4")
    for (ids, learned), end in zip(parts, ends):
        if learned:
            steps[end - len(ids)] += 1
            steps[end] -= 1
    return np.concatenate([ids for ids, _ in parts]), np.cumsum(steps)[:-1].astype("i1")


def turn_ids(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, turn, role, ids array<long>, mask array<byte> of each row. Null roles and texts count as empty."""
    path = path or tokens.vocabulary_path()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.worker(tokens.Encoder, path)
        for batch in batches:
            found = [assemble(segments(r if isinstance(r, str) else "", t if isinstance(t, str) else "", encoder)) for r, t in zip(batch["role"], batch["text"])]
            yield pd.DataFrame({"conv_id": batch["conv_id"], "turn": batch["turn"], "_role": batch["role"], "_text": batch["text"], "ids": [i.astype("i8") for i, _ in found], "mask": [m for _, m in found]})

    return common.documents_only(conversations, "conv_id", "turn", "role", "text").mapInPandas(encode, "conv_id long, turn long, _role string, _text string, ids array<bigint>, mask array<tinyint>")


class Reader:
    """Reads ids and masks back, part by part: turns, the learned text and the length of the rendered form."""

    def __init__(self, encoder: tokens.Encoder) -> None:
        self.core = encoder.core
        self.turns = self.loss_chars = self.formatted = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def text(self, ids: np.ndarray) -> str:
        """Of plain ids. The one special string's id isn't among the ranks."""
        runs = np.split(ids, np.flatnonzero(ids == tokens.SPECIAL_ID))
        raw = b"".join((tokens.SPECIAL.encode() if len(r) and r[0] == tokens.SPECIAL_ID else b"") + self.core.decode_bytes(r[1:].tolist() if len(r) and r[0] == tokens.SPECIAL_ID else r.tolist()) for r in runs)
        return raw.decode("utf-8", "surrogatepass")

    def turn(self, ids: np.ndarray, mask: np.ndarray) -> None:
        """One turn, from its opening to its closing ids."""
        at = np.flatnonzero(ids >= RESERVED)
        marks = [CONTROLS[i - RESERVED] for i in ids[at]]
        edges = [-1, *at, len(ids)]
        plain = [self.text(ids[a + 1 : b]) for a, b in zip(edges, edges[1:])]
        if marks[0] == "[ROLE]":
            role, text = unescape(plain[1]), unescape(plain[2])
        else:
            role = {v: k for k, v in CLOSE.items()}[marks[-1]]
            text = unescape(plain[-2])
        self.turns += 1
        self.formatted += sum(map(len, plain)) + sum(map(len, marks))
        self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        learned = unescape(self.text(ids[mask == 1]))
        self.loss_chars += len(learned)
        self.loss.update(learned.encode("utf-8", "surrogatepass"))

    def row(self, conv_id) -> tuple:
        return conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted


def digests(turns: DataFrame, path: str | None = None) -> DataFrame:
    """One row per conversation, read back from turn_ids' rows in their order.

    A conversation's hash follows its turns one by one; they pass through in sorted order, never gathered, whatever
    their number. Ties between turns go by role and text, repeated rows are turns of their own; a null conv_id is a
    conversation of its own. Very long texts are read whole, one at a time. An empty table gives an empty result.
    """
    path = path or tokens.vocabulary_path()
    ordered = turns.repartition(F.col("conv_id")).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("_role").asc_nulls_first(), F.col("_text").asc_nulls_first())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.worker(tokens.Encoder, path)
        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        table = lambda rows: pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64"})
        now, reader = None, None
        for batch in batches:
            done = []
            for conv, ids, mask in zip(batch["conv_id"].astype("Int64"), batch["ids"], batch["mask"]):
                conv = None if conv is pd.NA else int(conv)
                if reader is None or conv != now:
                    if reader is not None:
                        done.append(reader.row(now))
                    now, reader = conv, Reader(encoder)
                reader.turn(np.asarray(ids, "i8"), np.asarray(mask, "i1"))
            if done:
                yield table(done)
        if reader is not None:
            yield table([reader.row(now)])

    return ordered.drop("turn", "_role", "_text").mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def positions(turns: DataFrame) -> DataFrame:
    """Adds first, the number of a turn's first id in its conversation, by a prefix sum over the turns."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn", "_role", "_text").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("first", F.coalesce(F.sum(F.size("ids")).over(order), F.lit(0))).drop("_role", "_text")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    given = common.documents_only(common.read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return digests(turn_ids(given.unionByName(extra)))


QUERIES = {"op3_chat_format": op3_chat_format}
