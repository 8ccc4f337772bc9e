"""Token ids and exact token counts at every prefix of a text, for a byte-level BPE vocabulary.

Byte-level BPE has a property that allows dynamic programming: a row of tokens is the encoding of its text if and
only if each token encodes to itself and each neighbouring pair encodes to that pair. So the encoding of a prefix
ends in exactly one token that fits the encoding of what stands before it, and count[i] = count[i - len(last)] + 1.

Texts are parted at single spaces between other characters. No token crosses such a place, so what stands between
two of them is worked out once and kept; parts that begin or end with white space are worked out in their text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from . import common

VOCABULARY = "byte_bpe_50k"
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Entries of each of two generations of kept parts, in each Python worker.
KEPT = 200_000
LONGEST_KEPT = 64
PAIRS = 1_000_000
#: Characters on whose class (letter, number, space) all Unicode versions in use agree; others are asked of the library.
PLAIN = regex.compile(r"[\x00-\x1b\x20-\x84\x86-ɏЀ-ҁҊ-ԯ‐-‧‰-⁞ぁ-ゖ一-龥가-힣\U0001f300-\U0001f5ff]*")
CONTRACTIONS = {"'re": 3, "'ve": 3, "'ll": 3}


class Kept(dict):
    """Results of make by key, in two generations; the older one goes when the newer is full."""

    def __init__(self, make, limit: int = KEPT) -> None:
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key, self)
        if value is self:
            value = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Likeness(dict):
    """A plain character of the same class for each character, as the library's own splitting into pieces tells."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if PLAIN.fullmatch(char):
            self[code] = char
        else:
            split = self.tokenizer().pre_tokenizer.pre_tokenize_str
            self[code] = next((c for c in "a0#" if len(split(c + char)) == 1), "\t")
        return self[code]


def crosses(part: str) -> bool:
    """Whether white space at an end of the part, or none in it, lets a token depend on its neighbours."""
    return not part or part[0].isspace() or part[-1].isspace()


def is_word(body: str) -> bool:
    """Whether it is a run of Latin letters, and so a single piece, with a space before it or not."""
    return body.isalpha() and max(body) < "\u0250"


class Encoder:
    """Ids of texts. path: of the vocabulary, without its ending; the .json and the .tiktoken file hold the same."""

    def __init__(self, path: str) -> None:
        with open(f"{path}.tiktoken", "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.json, self.whole = f"{path}.json", None
        self.like = Likeness(self.tokenizer)
        self.core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.after, self.first = Kept(lambda part: self.part(" " + part)), Kept(self.part)

    def tokenizer(self):
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.json)
        return self.whole

    def library(self, text: str) -> list[int]:
        return self.tokenizer().encode(text, add_special_tokens=False).ids

    def shape(self, text: str) -> str:
        """The text with plain characters of the same class for all others: the library parts both at the same places."""
        return text if PLAIN.fullmatch(text) else text.translate(self.like)

    def part(self, part: str) -> bytes | None:
        """None: the whole text must be encoded in one."""
        body = part.removeprefix(" ")
        if is_word(body):
            return array("I", self.core._encode_single_piece(part)).tobytes()
        if crosses(body) or not PLAIN.fullmatch(body):
            return None
        return array("I", self.core.encode_ordinary(part)).tobytes()

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids. Null counts as empty."""
        if not text:
            return b""
        if SPECIAL in text:
            return np.uint32(SPECIAL_ID).tobytes().join([self.ids(x) for x in text.split(SPECIAL)])
        first, *rest = text.split(" ")
        try:
            return self.first[first] + b"".join(map(self.after.__getitem__, rest))
        except TypeError:  # a None among them
            if PLAIN.fullmatch(text):
                return self.core.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            return np.array(self.library(text), "<u4").tobytes()


class PrefixCounter:
    """Token counts at every prefix, by dynamic programming over the vocabulary."""

    def __init__(self, path: str) -> None:
        self.encoder = Encoder(path)
        self.ranks, self.single = self.encoder.ranks, self.encoder.core._encode_single_piece
        self.text_of = {i: t for t, i in self.ranks.items()}
        self.ending = ahocorasick.Automaton()  # all tokens that end at a place, the longest first
        for text, token in self.ranks.items():
            self.ending.add_word(text.decode("latin-1"), (token, len(text)))
        self.ending.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.piece = Kept(self.piece_counts)
        self.after, self.first = Kept(lambda part: self.part(" " + part), 2 * KEPT), Kept(self.part)

    def fits(self, before: int, token: int) -> bool:
        """Whether the two tokens' text is encoded as these two."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        self.pairs[before << 20 | token] = found = self.single(self.text_of[before] + self.text_of[token]) == [before, token]
        return found

    def stands(self, token: int) -> bool:
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = self.single(self.text_of[token]) == [token]
        return known

    def byte_counts(self, piece: bytes) -> list[int]:
        """count[i] of tokens of piece[:i], for a piece that isn't split before BPE."""
        count, last, done, pairs = [0], [-1], 0, self.pairs
        for at, (token, length) in self.ending.iter(piece.decode("latin-1")):
            if at < done:  # this prefix has its last token
                continue
            start = at + 1 - length
            if start:
                fits = pairs.get(last[start] << 20 | token)
                if fits is None:
                    fits = self.fits(last[start], token)
            else:
                fits = self.stands(token)
            if fits:
                count.append(count[start] + 1)
                last.append(token)
                done = at + 1
        if done != len(piece):
            raise ValueError("the vocabulary lacks a single byte")
        return count

    def piece_counts(self, piece: str) -> tuple[int, ...]:
        """count[i] of tokens of piece[:i] by code points, from i = 1, if what is cut off stays one piece."""
        if piece in CONTRACTIONS:  # cut short, it is an apostrophe and a letter
            return (1, 2, len(self.single(piece.encode())))
        count = self.byte_counts(piece.encode("utf-8"))
        if len(count) == len(piece) + 1:
            return tuple(count[1:])
        return tuple([count[e] for e in accumulate([len(c.encode("utf-8")) for c in piece])])

    def counts(self, text: str) -> list[int]:
        """Tokens of text[:i] for i = 1...; text holds no special string."""
        out: list[int] = []
        base = at = 0
        shape = self.encoder.shape(text)
        shapes = self.encoder.pieces(shape)
        pieces = shapes if shape is text else [text[a : a + len(x)] for a, x in zip(accumulate(map(len, shapes), initial=0), shapes)]
        while at < len(pieces):
            piece, kind = pieces[at], shapes[at]
            if kind.isspace():  # a run may end in a space that belongs to the next piece; cut inside, it is one piece
                run, at = piece, at + 1
                while at < len(pieces) and shapes[at].isspace():
                    run, at = run + pieces[at], at + 1
                joined = at < len(pieces) and shapes[at][0] == " "
                inner = self.piece[run + " " if joined else run]
                out += [base + c for c in inner[: len(run)]]
                if at < len(pieces):  # all but the run's last character is one piece, then its last
                    head, tail = (run, "") if joined else (run[:-1], run[-1])
                    base += (self.piece[head][-1] if head else 0) + (self.piece[tail][-1] if tail else 0)
                    if joined:  # the space itself, as long as nothing follows it
                        out.append(out[-1] - inner[len(run) - 1] + inner[len(run)])
                        out += [base + c for c in self.piece[pieces[at]][1:]]
                        base += self.piece[pieces[at]][-1]
                        at += 1
                continue
            inner = self.piece[piece]
            out += [base + c for c in inner]
            base += inner[-1]
            at += 1
        return out

    def part(self, part: str) -> tuple[bytes, int] | None:
        """Steps and their sum; None: the whole text must be counted in one."""
        body = part.removeprefix(" ")
        if is_word(body):
            count = self.piece[part]
        elif crosses(self.encoder.shape(body)):
            return None
        else:
            count = self.counts(part)
        steps = [b - a for a, b in zip((0, *count), count)]
        if max(steps) > 127 or min(steps) < -128:
            return None
        return array("b", steps).tobytes(), count[-1]

    def steps(self, text: str | None) -> tuple[np.ndarray, int]:
        """Steps of the count from each code point to the next, whose running sum is the count at every prefix; and the
        count of the whole text."""
        if not text:
            return np.zeros(0, "i1"), 0
        if SPECIAL in text:
            before, after = text.split(SPECIAL, 1)
            open_, _ = self.steps(before + SPECIAL[:-1])
            rest, more = self.steps(after)
            count = int(open_[: len(before)].sum(dtype="i8")) + 1
            return np.concatenate([open_.astype("i4"), [count - open_.sum(dtype="i8")], rest]).astype("i4"), count + more
        first, *others = text.split(" ")
        try:
            parts = [self.first[first], *map(self.after.__getitem__, others)]
            return np.frombuffer(b"".join([p[0] for p in parts]), "i1"), sum([p[1] for p in parts])
        except TypeError:  # a None among them
            counts = self.counts(text)
            return np.diff(counts, prepend=0).astype("i4"), counts[-1]

    def prefix_counts(self, text: str | None) -> np.ndarray:
        return np.cumsum(self.steps(text)[0], dtype="i8")


def longest_fit(steps: np.ndarray, total: int, limit: int) -> int:
    """Code points of the longest prefix with at most limit tokens, from the stored steps."""
    if total <= limit:
        return len(steps)
    fit = np.flatnonzero(np.cumsum(steps, dtype="i8") <= limit)
    return int(fit[-1]) + 1 if len(fit) else 0


_made: dict[tuple[type, str], object] = {}


def worker(kind: type, path: str):
    """One encoder or counter for each Python worker, with what it has kept."""
    if (kind, path) not in _made:
        _made[(kind, path)] = kind(path)
    return _made[(kind, path)]


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(f"{name}.json").removesuffix(".json")


def token_counts(documents: DataFrame, limit: int = 512, path: str | None = None, prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fits of each document, all from the counts at its prefixes; fits: code
    points of the longest prefix with at most limit tokens. prefixes: also return steps, array<int> of the count's steps
    from code point to code point, whose running sum is the count at every prefix.

    Null and empty texts have no bytes and no tokens, and fit whole. Very long texts are counted whole, in time and memory
    that grow with their length. Repeated rows and null ids are each answered. An empty table gives an empty result.
    Extra columns are left out.
    """
    path = path or vocabulary_path()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = worker(PrefixCounter, path)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            stored = [counter.steps(t) for t in texts]
            out = pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": [total for _, total in stored]})
            out["over_limit"] = out["n_tokens"] > limit
            out["fits"] = [longest_fit(steps, total, limit) for steps, total in stored]
            if prefixes:
                out["steps"] = [steps.astype("i4") for steps, _ in stored]
            yield out

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits long" + ", steps array<int>" * prefixes
    return common.documents_only(documents, "doc_id", "text").mapInPandas(count, schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.read_table(spark, sf_dir, "documents"))


QUERIES = {"op8_token_counts": op8_token_counts}
