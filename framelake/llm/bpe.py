"""Operator 4: byte-level BPE encoding and decoding, by batched numpy merge rounds."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from framelake.llm.text import small_batches, text_bytes

#: Fixed value: the split pattern of public byte-level BPE vocabularies.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Word pieces whose ids a task remembers; beyond it the memory starts afresh.
REMEMBERED = 200_000
#: Longer pieces are merged, but not remembered.
REMEMBERED_CHARS = 200
NONE = np.int64(1) << np.int64(60)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of one tokenizer file, as arrays ready for batched merging."""

    def __init__(self, definition: str):
        data = json.loads(definition)
        model, vocab = data["model"], dict(data["model"]["vocab"])
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        added = {x["content"]: x["id"] for x in data.get("added_tokens") or []}
        self.specials = added
        self.special_pattern = regex.compile("|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None
        ids = vocab | added
        self.size = max(ids.values()) + 1
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        pairs = [(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every adjacent pair, by binary search over the sorted pair keys; NONE where no merge exists."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word. The symbols of all words lie in one flat array. Each round finds every word's
        lowest-ranked pair and merges all its occurrences there, left to right; words without a pair leave."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        while len(symbols):
            rank = np.full(len(symbols), NONE)
            rank[:-1] = np.where(word[:-1] == word[1:], self.pair_ranks(symbols[:-1], symbols[1:]), NONE)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(word)))
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            if done.any():
                for a, n in zip(starts[done], sizes[done], strict=True):
                    out[word[a]] = symbols[a : a + n]
                stay = np.repeat(~done, sizes)
                symbols, word, rank, best = symbols[stay], word[stay], rank[stay], np.repeat(best[~done], sizes[~done])
            else:
                best = np.repeat(best, sizes)
            hit = np.flatnonzero((rank == best) & (rank != NONE))
            if not len(hit):
                continue
            # In a run of overlapping hits (aaa) every second one merges.
            run = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (word[hit[1:]] != word[hit[:-1]])]))
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            symbols, word = symbols[stay], word[stay]
        return out


class Encoder:
    """Encodes and decodes texts in one task, remembering the ids of frequent word pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, tuple[int, ...]] = {}

    def split(self, text: str) -> list[str]:
        """Word pieces; a special token is a piece of its own."""
        if self.v.special_pattern is None or not self.v.special_pattern.search(text):
            return SPLIT.findall(text)
        out, at = [], 0
        for m in self.v.special_pattern.finditer(text):
            out += SPLIT.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + SPLIT.findall(text[at:])

    def learn(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of the pieces that aren't known yet."""
        new = [p for p in pieces if p not in self.known]
        ids = self.v.merge_words([p.encode() for p in new])
        return {p: (self.v.specials[p],) if p in self.v.specials else tuple(x.tolist()) for p, x in zip(new, ids, strict=True)}

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        fresh = self.learn(set(chain.from_iterable(split)))
        self.known |= fresh
        out = [list(chain.from_iterable(map(self.known.__getitem__, pieces))) for pieces in split]
        for p in fresh:
            if len(p) > REMEMBERED_CHARS:
                del self.known[p]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.v.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def read_definition(spark: SparkSession, path: str) -> str:
    """The tokenizer file, through Spark's reader: any store will do."""
    return spark.read.text(path if "://" in path else f"file://{path}", wholetext=True).first()[0]


def _coded(definition, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(definition.value))
        for batch in batches:
            ids = encoder.encode_batch([(x or b"").decode("utf-8", "replace") for x in batch.column("text").to_pylist()])
            counts = np.array([len(x) for x in ids], np.int64)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            columns = [batch.column("doc_id"), pa.array(counts), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            if decode:
                columns.append(pa.array([encoder.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    return run


def bpe_encode(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """Token ids of every whole text by the byte-level BPE in the tokenizer file at `path`, in one pass without shuffle.

    Reads doc_id (any values; null and repeated ones pass through) and text; other columns are ignored. A null or
    empty text has no tokens. Special tokens' strings in a text become their ids; nothing is added, cut or padded.
    Returns doc_id, n_tokens, ids and, if asked, decoded (the text that the ids stand for; bytes that aren't UTF-8
    become U+FFFD). An empty table gives no rows. The vocabulary (1.5 MB, a fixed file) is broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    definition = spark.sparkContext.broadcast(read_definition(spark, path))
    schema = "doc_id long, n_tokens long, ids array<int>" + ", decoded string" * decode
    return text_bytes(docs).mapInArrow(_coded(definition, decode), schema)
