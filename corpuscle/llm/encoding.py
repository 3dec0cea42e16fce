"""Encoding a corpus with a public byte-level BPE vocabulary.

Method (speculate and verify): each pre-token is split greedily into the longest vocabulary entries; one
vectorised check over all adjacent pairs of a batch tells which proposals are what BPE would produce, and only
words with a failing pair are merged exactly.  A split is the BPE result iff every adjacent pair is: a pair is
compatible when, undoing the merges of both tokens from the latest to the earliest, no merge across their border
would have come before the merge undone.

Scale: a map over the scan without shuffle.  The vocabulary tables (three arrays, 50k entries) are the only thing
sent to the tasks.  Words are encoded once per task; the memo is emptied at ``MEMO`` words, which changes nothing
but speed.

Defined results: null, empty texts give an empty list; strings that look like special tokens are ordinary text;
lone surrogates cannot occur (Spark strings are UTF-8); extra columns are ignored, repeated rows are kept.
"""
from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table

VOCABULARIES = "/opt/tokenizers"
#: Splits a text into words; fixed value of this family of vocabularies.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 500_000
NONE = -1


def merge(word: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[int]:
    """Exact BPE of one word: always the adjacent pair of lowest rank, leftmost first; ``below`` stops at that rank."""
    n = len(word)
    end = list(range(1, n + 1))  # end[i]: where the piece that starts at i ends
    prev = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = ranks.get(word[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 1, i + 2))
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        r, i, mid, stop = heapq.heappop(heap)
        if below is not None and r >= below:
            break
        if not alive[i] or end[i] != mid or mid >= n or not alive[mid] or end[mid] != stop:
            continue
        end[i], alive[mid] = stop, 0
        if stop < n:
            prev[stop] = i
            q = ranks.get(word[i : end[stop]])
            if q is not None:
                heapq.heappush(heap, (q, i, stop, end[stop]))
        p = prev[i]
        if p >= 0:
            q = ranks.get(word[p:stop])
            if q is not None:
                heapq.heappush(heap, (q, p, i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Vocabulary:
    """Ranks plus, per token, the two tokens of its last merge (itself twice for a byte)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        usable = {}
        for tok, r in ranks.items():
            if len(tok) == 1:
                usable[tok] = r
                continue
            parts = merge(tok, ranks, below=r)
            if len(parts) == 2:  # else BPE never forms this entry
                self.left[r], self.right[r] = parts
                usable[tok] = r
        self._finish(usable)

    def _finish(self, usable: dict[bytes, int]) -> None:
        self.usable = usable
        self.size = len(self.left)
        made = np.array([r for t, r in usable.items() if len(t) > 1], dtype=np.int64)
        keys = self.left[made] * self.size + self.right[made]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[order], made[order]
        self.longest: dict[bytes, int] = {}
        for t in usable:
            self.longest[t[:2]] = max(self.longest.get(t[:2], 1), len(t))

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or a number above all ranks."""
        k = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, k), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == k, self.pair_ids[at], self.size + 1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does BPE keep their border?"""
        ok = np.ones(len(a), dtype=bool)
        idx = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), self.size, dtype=np.int64)  # merges from here on come too late to matter
        while len(idx):
            clash = self._merged(a, b) < limit
            ok[idx[clash]] = False
            # the later of the two last merges is undone next (the right token's on a tie); a byte has none
            can_a, can_b = self.left[a] != a, self.left[b] != b
            undo_a = can_a & (~can_b | (a > b))
            undo_b = can_b & ~undo_a
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            go = ~clash & (undo_a | undo_b)
            a, b = np.where(undo_a, self.right[a], a)[go], np.where(undo_b, self.left[b], b)[go]
            idx, limit = idx[go], limit[go]
        return ok

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, i, n, get = [], 0, len(word), self.usable.get
        while i < n:
            for j in range(min(n, i + self.longest.get(word[i : i + 2], 1)), i, -1):
                r = get(word[i:j])
                if r is not None:
                    break
            out.append(r)
            i = j
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode() for w in words]
        props = [self.propose(w) for w in raw]
        lens = np.fromiter(map(len, props), dtype=np.int64, count=len(props))
        flat = np.fromiter((t for p in props for t in p), dtype=np.int64, count=int(lens.sum()))
        owner = np.repeat(np.arange(len(props)), lens)
        inner = owner[1:] == owner[:-1]
        good = self.compatible(flat[:-1][inner], flat[1:][inner])
        for i in np.unique(owner[1:][inner][~good]).tolist():
            props[i] = merge(raw[i], self.ranks)
        return props


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Vocabulary:
    path = str(Path(folder) / f"{name}.tiktoken")
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(read_ranks(path))
    return _LOADED[path]


class Encoder:
    """Encodes texts, each distinct word once."""

    def __init__(self, vocab: Vocabulary):
        import regex

        self.vocab, self.find, self.memo = vocab, regex.compile(WORDS).findall, {}

    def __call__(self, texts: list[str | None]) -> Iterator[array]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        split = [self.find(t) if t else [] for t in texts]
        new = list({w for ws in split for w in ws if w not in memo})
        memo.update(zip(new, map(tuple, self.vocab.encode_words(new))) if new else ())
        for ws in split:
            ids = array("i")
            for w in ws:
                ids.extend(memo[w])
            yield ids


def _shared(spark: SparkSession, name: str, folder: str):
    return spark.sparkContext.broadcast(vocabulary(name, folder))


def encode(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, ids) of each row."""
    shared = _shared(df.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                flat, offsets = array("i"), [0]
                for ids in enc(part.column(1).to_pylist()):
                    flat.extend(ids)
                    offsets.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [key, "ids"])

    kind = dict(df.dtypes)[key]
    return spread(df.select(key, text)).mapInArrow(run, f"{key} {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, n_tokens) of each row, without shipping the ids."""
    shared = _shared(df.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                n = [len(ids) for ids in enc(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], [key, "n_tokens"])

    kind = dict(df.dtypes)[key]
    return spread(df.select(key, text)).mapInArrow(run, f"{key} {kind}, n_tokens bigint")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(table(spark, sf, "documents"), "doc_id", "text")


def p8_token_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and tokens per source and language."""
    docs = table(spark, sf, "documents")
    n = token_counts(docs, "doc_id", "text").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    lang = F.coalesce(F.split(F.lower("lang"), "[-_]")[0], F.lit("unknown"))
    return docs.select("doc_id", lang.alias("lang")).join(n, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


QUERIES = {"p8_ids": p8_ids, "p8_token_stats": p8_token_stats}
