"""Language-model scores by stupid backoff, computed relationally.

Texts become blocks of some megabytes: the block's distinct words and its texts as numbers of them. From each block the
distinct n-grams, already counted within it, go to count tables that are partitioned by the n-grams' hash (64 bits).
There the counts of all blocks are summed, and the totals are joined to the block's n-grams again; a hot n-gram is one
entry of each block. Each block then scores its texts from totals of its own n-grams, and sums per document.

A text is scored by what the other rows hold: its own counts are taken off. With ``c`` the counts that remain, ``N``
the words that remain, and ``A`` = 0.4, a word w after u has

    c(u w) / c(u)        if c(u w) > 0,
    A * c(w) / N         else, if c(w) > 0,
    A * A / max(N, 1)    else,

and a text's first word starts at the second line. The score is the sum of logarithms.

Defined results: null, empty and blank texts have no words and score 0; repeated rows are rows of their own, so each
is known to the other; texts of any length are counted whole, a block holds one at least; an empty table gives an empty result;
further columns are not read. Words are runs of other
characters than ASCII white space, with A-Z as a-z.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.llm.common import small_batches, stored
from lumensift.llm.textbuf import buffer_of, mixed, releasing, word_hashes

BACKOFF = 0.4
#: Bytes of text in a block, and words of all blocks in a partition of the count tables, about.
BLOCK_BYTES = 8 << 20
PARTITION_WORDS = 4_000_000
#: Blocks that a task scores, about.
BLOCKS_A_TASK = 4

BLOCKS = "block long, docs array<long>, sizes binary, words binary, tokens binary, n long"


def _planes(x: np.ndarray) -> bytes:
    """Bytes of the integers, all first bytes first and so on: sorted and small ones compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _packed(x: np.ndarray) -> bytes:
    """Totals as planes of as many bytes as they need, which the first byte tells."""
    kind = np.uint32 if not len(x) or x.max() < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + _planes(x.astype(kind))


def _unpacked(data: bytes) -> np.ndarray:
    return _from_planes(data[1:], np.uint64 if data[0] == 8 else np.uint32).astype(np.int64)


def _block(parts: list[tuple]) -> pa.RecordBatch:
    words, tokens = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    docs = [d for p in parts for d in p[0]]
    sizes = np.concatenate([p[2] for p in parts]).astype(np.uint32)
    name = int.from_bytes(os.urandom(8), "little", signed=True)  # blocks are stored at once, and never made again
    row = [[name], [docs], [sizes.tobytes()], [words.tobytes()], [_planes(tokens.astype(np.uint32))], [len(tokens)]]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["block", "docs", "sizes", "words", "tokens", "n"])


@releasing
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = buffer_of(batch.column(1))
        h, own = word_hashes(data, offsets)
        parts.append((batch.column(0).to_pylist(), h, np.bincount(own, minlength=batch.num_rows)))
        held += len(data)
        if held >= BLOCK_BYTES:
            yield _block(parts)
            parts, held = [], 0
    if parts:
        yield _block(parts)


class Block:
    """One row of BLOCKS with its n-grams in the order in which they are sent and answered."""

    def __init__(self, sizes: bytes, words: bytes, tokens: bytes):
        self.sizes = np.frombuffer(sizes, np.uint32).astype(np.int64)
        self.words = np.frombuffer(words, np.uint64)
        self.tokens = _from_planes(tokens, np.uint32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.counts = np.bincount(self.tokens, minlength=len(self.words))
        # each word but a text's first has the one before as its history
        self.after = np.ones(len(self.tokens), bool)
        self.after[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = False
        at = np.flatnonzero(self.after)
        pair = self.tokens[at - 1] * max(len(self.words), 1) + self.tokens[at]
        pairs, which, count = np.unique(pair, return_inverse=True, return_counts=True)
        h = mixed(mixed(self.words[pairs // max(len(self.words), 1)]) * np.uint64(3) + self.words[pairs % max(len(self.words), 1)]) if len(pairs) else np.zeros(0, np.uint64)
        order = np.argsort(h)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair_hash, self.pair_counts, self.pair = h[order], count[order], place[which]

    def ordered(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(n, sorted hashes, counts) of the words and of the pairs."""
        return [(1, self.words, self.counts), (2, self.pair_hash, self.pair_counts)]


@releasing
def _grams(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(part, n, block, hashes, counts): the distinct n-grams of a block by the first bits of their hash."""
    for batch in batches:
        for name, sizes, words, tokens in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            out = {"part": [], "n": [], "block": [], "hashes": [], "counts": []}
            for n, h, count in Block(sizes, words, tokens).ordered():
                edge = np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
                edge = np.append(edge, len(h))
                for part in np.flatnonzero(np.diff(edge)):
                    cut = slice(edge[part], edge[part + 1])
                    out["part"].append(int(part))
                    out["n"].append(n)
                    out["block"].append(name)
                    out["hashes"].append(_planes(h[cut]))
                    out["counts"].append(_planes(count[cut].astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(out["part"], pa.int32()), pa.array(out["n"], pa.int32()), pa.array(out["block"], pa.int64()), pa.array(out["hashes"], pa.binary()), pa.array(out["counts"], pa.binary())], names=list(out))


def _total(rows: pa.Table) -> pa.Table:
    """Of one part of a count table: to each block's n-grams their totals over all blocks."""
    hashes = [_from_planes(x, np.uint64) for x in rows.column("hashes").to_pylist()]
    counts = [_from_planes(x, np.uint32) for x in rows.column("counts").to_pylist()]
    every, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, at, np.concatenate(counts).astype(np.int64))
    total = total[at]
    ends = np.cumsum([len(h) for h in hashes])
    answers = [_packed(x) for x in np.split(total, ends[:-1])]
    return pa.table({"part": rows.column("part"), "n": rows.column("n"), "block": rows.column("block"), "totals": pa.array(answers, pa.binary())})


def _within(doc: np.ndarray, gram: np.ndarray, grams: int) -> np.ndarray:
    """How often the n-gram at each place is in that place's text."""
    _, at, count = np.unique(doc * max(grams, 1) + gram, return_inverse=True, return_counts=True)
    return count[at]


@releasing
def _scores(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs, *own, answers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            b = Block(*own)
            totals = {}
            for n, size in ((1, len(b.words)), (2, len(b.pair_hash))):
                parts = sorted((a["part"], a["totals"]) for a in answers or [] if a["n"] == n)
                totals[n] = np.concatenate([_unpacked(x) for _, x in parts]) if parts else np.zeros(0, np.int64)
                assert len(totals[n]) == size
            word = totals[1][b.tokens] - _within(b.doc, b.tokens, len(b.words))
            rest = np.maximum(words - b.sizes[b.doc], 1).astype(float)
            score = np.where(word > 0, BACKOFF * word / rest, BACKOFF * BACKOFF / rest)
            at = np.flatnonzero(b.after)
            both = totals[2][b.pair] - _within(b.doc[at], b.pair, len(b.pair_hash))
            known = both > 0
            score[at[known]] = both[known] / word[at[known] - 1]
            sums = np.bincount(b.doc, np.log(score), minlength=len(docs))
            backed = b.sizes - np.bincount(b.doc[at[known]], minlength=len(docs))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(b.sizes), pa.array(sums.astype(float)), pa.array(backed.astype(np.int64))], names=["doc_id", "n_words", "log_score", "n_backoff"])


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_score, n_backoff) per row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = stored(rows.mapInArrow(_blocks, BLOCKS), "ngrams-blocks")
    words, n_blocks = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    bits = max(4, (words // PARTITION_WORDS).bit_length())
    grams = blocks.select("block", "sizes", "words", "tokens").mapInArrow(partial(_grams, bits=bits), "part int, n int, block long, hashes binary, counts binary")
    # about a part of a table for each task
    totals = grams.repartition(2 << bits, "n", "part").groupBy("n", "part").applyInArrow(_total, "part int, n int, block long, totals binary")
    # a few blocks in each task, however many there are
    tasks = max(1, -(-n_blocks // BLOCKS_A_TASK))
    answers = totals.repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("n", "part", "totals")).alias("answers"))
    both = blocks.repartition(tasks, "block").join(answers, "block", "left").select("docs", "sizes", "words", "tokens", "answers")
    return both.mapInArrow(partial(_scores, words=words), "doc_id long, n_words long, log_score double, n_backoff long")
