"""Removal of repeated byte strings, by prefix doubling from anchors.

Two positions share a string of ``length`` bytes exactly if the ranks of its two halves agree. Prefix doubling from
single bytes on would sort a row for each byte in every round; here the rounds below ``length / 2`` are done inside each
text, and most positions never become rows:

1. inside each text, where no other text is needed, a rolling hash names the ``length / 2`` bytes at every position:
   these names are the ranks that earlier rounds would have given. Each position's string is represented by its anchor,
   the least such name within it. Neighbouring positions share anchors, so there is one anchor for each quarter of
   ``length`` bytes;
2. Spark counts the anchors' names. A position whose anchor is unique is unique, and is out;
3. anchors that repeat are named anew by all bytes that their positions' strings cover. Where that name repeats as
   well, all its positions are repeats, and one of them stands for them from here on;
4. the others are tied. The round that passes the threshold: each tied position becomes a pair of its rank and the rank
   at the offset ``length / 2``, Spark sorts the pairs, and positions whose pairs are equal are repeats.

Ranks are hashes, so equality needs no numbering: 64 bits of the first half and 32 of the second, which are compared
among tied positions only.

Defined results: a null text is empty; texts shorter than ``length`` keep all bytes; matches never cross texts;
overlapping repeats inside one text count; repeated rows repeat each other; texts of any length are hashed in pieces of
bounded size; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.llm.common import flagged, forgotten, join_in_parts, maybe_member, small_batches, stored
from lumensift.llm.textbuf import BASE, BYTE_VALUE, INVERSE, PIECE, buffer_of, mixed, powers, releasing

#: Rows of one name and cover, from which on its join goes in parts.
HOT_COVER = 10_000

HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)

ANCHORS = "row long, name long, cover long, first int, last int"


def _totals(data: np.ndarray, base: int) -> np.ndarray:
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_VALUE[data] * powers(base, len(data)), out=out[1:])
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, anchor's name, name of the bytes covered, first position, last position) of each run of positions.

    Positions count from the start of their text. A run holds the positions whose strings have the same anchor.
    """
    n, gram = len(data), length // 2
    window = length - gram + 1
    k = n - length + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    fits = offsets[1:] - offsets[:-1] >= length
    if k <= 0 or not fits.any():
        return none
    total = _totals(data, BASE)
    m = n - gram + 1
    name = mixed((total[gram:] - total[:-gram]) * powers(INVERSE, n)[:m])
    key = (name & HIGH) | np.arange(m, dtype=np.uint64)  # the least, and of equal ones the first
    rows = np.concatenate([key, np.full(-m % window, ~np.uint64(0))]).reshape(-1, window)
    before = np.minimum.accumulate(rows, 1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(after[:k], before[window - 1 : window - 1 + k])
    begin, stop = offsets[:-1][fits], offsets[1:][fits] - length + 1
    change = np.zeros(k + 1, np.int8)  # 1 where a text's positions begin, -1 where they stop
    change[begin] += 1
    change[stop] -= 1
    valid = np.cumsum(change[:k]).astype(bool)
    new = np.ones(k, bool)
    new[1:] = least[1:] != least[:-1]
    new[begin] = True
    first = np.flatnonzero(new & valid)
    text = np.searchsorted(offsets, first, "right") - 1
    last = np.minimum(np.concatenate([first[1:], [k]]), offsets[text + 1] - length + 1) - 1
    cover = mixed((total[last + length] - total[first]) * powers(INVERSE, n)[first] + (last - first).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    at = (least[first] & LOW).astype(np.int64)
    return text, name[at], cover, first - offsets[text], last - offsets[text]


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, numbers of their texts, first position) of the batch in pieces of about PIECE positions.

    Texts go together while they are short; a longer one is cut into pieces that share length - 1 bytes, so that every
    position is in one of them. Runs of positions end with their piece; the strings that tie there are compared later.
    """
    sizes, begin = np.diff(offsets), 0
    while begin < len(sizes):
        if sizes[begin] > 2 * PIECE:
            own = data[offsets[begin] : offsets[begin + 1]]
            for at in range(0, max(len(own) - length + 1, 1), PIECE):
                part = own[at : at + PIECE + length - 1]
                yield part, np.array([0, len(part)]), np.array([begin]), at
            begin += 1
            continue
        end = begin + 1
        while end < len(sizes) and sizes[end] <= 2 * PIECE and offsets[end + 1] - offsets[begin] <= 2 * PIECE:
            end += 1
        yield data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin], np.arange(begin, end), 0
        begin = end


@releasing
def _anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffer_of(batch.column(1))
        for part, edges, numbers, at in _pieces(data, offsets, length):
            text, name, cover, first, last = anchors(part, edges, length)
            arrays = [batch.column(0).take(pa.array(numbers[text])), pa.array(name.view(np.int64)), pa.array(cover.view(np.int64)), pa.array((first + at).astype(np.int32)), pa.array((last + at).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "name", "cover", "first", "last"])


def pairs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each position that has ``length`` bytes, and the rank at half the length behind it (32 bits of it)."""
    half = length // 2
    total = _totals(data, BASE)
    names = mixed((total[half:] - total[:-half]) * powers(INVERSE, len(data))[: len(data) - half + 1])
    n = len(data) - length + 1
    return names[:n].view(np.int64), (names[half : half + n] >> np.uint64(32)).astype(np.uint32).view(np.int32)


@releasing
def _tied(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Of each text its tied positions as rows: pairs of ranks."""
    names = ["row", "start", "alone", "a", "b"]
    for batch in batches:
        for row, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            out = []
            for w in wanted:
                a, b = pairs(data[w["first"] : w["last"] + length], length)
                out.append((np.arange(w["first"], w["last"] + 1, dtype=np.int32), np.full(len(a), w["alone"]), a, b))
            start, alone, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            for at in range(0, len(start), PIECE):  # a bounded batch of rows, however long the text is
                cut = slice(at, at + PIECE)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start[cut]), row)), pa.array(start[cut]), pa.array(alone[cut]), pa.array(a[cut]), pa.array(b[cut])], names=names)


@releasing
def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their pairs those whose pair another row has, and that stand for themselves: (row, start)."""
    held = None  # the last row, whose pair the next batch may repeat: its columns, and whether a row before has its pair
    for batch in batches:
        if not batch.num_rows:
            continue
        row, start, alone, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        if held is not None:
            row, start, alone, a, b = (np.concatenate([[h], x]) for h, x in zip(held[0], (row, start, alone, a, b), strict=True))
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        before = np.concatenate([[held is not None and held[1]], same])
        hit = before | np.concatenate([same, [False]])
        hit = hit[:-1] & alone[:-1].astype(bool)
        held = ((row[-1], start[-1], alone[-1], a[-1], b[-1]), bool(before[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(row[:-1][hit], pa.int64()), pa.array(start[:-1][hit], pa.int32())], names=["row", "start"])
    if held is not None and held[1] and held[0][2]:
        yield pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int64()), pa.array([held[0][1]], pa.int32())], names=["row", "start"])


@releasing
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, [s["start"] for s in spans], 1)
            np.add.at(edge, [s["stop"] for s in spans], -1)
            gone = np.cumsum(edge[:-1]) > 0
            out["n_bytes"].append(len(data))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(data) else 0)
            out["kept"].append(data[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.binary())], names=["doc_id", *out])


def _of_covers(tied: DataFrame, covers: DataFrame) -> DataFrame:
    """The runs whose name and cover another run has. Hot covers are joined in parts: a copy of very many texts is no hot key."""
    keys = ["name", "cover"]
    return join_in_parts(tied, covers.where("n > 1").select(*keys), keys, covers.where(F.col("n") >= HOT_COVER), F.xxhash64("row", "first"), "left_semi")


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(row, start, stop): bytes start to stop of the text are covered by repeats. docs: (row, text), row one per text."""
    runs = stored(docs.mapInArrow(partial(_anchors, length=length), ANCHORS), "suffix-anchors")
    again = stored(runs.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"), "suffix-names")
    tied = maybe_member(runs, "name", again, 1 << 26).join(again, "name", "left_semi")
    tied = stored(tied, "suffix-tied")
    forgotten(runs, again)
    covers = tied.groupBy("name", "cover").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "first", "last")).alias("one"))
    covers = stored(covers, "suffix-covers")
    whole = _of_covers(tied, covers)
    whole = whole.select("row", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    # names with several covers, of which one occurs once: only those may hold more repeats
    several = covers.groupBy("name").agg(F.count(F.lit(1)).alias("covers"), F.min("n").alias("least")).where("covers > 1 and least = 1").select("name")
    open_ = covers.join(several, "name").select("one.row", F.struct("one.first", "one.last", (F.col("n") == 1).alias("alone")).alias("wanted"))
    wanted = open_.groupBy("row").agg(F.collect_list("wanted").alias("wanted"))  # at most one for each quarter of length bytes of a text
    texts = maybe_member(docs, "row", wanted.select("row"), 1 << 24).dropDuplicates(["row"]).join(wanted, "row").select("row", "text", "wanted")
    ranked = texts.mapInArrow(partial(_tied, length=length), "row long, start int, alone boolean, a long, b int")
    # by both ranks: a passage that very many texts share gives many keys of as many rows as it has versions
    ranked = ranked.repartition("a", "b").sortWithinPartitions("a", "b")
    hit = ranked.mapInArrow(_repeated, "row long, start int")
    spans = stored(whole.unionByName(hit.select("row", "start", (F.col("start") + length).cast("int").alias("stop"))), "suffix-spans")
    forgotten(tied, covers)
    return spans


def _named(docs: DataFrame) -> DataFrame:
    """docs with row: a hash of identifier and text, the same for repeated rows only. Among very many rows some differ and
    share a hash; a second hash shows these, and they get another one."""
    name = lambda salt: F.xxhash64(F.lit(salt), "doc_id", "text")
    shared = docs.select(name(0).alias("row"), name(1).alias("other")).groupBy("row").agg(F.min("other").alias("least"), F.max("other").alias("most"))
    shared = stored(shared.where("least <> most").select("row"), "suffix-shared")
    docs = docs.withColumn("row", name(0))
    if shared.isEmpty():
        return docs
    both = docs.join(shared.withColumn("_shared", F.lit(True)), "row", "left")
    return both.withColumn("row", F.when(F.col("_shared"), name(2)).otherwise(F.col("row"))).select("doc_id", "text", "row")


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row; kept: the bytes that stay, which may end inside a character."""
    if length < 4 or length % 2:
        raise ValueError("length must be an even number of bytes, 4 at least")
    small_batches(docs.sparkSession, 256)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = _named(docs)
    spans = repeated_spans(docs.select("row", "text"), length)
    by_row = stored(spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "suffix-by-row")
    forgotten(spans)
    spans = by_row
    seen = flagged(docs, "row", spans)
    size = F.octet_length("text").cast("long")
    whole = lambda df: df.select("doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    hit = seen.where("_maybe").join(spans, "row", "left")
    hit = hit.withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,stop:int>>)")))
    cut = hit.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return whole(seen.where("not _maybe")).unionByName(cut)
