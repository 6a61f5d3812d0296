"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes of a text proposes cuts, so that a passage that several documents share is cut alike in
each of them. The tokenizer encodes a chunk once and its ids are remembered for all documents of a task (a cache that is
bounded in bytes). A cut may fall inside a word, so every join of two chunks is repaired: the last words before it and
the first ones after it are encoded again as one string. The join is right where that string's ids agree with both
chunks at its far ends, that is, begin with the ids of its first word and end with those of its last one, and where the
parts that it replaces are the ends of what the chunks gave. Where they disagree the join takes in more words, and in
the end the two chunks become one, so that the result is exact for any tokenizer for which agreement at white space
means agreement beyond it.

Defined results: null and empty texts have no ids and decode to the empty string; special strings in a text become
their special ids, as in the library; texts of any length are encoded whole, one without white space as one chunk;
repeated rows are encoded each; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.llm.common import small_batches
from lumensift.llm.textbuf import releasing

#: Bytes of chunks and ids that a task's cache holds before its older half goes.
CACHE_BYTES = 32 << 20
#: Words that its encoder remembers before the older half goes, and one in how many strings is encoded as a whole as well.
CACHED_WORDS, AUDITED = 200_000, 32
#: Words that are encoded as one string, and what stands between them: a word of its own.
GROUP, MARK, SEPARATOR = 256, b"\x01", b" \x01 "
#: A cut every so many bytes, on average; a power of two.
MEAN_CHUNK = 512
#: Bytes that the rolling hash sees; a power of two.
WINDOW = 32
#: Words that a join takes from each side at first, and words that a chunk has at least: joins of it never meet.
JOINED, LEAST_WORDS = 2, 8
#: Texts are encoded together up to so many bytes.
TOGETHER = 1 << 20


def cuts(data: bytes) -> np.ndarray:
    """Proposed cuts: ends of windows whose rolling hash is 0 modulo the mean chunk, never inside a character."""
    b = np.frombuffer(data, np.uint8)
    if len(b) <= WINDOW:
        return np.zeros(0, np.int64)
    h, width, base = b.astype(np.uint32) + np.uint32(1), 1, 0x01000193
    while width < WINDOW:  # hash of 2w bytes from two of w
        h = h[:-width] * np.uint32(base) + h[width:]
        width, base = 2 * width, base * base & 0xFFFFFFFF
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    at = np.flatnonzero(h >> np.uint32(32 - MEAN_CHUNK.bit_length() + 1) == 0) + WINDOW
    at = at[at < len(b)]
    return at[(b[at] & 0xC0) != 0x80]


def chunks(data: bytes) -> list[bytes]:
    """What the cuts leave, each with the words that joins need; fewer words go with what follows them."""
    if not data:
        return []
    out, begin = [], 0
    for end in [*cuts(data).tolist(), len(data)]:
        piece = data[begin:end]
        if len(piece.split(None, LEAST_WORDS)) >= LEAST_WORDS:
            out.append(piece)
            begin = end
    if begin < len(data):
        out.append((out.pop() if out else b"") + data[begin:])
    return out


class Encoder:
    """The tokenizer behind a cache of words.

    Only for a tokenizer that lets no token cross white space: that is tried on PROBES first, and then on one string in
    AUDITED of all that are encoded, as a whole and by its words. Where they ever differ the cache is given up, and what
    was encoded with it since the last agreement is encoded again.
    """

    PROBES = ["a b", "It's  one\nof 3,500 -- (e.g.) \u00c9t\u00e9s: don't", "x \u0301y e\u0301\t\u65e5\u672c\u8a9e  \U0001f600 <|endoftext|> 12 ", " THE The the, the. \u00a0\u00df\u0130 \u03a3\u03a3 "]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.forget()
        self.mark = b""
        self.by_words = True
        self.by_words = self.whole([p.encode() for p in self.PROBES]) == self.words([p.encode() for p in self.PROBES])
        self.forget()

    def forget(self) -> None:
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.encoded = 0

    def whole(self, parts: list[bytes]) -> list[bytes]:
        """Packed ids of each string, as the library gives them."""
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]

    def apart(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word, encoded as long strings in which a mark stands between two words."""
        if not self.mark:
            self.mark = self.whole([MARK])[0]
        out: list[bytes] = []
        groups = [words[i : i + GROUP] for i in range(0, len(words), GROUP)]
        for group, ids in zip(groups, self.whole([SEPARATOR.join(g) for g in groups]), strict=True):
            flat = np.frombuffer(ids, np.uint32)
            at = np.flatnonzero(flat == np.frombuffer(self.mark, np.uint32)[0])
            if len(self.mark) == 4 and len(at) == len(group) - 1:
                begin, end = [0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), len(ids)]
                out += [ids[i:j] for i, j in zip(begin, end, strict=True)]
            else:  # some word holds the mark
                out += self.whole(group)
        return out

    def words(self, parts: list[bytes]) -> list[bytes]:
        split = [p.split() for p in parts]
        young, old = self.young, self.old
        new = set().union(*split).difference(young)
        known = [w for w in new if w in old]  # words in use stay
        young.update(zip(known, map(old.__getitem__, known), strict=True))
        new = list(new.difference(known))
        young.update(zip(new, self.apart(new), strict=True))
        out = [b"".join(map(young.__getitem__, own)) for own in split]
        if len(young) > CACHED_WORDS:
            self.young, self.old = {}, young
        return out

    def __call__(self, parts: list[bytes]) -> list[bytes]:
        if not self.by_words:
            return self.whole(parts)
        out = self.words(parts)
        audited = range(-self.encoded % AUDITED, len(parts), AUDITED)
        self.encoded += len(parts)
        if self.whole([parts[i] for i in audited]) != [out[i] for i in audited]:
            self.by_words = False
            self.forget()
            return self.whole(parts)
        return out


class Codec:
    """An encoder with a cache of the chunks that it encoded."""

    kept: dict[str, Codec] = {}

    def __init__(self, path: str, joined: int = JOINED):
        self.encoder = Encoder(path)
        self.joined = joined
        self.forget()

    @classmethod
    def of(cls, path: str) -> Codec:
        """The worker's codec for a tokenizer; what it remembers is a task's."""
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def forget(self) -> None:
        self.encoder.forget()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = self.encoded = self.widened = 0

    def _ids(self, parts: Iterable[bytes]) -> dict[bytes, bytes]:
        """Packed ids of every part; those that aren't remembered are encoded together."""
        out, new = {}, []
        for p in dict.fromkeys(parts):
            known = self.young.get(p) or self.old.get(p)
            if known is None:
                new.append(p)
            else:
                out[p] = known
        for p, ids in zip(new, self.encoder(new), strict=True):
            out[p] = self.young[p] = ids
            self.held += len(p) + len(ids) + 200
            if self.held > CACHE_BYTES // 2:
                self.old, self.young, self.held = self.young, {}, 0
        self.encoded += len(new)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        cut = [chunks(t.encode()) for t in texts]
        ids = self._ids(c for own in cut for c in own)
        out: list[bytes | None] = [None] * len(texts)
        words = self.joined
        open_ = list(range(len(texts)))
        while open_:
            ends = {i: [_ends(a, b, words) for a, b in zip(cut[i], cut[i][1:], strict=False)] for i in open_}
            join = self._joins(p for own in ends.values() for e in own for p in (e[0], e[1], e[0] + e[1], e[2], e[3]))
            left = []
            for i in open_:
                apart = [n for n, e in enumerate(ends[i]) if not _agree(ids[cut[i][n]], ids[cut[i][n + 1]], e, join)]
                if apart:
                    left.append((i, apart))
                    continue
                whole = []
                for n, c in enumerate(cut[i]):
                    own = ids[c]
                    first = len(join[ends[i][n - 1][1]]) if n else 0
                    last = len(own) - (len(join[ends[i][n][0]]) if n < len(ends[i]) else 0)
                    whole.append(own[first:last])
                    if n < len(ends[i]):
                        whole.append(join[ends[i][n][0] + ends[i][n][1]])
                out[i] = b"".join(whole)
            self.widened += len(left)
            words *= 2
            if 2 * words > LEAST_WORDS:  # joins would meet: chunks that don't agree become one
                words = self.joined
                for i, apart in left:
                    merged = [cut[i][0]]
                    for n, c in enumerate(cut[i][1:]):
                        if n in apart:
                            merged[-1] += c
                        else:
                            merged.append(c)
                    cut[i] = merged
                ids |= self._ids(c for i, _ in left for c in cut[i])
            open_ = [i for i, _ in left]
        return out

    def _joins(self, parts: Iterable[bytes]) -> dict[bytes, bytes]:
        each = list(dict.fromkeys(parts))
        return dict(zip(each, self.encoder(each), strict=True))

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.encoder.tok.decode_batch([array("I", x).tolist() for x in ids], skip_special_tokens=False)


def _ends(a: bytes, b: bytes, words: int) -> tuple[bytes, bytes, bytes, bytes]:
    """(last words of a with the white space before them, first words of b with what follows them, first and last word of both)."""
    before, after = a.rsplit(None, words), b.split(None, words)
    tail = a[len(before[0]) :] if len(before) > words else a
    head = b[: len(b) - len(after[words])] if len(after) > words else b
    return tail, head, before[-words], after[min(words, len(after)) - 1]


def _agree(a: bytes, b: bytes, ends: tuple[bytes, bytes, bytes, bytes], ids: dict[bytes, bytes]) -> bool:
    both = ids[ends[0] + ends[1]]
    return both.startswith(ids[ends[2]]) and both.endswith(ids[ends[3]]) and a.endswith(ids[ends[0]]) and b.startswith(ids[ends[1]])


@releasing
def _encode(batches: Iterator[pa.RecordBatch], path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    codec = Codec.of(path)
    codec.forget()
    for batch in batches:
        texts, begin, held = [t or "" for t in batch.column(1).to_pylist()], 0, 0
        for n, t in enumerate(texts):
            held += len(t)
            if held >= TOGETHER or n + 1 == len(texts):
                ids = codec.encode(texts[begin : n + 1])
                packed = pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, n + 1 - begin), packed, pa.array(codec.decode(ids), pa.string())], schema=schema)
                begin, held = n + 1, 0
    codec.forget()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) per row: ids as packed little-endian unsigned 32-bit integers. No shuffle.

    path: a tokenizer file that every executor can read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
    return rows.mapInArrow(partial(_encode, path=path, schema=schema), "doc_id long, ids binary, decoded string")


@releasing
def _decode(batches: Iterator[pa.RecordBatch], path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    codec = Codec.of(path)
    for batch in batches:
        ids = [x or b"" for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codec.decode(ids), pa.string())], schema=schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) of rows (doc_id, ids)."""
    small_batches(encoded.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(partial(_decode, path=path, schema=schema), "doc_id long, decoded string")
