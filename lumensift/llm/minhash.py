"""MinHash near-deduplication with b-bit signatures.

Every text's set of word shingles gives 64 minima. Bands of four minima propose candidates; the low four bits of every
minimum are packed into four 64-bit integers, and a candidate's similarity is estimated from the bits that agree,
corrected for chance agreement (1 in 16). What may reach the threshold is confirmed on the full sets.

Groups are never expanded into pairs. Texts of equal word sequences are one class. Of a bucket, every class is
compared with the most central one only; components of the confirmed links follow; then just those pairs of a bucket
that still lie in different components are compared, in blocks that give nothing but links between components, so that
no link that could join two components is missed.

Nodes are classes of equal word sequences, by a 128-bit key, and not identifiers: an identifier that repeats with
different texts is in several classes, and joins them.

Defined results: null and blank texts have the empty set and link with nothing; rows that share an identifier are one
document, so a link of one of them is a link of the identifier; rows with a null identifier get a null component and
are kept; texts of any length are compared whole, and blocks are bounded by the shingles in them; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.llm.common import HOT_COMPONENT, NARROW_ROWS, components, flagged, forgotten, join_in_parts, maybe_member, small_batches, stored
from lumensift.llm.textbuf import FACTORS, MASKS, buffer_of, distinct, mixed, releasing, shingles

BANDS, ROWS = 16, 4
HASHES = BANDS * ROWS
BITS = 4
#: Candidates are confirmed if their estimate isn't over five standard errors below the threshold.
SLACK = 0.26
#: Members of a bucket that are compared in one task, squared (row numbers of a block are 16-bit integers).
BLOCK = 384
#: Shingles, about, of all members on one side of a block.
BLOCK_SHINGLES = 1 << 20

NODE = "struct<k1:long,k2:long>"
SIGNATURES = "doc_id long, k1 long, k2 long, n_shingles long, sig array<long>, bands array<long>"


def signatures(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, set sizes, packed signatures n x 4, band keys n x BANDS)."""
    texts = len(offsets) - 1
    h, own, keys = shingles(data, offsets, words)
    h, own = distinct(h, own)
    n = np.bincount(own, minlength=texts)
    sig, bands = np.zeros((texts, HASHES * BITS // 64), np.uint64), np.zeros((texts, BANDS), np.uint64)
    have = np.flatnonzero(n)
    if len(have):
        at = (np.cumsum(n) - n)[have]
        for k in range(HASHES):
            low = np.minimum.reduceat((h ^ MASKS[k]) * FACTORS[k], at)
            spread = mixed(low)
            sig[have, k * BITS // 64] |= (spread & np.uint64((1 << BITS) - 1)) << np.uint64(k * BITS % 64)
            bands[have, k // ROWS] = mixed(bands[have, k // ROWS] * np.uint64(3) + spread + np.uint64(k))
    return keys, n, sig, bands


@releasing
def _sign(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffer_of(batch.column(1))
        keys, n, sig, bands = signatures(data, offsets, words)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).view(np.int64).ravel()))
        k = np.ascontiguousarray(keys.T).view(np.int64)
        arrays = [batch.column(0), pa.array(k[0]), pa.array(k[1]), pa.array(n.astype(np.int64)), lists(sig), lists(bands)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "k1", "k2", "n_shingles", "sig", "bands"])


def _agreeing(a: str, b: str) -> str:
    """SQL: how many of the packed low bits' groups agree."""
    x = "({0}[{2}] ^ {1}[{2}])"
    ones = 0x1111111111111111
    off = []
    for i in range(HASHES * BITS // 64):
        v = x.format(a, b, i)
        off.append(f"bit_count(({v} | shiftrightunsigned({v}, 1) | shiftrightunsigned({v}, 2) | shiftrightunsigned({v}, 3)) & {ones}L)")
    return f"({HASHES} - ({' + '.join(off)}))"


def _least_agreeing(threshold: float) -> int:
    chance = 1 / (1 << BITS)
    return int(np.ceil(HASHES * ((threshold - SLACK) * (1 - chance) + chance)))


def _of_node(keys: np.ndarray, node: pa.StructArray) -> np.ndarray:
    """Which texts have the word sequence that their node names: an identifier may have other texts as well."""
    want = [node.field(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in (0, 1)]
    return (keys[:, 0] == want[0]) & (keys[:, 1] == want[1])


@releasing
def _confirm(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets, keep = [], np.ones(batch.num_rows, bool)
        for col in (2, 3):
            data, offsets = buffer_of(batch.column(col))
            h, own, keys = shingles(data, offsets, words)
            keep &= _of_node(keys, batch.column(col - 2))
            h, own = distinct(h, own)
            sets.append((h, np.searchsorted(own, np.arange(len(offsets)))))
        (x, xs), (y, ys) = sets
        for i in np.flatnonzero(keep):
            a, b = x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]]
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep[i] = both > 0 and 100 * both >= percent * (len(a) + len(b) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["u", "v"])


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs of nodes (u, v; ui and vi: an identifier of each) whose full sets are similar enough. Texts of candidates
    only are shuffled."""
    ids = pairs.select(F.col("ui").alias("doc_id")).unionByName(pairs.select(F.col("vi").alias("doc_id"))).distinct()
    held = maybe_member(docs, "doc_id", ids)
    first = pairs.join(held.select(F.col("doc_id").alias("ui"), F.col("text").alias("text_u")), "ui")
    both = first.join(held.select(F.col("doc_id").alias("vi"), F.col("text").alias("text_v")), "vi")
    return both.select("u", "v", "text_u", "text_v").mapInArrow(partial(_confirm, words=words, percent=percent), f"u {NODE}, v {NODE}")


def _candidates(block: pa.Table, least: int, percent: int) -> np.ndarray:
    """(agreement, row, row), n x 3, of the pairs of one block, or between two, that lie in different components and may link.

    A pair that shares an earlier band is met there.
    """
    col = lambda name: block.column(name).to_numpy()
    flat = lambda name: np.array(block.column(name).to_pylist(), np.int64).view(np.uint64)
    part, n, sig, bands = col("part"), col("n_shingles"), flat("sig"), flat("bands")
    comp = _numbers(block.column("component"))
    band, low, high = (block.column(c)[0].as_py() for c in ("band", "low", "high"))
    cols = np.flatnonzero(part == high)
    pairs = []
    ones = np.uint64(0x1111111111111111)
    for i in np.flatnonzero(part == low):
        x = sig[cols] ^ sig[i]
        x = (x | (x >> np.uint64(1)) | (x >> np.uint64(2)) | (x >> np.uint64(3))) & ones
        agree = HASHES - np.bitwise_count(x).sum(1).astype(int)
        near = (agree >= least) & (comp[cols] != comp[i]) & (100 * np.minimum(n[cols], n[i]) >= percent * np.maximum(n[cols], n[i]))
        near &= ~(bands[cols, :band] == bands[i, :band]).any(1)
        if low == high:
            near &= cols > i
        k = np.flatnonzero(near)
        pairs.append(np.stack([agree[k], np.full(len(k), i), cols[k]], 1).astype(np.int16))
    return np.concatenate(pairs) if pairs else np.zeros((0, 3), np.int16)


def _numbers(nodes: pa.ChunkedArray) -> np.ndarray:
    """The nodes as small integers: equal ones get equal numbers."""
    keys = np.stack([nodes.combine_chunks().field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1) if len(nodes) else np.zeros((0, 2), np.int64)
    return np.unique(keys, axis=0, return_inverse=True)[1].ravel()


def _promising(block: pa.Table, least: int, percent: int) -> pa.Table:
    """The rows of a block that some pair needs."""
    pairs = _candidates(block, least, percent)
    return block.take(pa.array(np.unique(pairs[:, 1:]).astype(np.int64)))


def _across(block: pa.Table, words: int, least: int, percent: int) -> pa.Table:
    """Links of a block that join different components.

    Pairs go by their estimate, the nearest first; each is confirmed on the full sets, unless the links found here
    have joined its ends by then.
    """
    block = block.combine_chunks()
    nodes = block.column("node").combine_chunks()
    sets, own = [], []
    for at in range(0, block.num_rows, 64):  # hashing takes many times a text's size
        data, offsets = buffer_of(block.column("text").slice(at, 64).combine_chunks())
        h, text, keys = shingles(data, offsets, words)
        own.append(_of_node(keys, nodes.slice(at, 64)))
        h, text = distinct(h, text)
        sets += np.split(h, np.searchsorted(text, np.arange(1, len(offsets) - 1)))
    pairs = _candidates(block, least, percent)
    own = np.concatenate(own)
    pairs = pairs[own[pairs[:, 1]] & own[pairs[:, 2]]]
    n, comp = block.column("n_shingles").to_numpy(), _numbers(block.column("component"))
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while c in root:
            c = root[c]
        return c

    u, v = [], []
    for _, i, j in pairs[np.argsort(-pairs[:, 0], kind="stable")]:
        a, b = find(comp[i]), find(comp[j])
        if a == b:
            continue
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if both and 100 * both >= percent * (n[i] + n[j] - both):
            root[max(a, b)] = min(a, b)
            u.append(i)
            v.append(j)
    ends = [nodes.take(pa.array(x, pa.int64())) for x in (u, v)]
    return pa.table(ends, names=["u", "v"])


PLACE = ["band", "key", "low", "high"]


def _on_blocks(f: Callable[..., pa.Table], least: int, percent: int) -> Callable[[pa.Table], pa.Table]:
    def on_block(block: pa.Table) -> pa.Table:
        return f(block, least=least, percent=percent)

    return on_block


def _blocks(in_bucket: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the buckets that still hold several components, their leader aside (it has met all), by pair of parts."""
    rest = in_bucket.where("size > 2 and node <> leader").join(found.select("node", "component"), "node", "left")
    rest = rest.withColumn("component", F.coalesce("component", "node"))
    open_ = rest.groupBy("band", "key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("left"), F.sum("n_shingles").alias("held")).where("c1 <> c2")
    rest = rest.join(open_.select("band", "key", "left", "held"), ["band", "key"])
    parts = F.ceil(F.greatest(F.col("left") / BLOCK, F.least(F.col("held") / BLOCK_SHINGLES, F.col("left")))).cast("int")
    rest = rest.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rest.select("band", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "rep", "n_shingles", "sig", "bands", "component")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row; kept: doc_id is the smallest one of its component."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(docs.mapInArrow(partial(_sign, words=words), SIGNATURES), "minhash-rows")
    n = rows.count()
    node = F.struct("k1", "k2").alias("node")
    classes = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = stored(classes.select(node, "rep", "n_shingles", "sig", "bands"), "minhash-classes", n)
    least = _least_agreeing(percent / 100)
    members = classes.where("n_shingles > 0 and rep is not null").select("node", "rep", "n_shingles", "sig", "bands", F.posexplode("bands").alias("band", "key"))
    sizes = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stored(members.join(sizes, ["band", "key"]), "minhash-members", BANDS * n)
    # the leader of a bucket is its most central member, that of the largest buckets: most others link with it
    central = shared.groupBy("node").agg(F.sum("size").alias("central"))
    leading = shared.select("band", "key", "node").join(central, "node").groupBy("band", "key").agg(F.max(F.struct("central", "node"))["node"].alias("leader"))
    in_bucket = stored(shared.join(leading, ["band", "key"]), "minhash-led", BANDS * n)
    forgotten(shared)
    leaders = classes.select(F.col("node").alias("leader"), F.col("rep").alias("ui"), F.col("n_shingles").alias("n2"), F.col("sig").alias("sig2"))
    star = in_bucket.where("node <> leader").select("leader", "node", F.col("rep").alias("vi"), "sig", "n_shingles").dropDuplicates(["leader", "node"]).join(leaders, "leader")
    star = star.where(F.expr(f"{_agreeing('sig', 'sig2')} >= {least} and 100 * least(n_shingles, n2) >= {percent} * greatest(n_shingles, n2)"))
    star = stored(star.select(F.col("leader").alias("u"), F.col("node").alias("v"), "ui", "vi"), "minhash-star", BANDS * n, NARROW_ROWS)
    linked = star.count()
    links = stored(_confirmed(star, docs, words, percent).distinct(), "minhash-links", linked, NARROW_ROWS)
    forgotten(star)
    # an identifier with several texts joins their classes
    own = rows.where("doc_id is not null and n_shingles > 0").select("doc_id", node)
    several = own.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("last")).where("u <> last").select("doc_id", "u")
    links = links.unionByName(stored(own.join(several, "doc_id").where("u <> node").select("u", F.col("node").alias("v")).distinct(), "minhash-same", n, NARROW_ROWS))
    found = components(links, "minhash-first", linked + n)
    promising, across = (_on_blocks(f, least, percent) for f in (_promising, partial(_across, words=words)))
    rest = _blocks(in_bucket, found)
    rest = stored(rest.groupBy(*PLACE).applyInArrow(promising, rest.schema), "minhash-rest")
    forgotten(in_bucket)
    if not rest.isEmpty():
        texts = maybe_member(docs, "doc_id", rest.select(F.col("rep").alias("doc_id")).distinct()).select(F.col("doc_id").alias("rep"), "text")
        texts = texts.withColumn("_hash", F.xxhash64("text")).dropDuplicates(["rep", "_hash"]).drop("_hash")
        more = rest.join(texts, "rep").groupBy(*PLACE).applyInArrow(across, f"u {NODE}, v {NODE}")
        found = components(links.unionByName(stored(more, "minhash-more")), "minhash-second")
    joined = classes.where("n_shingles > 0").select("node", "rep").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = joined.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    hot = smallest.where(F.col("nodes") >= HOT_COMPONENT)
    known = join_in_parts(joined.select("node", "component"), smallest, ["component"], hot, F.xxhash64("node")).select("node.k1", "node.k2", "component_id")
    out = rows.select("doc_id", "k1", "k2", "n_shingles").join(known, ["k1", "k2"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that have a smaller identifier in their group. Only possible leavers are shuffled."""
    gone = stored(near_groups(docs, words, percent).where("not kept").select("doc_id").distinct(), "minhash-gone")
    seen = flagged(docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id")), "doc_id", gone)
    stay = seen.where("_maybe").join(gone, "doc_id", "left_anti")
    return seen.where("not _maybe").select("doc").unionByName(stay.select("doc")).select("doc.*")
