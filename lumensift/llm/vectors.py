"""Embedding near-dedup over a robust-pruned graph.

Vectors of a label are dealt to cluster shards, each to its ``overlap`` nearest pivots. A shard's vectors get
adjacency lists by robust pruning (a neighbour is left out if a chosen one is nearer to it by the factor ``ALPHA``),
and the lists of all shards are united. Every vector then searches its shards greedily from the shard's medoid with a
bounded frontier, and from what lies in range the search expands over the united lists until nothing new is in range,
into other shards as well (there over neighbours within twice the range's angle: others lead to nothing in range). Every pair is verified by its cosine in double precision, and an exact check of each shard
follows the search: what a walk missed there is counted as well. Shards over ``MOST_SHARD`` vectors are searched in
parts, which share bridge vectors, and their parts are checked in pairs.

Links inside shards are counted where they are found and never become rows: a pair counts in the first shard that its
ends share, and what leaves a part is a number of links and the component of each vector. Only pairs that share no
shard are rows, of which the search finds few.

A sample of queries against all rows, of any nodes and of nodes with links, audits the recall; below ``LEAST_RECALL``
another round deals the vectors to twice as many shards, and the links of all rounds count. If the recall stays under
``RECALL_FLOOR`` the operator raises. The pivots are a bounded sample (``MOST_PIVOTS`` at an overlap of 2 and in
proportion to it, smallest hashes) without those in range of one another, every row is indexed.

Defined results: vectors that are null, empty, zero or hold null or non-finite values, and rows without label or
identifier, link with nothing; vectors of different lengths aren't compared; equal vectors of a label are one node of
the graph and linked; rows that share an identifier are one vector, which has the links of all of them (a partner of two
of them counts twice) and the smallest of their components; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.llm.common import HOT_COMPONENT, components, join_in_parts, small_batches, stored
from lumensift.llm.textbuf import releasing

MOST_PIVOTS = 16_384
PER_PIVOT = 300
MOST_SHARD = 1_200
BRIDGES = 48
DEGREE = 24
FRONTIER = 24
ALPHA = 1.2
AUDITED = 128
LEAST_RECALL = 0.97
RECALL_FLOOR = 0.9
MOST_OVERLAP = 16


@releasing
def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, length, unit vector as packed doubles) of the rows that may link."""
    for batch in batches:
        ids, labels, lengths, packed = [], [], [], []
        for i, label, vec in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if i is None or label is None or not vec or None in vec:
                continue
            x = np.array(vec, np.float64)
            if not np.isfinite(x).all():
                continue
            largest = np.abs(x).max()
            if largest == 0:
                continue
            x = x / largest  # squares neither overflow nor vanish
            ids.append(i)
            labels.append(label)
            lengths.append(len(x))
            packed.append((x / np.sqrt((x * x).sum())).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(lengths, pa.int32()), pa.array(packed, pa.binary())], names=["vec_id", "label", "length", "vec"])


def _matrix(packed: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(-1, length)


DEALT = "node long, label long, length int, vec binary, size long, shards array<long>, shard long"


@releasing
def _deal(batches: Iterator[pa.RecordBatch], pivots: dict, overlap: int, first: int) -> Iterator[pa.RecordBatch]:
    """Each vector once for each of its nearest pivots, with the list of all shards that it was ever dealt to, these
    included. Shards are numbered from ``first`` on, which is the shard of labels without a pivot."""
    for batch in batches:
        label, length = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        before = batch.column(5).to_pylist()
        rows, shards = [], []
        for group in {*zip(label.tolist(), length.tolist(), strict=True)}:
            at = np.flatnonzero((label == group[0]) & (length == group[1]))
            if group not in pivots:
                rows.append(at)
                shards.append(np.full((len(at), 1), first))
                continue
            own = pivots[group]
            k = min(overlap, len(own))
            step = max(1, (4 << 20) // len(own))  # bounds the cosines held at once
            for some in (at[i : i + step] for i in range(0, len(at), step)):
                near = _matrix(batch.column(3).take(pa.array(some)).to_pylist(), group[1]) @ own.T
                rows.append(some)
                shards.append(np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1) + first + 1)
        take = np.concatenate([np.repeat(r, s.shape[1]) for r, s in zip(rows, shards, strict=True)]) if rows else np.zeros(0, np.int64)
        shard = np.concatenate([s.ravel() for s in shards]) if rows else np.zeros(0, np.int64)
        listed = [before[i] + now for r, s in zip(rows, shards, strict=True) for i, now in zip(r, s.tolist(), strict=True) for _ in now]
        columns = [*(batch.column(i).take(pa.array(take)) for i in range(5)), pa.array(listed, pa.list_(pa.int64())), pa.array(shard, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "label", "length", "vec", "size", "shards", "shard"])


def _thinned(pivots: np.ndarray, least: float) -> np.ndarray:
    """The pivots without those in range of an earlier one: a dense group stays together, however many of its vectors were
    drawn."""
    kept = pivots[:0]
    for at in range(0, len(pivots), 256):
        some = pivots[at : at + 256]
        if len(kept):
            some = some[(some @ kept.T).max(1) < least]
        near, own = some @ some.T >= least, []
        for i in range(len(some)):
            if not near[i, own].any():
                own.append(i)
        kept = np.concatenate([kept, some[own]])
    return kept


def robust_prune(near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours of each of the vectors whose cosines are ``near``."""
    n = len(near)
    far = np.maximum(2 - 2 * near, 0)  # squared distances of unit vectors
    pool = min(n - 1, 3 * degree)
    out = []
    for p in range(n):
        d = far[p].copy()
        d[p] = np.inf
        left = np.argpartition(d, pool - 1)[:pool] if 0 < pool < n - 1 else np.flatnonzero(np.arange(n) != p)
        left = left[np.argsort(d[left], kind="stable")]
        chosen = []
        while len(left) and len(chosen) < degree:
            c = left[0]
            chosen.append(c)
            left = left[1:]
            left = left[alpha * alpha * far[c, left] > d[left]]
        out.append(np.array(chosen, np.int64))
    return out


def _twice(least: float) -> float:
    """The least cosine that two vectors in range of a third one can have."""
    return 2 * least * least - 1 if least > 0 else -1.0


def _build(shard: pd.DataFrame, least: float) -> pd.DataFrame:
    """Adjacency lists of one part of a shard; close: those of the neighbours that something in range of a vector may be
    in range of."""
    shard = shard.sort_values("node")
    ids = shard["node"].to_numpy()
    v = _matrix(shard["vec"].tolist(), int(shard["length"].iloc[0]))
    near = v @ v.T
    lists = robust_prune(near)
    # both ends know of an edge: searches must be able to come as well as to go; of many that come the nearest stay
    back: list[list[int]] = [[] for _ in ids]
    for i, own in enumerate(lists):
        for j in own:
            back[j].append(i)
    both, close = [], []
    for i, (own, come) in enumerate(zip(lists, back, strict=True)):
        come = np.array(come, np.int64)
        both.append(np.unique(np.concatenate([own, come[np.argsort(-near[i, come], kind="stable")[:DEGREE]]])))
        close.append(both[-1][near[i, both[-1]] >= _twice(least) - 1e-9])
    return pd.DataFrame({"node": ids, "near": [ids[b].tolist() for b in both], "close": [ids[b].tolist() for b in close]})


def _walked(v: np.ndarray, cosine: np.ndarray, link: np.ndarray, least: float) -> np.ndarray:
    """What each vector's search of a part sees: greedy from the medoid, then on from all that lies in range."""
    n = len(v)
    each = np.arange(n)
    seen, done = np.zeros((n, n), bool), np.zeros((n, n), bool)
    seen[:, int(np.argmax(v @ v.mean(0)))] = True
    for _ in range(FRONTIER):  # the nearest vector that isn't expanded yet, for all queries at once
        ahead = np.where(seen & ~done, cosine, -2.0)
        best = ahead.argmax(1)
        go = ahead[each, best] > -2
        if not go.any():
            break
        done[each[go], best[go]] = True
        seen[go] |= link[best[go]]
    in_range = cosine >= least
    seen[each, each] = True  # a query lies in its own range
    while True:
        ahead = seen & ~done & in_range
        if not ahead.any():
            return seen
        done |= ahead
        for q in np.flatnonzero(ahead.any(1)):
            seen[q] |= link[ahead[q]].any(0)


def _roots(hit: np.ndarray) -> np.ndarray:
    """The first member of each vector's component, of a symmetric matrix of links."""
    root = np.arange(len(hit))
    open_ = hit.any(1)
    for i in range(len(hit)):
        if not open_[i]:
            continue
        front = np.zeros(len(hit), bool)
        front[i] = True
        while front.any():
            root[front], open_[front] = i, False
            front = hit[front].any(0) & open_
    return root


def _table_of(lists: list) -> np.ndarray:
    """Lists of shards as rows of a matrix, padded by -1."""
    out = np.full((len(lists), max(map(len, lists))), -1, np.int64)
    for i, own in enumerate(lists):
        out[i, : len(own)] = own
    return out


def _counted(one: np.ndarray, two: np.ndarray, shard: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) have ``shard`` as the first shard that both were dealt to."""
    out = np.zeros(len(i), bool)
    step = max(1, (1 << 22) // (one.shape[1] * two.shape[1]))
    for at in range(0, len(i), step):
        a, b = one[i[at : at + step]], two[j[at : at + step]]
        common = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(2)
        out[at : at + step] = a[np.arange(len(a)), common.argmax(1)] == shard
    return out


FOUND = "node long, root long, links long, walked long, exits array<long>"


def _search(part: pd.DataFrame, least: float) -> pd.DataFrame:
    """Of each vector of a part: its links there and its component, how many of the links its walk found, and exits: what
    the search goes on to in shards that the vector isn't in, close neighbours of itself and of what is in its range.

    A pair counts for the vectors whose home the part is, in the first shard that they share.
    """
    part = part.sort_values("node")
    ids, size, home = part["node"].to_numpy(), part["size"].to_numpy(), part["home"].to_numpy()
    n = len(ids)
    v = _matrix(part["vec"].tolist(), int(part["length"].iloc[0]))
    cosine = v @ v.T
    link = np.zeros((n, n), bool)
    for i, own in enumerate(part["near"]):
        own = np.asarray(own, np.int64)
        at = np.minimum(np.searchsorted(ids, own), n - 1)
        link[i, at[ids[at] == own]] = True
    seen = _walked(v, cosine, link, least)
    hit = cosine >= least
    hit |= hit.T
    hit[np.arange(n), np.arange(n)] = False
    i, j = np.nonzero(hit & home[:, None] & home[None, :])
    shards = _table_of(part["shards"].tolist())
    own = _counted(shards, shards, int(part["shard"].iloc[0]), i, j)
    i, j = i[own], j[own]
    links = np.zeros(n, np.int64)
    np.add.at(links, i, size[j])
    walked = np.zeros(n, np.int64)
    np.add.at(walked, i, np.where(seen[i, j], size[j], 0))
    exits = _exits(hit, shards, part["close"], part["close_shards"])
    return pd.DataFrame({"node": ids, "root": ids[_roots(hit)], "links": links, "walked": walked, "exits": exits})


def _exits(hit: np.ndarray, shards: np.ndarray, close: pd.Series, theirs: pd.Series) -> list[list[int]]:
    """Of each vector the close neighbours, of itself and of its hits, that share no shard with it."""
    lists = [np.asarray(x if x is not None else [], np.int64) for x in close]
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    if not len(flat):
        return [[] for _ in lists]
    ends, first, at = np.unique(flat, return_index=True, return_inverse=True)
    own = [list(x) for lst in theirs if lst is not None for x in lst]
    of_ends = _table_of([own[i] for i in first])
    names = np.unique(np.concatenate([shards.ravel(), of_ends.ravel()]))
    has = lambda table: np.stack([np.bincount(np.searchsorted(names, row[row >= 0]), minlength=len(names)) for row in table]).astype(np.float32)
    beside = has(shards) @ has(of_ends).T > 0
    near = np.zeros((len(lists), len(ends)), np.float32)
    near[np.repeat(np.arange(len(lists)), [len(x) for x in lists]), at.ravel()] = 1
    seen = ((hit.astype(np.float32) @ near > 0) | (near > 0)) & ~beside
    return [ends[row].tolist() for row in seen]


def _across(pair: pd.DataFrame, least: float) -> pd.DataFrame:
    """The exact check of two parts of a shard: links and components of the vectors of both."""
    pair = pair.sort_values("node")
    one, two = pair[pair["part"] == pair["low"]], pair[pair["part"] == pair["high"]]
    if one.empty or two.empty:
        return pd.DataFrame({"node": np.zeros(0, np.int64), "root": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
    length, shard = int(pair["length"].iloc[0]), int(pair["shard"].iloc[0])
    x, y = (_matrix(side["vec"].tolist(), length) for side in (one, two))
    n = len(x) + len(y)
    hit = np.zeros((n, n), bool)
    hit[: len(x), len(x) :] = x @ y.T >= least
    hit |= hit.T
    i, j = np.nonzero(hit[: len(x), len(x) :])
    own = _counted(_table_of(one["shards"].tolist()), _table_of(two["shards"].tolist()), shard, i, j)
    i, j = i[own], j[own]
    links, size = np.zeros(n, np.int64), np.concatenate([one["size"].to_numpy(), two["size"].to_numpy()])
    np.add.at(links, i, size[len(x) + j])
    np.add.at(links, len(x) + j, size[i])
    ids = np.concatenate([one["node"].to_numpy(), two["node"].to_numpy()])
    return pd.DataFrame({"node": ids, "root": ids[_roots(hit)], "links": links})


@releasing
def _cosines(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = pa.array([len(a) == len(b) and float(np.frombuffer(a) @ np.frombuffer(b)) >= least for a, b in zip(x, y, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])


def _verified(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs of a label that are in range and share no shard: those that do are counted there."""
    one = nodes.select(F.col("node").alias("u"), F.col("label").alias("lu"), F.col("vec").alias("vu"), F.col("shards").alias("su"))
    two = nodes.select(F.col("node").alias("v"), F.col("label").alias("lv"), F.col("vec").alias("vv"), F.col("shards").alias("sv"))
    both = pairs.join(one, "u").join(two, "v").where("lu = lv and not arrays_overlap(su, sv)").select("u", "v", "vu", "vv")
    return both.mapInArrow(partial(_cosines, least=least), "u long, v long")


@releasing
def _brute(batches: Iterator[pa.RecordBatch], queries: dict, least: float) -> Iterator[pa.RecordBatch]:
    """(node, links): of each query its links among the batch's rows."""
    for batch in batches:
        label, length, ids, size = (batch.column(i).to_numpy() for i in (1, 2, 0, 4))
        total: dict[int, int] = {}
        for group, (qs, q) in queries.items():
            at = np.flatnonzero((label == group[0]) & (length == group[1]))
            if len(at):
                near = q @ _matrix(batch.column(3).take(pa.array(at)).to_pylist(), group[1]).T >= least
                near &= qs[:, None] != ids[at][None, :]
                for node, links in zip(qs.tolist(), (near @ size[at]).tolist(), strict=True):
                    total[node] = total.get(node, 0) + links
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["node", "links"])


def _by_group(rows: list) -> dict:
    groups: dict = {}
    for r in rows:
        groups.setdefault((r["label"], r["length"]), []).append(r)
    return {k: (np.array([r["node"] for r in own], np.int64), _matrix([bytes(r["vec"]) for r in own], k[1])) for k, own in groups.items()}


NODES = ["node", "label", "length", "vec", "size", "shards"]


def audit(nodes: DataFrame, links: DataFrame, least: float, queries: int = AUDITED) -> float:
    """Share of the links of some queries (smallest hashes), counted by comparing them with all rows, that links (node,
    links) has.

    The queries are nodes with links, and eight times as many of all nodes: links may be rare among them, but only
    there are nodes all of whose links were missed.
    """
    first = lambda df, most: df.orderBy(F.xxhash64(F.lit(5), "node"), "node").limit(most)
    linked = nodes.join(first(links.where("links > 0").select("node"), queries), "node", "left_semi")
    sample = list({r["node"]: r for r in first(nodes, 8 * queries).collect() + linked.select(*nodes.columns).collect()}.values())
    true = nodes.select(*NODES).mapInArrow(partial(_brute, queries=_by_group(sample), least=least), "node long, links long")
    true = true.groupBy("node").agg(F.sum("links").alias("true"))
    n, found = true.join(links, "node", "left").agg(F.coalesce(F.sum("true"), F.lit(0)), F.coalesce(F.sum("links"), F.lit(0))).first()
    return found / n if n else 1.0


def _round(nodes: DataFrame, count: int, least: float, overlap: int, first: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with the shards of this round as well; node, root, links, walked inside shards; pairs u < v of no shard)."""
    # in proportion to the overlap, so that shards don't grow with it
    many = max(1, min(MOST_PIVOTS, count // PER_PIVOT) * max(overlap, 2) // 2)
    sample = nodes.orderBy(F.xxhash64(F.lit(3), "node"), "node").limit(many).collect()
    pivots = {k: _thinned(v, least) for k, (_, v) in _by_group(sample).items()}
    dealt = stored(nodes.select(*NODES).mapInArrow(partial(_deal, pivots=pivots, overlap=overlap, first=first), DEALT), "vectors-dealt")
    nodes = nodes.drop("shards").join(dealt.groupBy("node").agg(F.first("shards").alias("shards")), "node")
    nodes = stored(nodes.select(*NODES), "vectors-nodes", count)
    # one row for each shard, of which there is one for each pivot and one for each label without a pivot
    sizes = dealt.groupBy("label", "length", "shard").agg(F.count(F.lit(1)).alias("members"))
    parts = F.ceil(F.col("members") / MOST_SHARD).cast("int")
    dealt = dealt.join(sizes, ["label", "length", "shard"]).withColumn("own", F.pmod(F.xxhash64("node", "shard"), parts).cast("int")).withColumn("parts", parts)
    bridge = F.pmod(F.xxhash64(F.lit(9), "node"), F.col("members")) < BRIDGES
    place = ["label", "length", "shard", "part"]
    spread = dealt.withColumn("part", F.explode(F.when(bridge, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))))
    spread = stored(spread.select(*place, "node", "vec", "size", "shards", (F.col("part") == F.col("own")).alias("home")), "vectors-parts")
    built = spread.groupBy(*place).applyInPandas(partial(_build, least=least), "node long, near array<long>, close array<long>")
    listed = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    united = stored(built.groupBy("node").agg(listed("near"), listed("close")), "vectors-graph")
    ends = united.select("node", F.explode("close").alias("v")).join(nodes.select(F.col("node").alias("v"), F.col("shards").alias("s")), "v")
    ends = ends.groupBy("node").agg(F.collect_list(F.struct("v", "s")).alias("e"))
    ends = ends.select("node", F.col("e.v").alias("close"), F.col("e.s").alias("close_shards"))
    found = spread.join(united.select("node", "near"), "node").join(ends, "node", "left").groupBy(*place).applyInPandas(partial(_search, least=least), FOUND)
    found = stored(found, "vectors-found")
    # exact inside a shard of several parts: each vector goes to the pairs of its part with the others
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != F.col("own"))
    each = dealt.where("parts > 1").withColumn("other", F.explode(others))
    each = each.select("label", "length", "shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.col("own").alias("part"), "node", "vec", "size", "shards")
    checked = each.groupBy("label", "length", "shard", "low", "high").applyInPandas(partial(_across, least=least), "node long, root long, links long")
    inside = found.select("node", "root", "links", "walked").unionByName(checked.withColumn("walked", F.lit(0).cast("long")))
    inside = stored(inside.where("links > 0 or root <> node"), "vectors-inside")
    ordered = lambda df: df.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    pairs = nodes.select(F.col("node").alias("u"), F.col("node").alias("v")).where("false")
    ahead = ordered(found.select(F.col("node").alias("u"), F.explode("exits").alias("v")))
    while True:  # into other shards, until a round finds nothing new
        new = stored(_verified(ahead.join(pairs, ["u", "v"], "left_anti"), nodes, least), "vectors-new")
        if new.isEmpty():
            return nodes, inside, pairs
        pairs = stored(pairs.unionByName(new), "vectors-pairs")
        ways = new.unionByName(new.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ahead = ordered(ways.join(united.select(F.col("node").alias("v"), "close"), "v").select("u", F.explode("close").alias("v")))


def _apart(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct pairs that share no shard of any round."""
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("shards").alias(f"s{end}"))
    return pairs.distinct().join(of("u"), "u").join(of("v"), "v").where("not arrays_overlap(su, sv)").select("u", "v")


def near_vectors(vectors: DataFrame, least: float = 0.98, overlap: int = 2) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors (vec_id, embedding, label)."""
    small_batches(vectors.sparkSession, 2_000)
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = stored(given.select("vec_id", "label", "embedding").mapInArrow(_unit, "vec_id long, label long, length int, vec binary"), "vectors-units")
    units = units.select("vec_id", "label", "length", "vec", F.sha2("vec", 256).alias("same"))
    # equal vectors of a label are one node; its size is the number of their identifiers
    classes = units.groupBy("label", "same").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("size"), F.first("length").alias("length"), F.first("vec").alias("vec"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vectors-classes", units.count())
    nodes = classes.select("node", "label", "length", "vec", "size", F.array().cast("array<long>").alias("shards"))
    count = classes.count()
    none = classes.where("false")
    inside = none.select("node", F.col("node").alias("root"), F.col("node").alias("links"), F.col("node").alias("walked"))
    pairs = none.select(F.col("node").alias("u"), F.col("node").alias("v"))
    links, shards = inside.select("node", "links"), 0
    while count:
        nodes, more, apart = _round(nodes, count, least, overlap, shards)
        shards += MOST_PIVOTS * MOST_OVERLAP  # more than a round has
        inside = inside.unionByName(more)
        pairs = stored(_apart(pairs.unionByName(apart), nodes), "vectors-apart")
        size = nodes.select(F.col("node").alias("v"), "size")
        ways = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).join(size, "v").select(F.col("u").alias("node"), F.col("size").alias("links"))
        links = stored(inside.select("node", "links").unionByName(ways).groupBy("node").agg(F.sum("links").alias("links")), "vectors-links", count)
        recall = audit(nodes, links, least)
        if recall >= LEAST_RECALL:
            break
        if overlap >= MOST_OVERLAP:
            if recall < RECALL_FLOOR:
                raise RuntimeError(f"recall of {recall:.3f} at an overlap of {overlap}")
            break
        overlap *= 2
    # rows that share an identifier belong together, too
    own = units.join(classes.select("label", "same", "node"), ["label", "same"]).select("vec_id", "node").distinct()
    several = own.groupBy("vec_id").agg(F.min("node").alias("u"), F.max("node").alias("last")).where("u <> last").select("vec_id", "u")
    same = own.join(several, "vec_id").where("u <> node").select("u", F.col("node").alias("v"))
    edges = inside.where("root <> node").select(F.col("root").alias("u"), F.col("node").alias("v")).unionByName(pairs).unionByName(same)
    joined = classes.select("node", "rep", "size").join(components(edges, "vectors"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = joined.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    hot = smallest.where(F.col("nodes") >= HOT_COMPONENT)
    known = join_in_parts(joined, smallest, ["component"], hot, F.xxhash64("node")).join(links, "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    known = own.join(known, "node").groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = given.select("vec_id").join(known, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
