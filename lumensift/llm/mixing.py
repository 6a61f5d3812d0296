"""Mixing sources to target weights.

Rows get hash-random keys and are range-sorted by them within their source: a bucket is a range of keys, so sums per
bucket and a running sum inside each bucket give the prefix sums of the whole source without any task holding it. The
cut falls at the exact budget; budgets over one pass repeat whole epochs first.

Sources are rows of a table like any other: their weights go by their rank, and what the limit of a source's target
leaves over is reshared in rounds of one small aggregation each. The mix itself needs no shuffle of texts: before the
bucket of its source's cut a row is taken once more than behind it, and only the rows of the cut buckets are sorted.

Defined results: a null text has size 0; null sources form one source, last; repeated rows are rows of their own;
equal keys are ordered by id, size and text hash, so that reruns agree; an empty table gives an empty result; a
source of size 0 gets target 0; texts of any length are counted whole; of further columns, those of the same names as
what is computed here are kept as they came.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumensift.llm.common import WORD, stored
from lumensift.operators.findings import numbered_by

SEED = 20_240_607


def cyclic_weights(sources: DataFrame) -> DataFrame:
    """sources with weight: 3, 1, 2, repeating over them by code point, null last."""
    ranked = numbered_by(sources, F.col("source").isNull(), F.coalesce("source", F.lit("")))
    return ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, (3.0, 1.0, 2.0))), (F.col("number") % 3 + 1).cast("int"))).drop("number")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size, weight) with target: ``share`` of all sizes by weight; no target over ``most`` times
    its source's size, the excess reshared among the others."""
    each, total, full = 0.0, 0, -1
    over = lambda: F.lit(each) * F.col("weight") > F.lit(most) * F.col("source_size")
    while True:  # what a weight gets only grows, so a source that is full stays full
        now = sources.agg(F.sum("source_size"), F.sum(F.when(over(), F.col("source_size"))), F.sum(F.when(~over(), F.col("weight"))), F.count_if(over())).first()
        if now[3] == full:
            break
        total, full = now[0] or 0, now[3]
        each = (share * total - most * (now[1] or 0)) / now[2] if now[2] else each
    return sources.withColumn("target", F.when(over(), F.lit(most) * F.col("source_size")).otherwise(F.lit(each) * F.col("weight")))


def _sized(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(doc_id: Column, text_hash: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(doc_id, F.lit(-1)), text_hash)


def _bucket(key: Column, buckets: int) -> Column:
    """Ranges of keys, numbered in their order."""
    unit = F.shiftright(key, 11) / F.lit(float(1 << 53)) + 0.5  # of [0, 1)
    return F.least(F.floor(unit * buckets), F.lit(buckets - 1))


def _same(a: DataFrame, b: DataFrame, *on: str) -> list[Column]:
    return [a[c].eqNullSafe(b[c]) for c in on]


def _planned(rows: DataFrame, weigh: Callable[[DataFrame], DataFrame], share: float, most: float) -> tuple[DataFrame, DataFrame, int]:
    """(a row per source: source_size, target, epochs, rest; a row per source and bucket: offset; buckets).

    rows: (source, key, size). ``rest`` is what is left of the budget after whole epochs.
    """
    sources = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-sources")
    # about the square root of the rows in each bucket, and as many buckets: both windows stay small
    buckets = max(1, isqrt(sources.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    plan = targets(stored(weigh(sources.drop("n")), "mix-weights"), share, most)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    plan = plan.select("source", "source_size", "target", epochs.cast("long").alias("epochs"))
    plan = stored(plan.withColumn("rest", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long")), "mix-plan")
    sums = rows.groupBy("source", _bucket(F.col("key"), buckets).alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    return plan, sums, buckets


def mix(docs: DataFrame, weigh: Callable[[DataFrame], DataFrame] = cyclic_weights, share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """One row per row of docs (doc_id, source, text): doc_id, text_hash, size, source, source_size, target, key, taken."""
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), _sized(F.col("text")).alias("size"))
    rows = stored(rows.withColumn("key", _keyed(F.col("doc_id"), F.col("text_hash"), seed)), "mix-rows")
    plan, sums, buckets = _planned(rows, weigh, share, most)
    rows = rows.withColumn("bucket", _bucket(F.col("key"), buckets))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sums = sums.drop("bucket_size")
    rows = rows.join(sums, _same(rows, sums, "source", "bucket")).drop(sums["source"]).drop(sums["bucket"])
    rows = rows.join(plan, _same(rows, plan, "source")).drop(plan["source"])
    rest = F.col("rest") - F.col("offset") - F.col("within")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return rows.select("doc_id", "text_hash", "size", "source", "source_size", "target", "key", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weigh: Callable[[DataFrame], DataFrame] = cyclic_weights, share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """The mix itself: docs' columns, each row as often as whole passes take it, and the row at a cut as its first words.

    Rows that the mix takes nothing of are not in it, but for rows of size 0, which cost nothing and stay once.
    """
    rows = docs.select(F.struct("*").alias("doc"), "source", _sized(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), F.col("doc_id").alias("own_id"))
    rows = rows.withColumn("key", _keyed(F.col("own_id"), F.col("text_hash"), seed))
    plan, sums, buckets = _planned(stored(rows.select("source", "key", "size"), "mix-sizes"), weigh, share, most)
    # the bucket of a source's cut: the one in which the rest runs out; none where the rest is 0
    ends = sums.join(plan.select("source", "rest"), _same(sums, plan, "source")).drop(plan["source"])
    ends = ends.where("offset < rest and offset + bucket_size >= rest").groupBy("source").agg(F.min("bucket").alias("cut"), F.min("offset").alias("offset"))
    whole = plan.join(ends, _same(plan, ends, "source"), "left").drop(ends["source"])
    whole = stored(whole.select("source", "epochs", "rest", F.coalesce("cut", F.lit(-1)).alias("cut"), F.coalesce("offset", F.lit(0)).alias("offset")), "mix-cuts")
    rows = rows.withColumn("bucket", _bucket(F.col("key"), buckets))
    rows = rows.join(whole, _same(rows, whole, "source")).drop(whole["source"])
    plain = rows.where("bucket <> cut").withColumn("taken", F.col("size") * (F.col("epochs") + F.when(F.col("bucket") < F.col("cut"), 1).otherwise(0)))
    at_cut = rows.where("bucket = cut")
    inside = Window.partitionBy("source").orderBy("key", "own_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("rest") - F.col("offset") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    at_cut = at_cut.withColumn("taken", F.col("size") * F.col("epochs") + F.greatest(F.lit(0), F.least(F.col("size"), rest)))
    out = plain.select("doc", "size", "taken").unionByName(at_cut.select("doc", "size", "taken"))
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size"))).cast("int")
    part = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("taken") % F.col("size")).cast("int")
    text = F.col("doc").getField("text")
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))  # each with the white space before it
    copies = F.when(times > 0, F.array_repeat(F.lit(0), times)).otherwise(F.array().cast("array<int>"))
    copies = F.concat(copies, F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    out = out.select("doc", F.explode(copies).alias("first"))
    cut = F.when(F.col("first") > 0, F.array_join(F.slice(words, F.lit(1), F.col("first")), ""))
    instead = {"text": F.coalesce(cut, text)}
    if "n_chars" in docs.columns:
        instead["n_chars"] = F.coalesce(F.char_length(cut), F.col("doc").getField("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[instead.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
