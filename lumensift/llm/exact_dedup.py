"""Exact deduplication by a log-structured merge index of digests.

Every task sorts the digests of its rows (the memtable; Spark's sort spills) and flushes them as sorted files: together
a run of the lowest level, with a filter of one-hash bitmaps. When a level has ``FANOUT`` runs, compaction merges them
into one of the next level, dealt by range: of each digest it keeps the smallest identifier and the number of rows.
Lookups ask a run's filter before they join the run.

Digests with several rows are hits, and hits are verified byte by byte: the least and the greatest text of a digest,
combined in each task before they are shuffled, are equal exactly if all its texts are. A digest whose texts differ
falls back to the texts themselves.

Defined results: a null text counts as empty; rows whose identifier repeats are rows of their own and count in
``group_size``; a null identifier never stays while its group has another one; texts of any length are digested and
compared whole; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.llm.common import SPACE, flagged, maybe_member, shared_path, stored


def normalised(text: Column) -> Column:
    """Null is empty; each run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


#: Runs of a level that are merged into one of the next.
FANOUT = 4


class DigestIndex:
    """Runs (digest, keep_id, group_size) by level in a shared folder, each sorted and with a filter."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.made = spark, path or shared_path(spark, "digests"), 0
        self.levels: dict[int, list[str]] = {}
        self.flushed: list[str] = []

    def _write(self, rows: DataFrame, level: int) -> str:
        run = f"{self.path}/level-{level}-{self.made:06d}"
        self.made += 1
        out = rows.write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        out.option("compression", "zstd").parquet(run)
        self.levels.setdefault(level, []).append(run)
        return run

    def read(self, *runs: str) -> DataFrame:
        return self.spark.read.parquet(*runs)

    def flush(self, rows: DataFrame) -> None:
        """Add rows (digest, id): a run of the lowest level. Levels that are full by then are merged."""
        rows = rows.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
        self.flushed.append(self._write(rows.sortWithinPartitions("digest", "keep_id"), 0))
        level = 0
        while len(self.levels.get(level, [])) >= FANOUT:
            self._merge([level], level + 1)
            level += 1

    def _merge(self, levels: list[int], into: int) -> str:
        """One run of the runs of some levels. Minima and sums are combined in each task before they are shuffled."""
        runs = [r for level in levels for r in self.levels.pop(level, [])]
        merged = self.read(*runs).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        return self._write(merged.repartitionByRange("digest").sortWithinPartitions("digest"), into)

    def compact(self) -> DataFrame:
        """All runs as one: (digest, keep_id, group_size)."""
        return self.read(self._merge(sorted(self.levels), max(self.levels) + 1))

    def rows(self) -> DataFrame:
        """(digest, id) of all rows that were ever flushed."""
        return self.read(*self.flushed).select("digest", F.col("keep_id").alias("id"))

    def probe(self, digests: DataFrame) -> DataFrame:
        """Which of the digests some run has. Only those that a run's filter lets through are joined with it."""
        found = None
        for run in (r for level in sorted(self.levels) for r in self.levels[level]):
            own = self.read(run).select("digest")
            hit = maybe_member(digests, "digest", own).join(own, "digest", "left_semi")
            found = hit if found is None else found.unionByName(hit)
        return digests.where("false") if found is None else found.distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: id, digest, keep_id, group_size, kept. ``digest`` only proposes; bytes decide."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    index = DigestIndex(spark)
    index.flush(rows.select(digest(F.col("norm")).alias("digest"), "id"))
    merged = index.compact()
    held = maybe_member(rows.withColumn("digest", digest(F.col("norm"))), "digest", merged.where("group_size > 1"))
    texts = held.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
    unequal = stored(texts.where("least <> greatest").select("digest"), "digests-unequal")
    found = index.rows().join(merged, "digest")
    if not unequal.isEmpty():  # digests that collide: their groups are formed by their bytes
        again = rows.withColumn("digest", digest(F.col("norm"))).join(unequal, "digest", "left_semi")
        exact = again.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = found.join(unequal, "digest", "left_anti").unionByName(again.join(exact, ["digest", "norm"]).select(*found.columns))
    return found.select("id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each text, the one with the smallest identifier. Only rows of shared texts are shuffled."""
    groups = stored(exact_groups(docs, id_col, text_col).where("group_size > 1 and kept"), "digests-kept")
    kept = groups.select(F.col("id").alias("kept_id"), F.col("digest").alias("kept_digest")).distinct()
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), sha256(normalised(F.col(text_col))).alias("digest"))
    seen = flagged(rows, "digest", groups.select("digest"))
    hits = seen.where("_maybe")
    shared = hits.join(kept, hits["digest"] == kept["kept_digest"], "left")
    stay = shared.where("kept_digest is null")
    one = shared.where("kept_digest is not null and id <=> kept_id").dropDuplicates(["digest"])
    return seen.where("not _maybe").select("doc").unionByName(stay.select("doc")).unionByName(one.select("doc")).select("doc.*")
