"""What the operators share: the tables, the shared folder, Arrow batch sizes, membership bitmaps, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.operators.tables import ship

#: ASCII white space, as all contracts here use it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_fallback: dict[str, str] = {}
_cleared: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Before Python runs on executors: bound what one Arrow batch holds, so that a worker's memory doesn't follow the
    length of texts, and ship the code."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests, local mode) a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="lumensift-")
    return _fallback[app]


def _clear(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before the process does
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the application's part of the shared folder, which goes when the driver ends."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_dir(spark).rstrip('/')}/lumensift/{app}"
    if app not in _cleared:
        _cleared.add(app)
        atexit.register(_clear, spark, folder)
    return f"{folder}/{tag}-{uuid.uuid4().hex}"


#: Rows of a stored table's file, about, where their number is known: of wide tables, and of those of a few numbers.
FILE_ROWS, NARROW_ROWS = 60_000, 250_000


def stored(df: DataFrame, tag: str, rows: int | None = None, each: int = FILE_ROWS) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and survives lost executors.

    rows: how many it has at most. Tables that are small for their number of partitions get fewer files, of about
    ``each`` rows: each file costs a task, calls of the file system, and on a local one processes.
    """
    path = shared_path(df.sparkSession, tag)
    if rows is not None:
        df = df.coalesce(1 + rows // each)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forgotten(*tables: DataFrame) -> None:
    """Deletes stored tables whose every use has been stored itself: nothing reads them again, lost executors or not."""
    for t in tables:
        _clear(t.sparkSession, t._stored_at)


#: A bitmap of Spark's bitmap functions covers so many bits.
BITMAP_BITS = 32768


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def flagged(df: DataFrame, key: str, keys: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """df with ``_maybe``: whether its key may be in keys (true for all members, and for a few others).

    A one-hash Bloom filter: at most ``bits / 32768`` bitmaps of 4 KB are broadcast (2 MB by default), however many
    keys there are. An exact join follows at every caller; this spares it the shuffle of rows without a partner.
    """
    maps = (
        keys.select(_bit(F.col(key), bits).alias("_h"))
        .groupBy(F.shiftright("_h", 15).alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.col("_h") % BITMAP_BITS).alias("_bitmap"))
    )
    probe = df.withColumn("_h", _bit(F.col(key), bits)).withColumn("_bucket", F.shiftright("_h", 15))
    byte = F.expr("cast(conv(hex(substring(_bitmap, cast((_h % 32768) div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = byte.bitwiseAND(F.expr("cast(pow(2, _h % 8) as int)")) != 0
    return probe.join(F.broadcast(maps), "_bucket", "left").select(*df.columns, F.coalesce(bit, F.lit(False)).alias("_maybe"))


def maybe_member(df: DataFrame, key: str, keys: DataFrame, bits: int = 1 << 24) -> DataFrame:
    return flagged(df, key, keys, bits).where("_maybe").drop("_maybe")


#: Nodes of a component, from which on what is known of it is joined in parts.
HOT_COMPONENT = 1_000


def join_in_parts(rows: DataFrame, other: DataFrame, on: list[str], hot: DataFrame, spread: Column, how: str = "inner", parts: int = 64) -> DataFrame:
    """rows joined with other, which has a row for a key at most, on columns of both. hot: keys that very many rows have.

    Rows of hot keys are dealt by ``spread`` to parts, each of which gets a copy of the key's row of other. Which keys are
    dealt is told by a bitmap on both sides, so any number of them may be hot.
    """
    key = F.xxhash64(*on)
    hot = hot.select(key.alias("_key"))
    rows = flagged(rows.withColumn("_key", key), "_key", hot)
    rows = rows.withColumn("_part", F.when(F.col("_maybe"), F.pmod(spread, F.lit(parts)).cast("int")).otherwise(0)).drop("_key", "_maybe")
    other = flagged(other.withColumn("_key", key), "_key", hot)
    copies = F.when(F.col("_maybe"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    other = other.withColumn("_part", F.explode(copies)).drop("_key", "_maybe")
    return rows.join(other, [*on, "_part"], how).drop("_part")


def components(edges: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (u, v; rows of them at most), for every node of an edge.

    Alternating large-star and small-star rounds. Each is two map-side combined aggregations and a join, each ends in
    a stored table, and the number of rounds grows with the logarithm of the longest chain. A hot node is only a hot
    key of a minimum (combined before the shuffle) and of a join that may be split.
    """
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{tag}-edges", rows, NARROW_ROWS)
    before, rows = None, e.count()
    while True:  # a round that changes nothing is the last: the edges only ever move to smaller nodes
        # large star: every larger neighbour of a node goes to the node's smallest neighbour (itself included)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of a node, and the node, go to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, e = e, stored(small, f"{tag}-star", rows, NARROW_ROWS)
        forgotten(last)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before, rows = now, now[0]
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
