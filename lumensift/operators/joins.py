"""Nearest, range and band joins, and the comparison of findings with known issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, tolerance: int, left_id: list[str], order: str) -> DataFrame:
    """left with the right row of the same key that is nearest in ``at``, within tolerance; the first of equals; or nulls.

    An equi join on (key, bucket): buckets are as wide as the tolerance, and a right row goes to its own and to both
    neighbours, so what is compared stays near, however many rows a key has.
    """
    width = max(tolerance, 1)
    bucket = F.floor(F.col(at) / width)
    renamed = right.select(F.col(key), *[F.col(c).alias(f"near_{c}") for c in right.columns if c != key])
    renamed = renamed.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col(f"near_{at}") / width) + d for d in (-1, 0, 1)])))
    joined = left.withColumn("_bucket", bucket).join(renamed, [key, "_bucket"])
    distance = F.abs(F.col(f"near_{at}") - F.col(at))
    best = joined.where(distance <= tolerance).groupBy(*left_id).agg(F.min_by(F.struct(*[c for c in renamed.columns if c.startswith("near_")], distance.alias("distance")), F.struct(distance, f"near_{order}")).alias("m"))
    return left.join(best, left_id, "left").select(*left.columns, "m.*")


def overlapping(spans: DataFrame, points: DataFrame, key: str, start: str = "line", end: str = "end_line", at: str = "changed_line") -> DataFrame:
    """spans (semi) that hold a point of their key; keys without any point keep all their spans.

    One sort by key: each span looks at the first point from its start on, so the work is linear in the rows of a key.
    """
    both = spans.select(key, F.col(start).alias("_at"), F.lit(None).cast("long").alias("_p"), F.struct(*spans.columns).alias("_span"))
    marks = points.select(key, F.col(at).alias("_at"), F.col(at).cast("long").alias("_p"), F.lit(None).cast(both.schema["_span"].dataType).alias("_span"))
    own = Window.partitionBy(key)
    ahead = own.orderBy(F.desc("_at"), F.desc_nulls_last("_p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.unionByName(marks).withColumns({"_next": F.min("_p").over(ahead), "_any": F.max("_p").over(own)})
    inside = F.col("_any").isNull() | (F.col("_next") <= F.col(f"_span.{end}")) | F.col(key).isNull()
    return seen.where(F.col("_span").isNotNull() & inside).select("_span.*")


def earlier_in_group(rows: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """Each row with the names of all rows before it in its group; at is a whole number.

    A frame over the ordered group: no row is made for a pair, only the lists themselves grow with the group.
    """
    before = Window.partitionBy(key).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    named = F.when(F.col(at).isNotNull() & F.col(name).isNotNull(), F.struct(at, name))
    placed = F.col(key).isNotNull() & F.col(at).isNotNull()
    listed = rows.select(key, at, name, F.when(placed, F.collect_list(named).over(before)).alias("_before"))
    packed = F.array_sort(F.flatten(F.collect_list("_before")))
    return listed.groupBy(key, at, name).agg(F.transform(packed, lambda s: s[name]).alias("earlier"))


def next_in_group(rows: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """(key, src, dst): each row's name with that of the row after it."""
    after = F.lead(name).over(Window.partitionBy(key).orderBy(at))
    return rows.select(key, F.col(name).alias("src"), after.alias("dst")).where("dst is not null")


def known_found(known: DataFrame, found: DataFrame, how: str, slack: int = 2) -> DataFrame:
    """known (known_id, file, line, rule_id) with detected.

    how: exact (file, line and rule), line (file, and the line within slack), rule (line, and the rule as well), range
    (the line within slack of the finding's lines).
    """
    f = found.select(F.col("file").alias("f_file"), F.col("line").alias("f_line"), F.col("end_line").alias("f_end"), F.col("rule_id").alias("f_rule"))
    near = {
        "exact": (F.col("line") == F.col("f_line")) & (F.col("rule_id") == F.col("f_rule")),
        "line": F.abs(F.col("line") - F.col("f_line")) <= slack,
        "rule": (F.abs(F.col("line") - F.col("f_line")) <= slack) & (F.col("rule_id") == F.col("f_rule")),
        "range": (F.col("line") >= F.col("f_line") - slack) & (F.col("line") <= F.col("f_end") + slack),
    }[how]
    # buckets of lines: what is compared within a file stays near, however many findings the file has
    width, reach = 32, 0 if how == "exact" else slack
    last = F.col("f_end") if how == "range" else F.col("f_line")
    f = f.withColumn("f_bucket", F.explode(F.sequence(F.floor((F.col("f_line") - reach) / width), F.floor((F.greatest(last, "f_line") + reach) / width))))
    placed = known.withColumn("_bucket", F.floor(F.col("line") / width))
    hit = placed.join(f, (F.col("file") == F.col("f_file")) & (F.col("_bucket") == F.col("f_bucket")) & near, "left_semi").select("known_id").distinct().withColumn("_hit", F.lit(True))
    return known.join(hit, "known_id", "left").withColumn("detected", F.coalesce("_hit", F.lit(False))).drop("_hit")


def agreement(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """One row: how many keys two reviewers share, of all, and how often they give the same value to a shared one."""
    x, y = (df.groupBy(*on).agg(F.min(value).alias(name)) for df, name in ((a, "_x"), (b, "_y")))
    both = x.join(y, on, "full")
    common = F.count_if(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    same = F.count_if(F.col("_x") == F.col("_y"))
    return both.agg(common.alias("n_common"), F.count(F.lit(1)).alias("n_union"), same.alias("n_same"))
