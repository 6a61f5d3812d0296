"""Patches from a git repository on the driver; everything after that is relations (``sources.diff``)."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.functions import text as T
from lumensift.operators.joins import overlapping
from lumensift.sources import code, diff

PATCHES = "path string, patch string, new_file boolean, deleted_file boolean, renamed_file boolean"


def _git(folder: str, *args: str, timeout: int = 300) -> str:
    done = subprocess.run(["git", "-c", "core.quotepath=off", *args], cwd=folder, capture_output=True, timeout=timeout, check=False)
    if done.returncode:
        raise ValueError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode("utf-8", "replace")


def split_patches(text: str) -> list[tuple[str, str, bool, bool, bool]]:
    """(path, patch from its first hunk on, new, deleted, renamed) of each file of a diff."""
    out = []
    for part in re.split(r"(?m)^(?=diff --git )", text)[1:]:
        head, hunks = re.match(r"(.*?)((?:^@@.*)?)\Z", part, re.DOTALL | re.MULTILINE).groups()
        named = {k: v for k, v in re.findall(r"(?m)^(--- a/|\+\+\+ b/|rename to |rename from )(.+)$", head)}
        first = re.match(r"diff --git a/.* b/(.*)", head)
        path = named.get("+++ b/") or named.get("rename to ") or named.get("--- a/") or first[1]
        out.append((path, "\n" + hunks, "\nnew file mode" in head, "\ndeleted file mode" in head, "\nrename to " in head))
    return out


def git_patches(spark: SparkSession, folder: str, base: str, target: str) -> DataFrame:
    """(path, patch, new_file, deleted_file, renamed_file) between two commits; an unknown one is a ValueError."""
    return spark.createDataFrame(split_patches(_git(folder, "diff", "--no-color", "--find-renames", f"{base}..{target}")), PATCHES)


def git_stat(spark: SparkSession, folder: str, base: str, target: str) -> DataFrame:
    """The files that ``git diff --stat`` names, without counts."""
    text = _git(folder, "diff", f"{base}..{target}", "--stat")
    return diff.stat_files(spark.createDataFrame([("stat", text)], "diff_id string, stat string")).drop("diff_id")


def changed_methods(spark: SparkSession, folder: str, base: str, target: str) -> DataFrame:
    """(file, name, line, end_line) of the target's definitions in files that changed, those that hold a changed line; of
    files without any changed line all."""
    patches = git_patches(spark, folder, base, target).where("not deleted_file")
    paths = [r.path for r in patches.select("path").collect()]  # the files of one diff
    texts = spark.createDataFrame([(p, _git(folder, "show", f"{target}:{p}")) for p in paths], "path string, text string")
    files = texts.withColumn("lang", T.language_of(T.extension(F.col("path"))))
    changed = diff.changed_lines(patches).withColumnRenamed("line", "changed_line")
    return overlapping(code.changed_defs(files), changed, "path").select(F.col("path").alias("file"), "name", "line", "end_line")


def is_repository(folder: str) -> bool:
    return (Path(folder) / ".git").exists()
