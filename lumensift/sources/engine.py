"""The external matching engine as a child process of the driver; its JSON output is a source like any other."""

from __future__ import annotations

import subprocess
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.functions import text as T
from lumensift.operators.match import flatten_engine
from lumensift.operators.rulebase import engine_rules
from lumensift.sources.config import dump_yaml
from lumensift.sources.rules_md import Rule

# Folders that the engine leaves out.
EXCLUDED = [".python", "venv", ".venv", "env", ".env", "site-packages", "vendor", "third_party", "third-party", "node_modules", "__pycache__", "target", "build", "dist"]
NOTHING = '{"results": []}'


def engine_output(folder: str, rules: list[Rule], binary: str = "semgrep", timeout: float = 300) -> str:
    """The engine's JSON over a folder. If there is no engine, or it fails or takes too long, it has found nothing."""
    given = engine_rules(rules)
    if not given["rules"]:
        return NOTHING
    with tempfile.TemporaryDirectory() as place:  # the driver's own file, for the driver's own child
        file = Path(place) / "rules.yaml"
        file.write_text(dump_yaml(given), encoding="utf-8")
        apart = [x for name in EXCLUDED for x in ("--exclude", name)]
        try:
            done = subprocess.run([binary, "--config", str(file), "--json", "--no-git-ignore", "--quiet", *apart, "."], cwd=folder, capture_output=True, timeout=timeout, check=False)
        except (OSError, subprocess.TimeoutExpired):
            return NOTHING
    return done.stdout.decode("utf-8", "replace").strip() or NOTHING


def engine_findings(spark: SparkSession, folder: str, rules: list[Rule], **how) -> DataFrame:
    """Findings of the external engine, with absolute paths, and categories by rule id."""
    found = flatten_engine(spark.createDataFrame([(engine_output(folder, rules, **how),)], "report string"))
    return found.withColumn("file", T.absolute_path(folder, F.col("file"))).withColumn("category", T.category(F.col("rule_id")))
