"""What this folder adds to the driver's entry point."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from lumensift.llm import oracle, queries as q


def queries() -> dict[str, Callable]:
    own = {name: f for name, f in vars(q).items() if name.startswith("op") and name[2:3].isdigit()}
    return own | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
