"""Queries that must cover all of their rows, against SQL that does."""

from __future__ import annotations

from collections import Counter

import duckdb

from lumensift.plans import registry

SF = "/root/testdata/sf0.001"


def same_rows(spark, name, folder=SF, tables=("documents", "labels", "events", "orders")):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, folder).select(*want.columns)
    rows = Counter(tuple(r) for r in got.collect())
    assert rows == Counter(want.fetchall())
    return rows


def test_report_has_all_findings(spark):
    rows = same_rows(spark, "report_markdown_lines")
    assert len({rank for rank, *_ in rows}) > 50


def test_every_order_has_next_runs(spark):
    rows = same_rows(spark, "cron_next_run")
    assert len({order for order, *_ in rows}) == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_long_conversations_keep_all_turns(spark, tmp_path):
    turns = [(c, t, ("user", "assistant")[t % 2], "x") for c, n in ((1, 40), (2, 13), (3, 1)) for t in range(n)]
    some = f"{', '.join(map(str, turns))}, (NULL, 3, 'user', 'x'), (2, NULL, 'user', 'x'), (3, 4, NULL, 'x'), (3, 5, 'user', 'x')"
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {some}) t(conv_id, turn, role, text)) TO '{tmp_path}/conversations.parquet'")
    rows = same_rows(spark, "triangular_self_join", folder=tmp_path, tables=("conversations",))
    assert len(rows) == len(turns) + 4


def test_reachability_starts_at_all_purchases(spark):
    seeds = {f"e{i}" for (i,) in duckdb.sql(f"SELECT event_id FROM '{SF}/events.parquet' WHERE event_type = 'purchase'").fetchall()}
    assert seeds <= {node for (node,) in same_rows(spark, "bfs_affected")}
    assert same_rows(spark, "induced_subgraph")
