"""Queries on nearest, range and graph relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumensift.functions import cron
from lumensift.operators import aggregates as A
from lumensift.operators import findings as N
from lumensift.operators import graph as G
from lumensift.operators import joins as J
from lumensift.operators.tables import settled
from lumensift.plans.data import EDGES_CTE, FEEDBACK_CTE, FINDINGS_CTE, KNOWN_CTE, TRIAGE_CTE, edges, feedback, findings, known, stored_findings, table, values
from lumensift.plans.registry import query
from lumensift.streaming import throttle as S

HALF_HOUR = 1_800_000_000


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error'), p AS (SELECT user_id, event_id AS near_event_id, epoch_us(ts) AS near_at FROM events WHERE event_type = 'purchase'),
    r AS (SELECT e.event_id, near_event_id, abs(near_at - t) AS distance, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(near_at - t), near_event_id) AS k FROM e JOIN p USING (user_id) WHERE abs(near_at - t) <= 21600000000)
    SELECT e.event_id, r.near_event_id, r.distance FROM e LEFT JOIN r ON r.event_id = e.event_id AND k = 1""")
def asof_nearest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    left, right = (events.where(F.col("event_type") == t).drop("event_type") for t in ("error", "purchase"))
    return J.nearest(left, right, "user_id", "at", 21_600_000_000, ["event_id"], "event_id").select("event_id", "near_event_id", "distance")


@query(f"""WITH {FINDINGS_CTE}, h AS (SELECT file, line AS near_line, ord AS near_ord FROM findings WHERE rule_id = 'naming-loud-token'),
    r AS (SELECT f.ord, near_line, row_number() OVER (PARTITION BY f.ord ORDER BY abs(near_line - f.line), near_ord) AS k FROM findings f JOIN h USING (file) WHERE f.rule_id <> 'naming-loud-token' AND abs(near_line - f.line) <= 5)
    SELECT f.ord, r.near_line FROM findings f LEFT JOIN r ON r.ord = f.ord AND k = 1 WHERE f.rule_id <> 'naming-loud-token'""")
def finding_call_chain(spark, sf_dir):
    found = stored_findings(spark, sf_dir, "file", "line", "ord", "rule_id")
    methods = found.where("rule_id = 'naming-loud-token'").select("file", "line", "ord")
    return J.nearest(found.where("rule_id <> 'naming-loud-token'").drop("rule_id"), methods, "file", "line", 5, ["ord"], "ord").select("ord", "near_line")


@query(f"""WITH {FINDINGS_CTE}, c AS (SELECT DISTINCT file, line AS changed_line FROM findings WHERE severity = 'INFO' AND doc_id % 2 = 0)
    SELECT ord FROM findings f WHERE EXISTS (SELECT 1 FROM c WHERE c.file = f.file AND changed_line BETWEEN f.line AND f.end_line) OR f.file NOT IN (SELECT file FROM c)""")
def interval_semi_join(spark, sf_dir):
    found = stored_findings(spark, sf_dir, "ord", "file", "line", "end_line", "severity", "doc_id")
    changed = found.where("severity = 'INFO' AND doc_id % 2 = 0").select("file", F.col("line").alias("changed_line")).distinct()
    return J.overlapping(found, changed, "file").select("ord")


KEPT = ["doc_id", "lang", "rule_id", "file", "line", "end_line", "ord"]


def _validated(spark, sf_dir, how, slack=2):
    found = stored_findings(spark, sf_dir, *KEPT)
    return J.known_found(known(found, spark, sf_dir), found.where("(doc_id + line) % 5 <> 0"), how, slack)


def _known_sql(condition: str) -> str:
    return f"WITH {FINDINGS_CTE}, {KNOWN_CTE} SELECT known_id, EXISTS (SELECT 1 FROM found f WHERE f.file = k.file AND {condition}) AS detected FROM known k"


@query(_known_sql("f.line = k.line AND f.rule_id = k.rule_id"))
def validation_exact(spark, sf_dir):
    return _validated(spark, sf_dir, "exact").select("known_id", "detected")


@query(_known_sql("abs(f.line - k.line) <= 2"))
def validation_band(spark, sf_dir):
    return _validated(spark, sf_dir, "line").select("known_id", "detected")


@query(_known_sql("abs(f.line - k.line) <= 2 AND f.rule_id = k.rule_id"))
def validation_band_rule(spark, sf_dir):
    return _validated(spark, sf_dir, "rule").select("known_id", "detected")


@query(_known_sql("k.line BETWEEN f.line - 5 AND f.end_line + 5"))
def validation_range(spark, sf_dir):
    return _validated(spark, sf_dir, "range", 5).select("known_id", "detected")


@query(f"WITH {FINDINGS_CTE} SELECT ord, rule_id FROM findings WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def safe_file_fp(spark, sf_dir):
    safe = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return findings(spark, sf_dir).join(safe, "doc_id", "left_semi").select("ord", "rule_id")


@query(f"""WITH {FINDINGS_CTE}, {KNOWN_CTE}, k AS (SELECT EXISTS (SELECT 1 FROM found f WHERE f.file = k.file AND abs(f.line - k.line) <= 2 AND f.rule_id = k.rule_id) AS d FROM known k),
    r AS (SELECT EXISTS (SELECT 1 FROM known k WHERE f.file = k.file AND abs(f.line - k.line) <= 2 AND f.rule_id = k.rule_id) AS d FROM found f WHERE doc_id IN (SELECT doc_id FROM labels)),
    c AS (SELECT (SELECT count(*) FROM k) AS n_known, (SELECT count(*) FROM k WHERE d) AS n_hit, (SELECT count(*) FROM r) AS n_found, (SELECT count(*) FROM r WHERE d) AS n_right),
    m AS (SELECT *, round(CASE WHEN n_known > 0 THEN n_hit / n_known::DOUBLE ELSE 0 END, 6) AS recall, round(CASE WHEN n_found > 0 THEN n_right / n_found::DOUBLE ELSE 0 END, 6) AS precision FROM c)
    SELECT *, round(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END, 6) AS f1, round(CASE WHEN n_found > 0 THEN (n_found - n_right) / n_found::DOUBLE ELSE 0 END, 6) AS false_positive_rate,
      round(CASE WHEN n_known > 0 THEN (n_known - n_hit) / n_known::DOUBLE ELSE 0 END, 6) AS false_negative_rate FROM m""")
def confusion_metrics(spark, sf_dir):
    found = stored_findings(spark, sf_dir, *KEPT)
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct()
    truth, shown = known(found, spark, sf_dir), found.where("(doc_id + line) % 5 <> 0")
    hit = J.known_found(truth, shown, "rule").agg(F.count(F.lit(1)).alias("n_known"), F.count_if("detected").alias("n_hit"))
    own = shown.join(labelled, "doc_id", "left_semi").select(F.col("ord").alias("known_id"), "file", "line", "rule_id")
    right = J.known_found(own, truth.withColumn("end_line", F.col("line")), "rule").agg(F.count(F.lit(1)).alias("n_found"), F.count_if("detected").alias("n_right"))
    one = hit.crossJoin(right)  # one row each
    return one.select("*", *A.confusion(F.col("n_known"), F.col("n_hit"), F.col("n_found"), F.col("n_right")))


@query(f"""WITH {FINDINGS_CTE}, {KNOWN_CTE}, k AS (SELECT lang, rule_id, EXISTS (SELECT 1 FROM found f WHERE f.file = k.file AND abs(f.line - k.line) <= 2) AS d FROM known k)
    SELECT lang, rule_id, count(*) AS n, count(*) FILTER (d) AS detected, round(count(*) FILTER (d) / count(*)::DOUBLE, 6) AS rate FROM k GROUP BY ALL""")
def detection_by_group(spark, sf_dir):
    n, hit = F.count(F.lit(1)), F.count_if("detected")
    return _validated(spark, sf_dir, "line").groupBy("lang", "rule_id").agg(n.alias("n"), hit.alias("detected"), A.ratio(hit, n).alias("rate"))


@query(f"""WITH {TRIAGE_CTE}, {FEEDBACK_CTE}, a AS (SELECT file, rule_id, min(ai_action) AS x FROM decided GROUP BY ALL),
    b AS (SELECT file, rule_id, min(CASE verdict WHEN 'confirmed' THEN 'keep' WHEN 'false_positive' THEN 'drop' ELSE 'needs_review' END) AS y FROM findings JOIN feedback USING (doc_id) GROUP BY ALL)
    SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_common, count(*) AS n_union, count(*) FILTER (x = y) AS n_same FROM a FULL JOIN b USING (file, rule_id)""")
def reviewer_agreement(spark, sf_dir):
    base = stored_findings(spark, sf_dir, "doc_id", "file", "rule_id", "code_snippet", "ai_confidence")
    verdict = F.when(F.col("verdict") == "confirmed", "keep").when(F.col("verdict") == "false_positive", "drop").otherwise("needs_review")
    other = base.join(feedback(spark, sf_dir), "doc_id").select("file", "rule_id", verdict.alias("ai_action"))
    return J.agreement(N.decided(N.prefilter(base)).select("file", "rule_id", "ai_action"), other, ["file", "rule_id"], "ai_action")


@query("SELECT c.conv_id, c.turn, coalesce(array_to_string(list(p.role || p.turn ORDER BY p.turn) FILTER (p.turn IS NOT NULL), '|'), '') AS earlier FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn < c.turn GROUP BY ALL")
def triangular_self_join(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", "turn").alias("name"))
    return J.earlier_in_group(turns, "conv_id", "turn", "name").select("conv_id", "turn", F.array_join("earlier", "|").alias("earlier"))


@query("WITH n AS (SELECT conv_id, role || turn AS src, lead(role || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations) SELECT * FROM n WHERE dst IS NOT NULL")
def adjacent_edges(spark, sf_dir):
    return J.next_in_group(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", "turn").alias("name")), "conv_id", "turn", "name")


NODES_CTE = "nodes AS (SELECT 'e' || event_id AS name, user_id || ':' || event_id AS node_id FROM events UNION ALL SELECT 'e' || event_id, 'copy:' || event_id FROM events WHERE event_id % 10 = 0)"


@query(f"WITH {EDGES_CTE}, {NODES_CTE} SELECT a.node_id AS from_id, b.node_id AS to_id FROM edges JOIN nodes a ON a.name = src JOIN nodes b ON b.name = dst")
def edge_resolution(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    name = F.concat(F.lit("e"), "event_id").alias("name")
    nodes = events.select(name, F.concat_ws(":", "user_id", "event_id").alias("node_id")).unionByName(events.where("event_id % 10 = 0").select(name, F.concat(F.lit("copy:"), "event_id").alias("node_id")))
    return G.resolved(edges(spark, sf_dir), nodes)


@query(f"WITH {EDGES_CTE}, s AS (SELECT 'e' || event_id AS node FROM events WHERE event_type IN ('view', 'click')) SELECT src, dst FROM edges WHERE src IN (SELECT node FROM s) AND dst IN (SELECT node FROM s)")
def edge_semi_join(spark, sf_dir):
    nodes = table(spark, sf_dir, "events").where("event_type IN ('view', 'click')").select(F.concat(F.lit("e"), "event_id").alias("node"))
    return G.induced(edges(spark, sf_dir), nodes).select("src", "dst")


@query(f"WITH {EDGES_CTE} SELECT dst AS node, array_to_string(list_sort(list(DISTINCT src)), '|') AS callers FROM edges GROUP BY 1")
def adjacency_sets(spark, sf_dir):
    return G.adjacency(edges(spark, sf_dir)).select("node", F.array_join("callers", "|").alias("callers"))


SEEDS_CTE = "seeds AS (SELECT 'e' || event_id AS node FROM events WHERE event_type = 'purchase')"
REACHED_CTE = f"{EDGES_CTE}, {SEEDS_CTE}, reached AS (SELECT node FROM seeds UNION SELECT e.src FROM edges e JOIN reached r ON e.dst = r.node)"


def _edges(spark, sf_dir):
    """The edges as a written table: a search uses them in every round."""
    return settled(edges(spark, sf_dir))


def _seeds(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.concat(F.lit("e"), "event_id").alias("node"))


@query(f"WITH RECURSIVE {REACHED_CTE} SELECT node FROM reached")
def bfs_affected(spark, sf_dir):
    return G.reached(_edges(spark, sf_dir), _seeds(spark, sf_dir)).select("node")


@query(f"WITH RECURSIVE {REACHED_CTE} SELECT src, dst FROM edges WHERE src IN (SELECT node FROM reached) AND dst IN (SELECT node FROM reached)")
def induced_subgraph(spark, sf_dir):
    near = _edges(spark, sf_dir)
    return G.induced(near, G.reached(near, _seeds(spark, sf_dir))).select("src", "dst")


@query(f"""WITH RECURSIVE {EDGES_CTE}, callers AS (SELECT dst, min(src) AS caller FROM edges WHERE src <> dst GROUP BY 1), starts AS (SELECT 'e' || event_id AS node FROM events WHERE event_type = 'purchase'),
    c AS (SELECT node AS start, [node] AS chain, 1 AS d FROM starts UNION ALL SELECT c.start, list_append(chain, caller), d + 1 FROM c JOIN callers ON dst = chain[-1] WHERE d < 5 AND NOT list_contains(chain, caller))
    SELECT start, array_to_string(max_by(chain, d), '>') AS chain FROM c GROUP BY 1""")
def call_chain_depth5(spark, sf_dir):
    starts = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.concat(F.lit("e"), "event_id").alias("node"))
    return G.chains(edges(spark, sf_dir), starts).select("start", F.array_join("chain", ">").alias("chain"))


TREE = [(1, None, "program"), (2, 1, "class"), (3, 2, "method"), (4, 3, "call"), (5, 3, "block"), (6, 5, "call"), (7, 2, "method"), (8, 7, "return")]


@query(f"WITH RECURSIVE t AS (SELECT * FROM {values(TREE, 'id, parent, type')}), d AS (SELECT parent AS root, id, type FROM t WHERE parent IS NOT NULL UNION ALL SELECT d.root, t.id, t.type FROM d JOIN t ON t.parent = d.id) SELECT root, id FROM d WHERE type = 'call'")
def ast_descendants(spark, sf_dir):
    return G.descendants(spark.createDataFrame(TREE, "id int, parent int, type string"), "call")


CRONS = [("0 2 * * *",), ("30 8 * * 1,2,3,4,5",), ("*/15 * * * *",), ("0 9-17 * * *",), ("60 * * * *",), ("* 24 * * *",), ("* * 0 * *",), ("* * * 13 *",), ("* * * * 8",), ("* * * *",), ("",), ("a * * * *",), ("1-2-3 * * * *",), ("*/0 * * * *",), ("* * */0 * *",), ("5 4 1,15 */2 0-6",)]


def _field_sql(i: int, low: int, high: int) -> str:
    number = lambda x: f"coalesce(try_cast(CASE WHEN regexp_full_match({x}, '\\+?[0-9]{{1,9}}') THEN {x} END AS INT) BETWEEN {low} AND {high}, false)"
    v = f"p[{i + 1}]"
    part = f"CASE WHEN contains(x, '-') THEN len(string_split(x, '-')) = 2 AND list_bool_and(list_transform(string_split(x, '-'), lambda y: {number('y')})) ELSE {number('x')} END"
    return f"CASE WHEN {v} = '*' THEN true WHEN starts_with({v}, '*/') THEN {number(f'substr({v}, 3)')} ELSE list_bool_and(list_transform(string_split({v}, ','), lambda x: {part})) END"


CRON_CTE = "c AS (SELECT expr, string_split_regex(trim(expr), '\\s+') AS p FROM " + values(CRONS, "expr") + "), v AS (SELECT expr, p, len(p) = 5 AND " + " AND ".join(_field_sql(i, lo, hi) for i, (_, lo, hi) in enumerate(cron.FIELDS)) + " AS valid FROM c)"


@query(f"WITH {CRON_CTE} SELECT expr, coalesce(valid, false) AS valid FROM v")
def cron_validate(spark, sf_dir):
    return spark.createDataFrame(CRONS, "expr string").select("expr", cron.valid(F.col("expr")).alias("valid"))


@query(f"""WITH {CRON_CTE}, n AS (SELECT o_orderkey, o_orderdate + to_minutes((o_orderkey % 1440)::INT) AS now FROM orders),
    a AS (SELECT o_orderkey, expr, now, date_trunc('day', now) + to_hours(CASE WHEN p[2] = '*' THEN 0 ELSE try_cast(p[2] AS INT) END) + to_minutes(CASE WHEN p[1] = '*' THEN 0 ELSE try_cast(p[1] AS INT) END) AS t FROM n, v WHERE valid)
    SELECT o_orderkey, expr, strftime(CASE WHEN t <= now THEN t + INTERVAL 1 DAY ELSE t END, '%Y-%m-%d %H:%M:%S') AS next_run FROM a""")
def cron_next_run(spark, sf_dir):
    now = F.col("o_orderdate").cast("timestamp") + F.make_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", now.alias("now"))
    exprs = spark.createDataFrame(CRONS, "expr string").where(cron.valid(F.col("expr")))
    pairs = orders.crossJoin(exprs)  # a list of a few schedules
    return pairs.select("o_orderkey", "expr", F.date_format(cron.next_run(F.col("expr"), F.col("now")), "yyyy-MM-dd HH:mm:ss").alias("next_run"))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error'),
    s AS (SELECT user_id, k, t, t AS last, true AS go FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, e.t, CASE WHEN e.t - s.last >= 86400000000 THEN e.t ELSE s.last END, e.t - s.last >= 86400000000 FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
    SELECT user_id, t AS sent_at FROM s WHERE go""")
def alert_throttle(spark, sf_dir):
    alerts = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return S.throttle(alerts, "user_id", "at", 86_400_000_000)
