"""Queries over the star-schema tables, each with its SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions import clock, ids, paths, scoring
from quarrylight.operators import aggregates, graph, joins, ledger, lookup, upsert
from quarrylight.plans import architecture, audit, history, search, symbols
from quarrylight.proxies import Tables
from quarrylight.registry import ORACLE, QUERIES, query, rounded
from quarrylight.session import shared_folder
from quarrylight.streaming import alerts, detectors, windows

# SQL shared by several queries --------------------------------------------------------------------------------------

TOUCHED = "touched AS (SELECT DISTINCT l_orderkey AS sha, l_partkey AS path FROM lineitem)"
CHURN = f"""{TOUCHED}, last AS (SELECT max(o_orderdate) AS t FROM orders),
churn AS (SELECT path, count(*) AS churn FROM touched JOIN orders ON sha = o_orderkey, last
          WHERE o_orderdate >= t - INTERVAL 90 DAY GROUP BY path),
spots AS (SELECT p_partkey AS path, p_size AS ccn_total, coalesce(churn, 0) AS churn_count,
                 ln(1 + p_size) * ln(1 + coalesce(churn, 0)) AS score
          FROM part LEFT JOIN churn ON p_partkey = path)"""
SEVERITY = "CASE WHEN score >= 5 THEN 'critical' WHEN score >= 3 THEN 'high' WHEN score >= 1.5 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'informational' END"
OWNERS = f"""{TOUCHED}, last AS (SELECT max(o_orderdate) AS t FROM orders),
blamed AS (SELECT l_partkey AS path, l_suppkey AS author, sum(l_quantity) AS lines FROM lineitem GROUP BY 1, 2),
churned AS (SELECT path, o_custkey AS author, sum(exp(-(epoch(t) - epoch(o_orderdate)) / (90 * 86400.0))) AS recency, count(*) AS commits
            FROM touched JOIN orders ON sha = o_orderkey JOIN customer ON o_custkey = c_custkey, last
            WHERE o_orderstatus <> 'P' AND c_mktsegment <> 'MACHINERY' GROUP BY 1, 2),
a AS (SELECT *, lines / sum(lines) OVER (PARTITION BY path) AS blame_share FROM blamed),
b AS (SELECT *, recency / sum(recency) OVER (PARTITION BY path) AS churn_share FROM churned),
owners AS (SELECT path, author, coalesce(blame_share, 0) AS blame_share, coalesce(churn_share, 0) AS churn_share,
                  0.5 * coalesce(blame_share, 0) + 0.5 * coalesce(churn_share, 0) AS weight,
                  coalesce(lines, 0) AS lines_attributed, coalesce(commits, 0) AS commit_count
           FROM a FULL JOIN b USING (path, author))"""
SHADOW = """shadow AS (SELECT event_id AS key, user_id AS symbol, CASE WHEN event_type = 'signup' THEN 'def' ELSE 'use' END AS kind,
                  value / (SELECT max(value) FROM events) AS importance, ts AS last_seen FROM events)"""
USES = """uses AS (SELECT c_nationkey AS consumer, s_nationkey AS producer, l_partkey AS symbol, l_orderkey AS path, year(o_orderdate) AS y
                  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
EDGES = f"""{USES}, edges AS (SELECT src, dst FROM (
              SELECT consumer AS src, producer AS dst, row_number() OVER (PARTITION BY consumer ORDER BY count(*) DESC, producer) AS r
              FROM uses WHERE consumer <> producer GROUP BY 1, 2) WHERE r <= 2)"""
RUNS = "runs AS (SELECT event_id AS run_id, user_id AS project, event_type AS extractor, ts AS started_at, event_type <> 'error' AS success, value FROM events)"


# history ------------------------------------------------------------------------------------------------------------


def _hotspots(t: Tables) -> DataFrame:
    return history.hotspots(t.files(), t.touched(), t.commits(), t.last_commit())


@query(f"WITH {CHURN} SELECT path, ccn_total, churn_count, round(score, 6) AS hotspot_score, {SEVERITY} AS severity FROM spots")
def hotspots(t: Tables) -> DataFrame:
    return rounded(_hotspots(t), "hotspot_score")


@query(f"WITH {CHURN} SELECT path, ccn_total, churn_count, round(score, 6) AS hotspot_score, {SEVERITY} AS severity FROM spots WHERE score >= 0.5 ORDER BY score DESC, path LIMIT 20")
def find_hotspots(t: Tables) -> DataFrame:
    return rounded(history.find_hotspots(_hotspots(t), 20, 0.5), "hotspot_score")


@query(f"WITH {CHURN} SELECT {SEVERITY} AS severity, count(*) AS n FROM spots GROUP BY 1")
def hotspot_severity_counts(t: Tables) -> DataFrame:
    return _hotspots(t).groupBy("severity").agg(F.count("*").alias("n"))


@query(f"WITH {CHURN} SELECT p_partkey AS path, coalesce(churn, 0) AS churn FROM part LEFT JOIN churn ON p_partkey = path")
def churn_with_zero(t: Tables) -> DataFrame:
    return history.churn(t.files(), t.touched(), t.commits(), t.last_commit(), 90)


def _owners(t: Tables) -> DataFrame:
    churned = history.recency_churn(t.touched(), t.commits(), t.authors(), F.lit(t.last_commit()), 90.0, parts=t.parts("lineitem"))
    return history.ownership(t.blame(), churned, parts=t.parts("lineitem"))


@query(f"WITH {OWNERS} SELECT path, author, round(weight + 1e-9, 6) AS weight, round(blame_share + 1e-9, 6) AS blame_share, round(churn_share + 1e-9, 6) AS churn_share, lines_attributed, commit_count FROM owners WHERE weight > 0")
def ownership(t: Tables) -> DataFrame:
    lifted = {c: F.col(c) + 1e-9 for c in ("weight", "blame_share", "churn_share")}  # off the halves that round either way
    return rounded(_owners(t).drop("last_touched_at").withColumns(lifted), *lifted)


@query(f"""WITH {OWNERS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY round(weight, 9) DESC, author) AS r, count(*) OVER (PARTITION BY path) AS total_authors FROM owners WHERE weight > 0)
SELECT path, author, round(weight + 1e-9, 6) AS weight, total_authors FROM ranked WHERE r <= 3""")
def find_owners(t: Tables) -> DataFrame:
    edges = _owners(t).withColumns({"shown": F.round(F.col("weight") + 1e-9, 6), "weight": F.round("weight", 9)})  # near ties go by author
    return history.find_owners(edges, 3).select("path", "author", F.col("shown").alias("weight"), "total_authors")


@query(f"""WITH {OWNERS}, best AS (SELECT path, max(weight) AS top FROM owners WHERE weight > 0 GROUP BY path)
SELECT CASE WHEN top < 0.1 THEN 'high' WHEN top < 0.2 THEN 'medium' ELSE 'informational' END AS severity, count(*) AS files FROM best GROUP BY 1""")
def diffuse_ownership(t: Tables) -> DataFrame:
    best = _owners(t).groupBy("path").agg(F.max("weight").alias("top"))
    return best.groupBy(scoring.ownership_severity(F.col("top")).alias("severity")).agg(F.count("*").alias("files"))


@query("""SELECT coalesce(a.l_partkey, b.l_partkey) AS path, CASE WHEN b.l_partkey IS NULL THEN 'deleted' ELSE 'dirty' END AS state
FROM (SELECT l_partkey, sum(l_quantity) AS blob FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1) a
FULL JOIN (SELECT l_partkey, sum(l_quantity) AS blob FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-03-01' GROUP BY 1) b ON a.l_partkey = b.l_partkey
WHERE a.blob IS DISTINCT FROM b.blob""")
def dirty_files(t: Tables) -> DataFrame:
    rows = t.read("lineitem")
    manifest = lambda c: rows.where(c).groupBy(F.col("l_partkey").alias("path")).agg(F.sum("l_quantity").alias("blob"))
    return history.dirty_files(manifest("l_shipdate < '1997-01-01'"), manifest("l_shipdate >= '2001-03-01'"))


@query("SELECT c_custkey AS author, CASE WHEN c_mktsegment = 'MACHINERY' THEN true ELSE false END AS bot FROM customer")
def bot_authors(t: Tables) -> DataFrame:
    rows = t.read("customer").withColumn("name", F.when(F.col("c_mktsegment") == "MACHINERY", F.concat("c_name", F.lit("[bot]"))).otherwise(F.col("c_name")))
    return rows.select(F.col("c_custkey").alias("author"), paths.is_bot(F.lit(None).cast("string"), F.col("name")).alias("bot"))


@query("""WITH raw AS (SELECT o_orderkey, 'alias-' || CAST(CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 1 ELSE c_custkey END AS VARCHAR) AS author FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT author, count(*) AS commits FROM raw GROUP BY 1""")
def mailmap_commits(t: Tables) -> DataFrame:
    name = F.concat(F.lit("Alias-"), F.col("o_custkey").cast("string"))
    own = F.col("c_custkey")
    aliases = t.read("customer").select(F.concat(F.lit("alias-"), own.cast("string")).alias("raw"), F.concat(F.lit("ALIAS-"), F.when(own % 10 == 0, own + 1).otherwise(own).cast("string")).alias("canonical"))
    known = t.read("orders").join(t.read("customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = joins.canonical(known.select(name.alias("author")), aliases, "author")
    return rows.groupBy("author").agg(F.count("*").alias("commits"))


# symbols ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {SHADOW}, r1 AS (SELECT key FROM shadow WHERE kind <> 'def' AND importance < 0.05 ORDER BY importance, last_seen, key LIMIT 500),
l1 AS (SELECT * FROM shadow WHERE key NOT IN (SELECT key FROM r1)),
r2 AS (SELECT key FROM (SELECT key, row_number() OVER (PARTITION BY symbol ORDER BY last_seen DESC, key DESC) AS r FROM l1 WHERE kind <> 'def') WHERE r > 40),
l2 AS (SELECT * FROM l1 WHERE key NOT IN (SELECT key FROM r2)),
r3 AS (SELECT key FROM l2 WHERE kind <> 'def' ORDER BY importance, last_seen, key LIMIT (SELECT greatest(0, count(*) - 3000) FROM l2))
SELECT key, symbol, kind, CASE WHEN key IN (SELECT key FROM r1) THEN 1 WHEN key IN (SELECT key FROM r2) THEN 2 WHEN key IN (SELECT key FROM r3) THEN 3 END AS evicted_in FROM shadow""")
def eviction(t: Tables) -> DataFrame:
    return symbols.evict(t.shadow(), "key", 0.05, 40, 3000, 500).select("key", "symbol", "kind", "evicted_in")


@query(f"""WITH {SHADOW}, last AS (SELECT max(last_seen) AS t FROM shadow), deg AS (SELECT symbol, count(*) AS n FROM shadow GROUP BY 1)
SELECT key, round(greatest(0, least(1, 0.35 * ln(1 + n) / ln(101) + 0.30 * 1.0 + 0.20 * CASE kind WHEN 'def' THEN 1.0 ELSE 0.3 END
 + 0.10 * exp(-ln(2) * ((epoch(t) - epoch(last_seen)) / 86400.0) / 30.0) + 0.05 * 0.5)), 6) AS importance
FROM shadow JOIN deg USING (symbol), last""")
def importance(t: Tables) -> DataFrame:
    rows = t.shadow()
    degree = rows.groupBy("symbol").agg(F.count("*").alias("n"))
    last = rows.agg(F.max("last_seen")).first()[0]
    days = (F.unix_micros(F.lit(last)) - F.unix_micros("last_seen")) / 86400e6
    score = scoring.importance(F.col("n"), scoring.tier_weight(F.lit("src/a.py")), scoring.kind_weight(F.col("kind")), days, scoring.language_weight(F.lit("python"), None))
    return rows.join(degree, "symbol").select("key", F.round(score, 6).alias("importance"))


@query(f"""WITH {SHADOW}, ev AS (SELECT symbol, count(*) AS evicted FROM shadow WHERE importance < 0.02 AND kind <> 'def' GROUP BY 1),
f AS (SELECT symbol, count(*) AS n FROM shadow WHERE NOT (importance < 0.02 AND kind <> 'def') GROUP BY 1),
asked AS (SELECT DISTINCT symbol FROM shadow UNION SELECT -1 - symbol FROM shadow),
indexed AS (SELECT DISTINCT user_id % 11 AS project FROM events WHERE event_type = 'error' AND value > 70)
SELECT symbol % 11 AS project, symbol, coalesce(n, 0) AS "references", coalesce(evicted, 0) AS evicted, CASE WHEN symbol % 11 NOT IN (SELECT project FROM indexed) THEN 'not_indexed' WHEN coalesce(evicted, 0) > 0 THEN 'partial' ELSE 'ok' END AS state,
CASE WHEN coalesce(n, 0) + coalesce(evicted, 0) = 0 THEN 100 ELSE CAST(floor(100 * coalesce(n, 0) / (coalesce(n, 0) + coalesce(evicted, 0))) AS INTEGER) END AS coverage_pct
FROM asked LEFT JOIN f USING (symbol) LEFT JOIN ev USING (symbol)""")
def find_references(t: Tables) -> DataFrame:
    rows = t.shadow().withColumn("project", F.col("symbol") % 11)
    gone = (F.col("importance") < 0.02) & (F.col("kind") != "def")
    unknown = rows.select((-1 - F.col("symbol")).alias("symbol")).withColumn("project", F.col("symbol") % 11)
    runs = t.runs().where("extractor = 'error' and value > 70").withColumn("project", F.col("project") % 11)
    return symbols.find_references(rows.where(~gone), rows.where(gone), runs, rows.select("project", "symbol").unionByName(unknown))


@query(f"WITH {SHADOW} SELECT key, CASE WHEN kind = 'def' THEN 'phase1_defs' WHEN symbol % 4 <> 0 AND (SELECT count(*) FROM shadow WHERE kind = 'def') < 50000 THEN 'phase2_user_uses' WHEN symbol % 4 = 0 AND (SELECT count(*) FROM shadow WHERE kind = 'def' OR symbol % 4 <> 0) < 30000 THEN 'phase3_vendor_uses' END AS phase FROM shadow")
def ingest_phases(t: Tables) -> DataFrame:
    return symbols.phases(t.shadow().withColumn("vendor", F.col("symbol") % 4 == 0), 100_000).select("key", "phase")


SKEW = """deps AS (SELECT 'pkg:maven/' || replace(p_brand, '#', '_') AS purl_root, CAST(p_size // 10 AS VARCHAR) || '.' || CAST(p_size % 10 AS VARCHAR) || '.' || CAST(p_partkey % 3 AS VARCHAR) AS version,
 p_size // 10 AS major, p_size % 10 AS minor, p_type AS scope_id FROM part),
skew AS (SELECT purl_root, 'maven' AS ecosystem, count(DISTINCT version) AS version_count, count(DISTINCT scope_id) AS scopes,
 CASE WHEN count(DISTINCT version) < 2 THEN NULL WHEN count(DISTINCT major) > 1 THEN 'major' WHEN count(DISTINCT (major, minor)) > 1 THEN 'minor' ELSE 'patch' END AS severity,
 count(DISTINCT version) = 1 AS aligned FROM deps GROUP BY 1 HAVING count(DISTINCT scope_id) > 1)"""


@query(f"WITH {SKEW} SELECT * FROM skew")
def version_skew(t: Tables) -> DataFrame:
    return symbols.skew_groups(t.dependencies())


@query(f"WITH {SKEW} SELECT * FROM skew WHERE version_count > 1 AND severity IN ('major', 'minor') ORDER BY CASE severity WHEN 'major' THEN 3 WHEN 'minor' THEN 2 ELSE 1 END DESC, version_count DESC, purl_root LIMIT 10")
def find_version_skew(t: Tables) -> DataFrame:
    return symbols.find_skew(symbols.skew_groups(t.dependencies()), "minor", 10)


@query(f"WITH {USES} SELECT consumer, producer, symbol, count(*) AS use_count, count(DISTINCT path) AS file_count, min(path) AS first_path FROM uses WHERE consumer <> producer AND y = 1996 GROUP BY 1, 2, 3")
def contract_snapshot(t: Tables) -> DataFrame:
    return symbols.contract_snapshot(t.uses(1996)).drop("evidence_paths")


@query(f"""WITH {USES}, o AS (SELECT consumer, producer, symbol, count(*) AS n FROM uses WHERE consumer <> producer AND y = 1996 GROUP BY 1, 2, 3),
n AS (SELECT consumer, producer, symbol, count(*) AS n FROM uses WHERE consumer <> producer AND y = 1997 GROUP BY 1, 2, 3),
d AS (SELECT consumer, producer, count(*) FILTER (o.n IS NULL) AS added, count(*) FILTER (n.n IS NULL) AS removed, count(*) FILTER (o.n <> n.n) AS changed FROM o FULL JOIN n USING (consumer, producer, symbol) GROUP BY 1, 2)
SELECT *, CASE WHEN removed > 10 THEN 'high' WHEN removed > 3 THEN 'medium' WHEN removed > 0 THEN 'low' ELSE 'informational' END AS severity FROM d""")
def contract_delta(t: Tables) -> DataFrame:
    return symbols.contract_delta(symbols.contract_snapshot(t.uses(1996)), symbols.contract_snapshot(t.uses(1997)))


@query("""WITH last AS (SELECT max(o_orderdate) AS t FROM orders), used AS (SELECT DISTINCT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey, last WHERE o_orderdate >= t - INTERVAL 90 DAY)
SELECT p_partkey AS finding_id, p_name AS symbol_key, CASE WHEN p_size % 11 = 0 THEN 'skipped' WHEN (SELECT count(*) FROM part q WHERE q.p_name = part.p_name) > 1 THEN 'skipped'
 WHEN p_type LIKE 'PROMO%' THEN 'retained_public_api' WHEN p_partkey % 5 = 0 THEN 'blocked_by_contract' ELSE 'unused_candidate' END AS state,
CASE WHEN p_size % 11 = 0 THEN 'reported_skip' WHEN (SELECT count(*) FROM part q WHERE q.p_name = part.p_name) > 1 THEN 'ambiguous_symbol_match' END AS skip_reason,
CASE WHEN p_size % 11 = 0 OR (SELECT count(*) FROM part q WHERE q.p_name = part.p_name) > 1 THEN 'low' WHEN p_type LIKE 'PROMO%' OR p_partkey % 5 = 0 THEN 'medium' ELSE 'high' END AS confidence
FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM used)""")
def dead_symbols(t: Tables) -> DataFrame:
    since = t.last_commit() - timedelta(days=90)
    used = t.touched().join(t.commits().where(F.col("committed_at") >= F.lit(since)), "sha").select(F.col("path").alias("p_partkey"))
    part = t.read("part")
    findings = part.join(used, "p_partkey", "left_anti").select(
        F.col("p_partkey").alias("finding_id"), F.col("p_name").alias("symbol_key"), (F.col("p_size") % 11 == 0).alias("skipped"), F.lit(True).alias("has_place"), F.col("p_type").startswith("PROMO").alias("retain_public")
    )
    public = part.select(F.col("p_name").alias("symbol_key"), F.col("p_partkey").alias("public_id"))
    shadows = part.select(F.col("p_name").alias("symbol_key"), F.col("p_partkey").alias("symbol_id"))
    blocked = part.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("public_id"))
    return symbols.dead_symbols(findings, public, shadows, blocked).drop("skipped", "has_place", "retain_public")


# architecture -------------------------------------------------------------------------------------------------------


@query(f"WITH {EDGES} SELECT src, dst FROM edges")
def module_edges(t: Tables) -> DataFrame:
    return t.module_edges()


@query(f"""WITH RECURSIVE {EDGES}, reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src),
scc AS (SELECT a.src AS node, min(b.src) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)
SELECT node, least(node, component) AS component FROM scc WHERE component <> node OR node IN (SELECT component FROM scc WHERE node <> component)""")
def module_cycles(t: Tables) -> DataFrame:
    return graph.strong_components(t.module_edges())


@query(f"WITH RECURSIVE {EDGES}, reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src) SELECT src, dst FROM reach")
def module_reachability(t: Tables) -> DataFrame:
    return graph.reachability(t.module_edges())


@query(f"""WITH RECURSIVE {EDGES}, walk AS (SELECT dst AS node, 1 AS hop FROM edges WHERE src = 0 UNION SELECT e.dst, hop + 1 FROM walk JOIN edges e ON node = e.src WHERE hop < 3)
SELECT node, min(hop) AS hop FROM walk WHERE node <> 0 GROUP BY 1""")
def call_trace(t: Tables) -> DataFrame:
    return graph.trace(t.module_edges(), t.spark.range(0, 1).select(F.col("id").cast("int").alias("node")), 3)


@query(f"""WITH {EDGES}, imports AS (SELECT DISTINCT consumer AS src, CASE WHEN consumer < 5 THEN 24 - producer ELSE producer END AS dst FROM uses WHERE consumer <> producer)
SELECT 'layers' AS rule_id, 'forbidden_dependency' AS kind, 'high' AS severity, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM edges JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey WHERE a.n_regionkey IN (0, 1) AND b.n_regionkey = 2
UNION ALL SELECT 'globs', 'forbidden_module_glob_dependency', 'medium', CAST(src AS VARCHAR), CAST(dst AS VARCHAR) FROM edges WHERE CAST(src AS VARCHAR) LIKE '1%' AND CAST(dst AS VARCHAR) LIKE '2_'
UNION ALL SELECT 'unused', 'manifest_dep_actually_used', 'low', CAST(src AS VARCHAR), CAST(dst AS VARCHAR) FROM (SELECT src, dst FROM edges EXCEPT SELECT src, dst FROM imports)
UNION ALL SELECT 'undeclared', 'ast_dep_not_declared', 'medium', CAST(src AS VARCHAR), CAST(dst AS VARCHAR) FROM (SELECT src, dst FROM imports EXCEPT SELECT src, dst FROM edges)""")
def architecture_violations(t: Tables) -> DataFrame:
    text = lambda df: df.select(F.col("src").cast("string"), F.col("dst").cast("string"))
    rules, _ = architecture.read_rules(
        [
            {"id": "layers", "kind": "forbidden_dependency", "severity": "high", "from": ["0", "1"], "to": ["2"]},
            {"id": "globs", "kind": "forbidden_module_glob_dependency", "severity": "medium", "from": ["1*"], "to": ["2?"]},
            {"id": "unused", "kind": "manifest_dep_actually_used", "severity": "low"},
            {"id": "undeclared", "kind": "ast_dep_not_declared", "severity": "medium"},
        ]
    )
    used = F.when(F.col("consumer") < 5, 24 - F.col("producer")).otherwise(F.col("producer"))
    imports = t.uses().where("consumer <> producer").select(F.col("consumer").alias("src"), used.alias("dst"))
    layers = t.module_layers().select(F.col("module").cast("string"), "layer")
    return architecture.violations(rules, text(t.module_edges()), text(imports), layers)


@query("""WITH votes AS (SELECT p_brand AS module, p_type AS rule, CASE WHEN p_size < 30 THEN 'short' ELSE 'long' END AS choice, count(*) AS n FROM part GROUP BY 1, 2, 3),
best AS (SELECT module, rule, arg_max(choice, (n, choice)) AS choice, max(n) AS votes, sum(n) AS total FROM votes GROUP BY 1, 2)
SELECT module, rule, choice, votes, total, total - votes AS outliers, CASE WHEN total = votes THEN 'informational' WHEN (total - votes) / total >= 0.1 THEN 'high' ELSE 'medium' END AS severity FROM best WHERE total >= 5""")
def convention_outliers(t: Tables) -> DataFrame:
    return architecture.convention_outliers(t.read("part").select(F.col("p_brand").alias("module"), F.col("p_type").alias("rule"), F.when(F.col("p_size") < 30, "short").otherwise("long").alias("choice")))


@query("""SELECT f.event_id AS finding, coalesce(bool_or(m.event_id IS NOT NULL), false) AS suppressed FROM (SELECT event_id, user_id, event_id % 500 AS s, event_id % 500 + 3 AS e FROM events WHERE event_type <> 'signup') f
LEFT JOIN (SELECT event_id, user_id, event_id % 500 AS line FROM events WHERE event_type = 'signup') m ON f.user_id = m.user_id AND m.line >= f.s - 1 AND m.line <= f.e GROUP BY 1""")
def suppression_marks(t: Tables) -> DataFrame:
    events, line = t.read("events"), (F.col("event_id") % 500)
    findings = events.where("event_type <> 'signup'").select(F.col("event_id").alias("finding"), F.col("user_id").alias("path"), line.alias("start"), (line + 3).alias("end"))
    marks = events.where("event_type = 'signup'").select(F.col("user_id").alias("path"), line.alias("line"))
    return architecture.suppressed(findings, marks).select("finding", "suppressed")


# audit and bundles ----------------------------------------------------------------------------------------------------


@query(f"WITH {RUNS} SELECT project, extractor, arg_max(run_id, (started_at, run_id)) AS run_id, max(started_at) AS started_at FROM runs GROUP BY 1, 2")
def latest_runs(t: Tables) -> DataFrame:
    return audit.latest_runs(t.runs()).drop("success").withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


@query(f"WITH {RUNS} SELECT project, arg_max(run_id, (started_at, run_id)) AS run_id, arg_max(extractor, (started_at, run_id)) AS extractor FROM runs WHERE success GROUP BY 1")
def latest_successful_run(t: Tables) -> DataFrame:
    return lookup.latest(t.runs().where("success"), ["project"], [F.desc("started_at"), F.desc("run_id")]).select("project", "run_id", "extractor")


@query(f"""WITH {RUNS}, last AS (SELECT project, extractor, arg_max(success, (started_at, run_id)) AS ok FROM runs GROUP BY 1, 2),
p AS (SELECT DISTINCT project, CASE WHEN project % 2 = 0 THEN 'python' ELSE 'swift' END AS language FROM runs), x AS (SELECT DISTINCT extractor FROM runs UNION SELECT 'lint')
SELECT project, extractor, CASE WHEN language = 'python' AND extractor = 'error' OR language = 'swift' AND extractor = 'view' THEN 'NOT_APPLICABLE' WHEN ok IS NULL THEN 'NOT_ATTEMPTED' WHEN NOT ok THEN 'RUN_FAILED' ELSE 'OK' END AS status
FROM p CROSS JOIN x LEFT JOIN last USING (project, extractor)""")
def audit_status(t: Tables) -> DataFrame:
    runs = t.runs()
    projects = runs.select("project").distinct().withColumn("language", F.when(F.col("project") % 2 == 0, "python").otherwise("swift"))
    extractors = runs.select("extractor").distinct().unionByName(t.spark.createDataFrame([("lint",)], "extractor string"))
    profile = extractors.withColumn("language", F.explode(F.array(F.lit("python"), F.lit("swift")))).where("not (language = 'python' and extractor = 'error') and not (language = 'swift' and extractor = 'view')")
    return audit.audit_status(projects, extractors, profile, runs)


FINDINGS = """findings AS (SELECT event_type AS section, event_id AS position, CASE WHEN value >= 80 THEN 'critical' WHEN value >= 60 THEN 'HIGH' WHEN value >= 30 THEN 'medium' WHEN value >= 10 THEN 'low' ELSE 'odd' END AS severity FROM events),
ranked AS (SELECT *, CASE lower(severity) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS sr FROM findings)"""


def _findings(t: Tables) -> DataFrame:
    severity = F.when(F.col("value") >= 80, "critical").when(F.col("value") >= 60, "HIGH").when(F.col("value") >= 30, "medium").when(F.col("value") >= 10, "low").otherwise("odd")
    return t.read("events").select(F.col("event_type").alias("section"), F.col("event_id").alias("position"), severity.alias("severity"))


@query(f"""WITH {FINDINGS} SELECT section, position, severity, rank, total FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY sr, position) AS rank, count(*) OVER (PARTITION BY section) AS total FROM ranked) WHERE rank <= 25""")
def report_sections(t: Tables) -> DataFrame:
    return audit.sections(_findings(t), 25, F.col("position"))


@query(f"WITH {FINDINGS}, w AS (SELECT section, min(sr) AS worst, count(*) AS n FROM ranked GROUP BY 1) SELECT section, worst, n FROM w ORDER BY CASE section WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, worst, section")
def report_section_order(t: Tables) -> DataFrame:
    names = _findings(t).groupBy("section").agg(F.min(scoring.severity_rank(F.col("severity"))).alias("worst"), F.count("*").alias("n"))
    return audit.section_order(names, ["purchase", "view"])


@query(f"WITH {FINDINGS} SELECT CASE WHEN lower(severity) = 'odd' THEN 'informational' ELSE lower(severity) END AS severity, count(*) AS n FROM findings GROUP BY 1")
def parsed_severities(t: Tables) -> DataFrame:
    return _findings(t).groupBy(scoring.parsed_severity(F.col("severity")).alias("severity")).agg(F.count("*").alias("n"))


HEALTH = f"""{RUNS}, last AS (SELECT project, max(started_at) AS started_at, arg_max(success, (started_at, run_id)) AS ok FROM runs GROUP BY 1), now AS (SELECT max(ts) AS t FROM events),
m AS (SELECT DISTINCT user_id % 5 AS bundle, user_id AS member FROM events UNION SELECT DISTINCT user_id % 5, -1 - user_id FROM events),
health AS (SELECT bundle, member, CASE WHEN started_at IS NULL THEN 'never' WHEN NOT ok THEN 'failed' WHEN epoch(t) - epoch(started_at) < 86400 THEN 'fresh' ELSE 'stale' END AS health FROM m LEFT JOIN last ON member = project, now)"""


def _health(t: Tables) -> DataFrame:
    runs = t.runs().withColumnRenamed("project", "member")
    known = runs.select((F.col("member") % 5).alias("bundle"), "member").distinct()
    members = known.unionByName(known.withColumn("member", -1 - F.col("member")))  # each has a twin that never ran
    now = runs.agg(F.max("started_at")).first()[0]
    return audit.bundle_health(members, runs, F.lit(now), 1)


@query(f"WITH {HEALTH} SELECT * FROM health")
def bundle_health(t: Tables) -> DataFrame:
    return _health(t).drop("started_at")


@query(f"WITH {HEALTH} SELECT bundle, count(*) AS members, count(*) FILTER (health = 'fresh') AS fresh, count(*) FILTER (health = 'stale') AS stale, count(*) FILTER (health = 'failed') AS failed, count(*) FILTER (health = 'never') AS never FROM health GROUP BY 1")
def bundle_status(t: Tables) -> DataFrame:
    return audit.bundle_status(_health(t)).drop("oldest", "newest")


@query("SELECT 'customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'none', 0 UNION ALL SELECT 'events', count(*) FROM events")
def label_counts(t: Tables) -> DataFrame:
    tables = {x: t.read(x) for x in ("customer", "orders", "part", "events")}
    return aggregates.label_counts(tables | {"none": t.read("part").where("false")})


@query("SELECT n_name AS name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000 GROUP BY n_nationkey, n_name")
def counts_with_zero(t: Tables) -> DataFrame:
    dimension = t.read("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return aggregates.counts_with_zero(dimension, t.read("customer").withColumnRenamed("c_nationkey", "key"), ["key"], condition=F.col("c_acctbal") > 9000).select("name", "n")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (value > 50) AS large, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) * 100 // count(*) AS pct FROM events GROUP BY 1")
def one_pass_counts(t: Tables) -> DataFrame:
    large = F.count_if(F.col("value") > 50)
    return t.read("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), large.alias("large"), F.floor(large * 100 / F.count("*")).alias("pct"))


@query("SELECT section, library, example, test, other, total, total > 10 AND library = 0 AS no_library FROM (SELECT event_type AS section, count(*) FILTER (event_id % 4 = 0 AND event_type <> 'click') AS library, count(*) FILTER (event_id % 4 = 1) AS example, count(*) FILTER (event_id % 4 = 2) AS test, count(*) FILTER (event_id % 4 = 3 OR event_id % 4 = 0 AND event_type = 'click') AS other, count(*) AS total FROM events GROUP BY 1)")
def source_distribution(t: Tables) -> DataFrame:
    k = F.col("event_id") % 4
    path = F.when((k == 0) & (F.col("event_type") != "click"), "pkg/src/a.py").when(k == 1, "Examples/b.swift").when(k == 2, "pkg/tests/c.py").otherwise("docs/d.md")
    return audit.source_distribution(t.read("events").select(F.col("event_type").alias("section"), paths.source_context(path).alias("context")))


# relational kernel ----------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND coalesce(c_acctbal, 0) >= 1000 AND c_name LIKE '%1%' ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def filtered_lookup(t: Tables) -> DataFrame:
    known = {"segment": lookup.equals("c_mktsegment"), "min_balance": lookup.at_least("c_acctbal", 0.0), "name": lookup.contains("c_name"), "nation": lookup.equals("c_nationkey")}
    rows, _ = lookup.apply_filters(t.read("customer"), known, {"segment": "BUILDING", "min_balance": 1000.0, "name": "1", "nation": None, "colour": "red"})
    return lookup.page(rows, [F.desc("c_acctbal"), F.asc("c_custkey")], 50).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("SELECT count(*) AS total FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name LIKE 'Customer%'")
def lookup_total(t: Tables) -> DataFrame:
    known = {"segments": lookup.one_of("c_mktsegment"), "prefix": lookup.starts_with("c_name")}
    return lookup.apply_filters(t.read("customer"), known, {"segments": ["BUILDING", "MACHINERY"], "prefix": "Customer"})[0].agg(F.count("*").alias("total"))


@query("SELECT n_name, r_name, count(DISTINCT s_suppkey) AS suppliers FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def two_hop_join(t: Tables) -> DataFrame:
    rows = t.read("region").join(t.read("nation"), F.col("r_regionkey") == F.col("n_regionkey")).join(t.read("supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "r_name").agg(F.count_distinct("s_suppkey").alias("suppliers"))


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '2001-05-01')")
def anti_join(t: Tables) -> DataFrame:
    return t.read("part").join(t.read("lineitem").where("l_shipdate >= '2001-05-01'"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def semi_join(t: Tables) -> DataFrame:
    return t.read("customer").join(t.read("orders").where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS change, a.n AS old_n, b.n AS new_n FROM a FULL JOIN b ON a.k = b.k""")
def snapshot_diff(t: Tables) -> DataFrame:
    year = lambda y: t.read("orders").where(F.year("o_orderdate") == y).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return joins.snapshot_diff(year(1996), year(1997), ["k"], ["n"])


@query("SELECT p_partkey, p_name, CASE n WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status, CASE n WHEN 1 THEN one END AS value FROM part JOIN (SELECT p_name, count(DISTINCT p_partkey) AS n, min(p_partkey) AS one FROM part GROUP BY 1) USING (p_name)")
def ambiguous_lookup(t: Tables) -> DataFrame:
    part = t.read("part")
    known = part.select("p_name", F.col("p_partkey").alias("value"))
    return joins.ambiguous_lookup(part.select("p_partkey", "p_name"), known, ["p_name"], "value")


@query("""WITH f AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages), r AS (SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE 'none/' || path END AS root FROM f)
SELECT page_id, (SELECT arg_max(root, length(root)) FROM r WHERE f.path = root OR starts_with(f.path, root || '/')) AS root FROM f""")
def longest_prefix(t: Tables) -> DataFrame:
    files = t.read("pages").select("page_id", F.regexp_extract("url", "^https?://([^?#]*)", 1).alias("path"))
    part = lambda n: F.concat_ws("/", F.slice(F.split("path", "/"), 1, n))
    roots = files.select(F.when(F.col("page_id") % 3 == 0, part(2)).otherwise(F.concat(F.lit("none/"), "path")).alias("root")).distinct()
    found = joins.longest_prefix(files, roots.withColumn("owner", F.col("root")), "path", "root", "owner")
    return found.select("page_id", F.col("owner").alias("root"))


@query("""WITH s AS (SELECT event_id AS id, user_id AS k, epoch_ms(ts) // 1000 AS s, epoch_ms(ts) // 1000 + 600 AS e FROM events WHERE event_type = 'click'), f AS (SELECT event_id AS fid, user_id AS k, epoch_ms(ts) // 1000 AS s, epoch_ms(ts) // 1000 + 3600 AS e FROM events WHERE event_type = 'error')
SELECT id, fid FROM s JOIN f ON s.k = f.k AND s.s <= f.e AND f.s <= s.e""")
def interval_overlap(t: Tables) -> DataFrame:
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    span = lambda kind, name, n: t.read("events").where(F.col("event_type") == kind).select(F.col("event_id").alias(name), F.col("user_id").alias("k"), at.alias("s"), (at + n).alias("e"))
    return joins.overlap(span("click", "id", 600), span("error", "fid", 3600), ["k"], "s", "e", 3600).select("id", "fid")


@query("""SELECT e.event_id, s.event_id AS last_signup FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def as_of_join(t: Tables) -> DataFrame:
    events = t.read("events").select("event_id", "user_id", "ts", "event_type")
    right = events.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("last_signup"))
    return joins.as_of(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "last_signup").select("event_id", "last_signup")


@query("SELECT user_id, event_type, n, votes FROM (SELECT user_id, arg_max(event_type, (n, event_type)) AS event_type, sum(n) AS n, max(n) AS votes FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1)")
def mode_per_group(t: Tables) -> DataFrame:
    return aggregates.mode(t.read("events"), ["user_id"], "event_type").select("user_id", "event_type", F.col("total").alias("n"), "votes")


@query("SELECT event_id, round(value / sum(value) OVER (PARTITION BY user_id), 9) AS share FROM events")
def share_of_total(t: Tables) -> DataFrame:
    return aggregates.share_of(t.read("events").select("event_id", "user_id", "value"), ["user_id"], "value", "share").select("event_id", F.round("share", 9).alias("share"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) // 1000 RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM events")
def trailing_counts(t: Tables) -> DataFrame:
    return aggregates.trailing_counts(t.read("events"), ["user_id"], "ts", 86400).select("event_id", "n")


@query("WITH c AS (SELECT l_partkey AS key, count(*) AS n FROM lineitem GROUP BY 1) SELECT key, n FROM c ORDER BY n DESC, key LIMIT (SELECT CASE WHEN count(*) > 1100 THEN count(*) - 100 ELSE count(*) END FROM c)")
def heavy_hitters(t: Tables) -> DataFrame:
    return aggregates.heavy_hitters(t.read("lineitem").select(F.col("l_partkey").alias("key")), "key", 1000)


@query("SELECT c_custkey, c_acctbal, r - 1 AS rank, round(1 - (r - 1) / greatest(1, n // 20), 9) AS confidence FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r, count(*) OVER () AS n FROM customer) WHERE r <= greatest(1, n // 20)")
def top_five_percent(t: Tables) -> DataFrame:
    found = aggregates.top_share(t.read("customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")])
    return rounded(found, "confidence", digits=9)


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r > 8")
def over_cap(t: Tables) -> DataFrame:
    return lookup.over_cap(t.read("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 8).select("o_orderkey")


@query("SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation")
def union_distinct(t: Tables) -> DataFrame:
    one = lambda name, c: t.read(name).select(F.col(c).alias("key"))
    return one("customer", "c_nationkey").union(one("supplier", "s_nationkey")).union(one("nation", "n_nationkey")).distinct()


@query("SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'")
def set_difference(t: Tables) -> DataFrame:
    return upsert.delete_keys(t.read("customer").select(F.col("c_custkey").alias("key")), t.read("orders").where("o_orderdate >= '2001-01-01'").select(F.col("o_custkey").alias("key")), ["key"])


@query("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_intersection(t: Tables) -> DataFrame:
    return t.read("customer").select("c_custkey").intersect(t.read("orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("SELECT doc_id FROM documents d WHERE md5(text) IS DISTINCT FROM (SELECT CASE WHEN o.doc_id % 10 = 0 THEN md5('x') ELSE md5(o.text) END FROM documents o WHERE o.doc_id = d.doc_id AND CASE WHEN o.doc_id % 3 = 0 THEN -1 - o.doc_id ELSE o.doc_id END = d.doc_id)")
def changed_by_hash(t: Tables) -> DataFrame:
    docs = t.read("documents")
    new = docs.select("doc_id", F.md5("text").alias("h"))
    old = docs.select(F.when(F.col("doc_id") % 3 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 10 == 0, F.md5(F.lit("x"))).otherwise(F.md5("text")).alias("h"))
    return joins.changed_rows(old, new, "doc_id", "h").select("doc_id")


# upserts ------------------------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT user_id AS k, min(event_id) AS v FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), n AS (SELECT user_id AS k, event_id AS v FROM events WHERE ts >= TIMESTAMP '2024-01-10')
SELECT k, v FROM o UNION ALL SELECT k, min(v) FROM n WHERE k NOT IN (SELECT k FROM o) GROUP BY 1""")
def upsert_first_wins(t: Tables) -> DataFrame:
    rows = t.read("events").select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), "ts")
    old = rows.where("ts < '2024-01-10'").groupBy("k").agg(F.min("v").alias("v"))
    return upsert.first_wins(old, rows.where("ts >= '2024-01-10'").drop("ts"), ["k"], [F.asc("v")])


@query("""WITH o AS (SELECT user_id AS k, min(event_id) AS v FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1), n AS (SELECT user_id AS k, max(event_id) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1)
SELECT k, v FROM n UNION ALL SELECT k, v FROM o WHERE k NOT IN (SELECT k FROM n)""")
def upsert_last_wins(t: Tables) -> DataFrame:
    rows = t.read("events").select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), "ts")
    old = rows.where("ts < '2024-01-20'").groupBy("k").agg(F.min("v").alias("v"))
    return upsert.last_wins(old, rows.where("ts >= '2024-01-29'").drop("ts"), ["k"], [F.col("v")])


@query("SELECT user_id AS k, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(event_type, (ts, event_id)) AS email, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1")
def upsert_widen(t: Tables) -> DataFrame:
    rows = t.read("events").select(F.col("user_id").alias("k"), "ts", "event_id", "event_type").withColumn("at", F.struct("ts", "event_id"))
    shape = lambda df: df.select("k", "at", F.col("event_type").alias("email"), F.col("event_type").alias("state"))
    early = shape(rows.where("ts < '2024-01-15'"))
    empty = early.limit(0).select("k", F.col("at").alias("first_seen"), F.col("at").alias("last_seen"), "email", "state")
    old = upsert.widen(empty, early, ["k"], "at", ["email"], ["state"])
    out = upsert.widen(old, shape(rows.where("ts >= '2024-01-15'")), ["k"], "at", ["email"], ["state"])
    return out.select("k", F.col("first_seen.ts").alias("first_seen"), F.col("last_seen.ts").alias("last_seen"), "email", "state")


@query("""WITH n AS (SELECT n_nationkey AS scope, 'new' AS v FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey, 'newer' FROM nation WHERE n_nationkey < 2)
SELECT c_nationkey AS scope, c_mktsegment AS v FROM customer WHERE c_nationkey >= 5 UNION ALL SELECT * FROM n""")
def replace_scope(t: Tables) -> DataFrame:
    nation = t.read("nation").select(F.col("n_nationkey").alias("scope"))
    new = nation.where("scope < 5").withColumn("v", F.lit("new")).unionByName(nation.where("scope < 2").withColumn("v", F.lit("newer")))
    return upsert.replace_scope(t.read("customer").select(F.col("c_nationkey").alias("scope"), F.col("c_mktsegment").alias("v")), new, ["scope"])


@query("SELECT user_id, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' OR user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-28')")
def evict_stale(t: Tables) -> DataFrame:
    rows = t.read("events").select("user_id", "event_id", "ts")
    kept = t.read("events").where("event_type = 'purchase' and ts >= '2024-01-28'").select("user_id")
    stale = rows.where("ts < '2024-01-15'").join(kept.distinct(), "user_id", "left_anti")
    return upsert.evict_stale(rows.withColumn("key", F.col("event_id")), rows.where("ts >= '2024-01-15'").withColumn("key", F.col("event_id")).unionByName(rows.join(stale.select("event_id"), "event_id", "left_anti").select("user_id", "event_id", "ts").withColumn("key", F.col("event_id"))), "key", "ts", F.lit("2024-01-15").cast("timestamp_ntz")).select("user_id", "event_id")


@query("SELECT p_partkey AS path, CASE WHEN p_size < 10 AND p_partkey % 2 = 0 THEN 0 ELSE p_size END AS ccn, CASE WHEN p_size < 10 AND p_partkey % 2 = 0 THEN 'stale' ELSE 'fresh' END AS status FROM part")
def mark_stale(t: Tables) -> DataFrame:
    rows = t.files().withColumns({"status": F.lit("fresh"), "seen": F.col("ccn")})
    kept = rows.select(F.when(F.col("path") % 2 == 1, F.col("path")).otherwise(-F.col("path")).alias("path"))
    return upsert.mark_stale(rows, kept, "path", "seen", F.lit(10), {"ccn": F.lit(0), "status": F.lit("stale")}).select("path", "ccn", "status")


@query("SELECT o_orderkey AS id, CASE WHEN CAST(o_orderkey AS VARCHAR) LIKE '1%' AND o_orderstatus <> 'F' THEN '2002-01-01' WHEN o_orderstatus = 'F' THEN '2000-01-01' END AS invalid_at FROM orders")
def invalidate_edges(t: Tables) -> DataFrame:
    edges = t.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("edge_id"), F.when(F.col("o_orderstatus") == "F", "2000-01-01").alias("invalid_at"))
    return upsert.invalidate(edges, "edge_id", ["1"], F.lit("2002-01-01")).select("id", "invalid_at")


# functions and search -------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, length(text) > 400 AS truncated, substr(text, 1, 400) AS text FROM conversations")
def token_budget(t: Tables) -> DataFrame:
    return search.budgeted(t.read("conversations").select("conv_id", "turn", "text"), "text", 100)


@query("SELECT doc_id, sha256(substr(text, 1, 500)) AS excerpt_hash FROM documents WHERE contains(text, 'the')")
def keyword_search(t: Tables) -> DataFrame:
    found = search.keyword_search(t.read("documents"), "text", "the")
    return found.select("doc_id", F.sha2("excerpt", 256).alias("excerpt_hash"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT doc_id AS path, line, content FROM l WHERE regexp_matches(content, 'License|token = ')""")
def code_search(t: Tables) -> DataFrame:
    files = t.read("documents").select(F.col("doc_id").alias("path"), "text")
    return search.code_lines(files, "License|token = ")


@query("SELECT p_partkey, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS signature, sha256(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS signature_hash FROM part")
def signatures(t: Tables) -> DataFrame:
    return t.read("part").select("p_partkey", ids.normal_signature(F.col("p_name")).alias("signature"), ids.signature_hash(F.col("p_name")).alias("signature_hash"))


@query("SELECT l_orderkey, l_linenumber, l_partkey AS symbol_id, 'dir:' || CAST(l_suppkey AS VARCHAR) AS path, l_linenumber AS line, CAST(l_quantity AS INTEGER) AS col FROM lineitem")
def doc_keys(t: Tables) -> DataFrame:
    key = ids.doc_key(F.col("l_partkey"), F.concat(F.lit("dir:"), F.col("l_suppkey").cast("string")), F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.lit("run"))
    return t.read("lineitem").select("l_orderkey", "l_linenumber", ids.parse_doc_key(key).alias("k")).select("l_orderkey", "l_linenumber", "k.symbol_id", "k.path", "k.line", "k.col")


@query("SELECT event_id, ((event_id % 3) * 24 + event_id % 24) * 3600 + (event_id % 60) * 60 + (event_id * 7) % 60 AS seconds FROM events")
def elapsed_times(t: Tables) -> DataFrame:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    k = F.col("event_id")
    text = F.concat((k % 3).cast("string"), F.lit("-"), two(k % 24), F.lit(":"), two(k % 60), F.lit(":"), two(k * 7 % 60))
    return t.read("events").select("event_id", clock.elapsed_seconds(text).alias("seconds"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '/en/') THEN 'test' WHEN regexp_matches(url, '/de/') THEN 'example' WHEN regexp_matches(url, '/fr/') THEN 'library' ELSE 'other' END AS context FROM pages")
def source_contexts(t: Tables) -> DataFrame:
    path = F.replace(F.replace(F.replace("url", F.lit("/en/"), F.lit("/tests/")), F.lit("/de/"), F.lit("/Demo/")), F.lit("/fr/"), F.lit("/src/"))
    return t.read("pages").select("page_id", paths.source_context(path).alias("context"))


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def previous_speaker(t: Tables) -> DataFrame:
    return t.read("conversations").select("conv_id", "turn", "role", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_property_counts(t: Tables) -> DataFrame:
    return t.read("events").select(F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


# issue feed -----------------------------------------------------------------------------------------------------------

ISSUES = """issues AS (SELECT user_id AS issue_id, last.id % 40 AS assignee, CASE WHEN last.id % 4 = 0 THEN last.id END AS run_id,
 CASE last.kind WHEN 'view' THEN 'todo' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'in_review' WHEN 'error' THEN 'blocked' ELSE 'done' END AS status,
 CASE WHEN user_id % 3 = 0 THEN user_id + 1 END AS parent_id, seen AS updated_at, epoch(now) - epoch(seen) AS age
 FROM (SELECT user_id, max(ts) AS seen, arg_max({'id': event_id, 'kind': event_type}, (ts, event_id)) AS last FROM events GROUP BY 1), (SELECT max(ts) AS now FROM events))"""


@query(f"""WITH {ISSUES} SELECT issue_id, 'wrong_assignee' AS finding, CAST(floor(age) AS BIGINT) AS age_seconds FROM issues
WHERE status IN ('todo', 'in_progress', 'in_review') AND assignee >= 30 AND age BETWEEN 180 AND 14400 * 60""")
def wrong_assignee(t: Tables) -> DataFrame:
    agents = t.spark.range(30).select(F.col("id").alias("agent_id"))
    return detectors.wrong_assignee(t.issues(), agents, t.feed_time(), window_minutes=14_400).select("issue_id", "finding", "age_seconds")


@query(f"""WITH {ISSUES}, said AS (SELECT user_id AS issue_id, event_id, ts, CASE WHEN value >= 95 THEN 'cloudflare_1010' WHEN value >= 90 THEN 'rate_limit_429' WHEN value >= 85 THEN 'service_unavailable' WHEN value >= 80 THEN 'cloudflare_generic' END AS kind
 FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY)
SELECT issue_id, arg_min(kind, (ts, event_id)) AS error_kind FROM said JOIN issues USING (issue_id)
WHERE kind IS NOT NULL AND status IN ('todo', 'in_progress', 'in_review', 'blocked') AND floor(age) <= 14400 * 60 GROUP BY 1""")
def infra_block(t: Tables) -> DataFrame:
    body = F.when(F.col("value") >= 95, "error 1010").when(F.col("value") >= 90, "HTTP 429").when(F.col("value") >= 85, "HTTP 503 here").when(F.col("value") >= 80, "Cloudflare page").otherwise("fine")
    comments = t.read("events").select(F.col("event_id").alias("comment_id"), F.col("user_id").alias("issue_id"), F.lit(0).alias("author"), body.alias("body"), F.col("ts").cast("timestamp").alias("created_at"))
    found = detectors.infra_block(t.issues(), comments, t.feed_time(), 3 * 24 * 60, 14_400)
    return found.select("issue_id", F.col("snapshot")["error_kind"].alias("error_kind"))


@query(f"""WITH {ISSUES} SELECT issue_id, assignee FROM issues i WHERE status <> 'blocked' AND run_id IS NULL AND floor(age) BETWEEN 60 * 60 AND 20000 * 60
AND issue_id NOT IN (SELECT parent_id FROM issues WHERE parent_id IS NOT NULL AND status IN ('todo', 'in_progress', 'in_review'))""")
def died_mid_work(t: Tables) -> DataFrame:
    return detectors.died_mid_work(t.issues(), t.feed_time(), 60, 20_000).select("issue_id", "assignee")


@query("""WITH log AS (SELECT user_id % 7 AS tick, CASE WHEN event_type IN ('view', 'click') THEN 'alert' ELSE 'repair' END AS action FROM events)
SELECT tick, count(*) FILTER (action = 'alert') AS alerts, count(*) FILTER (action = 'alert') > 5 AS over_soft, greatest(count(*) FILTER (action = 'alert') - 20, 0) AS deferred FROM log GROUP BY 1""")
def alert_budget(t: Tables) -> DataFrame:
    log = t.read("events").select((F.col("user_id") % 7).alias("tick"), F.when(F.col("event_type").isin("view", "click"), "alert").otherwise("repair").alias("action"))
    return alerts.budget_use(log)


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT start, event_type, n FROM h WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 180 MINUTE""")
def streamed_hourly_counts(t: Tables) -> DataFrame:
    stream = windows.tumbling_counts(windows.table_stream(t.spark, t.folder, "events"), "ts", ["event_type"])
    return windows.run_to_table(stream, shared_folder(t.spark, "hourly")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT DISTINCT CASE WHEN r_name IS NULL THEN n_name ELSE r_name || '.' || n_name END AS match, n_name AS name, 'ok' AS status FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def suffix_lookup(t: Tables) -> DataFrame:
    nation, region = t.read("nation"), t.read("region")
    known = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.concat_ws(".", "r_name", "n_name").alias("name"))
    return joins.suffix_lookup(nation.select(F.col("n_name").alias("name")), known, "name").distinct()


@query("""WITH f AS (SELECT user_id AS path, event_id AS line, event_type AS kind, CASE WHEN value >= 80 THEN 0 WHEN value >= 30 THEN 1 ELSE 2 END AS rank FROM events)
SELECT path, kind, arg_min(line, (rank, line)) AS line, min(rank) AS rank FROM f GROUP BY 1, 2""")
def worst_findings(t: Tables) -> DataFrame:
    rank = F.when(F.col("value") >= 80, 0).when(F.col("value") >= 30, 1).otherwise(2)
    rows = t.read("events").select(F.col("user_id").alias("path"), F.col("event_type").alias("kind"), F.col("event_id").alias("line"), rank.alias("rank"))
    return aggregates.keep_worst(rows, ["path", "kind"], F.col("rank"))


@query("SELECT count(*) AS total, count(DISTINCT k) AS distinct_ids, count(*) FILTER (k < 0) AS negative, count(*) - count(DISTINCT k) AS collisions, count(*) FILTER (k < 0) / count(*) AS share_negative FROM (SELECT CASE WHEN l_linenumber % 2 = 0 THEN -l_orderkey ELSE l_orderkey END AS k FROM lineitem)")
def hash_statistics(t: Tables) -> DataFrame:
    signed = F.when(F.col("l_linenumber") % 2 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    return aggregates.hash_statistics(t.read("lineitem").select(signed.alias("k")), "k")


@query("""SELECT 'run-' || user_id AS run_id, min(ts) FILTER (event_type = 'view') AS started_at, max(ts) FILTER (event_type = 'purchase') AS finished_at, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'purchase') AS nodes FROM events GROUP BY 1""")
def run_ledger(t: Tables) -> DataFrame:
    event = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "end").otherwise("other")
    log = t.read("events").select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"), event.alias("event"), F.col("ts").alias("at"), F.lit("p").alias("project"), F.lit("x").alias("extractor"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error_code"), F.col("event_id").alias("nodes"), F.lit(0).alias("edges"))
    return ledger.runs(log).select("run_id", "started_at", "finished_at", "nodes")


@query("""WITH m AS (SELECT DISTINCT user_id % 5 AS bundle, user_id AS member FROM events), r AS (SELECT user_id % 5 AS bundle, user_id AS member, bool_or(CASE WHEN user_id % 5 <> 0 OR user_id % 2 = 0 THEN event_type = 'purchase' END) AS ok FROM events GROUP BY 1, 2)
SELECT bundle, count(*) AS members, count(ok) AS done, count(*) FILTER (NOT ok) AS failed, CASE WHEN count(ok) < count(*) THEN 'running' WHEN count(*) FILTER (NOT ok) > 0 THEN 'failed' ELSE 'succeeded' END AS state FROM m LEFT JOIN r USING (bundle, member) GROUP BY 1""")
def ingest_progress(t: Tables) -> DataFrame:
    rows = t.read("events").select((F.col("user_id") % 5).alias("bundle"), F.col("user_id").alias("member"), (F.col("event_type") == "purchase").alias("ok"))
    told = rows.withColumn("ok", F.when((F.col("bundle") != 0) | (F.col("member") % 2 == 0), F.col("ok")))  # of some nothing is known yet
    return windows.ingest_progress(rows.select("bundle", "member"), told)


from quarrylight import queries_rows, queries_sources, queries_state, queries_tools  # noqa: E402, F401 - they register their own

__all__ = ["ORACLE", "QUERIES"]
