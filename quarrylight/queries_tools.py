"""Queries of conventions, reports, runs and operations, each over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.api import Engine
from quarrylight.functions import paths
from quarrylight.operators import graph, joins, ledger, lookup
from quarrylight.plans import architecture, runs
from quarrylight.proxies import Tables
from quarrylight.queries_rows import FACT_LINES
from quarrylight.queries_sources import joined, naive, text
from quarrylight.registry import query
from quarrylight.session import shared_folder
from quarrylight.sources import facts, reports, trees
from quarrylight.streaming import detectors


def col(name: str) -> Column:
    return F.col(name)


# conventions ----------------------------------------------------------------------------------------------------------

SIGNALS = """(0, 1, 'naming.type_class', 'upper_camel'), (0, 1, 'structural.adt_pattern', 'class_hierarchy'), (0, 2, 'naming.module_protocol', 'other'), (0, 3, 'idiom.computed_vs_property', 'lazy'), (0, 6, 'naming.type_class', 'upper_camel'), (0, 7, 'idiom.collection_init', 'constructor'),
(1, 1, 'naming.type_class', 'upper_camel'), (1, 2, 'naming.module_protocol', 'other'), (1, 2, 'structural.adt_pattern', 'sealed'), (1, 3, 'idiom.computed_vs_property', 'lazy'), (1, 6, 'naming.type_class', 'upper_camel'), (1, 7, 'idiom.collection_init', 'literal')"""


@query(f"""WITH f(k, n, rule, choice) AS (VALUES {SIGNALS}), v AS (SELECT l_orderkey // 200 AS module, rule, choice, count(*) AS n FROM lineitem JOIN f ON l_orderkey % 2 = k AND l_linenumber = f.n GROUP BY 1, 2, 3),
b AS (SELECT module, rule, arg_max(choice, (n, choice)) AS choice, max(n) AS votes, CAST(sum(n) AS BIGINT) AS total FROM v GROUP BY 1, 2)
SELECT module, rule, choice, votes, total, total - votes AS outliers, CASE WHEN total = votes THEN 'informational' WHEN (total - votes) / total >= 0.1 THEN 'high' ELSE 'medium' END AS severity FROM b WHERE total >= 5""")
def code_conventions(t: Tables) -> DataFrame:
    """What the lines of orders say as source code: the usual choice of each module and how many differ."""
    line = F.lit(None).cast("string")
    for k, language in enumerate(FACT_LINES):
        for n, code in enumerate(FACT_LINES[language], 1):
            line = F.when((col("l_orderkey") % 2 == k) & (col("l_linenumber") == n), F.replace(F.lit(code), F.lit("%"), col("l_partkey").cast("string"))).otherwise(line)
    files = t.read("lineitem").groupBy(col("l_orderkey").cast("string").alias("path")).agg(F.concat_ws("\n", F.collect_list(line)).alias("text"))
    files = files.withColumn("language", F.when(col("path").cast("long") % 2 == 0, "swift").otherwise("kotlin"))
    told = facts.signals(facts.line_facts(files)).withColumn("module", F.floor(col("path").cast("long") / 200))
    return architecture.convention_outliers(told.select("module", "rule", "choice"))


@query("""SELECT 'nation' AS kind, n_name AS name, CASE WHEN n_name LIKE '%\\_%' ESCAPE '\\' THEN 'upper_snake' ELSE 'upper_camel' END AS type_choice, 'other' AS test_choice, 'other' AS protocol_choice FROM nation
UNION ALL SELECT 'part', p_brand, CASE WHEN p_brand = upper(p_brand) AND contains(p_brand, '_') THEN 'upper_snake' WHEN regexp_full_match(p_brand, '[A-Z][^_]*') THEN 'upper_camel' ELSE 'other' END, 'other', 'other' FROM part
UNION ALL SELECT 'segment', x, 'upper_camel', CASE WHEN k < 3 THEN ['suffix_tests', 'prefix_test', 'suffix_spec'][k + 1] ELSE 'other' END, CASE WHEN k >= 3 THEN ['suffix_protocol', 'suffix_able', 'suffix_ing'][k - 2] ELSE 'other' END
FROM (SELECT CASE c_custkey % 6 WHEN 0 THEN 'C' || c_custkey || 'Tests' WHEN 1 THEN 'Test' || c_custkey WHEN 2 THEN 'C' || c_custkey || 'Spec' WHEN 3 THEN 'C' || c_custkey || 'Protocol' WHEN 4 THEN 'C' || c_custkey || 'able' ELSE 'C' || c_custkey || 'ing' END AS x, c_custkey % 6 AS k FROM customer)""")
def name_choices(t: Tables) -> DataFrame:
    """How names of nations, brands and customers look as names of types, tests and protocols."""
    k, c = col("c_custkey") % 6, col("c_custkey")
    made = F.when(k == 0, text("C", c, "Tests")).when(k == 1, text("Test", c)).when(k == 2, text("C", c, "Spec")).when(k == 3, text("C", c, "Protocol")).when(k == 4, text("C", c, "able")).otherwise(text("C", c, "ing"))
    names = t.read("nation").select(F.lit("nation").alias("kind"), col("n_name").alias("name"))
    names = names.unionByName(t.read("part").select(F.lit("part").alias("kind"), col("p_brand").alias("name"))).unionByName(t.read("customer").select(F.lit("segment").alias("kind"), made.alias("name")))
    name = col("name")
    return names.select("kind", "name", paths.type_name_choice(name).alias("type_choice"), paths.test_name_choice(name).alias("test_choice"), paths.protocol_name_choice(name).alias("protocol_choice"))


# scanner reports ------------------------------------------------------------------------------------------------------

RESULT = """WITH r AS (SELECT 'f' || user_id AS path, CAST(event_id % 20 + 1 AS INTEGER) AS start_line, event_type AS kind, 'rules.' || event_type || CASE WHEN event_id % 2 = 0 THEN '.a' ELSE '.b' END AS rule_id, CASE WHEN value >= 90 THEN 'high' WHEN value >= 50 THEN 'medium' WHEN value >= 10 THEN 'low' ELSE 'informational' END AS severity, 'm' || CAST(floor(value) AS INTEGER) AS message FROM events)"""


def _report(t: Tables) -> DataFrame:
    v, n = col("value"), (col("event_id") % 20 + 1).cast("int")
    said = F.when(v >= 90, "ERROR").when(v >= 50, "warning").when(v >= 10, "INFO").otherwise("NOTE")
    rule = text("rules.", col("event_type"), F.when(col("event_id") % 2 == 0, ".a").otherwise(".b"))
    item = text('{"check_id": "', rule, '", "path": "f', col("user_id"), '", "start": {"line": ', n, '}, "extra": {"message": "m', F.floor("value").cast("int"), '", "severity": "', said, '", "lines": "  ', F.repeat(F.lit("x"), n * 10), '  ", "metadata": {"kind": "', col("event_type"), '"}}}')
    return joined(t.read("events"), ["user_id"], item, '{"results": [', "]}", ", ").select("text")


@query(RESULT + " SELECT path, start_line, start_line AS end_line, kind, severity, message, rule_id, 'other' AS context, CAST(least(start_line * 10, 100) AS INTEGER) AS matched FROM r")
def scanned_results(t: Tables) -> DataFrame:
    """Every result of a scanner's reports, one report a user."""
    return reports.scanned(_report(t)).select("path", "start_line", "end_line", "kind", "severity", "message", "rule_id", "context", F.length("literal").alias("matched"))


@query(RESULT + """, k AS (SELECT *, row_number() OVER (PARTITION BY path, start_line, kind ORDER BY list_position(['high', 'medium', 'low', 'informational'], severity), rule_id, message) AS n FROM r)
SELECT path, start_line, start_line AS end_line, kind, severity, rule_id, message FROM k WHERE n = 1""")
def worst_results(t: Tables) -> DataFrame:
    """Of each place and kind the worst result."""
    return reports.worst_scanned(_report(t)).select("path", "start_line", "end_line", "kind", "severity", "rule_id", "message")


# keys that may be hot -------------------------------------------------------------------------------------------------


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place FROM events")
def places_in_type(t: Tables) -> DataFrame:
    """The place of each event within its type: a few keys with very many rows each."""
    return joins.placed(t.read("events").select("event_id", "event_type", "ts"), ["event_type"], [col("ts"), col("event_id")], "place").select("event_id", "place")


@query("""WITH n AS (SELECT DISTINCT l_orderkey, l_orderkey * 10 + l_linenumber AS node FROM lineitem) SELECT node, min(node) OVER (PARTITION BY l_orderkey) AS component FROM n QUALIFY count(*) OVER (PARTITION BY l_orderkey) > 1""")
def line_cycles(t: Tables) -> DataFrame:
    """The lines of an order in a ring, each with a way out to a part: as many cycles as orders, beyond what a driver should hold."""
    lines = t.read("lineitem").select("l_orderkey", (col("l_orderkey") * 10 + col("l_linenumber")).alias("node"), "l_partkey")
    of_order = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("node")).alias("nodes")).where(F.size("nodes") > 1)
    pairs = F.transform("nodes", lambda x, i: F.struct(x.alias("src"), F.coalesce(F.get("nodes", i + 1), F.get("nodes", F.lit(0))).alias("dst")))
    ring = of_order.select(F.explode(pairs).alias("e")).select("e.*")
    out = lines.select(col("node").alias("src"), (-col("l_partkey")).alias("dst"))
    return graph.strong_components(ring.unionByName(out))


# operations -----------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, user_id, event_type, ts FROM events) SELECT CAST(user_id AS VARCHAR) AS issue_id, CAST(NULL AS VARCHAR) AS error, ts AS updated_at, event_type AS status FROM e WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0
UNION ALL SELECT CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) END, CASE WHEN event_id % 5 = 0 THEN 'malformed' WHEN event_id % 7 = 0 THEN 'no_status' ELSE 'no_time' END, NULL, NULL FROM e WHERE event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0""")
def isolated_issues(t: Tables) -> DataFrame:
    """A feed of issues, some of which can't be read: these become errors, the others go on."""
    k, at = col("event_id"), F.date_format(col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    whole = F.to_json(F.struct(col("user_id").cast("string").alias("id"), F.when(k % 7 != 0, col("event_type")).alias("status"), F.when(k % 11 != 0, at).otherwise("soon").alias("updatedAt")))
    feed = t.read("events").select(F.when(k % 5 == 0, F.lit("{broken")).otherwise(whole).alias("text"))
    issues, errors = detectors.readable_issues(feed)
    found = issues.select("issue_id", F.lit(None).cast("string").alias("error"), "updated_at", "status")
    return naive(found.unionByName(errors.select("issue_id", "error", F.lit(None).cast("timestamp").alias("updated_at"), F.lit(None).cast("string").alias("status"))), "updated_at")


@query("""WITH n AS (SELECT max(ts) AS now FROM events), i AS (SELECT event_id AS issue_id, epoch(now) - epoch(ts) AS held FROM events, n WHERE event_type = 'error'), p AS (SELECT event_id AS pid, event_id * 37 % 2500000 AS ran FROM events WHERE event_type = 'click' AND user_id % 2 = 0)
SELECT issue_id, pid FROM i JOIN p ON abs(ran - held) <= 60""")
def lock_holders(t: Tables) -> DataFrame:
    """Errors as locked issues, clicks as processes that run for some time: who may hold which lock."""
    ran = (col("event_id") * 37) % 2_500_000
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    etime = F.concat(F.floor(ran / 86_400).cast("string"), F.lit("-"), two(F.floor(ran / 3600) % 24), F.lit(":"), two(F.floor(ran / 60) % 60), F.lit(":"), two(ran % 60))
    events = t.read("events")
    issues = events.where("event_type = 'error'").select(col("event_id").alias("issue_id"), F.lit("r").alias("run_id"), col("ts").cast("timestamp").alias("locked_at"))
    command = F.when(col("user_id") % 2 == 0, "tool --print").otherwise("tool")
    processes = events.where("event_type = 'click'").select(col("event_id").alias("pid"), etime.alias("etime"), F.lit(1.0).alias("pcpu"), command.alias("command"))
    return detectors.lock_holders(issues, processes, ["tool", "--print"], t.feed_time()).select("issue_id", "pid")


@query("""SELECT 'files' AS phase, r_name AS project, CAST(n AS BIGINT) AS rows, true AS finished FROM (SELECT lower(replace(r_name, ' ', '-')) AS r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
UNION ALL SELECT 'broken', lower(replace(min(r_name), ' ', '-')), 0, false FROM region""")
def extractor_runs(t: Tables) -> DataFrame:
    """An extractor over a project a region, and one that fails over the first: what the ledger and the table hold."""
    named = t.read("region").select("r_regionkey", F.lower(F.replace("r_name", F.lit(" "), F.lit("-"))).alias("slug"))
    rows = t.read("customer").join(t.read("nation"), col("c_nationkey") == col("n_nationkey")).join(named, col("n_regionkey") == col("r_regionkey"))

    def files(spark, project):
        return {"files": rows.where(col("slug") == project).select("c_custkey")}

    def broken(spark, project):
        raise runs.ExtractorError("prerequisite_missing")

    runner = runs.Runner(t.spark, shared_folder(t.spark, "runs"), {"files": files, "broken": broken}, named)
    slugs = [r["slug"] for r in named.select("slug").orderBy("slug").collect()]  # projects, a handful
    for slug in slugs:
        runner.run("files", slug, state="head")
    for slug in slugs[:1]:
        runner.run("broken", slug, state="head")
    held = runner.table("files").read().groupBy("project").agg(F.count("*").alias("held"))
    told = runner.runs().join(held, "project", "left")
    return told.select(col("extractor").alias("phase"), "project", F.when(col("extractor") == "files", col("held")).otherwise(0).cast("long").alias("rows"), (col("success") & (col("nodes") == col("held"))).alias("finished"))


# lookups and overviews ------------------------------------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'blue', 'steel', 'item', 'large']) OR list_has_any(string_split(p_type, ' '), ['STEEL', 'ECONOMY'])")
def tagged_lookup(t: Tables) -> DataFrame:
    """Parts whose words, as tags, hold any of some."""
    tagged = t.read("part").withColumn("tags", F.split("p_name", " ")).withColumn("kinds", F.split("p_type", " "))
    known = {"tags": lookup.any_tag("tags"), "kinds": lookup.any_tag("kinds")}
    by_name, _ = lookup.apply_filters(tagged, known, {"tags": ["red", "blue", "steel", "item", "large"]})
    by_kind, _ = lookup.apply_filters(tagged, known, {"kinds": ["STEEL", "ECONOMY"]})
    return by_name.select("p_partkey").union(by_kind.select("p_partkey")).distinct()


@query("SELECT doc_id, CAST(length(text) AS FLOAT) AS chars, CAST(length(text) - length(replace(text, 'e', '')) AS FLOAT) AS es FROM documents")
def embedded_documents(t: Tables) -> DataFrame:
    """A vector of each whole text, made in batches."""
    found = ledger.embedded(t.read("documents").select("doc_id", "text"), "text", lambda texts: [[float(len(x)), float(x.count("e"))] for x in texts])
    return found.select("doc_id", F.get("embedding", F.lit(0)).alias("chars"), F.get("embedding", F.lit(1)).alias("es"))


@query("""WITH p AS (SELECT user_id AS project FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT 'events' AS label, count(*) AS n, max(ts) AS last_run_at FROM events JOIN p ON user_id = project
UNION ALL SELECT 'runs', count(*), max(ts) FROM events JOIN p ON user_id = project""")
def project_overview(t: Tables) -> DataFrame:
    """How many rows the busiest project has in each table, and its last run."""
    events = t.read("events").withColumn("project", col("user_id"))
    busiest = events.groupBy("project").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project").first()["project"]
    tools = Engine({"events": events, "runs": t.runs(), "projects": events.select(col("project").alias("slug")).distinct()})
    return naive(tools.project_overview(busiest), "last_run_at")


@query("SELECT 'user-' || user_id AS slug FROM events GROUP BY 1")
def project_list(t: Tables) -> DataFrame:
    rows = t.read("events").select(text("user-", col("user_id")).alias("slug")).distinct()
    return Engine({"projects": rows}).list_projects()


@query("""SELECT fqn, line FROM (SELECT p_brand || '.' || p_name AS fqn, p_partkey AS line FROM part) ORDER BY fqn, line LIMIT 500""")
def capped_answers(t: Tables) -> DataFrame:
    """The public API of a project, of which a question gets 500 rows at most, however many it asks for."""
    rows = t.read("part").select(F.lit("p").alias("project"), F.concat_ws(".", "p_brand", "p_name").alias("fqn"), col("p_partkey").alias("line"))
    return Engine({"public_api": rows}).find_public_api("p", 100_000).select("fqn", "line")


NAMES = ["Package.swift", "libs.versions.toml", "build.gradle.kts", "pyproject.toml", "module.api"]


@query("""WITH f AS (SELECT s_suppkey, CASE WHEN s_nationkey % 4 = 0 THEN 'node_modules/' ELSE '' END || 'n' || s_nationkey || '/s' || s_suppkey || '/' || ['Package.swift', 'libs.versions.toml', 'build.gradle.kts', 'pyproject.toml', 'module.api'][s_suppkey % 5 + 1] AS path, s_name AS text, s_nationkey FROM supplier)
SELECT path, text, split_part(path, '/', 3) AS name FROM f WHERE s_nationkey % 4 <> 0""")
def discovered_files(t: Tables) -> DataFrame:
    """Manifests and API dumps found by their names in a tree that suppliers make, outside folders of others' code."""
    from quarrylight.queries_state import _local, _written

    name = F.get(F.array(*map(F.lit, NAMES)), (col("s_suppkey") % 5).cast("int"))
    folder = F.concat(F.when(col("s_nationkey") % 4 == 0, "node_modules/").otherwise(""), text("n", col("s_nationkey"), "/s", col("s_suppkey")))
    root = _local(t, "tree")
    _written(t.read("supplier").select(F.concat_ws("/", folder, name).alias("name"), F.encode("s_name", "UTF-8").alias("content")), root).count()
    return trees.named_files(t.spark, root, *NAMES).withColumn("name", F.element_at(F.split("path", "/"), -1))
