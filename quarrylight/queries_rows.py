"""Queries of column functions, ledgers, detectors and search over the tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.api import Engine
from quarrylight.functions import checks, clock, ids, paths, scoring
from quarrylight.operators import aggregates, joins, ledger, lookup, upsert
from quarrylight.plans import audit, history, search, symbols
from quarrylight.proxies import Tables
from quarrylight.queries_sources import naive, text
from quarrylight.registry import query, rounded
from quarrylight.session import shared_folder
from quarrylight.sources import facts
from quarrylight.streaming import alerts, detectors, windows


def col(name: str) -> Column:
    return F.col(name)


# ids and names -------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS rows, count(DISTINCT p_name) AS names, count(DISTINCT p_name) AS ids, true AS within FROM part")
def symbol_ids(t: Tables) -> DataFrame:
    """Equal names have equal ids, different ones different ids, all of 64 bits."""
    rows = t.read("part").select("p_name", ids.symbol_id("p_name").alias("id"), ids.stable_id(col("p_name"), F.lit("x")).alias("s"))
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("p_name").alias("names"), F.count_distinct("id").alias("ids"), F.bool_and(F.length("s") == 32).alias("within"))


@query("""SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE WHEN substr(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substr(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
FROM (SELECT p_partkey, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(p_name || p_partkey)) AS h FROM part)""")
def name_uuids(t: Tables) -> DataFrame:
    return t.read("part").select("p_partkey", ids.name_uuid(text(col("p_name"), col("p_partkey"))).alias("id"))


@query("""SELECT p_partkey, 'pkg' || p_size || ' C' || p_partkey || '#run().' AS qualified, 'pkg' || p_size || '.c' || p_partkey || '.run(),pkg' || p_size || '.c' || p_partkey || '.run,c' || p_partkey || '.run,run' AS keys FROM part""")
def symbol_names(t: Tables) -> DataFrame:
    k, size = col("p_partkey"), col("p_size")
    symbol = text("scip-x pip pkg", size, " 1.0 C", k, "#run().")
    name = text("pkg", size, ".C", k, ".run()")
    return t.read("part").select("p_partkey", ids.qualified_name(symbol).alias("qualified"), F.array_join(ids.candidate_keys(name), ",").alias("keys"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 1 THEN 'def' WHEN 2 THEN 'decl' WHEN 3 THEN 'assign' ELSE 'use' END AS kind FROM lineitem")
def occurrence_kinds(t: Tables) -> DataFrame:
    n = col("l_linenumber") % 4
    roles = F.when(n == 1, 1 + 4).when(n == 2, 64 + 4).when(n == 3, 4 + 8).otherwise(8)
    return t.read("lineitem").select("l_orderkey", "l_linenumber", ids.occurrence_kind(roles).alias("kind"))


@query("""SELECT p_partkey, 'pkg:pypi/cold-lib-' || p_partkey || '@' || p_size AS pypi, 'pkg:maven/Cold_Lib.' || p_partkey AS maven, 'pkg:maven/a@b/c' AS root FROM part""")
def package_urls(t: Tables) -> DataFrame:
    name = text("Cold_Lib.", col("p_partkey"))
    root = ids.purl_root(text("pkg:maven/a@b/c@", col("p_size")))
    return t.read("part").select("p_partkey", ids.purl(F.lit("pypi"), name, col("p_size").cast("string")).alias("pypi"), ids.purl(F.lit("maven"), name, F.lit(None).cast("string")).alias("maven"), root.alias("root"))


@query("""SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'unknown' WHEN p_size // 10 <> p_partkey % 5 THEN 'major' WHEN p_size % 10 <> 3 THEN 'minor' ELSE 'patch' END AS level FROM part""")
def version_differences(t: Tables) -> DataFrame:
    a = F.when(col("p_size") % 10 == 0, "branch-x").otherwise(text("v", F.floor(col("p_size") / 10), ".", col("p_size") % 10, ".1"))
    return t.read("part").select("p_partkey", ids.version_difference(a, text(col("p_partkey") % 5, ".3")).alias("level"))


@query("SELECT c_custkey, 'repos-x' || c_custkey AS prefixed, 'x' || c_custkey AS slug FROM customer")
def project_slugs(t: Tables) -> DataFrame:
    raw = text(F.when(col("c_custkey") % 2 == 0, "repos-").otherwise(""), "x", col("c_custkey"))
    return t.read("customer").select("c_custkey", ids.prefixed_project(raw).alias("prefixed"), ids.project_slug(raw).alias("slug"))


# paths, checks and times -----------------------------------------------------------------------------------------------

URL_PATH = "regexp_extract(url, '^https?://([^?#]*)', 1)"


PLACE = f"rtrim({URL_PATH}, '/')"


def _place() -> Column:
    """Where a page lies: its host and path."""
    return F.rtrim(F.regexp_extract("url", "^https?://([^?#]*)", 1), F.lit("/"))


@query(f"""WITH p AS (SELECT page_id, string_split(replace(replace(replace({PLACE} || '/', '/en/', '/src/'), '/fr/', '/Sources/'), '/de/', '/Tests/'), '/') AS parts FROM pages),
q AS (SELECT page_id, parts, len(parts) AS n, coalesce(list_position(parts, 'Sources'), 0) AS a, coalesce(list_position(parts, 'Tests'), 0) AS b, coalesce(list_position(parts, 'src'), 0) AS c FROM p)
SELECT page_id, CASE WHEN a > 0 AND a < n THEN parts[a + 1] WHEN b > 0 AND b < n THEN parts[b + 1] WHEN c > 1 THEN parts[c - 1] ELSE parts[1] END AS by_anchor,
CASE WHEN a > 0 AND a < n THEN parts[a + 1] WHEN b > 0 AND b < n THEN parts[b + 1] WHEN n > 1 THEN parts[n - 1] ELSE 'root' END AS by_parent FROM q""")
def inferred_modules(t: Tables) -> DataFrame:
    """Pages as files, whose folders by language play those that sources and tests have."""
    path = F.concat(_place(), F.lit("/"))
    for language, folder in (("en", "src"), ("fr", "Sources"), ("de", "Tests")):
        path = F.replace(path, F.lit(f"/{language}/"), F.lit(f"/{folder}/"))
    return t.read("pages").select("page_id", paths.module_by_anchor(path).alias("by_anchor"), paths.module_by_parent(path).alias("by_parent"))


@query("SELECT doc_id, 1 + length(substr(text, 1, 700)) - length(replace(substr(text, 1, 700), chr(10), '')) AS line FROM documents")
def offsets_to_lines(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", paths.line_of(col("text"), F.lit(700)).alias("line"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'swift' WHEN 1 THEN 'kotlin' WHEN 2 THEN 'rust' ELSE 'unknown' END AS language, page_id % 4 = 0 AS root FROM pages""")
def path_languages(t: Tables) -> DataFrame:
    k = col("page_id") % 4
    path = F.when(k == 0, "x/AppDelegate.SWIFT").when(k == 1, "x/B.kts").when(k == 2, "c.unknown").otherwise("Makefile")
    tag = F.when(k == 2, "Rust").otherwise("")
    return t.read("pages").select("page_id", paths.language_of(path, tag).alias("language"), paths.is_composition_root(path).alias("root"))


@query("""SELECT page_id, substr(replace(replace('in ~/repo: ' || url || chr(10) || 'next', chr(10), ' '), '/home/me', '~'), 1, 200) AS message FROM pages""")
def redacted_messages(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", paths.redacted(text("in /home/me/repo: ", col("url"), "\r\nnext"), "/home/me").alias("message"))


NAMES = f"""SELECT {PLACE} AS name FROM pages UNION SELECT unnest(string_split({PLACE}, '/')) FROM pages UNION SELECT unnest(string_split({URL_PATH}, '.')) FROM pages UNION SELECT p_name FROM part UNION SELECT replace(p_name, ' ', '-') FROM part UNION SELECT c_name FROM customer UNION SELECT n_name FROM nation UNION SELECT url FROM pages UNION SELECT '../' || p_brand FROM part"""


@query(f"""SELECT name, regexp_full_match(name, '[a-z0-9][a-z0-9-]{{0,62}}') AS slug, regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_-]*([.][A-Za-z_][A-Za-z0-9_-]*)*') AS qualified, regexp_full_match(name, '[A-Za-z0-9][A-Za-z0-9._/@~^-]{{0,199}}') AS ref,
regexp_full_match(name, '[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*') AND NOT list_contains(string_split(name, '/'), '..') AS relative, regexp_full_match(name, '[a-z][a-z0-9-]{{0,15}}') AS mount FROM ({NAMES})""")
def checked_names(t: Tables) -> DataFrame:
    """Hosts, paths and their parts, names of parts, customers and nations: which forms each keeps."""
    pages, part = t.read("pages"), t.read("part")
    whole = F.regexp_extract("url", "^https?://([^?#]*)", 1)
    found = [pages.select(F.explode(F.concat(F.array(_place(), col("url")), F.split(_place(), "/"), F.split(whole, r"\."))).alias("name"))]
    found += [part.select(F.explode(F.array("p_name", F.replace("p_name", F.lit(" "), F.lit("-")), text("../", col("p_brand")))).alias("name")), t.read("customer").select(col("c_name").alias("name")), t.read("nation").select(col("n_name").alias("name"))]
    name = col("name")
    return reduce(DataFrame.unionByName, found).distinct().select(
        "name", checks.slug_ok(name).alias("slug"), checks.qualified_ok(name).alias("qualified"), checks.ref_ok(name).alias("ref"), checks.relative_ok(name).alias("relative"), checks.mount_ok(name).alias("mount")
    )


@query("SELECT event_id, (event_id % 24) * 3600 + (event_id % 60) * 60 + (event_id * 7) % 60 + CASE WHEN event_id % 10 >= 5 THEN 1 ELSE 0 END AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6, 6) AS since FROM events")
def cpu_times(t: Tables) -> DataFrame:
    two, k = lambda c: F.lpad(c.cast("string"), 2, "0"), col("event_id")
    said = F.concat(two(k % 24), F.lit(":"), two(k % 60), F.lit(":"), two(k * 7 % 60), F.lit("."), (k % 10).cast("string"), F.lit("3"))
    return t.read("events").select("event_id", clock.cpu_seconds(said).cast("long").alias("seconds"), clock.iso(col("ts").cast("timestamp")).alias("at"), F.round(clock.seconds_between(col("ts"), F.lit("2024-01-01").cast("timestamp")), 6).alias("since"))


@query("""SELECT event_id, CASE WHEN value >= 100 THEN 'informational' WHEN event_id % 3 <> 0 THEN 'high' WHEN event_id % 2 = 0 AND event_type <> 'click' THEN 'medium' ELSE 'low' END AS swallowed, CASE WHEN event_id % 2 = 0 THEN 'high' ELSE 'medium' END AS untestable,
CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS node, CASE WHEN event_id % 2 = 0 OR event_id % 3 = 1 THEN 'medium' ELSE 'high' END AS edge, CASE WHEN event_id % 2 = 0 THEN 'button' ELSE 'other' END AS control, CASE WHEN event_id % 3 = 0 THEN 'android' ELSE 'ios' END AS surface FROM events""")
def rule_severities(t: Tables) -> DataFrame:
    k = col("event_id")
    path = F.when(k % 2 == 0, "src/crypto/wallet.swift").otherwise("src/ui/view.swift")
    kind = F.when(k % 3 == 0, "try_optional_swallow").otherwise("empty_catch")
    context = F.when(col("event_type") == "click", "test").otherwise("library")
    found = scoring.critical_path_severity(F.when(col("value") >= 100, "informational").otherwise("high"), kind, path, context)
    node_kind, resolution = F.when(k % 3 == 0, "weak").otherwise("state"), F.when(k % 3 == 1, "partial").otherwise("full")
    return t.read("events").select(
        "event_id", found.alias("swallowed"), scoring.untestable_severity(path).alias("untestable"), scoring.node_confidence(node_kind, resolution, ["weak"], ["partial"]).alias("node"),
        scoring.edge_confidence(F.when(k % 2 == 0, "triggers_effect").otherwise("reads"), resolution, F.lit(None), ["partial"]).alias("edge"), scoring.control_kind(F.when(k % 2 == 0, "Button").otherwise("Slider")).alias("control"),
        scoring.surface_of(F.when(k % 3 == 0, "a11y.Compose.label").otherwise("a11y.swiftui")).alias("surface"),
    )


@query("SELECT p_partkey, round(0.35 * ln(1 + p_size) / ln(101) + 0.30 * CASE p_partkey % 4 WHEN 0 THEN 0.1 WHEN 1 THEN 0.05 WHEN 2 THEN 0.15 ELSE 1.0 END + 0.20 * 0.5 + 0.10 + 0.05 * CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.1 ELSE 0.5 END, 6) AS importance FROM part")
def tier_importance(t: Tables) -> DataFrame:
    k = col("p_partkey")
    path = F.when(k % 4 == 0, "node_modules/a.js").when(k % 4 == 1, "x/__pycache__/a.py").when(k % 4 == 2, "target/a").otherwise("src/a")
    language = F.when(k % 3 == 0, "python").when(k % 3 == 1, "unknown").otherwise("go")
    score = scoring.importance(col("p_size"), scoring.tier_weight(path), scoring.kind_weight(F.lit("assign")), F.lit(-3.0), scoring.language_weight(language, "python"))
    return rounded(t.read("part").select("p_partkey", score.alias("importance")), "importance")


FACT_LINES = {
    "swift": ["public final class T%: Base {", "  internal protocol P% {}", "    lazy var v% = f()", "let a = x%.resolve(B.self)", "import Swinject", "struct A%Mock {", "var l% = [Int]()"],
    "kotlin": ["data class U%(val a: String)", "sealed interface S%", "  val d% by lazy { f() }", "val a = D%.getInstance()", "import dagger.hilt.X", "object F%Fake", "val l% = mutableListOf(1)"],
}
FACTS = """(0, 1, 'type', 'T%'), (0, 1, 'subclass', 'T%'), (0, 2, 'protocol', 'P%'), (0, 3, 'lazy', 'v%'), (0, 4, 'service_locator', 'x%.resolve('), (0, 5, 'framework', 'swinject'), (0, 6, 'type', 'A%Mock'), (0, 6, 'double', 'A%Mock'), (0, 7, 'collection_constructor', '[Int]()'),
(1, 1, 'type', 'U%'), (1, 1, 'init_injection', 'U%'), (1, 2, 'protocol', 'S%'), (1, 2, 'sealed', 'S%'), (1, 3, 'lazy', 'd%'), (1, 4, 'service_locator', 'D%.getInstance()'), (1, 5, 'framework', 'hilt'), (1, 6, 'type', 'F%Fake'), (1, 6, 'double', 'F%Fake'), (1, 7, 'collection_factory', 'mutableListOf')"""


@query(f"""WITH f(k, n, fact, name) AS (VALUES {FACTS}) SELECT l_orderkey AS file, fact, replace(name, '%', CAST(l_partkey AS VARCHAR)) AS name FROM lineitem JOIN f ON l_orderkey % 2 = k AND l_linenumber = n""")
def code_facts(t: Tables) -> DataFrame:
    """A source file an order, with a line of code for each of its lines."""
    line = F.lit(None).cast("string")
    for k, language in enumerate(FACT_LINES):
        for n, code in enumerate(FACT_LINES[language], 1):
            line = F.when((col("l_orderkey") % 2 == k) & (col("l_linenumber") == n), F.replace(F.lit(code), F.lit("%"), col("l_partkey").cast("string"))).otherwise(line)
    files = t.read("lineitem").groupBy(col("l_orderkey").cast("string").alias("path")).agg(F.concat_ws("\n", F.collect_list(line)).alias("text"))
    files = files.withColumn("language", F.when(col("path").cast("long") % 2 == 0, "swift").otherwise("kotlin"))
    return facts.line_facts(files).select(col("path").cast("long").alias("file"), "fact", "name")


# joins and aggregates ------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN NULL ELSE (SELECT min(q.p_partkey) FROM part q WHERE q.p_name = part.p_name) END AS found FROM part""")
def first_known_key(t: Tables) -> DataFrame:
    part = t.read("part")
    rows = part.select("p_partkey", F.when(col("p_size") % 3 == 0, F.array("p_name", "p_brand")).when(col("p_size") % 3 == 1, F.array(F.lit("nothing"), col("p_name"))).otherwise(F.array(F.lit("nothing"))).alias("keys"))
    known = part.select(col("p_name").alias("key"), col("p_partkey").alias("found"))
    return joins.first_key_wins(rows, "keys", known, "key", "found", "p_partkey").select("p_partkey", "found")


OWNED = f"""p AS (SELECT page_id, url, {PLACE} AS path FROM pages), h AS (SELECT *, split_part(path, '/', 1) AS host FROM p),
r AS (SELECT DISTINCT host AS root, regexp_extract(host, '[^.]*$') AS module FROM h WHERE host NOT LIKE 'm.%' UNION SELECT DISTINCT host || '/fr', 'fr' FROM h WHERE starts_with(path, host || '/fr')),
o AS (SELECT page_id, any_value(url) AS url, any_value(host) AS host, count(DISTINCT module) AS n, min(module) AS module FROM h LEFT JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY page_id)"""


def _owned(t: Tables) -> DataFrame:
    """Hosts belong to their domain, but mobile ones to nobody, and French folders to another."""
    places = t.read("pages").select("page_id", "url", _place().alias("path")).withColumn("host", F.substring_index("path", "/", 1))
    domains = places.where(~col("host").startswith("m.")).select(col("host").alias("root"), F.substring_index("host", ".", -1).alias("module"))
    french = places.where(F.startswith("path", F.concat("host", F.lit("/fr")))).select(F.concat("host", F.lit("/fr/")).alias("root"), F.lit("fr").alias("module"))
    return joins.owner_by_prefix(places, domains.unionByName(french).distinct(), "path", "root", "module")


@query(f"WITH {OWNED} SELECT page_id, CASE WHEN n = 1 THEN module END AS module, CASE n WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM o")
def owners_by_prefix(t: Tables) -> DataFrame:
    return _owned(t).select("page_id", "module", "status")


@query(f"""WITH {OWNED}, b AS (SELECT *, CASE WHEN starts_with(url, 'https') THEN regexp_extract(host, '[^.]*$') END AS other FROM o),
c AS (SELECT *, n > 1 OR (n = 1 AND other IS NOT NULL AND other <> module) AS clash FROM b)
SELECT page_id, CASE WHEN clash THEN NULL WHEN n = 1 THEN module ELSE other END AS module, CASE WHEN clash THEN 'ambiguous' WHEN n = 1 OR other IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS status FROM c""")
def reconciled_owners(t: Tables) -> DataFrame:
    """A second resolution that names the domain of secure pages and nothing for the others."""
    first = _owned(t)
    named = col("url").startswith("https")
    second = first.select("page_id", F.when(named, F.substring_index("host", ".", -1)).alias("module"), F.when(named, "resolved").otherwise("unresolved").alias("status"))
    return joins.reconciled_owner(first.select("page_id", "module", "status"), second, "page_id", "module")


@query("""WITH s AS (SELECT DISTINCT event_type AS kind, user_id AS file, CAST(event_id % 5 AS INTEGER) AS line FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY file, line) AS k, count(*) OVER (PARTITION BY kind) AS n FROM s)
SELECT kind, n, string_agg(file || ':' || line, ',' ORDER BY file, line) AS sites FROM r WHERE k <= 20 GROUP BY 1, 2""")
def sites_per_kind(t: Tables) -> DataFrame:
    rows = t.read("events").select(col("event_type").alias("kind"), col("user_id").alias("file"), (col("event_id") % 5).cast("int").alias("line"))
    found = aggregates.sites_per_group(rows, ["kind"], ["file", "line"])
    return found.select("kind", "n", F.array_join(F.transform("sites", lambda s: F.concat_ws(":", s["file"].cast("string"), s["line"].cast("string"))), ",").alias("sites"))


@query("""WITH touched AS (SELECT DISTINCT l_orderkey AS sha, l_partkey AS path FROM lineitem), last AS (SELECT max(o_orderdate) AS t FROM orders)
SELECT path, o_custkey AS author, round(sum(exp(-(epoch(t) - epoch(o_orderdate)) / (90 * 86400.0))) + 1e-9, 6) AS recency_score, count(*) AS commit_count, max(o_orderdate) AS last_touched_at
FROM touched JOIN orders ON sha = o_orderkey JOIN customer ON o_custkey = c_custkey, last WHERE o_orderstatus <> 'P' AND c_mktsegment <> 'MACHINERY' GROUP BY 1, 2""")
def recency_churn(t: Tables) -> DataFrame:
    found = history.recency_churn(t.touched(), t.commits(), t.authors(), F.lit(t.last_commit()), 90.0)
    return naive(rounded(found.withColumn("recency_score", col("recency_score") + 1e-9), "recency_score"), "last_touched_at")


@query("SELECT p_partkey, p_retailprice, (SELECT count(*) FROM part) > 30 AS truncated FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30")
def truncated_page(t: Tables) -> DataFrame:
    return lookup.flagged(t.read("part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.asc("p_partkey")], 30)


@query("""SELECT 'hotspot' AS section, 'file_count' AS statistic, CAST(count(*) AS DOUBLE) AS value FROM part UNION ALL SELECT 'hotspot', 'max_score', max(p_size) FROM part
UNION ALL SELECT 'dead_symbols', x, count(*) FILTER (p_type = y) FROM part, (VALUES ('confirmed_dead', 'PROMO'), ('unused_candidate', 'SMALL'), ('skipped', 'LARGE')) v(x, y) GROUP BY x
UNION ALL SELECT 'dependencies', 'scopes', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'dependencies', 'missing_lockfile', 0 UNION ALL SELECT 'ownership', 'files_analysed', count(*) FROM part
UNION ALL SELECT 'ownership', 'diffuse_ownership_count', count(*) FILTER (p_size < 10) FROM part UNION ALL SELECT 'version_skew', x, count(*) FILTER (p_size % 3 = y) FROM part, (VALUES ('major', 0), ('minor', 1), ('patch', 2)) v(x, y) GROUP BY x
UNION ALL SELECT 'public_api', 'module_count', count(DISTINCT p_type) FROM part UNION ALL SELECT 'contracts', 'breaking', count(*) FILTER (p_size > 25) FROM part UNION ALL SELECT 'contracts', 'signature_changes', count(*) FILTER (p_size % 2 > 0) FROM part
UNION ALL SELECT 'testability', 'patterns', count(*) FILTER (p_size <= 40) FROM part UNION ALL SELECT 'testability', 'test_doubles', count(DISTINCT p_name) FROM part UNION ALL SELECT 'testability', 'untestable_sites', count(DISTINCT p_brand) FROM part""")
def section_figures(t: Tables) -> DataFrame:
    part, size = t.read("part"), col("p_size")
    state = F.when(col("p_type") == "PROMO", "confirmed_dead").when(col("p_type") == "SMALL", "unused_candidate").when(col("p_type") == "LARGE", "skipped").otherwise("other")
    level = F.when(size % 3 == 0, "major").when(size % 3 == 1, "minor").otherwise("patch")
    return audit.summaries(
        part.select(size.cast("double").alias("hotspot_score")), part.select(state.alias("state")), part.select(col("p_brand").alias("scope"), F.when(size == 1, "1.0").otherwise("unresolved").alias("version")).unionByName(t.spark.createDataFrame([(None, "2.0")], "scope string, version string")),
        part.select(F.when(size < 10, 0.1).when(size < 20, 0.9).alias("weight")), part.select(level.alias("severity")), part.select(col("p_type").alias("module")), part.select((size - 25).alias("removed"), (size % 2).alias("changed")),
        part.select(F.when(size <= 40, "init").alias("style"), col("p_name").alias("double"), col("p_brand").alias("site")),
    )


# upserts and ledgers -------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS function, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS n, max(o_totalprice) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS peak FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def enriched_functions(t: Tables) -> DataFrame:
    """Samples of a trace are replaced by newer ones; functions without any keep no figures."""
    samples = t.read("orders").select(col("o_custkey").alias("function"), F.when(col("o_orderdate") >= "1998-01-01", "new").otherwise("old").alias("trace"), col("o_totalprice").alias("v"))
    held = samples.withColumn("trace", F.lit("t")).where("false").unionByName(samples.where("trace = 'old'").withColumn("trace", F.lit("t")))
    now = upsert.replace_scope(held, samples.where("trace = 'new'").withColumn("trace", F.lit("t")), ["trace"])
    found = upsert.enriched(t.read("customer").select(col("c_custkey").alias("function")), now, "function", F.count("*").alias("n"), F.max("v").alias("peak"))
    return found.fillna(0, ["n"])


@query("""WITH f AS (SELECT o_custkey AS batch, o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'component' WHEN 1 THEN 'state' WHEN 2 THEN 'effect' WHEN 3 THEN 'diagnostic' ELSE 'edge' END AS kind, o_orderkey % 70 = 0 AS wrong, o_orderkey % 60 AS odd FROM orders)
SELECT batch FROM f GROUP BY 1 HAVING NOT bool_or(wrong OR (odd = 11 AND kind <> 'edge'))""")
def valid_batches(t: Tables) -> DataFrame:
    """Some facts name another file; some another language, which effects (as unknown) and edges may."""
    k = col("o_orderkey")
    kind = F.when(k % 5 == 0, "component").when(k % 5 == 1, "state").when(k % 5 == 2, "effect").when(k % 5 == 3, "diagnostic").otherwise("edge")
    rows = t.read("orders").select(col("o_custkey").alias("batch"), kind.alias("kind"), F.when(k % 70 == 0, "other").otherwise("f").alias("file_path"), F.when((k % 60 == 11) | (k % 60 == 14), "kotlin").when(k % 60 == 12, "unknown").otherwise("swift").alias("language"))
    rows = rows.where("not (language = 'unknown' and kind <> 'effect')")
    batches = rows.select("batch", F.lit("f").alias("file_path"), F.lit("swift").alias("language")).distinct()
    return upsert.valid_batches(batches, rows).select("batch")


@query("SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS left_over, (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders UNION ALL SELECT DISTINCT -1 - o_custkey FROM orders)) AS asked")
def delete_by_ids(t: Tables) -> DataFrame:
    """Ids that aren't there count as asked for."""
    asked = t.read("orders").select(F.explode(F.array("o_custkey", -1 - col("o_custkey"))).alias("key"))
    left, n = upsert.delete_counted(t.read("customer").select(col("c_custkey").alias("key")), asked, "key")
    return left.agg(F.count("*").alias("left_over"), F.lit(n).cast("long").alias("asked"))


@query("""SELECT user_id AS run_id, event_type AS phase, CASE WHEN user_id % 4 = 0 THEN count(*) + 1 ELSE count(*) END AS expected, count(*) AS actual, user_id % 4 <> 0 AS agrees FROM events GROUP BY user_id, event_type
UNION ALL SELECT DISTINCT -1 - user_id, 'view', 3, 0, false FROM events""")
def reconciled_phases(t: Tables) -> DataFrame:
    rows = t.read("events").select(col("user_id").alias("run_id"), col("event_type").alias("phase"))
    counted = rows.groupBy("run_id", "phase").agg(F.count("*").alias("n"))
    last = counted.select("run_id", "phase", F.when(col("run_id") % 4 == 0, col("n") + 1).otherwise(col("n")).alias("count"), F.lit(2).alias("at"))
    first = counted.select("run_id", "phase", F.lit(99).cast("long").alias("count"), F.lit(1).alias("at"))
    lost = rows.select((-1 - col("run_id")).alias("run_id")).distinct().select("run_id", F.lit("view").alias("phase"), F.lit(3).cast("long").alias("count"), F.lit(1).alias("at"))
    return ledger.reconcile(last.unionByName(first).unionByName(lost), rows)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'own' END AS extractor FROM events")
def extractor_names(t: Tables) -> DataFrame:
    k = col("event_id") % 3
    source = F.when(k == 2, "manual").otherwise(F.concat(F.lit("extractor."), col("event_type")))
    return t.read("events").select("event_id", ledger.extractor_of(source, F.when(k == 1, "own")).alias("extractor"))


@query("""SELECT 'p' || c_custkey AS slug, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS language_profile, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS note FROM customer WHERE c_custkey >= 5
UNION ALL SELECT 'p' || c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' END, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END FROM customer WHERE c_custkey < 5 UNION ALL SELECT DISTINCT 'q' || c_nationkey, 'old', 'kept' FROM customer""")
def merged_projects(t: Tables) -> DataFrame:
    """New rows for all customers, the first of them unknown before; some old projects get none."""
    rows = t.read("customer")
    slug = text("p", col("c_custkey"))
    old = rows.select(F.when(col("c_custkey") < 5, text("q", col("c_nationkey"))).otherwise(slug).alias("slug")).unionByName(rows.select(text("q", col("c_nationkey")).alias("slug"))).distinct()
    old = old.select("slug", F.lit("old").alias("language_profile"), F.lit("kept").alias("note"))
    new = rows.select(slug.alias("slug"), F.when(col("c_custkey") % 3 == 0, "new").alias("language_profile"), F.when(col("c_custkey") % 2 == 1, col("c_mktsegment")).alias("note"))
    return ledger.merge_projects(old, new, ["language_profile"])


@query("""SELECT 'b' || r_regionkey AS bundle, 'n' || n_nationkey AS slug, CASE WHEN n_nationkey % 5 = 0 THEN 'project_not_registered' WHEN n_nationkey % 5 = 1 THEN 'already_member' END AS error FROM nation JOIN region ON n_regionkey = r_regionkey""")
def bundle_additions(t: Tables) -> DataFrame:
    k = col("n_nationkey")
    new = t.read("nation").select(text("b", col("n_regionkey")).alias("bundle"), text("n", k).alias("slug"), (k % 5).alias("k"))
    projects = new.select(F.when(col("k") == 0, "other").otherwise(col("slug")).alias("slug"))
    members = new.select("bundle", F.when(col("k") == 1, col("slug")).otherwise(F.concat(F.lit("old-"), "slug")).alias("slug"))
    added, errors = ledger.add_members(members, new.select("bundle", "slug"), projects)
    fresh = added.join(members, ["bundle", "slug"], "left_anti").withColumn("error", F.lit(None).cast("string"))
    return fresh.unionByName(errors)


@query(f"""WITH p AS (SELECT string_split({PLACE}, '/') AS parts, url FROM pages), l AS (SELECT unnest(parts) AS slug FROM p UNION SELECT string_split(parts[1], '.')[1] FROM p)
SELECT slug, CASE WHEN slug IN (SELECT string_split(parts[1], '.')[1] FROM p WHERE starts_with(url, 'https')) THEN 'bundle' WHEN slug IN (SELECT string_split(parts[1], '.')[1] FROM p UNION SELECT parts[2] FROM p WHERE len(parts) > 1) THEN 'project' ELSE 'unknown' END AS kind FROM l""")
def slug_kinds(t: Tables) -> DataFrame:
    """Parts of addresses: first names of secure hosts are bundles, those of all hosts and their first folders projects."""
    parts, label = F.split(_place(), "/"), F.substring_index(_place(), ".", 1)
    pages = t.read("pages")
    asked = pages.select(F.explode(F.array_append(parts, label)).alias("slug")).distinct()
    bundles = pages.where(col("url").startswith("https")).select(label.alias("bundle"))
    projects = pages.select(F.explode(F.array_compact(F.array(label, F.get(parts, F.lit(1))))).alias("slug"))
    return ledger.slug_kind(asked, bundles, projects)


@query("SELECT 'project/' || n_name AS group_id, 'all' AS asked FROM nation UNION ALL SELECT 'project/NATION_3', 'one' UNION ALL SELECT 'home', 'none'")
def group_ids(t: Tables) -> DataFrame:
    projects = t.read("nation").select(col("n_name").alias("slug"))
    parts = [ledger.resolve_groups(a, projects, "home").withColumn("asked", F.lit(n)) for a, n in (("*", "all"), ("NATION_3", "one"), (None, "none"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'title' WHEN 2 THEN 'body' WHEN 3 THEN 'slice_ref' WHEN 4 THEN 'maker' WHEN 5 THEN 'confidence' END AS error FROM events")
def checked_decisions(t: Tables) -> DataFrame:
    k = col("event_id") % 6
    pick = lambda n, bad, good: F.when(k == n, F.lit(bad)).otherwise(F.lit(good))
    rows = t.read("events").select("event_id", pick(1, " ", "t").alias("title"), F.when(k == 2, F.repeat(F.lit("x"), 2001)).otherwise("b").alias("body"), pick(3, "no", "GIM-1").alias("slice_ref"), pick(4, "me", "cto").alias("maker"), pick(5, 1.5, 0.5).alias("confidence"))
    good, errors = ledger.valid_decisions(rows, ["cto"], r"^GIM-\d+$")
    return good.select("event_id", F.lit(None).cast("string").alias("error")).unionByName(errors.select("event_id", "error"))


@query("SELECT 'commit:' || o_orderkey AS doc_id, 'commit' AS kind, sha256(o_orderpriority) AS body FROM orders UNION ALL SELECT 'pr:' || c_custkey, 'pr', sha256('') FROM customer UNION ALL SELECT 'pr_comment:' || event_id, 'pr_comment', sha256(event_type) FROM events")
def search_records(t: Tables) -> DataFrame:
    commits = t.read("orders").select(col("o_orderkey").alias("sha"), col("o_orderpriority").alias("message"), col("o_orderdate").alias("committed_at"))
    pulls = t.read("customer").select(col("c_custkey").alias("number"), F.lit(None).cast("string").alias("body"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    comments = t.read("events").select(col("event_id").alias("comment_id"), col("event_type").alias("body"), col("ts").alias("created_at"))
    return ledger.document_records(commits, pulls, comments).select("doc_id", "kind", F.sha2("body", 256).alias("body"))


@query("SELECT o_orderkey AS sha FROM orders WHERE 'commit:' || o_orderkey = 'commit:77'")
def search_by_doc_id(t: Tables) -> DataFrame:
    records = t.read("orders").select(text("commit:", col("o_orderkey")).alias("doc_id"), col("o_orderkey").alias("sha"))
    return search.by_doc_id(records, "commit:77").select("sha")


@query("SELECT event_id FROM events WHERE value / 100 > 1 OR event_type = 'click' OR event_id % 7 = 0")
def envelope_errors(t: Tables) -> DataFrame:
    provenance = F.when(col("event_type") == "click", "guessed").otherwise("derived")
    rows = t.read("events").select("event_id", (col("value") / 100).alias("confidence"), provenance.alias("provenance"), F.when(col("event_id") % 7 != 0, col("ts")).alias("observed_at"))
    return ledger.envelope_errors(rows).select("event_id")


@query("""WITH p AS (SELECT user_id AS run_id, event_id AS place, CAST(floor(value) AS BIGINT) AS written, CASE WHEN user_id % 5 = 0 THEN 'budget_exceeded' END AS last_error FROM events),
c AS (SELECT *, coalesce(sum(written) OVER (PARTITION BY run_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT run_id, place, CAST(before AS BIGINT) AS written_before, CASE WHEN last_error IS NOT NULL THEN 'resume_blocked' WHEN before >= 500 THEN 'budget_exceeded' ELSE 'ok' END AS state FROM c""")
def phase_budgets(t: Tables) -> DataFrame:
    rows = t.read("events").select(col("user_id").alias("run_id"), col("event_id").alias("place"), F.floor("value").alias("written"), F.when(col("user_id") % 5 == 0, "budget_exceeded").alias("last_error"))
    return ledger.phase_states(rows, 500).drop("written", "last_error")


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS phase, count(*) AS n FROM events GROUP BY 1, 2")
def rows_of_a_phase(t: Tables) -> DataFrame:
    """How many rows each run wrote in each phase."""
    return ledger.counts_of(t.read("events").select(col("user_id").cast("string").alias("run_id"), col("event_type").alias("phase")))


@query("""SELECT 'a' || n_nationkey AS slug, CASE WHEN n_nationkey % 3 = 0 THEN 'superseded' WHEN n_nationkey % 3 = 1 AND n_nationkey > 0 THEN 'active' ELSE 'draft' END AS status, CASE WHEN n_nationkey % 3 = 0 THEN '**SUPERSEDED by a' || (n_nationkey + 1) || '**' || chr(10) || chr(10) || 'text' ELSE 'text' END AS body FROM nation
UNION ALL SELECT 'a' || (max(n_nationkey) + 1), 'active', '' FROM nation""")
def superseded_decisions(t: Tables) -> DataFrame:
    k = col("n_nationkey")
    records = t.read("nation").select(text("a", k).alias("slug"), col("n_name").alias("title"), F.lit("draft").alias("status"), F.lit("text").alias("body"))
    changes = t.read("nation").select(F.when(k % 3 == 0, text("a", k)).otherwise("gone").alias("old"), F.when(k % 3 == 0, text("a", k + 1)).otherwise("a0").alias("new"), F.lit("r").alias("reason"))
    changes = changes.where("old <> 'gone'")
    return ledger.superseded(records, changes).select("slug", "status", "body")


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '# T' || chr(10) || '## STACK' || chr(10) || 'new body' || chr(10) || '## PURPOSE' || chr(10) || 'why' ELSE '# T' || chr(10) || '## PURPOSE' || chr(10) || 'why' || chr(10) || '## STACK' || chr(10) || 'new body' END AS text, n_nationkey % 4 <> 0 AS changed FROM nation""")
def spliced_decisions(t: Tables) -> DataFrame:
    k = col("n_nationkey")
    old = F.when(k % 4 == 0, "# T\n## STACK\nnew body\n## PURPOSE\nwhy").when(k % 2 == 0, "# T\n## STACK\nold\nlines\n## PURPOSE\nwhy").otherwise("# T\n## PURPOSE\nwhy")
    return search.spliced(t.read("nation").select("n_nationkey", old.alias("text")), "text", "STACK", "new body").select("n_nationkey", "text", "changed")


@query("SELECT n_nationkey, s AS section, CASE s WHEN 'PURPOSE' THEN 'why ' || n_name ELSE 'with spark' END AS body FROM nation, (VALUES ('PURPOSE'), ('STACK')) v(s)")
def decision_sections(t: Tables) -> DataFrame:
    body = text("# Title\nintro\n## Purpose\nwhy ", col("n_name"), "\n## Other\nx\n##  STACK \nwith spark\n")
    return search.markdown_sections(t.read("nation").select("n_nationkey", body.alias("text")), "text").select("n_nationkey", "section", "body")


@query("SELECT DISTINCT l_orderkey || ':' || l_linenumber AS doc_key FROM lineitem WHERE l_partkey = 7 AND l_returnflag IN ('A', 'N')")
def term_postings(t: Tables) -> DataFrame:
    rows = t.read("lineitem").select(text(col("l_orderkey"), ":", col("l_linenumber")).alias("doc_key"), col("l_partkey").alias("symbol_id"), col("l_returnflag").alias("phase"))
    return search.term_documents(rows.unionByName(rows), 7, ["A", "N"]).select("doc_key")


@query("""SELECT 'rows' AS kind, 'orders' AS name, count(*) AS value FROM orders UNION ALL SELECT 'rows', 'part', count(*) FROM part UNION ALL SELECT 'last_run', event_type, CAST(arg_max(event_type <> 'error', (ts, event_id)) AS BIGINT) FROM events GROUP BY event_type
UNION ALL SELECT 'never_run', CAST(-1 - user_id AS VARCHAR), 0 FROM (SELECT DISTINCT user_id FROM events)""")
def health_report(t: Tables) -> DataFrame:
    runs = t.runs()
    projects = runs.select(F.explode(F.array("project", -1 - col("project"))).alias("slug")).distinct()
    return audit.health({"orders": t.read("orders"), "part": t.read("part")}, runs, projects).select("kind", "name", "value")


# references, ownership, architecture ------------------------------------------------------------------------------------


@query("SELECT 's' || k AS slug, CASE k % 3 WHEN 0 THEN 'not_registered' WHEN 1 THEN 'not_indexed' ELSE 'indexed' END AS status FROM (SELECT DISTINCT user_id AS k FROM events)")
def skew_targets(t: Tables) -> DataFrame:
    rows = t.read("events").select(text("s", col("user_id")).alias("slug"), (col("user_id") % 3).alias("k"))
    projects, deps = rows.select(F.when(col("k") > 0, col("slug")).otherwise("x").alias("slug")), rows.select(F.when(col("k") == 2, col("slug")).otherwise("y").alias("slug"))
    return symbols.target_status(rows, projects, deps)


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS project FROM lineitem), o AS (SELECT l_suppkey AS project, l_partkey AS path, sum(l_quantity) FILTER (l_suppkey % 3 <> 0 OR l_returnflag <> 'R') AS blob FROM lineitem GROUP BY 1, 2), n AS (SELECT l_suppkey AS project, l_partkey AS path, sum(l_quantity) AS blob FROM lineitem GROUP BY 1, 2),
d AS (SELECT project, count(*) FILTER (project % 5 = 4 OR o.blob IS DISTINCT FROM n.blob) AS dirty FROM o JOIN n USING (project, path) WHERE project % 5 <> 3 GROUP BY 1)
SELECT project, coalesce(dirty, 0) AS dirty, 0 AS deleted, CASE WHEN project % 5 = 3 THEN 'no_change' WHEN coalesce(dirty, 0) = 0 THEN 'no_dirty' WHEN dirty > 40 THEN 'max_files_exceeded' ELSE 'success' END AS exit_reason FROM p LEFT JOIN d USING (project)""")
def ownership_runs(t: Tables) -> DataFrame:
    rows = t.read("lineitem").select(col("l_suppkey").alias("project"), col("l_partkey").alias("path"), "l_quantity", "l_returnflag").repartition(t.parts("lineitem"), "project", "path")
    blob = F.sum(F.when((col("project") % 3 != 0) | (col("l_returnflag") != "R"), col("l_quantity")))
    k = col("project") % 5
    heads = rows.select("project").distinct().select("project", F.when(k == 3, "h2").when(k != 4, "h1").alias("last_head"), F.lit("h2").alias("head"))
    plan, _ = history.ownership_plan(heads, rows.groupBy("project", "path").agg(blob.alias("blob")), rows.groupBy("project", "path").agg(F.sum("l_quantity").alias("blob")), 40)
    return plan


@query("""WITH RECURSIVE e AS (SELECT CAST(c_custkey AS VARCHAR) AS src, CAST(c_custkey // 2 AS VARCHAR) AS dst FROM customer WHERE c_custkey > 0), w AS (SELECT src AS node, 1 AS hop FROM e WHERE dst = '3' UNION SELECT e.src, hop + 1 FROM w JOIN e ON e.dst = node WHERE hop < 3)
SELECT node, min(hop) AS hop FROM w GROUP BY 1""")
def impacted_tests(t: Tables) -> DataFrame:
    """Each customer calls the one of half its number; all are tests."""
    rows = t.read("customer").where("c_custkey > 0")
    calls = rows.select(F.lit("p").alias("project"), col("c_custkey").cast("string").alias("src"), F.floor(col("c_custkey") / 2).cast("string").alias("dst"))
    found, _ = Engine({"calls": calls, "tests": calls.select("project", col("src").alias("name"))}).test_impact("3", "p", 3, 500)
    return found


# issues ------------------------------------------------------------------------------------------------------------------

ISSUES = """issues AS (SELECT user_id AS issue_id, last.id % 40 AS assignee, CASE WHEN last.id % 4 = 0 THEN last.id END AS run_id,
 CASE last.kind WHEN 'view' THEN 'todo' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'in_review' WHEN 'error' THEN 'blocked' ELSE 'done' END AS status,
 CASE WHEN user_id % 3 = 0 THEN user_id + 1 END AS parent_id, seen AS updated_at, epoch(now) - epoch(seen) AS age, now
 FROM (SELECT user_id, max(ts) AS seen, arg_max({'id': event_id, 'kind': event_type}, (ts, event_id)) AS last FROM events GROUP BY 1), (SELECT max(ts) AS now FROM events))"""
#: Minutes of the window in which issues count: the events span a month.
WINDOW = 40_000


def _comments(t: Tables, body: Column, author: Column) -> DataFrame:
    return t.read("events").select(col("event_id").alias("comment_id"), col("user_id").alias("issue_id"), author.alias("author"), body.alias("body"), col("ts").cast("timestamp").alias("created_at"))


def agent(c: Column) -> Column:
    return F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(c.cast("string"), 12, "0"))


@query(f"""WITH {ISSUES}, said AS (SELECT user_id AS issue_id, event_id, ts, event_id % 2 AS target FROM events WHERE event_type = 'view'),
last AS (SELECT issue_id, arg_max({{'c': event_id, 't': target, 'at': ts}}, (ts, event_id)) AS c FROM said GROUP BY 1)
SELECT issue_id, c.c AS comment_id FROM issues JOIN last USING (issue_id) WHERE status IN ('todo', 'in_progress', 'in_review') AND c.t <> 0 AND epoch(updated_at) - epoch(c.at) >= 5 * 60""")
def comment_handoffs(t: Tables) -> DataFrame:
    """Views mention one of two agents; all issues belong to the first."""
    issues = t.issues().withColumn("assignee", agent(F.lit(0)))
    body = F.when(col("event_type") == "view", F.concat(F.lit("over to [x](agent://"), agent(col("event_id") % 2), F.lit(")"))).otherwise("fine")
    found = detectors.comment_only_handoff(issues, _comments(t, body, agent(F.lit(0))), t.feed_time(), 5, WINDOW)
    return found.select("issue_id", col("snapshot")["comment_id"].cast("long").alias("comment_id"))


@query(f"WITH {ISSUES} SELECT issue_id, CAST(floor(age) AS BIGINT) AS age_seconds FROM issues WHERE status = 'in_review' AND assignee % 3 = 0 AND age >= 300")
def reviews_of_implementers(t: Tables) -> DataFrame:
    agents = t.spark.range(40).select(col("id").alias("agent_id"), text("Agent", col("id")).alias("name"))
    roles = t.spark.range(40).select(text("AGENT", col("id")).alias("name"), F.when(col("id") % 3 == 0, "implementer").otherwise("reviewer").alias("role"))
    return detectors.review_owned_by_implementer(t.issues(), agents, roles, t.feed_time(), 5, WINDOW).select("issue_id", "age_seconds")


@query(f"""WITH {ISSUES} SELECT issue_id FROM issues WHERE status IN ('todo', 'in_progress', 'in_review') AND assignee % 4 = 1 AND issue_id NOT IN (SELECT user_id FROM events WHERE value > 190)""")
def cross_team_issues(t: Tables) -> DataFrame:
    """Agents of team b, unless they are in team a too."""
    teams = t.spark.range(40).select(col("id").cast("string").alias("agent_id"), F.when(col("id") % 2 == 1, "b").otherwise("a").alias("team"))
    both = t.spark.range(40).where("id % 4 = 3").select(col("id").cast("string").alias("agent_id"), F.lit("a").alias("team"))
    comments = _comments(t, F.when(col("value") > 190, "infra-block meant").otherwise("fine"), F.lit(0))
    issues = t.issues().withColumn("assignee", col("assignee").cast("string"))
    return detectors.cross_team_handoff(issues, comments, teams.unionByName(both), "a", t.feed_time(), WINDOW).select("issue_id")


@query(f"""WITH {ISSUES} SELECT issue_id FROM issues WHERE status = 'done' AND parent_id IS NULL AND issue_id NOT IN (SELECT user_id FROM events WHERE value > 150 AND event_id % 3 = 0)""")
def ownerless_completions(t: Tables) -> DataFrame:
    body = F.when(col("value") > 150, "Phase 4.1: QA pass").otherwise("Phase 4.1 runs")
    approvers = t.spark.createDataFrame([("qa",)], "agent_id string")
    comments = _comments(t, body, F.when(col("event_id") % 3 == 0, "qa").otherwise("dev"))
    return detectors.ownerless_completion(t.issues(), comments, approvers, t.feed_time(), WINDOW).select("issue_id")


@query(f"""WITH {ISSUES} SELECT issue_id, CASE WHEN assignee >= 30 AND age >= 180 AND status <> 'done' THEN 'wrong_assignee' ELSE 'ownerless_completion' END AS finding FROM issues
WHERE (status IN ('todo', 'in_progress', 'in_review') AND assignee >= 30 AND age >= 180) OR (status = 'done' AND parent_id IS NULL)""")
def first_findings(t: Tables) -> DataFrame:
    agents = t.spark.range(30).select(col("id").alias("agent_id"))
    approvers = t.spark.createDataFrame([("qa",)], "agent_id string")
    wrong = detectors.wrong_assignee(t.issues(), agents, t.feed_time(), 3, WINDOW)
    done = detectors.ownerless_completion(t.issues(), _comments(t, F.lit("x"), F.lit("qa")), approvers, t.feed_time(), WINDOW)
    return detectors.first_finding(done, wrong).select("issue_id", "finding")


@query(f"""WITH {ISSUES}, wakes AS (SELECT user_id % 97 AS issue_id, event_id % 40 AS agent, ts AS seen FROM events), now AS (SELECT max(ts) AS n FROM events),
lately AS (SELECT DISTINCT issue_id FROM wakes, now WHERE epoch(n) - epoch(seen) < 86400), often AS (SELECT agent, count(*) AS c FROM wakes, now WHERE epoch(n) - epoch(seen) < 864000 GROUP BY 1),
held AS (SELECT user_id AS issue_id, max(ts) FILTER (event_type = 'error') AS last, count(*) FILTER (event_type = 'error') AS c FROM events GROUP BY 1)
SELECT issue_id, CASE WHEN issue_id IN (SELECT issue_id FROM lately) THEN 'skip' WHEN coalesce(o.c, 0) >= 9 THEN 'escalate' ELSE 'wake' END AS decision
FROM issues LEFT JOIN often o ON assignee = agent JOIN held h USING (issue_id) WHERE h.last IS NULL OR (h.c <= 3 AND updated_at > h.last)""")
def wake_decisions(t: Tables) -> DataFrame:
    events = t.read("events")
    wakes = events.select((col("user_id") % 97).alias("issue_id"), (col("event_id") % 40).alias("agent_id"), col("ts").cast("timestamp").alias("at"))
    log = events.where("event_type = 'error'").select(col("user_id").alias("issue_id"), col("ts").cast("timestamp").alias("at"))
    return detectors.wake_decisions(t.issues(), wakes, detectors.escalations(log), t.feed_time(), 86_400, 9, 864_000).select("issue_id", "decision")


@query("SELECT user_id AS issue_id, max(ts) AS escalated_at, count(*) AS \"count\", count(*) > 3 AS permanent FROM events WHERE event_type = 'error' GROUP BY 1")
def escalation_log(t: Tables) -> DataFrame:
    log = t.read("events").where("event_type = 'error'").select(col("user_id").alias("issue_id"), col("ts").alias("at"))
    return detectors.escalations(log)


@query("SELECT 'sha' || arg_max(event_id, (ts, event_id)) AS deployed_sha, max(ts) AS deployed_at, CAST(48 AS DOUBLE) AS stale_hours FROM events")
def stale_deployments(t: Tables) -> DataFrame:
    log = t.read("events").select(text("sha", col("event_id")).alias("sha"), col("ts").cast("timestamp").alias("at"))
    now = F.lit(t.read("events").agg(F.max("ts") + F.expr("interval 48 hours")).first()[0]).cast("timestamp")
    return naive(detectors.stale_deployment(log, "other", now), "deployed_at")


@query("SELECT event_id AS pid FROM events WHERE event_type <> 'click' AND (event_id % 24) * 3600 >= 7200 AND (event_id % 60 < (event_id % 24) * 3600 * 0.005 OR value > 150)")
def idle_processes(t: Tables) -> DataFrame:
    two, k = lambda c: F.lpad(c.cast("string"), 2, "0"), col("event_id")
    command = F.when(col("event_type") == "click", "other --run").otherwise("tool --run x")
    rows = t.read("events").select(k.alias("pid"), F.concat(two(k % 24), F.lit(":00:00")).alias("etime"), F.concat(F.lit("0:"), two(k % 60)).alias("time"), command.alias("command"), col("value").alias("stream_age_seconds"))
    return detectors.idle_processes(rows, ["tool", "--run"], 7200, 0.005, 150).select("pid")


@query("SELECT issue_id, priority FROM (SELECT event_id AS issue_id, CAST(event_id % 6 AS INTEGER) AS priority, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 6, event_id) AS r FROM events) WHERE r <= 3")
def ranked_findings(t: Tables) -> DataFrame:
    rows = t.read("events").select(col("event_id").alias("issue_id"), (col("event_id") % 6).cast("int").alias("priority"), "user_id")
    return alerts.ranked_within(rows, ["user_id"], 3).select("issue_id", "priority")


@query("""WITH a AS (SELECT user_id % 5 AS feed, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 86400) AS BIGINT) AS tick, event_id AS id FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY tick, id) - 1 AS k FROM a)
SELECT id, CAST(floor((k + (SELECT max(b.tick * 7 - b.k) FROM k b WHERE b.feed = k.feed AND b.k <= k.k)) / 7) AS BIGINT) AS sent_at FROM k""")
def alert_ticks(t: Tables) -> DataFrame:
    days = F.floor((F.unix_seconds(col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / 86400)
    rows = t.read("events").select((col("user_id") % 5).alias("feed"), days.alias("tick"), col("event_id").alias("id"))
    return alerts.alert_ticks(rows, "feed", "tick", ["id"], 7).select("id", "sent_at")


@query("""WITH o AS (SELECT user_id, min(ts) AS first FROM events GROUP BY 1) SELECT CAST(user_id AS VARCHAR) AS issue_id, 'alert' AS action, 1 AS tier, count(*) AS n FROM o GROUP BY 1
UNION ALL SELECT CAST(user_id AS VARCHAR), 'escalate', 3, 1 FROM events JOIN o USING (user_id) WHERE epoch(ts) - epoch(first) >= 86400 GROUP BY 1""")
def alert_stream(t: Tables) -> DataFrame:
    """A finding for every user that holds all the time: it alerts once and is escalated after a day."""
    stream = windows.table_stream(t.spark, t.folder, "events").select(col("user_id").cast("string").alias("issue_id"), F.lit("idle").alias("finding"), col("ts").cast("timestamp").alias("at"), F.lit(True).alias("present"), F.lit("s").alias("snapshot"), F.lit(False).alias("actionable"))
    actions = alerts.alert_actions(stream, alerts.Delays(escalation_minutes=1440))
    found = windows.run_to_table(actions, shared_folder(t.spark, "alerts"))
    return found.groupBy("issue_id", "action", "tier").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 7200 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
w AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k) SELECT start, "end", user_id, n FROM w WHERE "end" <= (SELECT max(ts) FROM events) - INTERVAL 180 MINUTE""")
def streamed_sessions(t: Tables) -> DataFrame:
    stream = windows.sessions(windows.table_stream(t.spark, t.folder, "events"), "ts", ["user_id"], "2 hours")
    return naive(windows.run_to_table(stream, shared_folder(t.spark, "sessions")), "start", "end")


@query("SELECT issue_id, mentioned FROM (SELECT event_id AS issue_id, event_id % 3 AS mentioned FROM events)")
def agent_mentions(t: Tables) -> DataFrame:
    one = F.concat(F.lit(" agent://"), agent(col("event_id")))
    body = F.concat(F.lit("see"), F.expr("repeat(' AGENT://00000000-0000-0000-0000-00000000000A,', cast(event_id % 3 as int))"))
    rows = t.read("events").select(col("event_id").alias("issue_id"), F.size(detectors.mentions(body)).cast("long").alias("mentioned"), F.size(detectors.mentions(one)).alias("one"))
    return rows.where("one = 1").drop("one")


@query("SELECT user_id AS issue_id FROM (SELECT user_id, max(ts) AS seen, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY 1), (SELECT max(ts) AS now FROM events) WHERE kind IN ('view', 'click', 'purchase') AND user_id % 4 <> 0 AND epoch(now) - epoch(seen) <= 20000 * 60")
def eligible_issues(t: Tables) -> DataFrame:
    origin = F.when(col("issue_id") % 4 == 0, "stranded_issue_recovery").when(col("issue_id") % 4 == 1, "other")
    return detectors.eligible(t.issues().withColumn("origin", origin), t.feed_time(), window_minutes=20_000).select("issue_id")


# tools -----------------------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT page_id, html FROM pages WHERE page_id = 3), l AS (SELECT unnest(string_split(html, chr(10))) AS content, generate_subscripts(string_split(html, chr(10)), 1) AS line FROM f) SELECT line, content FROM l WHERE line BETWEEN 1 AND 3""")
def code_snippet(t: Tables) -> DataFrame:
    files = t.read("pages").select(col("page_id").cast("string").alias("path"), F.replace("html", F.lit("\r"), F.lit("")).alias("text"))
    return search.snippet(files, "3", 1, 3)


@query("""WITH RECURSIVE uses AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT coalesce(a.src, b.dst) AS module, coalesce(a.n, 0) AS uses, coalesce(b.n, 0) AS used_by FROM (SELECT src, count(*) AS n FROM uses GROUP BY 1) a FULL JOIN (SELECT dst, count(*) AS n FROM uses GROUP BY 1) b ON a.src = b.dst""")
def architecture_overview(t: Tables) -> DataFrame:
    edges = t.uses().select(F.lit("p").alias("project"), col("consumer").alias("src"), col("producer").alias("dst"))
    return Engine({"imports": edges}).get_architecture("p")


@query("""WITH m AS (SELECT l_partkey AS path, sum(l_quantity) FILTER (l_returnflag <> 'R') AS a, sum(l_quantity) AS b FROM lineitem GROUP BY 1) SELECT path, 'dirty' AS state FROM m WHERE a IS DISTINCT FROM b""")
def detected_changes(t: Tables) -> DataFrame:
    rows = t.read("lineitem")
    at = lambda n, c: rows.groupBy(col("l_partkey").alias("path")).agg(F.sum(c).alias("blob")).where("blob is not null").select(F.lit("p").alias("project"), F.lit(n).alias("at"), "path", "blob")
    both = at(1, F.when(col("l_returnflag") != "R", col("l_quantity"))).unionByName(at(2, col("l_quantity"))).unionByName(at(0, F.lit(0.0)))
    return Engine({"manifests": both}).detect_changes("p")


@query("SELECT event_type AS extractor, max(ts) AS last_run_at FROM events GROUP BY 1 UNION ALL SELECT 'lint', NULL")
def extractor_list(t: Tables) -> DataFrame:
    runs = t.runs()
    known = runs.select("extractor").distinct().unionByName(t.spark.createDataFrame([("lint",)], "extractor string"))
    return naive(Engine({"extractors": known, "runs": runs}).list_extractors(), "last_run_at")


@query("SELECT n_name AS slug, CASE WHEN n_regionkey = 0 THEN 'new' ELSE 'old' END AS language FROM nation")
def registered_projects(t: Tables) -> DataFrame:
    nation = t.read("nation")
    old = nation.select(F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))).alias("slug"), F.lit("old").alias("language"))
    new = nation.where("n_regionkey = 0").select(F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))).alias("slug"), F.lit("new").alias("language"))
    return Engine({"projects": old}).register_project(new).select(F.upper(F.replace("slug", F.lit("-"), F.lit("_"))).alias("slug"), "language")
