"""Queries of readers: texts in a tool's format are put together from the tables, and what is read back is held against the tables."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from quarrylight.plans import architecture
from quarrylight.proxies import Tables
from quarrylight.registry import query
from quarrylight.sources import api_dumps, config, feeds, gitlog, manifests, reports, scip, trees


def text(*parts: Column | str) -> Column:
    """Columns and plain pieces in a row."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def col(name: str) -> Column:
    return F.col(name)


def joined(rows: DataFrame, keys: list[str], part: Column, before: Column | str = "", after: Column | str = "", between: str = "") -> DataFrame:
    """keys and text: the parts of each key in a row, whatever their order."""
    both = rows.groupBy(*keys).agg(F.concat_ws(between, F.collect_list(part)).alias("_t"))
    return both.select(*keys, text(before, col("_t"), after).alias("text"))


def own(sign: str = "_") -> Column:
    """A name for each brand and each 200 parts: files by it grow in number with the table, not in length."""
    return F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(sign), F.floor(col("p_partkey") / 200).cast("string"))


OWN = "replace(p_brand, '#', '') || '_' || p_partkey // 200"


def sha(c: Column) -> Column:
    return F.concat(F.md5(c.cast("string")), F.lit("00000000"))


def naive(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: col(c).cast("timestamp_ntz") for c in columns})


SHA = "md5(CAST({} AS VARCHAR)) || '00000000'"

# git ------------------------------------------------------------------------------------------------------------------


@query(f"""SELECT {SHA.format("o_orderkey")} AS sha, CASE WHEN o_orderpriority = '5-LOW' THEN 'renovate[bot]' ELSE 'Author ' || o_custkey END AS name, 'user' || o_custkey || '@example.org' AS email, o_orderdate AS committed_at,
CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'F' THEN 1 ELSE 0 END AS n_parents, substr(o_orderpriority || ' ' || repeat('x', CAST(o_orderkey % 300 AS INTEGER)), 1, 200) AS subject, o_orderstatus = 'P' AS is_merge, o_orderpriority = '5-LOW' AS is_bot FROM orders""")
def git_commits(t: Tables) -> DataFrame:
    name = F.when(col("o_orderpriority") == "5-LOW", "renovate[bot]").otherwise(text("Author ", col("o_custkey")))
    parents = F.when(col("o_orderstatus") == "P", "p1 p2").when(col("o_orderstatus") == "F", "p1").otherwise("")
    subject = text(col("o_orderpriority"), " ", F.expr("repeat('x', cast(o_orderkey % 300 as int))"))
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.concat(F.concat_ws("\x00", sha(col("o_orderkey")), name, text("USER", col("o_custkey"), "@Example.org"), at, parents, subject), F.lit("\x1e\n"))
    found = gitlog.commits(joined(t.read("orders"), ["o_custkey"], record))
    return naive(found.withColumn("n_parents", F.size("parents")).drop("parents"), "committed_at")


@query("SELECT doc_id, sha256(CASE WHEN length(text) > 1024 THEN substr(text, 1, 1024) || '...' ELSE text END) AS excerpt FROM documents")
def git_message_excerpts(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", F.sha2(gitlog.message_excerpt(col("text")), 256).alias("excerpt"))


@query(f"""SELECT {SHA.format("l_orderkey")} AS sha, 'p' || l_partkey || '.py' AS path, CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS INTEGER) END AS added, CASE WHEN l_returnflag <> 'R' THEN l_linenumber END AS deleted FROM lineitem""")
def git_numstat(t: Tables) -> DataFrame:
    counts = F.when(col("l_returnflag") == "R", "-\t-").otherwise(text(col("l_quantity").cast("int"), "\t", col("l_linenumber")))
    return gitlog.numstat(joined(t.read("lineitem"), ["l_orderkey"], text(counts, "\tp", col("l_partkey"), ".py\n"), text("commit:", sha(col("l_orderkey")), "\n")))


@query(f"""SELECT '100644' AS mode, 'blob' AS kind, {SHA.format("p_partkey")} AS blob, p_brand || '/' || p_name AS path FROM part""")
def git_tree(t: Tables) -> DataFrame:
    line = text("100644 blob ", sha(col("p_partkey")), "\t", col("p_brand"), "/", col("p_name"), "\n")
    return gitlog.ls_tree(joined(t.read("part").withColumn("own", own()), ["own"], line))


@query("""SELECT 'p' || l_partkey AS path, 's' || l_suppkey || '@example.org' AS email, 'Supplier ' || l_suppkey AS name, count(*) AS lines, max(l_shipdate) AS last_commit_at FROM lineitem GROUP BY l_partkey, l_suppkey""")
def git_blame(t: Tables) -> DataFrame:
    who = col("l_suppkey")
    entry = text(sha(col("l_orderkey")), " 1 ", col("l_linenumber"), " 1\nauthor Supplier ", who, "\nauthor-mail <S", who, "@Example.org>\nauthor-time ", F.unix_seconds(col("l_shipdate").cast("timestamp")), "\nsummary s\nfilename f\n\tcode\n")
    blobs = joined(t.read("lineitem"), ["l_partkey"], entry).select(text("p", col("l_partkey")).alias("path"), "text")
    return naive(gitlog.blame(blobs), "last_commit_at")


@query("""SELECT l_orderkey AS blob, 'p' || l_partkey AS path, min(CASE WHEN l_linestatus = 'F' THEN 'old' || l_partkey ELSE 'p' || l_partkey END) AS old_path, count(*) AS hunks, CAST(sum(l_linenumber) AS BIGINT) AS added, count(*) AS deleted
FROM lineitem GROUP BY l_orderkey, l_partkey""")
def git_diff(t: Tables) -> DataFrame:
    # dealt by order, so that its files and its text are put together where its rows are
    rows = t.read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_linestatus").repartition("l_orderkey")
    hunk = text("@@ -1,2 +1,3 @@ f\n kept\n-gone\n", F.expr("repeat('+++ new\n', l_linenumber)"))
    old = F.min(F.when(col("l_linestatus") == "F", text("old", col("l_partkey"))).otherwise(text("p", col("l_partkey"))))
    files = rows.groupBy("l_orderkey", "l_partkey").agg(old.alias("_old"), F.concat_ws("", F.collect_list(hunk)).alias("_h"))
    name = text("p", col("l_partkey"))
    files = files.withColumn("_t", text("diff --git a/", col("_old"), " b/", name, "\nindex 1..2 100644\n--- a/", col("_old"), "\n+++ b/", name, "\n", col("_h")))
    blobs = files.groupBy(col("l_orderkey").alias("blob")).agg(F.concat_ws("", F.collect_list("_t")).alias("text"))
    return gitlog.diff(blobs)


@query("SELECT o_orderkey AS sha FROM orders, (SELECT o_orderdate AS d, o_orderkey AS k FROM orders WHERE o_orderkey = 100) WHERE o_orderdate > d OR o_orderdate = d AND o_orderkey > k")
def git_new_commits(t: Tables) -> DataFrame:
    commits = t.commits()
    at = commits.where("sha = 100").first()
    return gitlog.new_commits(t.spark, commits, (at["committed_at"], 100) if at else None).select("sha")


@query("""WITH n AS (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS k, count(*) OVER (PARTITION BY l_partkey) AS total FROM lineitem)
SELECT l_partkey, l_orderkey, l_linenumber, total > 20 AS truncated FROM n WHERE k <= 20""")
def git_output_caps(t: Tables) -> DataFrame:
    rows = t.read("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", (col("l_orderkey") * 10 + col("l_linenumber")).alias("at"))
    return gitlog.capped(rows, "l_partkey", "at", 20).drop("at")


# symbol indexes -------------------------------------------------------------------------------------------------------


@query("""SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'src' ELSE 'lib' END || '/f' || l_suppkey || '.py' AS file_path, 'python' AS language, 'pkg' || l_partkey % 7 || ' C' || l_partkey || '#run().' AS qualified_name,
CASE l_linenumber WHEN 1 THEN 'def' WHEN 2 THEN 'assign' WHEN 3 THEN 'decl' ELSE 'use' END AS kind, CAST(l_orderkey % 5000 AS INTEGER) AS line, l_linenumber AS col_start, l_linenumber + CAST(l_quantity AS INTEGER) AS col_end FROM lineitem
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT l_suppkey FROM lineitem)""")
def symbol_index(t: Tables) -> DataFrame:
    """An index of each supplier's lines, local symbols among them, and one that is cut off."""
    n = col("l_linenumber")
    symbol = text("scip-python pip pkg", col("l_partkey") % 7, " 1.0 C", col("l_partkey"), "#run().")
    span = F.array((col("l_orderkey") % 5000).cast("int"), n, n + col("l_quantity").cast("int"))
    roles = F.when(n == 1, 1).when(n == 2, 4).when(n == 3, 64).otherwise(8)
    path = text(F.when(col("l_suppkey") % 2 == 0, "src").otherwise("lib"), "/f", col("l_suppkey"), ".py")
    local = F.array(F.struct(F.lit("local 1").alias("symbol"), F.lit(1).alias("roles"), F.array(F.lit(1), F.lit(1), F.lit(2)).alias("span")))
    own = F.concat(F.collect_list(F.struct(symbol.alias("symbol"), roles.alias("roles"), span.alias("span"))), local)
    files = t.read("lineitem").groupBy(path.alias("path")).agg(own.alias("own"))
    good = files.select("path", scip.encoded_index(col("path"), col("own")).alias("content"))
    broken = files.select("path", F.unhex(F.lit("12FF01616263")).alias("content"))
    found = scip.index_occurrences(good.unionByName(broken).withColumn("length", F.octet_length("content")), "sha")
    return found.select("file_path", F.when(col("error").isNull(), col("language")).alias("language"), "qualified_name", "kind", "line", "col_start", "col_end")


@query("""SELECT 'pkg.sym' || (k % 1000) AS symbol, CASE WHEN k % 10 = 0 THEN 'def' ELSE 'use' END AS kind, CASE WHEN k % 7 = 0 THEN 'vendor/f' ELSE 'src/f' END || (k % 100) || '.py' AS file_path, CAST(k % 500 AS INTEGER) AS line, CAST(k % 80 AS INTEGER) AS col_start
FROM (SELECT l_orderkey * 31 + l_partkey * 7 + l_linenumber AS k FROM lineitem)""")
def synthetic_occurrences(t: Tables) -> DataFrame:
    """An occurrence for each line, by a number made of its keys."""
    rows = t.read("lineitem").select((col("l_orderkey") * 31 + col("l_partkey") * 7 + col("l_linenumber")).alias("number"))
    return scip.numbered_occurrences(rows, "number")


# trees ------------------------------------------------------------------------------------------------------------------


PLACE = "CASE page_id % 5 WHEN 0 THEN 'src/core/' WHEN 1 THEN 'node_modules/x/' WHEN 2 THEN 'Tests/' WHEN 3 THEN 'Examples/Demo/' ELSE 'generated/' END || 'f' || page_id || CASE page_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.kt' ELSE '.md' END"


def _page_files(t: Tables) -> DataFrame:
    k = col("page_id")
    folder = F.when(k % 5 == 0, "src/core/").when(k % 5 == 1, "node_modules/x/").when(k % 5 == 2, "Tests/").when(k % 5 == 3, "Examples/Demo/").otherwise("generated/")
    ending = F.when(k % 3 == 0, ".py").when(k % 3 == 1, ".kt").otherwise(".md")
    content = F.encode("html", "UTF-8")
    return t.read("pages").select(text("file:/w/tree/", folder, "f", k, ending).alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


@query(f"""SELECT path, CASE WHEN strlen(html) <= 6000 THEN md5(html) END AS digest, CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'kotlin' END AS language, CASE WHEN path LIKE 'src/%' THEN 'core' ELSE split_part(path, '/', 1) END AS module,
CASE WHEN path LIKE 'src/%' THEN 'library' WHEN path LIKE 'Tests/%' THEN 'test' WHEN path LIKE 'Examples/%' THEN 'example' ELSE 'other' END AS context FROM (SELECT {PLACE} AS path, html FROM pages) WHERE path NOT LIKE 'node_modules/%' AND path NOT LIKE '%.md'""")
def source_tree(t: Tables) -> DataFrame:
    found = trees.source_rows(_page_files(t), "/w/tree", most_bytes=6000)
    return found.select("path", F.md5("text").alias("digest"), "language", "module", "context")


@query(f"SELECT path, CASE WHEN path LIKE 'generated/%' THEN 'generated' ELSE 'too_large' END AS reason FROM (SELECT {PLACE} AS path, html FROM pages) WHERE path LIKE 'generated/%' OR strlen(html) > 6000")
def skipped_files(t: Tables) -> DataFrame:
    return trees.left_out(_page_files(t).select(trees.relative(col("path"), "/w/tree").alias("path"), "length"), 6000)


@query("""SELECT 'f' || o_custkey AS path, CAST(2 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS line,
CASE WHEN o_orderkey % 4 = 0 THEN 'deep' WHEN o_orderkey % 4 = 1 THEN 'one' ELSE 'core' END AS module, CASE WHEN o_orderkey % 4 = 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM orders QUALIFY o_orderkey % 4 <> 3""")
def module_imports(t: Tables) -> DataFrame:
    k = col("o_orderkey")
    said = F.when(k % 4 == 0, "import core.deep.Thing").when(k % 4 == 1, "from two import x").when(k % 4 == 2, "  import core.Other").otherwise("import elsewhere")
    parts = t.parts("orders")
    orders = t.read("orders").repartition(parts, "o_custkey")
    lines = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), said.alias("s")))).alias("_l"))
    files = lines.select(text("f", col("o_custkey")).alias("path"), F.lit("kotlin").alias("language"), F.concat_ws("\n", F.transform("_l", lambda x: F.concat(F.lit("# note\n"), x["s"]))).alias("text"))
    modules = t.spark.createDataFrame([("core", "core"), ("deep", "core.deep"), ("one", "two"), ("other", "two")], "module string, name string")
    return trees.imports(files, modules, parts)


# manifests ----------------------------------------------------------------------------------------------------------------


@query(f"""SELECT {OWN} || '/pyproject.toml' AS declared_in, 'Pkg_' || p_partkey AS name, '>=' || p_size AS "constraint", 'compile' AS scope, CASE WHEN p_size < 10 THEN 'unresolved' ELSE p_size || '.1' END AS version,
'pkg:pypi/pkg-' || p_partkey || '@' || CASE WHEN p_size < 10 THEN 'unresolved' ELSE p_size || '.1' END AS purl FROM part""")
def python_manifests(t: Tables) -> DataFrame:
    part = t.read("part").withColumn("own", own())
    name, size = text("Pkg_", col("p_partkey")), col("p_size")
    projects = joined(part, ["own"], text('"', name, ">=", size, '"'), "[project]\ndependencies = [", "]\n", ", ").select(text(col("own"), "/pyproject.toml").alias("path"), "text")
    entry = text('[[package]]\nname = "', F.when(size < 10, text("other-", col("p_partkey"))).otherwise(text("pkg-", col("p_partkey"))), '"\nversion = "', size, '.1"\n')
    locks = joined(part, ["p_type", "own"], entry).select(text(col("p_type"), col("own"), "/uv.lock").alias("path"), "text")
    return manifests.python_dependencies(projects, locks)


@query(f"""SELECT {OWN} || '/Package.swift' AS declared_in, 'https://github.com/Org/Lib' || p_partkey || '.git' AS url, p_size || '.0.0' AS "constraint", CASE WHEN p_size < 10 THEN 'unresolved' ELSE p_size || '.2.0' END AS version,
'pkg:github/org/lib' || p_partkey || '@' || CASE WHEN p_size < 10 THEN 'unresolved' ELSE p_size || '.2.0' END AS purl FROM part""")
def swift_manifests(t: Tables) -> DataFrame:
    part, k, size = t.read("part").withColumn("own", own()), col("p_partkey"), col("p_size")
    files = joined(part, ["own"], text('.package(url: "https://github.com/Org/Lib', k, '.git", from: "', size, '.0.0"),\n')).select(text(col("own"), "/Package.swift").alias("path"), "text")
    pin = text('{"location": "git@github.com:Org/', F.when(size < 10, "Other").otherwise("Lib"), k, '", "state": {"version": "', size, '.2.0"}}')
    pins = joined(part, ["p_type", "own"], pin, '{"pins": [', "]}", ", ")
    return manifests.swift_dependencies(files, pins.select(text(col("p_type"), col("own")).alias("path"), "text"))


@query(f"""SELECT {OWN} || '/build.gradle.kts' AS declared_in, CASE WHEN p_size % 2 = 0 THEN 'io.acme:lib' ELSE 'org.plain:lib' END || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN 'compile' ELSE 'test' END AS scope, p_size || '.5' AS version,
'pkg:maven/' || CASE WHEN p_size % 2 = 0 THEN 'io.acme/lib' ELSE 'org.plain/lib' END || p_partkey || '@' || p_size || '.5' AS purl FROM part""")
def gradle_manifests(t: Tables) -> DataFrame:
    part, k, size = t.read("part").withColumn("place", own()), col("p_partkey"), col("p_size")
    line = F.when(size % 2 == 0, text("implementation(libs.acme.lib", k, ")\n")).otherwise(text('testImplementation("org.plain:lib', k, ":", size, '.5")\n'))
    scripts = joined(part, ["place"], line).select(text(col("place"), "/build.gradle.kts").alias("path"), "text")
    entry = text("acme-lib", k, ' = { module = "io.acme:lib', k, '", version.ref = "v', size, '" }\n')
    versions = "[versions]\n" + "".join(f'v{n} = "{n}.5"\n' for n in range(1, 51)) + "[libraries]\n"
    catalogs = joined(part, ["p_type", "place"], entry, versions).select(text(col("p_type"), col("place")).alias("path"), "text")
    return manifests.gradle_dependencies(catalogs, scripts)


EDGE_ROWS = "(SELECT DISTINCT c_nationkey AS a, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 2 END AS b FROM customer)"


def _edges(t: Tables) -> DataFrame:
    to = F.when(col("c_mktsegment") == "BUILDING", 0).when(col("c_mktsegment") == "MACHINERY", 1).otherwise(2)
    return t.read("customer").select(col("c_nationkey").alias("a"), to.alias("b")).distinct()


@query(f"SELECT 'T' || a AS src, 'T' || b AS dst, 'Package.swift' AS declared_in FROM {EDGE_ROWS}")
def swift_target_edges(t: Tables) -> DataFrame:
    names = joined(_edges(t), ["a"], text('"T', col("b"), '"'), between=", ")
    own = names.withColumn("t", text('.target(\n  name: "T', col("a"), '",\n  dependencies: [', col("text"), ', .product(name: "Far", package: "far")]),\n'))
    return manifests.swift_targets(own.groupBy(F.lit("Package.swift").alias("path")).agg(F.concat_ws("", F.collect_list("t")).alias("text")))


@query(f"SELECT ':m:n' || a AS src, ':m:n' || b AS dst, 'm/n' || a || '/build.gradle.kts' AS declared_in FROM {EDGE_ROWS}")
def gradle_module_edges(t: Tables) -> DataFrame:
    scripts = joined(_edges(t), ["a"], text('implementation(project(":m:n', col("b"), '"))\n'))
    return manifests.gradle_modules(scripts.select(text("m/n", col("a"), "/build.gradle.kts").alias("path"), "text"))


# public APIs ----------------------------------------------------------------------------------------------------------------


@query(f"""SELECT 'com.acme.' || {OWN} || '.' || CASE WHEN p_size % 2 = 0 THEN 'run' || p_partkey || '(a: Int)' ELSE 'size' || p_partkey END AS fqn, CASE WHEN p_size % 2 = 0 THEN 'function' ELSE 'property' END AS kind, CASE WHEN p_size % 3 = 0 THEN 'protected' ELSE 'public' END AS visibility FROM part
UNION ALL SELECT DISTINCT 'com.acme.' || {OWN}, 'interface', 'public' FROM part""")
def kotlin_api(t: Tables) -> DataFrame:
    part, k, size = t.read("part").withColumn("own", own()), col("p_partkey"), col("p_size")
    seen = F.when(size % 3 == 0, "protected").otherwise("public")
    member = F.when(size % 2 == 0, text("\t", seen, " final fun run", k, " (a:   Int): Boolean\n")).otherwise(text("\t", seen, " abstract val size", k, ": Long\n"))
    files = joined(part, ["own"], member, text("// tool\npublic abstract interface com/acme/", col("own"), " : com/acme/Base {\n"), "}\n")
    return api_dumps.kotlin_api(files.select(text(col("own"), ".api").alias("path"), "text")).select("fqn", "kind", "visibility")


@query(f"""SELECT {OWN} || '.' || CASE WHEN p_size % 2 = 0 THEN 'run' || p_partkey || '(a: Int)' ELSE 'size' || p_partkey END AS fqn, CASE WHEN p_size % 2 = 0 THEN 'function' ELSE 'property' END AS kind FROM part
UNION ALL SELECT DISTINCT {OWN}, 'struct' FROM part UNION ALL SELECT DISTINCT 'after' || {OWN} || '()', 'function' FROM part""")
def swift_api(t: Tables) -> DataFrame:
    part, k, size = t.read("part").withColumn("own", own()), col("p_partkey"), col("p_size")
    body = text("  public func run", k, "(a:   Int) -> Bool {\n    if a > 0 {\n      return true\n    }\n    return false\n  }\n")
    member = F.when(size % 4 == 0, body).when(size % 2 == 0, text("  public func run", k, "(a:   Int) -> Bool\n")).otherwise(text("  public var size", k, ": Int { get }\n"))
    files = joined(part, ["own"], member, text("// tool\npublic struct ", col("own"), " {\n"), text("}\npublic func after", col("own"), "()\n"))
    return api_dumps.swift_api(files.select(text(col("own"), ".swiftinterface").alias("path"), "text")).select("fqn", "kind")


# reports -----------------------------------------------------------------------------------------------------------------


@query("""SELECT 's:' || p_partkey AS symbol_key, p_name AS display_name, 'function' AS kind, 'src/' || p_type || '.swift' AS source_file, p_size AS source_line, p_size % 2 = 0 AS public, p_type = 'PROMO' AS skipped FROM part WHERE p_brand <> 'Brand#1'
UNION ALL SELECT NULL, p_name, 'warning', 'lacks location, ids', NULL, NULL, NULL FROM part WHERE p_brand = 'Brand#1'""")
def dead_symbol_report(t: Tables) -> DataFrame:
    place = text(', "location": "src/', col("p_type"), ".swift:", col("p_size"), ':7", "ids": ["s:', col("p_partkey"), '"]')
    item = text('{"kind": "function", "name": "', col("p_name"), '", "accessibility": "', F.when(col("p_size") % 2 == 0, "public").otherwise("internal"), '"', F.when(col("p_brand") == "Brand#1", "").otherwise(place), "}")
    files = joined(t.read("part"), ["p_brand"], item, "[", "]", ", ")
    good, warnings = reports.dead_symbol_report(files, skip_paths=["^src/PROMO"])
    none = F.lit(None)
    lost = warnings.select(none.cast("string").alias("symbol_key"), col("name").alias("display_name"), F.lit("warning").alias("kind"), col("warning").alias("source_file"), none.cast("int").alias("source_line"), none.cast("boolean").alias("public"), none.cast("boolean").alias("skipped"))
    return good.drop("hints").unionByName(lost)


@query("""SELECT 'src/' || p_brand || '.py' AS path, 'f' || p_partkey AS "function", p_size AS start_line, p_size + greatest(p_size % 9 - 1, 0) AS end_line, p_size % 9 AS nloc, p_size % 4 AS ccn FROM part""")
def complexity_report(t: Tables) -> DataFrame:
    k, size = col("p_partkey"), col("p_size")
    rows = t.read("part").select(text("f", k, "(a int) at src/", col("p_brand"), ".py:", size).alias("name"), F.array(k.cast("string"), (size % 9).cast("string"), (size % 4).cast("string")).alias("values"))
    few = rows.select("name", F.slice("values", 1, 2).alias("values"))  # rows with too few values say nothing
    return reports.complexity_report(rows.unionByName(few))


@query("""WITH f AS (SELECT event_type AS rule, 'f' || user_id AS path, CAST(event_id % 50 AS INTEGER) AS start, CASE WHEN value >= 90 THEN 1 WHEN value >= 50 THEN 2 WHEN value >= 10 THEN 3 ELSE 4 END AS r FROM events)
SELECT rule, path, start, min(start + r) AS "end", 'm' || min(r) AS message, CASE min(r) WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'informational' END AS severity FROM f GROUP BY 1, 2, 3""")
def scan_report(t: Tables) -> DataFrame:
    v, start = col("value"), (col("event_id") % 50).cast("int")
    r = F.when(v >= 90, 1).when(v >= 50, 2).when(v >= 10, 3).otherwise(4)
    said = F.when(v >= 90, "ERROR").when(v >= 50, "warning").when(v >= 10, "INFO").otherwise("NOTE")
    item = text('{"check_id": "rules.', col("event_type"), '", "path": "f', col("user_id"), '", "start": {"line": ', start, '}, "end": {"line": ', start + r, '}, "extra": {"message": "m', r, '", "severity": "', said, '"}}')
    files = joined(t.read("events"), ["user_id"], item, '{"results": [', "]}", ", ").select("text")
    empty = t.spark.createDataFrame([('{"results": []}',)], "text string")  # a scanner that found nothing
    return reports.scan_report(files.unionByName(empty))


@query("""WITH k AS (SELECT p_type AS path, p_partkey, p_size FROM part) SELECT path, 'en' AS locale, CAST(count(*) AS INTEGER) AS keys FROM k GROUP BY 1
UNION ALL SELECT path, 'de', CAST(count(*) FILTER (p_size % 2 = 0) AS INTEGER) FROM k GROUP BY 1 HAVING count(*) FILTER (p_size % 2 = 0) > 0
UNION ALL SELECT path, 'fr', CAST(count(*) FILTER (p_size % 3 = 0) AS INTEGER) FROM k GROUP BY 1 HAVING count(*) FILTER (p_size % 3 = 0) > 0""")
def translations(t: Tables) -> DataFrame:
    size = col("p_size")
    have = F.concat_ws(", ", F.lit('"en": {}'), F.when(size % 2 == 0, '"de": {}'), F.when(size % 3 == 0, '"fr": {}'))
    entry = text('"k', col("p_partkey"), '": {"localizations": {', have, "}}")
    return reports.translations(joined(t.read("part"), ["p_type"], entry, '{"sourceLanguage": "en", "strings": {', "}}", ", ").withColumnRenamed("p_type", "path"))


@query("""WITH k AS (SELECT CASE p_size % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END AS locale, p_partkey FROM part), n AS (SELECT locale, count(*) AS keys FROM k GROUP BY 1)
SELECT locale, keys, round(100.0 * keys / (SELECT keys FROM n WHERE locale = 'en'), 1) AS coverage_pct FROM n""")
def translation_coverage(t: Tables) -> DataFrame:
    size, k = col("p_size") % 3, col("p_partkey")
    path = F.when(size == 0, "res/values/strings.xml").when(size == 1, "de.lproj/L.strings").otherwise("res/values-fr/strings.xml")
    line = F.when(size == 1, text('"k', k, '" = "x";\n')).otherwise(text('<string name="k', k, '">x</string>\n'))
    return reports.coverage(reports.string_tables(joined(t.read("part").withColumn("path", path), ["path"], line)))


@query("""WITH s AS (SELECT user_id, event_id, event_id % 10 + 1 AS c, event_id % 7 AS w FROM events), n AS (SELECT user_id, sum(c) AS tc, sum(w) AS tw FROM s GROUP BY 1)
SELECT 't' || user_id AS trace_id, 'f' || event_id AS symbol, 'main' AS thread, c AS cpu_samples, w AS wall_ms, round(c / tc, 9) AS cpu_share, round(CASE WHEN tw > 0 THEN w / tw ELSE 0 END, 9) AS wall_share, c / tc >= 0.02 AS hot FROM s JOIN n USING (user_id)""")
def profile_trace(t: Tables) -> DataFrame:
    sample = text('{"symbol_name": "f', col("event_id"), '", "cpu_samples": ', col("event_id") % 10 + 1, ', "wall_ms": ', col("event_id") % 7, ', "thread_name": "main"}')
    traces = joined(t.read("events"), ["user_id"], sample, text('{"trace_id": "t', col("user_id"), '", "threshold_cpu_share": 0.02, "samples": ['), "]}", ", ")
    found = reports.instruments_trace(traces)
    return found.withColumns({c: F.round(c, 9) for c in ("cpu_share", "wall_share")})


@query("SELECT n_name AS symbol, c_mktsegment AS thread, count(*) AS samples FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def sampled_frames(t: Tables) -> DataFrame:
    customer = t.read("customer")
    samples = t.read("orders").select(col("o_custkey").alias("callsite_id"), col("o_custkey").alias("thread_id"))
    callsites = customer.select(col("c_custkey").alias("callsite_id"), col("c_nationkey").alias("frame_id"))
    frames = t.read("nation").select(col("n_nationkey").alias("frame_id"), col("n_name").alias("symbol"))
    return reports.sampled_frames(samples, callsites, frames, customer.select(col("c_custkey").alias("thread_id"), col("c_mktsegment").alias("thread")))


# feeds ----------------------------------------------------------------------------------------------------------------------


@query("""SELECT event_id AS pid, '0' || event_id % 9 || ':00:00' AS etime, '0:0' || event_id % 9 AS time, 'tool --run ' || event_type AS command FROM events""")
def process_list(t: Tables) -> DataFrame:
    k = col("event_id")
    line = text("  ", k, "  0", k % 9, ":00:00 0:0", k % 9, " tool --run ", col("event_type"), "\n")
    return feeds.process_list(joined(t.read("events"), ["user_id"], line, "  PID ELAPSED TIME COMMAND\n"))


@query("SELECT date_trunc('second', ts) AS at, 'sha' || event_id AS sha FROM events WHERE event_type <> 'error'")
def deployment_log(t: Tables) -> DataFrame:
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.when(col("event_type") == "error", text(at, "\tno deployment\n")).otherwise(text(at, "\tok\tmain_sha=sha", col("event_id"), "\tend\n"))
    return naive(feeds.deployment_log(joined(t.read("events"), ["user_id"], line)), "at")


PULL_ROWS = "(SELECT user_id AS number, max(ts) AS u, min(ts) AS c, count(*) AS n FROM events GROUP BY 1)"


def _pulls(t: Tables) -> tuple[DataFrame, DataFrame]:
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    comment = text('{"id": "c', col("event_id"), '", "author": {"login": "a', col("event_id") % 9, '"}, "body": "', col("event_type"), '", "createdAt": "', iso("ts"), '"}')
    rows = t.read("events").groupBy("user_id").agg(F.concat_ws(", ", F.collect_list(comment)).alias("_c"), F.max("ts").alias("u"), F.min("ts").alias("c"))
    item = text('{"number": ', col("user_id"), ', "title": "t', col("user_id"), '", "body": "b", "state": "OPEN", "author": {"login": "u', col("user_id") % 5, '"}, "createdAt": "', iso("c"), '", "updatedAt": "', iso("u"), '", "comments": [', col("_c"), "]}")
    pages = joined(rows.withColumn("page", col("user_id") % 50), ["page"], item, "[", "]", ", ")
    return feeds.pull_requests(pages, "2024-01-20T00:00:00Z")


@query(f"SELECT number, 't' || number AS title, 'u' || number % 5 AS author, date_trunc('second', c) AS created_at, date_trunc('second', u) AS updated_at FROM {PULL_ROWS} WHERE date_trunc('second', u) >= TIMESTAMP '2024-01-20'")
def pull_requests(t: Tables) -> DataFrame:
    return naive(_pulls(t)[0].select("number", "title", "author", "created_at", "updated_at"), "created_at", "updated_at")


@query(f"""SELECT 'c' || event_id AS comment_id, user_id AS number, 'a' || event_id % 9 AS author, event_type AS body, date_trunc('second', ts) AS created_at FROM events
WHERE user_id IN (SELECT number FROM {PULL_ROWS} WHERE date_trunc('second', u) >= TIMESTAMP '2024-01-20')""")
def pull_request_comments(t: Tables) -> DataFrame:
    return naive(_pulls(t)[1], "created_at")


@query("SELECT 'c' || n_nationkey AS consumer, 'p' || n_regionkey AS producer, 'a' || n_nationkey AS from_commit, 'b' || n_nationkey AS to_commit FROM nation")
def delta_requests(t: Tables) -> DataFrame:
    k = col("n_nationkey")
    item = text('{"consumer": "c', k, '", "producer": "p', col("n_regionkey"), '", "from_commit": "a', k, '", "to_commit": "b', k, '"}, {"consumer": "c', k, '"}')
    return feeds.delta_requests(joined(t.read("nation"), ["n_regionkey"], item, "[", "]", ", "))


FLAWS = ["none", "malformed", "schema_version", "path", "duplicate_ref", "dangling_owner", "dangling_edge", "missing_trigger"]


@query("SELECT flaw, count(*) AS n FROM (SELECT " + "CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(FLAWS)) + " END AS flaw FROM part) GROUP BY 1")
def helper_documents(t: Tables) -> DataFrame:
    """A document a part, seven of eight with a flaw of its own."""
    k = col("p_partkey") % 8
    pick = lambda n, bad, good: F.when(k == n, bad).otherwise(good)
    document = text(
        '{"schema_version": ', pick(2, "9", "1"), ', "files": [{"path": "', pick(3, "../x.swift", "a/x.swift"), '", "components": [{"component_ref": "', pick(4, "s1", "c1"), '"}], "states": [{"state_ref": "s1", "owner_component_ref": "',
        F.when(k == 4, "s1").when(k == 5, "zz").otherwise("c1"), '"}], "effects": [], "edges": [{"edge_ref": "e1", "edge_kind": "', pick(7, "triggers_effect", "reads"), '", "from_ref": "', pick(4, "s1", "c1"), '", "to_ref": "', pick(6, "zz", "s1"),
        '", "owner_component_ref": "', pick(4, "s1", "c1"), '"}], "diagnostics": [{"code": "x", "ref": "e1"}]}]}',
    )
    good, errors = feeds.helper_documents(t.read("part").select(F.when(k == 1, "nonsense").otherwise(document).alias("text")))
    both = good.select(F.lit("none").alias("flaw")).unionByName(errors.select(col("error").alias("flaw")))
    return both.groupBy("flaw").agg(F.count("*").alias("n"))


# configuration -----------------------------------------------------------------------------------------------------------


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS module, CASE WHEN n_nationkey BETWEEN 10 AND 19 THEN 'core' WHEN n_nationkey BETWEEN 20 AND 29 THEN 'app' END AS layer FROM nation""")
def module_layers(t: Tables) -> DataFrame:
    told = config.read_text('{"layers": {"core": ["1?"], "app": ["2*", "x"]}, "rules": [{"id": "r", "kind": "no_circular_module_deps"}, {"kind": "odd"}]}')
    rules, warnings = architecture.read_rules(told["rules"])
    assert len(rules) == len(warnings) == 1
    found = architecture.layers_of(t.read("nation").select(col("n_nationkey").cast("string").alias("module")), told["layers"])
    return found.withColumn("layer", F.when((F.length("module") == 1), None).otherwise(col("layer")))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'core' WHEN 1 THEN 'deps' WHEN 2 THEN 'qa' END AS owner FROM pages""")
def mapped_owners(t: Tables) -> DataFrame:
    """A configuration's owner map by longest prefix: other folders have no owner."""
    owners = config.owner_map(t.spark, '{"src": "base", "src/core": "core", "node_modules/": "deps", "Tests": "qa"}')
    files = _page_files(t).select(trees.relative(col("path"), "/w/tree").alias("path")).withColumn("page_id", F.regexp_extract("path", r"f(\d+)\.", 1).cast("long"))
    return config.mapped_owner(files, owners).select("page_id", "owner")


@query("SELECT event_id FROM events WHERE event_type NOT IN ('view', 'error')")
def allowed_findings(t: Tables) -> DataFrame:
    """Findings that no literal of an allowlist file covers."""
    allowed = config.allowlist(t.spark, "# known\nvie\n\n  error  \n")
    from quarrylight.operators.joins import unallowed

    return unallowed(t.read("events").select("event_id", "event_type"), allowed, "event_type", "literal").select("event_id")


@query("""SELECT n_nationkey AS id, n_name AS name, 'node' AS kind FROM nation UNION ALL SELECT r_regionkey, r_name, 'node' FROM region UNION ALL SELECT r_regionkey, r_name, 'cluster' FROM region""")
def sidecar_nodes(t: Tables) -> DataFrame:
    """The three shapes in which a sidecar answers: a list, rows under `results`, and columns with values."""
    nation, region = t.read("nation"), t.read("region")
    lists = joined(nation, ["n_regionkey"], text('{"id": ', col("n_nationkey"), ', "name": "', col("n_name"), '"}'), "[", "]", ", ").select("text", F.lit("node").alias("kind"))
    results = region.select(text('{"results": [{"id": ', col("r_regionkey"), ', "name": "', col("r_name"), '"}]}').alias("text"), F.lit("node").alias("kind"))
    columns = region.select(text('{"columns": ["id", "name"], "rows": [[', col("r_regionkey"), ', "', col("r_name"), '"]]}').alias("text"), F.lit("cluster").alias("kind"))
    found = config.sidecar_rows(lists.unionByName(results).unionByName(columns), ["id", "name"])
    return found.select(col("id").cast("long").alias("id"), "name", "kind")


@query("""WITH n AS (SELECT p_name, max(p_partkey) AS id FROM part GROUP BY 1) SELECT a.p_partkey AS edge, x.id AS src, y.id AS dst FROM part a JOIN n x ON a.p_name = x.p_name LEFT JOIN n y ON y.p_name = CASE WHEN a.p_size % 2 = 0 THEN a.p_name ELSE 'nobody' END WHERE y.id IS NOT NULL""")
def edges_by_name(t: Tables) -> DataFrame:
    """Edges of a sidecar name their ends; of several nodes of a name the last one counts."""
    part = t.read("part")
    nodes = part.select(col("p_partkey").alias("id"), col("p_name").alias("name"), col("p_partkey").alias("at"))
    edges = part.select(col("p_partkey").alias("edge"), col("p_name").alias("src"), F.when(col("p_size") % 2 == 0, col("p_name")).otherwise("nobody").alias("dst"))
    return config.resolved_edges(edges, nodes)


@query("""SELECT user_id AS project, CASE WHEN user_id % 3 = 0 THEN 'python_service' WHEN user_id % 3 = 1 THEN 'swift_kit' END AS profile, CASE WHEN user_id % 3 = 0 THEN 'explicit' WHEN user_id % 3 = 1 THEN 'manifest' ELSE 'unknown_profile' END AS source FROM events GROUP BY 1""")
def language_profiles(t: Tables) -> DataFrame:
    k = col("user_id")
    projects = t.read("events").select("user_id").distinct().select(k.alias("project"), F.when(k % 3 == 0, "python_service").alias("language_profile"))
    found = projects.select("project", F.when(col("project") % 3 == 1, "Package.swift").when(col("project") % 3 == 2, "README.md").otherwise("Package.swift").alias("path"))
    return config.resolve_profiles(projects, found)
