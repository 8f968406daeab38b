"""Operators on hand-made tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarrylight.plans import history
from quarrylight.operators import aggregates, graph, joins, ledger, lookup, upsert
from quarrylight.plans import audit


def out(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def day(k, hour=0):
    return dt.datetime(2026, 1, k, hour)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z")], "k int, v string")
    assert out(upsert.first_wins(old, new, ["k"], [F.col("v")])) == [(1, "a"), (2, "b"), (3, "y")]
    assert out(upsert.last_wins(old, new, ["k"], [F.col("v")])) == [(1, "a"), (2, "x"), (3, "z")]
    again = upsert.last_wins(upsert.last_wins(old, new, ["k"], [F.col("v")]), new, ["k"], [F.col("v")])
    assert out(again) == [(1, "a"), (2, "x"), (3, "z")]
    assert out(upsert.delete_keys(old, new, ["k"])) == [(1, "a")]
    assert out(upsert.replace_scope(old, new, ["k"])) == [(1, "a"), (2, "x"), (3, "y"), (3, "z")]


def test_sightings_widen(spark):
    old = spark.createDataFrame([("a", day(2), day(3), "e", False)], "k string, first_seen timestamp, last_seen timestamp, email string, bot boolean")
    new = spark.createDataFrame([("a", day(1), None, True), ("a", day(5), "f", True), ("b", day(4), None, False)], "k string, at timestamp, email string, bot boolean")
    assert out(upsert.widen(old, new, ["k"], "at", ["email"], ["bot"])) == [("a", day(1), day(5), "e", True), ("b", day(4), day(4), None, False)]


def test_stale_rows(spark):
    rows = spark.createDataFrame([("a", day(1), 5), ("b", day(1), 6), ("c", day(9), 7)], "p string, seen timestamp, ccn int")
    kept = spark.createDataFrame([("a",)], "p string")
    assert out(upsert.evict_stale(rows, kept, "p", "seen", F.lit(day(2))).select("p")) == [("a",), ("c",)]
    assert out(upsert.mark_stale(rows, kept, "p", "seen", F.lit(day(2)), {"ccn": F.lit(0)}).select("p", "ccn")) == [("a", 5), ("b", 0), ("c", 7)]
    edges = spark.createDataFrame([("cm:1", None), ("cm:2", day(1)), ("x:1", None)], "id string, invalid_at timestamp")
    assert out(upsert.invalidate(edges, "id", ["cm:"], F.lit(day(3)))) == [("cm:1", day(3)), ("cm:2", day(1)), ("x:1", None)]


def test_prefixes(spark):
    files = spark.createDataFrame([("a/b/c.py",), ("a/x.py",), ("ab/c.py",), ("z.py",)], "path string")
    roots = spark.createDataFrame([("a", "A"), ("a/b", "B")], "root string, module string")
    assert out(joins.longest_prefix(files, roots, "path", "root", "module").select("path", "module")) == [("a/b/c.py", "B"), ("a/x.py", "A"), ("ab/c.py", None), ("z.py", None)]
    found = out(joins.owner_by_prefix(files, roots, "path", "root", "module").select("path", "module", "status"))
    assert found == [("a/b/c.py", None, "ambiguous"), ("a/x.py", "A", "resolved"), ("ab/c.py", None, "unresolved"), ("z.py", None, "unresolved")]


def test_two_resolutions(spark):
    shape = "path string, module string, status string"
    a = spark.createDataFrame([("1", "A", "resolved"), ("2", "A", "resolved"), ("3", None, "ambiguous"), ("4", None, "unresolved"), ("5", None, "unresolved")], shape)
    b = spark.createDataFrame([("1", "A", "resolved"), ("2", "B", "resolved"), ("3", "A", "resolved"), ("4", "B", "resolved"), ("6", "C", "resolved")], shape)
    assert out(joins.reconciled_owner(a, b, "path", "module")) == [("1", "A", "resolved"), ("2", None, "ambiguous"), ("3", None, "ambiguous"), ("4", "B", "resolved"), ("5", None, "unresolved"), ("6", "C", "resolved")]


def test_lookups(spark):
    known = spark.createDataFrame([("a.b.run",), ("c.run",), ("c.stop",)], "name string")
    asked = spark.createDataFrame([("b.run",), ("run",), ("stop",), ("gone",)], "name string")
    assert out(joins.suffix_lookup(asked, known, "name").select("name", "status", "match"), "name") == [("b.run", "ok", "a.b.run"), ("gone", "not_found", None), ("run", "ambiguous", None), ("stop", "ok", "c.stop")]
    table = spark.createDataFrame([("k", 1), ("m", 2), ("m", 3)], "key string, v int")
    rows = spark.createDataFrame([("k",), ("m",), ("n",)], "key string")
    assert out(joins.ambiguous_lookup(rows, table, ["key"], "v").select("key", "status", "v")) == [("k", "ok", 1), ("m", "ambiguous", None), ("n", "missing", None)]
    tried = spark.createDataFrame([(1, ["z", "m", "k"]), (2, ["z"])], "id int, keys array<string>")
    assert out(joins.first_key_wins(tried, "keys", table, "key", "v", "id").select("id", "v")) == [(1, 2), (2, None)]


def test_intervals_and_times(spark):
    a = spark.createDataFrame([("f", 1, 10), ("f", 50, 60), ("g", 5, 5)], "path string, start int, end int")
    b = spark.createDataFrame([("f", 10, 12), ("f", 0, 100), ("g", 6, 7)], "path string, start int, end int")
    assert out(joins.overlap(a, b, ["path"], "start", "end", 8).select("path", "start", "end", "start_r", "end_r")) == [("f", 1, 10, 0, 100), ("f", 1, 10, 10, 12), ("f", 50, 60, 0, 100)]
    left = spark.createDataFrame([("k", 1), ("k", 5), ("m", 2)], "k string, t int")
    right = spark.createDataFrame([("k", 2, "x"), ("k", 5, "y"), ("m", 3, "z")], "k string, t int, v string")
    assert out(joins.as_of(left, right, ["k"], "t", "v")) == [("k", 1, None), ("k", 5, "y"), ("m", 2, None)]


def test_differences(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "w")], "k int, v string")
    assert out(joins.snapshot_diff(a, b, ["k"], ["v"]).select("k", "change")) == [(1, "same"), (2, "changed"), (3, "removed"), (4, "added")]
    assert out(joins.changed_rows(a, b, "k", "v")) == [(2, "y"), (4, "w")]
    assert out(joins.set_differences(a, b, ["k"])) == [(3, "unused"), (4, "undeclared")]
    allowed = spark.createDataFrame([("ok",), ("",)], "l string")
    texts = spark.createDataFrame([("it is ok",), ("no",), (None,)], "t string")
    assert out(joins.unallowed(texts, allowed, "t", "l"), F.col("t").asc_nulls_first()) == [(None,), ("no",)]


def test_aggregates(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "p"), ("b", "q")], "k string, c string")
    assert out(aggregates.mode(rows, ["k"], "c")) == [("a", "y", 2, 3, 1), ("b", "q", 1, 2, 1)]
    found = spark.createDataFrame([("f", 1, "low", "m1"), ("f", 1, "high", "m2"), ("g", 2, "low", "m3")], "path string, line int, severity string, message string")
    assert out(aggregates.keep_worst(found, ["path", "line"], F.when(F.col("severity") == "high", 0).otherwise(1))) == [("f", 1, "high", "m2"), ("g", 2, "low", "m3")]
    assert aggregates.hash_statistics(spark.createDataFrame([(1,), (1,), (-3,)], "i long"), "i").first().asDict() == {"total": 3, "distinct_ids": 2, "negative": 1, "collisions": 1, "share_negative": pytest.approx(1 / 3)}
    hits = spark.range(130).select((F.col("id") % 65).alias("k")).unionByName(spark.range(60).select(F.col("id").alias("k")))
    assert aggregates.heavy_hitters(hits, "k", 50).count() == 60 and aggregates.heavy_hitters(hits, "k", 60).count() == 65


def test_filters_and_pages(spark):
    rows = spark.createDataFrame([("a", 1, ["x"]), ("b", 2, ["y", "z"]), ("c", None, [])], "name string, n int, tags array<string>")
    known = {"name": lookup.equals("name"), "least": lookup.at_least("n", 0), "tags": lookup.any_tag("tags"), "prefix": lookup.starts_with("name")}
    found, warnings = lookup.apply_filters(rows, known, {"least": 1, "tags": ["z", "x"], "name": None, "odd": 3})
    assert out(found.select("name")) == [("a",), ("b",)] and len(warnings) == 1
    page, more = lookup.truncated(rows.orderBy("name"), 2)
    assert page.count() == 2 and more
    assert out(lookup.latest(rows, [], [F.desc("n")]).select("name")) == [("b",)]


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1)], "src int, dst int")
    for small in (0, 3, 20_000):  # rounds of joins to the end, some, or none
        assert out(graph.strong_components(edges, small=small)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert out(graph.trace(edges, spark.createDataFrame([(7,)], "node int"), 3)) == [(1, 1), (2, 2), (3, 3)]
    assert graph.reachability(edges).where("src = 7").count() == 5
    assert graph.strong_components(edges.where("src = 7")).count() == 0


def test_components_leave_no_checkpoints(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph, "cut", lambda df: (_ for _ in ()).throw(AssertionError("a checkpoint of every round")), raising=False)
    pairs = [(10 * k + n, 10 * k + (n + 1) % 4) for k in range(4) for n in range(4)] + [(10 * k, 10 * k + 10) for k in range(3)] + [(30, -1), (-2, 0), (35, 10)]
    pairs += [(10, 35), (35, 35), (10, 35)]
    edges = spark.createDataFrame(pairs, "src long, dst long").repartition(3)
    whole = sorted((10 * k + n, 10 * k) for k in range(4) for n in range(4))
    whole = sorted([*whole, (35, 10)])
    for chunk, small in ((100_000, 20_000), (1, 0), (7, 20_000)):  # one chunk, none of use, some that cut rings
        assert out(graph.strong_components(edges, small=small, chunk=chunk)) == whole
    named = edges.select(*(F.col(c).cast("string").alias(c) for c in ("src", "dst")))
    assert graph.strong_components(named, chunk=7).count() == len(whole)


def test_ledgers(spark):
    log = spark.createDataFrame([("r", "start", day(1), "p", "x", None, None, None, None), ("r", "end", day(1, 1), "p", "x", True, None, 5, 6), ("s", "start", day(2), "p", "x", None, None, None, None)], "run_id string, event string, at timestamp, project string, extractor string, success boolean, error_code string, nodes long, edges long")
    assert out(ledger.runs(log).select("run_id", "success", "nodes", "duration_ms")) == [("r", True, 5, 3_600_000), ("s", None, None, None)]
    projects = spark.createDataFrame([("a", "A", "py"), ("b", "B", None)], "slug string, name string, language_profile string")
    new = spark.createDataFrame([("a", "A2", None), ("c", "C", "go")], "slug string, name string, language_profile string")
    assert out(ledger.merge_projects(projects, new)) == [("a", "A2", "py"), ("b", "B", None), ("c", "C", "go")]
    members = spark.createDataFrame([("m", "a", "core")], "bundle string, slug string, tier string")
    asked = spark.createDataFrame([("m", "a", "core"), ("m", "b", "x"), ("m", "z", "x")], "bundle string, slug string, tier string")
    after, errors = ledger.add_members(members, asked, projects)
    assert out(after) == [("m", "a", "core"), ("m", "b", "x")] and out(errors) == [("m", "a", "already_member"), ("m", "z", "project_not_registered")]
    with pytest.raises(ValueError):
        ledger.delete_bundle(members, "m")
    assert ledger.delete_bundle(members, "m", cascade=True).count() == 0
    assert out(ledger.slug_kind(spark.createDataFrame([("m",), ("a",), ("q",)], "slug string"), members, projects)) == [("a", "project"), ("m", "bundle"), ("q", "unknown")]
    assert out(ledger.resolve_groups("*", projects, "d")) == [("project/a",), ("project/b",)] and out(ledger.resolve_groups(None, projects, "d")) == [("d",)]
    with pytest.raises(LookupError):
        ledger.resolve_groups(["a", "nope"], projects, "d")
    with pytest.raises(ledger.SchemaDrift, match="name"):
        ledger.check_schema(projects, "slug string, name int")
    assert ledger.check_schema(projects, "slug string") is projects
    marks = spark.createDataFrame([("r", "p1", 2, day(1)), ("r", "p1", 3, day(2)), ("r", "p2", 1, day(1))], "run_id string, phase string, count long, at timestamp")
    counted = spark.createDataFrame([("r", "p1")] * 3, "run_id string, phase string")
    assert out(ledger.reconcile(marks, counted)) == [("r", "p1", 3, 3, True), ("r", "p2", 1, 0, False)]


def test_decisions_and_envelopes(spark):
    rows = spark.createDataFrame([("t", "b", "S-1", "cto", 0.5), ("", "b", "S-1", "cto", None), ("t", "b", "x", "cto", None), ("t", "b", "S-2", "me", None), ("t", "b", "S-2", "cto", 2.0), (None, "b", "S-1", "cto", None)], "title string, body string, slice_ref string, maker string, confidence double")
    good, errors = ledger.valid_decisions(rows, ["cto"], r"^S-\d+$")
    assert good.count() == 1 and sorted(r["error"] for r in errors.collect()) == ["confidence", "maker", "slice_ref", "title", "title"]
    env = spark.createDataFrame([(0.5, "asserted", day(1)), (2.0, "asserted", day(1)), (0.5, None, day(1))], "confidence double, provenance string, observed_at timestamp")
    assert ledger.envelope_errors(env).count() == 2
    vectors = ledger.embedded(spark.createDataFrame([("ab",), (None,)], "t string"), "t", lambda texts: [[float(len(x))] for x in texts])
    assert sorted(r["embedding"] for r in vectors.collect()) == [[0.0], [2.0]]


def test_audit_figures(spark):
    contexts = spark.createDataFrame([("x", "test")] * 11 + [("y", "test")] * 10 + [("y", "library")], "section string, context string")
    assert {r["section"]: r["no_library"] for r in audit.source_distribution(contexts).collect()} == {"x": True, "y": False}
    table = lambda rows, shape: spark.createDataFrame(rows, shape)
    found = audit.summaries(
        table([("a", 2.5)], "path string, hotspot_score double"), table([("skipped",), ("unused_candidate",)], "state string"), table([("test", "unresolved")], "scope string, version string"), table([("a", 0.1), ("b", None)], "path string, weight double"),
        table([("major",)], "severity string"), table([("m",)], "module string"), table([(1, 0), (0, 2)], "removed int, changed int"),
        table([("init", "a", "x"), (None, "a", "y"), ("lazy", None, None)], "style string, double string, site string"),
    )
    got = {(r["section"], r["statistic"]): r["value"] for r in found.collect()}
    assert got["hotspot", "max_score"] == 2.5 and got["dependencies", "missing_lockfile"] == 1 and got["ownership", "diffuse_ownership_count"] == 1 and got["contracts", "breaking"] == 1
    assert got["testability", "patterns"] == 2 and got["testability", "test_doubles"] == 1 and got["testability", "untestable_sites"] == 2


def test_ownership_deals_files_by_rows(spark):
    blame = spark.createDataFrame([("f", "a", 3), ("f", "b", 1)], "path string, author string, lines long")
    churned = spark.createDataFrame([("f", "a", 1.0, 2, day(1))], "path string, author string, recency_score double, commit_count long, last_touched_at timestamp")
    found = history.ownership(blame, churned, parts=37)
    assert ", 37)" in found._jdf.queryExecution().executedPlan().toString()
    assert out(found.select("author", "lines_attributed")) == [("a", 3), ("b", 1)]
