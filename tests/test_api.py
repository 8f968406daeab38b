"""The tool surface over small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarrylight.api import Engine, UnknownTable

NOW = dt.datetime(2026, 1, 10)


@pytest.fixture(scope="module")
def engine(spark):
    t = lambda rows, shape: spark.createDataFrame(rows, shape)
    return Engine(
        {
            "hotspots": t([("p", "a", 3.0), ("p", "b", 5.0), ("q", "c", 9.0)], "project string, path string, hotspot_score double"),
            "owned_by": t([("p", "a", "x", 0.7), ("p", "a", "y", 0.3)], "project string, path string, author string, weight double"),
            "functions": t([("p", "a", "f", 1, 5), ("p", "a", "g", 9, 8)], "project string, path string, name string, start_line int, ccn int"),
            "occurrences": t([("p", "s1"), ("p", "s1"), ("p", "s2")], "project string, symbol string"),
            "evicted": t([("p", "s1")], "project string, symbol string"),
            "runs": t([("p", "e", "r1", NOW - dt.timedelta(days=1), True)], "project string, extractor string, run_id string, started_at timestamp, success boolean"),
            "projects": t([("p", "p", "python"), ("q", "q", "swift")], "slug string, project string, language string"),
            "bundle_members": t([("b", "p"), ("b", "q")], "bundle string, slug string"),
            "calls": t([("p", "t.a", "m.f"), ("p", "t.b", "m.g"), ("p", "m.g", "m.f")], "project string, src string, dst string"),
            "tests": t([("p", "t.a"), ("p", "t.b")], "project string, name string"),
            "source_files": t([("p", "a.py", "x = 1\ny = 2"), ("p", "b.py", "x = 3")], "project string, path string, text string"),
            "decisions": t([("p", f"t{k}", "b", NOW - dt.timedelta(days=k)) for k in range(5)], "project string, title string, body string, at timestamp"),
            "decision_records": t([("p-1", "active", "STACK", "we use spark"), ("p-2", "superseded", "STACK", "we use spark")], "slug string, status string, section string, body string"),
            "findings": t([("p", "s", 1, "low", "m1"), ("p", "s", 2, "critical", "m2")], "project string, section string, position int, severity string, message string"),
            "extractors": t([("e",), ("f",)], "extractor string"),
            "dependencies": t([("p", "pkg:pypi/a@1.0", "pypi", "1.0", "p"), ("q", "pkg:pypi/a@2.0", "pypi", "2.0", "q")], "slug string, purl string, ecosystem string, version string, scope_id string"),
            "commits": t([("p", "s1", NOW, "x@y"), ("p", "s2", NOW - dt.timedelta(days=9), "z@y")], "project string, sha string, committed_at timestamp, email string"),
        },
        NOW,
    )


def test_code(engine):
    assert [r["path"] for r in engine.find_hotspots("p", 1).collect()] == ["b"]
    assert [r["name"] for r in engine.list_functions("p", "a", 6).collect()] == ["g"]
    assert [(r["author"], r["total_authors"]) for r in engine.find_owners("p", "a", 1).collect()] == [("x", 2)]
    found = {r["symbol"]: (r["references"], r["state"], r["coverage_pct"]) for r in engine.find_references(["s1", "s2", "s3"], "p").collect()}
    assert found == {"s1": (2, "partial", 66), "s2": (1, "ok", 100), "s3": (0, "ok", 100)}
    assert engine.find_version_skew().first()["severity"] == "major" and engine.find_version_skew(["p"]).count() == 0
    assert [(r["path"], r["line"]) for r in engine.search_code("p", r"^x = \d").collect()] == [("a.py", 1), ("b.py", 1)]
    with pytest.raises(UnknownTable):
        engine.find_public_api("p")


def test_views_of_the_session_stay(spark, engine):
    spark.range(7).createOrReplaceTempView("hotspots")
    assert engine.query("select count(*) as n from hotspots").first()["n"] == 3
    assert spark.table("hotspots").count() == 7
    spark.catalog.dropTempView("hotspots")
    engine.query("select 1 as one from commits").collect()
    assert not spark.catalog.tableExists("commits") and not spark.catalog.tableExists("hotspots")


def test_tools_over_texts(spark):
    t = lambda rows, shape: spark.createDataFrame(rows, shape)
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1,2 @@\n-old\n+new\n+++ more\ndiff --git a/y b/y\n--- a/y\n+++ b/y\n@@ -1 +0,0 @@\n-gone"
    tools = Engine(
        {
            "diff_texts": t([("p", "s", diff)], "project string, sha string, text string"),
            "tree_texts": t([("p", "100644 blob " + "a" * 40 + "\tx.py\n")], "project string, text string"),
            "source_files": t([("p", "x.py", "1\n2\n3\n4")], "project string, path string, text string"),
            "manifests": t([("p", 1, "a", "h1"), ("p", 2, "a", "h2"), ("p", 2, "b", "h1"), ("p", 0, "z", "h")], "project string, at int, path string, blob string"),
            "imports": t([("p", "a", "b"), ("p", "a", "c"), ("p", "c", "b")], "project string, src string, dst string"),
            "projects": t([("old", "swift")], "slug string, language string"),
            "bundle_members": t([("x", "old")], "bundle string, slug string"),
            "extractors": t([("e",), ("f",)], "extractor string"),
            "runs": t([("p", "e", NOW)], "project string, extractor string, started_at timestamp"),
            "decision_texts": t([("d", "# D\n## STACK\nold")], "slug string, text string"),
            "decision_documents": t([("d1", "t", "active", "body")], "slug string, title string, status string, body string"),
        }
    )
    assert [tuple(r) for r in tools.git_show("p", "s").select("path", "hunks", "added", "deleted").collect()] == [("x.py", 1, 2, 1), ("y", 1, 0, 1)]
    lines, more = tools.git_diff("p", "s")
    assert lines.count() == 12 and not more and tools.git_ls_tree("p")[0].first()["path"] == "x.py"
    assert [r["content"] for r in tools.get_code_snippet("p", "x.py", 2, 3).collect()] == ["2", "3"]
    assert [tuple(r) for r in tools.detect_changes("p").collect()] == [("a", "dirty"), ("b", "dirty")]
    assert [tuple(r) for r in tools.get_architecture("p").collect()] == [("a", 2, 0), ("b", 0, 2), ("c", 1, 1)]
    assert tools.register_project(t([("new", "kotlin")], "slug string, language string")).count() == 2
    with pytest.raises(ValueError, match="no slug"):
        tools.register_project(t([("Bad Slug", "x")], "slug string, language string"))
    members, errors = tools.add_to_bundle(t([("x", "old"), ("y", "old"), ("y", "lost")], "bundle string, slug string"))
    assert members.count() == 2 and errors.count() == 2
    with pytest.raises(ValueError, match="has members"):
        tools.delete_bundle("x")
    assert tools.delete_bundle("x", cascade=True).count() == 0
    assert [(r["extractor"], r["last_run_at"]) for r in tools.list_extractors().collect()] == [("e", NOW), ("f", None)]
    assert {r["label"]: r["n"] for r in tools.project_overview("p").collect()}["manifests"] == 4
    shape = "title string, body string, slice_ref string, maker string, confidence double"
    good, bad = tools.decide(t([("t", "b", "GIM-1", "cto", 0.5), ("t", "b", "no", "cto", None)], shape), ["cto"])
    assert good.count() == 1 and bad.first()["error"] == "slice_ref"
    assert tools.splice_decision("STACK", "new").first()["text"] == "# D\n## STACK\nnew"
    found = {r["slug"]: (r["status"], r["body"]) for r in tools.supersede_decision(t([("d1", "d2", "r")], "old string, new string, reason string")).collect()}
    assert found == {"d1": ("superseded", "**SUPERSEDED by d2**\n\nbody"), "d2": ("active", "")}


def test_impact(engine):
    found, more = engine.test_impact("f", "p")
    assert [(r["node"], r["hop"]) for r in found.collect()] == [("t.a", 1), ("t.b", 2)] and not more
    with pytest.raises(LookupError, match="not_found"):
        engine.test_impact("zzz", "p")


def test_memory_and_audit(engine):
    rows, total, warnings = engine.lookup("commits", {"project": "p", "odd": 1}, "committed_at", 1)
    assert [r["sha"] for r in rows.collect()] == ["s1"] and total == 2 and len(warnings) == 1
    log, more = engine.git_log("p", since=NOW - dt.timedelta(days=2))
    assert log.count() == 1 and not more
    assert engine.bundle_status("b").first()["fresh"] == 1 and engine.bundle_status("b").first()["never"] == 1
    assert engine.search_decisions("spark").count() == 1 and engine.prime("p", "cto").count("## ") == 3
    assert "**critical** m2" in engine.audit("p").split("\n")[4]
    assert engine.query("select count(*) as n from hotspots").first()["n"] == 3
    kinds = {(r["kind"], r["name"]): r["value"] for r in engine.health().collect()}
    assert kinds["rows", "tests"] == 2 and kinds["never_run", "q"] == 0 and kinds["last_run", "e"] == 1
    profile = engine.tables["extractors"].select(F.lit("python").alias("language"), "extractor")
    found = {(r["project"], r["extractor"]): r["status"] for r in engine.audit_status(profile).collect()}
    assert found == {("p", "e"): "OK", ("p", "f"): "NOT_ATTEMPTED", ("q", "e"): "NOT_APPLICABLE", ("q", "f"): "NOT_APPLICABLE"}
