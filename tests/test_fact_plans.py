"""How facts of lines are planned, and lines that are odd."""

import re

import pytest
from pyspark.sql import functions as F

from quarrylight.sources import facts, trees
from quarrylight.sources.lexed import TOKEN


@pytest.mark.parametrize("of", [facts.line_facts, lambda files: facts.signals(facts.line_facts(files))], ids=["facts", "signals"])
def test_conditions_are_compiled_once(spark, of):
    """A generator interprets what it is given, and a filter inferred from it evaluates that twice."""
    files = spark.createDataFrame([("a.swift", "swift", "class A {}")], "path string, language string, text string")
    plan = of(files)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum(line.count("RLIKE") for line in plan) < 60
    assert not [line for line in plan if re.match(r"\W*(Generate|Filter)\b", line) and ("RLIKE" in line or "_said" in line)]


def test_tokens_of_odd_lines(spark):
    lines = ["", "  ", 'let a = "x  \\" y" + b', 'open " quote', "a b c\u0085d", "\x0b\f\t e", "é?? -> \U0001f600\x001a", '""', "func f() throws {"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    kept = F.filter(F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0)), lambda t: ~t.rlike(r"^\s"))
    emptied = F.transform(kept, lambda t: F.when(t.startswith('"') & (F.length(t) > 1), '""').otherwise(t))
    want = F.concat(F.lit(" "), F.array_join(emptied, " "), F.lit(" "))
    assert not rows.where(facts.read_line(F.col("line")) != want).collect()


def test_facts_of_odd_lines(spark):
    text = "public lazy var x = f()\nlazy open class A\x00B\n\nfinal class C: D { let a = x.resolve(B.self) }\nclass\nvar"
    files = spark.createDataFrame([("a", "swift", text), ("b", "kotlin", text), ("c", "go", text), ("d", "swift", None)], "path string, language string, text string")
    found = sorted((r["path"], r["line"], r["fact"], r["name"]) for r in facts.line_facts(files).collect())
    want = [("a", 2, "type", "A"), ("a", 4, "service_locator", "x.resolve("), ("a", 4, "subclass", "C"), ("a", 4, "type", "C")]
    assert found == want


def test_imports_need_no_join_of_their_own_rows(spark):
    text = "import a.b.c\nimport a.x\nfrom two import y\nimport none\nimport nothing"
    files = spark.createDataFrame([("f", "kotlin", text), ("g", "kotlin", None)], "path string, language string, text string")
    modules = spark.createDataFrame([("m", "a"), ("n", "a.b"), ("p", "two"), ("q", "two"), (None, "none")], "module string, name string")
    found = trees.imports(files, modules, 3)
    assert sorted(tuple(r) for r in found.collect()) == [("f", 1, "n", "ok"), ("f", 2, "m", "ok"), ("f", 3, "p", "ambiguous"), ("f", 4, None, "ok")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
