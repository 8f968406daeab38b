"""Column functions on small tables, against plain values."""

import math

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import clock, ids, paths, scoring


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(column).collect()]


def test_bots(spark):
    rows = [("a@dependabot.com", "x"), ("a@b.c", "Dependabot[bot]"), ("a@b.c", "Ann"), (None, None), ("1+renovate[bot]@users.noreply.github.com", "r"), ("a@b.c", "my-bot")]
    assert values(spark, rows, "email string, name string", paths.is_bot(F.col("email"), F.col("name"))) == [True, True, False, False, True, False]
    assert values(spark, rows, "email string, name string", paths.is_bot(F.col("email"), F.col("name"), ["my-bot$"]))[-1]


@pytest.mark.parametrize("pattern", ["*.py", "src/**", "a?c", "[!x]*", "*", "m[0-9]", "a.b", "(x)"])
def test_globs_match_like_file_globs(spark, pattern):
    names = ["a.py", "src/a/b.py", "abc", "xyz", "m7", "a.b", "aXb", "(x)", "", "a\nb"]
    assert values(spark, names, "n string", paths.matches_glob(F.col("n"), pattern)) == [paths.glob_matches(n, pattern) for n in names]


def test_source_contexts(spark):
    names = ["Example/App.swift", "Tests/FooTests.swift", "src/main.py", "README.md", "lib\\x.py", "iOS Example/Sources/a.swift", "pkg/foo_test.py"]
    assert values(spark, names, "p string", paths.source_context(F.col("p"))) == ["example", "test", "library", "other", "library", "example", "test"]
    assert values(spark, names[:1], "p string", paths.source_context(F.col("p"), {"Example/*": "library"})) == ["library"]


def test_languages_modules_and_names(spark):
    assert values(spark, ["a.py", "b.kt", "c", "d.SOL"], "p string", paths.language_of(F.col("p"))) == ["python", "kotlin", "unknown", "solidity"]
    assert values(spark, ["Sources/Core/a.swift", "app/src/x/a.kt", "top/a.kt", "a.kt"], "p string", paths.module_of(F.col("p"))) == ["Core", "x", "top", "root"]
    assert values(spark, ["fooBar", "foo_bar", "FooBar", "FOO_BAR", "x-y"], "n string", paths.naming_choice(F.col("n"))) == ["camel", "snake", "pascal", "upper", "other"]


def test_identifiers(spark):
    found = values(spark, ["foo", None, "föö"], "n string", ids.symbol_id("n"))
    import hashlib

    own = lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big", signed=True)
    assert found == [own("foo"), None, own("föö")]
    assert values(spark, ["a"], "n string", ids.stable_id(F.col("n"), F.lit("b"))) == [hashlib.blake2b(b"a||b", digest_size=16).hexdigest()]
    keys = ["-5:src/a:b.py:3:4:run", "5:x:1:2:", "bad"]
    assert [tuple(r) if r else None for r in values(spark, keys, "k string", ids.parse_doc_key(F.col("k")))] == [(-5, "src/a:b.py", 3, 4, "run"), (5, "x", 1, 2, ""), None]
    assert values(spark, ["scip-python python pkg 1.0 mod/`a b`.f()", "local 1 2 3 4"], "s string", ids.qualified_name("s"))[0] == "pkg mod/`a b`.f()"
    assert values(spark, [1, 3, 64, 4, 8, 0], "r int", ids.occurrence_kind(F.col("r"))) == ["def", "def", "decl", "assign", "use", "use"]


def test_packages_and_versions(spark):
    assert values(spark, ["pkg:pypi/a@1.0", "pkg:github/x/y", "pkg:npm/@s/p@2"], "p string", ids.purl_root(F.col("p"))) == ["pkg:pypi/a", "pkg:github/x/y", "pkg:npm/@s/p"]
    assert values(spark, ["Foo_Bar.baz"], "n string", ids.purl(F.lit("pypi"), F.col("n"), F.lit("1"))) == ["pkg:pypi/foo-bar-baz@1"]
    assert values(spark, ["1.2.3", "v2", "1.0rc1", "main", None], "v string", ids.version_part(F.col("v"), 1)) == [2, 0, 0, None, None]
    pairs = [("1.2.3", "1.2.4"), ("1.2.3", "1.3.0"), ("1.0", "2.0"), ("1.0", "main"), ("1.0", "1.0.0"), (None, "1")]
    assert values(spark, pairs, "a string, b string", ids.version_difference(F.col("a"), F.col("b"))) == ["patch", "minor", "major", "unknown", "patch", "unknown"]


def test_scores(spark):
    assert values(spark, [(9, 4)], "c int, n int", scoring.hotspot_score(F.col("c"), F.col("n"))) == pytest.approx([math.log(10) * math.log(5)])
    assert values(spark, [5.0, 3.0, 1.5, 0.1, 0.0], "s double", scoring.hotspot_severity(F.col("s"))) == ["critical", "high", "medium", "low", "informational"]
    assert values(spark, [30.0, 0.0], "d double", scoring.half_life_decay(F.col("d"))) == pytest.approx([0.5, 1.0])
    assert values(spark, [(3, 1), (0, 0), (0, 4), (1, 2)], "n int, e int", scoring.coverage_pct(F.col("n"), F.col("e"))) == [75, 100, 0, 33]
    assert values(spark, [11, 4, 1, 0], "n int", scoring.removed_severity(F.col("n"))) == ["high", "medium", "low", "informational"]


def test_retuned_severities(spark):
    rows = [("try_optional_swallow", "src/auth/a.swift", "library", "high"), ("try_optional_swallow", "src/ui/a.swift", "library", "high"), ("try_optional_swallow", "Tests/auth.swift", "test", "high"), ("empty_catch", "src/auth/a", "library", "high"), ("try_optional_swallow", "src/auth", "library", "informational")]
    found = values(spark, rows, "kind string, path string, context string, severity string", scoring.critical_path_severity(*map(F.col, ("severity", "kind", "path", "context"))))
    assert found == ["medium", "low", "low", "high", "informational"]
    assert values(spark, ["src/Wallet.kt", "src/ui.kt"], "p string", scoring.untestable_severity(F.col("p"))) == ["high", "medium"]
    edges = [("reads", "resolved", None), ("triggers_effect", "resolved", None), ("triggers_effect", "resolved", "closure"), ("reads", "ambiguous", None)]
    assert values(spark, edges, "k string, r string, t string", scoring.edge_confidence(*map(F.col, "krt"), partly=("ambiguous",))) == ["high", "medium", "high", "medium"]


def test_times(spark):
    assert values(spark, ["05:03", "1:02:03", "2-03:04:05", "0:01.50", "x", None], "t string", clock.elapsed_seconds(F.col("t"))) == [303, 3723, 183845, 1, None, None]
    assert values(spark, ["0:01.50", "0:01.49", "1:00"], "t string", clock.cpu_seconds(F.col("t"))) == [2, 1, 60]
    assert values(spark, ["a\n/home/u/x  b"], "m string", paths.redacted(F.col("m"), "/home/u")) == ["a ~/x  b"]
