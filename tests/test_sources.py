"""Readers on small files and texts."""

import datetime as dt


import pytest

from quarrylight.operators import ledger
from quarrylight.sources import api_dumps, config, feeds, gitlog, manifests, reports, scip, trees


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def out(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


KOTLIN = """// Tool: kotlin-bcv 0.14
public final class com/acme/Wallet : com/acme/Base {
	public fun <init> (I)V
	public constructor (name: String)
	public final fun send (to: Address,  amount: Long): Boolean
	public final val balance: Long
	protected fun audit(): Unit
}

public abstract interface com/acme/Base {
	public abstract fun id(): Int
}
public final enum class com/acme/Kind {
}
"""
SWIFT = """// swift-compiler-version: Apple Swift version 5.9
import Foundation
public struct Wallet {
  public let name: Swift.String
  public var balance: Swift.Int { get }
  public init(name: Swift.String)
  public func send(to address: Address,   amount: Int) -> Bool
  public struct Key {
    public var raw: Data
  }
  public func close()
}
extension Wallet {
  public func reopen()
}
public func topLevel(x: Int)
public typealias Coins = Swift.Int
"""


def test_kotlin_dump(spark):
    found = out(api_dumps.kotlin_api(texts(spark, ("api/a.api", KOTLIN))), "fqn", "kind", "visibility", "line")
    assert found == sorted(
        [
            ("com.acme.Wallet", "class", "public", 2), ("com.acme.Wallet.<init>(I)", "function", "public", 3), ("com.acme.Wallet.init(name: String)", "initializer", "public", 4),
            ("com.acme.Wallet.send(to: Address, amount: Long)", "function", "public", 5), ("com.acme.Wallet.balance", "property", "public", 6), ("com.acme.Wallet.audit()", "function", "protected", 7),
            ("com.acme.Base", "interface", "public", 10), ("com.acme.Base.id()", "function", "public", 11), ("com.acme.Kind", "enum", "public", 13),
        ],
        key=repr,
    )


def test_swift_interface(spark):
    found = out(api_dumps.swift_api(texts(spark, ("a.swiftinterface", SWIFT))), "fqn", "kind")
    assert found == sorted(
        [
            ("Wallet", "struct"), ("Wallet.name", "property"), ("Wallet.balance", "property"), ("Wallet.init(name: Swift.String)", "initializer"), ("Wallet.send(to address: Address, amount: Int)", "function"),
            ("Key", "struct"), ("Key.raw", "property"), ("Wallet.close()", "function"), ("Wallet.extension", "extension"), ("Wallet.reopen()", "function"), ("topLevel(x: Int)", "function"), ("Coins", "typealias"),
        ],
        key=repr,
    )


def test_feeds(spark):
    ps = texts(spark, ("a", "  PID     ELAPSED     TIME COMMAND\n  42    01:02:03 00:00:01 tool --run x\nbad line\n"))
    assert out(feeds.process_list(ps)) == [(42, "01:02:03", "00:00:01", "tool --run x")]
    log = texts(spark, ("l", "2026-01-01T00:00:00Z\tmain_sha=abc\tok\nnoise\n2026-01-02T00:00:00Z\tx=1\tmain_sha=def"))
    assert [r[1] for r in out(feeds.deployment_log(log))] == ["abc", "def"]
    page = '[{"number": 1, "title": "t", "body": "b", "state": "OPEN", "author": {"login": "u"}, "createdAt": "2026-01-01T00:00:00Z", "updatedAt": "2026-01-03T00:00:00Z", "comments": [{"id": "c1", "author": null, "body": "hi", "createdAt": "2026-01-02T00:00:00Z"}]}, {"number": 2, "updatedAt": "2025-01-01T00:00:00Z"}]'
    pulls, comments = feeds.pull_requests(texts(spark, ("p", page)), "2026-01-01T00:00:00Z")
    assert out(pulls, "number", "author", "merged_at") == [(1, "u", None)] and out(comments, "comment_id", "number", "body") == [("c1", 1, "hi")]
    assert out(feeds.delta_requests(texts(spark, ("d", '[{"consumer": "a", "producer": "b", "from_commit": "x", "to_commit": "y"}, {"consumer": "a"}]')))) == [("a", "b", "x", "y")]


def helper(component="c1", owner="c1", end="s1", kind="reads", trigger="null", path="a.swift", version=1):
    return f"""{{"schema_version": {version}, "files": [{{"path": "{path}", "components": [{{"component_ref": "{component}"}}], "states": [{{"state_ref": "s1", "owner_component_ref": "{owner}"}}],
      "effects": [], "edges": [{{"edge_ref": "e1", "edge_kind": "{kind}", "from_ref": "c1", "to_ref": "{end}", "owner_component_ref": "c1", "trigger_expression_kind": {trigger}}}], "diagnostics": [{{"code": "x", "ref": "e1"}}]}}]}}"""


def test_helper_contract(spark):
    bodies = [helper(), helper(component="s1", owner="s1"), helper(owner="zz"), helper(end="zz"), helper(kind="triggers_effect"), helper(kind="triggers_effect", trigger='"closure"'), helper(path="../x"), helper(version=2), "nonsense", '{"schema_version": 1, "files": []}']
    good, errors = feeds.helper_documents(texts(spark, *((str(k), b) for k, b in enumerate(bodies))))
    assert good.count() == 2
    assert sorted(r["error"] for r in errors.collect()) == ["dangling_edge", "dangling_owner", "duplicate_ref", "malformed", "missing_trigger", "path", "schema_version"]


def test_git_output(spark):
    log = texts(spark, ("l", "aa\x00Ann\x00Ann@X.org\x002026-01-01T10:00:00+02:00\x00p1 p2\x00subject\x1e\nbb\x00dependabot[bot]\x00d@x\x002026-01-02T00:00:00Z\x00\x00s2\x1e\n"))
    found = gitlog.commits(log)
    assert out(found, "sha", "email", "is_merge", "is_bot", "subject") == [("aa", "ann@x.org", True, False, "subject"), ("bb", "d@x", False, True, "s2")]
    assert found.where("sha = 'aa'").first()["committed_at"] == dt.datetime(2026, 1, 1, 8)
    stat = texts(spark, ("n", "commit:" + "a" * 40 + "\n3\t1\tx.py\n-\t-\tb.png\ncommit:" + "b" * 40 + "\n1\t0\ty.py"))
    assert out(gitlog.numstat(stat)) == sorted([("a" * 40, "x.py", 3, 1), ("a" * 40, "b.png", None, None), ("b" * 40, "y.py", 1, 0)], key=repr)
    assert out(gitlog.ls_tree(texts(spark, ("t", "100644 blob " + "c" * 40 + "\tdir/a b.py\n")))) == [("100644", "blob", "c" * 40, "dir/a b.py")]
    entry = lambda sha, line: f"{sha} 1 {line} 1\nauthor Ann\nauthor-mail <Ann@x.org>\nauthor-time 1000\nsummary s\nfilename f\n\tcode {line}\n"
    assert out(gitlog.blame(texts(spark, ("f", entry("a" * 40, 1) + entry("b" * 40, 2)))), "path", "email", "lines") == [("f", "ann@x.org", 2)]
    commits = spark.createDataFrame([("a", dt.datetime(2026, 1, 1)), ("b", dt.datetime(2026, 1, 2))], "sha string, committed_at timestamp")
    assert out(gitlog.new_commits(spark, commits, (dt.datetime(2026, 1, 1), "a")), "sha") == [("b",)] and gitlog.new_commits(spark, commits, (dt.datetime(2026, 1, 1), "z")).count() == 2


def test_manifests(spark):
    project = texts(spark, ("pyproject.toml", '[project]\ndependencies = ["Foo_Bar>=1", "baz[x]==2 ; python_version > \'3\'"]\n[dependency-groups]\ndev = ["pytest"]\n'), ("bad.toml", "["))
    lock = texts(spark, ("uv.lock", '[[package]]\nname = "foo-bar"\nversion = "1.5"\n'))
    assert out(manifests.python_dependencies(project, lock), "name", "scope", "version") == [("Foo_Bar", "compile", "1.5"), ("baz", "compile", "unresolved"), ("pytest", "test", "unresolved")]
    swift = texts(spark, ("Package.swift", '.package(url: "https://github.com/A/B.git", from: "1.0.0"), .package(name: "C", url: "git@example.com:x/c.git", .exact("2.0"))'))
    pins = texts(spark, ("Package.resolved", '{"pins": [{"location": "https://github.com/a/b", "state": {"version": "1.2.0"}}]}'))
    assert out(manifests.swift_dependencies(swift, pins), "version", "purl") == [("1.2.0", "pkg:github/a/b@1.2.0"), ("unresolved", "pkg:generic/example.com/x/c@unresolved")]
    catalog = texts(spark, ("libs.versions.toml", '[versions]\nk = "1.9"\n[libraries]\nktor-core = { module = "io.ktor:core", version.ref = "k" }\n'))
    script = texts(spark, ("app/build.gradle.kts", 'implementation(libs.ktor.core)\ntestImplementation("a.b:c:1")\nimplementation(project(":core"))'))
    assert out(manifests.gradle_dependencies(catalog, script), "name", "scope", "version") == [("a.b:c", "test", "1"), ("io.ktor:core", "compile", "1.9")]
    assert out(manifests.gradle_modules(script), "src", "dst") == [(":app", ":core")]
    targets = texts(spark, ("Package.swift", '.target(name: "A", dependencies: ["B", .product(name: "Z", package: "z")]), .target(name: "B"), .testTarget(name: "T", dependencies: ["A"])'))
    assert out(manifests.swift_targets(targets), "src", "dst") == [("A", "B"), ("T", "A")]


def test_reports(spark):
    dead = texts(spark, ("r", '[{"ids": ["s:1"], "name": "f", "location": "a.swift:3:4", "kind": "function", "accessibility": "public"}, {"name": "g"}]'))
    good, warnings = reports.dead_symbol_report(dead)
    assert out(good, "symbol_key", "source_file", "source_line", "public") == [("s:1", "a.swift", 3, True)] and warnings.count() == 1
    scan = texts(spark, ("s", '{"results": [{"check_id": "x.rule", "path": "a", "start": {"line": 1}, "end": {"line": 2}, "extra": {"message": "m", "severity": "INFO"}}, {"check_id": "x.rule", "path": "a", "start": {"line": 1}, "end": {"line": 2}, "extra": {"message": "m", "severity": "ERROR"}}]}'))
    assert out(reports.scan_report(scan), "rule", "start", "severity") == [("rule", 1, "high")]
    trace = texts(spark, ("t", '{"trace_id": "t", "samples": [{"symbol_name": "f", "cpu_samples": 3, "wall_ms": 1, "thread_name": "m"}, {"symbol_name": "g", "cpu_samples": 97, "wall_ms": 1, "thread_name": "m"}]}'))
    assert out(reports.instruments_trace(trace), "symbol", "cpu_share", "hot") == [("f", 0.03, False), ("g", 0.97, True)]
    strings = texts(spark, ("de.lproj/L.strings", '"a" = "x";\n"b\\"c" = "y";'), ("res/values/strings.xml", '<string name="a">A</string><string name="b">B</string>'))
    assert out(reports.string_tables(strings), "locale", "keys") == [("de", 2), ("en", 2)]
    rows = spark.createDataFrame([("f(a int) at src/a.py:10", ["1", "5", "3"]), ("bad", ["1", "2", "3"])], "name string, values array<string>")
    assert out(reports.complexity_report(rows), "path", "function", "start_line", "end_line", "ccn") == [("src/a.py", "f", 10, 14, 3)]


def varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 0x7F
        out += bytes([low | (0x80 if n else 0)])
        if not n:
            return out


def field(k, value):
    return varint(k << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(k << 3) + varint(value)


def test_symbol_index(spark, tmp_path):
    occurrence = lambda span, symbol, roles: field(2, field(1, b"".join(map(varint, span))) + field(2, symbol.encode()) + field(3, roles))
    document = field(1, b"src/a.py") + occurrence([1, 0, 10], "s m pkg 1 f().", 1) + occurrence([2, 4, 3, 200], "s m pkg 1 g().", 8) + occurrence([3, 0, 1], "local 3", 1) + field(4, b"python")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "i.scip").write_bytes(field(1, b"meta") + field(2, document))
    (tmp_path / "bad.scip").write_bytes(b"\x12\xff\x01abc")
    found = scip.scip_occurrences(spark, str(tmp_path), "sha")
    assert out(found.where("error is null"), "file_path", "kind", "line", "col_start", "col_end", "language") == [("src/a.py", "def", 1, 0, 10, "python"), ("src/a.py", "use", 2, 4, 200, "python")]
    assert out(found.where("error is not null"), "error") == [("malformed",)]
    assert out(scip.scip_occurrences(spark, str(tmp_path), "sha", most_bytes=3), "error") == [("too_large",)] * 2
    assert scip.synthetic_occurrences(spark, 100).count() == 100


def test_trees(spark, tmp_path):
    for name in ("src/core/a.py", "node_modules/x.js", "Tests/FooTests.swift", "b.txt", "src/big.py"):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("import os\n" * (30 if "big" in name else 1))
    found = trees.source_tree(spark, str(tmp_path), most_bytes=100)
    assert out(found, "path", "module", "context") == [("Tests/FooTests.swift", "Tests", "test"), ("src/big.py", "root", "library"), ("src/core/a.py", "core", "library")] or out(found, "path") == [("Tests/FooTests.swift",), ("src/big.py",), ("src/core/a.py",)]
    assert found.where("path = 'src/big.py'").first()["text"] is None
    assert out(trees.named_files(spark, str(tmp_path), "*.txt"), "path") == [("b.txt",)]
    modules = spark.createDataFrame([("core", "core"), ("deep", "core.deep"), ("x", "two"), ("y", "two")], "module string, name string")
    files = spark.createDataFrame([("a.kt", "kotlin", "import core.deep.Thing\nimport core.Other\nimport two\nimport none")], "path string, language string, text string")
    assert out(trees.imports(files, modules), "line", "module", "status") == [(1, "deep", "ok"), (2, "core", "ok"), (3, "x", "ambiguous")]


def test_named_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "binary_files", lambda *_: (_ for _ in ()).throw(AssertionError("listed by the driver")))
    for name in ("a.api", "x/y/b.api", "x/c.toml", "x/d.txt", "node_modules/z/e.api", "x/build/f.toml"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode() + b"\xff")
    found = trees.named_files(spark, str(tmp_path), "*.api", "*.toml")
    assert out(found, "path", "text") == [(n, n + "\ufffd") for n in ("a.api", "x/c.toml", "x/y/b.api")]
    assert trees.named_files(spark, str(tmp_path), "*.none").count() == 0


def test_configuration_files(spark, tmp_path):
    (tmp_path / "second.json").write_text('{"rules": []}')
    name, text = config.first_file(spark, f"file://{tmp_path}", ["first.json", "second.json"])
    assert name == "second.json" and config.read_text(text) == {"rules": []}
    assert config.first_file(spark, f"file://{tmp_path}", ["none"]) == (None, None)
    assert config.context_overrides('{"overrides": {"a/*": "test"}}') == {"a/*": "test"} and config.context_overrides(None) == {}
    with pytest.raises(ValueError):
        config.read_text("[1]")
    assert out(config.allowlist(spark, "# x\n a \n\na\nb"), "literal") == [("a",), ("b",)]


def test_budgets_of_runs():
    ledger.check_budget(9, 10, "phase2")
    ledger.check_budget(10, 10, "phase2", override=True)
    ledger.check_resume("failed")
    with pytest.raises(ledger.BudgetExceeded):
        ledger.check_budget(10, 10, "phase2")
    with pytest.raises(ledger.BudgetExceeded):
        ledger.check_resume("budget_exceeded")
