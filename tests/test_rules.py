import random

from pyspark.sql import functions as F

from quarrylight.sources import facts, lexed, rules

# pieces of Swift with the findings (rule, first line, last line) that each has by itself
SWIFT = [
    ("do {\n  try f()\n} catch {\n}\n", [("generic_catch_all", 2, 2), ("empty_catch_in_crypto_path", 2, 3)]),
    ("do { try f() } catch let e as X { return }\n", [("empty_catch_in_crypto_path", 0, 0)]),
    ("do { try f() } catch let e as X { return 1 }\n", []),
    ("do { try f() } catch {\n  if a { return }\n}\n", [("generic_catch_all", 0, 0)]),
    ("catch e\n{\n  logger.error(\"no\")\n}\n", [("catch_only_logs", 0, 3)]),
    ("catch e { print(e) }\n", [("catch_only_logs", 0, 0)]),
    ("catch e { print(f(e)) }\n", []),
    ("catch e { print(e); throw e }\n", []),
    ("catch e { logger.debug(e) }\n", []),
    ('catch e { print("at }") }\n', [("catch_only_logs", 0, 0)]),
    ('throw "no \\" good"\n', [("error_as_string", 0, 0)]),
    ('throw ""\nthrow Bad("x")\n', []),
    ('return Result.failure("bad")\n', [("error_as_string", 0, 0)]),
    ("let a = try? f(x)\n", [("try_optional_swallow", 0, 0), ("try_optional_in_crypto_path", 0, 0)]),
    ("let a = try?\n  f(x) ?? 1; g()\n", [("try_optional_swallow", 0, 1), ("try_optional_in_crypto_path", 0, 1), ("nil_coalesce_swallows_error", 0, 1)]),
    ("let a = try? f(x); let b = c ?? d\n", [("try_optional_swallow", 0, 0), ("try_optional_in_crypto_path", 0, 0)]),
    ("let a = try! f(x) ?? 1\n", []),
    ('let a = "0xABCDEF0123"\nlet b = "0xABC" + "0xABCDEF0123 "\n', [("address_no_checksum_validation", 0, 0)]),
    ('unit("wei")\nunit("weight")\n', [("wei_eth_unit_mix_string", 0, 0)]),
    ('Text("Hello \\"you\\"")\nText(verbatim: "x")\nText("")\n', [("loc_hardcoded_swiftui", 0, 0)]),
    ('label.text = "Hi"\nlabel.text = title\nb.setTitle("Go", for: .normal)\nif a.text == "x" {}\n', [("loc_hardcoded_uikit", 0, 0), ("loc_hardcoded_uikit", 2, 2)]),
    ('Image("a")\n  .padding()\n', [("a11y_missing_label_swiftui", 0, 0)]),
    ('Image("a").accessibilityLabel("b")\nImage(f(\n  "x")).accessibilityHidden(true)\n', []),
    ("let privateKey: String = load()\nlet other: String = x\nvar mnemonic: Data = y\n", [("private_key_type_string", 0, 0)]),
    ("s = amount + fee\nt = a.amount + fee\namount += 1\nu = 2 * amount + 1\n", [("bignum_overflow_unguarded", 0, 0)]),
    ("s = total - amount\nt = balance - 1\nu = balance -> x\n", [("bignum_overflow_unguarded_sub", 1, 1)]),
    ("s = wei / 10\nt = gwei * 3\nu = x.wei / 2\n", [("decimal_raw_uint_arithmetic_div", 0, 0), ("decimal_raw_uint_arithmetic_mul", 1, 1)]),
    ('UserDefaults.standard.set(\n  w, forKey: "seed")\nUserDefaults.standard.set(w, forKey: "theme")\n', [("mnemonic_userdefaults_storage", 0, 1)]),
    ('UserDefaults.standard.set(list.joined(separator: " "), forKey: k)\n', [("words_joined_userdefaults", 0, 0)]),
    ("/* nothing */\nlet c = '\"'\n", []),
    ("// of wei/gwei, amount + fee\n/* let privateKey: String = x\n balance - 1 */ s = 1 // a\nt = balance - 2\n", [("bignum_overflow_unguarded_sub", 3, 3)]),
    ("// throw \"text\"\n", [("error_as_string", 0, 0)]),
    ("", []),
]
KOTLIN = [
    ('Text("Hi")\nText("")\nText(stringResource(R.string.a))\n', [("loc_hardcoded_compose", 0, 0)]),
    ("x = Modifier.clickable(\n  onClick = { f(1) })\n", [("a11y_missing_compose", 0, 1)]),
    ("x = Modifier.clickable(a)\n  .semantics { }\ny = Modifier.semantics(b).clickable(c)\n", []),
    ('let a = try? f()\nthrow "x"\n', []),
]


def made(seed, pieces, count):
    r, text, found, line = random.Random(seed), "", [], 1
    for _ in range(count):
        piece, own = r.choice(pieces)
        text += piece
        found += [(rule, line + a, line + b) for rule, a, b in own]
        line += piece.count("\n")
    return text, found


def test_rules_over_pieces_in_any_order(spark):
    rows, want = [], []
    for k in range(60):
        name, language, pieces = [(f"a/Wallet{k}.swift", "swift", SWIFT), (f"Sign/View{k}.swift", "swift", SWIFT), (f"b/Key{k}.kt", "kotlin", KOTLIN)][k % 3]
        text, found = made(k, pieces, k % 25)
        rows.append((name, language, text))
        want += [(name, *f) for f in found if "crypto_path" not in f[0] or "Wallet" in name]
    rows += [("none.swift", "swift", None), ("empty.swift", "swift", ""), ("x.py", "python", 'throw "x"'), ("open.swift", "swift", 'catch { "never closed'), ("deep.swift", "swift", "{" * 3000 + "catch {}" + "}" * 3000)]
    want += [("open.swift", "generic_catch_all", 1, 1), ("deep.swift", "generic_catch_all", 1, 1)]
    found = rules.findings(spark.createDataFrame(rows, "path string, language string, text string"))
    assert sorted((r["path"], r["rule"], r["first_line"], r["last_line"]) for r in found.collect()) == sorted(want)
    assert {r["severity"] for r in found.where("rule = 'empty_catch_in_crypto_path'").collect()} == {"CRITICAL"}


def test_error_sites(spark):
    text = "do { try f() } catch { return }\ncatch let e as X {\n  throw e\n}\ncatch { if a { } }\nlet a = try? f()\nlet b = try? f() ?? 1\nlet c = try!\n"
    found = rules.error_sites(spark.createDataFrame([("a.swift", "swift", text), ("b.kt", "kotlin", text), ("c.swift", "swift", None)], "path string, language string, text string"))
    want = [("catch", 1, 1, False), ("catch", 2, 4, True), ("nil_coalesce_try_optional", 7, 7, False), ("try_optional", 6, 6, False)]
    assert sorted((r["kind"], r["first_line"], r["last_line"], r["rethrows"]) for r in found.collect()) == want


def plain_blocks(text):
    out, held, quoted, line, k = [], [], False, 1, 0
    while k < len(text):
        c = text[k]
        if c == "\n":
            line += 1
        if c == '"':
            end = k + 1
            while end < len(text) and text[end] not in '"\n':
                end += 2 if text[end] == "\\" and end + 1 < len(text) and text[end + 1] != "\n" else 1
            if end < len(text) and text[end] == '"':
                k = end
        elif c == "{":
            held.append(line)
        elif c == "}" and held:
            out.append((len(held), held.pop(), line))
        k += 1
    return sorted(out)


def test_blocks_against_a_stack(spark):
    r = random.Random(7)
    texts = ["".join(r.choice(['{', '}', '{ ', ' }', '\n', 'word', '"{"', '"a\\"}"', '"', ' ']) for _ in range(60)) for _ in range(80)]
    texts = [t for t in texts if all(x <= 0 for x in [0])]
    rows = []
    for k, t in enumerate(texts):  # a brace that closes nothing is left out: it would end a block of another depth
        depth, kept = 0, ""
        for c in lexed_signs(t):
            depth += (c == "{") - (c == "}")
            if depth < 0:
                depth = 0
                continue
            kept += c
        rows.append((str(k), "swift", kept))
    got = lexed.blocks(lexed.tokens(spark.createDataFrame(rows, "path string, language string, text string"))).where("last_line is not null").collect()
    for path, _, text in rows:
        assert sorted((b["depth"], b["first_line"], b["last_line"]) for b in got if b["path"] == path) == plain_blocks(text)


def lexed_signs(text):
    import re

    return re.findall(r'"(?:[^"\\\n]|\\[^\n])*"|[^"]|"', text)


def test_texts_move_once(spark):
    files = spark.createDataFrame([("a", "swift", "x")], "path string, language string, text string")
    rows = lexed.tokens(files)
    plan = rules._on_tokens(lexed.with_statement_ends(lexed.with_comments(lexed.around(rows))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_tokens_keep_lines_and_gaps(spark):
    rows = lexed.tokens(spark.createDataFrame([("a", "swift", 'let x = "a b"\n  f?? 12;y')], "path string, language string, text string")).orderBy("pos").collect()
    assert [(r["tok"], r["line"], r["gap"], r["statement"]) for r in rows] == [("let", 1, False, 0), ("x", 1, True, 0), ("=", 1, True, 0), ('"a b"', 1, True, 0), ("f", 2, True, 1), ("??", 2, False, 1), ("12", 2, True, 1), (";", 2, False, 1), ("y", 2, False, 2)]


FACTS = {
    "swift": {
        "public final class Login: Base {": [("type", "Login"), ("subclass", "Login")],
        "struct Box<T> {": [("type", "Box")],
        "  internal protocol Reader {": [("protocol", "Reader")],
        "indirect enum Tree {": [("enum", "Tree")],
        "func load(_ a: Int) throws -> Int {": [("throws", "load")],
        "func load() -> Result<Int, Error> {": [("result", "load")],
        "func find(id: String) -> User? {": [("nullable", "find")],
        "func find(id: String) -> User {": [],
        "public func load() throws {": [],
        "lazy var model = make()": [("lazy", "model")],
        "var size: Int { 3 }": [("computed", "size")],
        "var size: Int = 3": [],
        "init(api: Api, n: Int) {": [("init_injection", "init")],
        "init(n: inout) {": [],
        "@Injected var api: Api": [("property_injection", "Injected"), ("framework", "resolver")],
        "let a = container.resolve(Api.self)": [("service_locator", "container.resolve(")],
        "let b = ServiceLocator.shared": [("service_locator", "ServiceLocator.shared")],
        "import Swinject": [("framework", "swinject")],
        "final class ApiMock: Api {": [("type", "ApiMock"), ("subclass", "ApiMock"), ("double", "ApiMock")],
        "var list: [Int] = []": [("collection_literal", "[")],
        "var list = [Int]()": [("collection_constructor", "[Int]()")],
        "var list = Array<Int>()": [("collection_constructor", "Array<Int>()")],
        'print("class Fake {")': [],
        "": [],
    },
    "kotlin": {
        "data class User(val name: String)": [("type", "User"), ("init_injection", "User")],
        "enum class Color { RED }": [("enum", "Color")],
        "sealed interface Shape": [("protocol", "Shape"), ("sealed", "Shape")],
        "fun load(a: Int): Result<Int> {": [("result", "load")],
        "fun find(): User? = null": [("nullable", "find")],
        "val db by lazy { open() }": [("lazy", "db")],
        "val size get() = 3": [("computed", "size")],
        "@Inject lateinit var api: Api": [("property_injection", "@Injectlateinitvar")],
        "val api: Api by inject()": [("property_injection", "byinject("), ("framework", "koin")],
        "val a = Db.getInstance()": [("service_locator", "Db.getInstance()")],
        "import dagger.hilt.Entry": [("framework", "hilt")],
        "import dagger.Module": [("framework", "dagger")],
        "object ApiFake": [("type", "ApiFake"), ("double", "ApiFake")],
        "val l = mutableListOf(1)": [("collection_factory", "mutableListOf")],
        "val l = ArrayList<Int>()": [("collection_constructor", "ArrayList")],
        "val m = mockk<Api>()": [("framework", "mockk")],
    },
}


def test_facts_of_lines(spark):
    rows = [(f"{language}/{k}", language, line) for language, lines in FACTS.items() for k, line in enumerate(lines)]
    want = sorted((f"{language}/{k}", *f) for language, lines in FACTS.items() for k, own in enumerate(lines.values()) for f in own)
    found = facts.line_facts(spark.createDataFrame(rows, "path string, language string, text string"))
    assert sorted((r["path"], r["fact"], r["name"]) for r in found.collect()) == want
    named = facts.doubles(found).select("name", "kind").orderBy("name").collect()
    assert [tuple(r) for r in named] == [("ApiFake", "fake"), ("ApiMock", "mock")]
    assert found.where(F.col("line") != 1).count() == 0


def test_findings_read_a_text_once(spark):
    files = spark.createDataFrame([("a", "swift", "x")], "path string, language string, text string")
    for of in (rules.findings, rules.error_sites):
        plan = of(files)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1 and plan.count("Union") == 0


def test_context_is_what_windows_tell(spark):
    r = random.Random(3)
    pieces = ["a1 ", "try? ", "?? ", '"b c"', '"d\\" ', "\n", " \t\n \n", ";", "{", "}", "->", "é_2", "\r\n", "\u0085", "\x0b", "/*", "// ", "\x1f", "\U0001f600"]
    rows = [(str(k), r.choice(["swift", "go"]), "".join(r.choice(pieces) for _ in range(n))) for k, n in enumerate([0, 1, 2, 7, lexed.PIECE, 2000, 5000] * 3)]
    files = spark.createDataFrame([*rows, ("none", "swift", None), ("blank", "swift", " \n\t ")], "path string, language string, text string")
    want = lexed.around(lexed.tokens(files), 5, 2).drop("statement")
    got = lexed.in_context(files, 5, 2).select(want.columns)
    assert got.count() == want.count() > 10_000
    assert not got.exceptAll(want).take(1)
