"""Scanner rules over source text: handling of errors, amounts and secrets, words and labels of a user interface.

A rule is judged on the tokens of a file: those that follow one, the block in braces or the call in parentheses that it
opens, and what comes right after that. A finding has the lines from its first to its last token.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.sources.lexed import ahead, behind, count_in, follows, gap_ahead, in_context, is_string, line_ahead, line_behind, of_file

# Rule, its kind, severity, category and language.
RULES = """
catch_only_logs catch_only_logs WARNING error-handling swift
empty_catch_in_crypto_path empty_catch_in_crypto_path CRITICAL error-handling swift
error_as_string error_as_string INFO error-handling swift
generic_catch_all generic_catch_all INFO error-handling swift
nil_coalesce_swallows_error nil_coalesce_swallows_error WARNING error-handling swift
try_optional_in_crypto_path try_optional_in_crypto_path ERROR error-handling swift
try_optional_swallow try_optional_swallow WARNING error-handling swift
address_no_checksum_validation address_no_checksum_validation WARNING crypto-correctness swift
bignum_overflow_unguarded bignum_overflow_unguarded WARNING crypto-correctness swift
bignum_overflow_unguarded_sub bignum_overflow_unguarded WARNING crypto-correctness swift
decimal_raw_uint_arithmetic_div decimal_raw_uint_arithmetic WARNING crypto-correctness swift
decimal_raw_uint_arithmetic_mul decimal_raw_uint_arithmetic WARNING crypto-correctness swift
wei_eth_unit_mix_string wei_eth_unit_mix WARNING crypto-correctness swift
mnemonic_userdefaults_storage private_key_string_storage ERROR crypto-security swift
private_key_type_string private_key_string_storage HIGH crypto-security swift
words_joined_userdefaults private_key_string_storage ERROR crypto-security swift
a11y_missing_label_swiftui a11y_missing WARNING accessibility swift
a11y_missing_compose a11y_missing WARNING accessibility kotlin
loc_hardcoded_swiftui hardcoded_string WARNING localization swift
loc_hardcoded_uikit hardcoded_string WARNING localization swift
loc_hardcoded_compose hardcoded_string WARNING localization kotlin
"""
# Words in the names of files that handle keys and money; levels of a log; names of amounts, units and secrets.
CRYPTO_FILES = ("Sign", "Crypto", "Key", "Wallet", "Balance", "Mnemonic", "Seed", "Private", "Secret")
LOG_LEVELS = ("error", "warning", "info")
SUMS = ("amount", "balance", "value", "totalAmount", "totalBalance", "totalValue")
UNIT_AMOUNTS = ("amount", "balance", "value", "satoshi", "satoshis", "wei", "sun", "lamport", "gwei", "tokenAmount")
UNITS = ("wei", "gwei", "sun", "eth", "trx", "satoshi")
SECRET_VALUES = ("privateKey", "private_key", "mnemonic", "seedPhrase")
SECRET_KEYS = ("mnemonic", "words", "seed", "private_key", "privatekey", "privateKey", "keyPhrase", "recoveryPhrase", "secretKey")
LABELS = ("accessibilityLabel", "accessibilityHidden")



def crypto_path(path: Column) -> Column:
    """Whether a Swift file's name speaks of keys or money."""
    name = F.substring_index(path, "/", -1)
    return name.endswith(".swift") & reduce(lambda a, b: a | b, (F.contains(name, F.lit(w)) for w in CRYPTO_FILES))


#: A rule on the next few tokens: its name, whether it holds, which token ahead is its last, whether it doesn't look into comments.
TokenRule = tuple[str, Column, int, bool]


def _tries() -> Column:
    return F.col("tok").endswith("try") & follows("?", near=True) & (F.coalesce(ahead(2), F.lit(";")) != ";")


def _token_rules() -> list[TokenRule]:
    tok = F.col("tok")
    swift, kotlin = F.col("language") == "swift", F.col("language") == "kotlin"
    # rules of syntax don't look into comments, those of text do
    operand = ~F.coalesce(behind(1), F.lit("")).isin(".", "*", "/", "%", "+", "-", "&")  # the left side is the name alone

    def sum_of(names: tuple[str, ...], sign: str) -> Column:
        return tok.isin(*names) & operand & follows(sign) & ~F.coalesce(ahead(2), F.lit("")).isin("=", ">", sign, "*", "/")

    string = is_string(ahead(1))
    secret = tok.isin("let", "var") & ahead(1).isin(*SECRET_VALUES) & (ahead(2) == ":") & (ahead(3) == "String") & (ahead(4) == "=")
    return [
        ("generic_catch_all", swift & tok.endswith("catch") & follows("{"), 1, False),
        ("error_as_string", swift & tok.endswith("throw") & string & gap_ahead(1), 1, False),
        ("error_as_string", swift & (tok == "Result") & follows(".", "failure", "(", is_string(ahead(4), False), ")", near=True), 5, False),
        ("address_no_checksum_validation", swift & tok.startswith('"0x') & tok.rlike('^"0[x][0-9a-fA-F]{10,}"$'), 0, False),
        ("wei_eth_unit_mix_string", swift & tok.isin(*(f'"{u}"' for u in UNITS)), 0, False),
        ("loc_hardcoded_swiftui", swift & tok.endswith("Text") & follows("(", is_string(ahead(2)), ")", near=True), 3, False),
        ("loc_hardcoded_uikit", swift & (tok == ".") & ~F.coalesce(gap_ahead(1), F.lit(True)) & follows("text", "=") & is_string(ahead(3)), 3, False),
        ("loc_hardcoded_uikit", swift & tok.endswith("setTitle") & follows("(", is_string(ahead(2)), ",", near=True), 3, False),
        ("private_key_type_string", swift & secret, 4, True),
        ("bignum_overflow_unguarded", swift & sum_of(SUMS, "+"), 2, True),
        ("bignum_overflow_unguarded_sub", swift & sum_of(SUMS, "-"), 2, True),
        ("decimal_raw_uint_arithmetic_div", swift & sum_of(UNIT_AMOUNTS, "/"), 2, True),
        ("decimal_raw_uint_arithmetic_mul", swift & sum_of(UNIT_AMOUNTS, "*"), 2, True),
        ("loc_hardcoded_compose", kotlin & (tok == "Text") & follows("(", is_string(ahead(2)), ")"), 3, True),
        ("try_optional_swallow", swift & _tries(), 2, False),
        ("try_optional_in_crypto_path", swift & _tries() & crypto_path(F.col("path")), 2, False),
    ]


def _may_begin() -> Column:
    """Whether a token is one with which a finding of the token rules may begin."""
    tok = F.col("tok")
    words = ("Result", "let", "var", *SUMS, *UNIT_AMOUNTS, *(f'"{u}"' for u in UNITS))
    return reduce(lambda a, b: a | b, (tok.endswith(w) for w in ("catch", "throw", "try", "Text", "setTitle")), tok.isin(*words) | tok.startswith('"0x') | ((tok == ".") & (ahead(1) == "text")))


def _told(rule: str, first: Column, last: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), first.cast("int").alias("first_line"), last.cast("int").alias("last_line"))


def _on_tokens(rows: DataFrame) -> DataFrame:
    """Findings of the rules that look at the next few tokens, in rows that know comments, ends and ?? of statements: path, rule,
    first_line, last_line."""
    line = F.col("line")
    found = [F.when(holds & ~F.col("comment") if code else holds, _told(rule, line, line_ahead(n))) for rule, holds, n, code in _token_rules()]
    found.append(F.when((F.col("language") == "swift") & _tries() & F.col("coalesces"), _told("nil_coalesce_swallows_error", line, F.col("end"))))
    return rows.where(_may_begin()).withColumn("_f", F.explode(F.array_compact(F.array(*found)))).select("path", "_f.rule", "_f.first_line", "_f.last_line")


def _begins_catch() -> Column:
    return F.col("tok").endswith("catch") & (gap_ahead(1) | (ahead(1) == "{"))


def _marked(files: DataFrame) -> DataFrame:
    """The tokens that some rule needs, a row each, with what the tokens around them say for it."""
    tok, text, swift = F.col("tok"), F.col("text"), F.col("language") == "swift"
    calls = reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in ("Image(", "clickable", "UserDefaults")))
    known = files.where(F.col("language").isin("swift", "kotlin")).select("path", "language", "text", calls.alias("_calling"), (swift & F.contains(text, F.lit("catch"))).alias("_catching"), (swift & F.contains(text, F.lit("??"))).alias("_asking"))
    rows = in_context(known, 5, 11)
    tight = F.coalesce(~gap_ahead(1), F.lit(False))
    note = F.when((tok == "/") & tight & (ahead(1) == "/"), "line").when((tok == "/") & tight & (ahead(1) == "*"), "block").when((tok == "*") & tight & (ahead(1) == "/"), "end")
    sign = F.when(F.col("_catching") & tok.isin("{", "}"), tok).when(F.col("_calling") & tok.isin("(", ")"), tok).when(F.col("_asking") & tok.isin("??", ";"), tok)
    shuts = F.when(F.col("_catching"), count_in(tok, ")")).otherwise(0)
    rows = rows.where(_may_begin() | tok.isin("/", "*") | sign.isNotNull() | (F.col("_catching") & F.contains(tok, F.lit(")"))))

    line, b = F.col("line"), lambda n: F.coalesce(behind(n), F.lit(""))
    hits = F.array(*(F.when(holds, F.struct(_told(rule, line, line_ahead(n)).alias("told"), F.lit(code).alias("code"))) for rule, holds, n, code in _token_rules()))
    before = lambda *words: reduce(lambda x, y: x & y, (b(len(words) - k) == w for k, w in enumerate(words)))
    opens, shut = F.col("sign") == "(", F.col("sign") == ")"
    call = F.when(F.col("language") == "swift", F.when(behind(1).endswith("Image") & ~F.col("gap"), "image").when(before("UserDefaults", ".", "standard", ".", "set"), "stored")).when(before("Modifier", ".", "clickable"), "click")
    labelled = ~gap_ahead(1) & ~gap_ahead(2) & (ahead(1) == ".") & reduce(lambda x, y: x | y, (ahead(2).startswith(w) for w in LABELS))
    keyed = (b(3) == "forKey") & (b(2) == ":")
    joined = keyed & (b(4) == ",") & reduce(lambda x, y: x & y, (b(11 - k) == w for k, w in enumerate((".", "joined", "(", "separator", ":", '" "', ")"))))
    logs = (follows("logger", ".", ahead(3).isin(*LOG_LEVELS), "(") & ~gap_ahead(2) & ~gap_ahead(3) & ~gap_ahead(4)) | (follows("print", "(") & ~gap_ahead(2))
    brace, no = F.col("sign") == "{", F.lit(False)
    return rows.withColumns({"sign": sign, "note": note, "shuts": shuts}).select(
        "path", "language", "pos", "line", "sign", "note", "shuts",
        F.when(_may_begin(), F.array_compact(hits)).alias("hits"),
        F.when(F.col("_catching"), F.coalesce(_begins_catch(), no)).otherwise(no).alias("catches"),
        F.when(brace, F.coalesce(ahead(1).isin("return", "break", "continue"), no)).alias("exits"),
        F.when(brace, F.coalesce(logs, no)).alias("logs"),
        F.when(opens, call).alias("call"),
        F.when(opens, F.when(call == "image", line_behind(1)).when(call == "click", line_behind(3)).otherwise(line_behind(5))).alias("call_line"),
        F.when(F.col("_asking") & _tries() & (ahead(2) != "??"), line_ahead(2)).alias("asked"),
        F.struct(
            "pos", "line", (behind(1) == ")").alias("after_call"),
            F.when(shut, F.coalesce(labelled, no)).alias("labelled"), F.when(shut, F.coalesce((ahead(1) == ".") & (ahead(2) == "semantics"), no)).alias("semantics"),
            F.when(shut, F.coalesce(keyed & F.replace(b(1), F.lit('"'), F.lit("")).isin(*SECRET_KEYS), no)).alias("secret"), F.when(shut, joined).alias("joined"),
        ).alias("end"),
    )


def _depth(opening: str, closing: str) -> Column:
    """How many brackets are open at one, itself included."""
    step = F.when(F.col("sign") == opening, 1).when(F.col("sign") == closing, -1).otherwise(0)
    return F.sum(step).over(of_file().rowsBetween(Window.unboundedPreceding, 0)) + F.when(F.col("sign") == closing, 1).otherwise(0)


def _counted(rows: DataFrame) -> DataFrame:
    """Marked tokens (sign, catches) with the braces and semicolons before each, its depth, and the catch with the most braces before it."""
    sign = F.col("sign")
    upto, before = of_file().rowsBetween(Window.unboundedPreceding, 0), of_file().rowsBetween(Window.unboundedPreceding, -1)
    count = lambda *signs: F.coalesce(F.sum(F.when(sign.isin(*signs), 1)).over(before), F.lit(0))
    counted = rows.withColumns({"_segment": count("{", "}"), "_ends": count(";"), "_braces": _depth("{", "}")})
    # the first catch since the last brace: of running maxima the one with the least position
    return counted.withColumn("_head", F.max(F.when(F.col("catches"), F.struct("_segment", (-F.col("pos")).alias("at"), "line"))).over(upto))


def _statement() -> Column:
    """What is equal for the ?? of a statement and the try whose next but one token is in it: a statement doesn't go beyond a line."""
    return F.coalesce("asked", "line").cast("long") * 2**31 + F.col("_ends")


def _in_levels(rows: DataFrame) -> DataFrame:
    """The marked tokens that may tell something, each with its level: brackets of one depth, or what a statement asks."""
    upto = of_file().rowsBetween(Window.unboundedPreceding, 0)
    sign, note = F.col("sign"), F.col("note")
    seen = _counted(rows).withColumns({
        "_commented": F.last(F.when(note == "line", F.col("line")), ignorenulls=True).over(upto),
        "_block": F.last(F.when(note == "block", True).when(note == "end", False), ignorenulls=True).over(upto),
        "shut": F.sum("shuts").over(upto),
        "_parens": _depth("(", ")"),
    })
    comment = F.coalesce(F.col("_commented") == F.col("line"), F.lit(False)) | F.coalesce(F.col("_block"), F.lit(False))
    called = F.when((F.col("call") == "image") | ~comment, F.col("call"))
    caught = F.when((sign == "{") & (F.col("_head._segment") == F.col("_segment")), F.col("_head.line"))
    levelled = seen.withColumns({
        "hits": F.when(F.size("hits") > 0, F.filter("hits", lambda x: ~(x["code"] & comment))), "called": called, "caught": caught,
        "kind": F.when(sign.isin("{", "}"), "{").when(sign.isin("(", ")"), "(").when((sign == "??") | F.col("asked").isNotNull(), "?"),
        "depth": F.when(sign.isin("{", "}"), F.col("_braces")).when(sign.isin("(", ")"), F.col("_parens")).otherwise(_statement()),
    })
    return levelled.where((F.size("hits") > 0) | sign.isin("}", ")", "??") | F.col("called").isNotNull() | F.col("caught").isNotNull() | F.col("asked").isNotNull())


def _judged(rows: DataFrame) -> DataFrame:
    """path, rule, first_line, last_line of all findings among tokens in levels: what follows an opening bracket in its level closes it."""
    level = Window.partitionBy("path", "kind", "depth").orderBy("pos")
    whole = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    closed = rows.withColumns({
        "close": F.when(F.col("caught").isNotNull() | F.col("called").isNotNull(), F.when(F.lead("sign").over(level).isin("}", ")"), F.lead(F.struct("end.*", "shut")).over(level))),
        "asks": F.max(F.when(F.col("sign") == "??", F.col("pos"))).over(whole),
    })
    close, line = F.col("close"), F.col("line")
    inside = close["pos"] - F.col("pos") - 1
    empty = (inside == 0) | ((inside == 1) & F.col("exits"))
    only_logs = F.col("logs") & close["after_call"] & (close["shut"] - F.col("shut") == 1)
    crypto = crypto_path(F.col("path"))
    block = F.when(empty & crypto, _told("empty_catch_in_crypto_path", F.col("caught"), close["line"])).when(only_logs, _told("catch_only_logs", F.col("caught"), close["line"]))
    of_call = lambda rule, holds: F.when(holds, _told(rule, F.col("call_line"), close["line"]))
    call, stored = F.col("called"), F.col("called") == "stored"
    ends = F.array(
        F.when(F.col("caught").isNotNull() & close.isNotNull(), block),
        of_call("a11y_missing_label_swiftui", (call == "image") & ~close["labelled"]),
        of_call("a11y_missing_compose", (call == "click") & ~close["semantics"]),
        of_call("mnemonic_userdefaults_storage", stored & close["secret"]),
        of_call("words_joined_userdefaults", stored & close["joined"]),
        F.when(F.col("asks") > F.col("pos") + 2, F.when(F.col("asked").isNotNull(), _told("nil_coalesce_swallows_error", line, F.col("asked")))),
    )
    told = closed.select("path", F.concat(F.coalesce(F.transform("hits", lambda x: x["told"]), F.array()), ends).alias("_all"))
    return told.select("path", F.explode_outer("_all").alias("_f")).where("_f is not null").select("path", "_f.*")


def rule_table(spark: SparkSession) -> DataFrame:
    """rule, kind, severity, category, language."""
    return spark.createDataFrame([tuple(line.split()) for line in RULES.strip().splitlines()], "rule string, kind string, severity string, category string, language string")


def findings(files: DataFrame) -> DataFrame:
    """path, rule, kind, severity, category, first_line, last_line of all that the rules find.

    files: path (unique), language, text; a null text has no findings.
    """
    found = _judged(_in_levels(_marked(files)))
    return found.join(F.broadcast(rule_table(files.sparkSession).drop("language")), "rule").select("path", "rule", "kind", "severity", "category", "first_line", "last_line")


def error_sites(files: DataFrame) -> DataFrame:
    """path, first_line, last_line, kind, rethrows of each place that meets an error: catch (a block without blocks in it),
    try_optional, nil_coalesce_try_optional. rethrows: the block speaks of throwing."""
    tok, sign = F.col("tok"), F.col("sign")
    known = files.where((F.col("language") == "swift") & F.col("text").rlike(r"catch|try\s*\?")).select("path", "text")
    throws = F.contains(tok, F.lit("throw"))
    rows = in_context(known, 2, 0).where(tok.isin("{", "}", "??", ";") | throws | tok.endswith("try") | tok.endswith("catch"))
    marked = rows.select(
        "path", "pos", "line", F.when(tok.isin("{", "}", "??", ";"), tok).alias("sign"), throws.cast("int").alias("throws"),
        F.coalesce(_begins_catch(), F.lit(False)).alias("catches"), F.when(_tries(), line_ahead(2)).alias("asked"), (ahead(2) != "??").alias("other"),
    )
    seen = _counted(marked).withColumn("throws", F.sum("throws").over(of_file().rowsBetween(Window.unboundedPreceding, 0)))
    caught = F.when((sign == "{") & (F.col("_head._segment") == F.col("_segment")), F.col("_head.line"))
    brace = sign.isin("{", "}")
    levelled = seen.withColumns({"caught": caught, "kind": F.when(brace, "{").otherwise("?"), "depth": F.when(brace, F.col("_braces")).otherwise(_statement())}).where("sign in ('}', '??') or caught is not null or asked is not null")
    level = Window.partitionBy("path", "kind", "depth").orderBy("pos")
    closed = levelled.withColumns({
        "close": F.lead(F.struct("sign", "line", "_segment", "throws")).over(level),
        "asks": F.max(F.when(sign == "??", F.col("pos"))).over(level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    }).where("asked is not null or (caught is not null and close.sign = '}' and close._segment = _segment + 1)")
    tried = F.when(F.col("other") & (F.col("asks") > F.col("pos") + 2), "nil_coalesce_try_optional").otherwise("try_optional")
    asked = F.col("asked").isNotNull()
    return closed.select(
        "path", F.when(asked, F.col("line")).otherwise(F.col("caught")).alias("first_line"), F.when(asked, F.col("asked")).otherwise(F.col("close.line")).alias("last_line"),
        F.when(asked, tried).otherwise("catch").alias("kind"), (~asked & (F.col("close.throws") > F.col("throws"))).alias("rethrows"),
    ).distinct()
