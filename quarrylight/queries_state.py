"""Queries of scanners, state with timers, bounded counters, tables written in place and feeds read in parts."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import keccak
from quarrylight.operators import aggregates, stored
from quarrylight.operators.lookup import ranked
from quarrylight.plans import history
from quarrylight.proxies import Tables
from quarrylight.queries import OWNERS
from quarrylight.queries_sources import naive, text
from quarrylight.registry import query, rounded
from quarrylight.session import cut, shared_folder
from quarrylight.sources import paged, profiles, rules, scip
from quarrylight.streaming import timers, windows
from quarrylight.streaming.alerts import Delays


def col(name: str) -> Column:
    return F.col(name)


# scanner rules --------------------------------------------------------------------------------------------------------

#: What a line of a document becomes by its length: three lines of Swift, in which W stands for a word of the line.
STATEMENTS = [
    "do { try f() } catch {\n}\n",
    'do { try f() } catch let e as X {\n  logger.error("W")\n}',
    'let a = try? load("W")\n\n',
    "let a = try?\n  load() ?? 1\n",
    'throw "W"\n\n',
    'return Result.failure("W")\n\n',
    'let a = "0xABCDEF0123456789" // W\n\n',
    'unit("wei")\nunit("W")\n',
    'Text("W")\nText(verbatim: "W")\n',
    'label.text = "W"\n\n',
    'Image("W")\n  .padding()\n',
    'Image("W").accessibilityLabel("W")\n\n',
    "do { try f() } catch let e {\n  if e { return }\n}",
    "let privateKey: String = load()\nvar mnemonic: Data = load()\n",
    "total = amount + fee\nsum = account.amount + fee\n",
    'UserDefaults.standard.set(W,\n  forKey: "seed")\n',
]
FINDINGS = """(0, 'generic_catch_all', 1, 1, false), (0, 'empty_catch_in_crypto_path', 1, 2, true), (1, 'catch_only_logs', 1, 3, false), (2, 'try_optional_swallow', 1, 1, false), (2, 'try_optional_in_crypto_path', 1, 1, true),
(3, 'try_optional_swallow', 1, 2, false), (3, 'try_optional_in_crypto_path', 1, 2, true), (3, 'nil_coalesce_swallows_error', 1, 2, false), (4, 'error_as_string', 1, 1, false), (5, 'error_as_string', 1, 1, false),
(6, 'address_no_checksum_validation', 1, 1, false), (7, 'wei_eth_unit_mix_string', 1, 1, false), (8, 'loc_hardcoded_swiftui', 1, 1, false), (9, 'loc_hardcoded_uikit', 1, 1, false), (10, 'a11y_missing_label_swiftui', 1, 1, false),
(13, 'private_key_type_string', 1, 1, false), (14, 'bignum_overflow_unguarded', 1, 1, false), (15, 'mnemonic_userdefaults_storage', 1, 2, false)"""


@query(f"""WITH l AS (SELECT doc_id, n_chars, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), f(k, rule, a, b, crypto) AS (VALUES {FINDINGS})
SELECT doc_id, rule, CAST(3 * i + a AS INTEGER) AS first_line, CAST(3 * i + b AS INTEGER) AS last_line FROM l JOIN f ON length(line) % {len(STATEMENTS)} = k WHERE NOT crypto OR n_chars > 2000""")
def scanner_findings(t: Tables) -> DataFrame:
    """What the rules find in every line of every document, as a statement of a source file."""
    return _by_document(rules.findings(_sources(t))).select("doc_id", "rule", "first_line", "last_line")


def _sources(t: Tables) -> DataFrame:
    """A file a document, in which each line is a statement; names of long documents speak of wallets."""
    word = lambda x: F.concat(F.lit("x"), F.regexp_extract(x, "[A-Za-z]+", 0))
    pieces = F.array(*map(F.lit, STATEMENTS))
    made = F.transform(F.split("text", "\n"), lambda x: F.replace(F.get(pieces, F.length(x) % len(STATEMENTS)), F.lit("W"), word(x)))
    path = text("app/", F.when(col("n_chars") > 2000, "Wallet").otherwise("View"), "-", col("doc_id"), ".swift")
    return t.read("documents").select(path.alias("path"), F.lit("swift").alias("language"), F.array_join(made, "\n").alias("text"))


def _by_document(found: DataFrame) -> DataFrame:
    return found.withColumn("doc_id", F.regexp_extract("path", r"-(-?\d+)\.swift", 1).cast("long"))


SITES = "(0, 'catch', 1, 2), (1, 'catch', 1, 3), (2, 'try_optional', 1, 1), (3, 'nil_coalesce_try_optional', 1, 2)"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), f(k, kind, a, b) AS (VALUES {SITES})
SELECT doc_id, kind, CAST(3 * i + a AS INTEGER) AS first_line, CAST(3 * i + b AS INTEGER) AS last_line, false AS rethrows FROM l JOIN f ON length(line) % {len(STATEMENTS)} = k""")
def error_sites(t: Tables) -> DataFrame:
    """Where the same files meet an error."""
    return _by_document(rules.error_sites(_sources(t))).select("doc_id", "kind", "first_line", "last_line", "rethrows")


# state with timers ----------------------------------------------------------------------------------------------------

UPTO = "w AS (SELECT date_trunc('millisecond', max(ts)) AS upto FROM events)"


@query(f"""WITH {UPTO}, s AS (SELECT user_id, ts, event_type <> 'purchase' AS present, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM events, w WHERE ts <= upto),
a AS (SELECT user_id, min(ts) FILTER (present) AS start, max(ts) FILTER (NOT present) AS cleared FROM s GROUP BY user_id, g),
o AS (SELECT user_id, 'alert' AS action, 1 AS tier, start AS "at" FROM a WHERE start IS NOT NULL UNION ALL SELECT user_id, 'clear', 0, cleared FROM a WHERE start IS NOT NULL AND cleared IS NOT NULL
UNION ALL SELECT user_id, 'repair', 2, start + INTERVAL 360 MINUTE FROM a, w WHERE user_id % 2 = 0 AND start + INTERVAL 360 MINUTE <= least(coalesce(cleared, upto), upto)
UNION ALL SELECT user_id, 'escalate', 3, start + INTERVAL 1440 MINUTE FROM a, w WHERE start + INTERVAL 1440 MINUTE <= least(coalesce(cleared, upto), upto))
SELECT CAST(user_id AS VARCHAR) AS issue_id, action, tier, "at" FROM o""")
def timed_alerts(t: Tables) -> DataFrame:
    """A finding for each user, gone with a purchase; what falls due while a user is silent comes at its time."""
    own = windows.table_stream(timers.with_timers(t.spark), t.folder, "events")
    rows = own.select(col("user_id").alias("issue_id"), F.lit("idle").alias("finding"), col("ts").cast("timestamp").alias("at"), (col("event_type") != "purchase").alias("present"), F.lit("s").alias("snapshot"), (col("user_id") % 2 == 0).alias("actionable"))
    actions = timers.timed_actions(rows, Delays(repair_minutes=360, escalation_minutes=1440, repairs=True))
    return naive(windows.run_to_table(actions, shared_folder(t.spark, "timed")), "at").select("issue_id", "action", "tier", "at")


@query(f"""WITH RECURSIVE {UPTO}, q AS (SELECT CAST(user_id % 7 AS VARCHAR) AS agent, CAST(user_id AS VARCHAR) AS issue, ts AS "at", CASE WHEN event_type = 'purchase' THEN ts END AS touched, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, CAST(user_id AS VARCHAR)) AS k FROM events, w WHERE ts <= upto),
r AS (SELECT DISTINCT agent, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS issue, CAST(NULL AS TIMESTAMP) AS "at", CAST('' AS VARCHAR) AS decision, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(i VARCHAR, t TIMESTAMP)[]) AS wakes, CAST([] AS STRUCT(i VARCHAR, t TIMESTAMP, n BIGINT, c BOOLEAN)[]) AS esc FROM q
UNION ALL SELECT agent, k, issue, "at", decision, n, CASE WHEN decision = 'wake' THEN list_append(wakes, {{'i': issue, 't': "at"}}) ELSE wakes END,
CASE WHEN decision = 'held' OR n = 0 THEN esc ELSE list_append(others, {{'i': issue, 't': CASE WHEN decision = 'escalate' THEN "at" ELSE e.t END, 'n': n, 'c': decision <> 'escalate'}}) END FROM (
 SELECT *, CASE WHEN decision = 'escalate' THEN coalesce(e.n, 0) + 1 ELSE coalesce(e.n, 0) END AS n FROM (
  SELECT *, CASE WHEN e IS NOT NULL AND NOT e.c AND (e.n > 2 OR touched IS NULL OR touched <= e.t) THEN 'held' WHEN len(list_filter(wakes, lambda x: x.i = issue)) > 0 AND list_max(list_transform(list_filter(wakes, lambda x: x.i = issue), lambda x: x.t)) > "at" - INTERVAL 6 HOUR THEN 'skip'
   WHEN len(list_filter(wakes, lambda x: x.t > "at" - INTERVAL 24 HOUR)) >= 5 THEN 'escalate' ELSE 'wake' END AS decision FROM (
   SELECT q.agent, q.k, q.issue, q."at", q.touched, list_filter(r.wakes, lambda x: x.t > q."at" - INTERVAL 24 HOUR) AS wakes, r.esc, list_filter(r.esc, lambda x: x.i <> q.issue) AS others, list_filter(r.esc, lambda x: x.i = q.issue)[1] AS e FROM r JOIN q ON q.agent = r.agent AND q.k = r.k + 1))))
SELECT agent, issue, "at", decision, CAST(n AS INTEGER) AS escalations FROM r WHERE k > 0""")
def governed_wakes(t: Tables) -> DataFrame:
    """Each event asks to wake one of seven agents; five wakes a day each, six hours between two of an issue."""
    own = windows.table_stream(timers.with_timers(t.spark), t.folder, "events")
    at = col("ts").cast("timestamp")
    rows = own.select((col("user_id") % 7).alias("agent"), col("user_id").alias("issue"), at.alias("at"), F.when(col("event_type") == "purchase", at).alias("touched"))
    decisions = timers.governed_wakes(rows, timers.WakeLimits(issue_seconds=6 * 3600, cap=5, window_seconds=24 * 3600, most_cleared=2))
    return naive(windows.run_to_table(decisions, shared_folder(t.spark, "wakes")), "at")


# bounded counters -----------------------------------------------------------------------------------------------------


@query("SELECT l_partkey, count(*) AS n, true AS within, true AS bounded FROM lineitem GROUP BY 1")
def bounded_counter(t: Tables) -> DataFrame:
    """For each part its exact count, and whether the bounded counter's bounds hold for it, kept or not."""
    most = 500
    rows = t.read("lineitem").select("l_partkey")
    counted = cut(aggregates.bounded_counts(rows, "l_partkey", most))
    whole = counted.agg(F.coalesce(F.max("floor"), F.lit(0)).alias("rest"), (F.count("*") <= most).alias("few"), (F.coalesce(F.max("most_held"), F.lit(0)) <= most + most // 10 + 1).alias("small"))
    exact = rows.groupBy("l_partkey").agg(F.count("*").alias("exact")).join(counted, "l_partkey", "left").crossJoin(F.broadcast(whole))
    within = F.coalesce(col("exact").between(col("n"), col("at_most")), col("exact") <= col("rest"))
    return exact.select("l_partkey", col("exact").alias("n"), within.alias("within"), (col("few") & col("small")).alias("bounded"))


# tables written in place ----------------------------------------------------------------------------------------------


@query("SELECT l_suppkey, count(*) AS n, CAST(sum(CASE WHEN l_suppkey % 2 = 1 THEN 2 ELSE 1 END * CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY 1")
def scoped_writes(t: Tables) -> DataFrame:
    """Suppliers are scopes; in one change some are replaced and some emptied, the others stay where they are."""
    rows = t.read("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", col("l_quantity").cast("long").alias("quantity"))
    table = stored.ScopedTable(t.spark, shared_folder(t.spark, "scopes"), ["l_suppkey"])
    table.replace(rows)
    changed = rows.select("l_suppkey").where("l_suppkey % 2 = 1 OR l_suppkey % 4 = 0")
    table.replace(rows.where("l_suppkey % 2 = 1").withColumn("quantity", col("quantity") * 2), changed)
    return table.read().groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query("""SELECT l_partkey AS symbol, CASE WHEN l_returnflag = 'R' THEN 'phase3' ELSE 'phase1' END AS phase, count(DISTINCT l_orderkey || ':' || l_linenumber || ':' || l_returnflag) AS postings FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_linenumber = 1) GROUP BY 1, 2""")
def indexed_postings(t: Tables) -> DataFrame:
    """Postings of all parts in a bucketed index; returned ones are replaced, some are removed."""
    rows = t.read("lineitem").select(col("l_partkey").alias("symbol"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_returnflag").alias("doc_key"), "l_returnflag", "l_linenumber", F.lit("phase1").alias("phase"))
    index = stored.PostingIndex(t.spark, f"postings_{uuid.uuid4().hex}", "symbol", "doc_key", buckets=8)
    index.add(rows.select("symbol", "doc_key", "phase"))
    index.add(rows.where("l_returnflag = 'R'").select("symbol", "doc_key", F.lit("phase3").alias("phase")))
    index.remove(rows.where("l_returnflag = 'A' AND l_linenumber = 1"))
    try:
        return cut(index.lookup_all(rows).groupBy("symbol", "phase").agg(F.count("*").alias("postings")))
    finally:
        index.drop()


# feeds and files in parts ---------------------------------------------------------------------------------------------


def _written(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows (name, content) as files of a folder that tasks and driver share; the names."""

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["name"], part["content"], strict=True):
                os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
                with open(f"{folder}/{name}.tmp", "wb") as file:
                    file.write(content)
                os.replace(f"{folder}/{name}.tmp", f"{folder}/{name}")  # a repeated attempt writes the same
            yield part[["name"]]

    return rows.mapInPandas(put, "name string")


def _local(t: Tables, name: str) -> str:
    return shared_folder(t.spark, name).removeprefix("file://")


@query("SELECT o_orderkey AS number, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS updated_at, o_orderpriority AS title FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01'")
def paged_feed(t: Tables) -> DataFrame:
    """Orders as a feed of pages of 200, newest first, read down to a time that has been seen."""
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    node = F.struct(col("o_orderkey").alias("number"), at.alias("updatedAt"), col("o_orderpriority").alias("title"))
    rows = ranked(t.read("orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), [F.desc("o_orderdate"), F.desc("o_orderkey")], "rank")
    pages = rows.groupBy(F.floor((col("rank") - 1) / 200).alias("page")).agg(F.collect_list(node).alias("nodes"))
    last = pages.agg(F.max("page")).first()[0]
    following = F.when(col("page") < (last or 0), (col("page") + 1).cast("string"))
    texts = pages.select(text("page-", F.when(col("page") > 0, col("page").cast("string")).otherwise(""), ".json").alias("name"), F.encode(F.to_json(F.struct(F.lit(500).alias("remaining"), "nodes", following.alias("next"))), "UTF-8").alias("content"))
    folder = _local(t, "pages")
    _written(texts.withColumn("content", F.encode(F.replace(F.decode("content", "UTF-8"), F.lit("}]}"), F.lit('}],"next":null}')), "UTF-8")), folder).count()
    found = paged.paged(t.spark, folder, since="1997-06-01T00:00:00Z")
    return found.select("number", "updated_at", F.get_json_object("node", "$.title").alias("title"))


@query("""SELECT 'f' || l_suppkey || '.py' AS file_path, 'pkg C' || l_partkey || '#run().' AS qualified_name, CASE WHEN l_linenumber = 1 THEN 'def' ELSE 'use' END AS kind, CAST(l_orderkey % 5000 AS INTEGER) AS line, l_linenumber AS col_start FROM lineitem""")
def split_index(t: Tables) -> DataFrame:
    """An index file of several documents for each nation and thousand of suppliers, read in ranges of a few documents."""
    n = col("l_linenumber")
    use = F.struct(text("scip-python pip pkg 1.0 C", col("l_partkey"), "#run().").alias("symbol"), F.when(n == 1, 1).otherwise(8).alias("roles"), F.array((col("l_orderkey") % 5000).cast("int"), n, n + 5).alias("span"))
    files = t.read("lineitem").groupBy("l_suppkey").agg(F.collect_list(use).alias("own")).withColumn("path", text("f", col("l_suppkey"), ".py"))
    one = files.join(t.read("supplier").select(col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").select("s_nationkey", F.floor(col("l_suppkey") / 1000).alias("block"), scip.encoded_index(col("path"), col("own")).alias("part"))
    # files grow in number with the table, not in length
    whole = one.groupBy("s_nationkey", "block").agg(F.unhex(F.array_join(F.collect_list(F.hex("part")), "")).alias("content"))
    folder = _local(t, "indexes")
    _written(whole.select(text(col("s_nationkey"), "-", col("block"), ".scip").alias("name"), "content"), folder).count()
    found = scip.split_occurrences(t.spark, folder, "sha", range_bytes=1 << 16)
    return found.select("file_path", "qualified_name", "kind", "line", "col_start")


@lru_cache(maxsize=10_000)
def _sample(line: int, quantity: int) -> bytes:
    """A sample whose leaf and thread go by a line's number; of the sixth no symbol, of the seventh no file."""
    field, coded = scip._field, scip._coded
    symbol = coded(3 << 3) + coded((1 << 64) - 1) if line == 6 else field(3, line)  # -1: no symbol
    leaf = field(1, line) + field(2, 2 if line == 7 else 1) + symbol
    return field(1, field(2, 10 + line % 3) + field(3, leaf) + field(3, field(1, 99)) + field(4, quantity - 1))


@query("""WITH s AS (SELECT l_suppkey AS trace, CASE l_linenumber WHEN 6 THEN 'lib.so!0x6' WHEN 7 THEN 'unknown' ELSE 'sym' || l_linenumber END AS symbol, CASE WHEN l_linenumber % 3 < 2 THEN 't' || l_linenumber % 3 END AS thread, CAST(sum(greatest(CAST(l_quantity AS BIGINT) - 1, 1)) AS BIGINT) AS cpu_samples FROM lineitem GROUP BY 1, 2, 3)
SELECT trace, symbol, thread, cpu_samples, round(cpu_samples / sum(cpu_samples) OVER (PARTITION BY trace), 9) AS cpu_share FROM s""")
def binary_profiles(t: Tables) -> DataFrame:
    """A profile of each supplier's lines: files, symbols and threads by reference, some of them dangling."""
    field = scip._field

    def encode(group: pd.DataFrame) -> pd.DataFrame:
        symbols = b"".join(field(3, s.encode()) for s in ("sym0", "sym1", " sym2 ", "", "sym4", "sym5")) + b"".join(field(4, s.encode()) for s in ("", "", "", "sym3"))
        out = [field(3, field(1, 1) + field(2, b"lib.so") + symbols), field(4, field(1, 10) + field(3, b"t0")), field(4, field(1, 11) + field(3, b"t1"))]
        out += [_sample(int(line), int(quantity)) for line, quantity in zip(group["l_linenumber"], group["l_quantity"], strict=True)]
        body = b"".join(len(r).to_bytes(4, "little") + r for r in out)
        content = profiles.MAGIC + (1).to_bytes(2, "little") + body + bytes(4)
        return pd.DataFrame({"path": [str(group["l_suppkey"].iloc[0])], "length": [len(content)], "content": [content]})

    files = t.read("lineitem").select("l_suppkey", "l_linenumber", "l_quantity").groupBy("l_suppkey").applyInPandas(encode, "path string, length long, content binary")
    found, _ = profiles.profiles(files)
    return rounded(found.select(col("path").cast("long").alias("trace"), "symbol", "thread", "cpu_samples", "cpu_share"), "cpu_share", digits=9)


@query()
def abi_selectors(t: Tables) -> DataFrame:
    """The selector of a function named after each part. No SQL here has this digest; tests hold published values."""
    signature = F.concat(F.regexp_replace("p_name", "[^A-Za-z]", ""), F.when(col("p_size") % 2 == 0, "(address,uint256)").otherwise("()"))
    return t.read("part").select("p_partkey", signature.alias("signature"), keccak.selector(signature).alias("selector"))


# ownership by what has changed ----------------------------------------------------------------------------------------


@query(f"WITH {OWNERS} SELECT path, author, round(weight + 1e-9, 6) AS weight, round(blame_share + 1e-9, 6) AS blame_share, round(churn_share + 1e-9, 6) AS churn_share, lines_attributed, commit_count FROM owners WHERE weight > 0")
def incremental_ownership(t: Tables) -> DataFrame:
    """Ownership of a state of half a year ago, with the files touched since computed anew from it: equal to the whole."""
    now = t.last_commit()
    then = F.lit(now) - F.expr("interval 180 days")
    commits, touched, authors, blame, parts = t.commits(), t.touched(), t.authors(), t.blame(), t.parts("lineitem")
    old, new = commits.where(col("committed_at") <= then), commits.where(col("committed_at") > then)
    state = cut(history.ownership_state(blame, history.recency_churn(touched, old, authors, then, parts=parts), then, parts))
    files = touched.join(new.select("sha"), "sha", "left_semi").select("path").distinct().withColumn("state", F.lit("dirty"))
    fresh = history.refreshed_state(state, blame, history.recency_churn(touched, new, authors, F.lit(now), parts=parts), files, F.lit(now), parts=parts)
    whole = state.repartition(parts, "path").join(files.select("path"), "path", "left_anti").unionByName(fresh)
    lifted = {c: F.col(c) + 1e-9 for c in ("weight", "blame_share", "churn_share")}
    return rounded(history.ownership_of_state(whole, parts=parts).drop("last_touched_at").withColumns(lifted), *lifted)


