"""Readers of feeds in pages, indexes in ranges, binary profiles; digests of contracts."""

import hashlib
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import keccak
from quarrylight.sources import gitlog, paged, profiles, scip
from quarrylight.sources.scip import _coded as coded
from quarrylight.sources.scip import _field as field

# feeds in pages -------------------------------------------------------------------------------------------------------


def put_feed(folder, nodes, size=3, remaining=500):
    folder.mkdir(exist_ok=True)
    nodes = sorted(nodes, key=lambda n: (n["updatedAt"], n["number"]), reverse=True)
    pages = [nodes[k : k + size] for k in range(0, len(nodes), size)] or [[]]
    for k, own in enumerate(pages):
        following = str(k + 1) if k + 1 < len(pages) else None
        (folder / f"page-{k or ''}.json").write_text(json.dumps({"remaining": remaining, "nodes": own, "next": following}))


def node(number, minute):
    return {"number": number, "updatedAt": f"2026-01-01T00:{minute:02d}:00Z", "title": f"t{number}"}


def streamed(spark, folder, tmp_path, **options):
    stream = paged.paged(spark, str(folder), stream=True, pause="0.01", **options)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sorted((r["number"], r["updated_at"][14:16]) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    nodes = [node(k, k) for k in range(1, 11)]
    put_feed(tmp_path / "feed", nodes)
    want = [(k, f"{k:02d}") for k in range(1, 11)]
    assert streamed(spark, tmp_path / "feed", tmp_path) == want
    assert streamed(spark, tmp_path / "feed", tmp_path) == want  # nothing new, nothing doubled
    later = [n for n in nodes if n["number"] != 4] + [node(4, 12), node(11, 10), node(12, 12)]  # one changed, one of the time last seen
    put_feed(tmp_path / "feed", later)
    assert streamed(spark, tmp_path / "feed", tmp_path) == sorted([*want, (4, "12"), (11, "10"), (12, "12")])


def test_since_leaves_older_pages_unread(spark, tmp_path):
    put_feed(tmp_path / "feed", [node(k, k) for k in range(1, 13)])
    (tmp_path / "feed" / "page-3.json").unlink()  # the oldest page isn't asked for
    found = paged.paged(spark, str(tmp_path / "feed"), since="2026-01-01T00:06:00Z", pause="0.01")
    assert sorted(r["number"] for r in found.collect()) == list(range(6, 13))
    with pytest.raises(Exception, match="No such file"):
        paged.paged(spark, str(tmp_path / "feed"), pause="0.01").collect()


def test_few_calls_end_the_reading(spark, tmp_path):
    put_feed(tmp_path / "feed", [node(1, 1)], remaining=99)
    with pytest.raises(Exception, match="99 calls remain"):
        paged.paged(spark, str(tmp_path / "feed")).collect()
    assert paged.paged(spark, str(tmp_path / "feed"), floor="99").count() == 1


def test_a_page_that_fails_twice_is_had(spark, tmp_path):
    put_feed(tmp_path / "feed", [node(k, k) for k in range(1, 5)])
    tried = {}

    class Failing(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            cursor = self.path.partition("cursor=")[2]
            tried[cursor] = tried.get(cursor, 0) + 1
            if tried[cursor] <= fails:
                return self.send_error(502)
            self.send_response(200)
            self.end_headers()
            self.wfile.write((tmp_path / "feed" / f"page-{cursor}.json").read_bytes())

        def log_message(self, *args): ...

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Failing) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        address = f"http://127.0.0.1:{server.server_port}/feed"
        fails = 2
        assert streamed(spark, address, tmp_path) == [(k, f"{k:02d}") for k in range(1, 5)]
        tried.clear()
        fails = 3
        with pytest.raises(Exception, match="502"):
            paged.paged(spark, address, pause="0.01").collect()
        server.shutdown()


# indexes in ranges ----------------------------------------------------------------------------------------------------


def index_of(documents, uses):
    return b"".join(scip.index_bytes(f"src/f{k}.py", "python", ((f"scip-python pip p 1.0 C{k}#m{u}().", 1 if u == 0 else 8, [u, 1, 4]) for u in range(uses))) for k in range(documents))


def seen(df):
    return sorted(((r["error"], r["file_path"], r["symbol"], r["kind"], r["line"], r["col_end"]) for r in df.collect()), key=repr)


def test_ranges_give_what_whole_files_give(spark, tmp_path):
    for name, content in {"a": field(1, b"meta") + index_of(40, 5), "b c": index_of(3, 200), "empty": b"", "one": index_of(1, 1)}.items():
        (tmp_path / f"{name}.scip").write_bytes(content)
    whole = seen(scip.scip_occurrences(spark, str(tmp_path), "sha"))
    for size in (1, 700, 5000, 1 << 20):
        assert seen(scip.split_occurrences(spark, str(tmp_path), "sha", size, tasks=5)) == whole
    assert len(whole) == 40 * 5 + 600 + 1


def test_a_file_that_is_cut_off_gives_its_whole_documents_and_one_error(spark, tmp_path):
    content = index_of(20, 5)
    (tmp_path / "cut.scip").write_bytes(content[:-7])
    (tmp_path / "noise.scip").write_bytes(b"\x12\xff\x01abc")
    found = scip.split_occurrences(spark, str(tmp_path), "sha", 500)
    assert sorted((r["source"][-8:], r["error"], r["n"]) for r in found.groupBy("source", "error").count().withColumnRenamed("count", "n").collect() if r["error"]) == [("cut.scip", "malformed", 1), ("ise.scip", "malformed", 1)]
    assert found.where("error is null").count() == 19 * 5
    assert [r["error"] for r in scip.split_occurrences(spark, str(tmp_path), "sha", most_bytes=3).collect()] == ["too_large"] * 2


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    padding = "x" * 4000  # long names, so that the file is large and quickly read
    document = scip.index_bytes("src/f.py", "python", ((f"scip-python pip p 1.0 {padding}{u}#m().", 8, [u, 1, 4]) for u in range(250)))
    with (tmp_path / "large.scip").open("wb") as file:
        for _ in range(200):
            file.write(document)
    size = (tmp_path / "large.scip").stat().st_size
    assert size > 190 << 20
    found = scip.split_occurrences(spark, str(tmp_path), "sha", 4 << 20, tasks=16)
    from pyspark.sql import functions as F

    tasks = found.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in tasks) == 200 * 250
    assert len(tasks) > 8 and max(r["n"] for r in tasks) < 200 * 250 / 3  # no task holds more than a few ranges


# binary profiles ------------------------------------------------------------------------------------------------------


def profile(*records, end=bytes(4), version=1):
    return profiles.MAGIC + version.to_bytes(2, "little") + b"".join(len(r).to_bytes(4, "little") + r for r in records) + end


def sample(thread, count, *chain):
    return field(1, field(2, thread) + b"".join(field(3, field(1, a) + field(2, f) + (field(3, s) if s >= 0 else coded(3 << 3) + coded((1 << 64) + s))) for a, f, s in chain) + field(4, count))


def test_profiles(spark):
    named = field(3, field(1, 1) + field(2, b"lib.so") + field(3, b" f ") + field(3, b"") + field(3, b"") + field(4, b"_f") + field(4, b"_g"))
    other = field(3, field(1, 2) + field(2, b" "))
    good = profile(named, other, field(4, field(1, 7) + field(3, b"main")), sample(7, 10, (1, 1, 0), (9, 1, 1)), sample(7, 0, (1, 1, 0)), sample(8, 4, (2, 1, 1)), sample(8, 3, (0x1F, 1, 2)), sample(8, 2, (5, 1, -1)), sample(8, 1, (5, 2, 0)), sample(8, 1))
    files = {
        "good": good, "late": profile(sample(7, 5, (1, 1, 0)), named), "none": profile(named), "short": b"SIMPLE", "other": b"NOPROFILE_1" + bytes(9), "old": profile(version=2),
        "cut": good[:-7], "bad": profile(sample(1, 1), b"\x0a\xff"), "open": profile(sample(1, 1), end=b""), "stop": profile(sample(1, 2)) + b"\xff" * 9,
    }
    rows = [(k, len(v), v) for k, v in files.items()] + [("big", 65 << 20, b"")]
    found, errors = profiles.profiles(spark.createDataFrame(rows, "path string, length long, content binary"))
    got = {(r["path"], r["symbol"], r["thread"]): (r["cpu_samples"], round(r["cpu_share"], 4), r["hot"]) for r in found.collect()}
    assert {k[1:]: v for k, v in got.items() if k[0] == "good"} == {
        ("f", "main"): (11, 0.5, True), ("_g", None): (4, 0.1818, True), ("lib.so!0x1f", None): (3, 0.1364, True), ("lib.so!0x5", None): (2, 0.0909, True), ("unknown", None): (2, 0.0909, True),
    }
    assert got["late", "f", None] == (5, 1.0, True) and got["open", "unknown", None][0] == 1 and got["stop", "unknown", None][0] == 2
    assert sorted((r["path"], r["error"]) for r in errors.collect()) == [("bad", "malformed"), ("big", "too_large"), ("cut", "truncated"), ("none", "no_samples"), ("old", "version"), ("other", "no_header"), ("short", "truncated")]
    assert {k[0] for k in got} == {"good", "late", "open", "stop"}


# digests --------------------------------------------------------------------------------------------------------------


def test_published_digests():
    of = lambda m: keccak.keccak([m])[0].hex()
    assert of(b"") == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert of(b"abc") == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    assert of(b"The quick brown fox jumps over the lazy dog") == "4d741b6f1eb29cb2a9b9911c82f56fa8d73b04959d3d9d222895df6c0b28aa15"


def test_the_permutation_is_that_of_the_standard():
    """The standard's hash differs in its padding alone: a message that ends in its suffix bits has the same digest."""
    for size in (0, 1, 134, 135, 136, 137, 300):
        message = bytes(k % 251 for k in range(size))
        lanes = sponge_with_suffix(message)
        assert lanes == hashlib.sha3_256(message).digest()


def sponge_with_suffix(message, rate=136):
    import numpy as np

    padded = bytearray(message + bytes(rate - len(message) % rate))
    padded[len(message)] ^= 0x06
    padded[-1] ^= 0x80
    lanes = [np.zeros(1, np.uint64) for _ in range(25)]
    for b in range(0, len(padded), rate):
        words = np.frombuffer(bytes(padded[b : b + rate]), "<u8")
        for k in range(rate // 8):
            lanes[k] = lanes[k] ^ words[k : k + 1]
        lanes = keccak.permuted(lanes)
    return np.concatenate(lanes[:4]).astype("<u8").tobytes()


def test_selectors(spark):
    known = {"transfer(address,uint256)": "0xa9059cbb", "owner()": "0x8da5cb5b", "balanceOf(address)": "0x70a08231", "approve(address,uint256)": "0x095ea7b3", None: None, "f(" + "uint256," * 60 + "bool)": None}
    found = spark.createDataFrame([(k,) for k in known], "s string").select("s", keccak.selector("s").alias("x")).collect()
    got = {r["s"]: r["x"] for r in found}
    long = next(k for k in known if k and len(k) > 200)
    assert got.pop(long) == "0x" + keccak.keccak([long.encode()])[0].hex()[:8]
    known.pop(long)
    assert got == known


def test_indexes_are_encoded_without_python(spark):
    """A batch of occurrences is many times its size as objects of Python."""
    rows = [("src/\u00e4.py", [("pkg \u20ac#m().", 1, [0, 127, 128]), ("x" * 300, 8, [70_000, 16_384, 2_097_151, 300_000_000])]), ("", [])]
    own = spark.createDataFrame(rows, "path string, own array<struct<symbol string, roles int, span array<int>>>").select("path", scip.encoded_index(F.col("path"), F.col("own")).alias("content"))
    assert {r["path"]: bytes(r["content"]) for r in own.collect()} == {p: scip.index_bytes(p, "python", o) for p, o in rows}
    assert "Python" not in own._jdf.queryExecution().toString()


def test_diff_needs_no_exchange(spark):
    a = "diff --git a/o.py b/n.py\nindex 1..2\n--- a/o.py\n+++ b/n.py\n@@ -1 +1 @@ f\n kept\n-gone\n+++ new\n+x\r\n@@ -9 +9 @@\n--- old\n"
    b = "diff --git a/bin b/bin\nBinary files differ\n"
    c = "diff --git a/d b/d\n--- a/d\n+++ /dev/null\n@@ -1 +0 @@\n-x"
    blobs = spark.createDataFrame([("k", "preamble\n+++ b/no\n" + a + b + c), ("l", c), ("m", "nothing"), ("n", None)], "blob string, text string")
    found = gitlog.diff(blobs)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("k", "n.py", "o.py", 2, 2, 2), ("k", None, None, 0, 0, 0), ("k", None, "d", 1, 0, 1), ("l", None, "d", 1, 0, 1)], key=repr)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_pages_share_tasks(spark, tmp_path):
    nodes = [{"number": k, "updatedAt": f"2026-01-01T00:{k // 60:02d}:{k % 60:02d}Z"} for k in range(60)]
    put_feed(tmp_path / "feed", nodes, size=3)
    found = paged.paged(spark, str(tmp_path / "feed"))
    assert sorted(r["number"] for r in found.collect()) == list(range(60)) and found.rdd.getNumPartitions() == 1
    few = paged.paged(spark, str(tmp_path / "feed"), pages="3")
    assert sorted(r["number"] for r in few.collect()) == list(range(60)) and few.rdd.getNumPartitions() == 7


def test_a_profile_is_read_once(spark):
    leaf = field(3, field(1, 5) + field(2, 1) + field(3, 0))
    records = [field(3, field(1, 1) + field(2, b"l.so") + field(3, b"main"))] + [field(1, field(2, 9) + leaf + field(4, n)) for n in (0, 2, 2, 2)]
    body = profiles.MAGIC + (1).to_bytes(2, "little") + b"".join(len(r).to_bytes(4, "little") + r for r in records) + bytes(4)
    rows = spark.createDataFrame([("a", len(body), body)], "path string, length long, content binary")
    read = profiles.profile_records(rows).where("kind = 'sample'").collect()
    assert [(r["weight"], r["symbol_id"]) for r in read] == [(7, 0)]
    found, errors = profiles.profiles(rows)
    assert [(r["symbol"], r["cpu_samples"]) for r in found.collect()] == [("main", 7)] and errors.count() == 0
    assert "MapInPandas" not in found._jdf.queryExecution().toString()
