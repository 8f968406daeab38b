import json
import zlib

import pytest

from quarrylight.llm import sharding as op
from tests.llm import cases


def test_rows_stay_as_they_are(spark, tmp_path):
    docs = cases.table(spark, clashing=True)
    store = op.shard(docs.repartition(6), f"file://{tmp_path}/s", arrivals=3, target_bytes=200_000)
    assert store.read().columns == docs.columns
    assert cases.plain_rows(store.read()) == cases.plain_rows(docs)


def test_similar_sizes_merge_up_to_the_target(spark, tmp_path):
    store = op.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=60_000, fanout=4, smallest=1_000)
    docs = cases.table(spark, [(k, cases.prose(k, 300), "xa", "s", 1) for k in range(64)])
    for k in range(4):
        store.append(docs.where(f"doc_id % 4 = {k}").repartition(8))
    before = store.manifest()["shards"]
    assert len(before) == 32 and store.versions() == [1, 2, 3, 4]
    store.compact()
    after = store.manifest()["shards"]
    assert len(after) < 12 and max(x["bytes"] for x in after) < 1.3 * 60_000
    assert not store.plan(after)
    assert store.read(2).count() == 32 and store.read().count() == 64  # old versions can be read
    store.vacuum()  # all of it is young
    assert store.versions()[0] == 1 and store.read(2).count() == 32
    store.vacuum(older_than_seconds=0)
    assert len(store.versions()) == 1  # no manifest is left that points at nothing
    assert cases.plain_rows(store.read()) == cases.plain_rows(docs)


def test_runs_are_planned_within_tiers(spark, tmp_path):
    store = op.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1_000, fanout=3, smallest=10)
    shards = [{"file": str(k), "bytes": n} for k, n in enumerate([12, 13, 14, 400, 500, 1_000, 2_000])]
    assert [[x["bytes"] for x in run] for run in store.plan(shards)] == [[12, 13, 14]]
    assert store.plan(shards[:2]) == [] and store.plan([]) == []


def test_only_one_writer_commits_a_version(spark, tmp_path):
    one, two = (op.ShardStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    one.append(cases.table(spark).limit(3))
    with pytest.raises(Exception, match="(?i)exist"):
        two._commit(1, None, [])
    assert len(one.manifest()["shards"]) >= 1 and one.versions() == [1]


def test_a_writer_that_comes_second_adds_to_the_newer_version(spark, tmp_path):
    one, two = (op.ShardStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    one.append(cases.table(spark).limit(3))
    stale, calls = two.manifest(), []
    own = two.manifest
    two.manifest = lambda version=None: stale if not calls.append(1) and len(calls) <= 2 else own(version)  # reads before the other's commit
    one.append(cases.table(spark).limit(2))
    assert two.append(cases.table(spark).limit(4)) == 3
    assert own()["version"] == 3 and two.read().count() == 9


def test_a_change_writes_only_the_parts_it_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "MOST_IN_PART", 3)
    store = op.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=60_000, fanout=4, smallest=1_000)
    docs = cases.table(spark, [(k, cases.prose(k, 300), "xa", "s", 1) for k in range(40)])
    store.append(docs.where("doc_id < 32").repartition(8))
    first = store._root_of(1)["parts"]
    assert sorted(first.values()) == [2, 3, 3]
    store.append(docs.where("doc_id >= 32").coalesce(1))
    second = store._root_of(2)["parts"]
    assert first.items() < second.items() and len(second) == 4  # the old parts stay, one is new
    assert len(store.manifest(1)["shards"]) == 8 and len(store.manifest()["shards"]) == 9
    store.compact()
    store.vacuum(older_than_seconds=0)
    left = {x.name.removesuffix(".json") for x in (tmp_path / "s/parts").iterdir() if x.name.endswith(".json")}
    assert left == set(store._root_of(store.versions()[-1])["parts"])
    assert cases.plain_rows(store.read()) == cases.plain_rows(docs)


def test_an_unfinished_write_is_not_seen(spark, tmp_path):
    store = op.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(cases.table(spark))
    cases.table(spark).write.parquet(f"{tmp_path}/s/data/v00000002-broken")  # a writer lost before its commit
    assert store.read().count() == len(cases.rows())
    store.vacuum()
    assert (tmp_path / "s/data/v00000002-broken").exists()  # its writer may still be at work
    store.vacuum(older_than_seconds=0)
    assert not (tmp_path / "s/data/v00000002-broken").exists()
    assert json.loads((tmp_path / "s/manifests/v00000001.json").read_text())["version"] == 1


def test_the_query_covers_all_rows(spark, tmp_path):
    at = cases.folder(spark, str(tmp_path), cases.table(spark, clashing=True))
    found = op.op7_sharding(spark, at).collect()
    want = [(r[0], None if r[1] is None else len(r[1].encode()), None if r[1] is None else zlib.crc32(r[1].encode())) for r in cases.rows()]
    assert sorted(((r["doc_id"], r["text_bytes"], r["text_crc32"]) for r in found), key=repr) == sorted(want, key=repr)


def test_every_row_lies_in_the_shard_named(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    at = cases.folder(spark, str(tmp_path / "in"), cases.table(spark))
    before = set(glob.glob("/tmp/quarrylight-*/shards-*"))
    found = op.op7_sharding(spark, at).collect()
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    newest = max(set(glob.glob(f"{shared}/shards-*")) - before, key=lambda x: __import__("os").path.getmtime(x))
    held = [(x.rsplit("/", 1)[1], d) for x in glob.glob(f"{newest}/store/data/*/part-*.parquet") for d in pq.read_table(x).column("doc_id").to_pylist()]
    assert sorted(((r["shard"], r["doc_id"]) for r in found), key=repr) == sorted(held, key=repr)


def test_empty_arrivals(spark, tmp_path):
    store = op.shard(cases.table(spark, []), f"file://{tmp_path}/s")
    assert store.read().count() == 0 and store.read().columns == ["doc_id", "text", "lang", "source", "n_chars"]
