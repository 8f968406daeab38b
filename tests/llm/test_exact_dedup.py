import hashlib
import os
from collections import defaultdict

import duckdb
import pytest

from quarrylight.llm import common
from quarrylight.llm import exact_dedup as op
from tests.llm import cases


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        ids = groups[text or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_against_brute_force(spark, batches):
    found = op.exact_dedup(cases.table(spark), buckets=4, batches=batches)
    assert cases.plain_rows(found) == brute(cases.rows())


@pytest.mark.parametrize("ids", [[1, 5 * 10**18, 4], [-(2**63), 2**63 - 1, 0], [-(2**63)] * 3, [hash((k, "x")) for k in range(40)]])
@pytest.mark.parametrize("batches", [1, 2, 5])
def test_any_two_longs(spark, ids, batches):
    rows = [(x, f"text {k % 2}") for k, x in enumerate(ids)]
    found = op.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), buckets=4, batches=batches)
    assert cases.plain_rows(found) == brute(rows)


def test_only_a_named_index_stays(spark):
    name = "digest_index_that_stays"
    op.DigestIndex(spark, name).drop()
    before = {t.name for t in spark.catalog.listTables()}
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    op.exact_dedup(table([(1, "a"), (2, "a")]), buckets=4).collect()
    assert {t.name for t in spark.catalog.listTables()} == before
    op.exact_dedup(table([(1, "a"), (2, "a"), (3, "b")]), buckets=4, index=name).collect()
    later = op.exact_dedup(table([(8, "a"), (9, "c")]), index=name)
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in later.collect()} == {(8, 2, False), (9, 9, True)}
    op.DigestIndex(spark, name).drop()


def test_an_index_without_a_name_needs_no_warehouse(spark, monkeypatch):
    def unnamed(_):
        raise ValueError("spark.sql.warehouse.dir has to name a folder that driver and executors share")

    seen, drop = [], op.DigestIndex.drop

    def seen_first(index):
        at = index.spark.sql(f"DESCRIBE FORMATTED {index.table}").where("col_name = 'Location'").first()["data_type"].removeprefix("file:")
        seen.append((at, os.path.isdir(at)))
        drop(index)

    monkeypatch.setattr(op, "shared_warehouse", unnamed)
    monkeypatch.setattr(op.DigestIndex, "drop", seen_first)
    assert cases.plain_rows(op.exact_dedup(cases.table(spark), buckets=4)) == brute(cases.rows())
    shared, ((at, there),) = common.shared_folder(spark).removeprefix("file://"), seen
    assert at.startswith(f"{shared}/") and there and not os.path.exists(at)
    with pytest.raises(ValueError):
        op.exact_dedup(cases.table(spark), buckets=4, index="digest_index_of_no_warehouse")


def test_sql_gives_the_same(spark):
    at = cases.sf()
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{at}/documents.parquet'")
    want = db.execute(op.ORACLE["op2_exact_dedup"]).fetchall()
    got = op.op2_exact_dedup(spark, at).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert cases.plain_rows(got) == sorted(want, key=repr)


def test_the_index_persists_over_batches(spark):
    index = op.DigestIndex(spark, "digest_index_of_a_test", buckets=4)
    index.drop()
    batch = lambda rows: op.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    index.add(batch([(1, "a"), (2, "a"), (3, "b")]))
    index = op.DigestIndex(spark, index.table)  # another program goes on with it
    assert index.buckets == 4
    index.add(batch([(9, "a"), (10, "c"), (None, "d")]))
    held = {bytes(r["digest"]): r["keep_id"] for r in index.rows().collect()}
    sha = lambda x: hashlib.sha256(x.encode()).digest()
    assert held == {sha("a"): 2, sha("b"): 3, sha("c"): 10, sha("d"): None}
    plan = batch([(1, "a")]).join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan
    index.drop()


def test_no_python_on_the_main_path(spark):
    plan = op.exact_dedup(cases.table(spark), buckets=4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_one_copy_stays_with_its_columns(spark):
    docs = cases.table(spark, clashing=True)
    kept = op.drop_copies(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert len(got) == len({r["text"] or "" for r in got}) == len({r[1] or "" for r in cases.rows()})
    assert {r["doc_id"] for r in got if r["text"] == cases.prose(3, 63)} == {104}
    assert all(r["digest"] == "own digest" for r in got)
