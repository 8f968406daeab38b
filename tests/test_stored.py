import pytest

from quarrylight.api import Engine
from quarrylight.operators import aggregates, stored


def rows_of(spark, *rows):
    return spark.createDataFrame(rows, "scope string, k long, v string")


def shown(df):
    return sorted(((r["scope"], r["k"], r["v"]) for r in df.collect()), key=repr)


def test_scopes_are_replaced_as_a_whole(spark, tmp_path):
    table = stored.ScopedTable(spark, str(tmp_path / "t"), ["scope"])
    table.replace(rows_of(spark, ("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), (None, 9, "x")))
    table.replace(rows_of(spark, ("a", 3, "y")))
    assert shown(table.read()) == sorted([("a", 3, "y"), ("b", 1, "x"), (None, 9, "x")], key=repr)
    table.replace(rows_of(spark, (None, 8, "z")), spark.createDataFrame([(None,), ("b",)], "scope string"))  # b is emptied
    assert shown(table.read()) == sorted([("a", 3, "y"), (None, 8, "z")], key=repr)
    assert shown(table.read(table.versions()[0])) == sorted([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), (None, 9, "x")], key=repr)
    with pytest.raises(ValueError):
        table.replace(rows_of(spark, ("c", 1, "x")), spark.createDataFrame([("a",)], "scope string"))
    assert len(table.vacuum(keep=1)) == 2  # of the first change, whose scopes are all gone, and of the one that failed
    assert shown(table.read()) == sorted([("a", 3, "y"), (None, 8, "z")], key=repr)


def test_a_writer_that_dies_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    table = stored.ScopedTable(spark, str(tmp_path / "t"), ["scope"])
    table.replace(rows_of(spark, ("a", 1, "old"), ("b", 1, "old")))

    def killed(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(stored.ScopedTable, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            table.replace(rows_of(spark, ("a", 2, "new"), ("b", 2, "new")))
    again = stored.ScopedTable(spark, str(tmp_path / "t"), ["scope"])
    assert shown(again.read()) == [("a", 1, "old"), ("b", 1, "old")]
    again.replace(rows_of(spark, ("b", 3, "newer")))
    assert shown(again.read()) == [("a", 1, "old"), ("b", 3, "newer")]


def test_a_slower_writer_begins_anew(spark, tmp_path, monkeypatch):
    table = stored.ScopedTable(spark, str(tmp_path / "t"), ["scope"])
    table.replace(rows_of(spark, ("a", 1, "x"), ("b", 1, "x")))
    plain, calls = stored.ScopedTable._commit, []

    def overtaken(self, staged, version):
        if not calls:
            calls.append(version)
            stored.ScopedTable(spark, str(tmp_path / "t"), ["scope"]).replace(rows_of(spark, ("b", 2, "other")))
        return plain(self, staged, version)

    monkeypatch.setattr(stored.ScopedTable, "_commit", overtaken)
    table.replace(rows_of(spark, ("a", 2, "mine")))
    assert shown(table.read()) == [("a", 2, "mine"), ("b", 2, "other")] and len(table.versions()) == 3


def test_postings_are_read_from_one_bucket(spark):
    index = stored.PostingIndex(spark, "postings_test", "symbol", "doc_key", buckets=4)
    index.drop()
    try:
        rows = spark.range(400).selectExpr("id % 40 AS symbol", "concat('d', id) AS doc_key", "'p1' AS phase", "id % 2 AS commit")
        index.add(rows)
        index.add(spark.createDataFrame([(7, "d7", "p2", 1), (7, "new", "p1", 0)], "symbol long, doc_key string, phase string, commit long"))
        index.remove(spark.createDataFrame([(7, "d47"), (7, "unknown")], "symbol long, doc_key string"))
        found = index.lookup(7)
        assert "SelectedBucketsCount: 1 out of 4" in found._jdf.queryExecution().toString()
        keys = sorted(r["doc_key"] for r in found.collect())
        assert keys == sorted([f"d{k}" for k in range(7, 400, 40) if k != 47] + ["new"])  # one posting a key
        assert [r["doc_key"] for r in index.lookup(7, phase=["p2", "p3"], commit=1).collect()] == ["d7"]
        many = index.lookup_all(spark.createDataFrame([(7,), (8,), (999,)], "symbol long"))
        assert many.count() == 20
        plan = index.postings()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan  # grouped within the buckets
        assert index.postings().count() == 400
    finally:
        index.drop()


def test_questions_are_served_from_indexes(spark):
    occurrences = spark.range(300).selectExpr("concat('s', id % 30) AS symbol", "id AS doc_key", "IF(id % 2 = 0, 'p', 'q') AS project")
    postings = spark.range(300).selectExpr("id % 30 AS symbol_id", "concat('d', id) AS doc_key", "IF(id % 3 = 0, 'p1', 'p2') AS phase", "concat('c', id % 2) AS commit_sha")
    by_symbol, by_id = stored.PostingIndex(spark, "served_occurrences", "symbol", "doc_key", 8), stored.PostingIndex(spark, "served_postings", "symbol_id", "doc_key", 8)
    tables = {"runs": spark.createDataFrame([("p",)], "project string"), "evicted": occurrences.where("doc_key = 2"), "occurrences": occurrences, "postings": postings}
    try:
        by_symbol.drop()
        by_id.drop()
        by_symbol.add(occurrences)
        by_id.add(postings)
        plain, served = Engine(tables), Engine(tables, indexes={"occurrences": by_symbol, "postings": by_id})
        rows = lambda df: sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=repr)
        assert rows(plain.find_references(["s2", "s4", "none"], "p")) == rows(served.find_references(["s2", "s4", "none"], "p"))
        assert "SelectedBucketsCount: 1 out of 8" in served.find_references(["s2"], "p")._jdf.queryExecution().toString()
        found = served.find_occurrences(6, ["p1"], "c0")
        assert rows(found) == rows(plain.find_occurrences(6, ["p1"], "c0")) and found.count() == 10
        assert "SelectedBucketsCount: 1 out of 8" in found._jdf.queryExecution().toString()
    finally:
        by_symbol.drop()
        by_id.drop()


@pytest.mark.parametrize("most", [1, 7, 50, 1000])
def test_bounded_counts(spark, most):
    values = [k % (k % 13 + 1) * 100 + k % 7 for k in range(3000)] + list(range(10_000, 10_500))
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "key long").repartition(3)
    found = aggregates.bounded_counts(rows, "key", most).collect()
    exact = {v: values.count(v) for v in set(values)}
    assert len(found) == min(most, len(exact))
    for r in found:
        assert r["n"] <= exact[r["key"]] <= r["at_most"] and r["most_held"] <= most + most // 10 + 1
    rest = exact.keys() - {r["key"] for r in found}
    assert all(exact[k] <= found[0]["floor"] for k in rest)
    if most == 1000:
        assert {r["key"]: r["n"] for r in found} == exact and found[0]["floor"] == 0
    assert aggregates.bounded_counts(rows.where("key < 0"), "key", most).count() == 0
