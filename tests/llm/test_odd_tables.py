"""Every query on tables with nulls, repeated rows, clashing names, very long texts, and on empty ones."""

import pytest

from quarrylight.llm import registry
from tests.llm import cases


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    return {
        "odd": cases.folder(spark, str(at / "odd"), cases.table(spark, clashing=True)),
        "empty": cases.folder(spark, str(at / "empty"), cases.table(spark, [])),
        "nulls": cases.folder(spark, str(at / "nulls"), cases.table(spark, [(None,) * 5] * 3)),
    }


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
@pytest.mark.parametrize("kind", ["odd", "empty", "nulls"])
def test_query(spark, folders, name, kind):
    rows = registry.QUERIES[name](spark, folders[kind]).collect()
    if name == "op10_packing":
        assert {r["doc_id"] for r in rows} == {r[0] for r in {"odd": cases.rows(), "empty": [], "nulls": [(None,)]}[kind]}
        return
    if name == "op13_spelling":  # a row a word
        assert bool(rows) == (kind == "odd") and all(r["n"] >= 2 and len(r["word"]) >= 7 for r in rows)
        return
    assert len(rows) == {"odd": len(cases.rows()), "empty": 0, "nulls": 3}[kind]
    if name != "op7_sharding" and kind == "nulls":  # repeated rows get equal values
        assert len({repr(r) for r in rows}) == 1
