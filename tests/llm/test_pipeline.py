import corpus_pipeline
from quarrylight.llm import exact_dedup, quality
from tests.llm import cases
from tests.llm.test_near_copies import brute as without_near_copies
from tests.llm.test_packing import check
from tests.llm.test_passages import brute as without_passages


def brute(rows, rejected):
    """rows: (doc_id, text). What the stages keep, as (doc_id, text)."""
    kept = [r for r in rows if r[0] not in rejected]
    by_text = {}
    for doc_id, text in kept:
        by_text[text or ""] = max(by_text.get(text or "", doc_id), doc_id)
    kept = [(d, t) for t, d in by_text.items()]
    stay = set(without_near_copies(kept))
    kept = [r for r in kept if r[0] in stay]
    texts = without_passages([t.encode() for _, t in kept])
    return [(d, t) for (d, _), t in zip(kept, texts, strict=True)]


def test_all_stages_against_brute_force(spark):
    at = cases.sf()
    docs = spark.read.parquet(f"{at}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = quality.quality_posteriors(docs, spark.read.parquet(f"{at}/labels.parquet"))
    rejected = {r["doc_id"] for r in found.where("quality < 0.2").collect()}
    want = brute(rows, rejected)
    check(want, corpus_pipeline.run(spark, at).collect())
    assert 0 < len(want) < len(rows)


def test_stages_take_odd_tables(spark, tmp_path):
    for name, own, clashing in (("odd", None, True), ("empty", [], True)):
        at = cases.folder(spark, str(tmp_path / name), cases.table(spark, own, clashing))
        docs = spark.read.parquet(f"{at}/documents.parquet")
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, at).write.parquet(str(tmp_path / f"{name}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{k}"))
            if k + 1 < len(corpus_pipeline.STAGES):
                assert docs.columns == columns
        assert (docs.count() == 0) == (name == "empty")


def test_no_stage_needs_a_warehouse(spark, tmp_path, monkeypatch):
    own = cases.folder(spark, str(tmp_path), cases.table(spark, cases.rows(odd=False)))
    want = cases.plain_rows(corpus_pipeline.run(spark, own).select("doc_id", "start", "length", "ids_crc32"))

    def unnamed(_):
        raise ValueError("spark.sql.warehouse.dir has to name a folder that driver and executors share")

    monkeypatch.setattr(exact_dedup, "shared_warehouse", unnamed)
    assert cases.plain_rows(corpus_pipeline.run(spark, own).select("doc_id", "start", "length", "ids_crc32")) == want
