import os
import threading
from types import SimpleNamespace

import pytest

from quarrylight.llm import common
from tests.llm import cases


def at(scratch, name):
    return scratch.path(name).removeprefix("file://")


def test_a_run_deletes_what_it_began_and_nothing_else(spark):
    outside = common.Scratch(spark, "outside")
    outside.table(spark.range(3).toDF("x"), "t")
    with common.Scratch.until_used():
        inside = common.Scratch(spark, "inside")
        inside.table(spark.range(4).toDF("x"), "t")
        other = []
        thread = threading.Thread(target=lambda: other.append(common.Scratch(spark, "other")))
        thread.start()
        thread.join()
        other[0].table(spark.range(5).toDF("x"), "t")
        with common.Scratch.until_used():
            nested = common.Scratch(spark, "nested")
            nested.table(spark.range(2).toDF("x"), "t")
        assert not os.path.exists(at(nested, "t")) and os.path.exists(at(inside, "t"))
    assert not os.path.exists(at(inside, "t"))
    assert os.path.exists(at(outside, "t")) and os.path.exists(at(other[0], "t"))


def test_two_pipelines_at_once(spark, tmp_path):
    import corpus_pipeline

    own = cases.folder(spark, str(tmp_path), cases.table(spark, cases.rows(odd=False)))
    want = cases.plain_rows(corpus_pipeline.run(spark, own).select("doc_id", "start", "length"))
    found, wrong = {}, []

    def run(k):
        try:
            found[k] = cases.plain_rows(corpus_pipeline.run(spark, own).select("doc_id", "start", "length"))
        except Exception as e:  # told below
            wrong.append(e)

    threads = [threading.Thread(target=run, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not wrong and found == {0: want, 1: want}
    assert spark.conf.get(common.SHUFFLES_GO, None) in (None, "false")


def test_the_warehouse_has_to_be_shared_on_a_cluster():
    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key: folder), sparkContext=SimpleNamespace(master=master))

    own = f"file:{os.getcwd()}/spark-warehouse"
    assert common.shared_warehouse(session("local[4]", own)) == own
    assert common.shared_warehouse(session("spark://x", "hdfs://y/w")) == "hdfs://y/w"
    with pytest.raises(ValueError):
        common.shared_warehouse(session("spark://x", own))
