import math
from collections import defaultdict

import pytest

from quarrylight.llm import quality as op
from tests.llm import cases


def site(source, lang):
    source = source or ""
    host = source.split("/")[0]
    rest = source.split("/")[1] if "/" in source else ""
    return host, rest or (lang or "")


def strength(groups, mean, least=1.0, most=1e4):
    n, total = len(groups), sum(g[0] for g in groups)
    if n < 2 or not total:
        return most
    between = sum(k * (s / k - mean) ** 2 for k, s in groups)
    inner = sum(s * (1 - s / k) for k, s in groups)
    spread = between / total - n / total * inner / total
    return min(most, max(least, mean * (1 - mean) / spread - 1)) if spread > 0 else most


def brute(rows):
    """rows: host, path, evidence. The quality of each."""
    paths, hosts = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for h, p, e in rows:
        for g in (paths[h, p], hosts[h]):
            g[0] += 1
            g[1] += e
    base = sum(r[2] for r in rows) / len(rows)
    k_host, k_path = strength(list(hosts.values()), base), strength(list(paths.values()), base)
    out = []
    for h, p, e in rows:
        host = (hosts[h][1] - e + k_host * base) / (hosts[h][0] - 1 + k_host)
        path = (paths[h, p][1] - e + k_path * host) / (paths[h, p][0] - 1 + k_path)
        odds = [math.log(min(1 - 1e-9, max(1e-9, x)) / (1 - min(1 - 1e-9, max(1e-9, x)))) for x in (e, path)]
        out.append(1 / (1 + math.exp(-(sum(odds) - math.log(base / (1 - base))))))
    return out


@pytest.mark.parametrize("clashing", [False, True])
def test_posteriors_against_brute_force(spark, tmp_path, clashing):
    at = cases.folder(spark, str(tmp_path), cases.table(spark, clashing=clashing))
    found = op.op3_quality(spark, at).collect()
    assert len(found) == len(cases.rows())
    sites = sorted((site(r[3], r[2]) for r in cases.rows()), key=repr)
    assert sorted(((r["host"], r["path"]) for r in found), key=repr) == sites
    for r, q in zip(found, brute([(r["host"], r["path"], r["evidence"]) for r in found]), strict=True):
        assert abs(r["quality"] - q) < 1e-9 and r["kept"] == (r["quality"] >= 0.2)


def test_sparse_sites_shrink_toward_the_corpus(spark):
    rows = [(k, cases.prose(k, 40 + k % 30) if k % 2 else "!!! $$$ 99 " * (3 + k % 5), "xa", "big/a" if k < 180 else f"tiny{k}/a", 1) for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(100)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in op.quality_posteriors(cases.table(spark, rows), labels).collect()}
    assert all(found[k]["quality"] > 0.5 for k in range(1, 200, 2)) and all(found[k]["quality"] < 0.5 for k in range(0, 200, 2))
    tiny = [found[k]["path_posterior"] for k in range(180, 200)]
    assert max(tiny) - min(tiny) < 0.05  # alone on its site, a document has the corpus's prior


def test_good_documents_stay(spark):
    at = cases.sf("sf0.01")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet").where("quality is not null")
    kept = op.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    told = labels.collect()
    good, bad = [r["doc_id"] in ids for r in told if r["quality"] == 1], [r["doc_id"] in ids for r in told if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_without_labels_all_stay(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = cases.table(spark, clashing=True)
    assert op.keep_good(docs, labels).count() == docs.count()
