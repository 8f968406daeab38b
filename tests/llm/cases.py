"""Small tables of documents with all that tables may hold."""

from __future__ import annotations

import os
import random

from pyspark.sql import DataFrame, SparkSession

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["ala", "bero", "cinta", "dovu", "elka", "fimo", "gatu", "hosen", "iblu", "jarro", "kepi", "lumo", "märz", "naïve", "ost", "päivä"]
LONG = " ".join(WORDS[k % 16] + str(k % 97) for k in range(60_000))


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice("abcdefgh") * r.randint(0, 2) for _ in range(words))


def rows(odd: bool = True) -> list[tuple]:
    """Plain documents, exact and near copies, shared passages; if odd: nulls, repeated rows, empty and very long texts."""
    plain = [(k, prose(k, 60 + k), ("xa", "xb")[k % 2], f"site{k % 3}/p{k % 2}", 0) for k in range(24)]
    copies = [(100 + k, prose(3, 63), "xa", "site0/p1", 0) for k in range(5)]
    near = [(200 + k, prose(4, 64) + f" end{k}", "xa", "site0", 0) for k in range(3)]
    shared = [(300 + k, prose(400 + k, 20) + " " + prose(77, 120) + " " + prose(500 + k, 20), "xb", "site1/p0", 0) for k in range(4)]
    if not odd:
        return plain + copies + near + shared
    strange = [
        (None, prose(5, 65), "xb", None, None), (None, None, None, None, None), (None, None, None, None, None), (400, None, "xa", "site2", None), (401, "", None, "", 0), (402, " \t\n", "xa", "/", 3),
        (403, "12345 !!", "xb", "a//b", 8), (404, LONG, "xa", "site2/p0", len(LONG)), (405, LONG + " x", None, "site2/p0", None), (7, prose(7, 67), "xb", "site1/p1", 0), (8, prose(999, 70), "xa", "site1/p1", 0),
        (406, "\x00 null ﻿ bytes   <|endoftext|> ▁▁ mark 😀", "xb", "x/y/z", 1), (407, "A", "xa", "x", 1), (-5, "Tiny Text here", "xa", "x", 1),
        (5 * 10**18, prose(41, 66), "xa", "site0", 0), (-(2**63), prose(42, 66), "xb", "site1", 0), (2**63 - 1, prose(43, 66), "xb", "site1", 0),
    ]
    return plain + copies + near + shared + strange


def table(spark: SparkSession, own: list[tuple] | None = None, clashing: bool = False) -> DataFrame:
    """A table of documents; clashing: with further columns whose names the operators might use themselves."""
    df = spark.createDataFrame(rows() if own is None else own, COLUMNS)
    if clashing:
        names = ["digest", "DIGEST_", "text_key", "spans", "row_id", "fp", "root", "file", "target", "host", "path", "x", "kept", "item", "key", "words", "_metadata", "batch"]
        df = df.selectExpr("*", *(f"'own {n}' as `{n}`" for n in names))
    return df


def folder(spark: SparkSession, at: str, docs: DataFrame) -> str:
    """An input folder with the documents and labels for some of them."""
    docs.write.mode("overwrite").parquet(f"{at}/documents.parquet")
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 24)] + [(None, 1, 0), (100, None, None), (9999, 1, 1), (3, 1, 0), (3, 1, 0)]
    spark.createDataFrame(labels if docs.take(1) else [], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{at}/labels.parquet")
    return at


def plain_rows(df: DataFrame) -> list[tuple]:
    """Collected rows in a fixed order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sf(name: str = "sf0.001") -> str:
    import pytest

    at = f"/root/testdata/{name}"
    if not os.path.isdir(at):
        pytest.skip("the driver's tables aren't here")
    return at
