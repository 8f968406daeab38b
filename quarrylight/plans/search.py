"""Search over documents, decision records and code lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.stored import PostingIndex

SECTIONS = ("PURPOSE", "STACK", "ARCHITECTURE", "PATTERNS", "TRADEOFFS", "PHILOSOPHY")


def keyword_search(docs: DataFrame, text: str, keyword: str, excerpt: int = 500) -> DataFrame:
    """Rows whose text contains the keyword (case counts), with the text's beginning."""
    return docs.where(F.contains(F.col(text), F.lit(keyword))).withColumn("excerpt", F.substring(text, 1, excerpt))


def term_documents(postings: DataFrame, symbol: int, phases: list[str], key: str = "doc_key") -> DataFrame:
    """Postings of a symbol in any of the phases, one a document key."""
    return postings.where((F.col("symbol_id") == symbol) & F.col("phase").isin(*phases)).dropDuplicates([key])


def served_documents(index: PostingIndex, symbol: int, phases: list[str], commit: str | None = None) -> DataFrame:
    """The same from an index of postings (symbol_id, doc_key, phase, commit_sha): only the symbol's bucket is read."""
    return index.lookup(symbol, phase=phases, **({} if commit is None else {"commit_sha": commit}))


def served_record(index: PostingIndex, doc_id: str) -> DataFrame:
    """The rows of one document from an index by doc_id."""
    return index.lookup(doc_id)


def markdown_sections(records: DataFrame, text: str) -> DataFrame:
    """records with section and body: what follows each second-level heading of a known name."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n##[ \t]+")
    own = records.withColumn("_p", F.explode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))))
    name = F.upper(F.trim(F.regexp_extract("_p", r"^([^\n]*)", 1)))
    return own.withColumns({"section": name, "body": F.regexp_replace(F.regexp_replace("_p", r"^[^\n]*\n?", ""), r"^\s+|\s+$", "")}).where(name.isin(*SECTIONS)).drop("_p")


def spliced(records: DataFrame, text: str, section: str, body: str) -> DataFrame:
    """records with a section's body replaced (or appended), its hash, and whether that changes anything."""
    pattern = rf"(?s)(^|\n)(##[ \t]+{section}[ \t]*\n).*?(?=\n##[ \t]|\z)"
    has = F.col(text).rlike(pattern)
    new = F.when(has, F.regexp_replace(F.col(text), pattern, "$1$2" + body.replace("\\", r"\\").replace("$", r"\$"))).otherwise(F.concat(F.col(text), F.lit(f"\n## {section}\n{body}")))
    return records.withColumn("_new", new).withColumns({"body_hash": F.sha2(F.lit(body), 256), "changed": F.sha2("_new", 256) != F.sha2(F.col(text), 256)}).withColumn(text, F.col("_new")).drop("_new")


def code_lines(files: DataFrame, pattern: str) -> DataFrame:
    """path, line, content of each line that matches."""
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("_n", "content"))
    return lines.where(F.col("content").rlike(pattern)).select("path", (F.col("_n") + 1).alias("line"), "content")


def budgeted(docs: DataFrame, text: str, tokens: int, per_token: int = 4) -> DataFrame:
    """docs with the text cut to a budget of tokens of four characters, and whether it was cut."""
    return docs.withColumns({"truncated": F.length(text) > tokens * per_token, text: F.substring(text, 1, tokens * per_token)})


def overview(tables: dict[str, DataFrame], runs: DataFrame) -> DataFrame:
    """label, n of every table and, in each row, when the last run started."""
    from quarrylight.operators.aggregates import label_counts

    return label_counts(tables).withColumn("last_run_at", F.lit(runs.agg(F.max("started_at")).first()[0]))


def by_doc_id(records: DataFrame, doc_id: str) -> DataFrame:
    """The rows of one document."""
    return records.where(F.col("doc_id") == doc_id)


def snippet(files: DataFrame, path: str, first: int, last: int, most: int = 500) -> DataFrame:
    """line, content of a file's lines first to last, at most so many."""
    lines = files.where(F.col("path") == path).select(F.posexplode(F.split("text", "\r?\n")).alias("_n", "content"))
    return lines.select((F.col("_n") + 1).alias("line"), "content").where(F.col("line").between(first, min(last, first + most - 1))).orderBy("line")
