"""Symbol indexes in SCIP form: one binary message a file, read where Spark reads it.

Only the fields that occurrences need are read from the wire: documents (2) with path (1), occurrences (2), language (4);
occurrences with range (1, packed), symbol (2) and roles (3).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.ids import occurrence_kind, qualified_name, symbol_id
from quarrylight.functions.paths import language_of
from quarrylight.sources.trees import binary_files, store_of

COLUMNS = "source string, error string, file_path string, language string, symbol string, roles int, line int, col_start int, col_end int"


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not byte & 0x80:
            return value, at


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message; lengths give a view of their bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("cut off")
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def _numbers(data: memoryview) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = _varint(data, at)
        out.append(value)
    return out


def occurrences_of(data: bytes) -> Iterator[tuple]:
    """file_path, language, symbol, roles, line, col_start, col_end; local and empty symbols are left out."""
    for number, document in fields(memoryview(data)):
        if number != 2 or isinstance(document, int):
            continue
        path = language = ""
        found = []
        for k, value in fields(document):
            if k == 1:
                path = bytes(value).decode()
            elif k == 4:
                language = bytes(value).decode()
            elif k == 2:
                found.append(value)
        for x in found:
            symbol, roles, span = "", 0, []
            for k, value in fields(x):
                if k == 1:
                    span += _numbers(value) if not isinstance(value, int) else [value]
                elif k == 2:
                    symbol = bytes(value).decode()
                elif k == 3:
                    roles = value
            if symbol and not symbol.startswith("local ") and len(span) in (3, 4):
                yield path, language, symbol, roles, span[0], span[1], max(span[1], span[-1])


def scip_occurrences(spark: SparkSession, path: str, commit: str, most_bytes: int = 500 << 20) -> DataFrame:
    """Occurrences of all indexes under a path, with kind, language, symbol_id and qualified name; unreadable files give
    one row with an error (too_large, malformed) and no symbol.

    A file is one row here; `split_occurrences` reads files of any size in ranges.
    """
    return index_occurrences(binary_files(spark, path, "*.scip"), commit, most_bytes)


def index_occurrences(files: DataFrame, commit: str, most_bytes: int = 500 << 20) -> DataFrame:
    """The same of indexes that are rows (path, length, content)."""
    small = F.when(F.col("length") <= most_bytes, F.col("content"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for source, content in zip(part["path"], part["content"], strict=True):
                if content is None:
                    yield _frame([(source, "too_large", *[None] * 7)])
                else:
                    yield from _decoded(source, content)

    return _named(files.select("path", small.alias("content")).mapInPandas(run, COLUMNS), commit)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in COLUMNS.split(", ")])


def _decoded(source: str, content: bytes) -> Iterator[pd.DataFrame]:
    """The rows of whole documents; one row with an error if any of them can't be read."""
    try:
        yield _frame([(source, None, *x) for x in occurrences_of(content)])
    except (ValueError, IndexError, UnicodeDecodeError):
        yield _frame([(source, "malformed", *[None] * 7)])


def _named(rows: DataFrame, commit: str) -> DataFrame:
    named = rows.withColumns({"kind": F.when(F.col("symbol").isNotNull(), occurrence_kind(F.col("roles"))), "language": language_of(F.col("file_path"), F.col("language")), "qualified_name": qualified_name("symbol"), "commit_sha": F.lit(commit)})
    return named.withColumn("symbol_id", symbol_id("qualified_name"))


def opened(path: str) -> pa.NativeFile:
    """A file of a store (`trees.store_of`), for reads at any place; path as Spark names it."""
    system, at = store_of(path)
    return system.open_input_file(at)


def document_ranges(file: pa.NativeFile, most_bytes: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of stretches of whole fields with about most_bytes each; a larger document stands alone.

    Only the lengths before the fields are read. The last stretch isn't whole if the file ends within a field.
    """
    size = file.size()
    start = at = 0
    while at < size:
        file.seek(at)
        head = memoryview(file.read(min(20, size - at)))
        try:
            tag, own = _varint(head, 0)
            if tag & 7 == 2:
                length, own = _varint(head, own)
                own += length
            elif tag & 7 == 0:
                _, own = _varint(head, own)
            elif tag & 7 in (1, 5):
                own += 8 if tag & 7 == 1 else 4
            else:
                raise ValueError("wire type")
        except (IndexError, ValueError):
            own = size  # no head of a field
        if at + own > size:
            if at > start:
                yield start, at, True
            yield at, size, False
            return
        if at > start and at + own - start > most_bytes:
            yield start, at, True
            start = at
        at += own
    if at > start:
        yield start, at, True


def split_occurrences(spark: SparkSession, path: str, commit: str, range_bytes: int = 8 << 20, most_bytes: int | None = None, tasks: int | None = None) -> DataFrame:
    """What scip_occurrences gives, read in ranges: a task holds range_bytes of a file or one document, whichever is more.

    One pass over the files seeks from length to length and gives ranges of whole documents; these are dealt evenly, so that
    many tasks (`tasks`, or as many as the session's shuffles have) read one large file. A file that ends within a document gives its whole documents and one row with an error.
    Files lie in a store that tasks can open (`opened`); elsewhere use scip_occurrences.
    """
    listed = binary_files(spark, path, "*.scip").select("path", "length")
    small = listed if most_bytes is None else listed.where(F.col("length") <= most_bytes)

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for source in part["path"]:
                with opened(source) as file:
                    yield pd.DataFrame([(source, *r) for r in document_ranges(file, range_bytes)], columns=["path", "start", "end", "whole"])

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for source, start, end, whole in part.itertuples(index=False):
                if not whole:
                    yield _frame([(source, "malformed", *[None] * 7)])
                    continue
                with opened(source) as file:
                    file.seek(start)
                    yield from _decoded(source, file.read(end - start))

    ranges = small.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInPandas(scan, "path string, start long, end long, whole boolean")
    # by a hash of the place, so that a repeated attempt deals the ranges as the first one did; a range is a few bytes that stand
    # for many, so the number of tasks is fixed and not left to the rows' size
    dealt = ranges.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    rows = dealt.mapInPandas(read, COLUMNS)
    if most_bytes is not None:
        large = listed.where(F.col("length") > most_bytes).select(F.col("path").alias("source"), F.lit("too_large").alias("error"))
        rows = rows.unionByName(large, allowMissingColumns=True)
    return _named(rows, commit)


def _coded(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes) -> bytes:
    return _coded(number << 3) + _coded(value) if isinstance(value, int) else _coded(number << 3 | 2) + _coded(len(value)) + value


def index_bytes(path: str, language: str, occurrences: Iterator[tuple[str, int, list[int]]]) -> bytes:
    """An index of one document; occurrences: symbol, roles, range."""
    own = b"".join(_field(2, _field(1, b"".join(map(_coded, span))) + _field(2, symbol.encode()) + _field(3, roles)) for symbol, roles, span in occurrences)
    return _field(2, _field(1, path.encode()) + own + _field(4, language.encode()))


def _once(value: Column, what: Callable[[Column], Column]) -> Column:
    """What is made of a value that is used several times and computed once."""
    return F.get(F.transform(F.array(value), what), F.lit(0))


def _hex_number(number: Column) -> Column:
    """A number from 0 below 2^35 in the wire's form, as hexadecimal digits."""
    byte = lambda n, k, more: F.lpad(F.hex(F.shiftright(n, 7 * k).bitwiseAND(0x7F).bitwiseOR(0x80 if more else 0)), 2, "0")
    sized = lambda n, size: F.concat(*(byte(n, k, k + 1 < size) for k in range(size)))
    return _once(number.cast("long"), lambda n: F.when(n < 1 << 7, sized(n, 1)).when(n < 1 << 14, sized(n, 2)).when(n < 1 << 21, sized(n, 3)).when(n < 1 << 28, sized(n, 4)).otherwise(sized(n, 5)))


def _hex_field(number: int, value: Column) -> Column:
    return _once(value, lambda v: F.concat(F.lit(f"{number << 3 | 2:02X}"), _hex_number(F.length(v) / 2), v))


def encoded_index(path: Column, own: Column) -> Column:
    """An index of one document: a path and its occurrences (structs of symbol, roles, span)."""
    text = lambda c: F.hex(F.encode(c, "UTF-8"))

    def one(x: Column) -> Column:
        span = F.array_join(F.transform(x["span"], lambda n: _hex_number(n)), "")
        return _hex_field(2, F.concat(_hex_field(1, span), _hex_field(2, text(x["symbol"])), F.lit("18"), _hex_number(x["roles"])))

    whole = F.concat(_hex_field(1, text(path)), F.array_join(F.transform(own, one), ""), _hex_field(4, text(F.lit("python"))))
    return F.unhex(_hex_field(2, whole))


def synthetic_occurrences(spark: SparkSession, n: int, symbols: int = 1000, files: int = 100) -> DataFrame:
    """n occurrences in modular cycles: each tenth is a definition, every seventh lies in vendor code."""
    return numbered_occurrences(spark.range(n), "id", symbols, files)


def numbered_occurrences(rows: DataFrame, number: str, symbols: int = 1000, files: int = 100) -> DataFrame:
    """The same, an occurrence for each row by a number that it has."""
    k = F.col(number)
    path = F.when(k % 7 == 0, F.concat(F.lit("vendor/f"), (k % files).cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("src/f"), (k % files).cast("string"), F.lit(".py")))
    return rows.select(F.concat(F.lit("pkg.sym"), (k % symbols).cast("string")).alias("symbol"), F.when(k % 10 == 0, "def").otherwise("use").alias("kind"), path.alias("file_path"), (k % 500).cast("int").alias("line"), (k % 80).cast("int").alias("col_start"))
