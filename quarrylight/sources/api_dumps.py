"""Public API dumps: which types and members a module exports, by windows over the lines of a file.

files: path, text. Both return path, line, fqn, name, kind, visibility, signature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions.ids import normal_signature, signature_hash

KOTLIN_TYPE = r"^(public|protected|internal)\s+((?:[a-z]+\s+)*)(class|interface|object)\s+([\w./$]+)"
KOTLIN_CONSTRUCTOR = r"^(public|protected|internal)\s+(?:[a-z]+\s+)*constructor\s*\(([^)]*)\)"
KOTLIN_FUNCTION = r"^(public|protected|internal)\s+(?:[a-z]+\s+)*fun\s+(?:<[^>]*>\s*)?([\w$<>-]+)\s*\(([^)]*)\)"
KOTLIN_PROPERTY = r"^(public|protected|internal)\s+(?:[a-z]+\s+)*va[lr]\s+([\w$]+):"
SWIFT_TYPE = r"^(public|open|package)\s+(?:final\s+)?(struct|class|enum|protocol|typealias)\s+([A-Za-z_][\w.]*)"
SWIFT_EXTENSION = r"^(?:(public|package)\s+)?extension\s+([A-Za-z_][\w.]*)[^{]*\{$"
SWIFT_INIT = r"^(public|open|package)\s+init[?!]?\(([^)]*)\)"
SWIFT_FUNCTION = r"^(public|open|package)\s+(?:static\s+|class\s+)?func\s+([A-Za-z_]\w*)\(([^)]*)\)"
SWIFT_PROPERTY = r"^(public|open|package)\s+(?:static\s+|class\s+)?(?:var|let)\s+([A-Za-z_]\w*)\s*:"


def _lines(files: DataFrame) -> DataFrame:
    rows = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("_n", "_l"))
    return rows.select("path", (F.col("_n") + 1).alias("line"), F.regexp_replace("_l", r"^\s+|\s+$", "").alias("signature")).where("signature <> ''")


def _part(pattern: str, k: int) -> Column:
    return F.regexp_extract("signature", pattern, k)


def _is(pattern: str) -> Column:
    return F.col("signature").rlike(pattern)


def _listed(rows: DataFrame, fqn: Column, name: Column, kind: Column, visibility: Column) -> DataFrame:
    found = rows.select("path", "line", fqn.alias("fqn"), name.alias("name"), kind.alias("kind"), visibility.alias("visibility"), "signature").where("kind is not null and fqn is not null")
    return found.withColumns({"signature": normal_signature(F.col("signature")), "signature_hash": signature_hash(F.col("signature"))})


def kotlin_api(files: DataFrame) -> DataFrame:
    """Types, constructors, functions and properties of .api dumps; members belong to the type that is open."""
    own = F.replace(_part(KOTLIN_TYPE, 4), F.lit("/"), F.lit("."))
    now = F.when(_is(KOTLIN_TYPE), own).when(F.col("signature") == "}", "")
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = _lines(files).withColumn("_t", F.nullif(F.last(now, ignorenulls=True).over(w), F.lit("")))
    word = _part(KOTLIN_TYPE, 2)
    type_kind = F.when(F.contains(word, F.lit("enum")), "enum").when(_part(KOTLIN_TYPE, 3) == "interface", "interface").when(_part(KOTLIN_TYPE, 3) == "object", "object").otherwise("class")
    kind = F.when(_is(KOTLIN_TYPE), type_kind).when(_is(KOTLIN_CONSTRUCTOR), "initializer").when(_is(KOTLIN_FUNCTION), "function").when(_is(KOTLIN_PROPERTY), "property")
    name = F.when(_is(KOTLIN_TYPE), F.element_at(F.split(own, r"\."), -1)).when(_is(KOTLIN_CONSTRUCTOR), "init").when(_is(KOTLIN_FUNCTION), _part(KOTLIN_FUNCTION, 2)).otherwise(_part(KOTLIN_PROPERTY, 2))
    params = F.when(_is(KOTLIN_CONSTRUCTOR), _part(KOTLIN_CONSTRUCTOR, 2)).when(_is(KOTLIN_FUNCTION), _part(KOTLIN_FUNCTION, 3))
    member = F.concat(F.col("_t"), F.lit("."), name, F.coalesce(F.concat(F.lit("("), normal_signature(params), F.lit(")")), F.lit("")))
    return _listed(rows, F.when(_is(KOTLIN_TYPE), own).otherwise(member), name, kind, _part(r"^(public|protected|internal)\b", 1))


def swift_api(files: DataFrame) -> DataFrame:
    """Types, extensions, initialisers, functions and properties of .swiftinterface files.

    Braces give each line its depth; the scope of a line is the last type or extension opened at that depth.
    """
    w = Window.partitionBy("path").orderBy("line")
    delta = F.when(F.col("signature") == "}", -1).when(F.col("signature").endswith("{"), 1).otherwise(0)
    rows = _lines(files).where(~F.col("signature").startswith("//")).withColumn("_after", F.sum(delta).over(w))
    opens, extension, named = F.col("signature").endswith("{"), _is(SWIFT_EXTENSION), _is(SWIFT_TYPE)
    scope_name = F.when(opens & extension, _part(SWIFT_EXTENSION, 2)).when(opens & named, _part(SWIFT_TYPE, 3)).when(opens, "")
    outer = Window.partitionBy("path", "_level").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_open", F.when(opens, scope_name))
    # a line that opens a block is a member of the scope one level up; all others lie at their own level
    both = rows.select("*", F.col("_after").alias("_level"), F.lit(False).alias("_probe")).unionByName(rows.where(opens).select("*", (F.col("_after") - 1).alias("_level"), F.lit(True).alias("_probe")))
    held = both.withColumn("_scope", F.last(F.when(~F.col("_probe"), F.col("_open")), ignorenulls=True).over(outer))
    rows = held.where(F.when(opens, F.col("_probe")).otherwise(True)).withColumn("_scope", F.nullif("_scope", F.lit("")))
    kind = F.when(extension, "extension").when(named, _part(SWIFT_TYPE, 2)).when(_is(SWIFT_INIT) & F.col("_scope").isNotNull(), "initializer").when(_is(SWIFT_FUNCTION), "function").when(_is(SWIFT_PROPERTY), "property")
    name = F.when(extension, "extension").when(named, F.element_at(F.split(_part(SWIFT_TYPE, 3), r"\."), -1)).when(_is(SWIFT_INIT), "init").when(_is(SWIFT_FUNCTION), _part(SWIFT_FUNCTION, 2)).otherwise(_part(SWIFT_PROPERTY, 2))
    params = F.when(_is(SWIFT_INIT), _part(SWIFT_INIT, 2)).when(_is(SWIFT_FUNCTION), _part(SWIFT_FUNCTION, 3))
    member = F.concat(F.concat_ws(".", "_scope", name), F.coalesce(F.concat(F.lit("("), normal_signature(params), F.lit(")")), F.lit("")))
    fqn = F.when(extension, F.concat(_part(SWIFT_EXTENSION, 2), F.lit(".extension"))).when(named, _part(SWIFT_TYPE, 3)).otherwise(member)
    return _listed(rows, fqn, name, kind, F.coalesce(F.nullif(_part(r"^(public|open|package)\b", 1), F.lit("")), F.lit("public")))
