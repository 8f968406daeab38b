"""Identifiers, versions and signatures."""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType


@F.pandas_udf(LongType())
def symbol_id(names: pd.Series) -> pd.Series:
    """The first 8 bytes of BLAKE2b as a big-endian signed integer; null for null."""
    return names.map(lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big", signed=True) if x is not None else None).astype("Int64")


@F.pandas_udf(StringType())
def stable_hash(joined: pd.Series) -> pd.Series:
    """BLAKE2b of 16 bytes in hexadecimal."""
    return joined.map(lambda x: hashlib.blake2b(x.encode(), digest_size=16).hexdigest() if x is not None else None)


def stable_id(*parts: Column) -> Column:
    """An id over parts joined by ||."""
    return stable_hash(F.concat_ws("||", *parts))


def name_uuid(name: Column | str) -> Column:
    """UUID version 5 in the object-identifier namespace."""
    raw = (F.col(name) if isinstance(name, str) else name).cast("binary")
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.NAMESPACE_OID.hex)), raw))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.substring(F.lit("89ab"), F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def doc_key(symbol: Column, path: Column, line: Column, column: Column, run: Column) -> Column:
    return F.concat_ws(":", symbol.cast("string"), path, line.cast("string"), column.cast("string"), run)


def parse_doc_key(key: Column) -> Column:
    """symbol_id, path, line, col and rest; the path may hold colons, so the key is read from the right."""
    pattern = r"^(-?\d+):(.*):(\d+):(\d+):([^:]*)$"
    part = lambda k: F.regexp_extract(key, pattern, k)
    return F.when(
        key.rlike(pattern), F.struct(part(1).cast("long").alias("symbol_id"), part(2).alias("path"), part(3).cast("int").alias("line"), part(4).cast("int").alias("col"), part(5).alias("rest"))
    )


def purl_root(purl: Column) -> Column:
    """A package URL without the version after its last @."""
    return F.regexp_replace(purl, "@[^@]*$", "")


def purl(kind: Column, name: Column, version: Column) -> Column:
    """pkg:kind/name@version; names of pypi are lower case with hyphens."""
    own = F.when(kind == "pypi", F.regexp_replace(F.lower(name), r"[-_.]+", "-")).otherwise(name)
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), own, F.when(version.isNotNull(), F.concat(F.lit("@"), version)).otherwise(""))


def version_part(version: Column, k: int) -> Column:
    """The k-th number of a release (0 if it has fewer); null if it is no version of numbers."""
    number = F.regexp_extract(version, r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?", k + 1)
    return F.when(version.rlike(r"^v?\d+(\.\d+)*((a|b|rc|\.dev|\.post|\+|-)[0-9A-Za-z.+-]*)?$"), F.coalesce(F.nullif(number, F.lit("")).cast("int"), F.lit(0)))


def skew_level(versions_major: Column, versions_minor: Column, readable: Column) -> Column:
    """Worst pair of a group by counts of distinct major and (major, minor): major, minor, patch or unknown.

    A pair's level is the highest part in which it differs, so the worst over all pairs needs no pairs.
    """
    return F.when(readable < 2, "unknown").when(versions_major > 1, "major").when(versions_minor > 1, "minor").otherwise("patch")


def version_difference(a: Column, b: Column) -> Column:
    """major, minor or patch: the highest part in which two versions differ (patch if in none); unknown if one can't be read."""
    part = lambda k: version_part(a, k) != version_part(b, k)
    return F.when(part(0).isNull(), "unknown").when(part(0), "major").when(part(1), "minor").otherwise("patch")


def normal_signature(signature: Column) -> Column:
    return F.regexp_replace(F.trim(signature), r"\s+", " ")


def signature_hash(signature: Column) -> Column:
    return F.sha2(normal_signature(signature), 256)


def candidate_keys(name: Column) -> Column:
    """Lower-cased forms by which a name may be found: whole, without parentheses, last two parts, last part."""
    bare = F.regexp_replace(name, r"\(.*\)", "")
    parts = F.filter(F.split(bare, r"[.:/#]+"), lambda x: x != "")
    last = F.element_at(parts, -1)
    two = F.when(F.size(parts) > 1, F.concat_ws(".", F.slice(parts, -2, 2))).otherwise(last)
    return F.array_distinct(F.transform(F.array(name, bare, two, last), lambda x: F.lower(x)))


def occurrence_kind(roles: Column) -> Column:
    """Role bits: 1 definition, 64 forward declaration, 4 write; else a use."""
    has = lambda bit: roles.bitwiseAND(bit) == bit
    return F.when(has(1), "def").when(has(64), "decl").when(has(4), "assign").otherwise("use")


def qualified_name(symbol: Column | str) -> Column:
    """A symbol without its scheme, manager and version; blanks within back-ticks don't part it."""
    own = F.col(symbol) if isinstance(symbol, str) else symbol
    words = F.regexp_extract_all(own, F.lit(r"((?:[^\s`]|`(?:[^`]|``)*+`)++)"), F.lit(1))
    parts = F.transform(words, lambda x: F.replace(x, F.lit("``"), F.lit("`")))
    name, full = F.get(parts, 2), F.size(parts) > 4
    rest = F.when(full, F.array_join(F.slice(parts, F.lit(5), F.greatest(F.size(parts) - 4, F.lit(0))), " ")).otherwise(F.get(parts, F.size(parts) - 1))
    return F.when(own.isNull() | (F.size(parts) <= 1), own).when(full & (name != "") & (name != "."), F.trim(F.concat_ws(" ", name, rest))).otherwise(rest)


def prefixed_project(slug: Column) -> Column:
    return F.concat(F.lit("repos-"), F.regexp_replace(slug, "^repos-", ""))


def project_slug(name: Column) -> Column:
    return F.regexp_replace(name, "^repos-", "")
