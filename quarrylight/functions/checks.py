"""Forms that names have to keep, as column expressions; a null keeps none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of slugs, qualified names, refs, mounts and relative paths.
SLUG = r"^[a-z0-9][a-z0-9-]{0,62}$"
QUALIFIED = r"^[A-Za-z_][A-Za-z0-9_-]*(\.[A-Za-z_][A-Za-z0-9_-]*)*$"
REF = r"^[A-Za-z0-9][A-Za-z0-9._/@\-~^]{0,199}$"
MOUNT = r"^[a-z][a-z0-9-]{0,15}$"
RELATIVE = r"^[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*$"


def _keeps(value: Column, form: str) -> Column:
    return F.coalesce(value.rlike(form), F.lit(False))


def slug_ok(value: Column) -> Column:
    return _keeps(value, SLUG)


def qualified_ok(value: Column) -> Column:
    return _keeps(value, QUALIFIED)


def ref_ok(value: Column) -> Column:
    return _keeps(value, REF)


def mount_ok(value: Column) -> Column:
    return _keeps(value, MOUNT)


def relative_ok(value: Column) -> Column:
    """A path inside a folder: no part of it leads upward."""
    return _keeps(value, RELATIVE) & ~F.coalesce(F.array_contains(F.split(value, "/"), ".."), F.lit(True))
