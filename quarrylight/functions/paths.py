"""Classifiers of paths, authors and names as column expressions."""

from __future__ import annotations

import fnmatch
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of automated authors, anchored at the start.
BOT_EMAILS = [r".*\[bot\]@users\.noreply\.github\.com$", r".*@dependabot\.com$", r"renovate\[bot\]@.*"]
BOT_NAMES = [r"github-actions(\[bot\])?$", r"dependabot(\[bot\])?$", r"renovate(\[bot\])?$", r".*\[bot\]$"]
# Patterns of source contexts, in the order in which they are tried.
EXAMPLE = r"(?i)(^|/)(?:[^/]*[-_ ])?(Example|Examples|Sample|Samples|Demo|Demos)(?:[-_ ][^/]*)?(/|$)"
TEST = r"(?i)(^|/)(Tests?|spec)(/|$)|Test(s)?\.swift$|_test\.py$|Test\.kt$"
LIBRARY = r"(?i)(^|/)(Sources|src|lib|libs)(/|$)"
# Languages of file extensions.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "java": "java", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "sol": "solidity", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "go": "go", "rs": "rust", "rb": "ruby", "cs": "csharp", "scala": "scala"}


def any_of(value: Column, patterns: list[str], flags: str = "") -> Column:
    return value.rlike(f"{flags}^(?:{'|'.join(patterns)})")


def is_bot(email: Column, name: Column, own_names: Sequence[str] = ()) -> Column:
    """Known automated authors and those of one's own (patterns of names); null email and name are none."""
    return F.coalesce(any_of(email, BOT_EMAILS), F.lit(False)) | F.coalesce(any_of(name, [*BOT_NAMES, *own_names], "(?i)"), F.lit(False))


def glob_regex(pattern: str) -> str:
    """A file glob as an anchored regular expression for rlike."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "[" and (end := pattern.find("]", k + 2)) > 0:
            inner = pattern[k + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", r"\\") + "]"
            k = end
        else:
            out += {"*": "(?s:.*)", "?": "(?s:.)"}.get(c, "\\" + c if not c.isalnum() and c != "_" else c)
        k += 1
    return f"^{out}$"


def matches_glob(value: Column, pattern: str) -> Column:
    return value.rlike(glob_regex(pattern))


def glob_matches(name: str, pattern: str) -> bool:
    """The same on the driver, for tests and small configurations."""
    return fnmatch.fnmatchcase(name, pattern)


def source_context(path: Column, overrides: Mapping[str, str] | None = None) -> Column:
    """override, example, test, library or other, by the first that matches; back-slashes count as slashes."""
    p = F.regexp_replace(path, r"\\", "/")
    out = F.when(F.lit(False), "")
    for pattern, context in (overrides or {}).items():
        out = out.when(matches_glob(p, pattern), context)
    return out.when(p.rlike(EXAMPLE), "example").when(p.rlike(TEST), "test").when(p.rlike(LIBRARY), "library").otherwise("other")


def language_of(path: Column, tag: Column | None = None) -> Column:
    """The document's own tag, else the language of the extension, else unknown."""
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    found = known[F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))]
    return F.coalesce(F.nullif(F.lower(tag), F.lit("")), found, F.lit("unknown")) if tag is not None else F.coalesce(found, F.lit("unknown"))


def module_of(path: Column, anchors: tuple[str, ...] = ("Sources", "src")) -> Column:
    """The directory after the first anchor in a path, else the first directory, else root."""
    parts = F.split(path, "/")
    out = F.when(F.lit(False), "")
    for anchor in anchors:
        at = F.array_position(parts, anchor)
        out = out.when((at > 0) & (F.size(parts) > at + 1), F.try_element_at(parts, (at + 1).cast("int")))
    return out.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise("root")


def naming_choice(name: Column) -> Column:
    """camel, pascal, snake, upper or other."""
    return (
        F.when(name.rlike(r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$"), "upper")
        .when(name.rlike(r"^[a-z0-9]+(_[a-z0-9]+)+$"), "snake")
        .when(name.rlike(r"^[A-Z][A-Za-z0-9]*$"), "pascal")
        .when(name.rlike(r"^[a-z][A-Za-z0-9]*$"), "camel")
        .otherwise("other")
    )


def type_name_choice(name: Column) -> Column:
    """upper_snake, upper_camel or other."""
    snake = (F.upper(name) == name) & F.contains(name, F.lit("_"))
    return F.when(snake, "upper_snake").when(name.rlike(r"^\p{Lu}[^_]*$"), "upper_camel").otherwise("other")


def test_name_choice(name: Column) -> Column:
    """By where a test class says that it is one: suffix_tests, prefix_test, suffix_spec or other."""
    return F.when(name.endswith("Tests"), "suffix_tests").when(name.startswith("Test"), "prefix_test").when(name.endswith("Spec"), "suffix_spec").otherwise("other")


def protocol_name_choice(name: Column) -> Column:
    """By a protocol's ending: suffix_protocol, suffix_able, suffix_ing or other."""
    out = F.when(F.lit(False), "")
    for ending in ("Protocol", "able", "ing"):
        out = out.when(name.endswith(ending), f"suffix_{ending.lower()}")
    return out.otherwise("other")


def redacted(message: Column, home: str, most: int = 200) -> Column:
    """Home folder as ~, new lines as blanks, at most so many characters."""
    return F.substring(F.regexp_replace(F.replace(message, F.lit(home), F.lit("~")), r"[\r\n]+", " "), 1, most)


def module_by_anchor(path: Column) -> Column:
    """The folder after Sources or Tests, else the one before src, else the first part."""
    parts = F.split(path, "/")
    at = lambda name: F.array_position(parts, name).cast("int")
    after = lambda name: (at(name) > 0) & (at(name) < F.size(parts))
    out = F.when(after("Sources"), F.try_element_at(parts, at("Sources") + 1)).when(after("Tests"), F.try_element_at(parts, at("Tests") + 1))
    return out.when(at("src") > 1, F.try_element_at(parts, F.greatest(at("src") - 1, F.lit(1)))).otherwise(F.element_at(parts, 1))


def module_by_parent(path: Column) -> Column:
    """The part after Sources or Tests, else the file's folder, else root."""
    parts = F.split(path, "/")
    at = lambda name: F.array_position(parts, name).cast("int")
    after = lambda name: (at(name) > 0) & (at(name) < F.size(parts))
    out = F.when(after("Sources"), F.try_element_at(parts, at("Sources") + 1)).when(after("Tests"), F.try_element_at(parts, at("Tests") + 1))
    return out.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-2))).otherwise("root")


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of the character at an offset from 0."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


# Parts of paths where an application puts its objects together.
COMPOSITION = ("appdelegate", "approot", "assembler", "assembly", "bootstrap", "compositionroot", "container", "di", "module", "scenedelegate")


def is_composition_root(path: Column) -> Column:
    return F.lower(path).rlike("|".join(COMPOSITION))
