"""Facts about source code that single lines tell: declared types, how objects get what they need, test doubles, idioms.

A line is read once into tokens in a row, with one blank between them and strings emptied; a declaration is split there into its
modifiers, keyword, name and tail. What a fact needs of each is in the tables below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.paths import protocol_name_choice, test_name_choice, type_name_choice

SHAPE = r"^ ((?:(?:{modifiers}) )*)({keywords}) (\w+) (.*)$"
# Modifiers that may stand before a declaration, and its keywords; the longer of two keywords first.
MODIFIERS = {"swift": "public private internal fileprivate open final indirect static lazy", "kotlin": "public private internal open data sealed enum"}
KEYWORDS = {"swift": "class struct protocol enum func var", "kotlin": "class object interface fun val"}

#: By language: fact, keywords, modifiers that may be there, modifiers that must be there, what the tail begins with or has.
Shape = tuple[str, str, str, str, str]
PLAIN = "public private internal"
DECLARED: dict[str, list[Shape]] = {
    "swift": [
        ("type", "class struct", MODIFIERS["swift"], "", ""),
        ("protocol", "protocol", PLAIN, "", ""),
        ("enum", "enum", PLAIN + " indirect", "", ""),
        ("subclass", "class", PLAIN + " open final", "", "^: "),
        ("throws", "func", "", "", r"^\( [^)]*\) throws "),
        ("result", "func", "", "", r"^\( [^)]*\) -> Result < "),
        ("nullable", "func", "", "", r"^\( [^)]*\) -> [^=]+\? "),
        ("lazy", "var", "lazy", "lazy", ""),
        ("computed", "var", "", "", r"^[^{=]*\{ "),
    ],
    "kotlin": [
        ("type", "class object", PLAIN + " open data sealed", "", ""),
        ("protocol", "interface", PLAIN + " sealed", "", ""),
        ("enum", "class", "enum", "enum", ""),
        ("sealed", "class interface", "sealed", "sealed", ""),
        ("result", "fun", "", "", r"^\( [^)]*\) : Result < "),
        ("nullable", "fun", "", "", r"^\( [^)]*\) : [^=]+\? "),
        ("lazy", "val", "", "", r"\bby lazy \{ "),
        ("computed", "val", "", "", r"^(?:[^=]* )?get \( \) = "),
    ],
}
DOUBLES = ("Fake", "Stub", "Spy", "Mock")
DOUBLE = r" (?:{keywords}) (\w+(?:" + "|".join(DOUBLES) + ")) "
TYPED = r"\( [^)]*: [A-Z]\w* "
#: By language: fact and the tokens that tell it, anywhere in the line; the fact's name is the first group.
TOLD = {
    "swift": [
        ("double", DOUBLE.format(keywords="class|struct|protocol")),
        ("init_injection", " (init) " + TYPED),
        ("property_injection", " @ (Injected|LazyInjected|InjectedObject) "),
        ("service_locator", r" (ServiceLocator \. shared|Resolver \. (?:root|resolve)|\w+ \. resolve \() "),
        ("collection_literal", r" = (\[) \] "),
        ("collection_constructor", r" = (Array < [^>]*> \( \)|\[ [^\]]+\] \( \)) "),
    ],
    "kotlin": [
        ("double", DOUBLE.format(keywords="class|object|interface")),
        ("init_injection", r" class (\w+) " + TYPED),
        ("property_injection", r" (@ Inject lateinit var|by inject (?:< [^>]+> )?\() "),
        ("service_locator", r" ([A-Z]\w* \. getInstance \( \)|\w+ \. get \( \)) "),
        ("collection_factory", r" = (listOf|mutableListOf|emptyList) \( "),
        ("collection_constructor", r" = (ArrayList) (?:< [^>]+> )?\( "),
    ],
}
#: By language: framework and the tokens of which one names it.
FRAMEWORKS = {
    "swift": {"resolver": ["import Resolver", "@ Injected"], "swinject": ["import Swinject"], "factory": ["import Factory"], "needle": ["import NeedleFoundation"], "cuckoo": ["import Cuckoo"]},
    "kotlin": {"hilt": ["dagger . hilt", "@ InstallIn", "SingletonComponent"], "dagger": ["import dagger ."], "koin": ["import org . koin", "by inject (", "by inject <"], "mockk": ["mockk <"], "mockito": ["mock <"]},
}


#: What lexed.TOKEN finds but for blanks.
WORD = r'(?s)"(?:[^"\\\n]|\\[^\n])*"|[\p{L}_][\p{L}\p{N}_]*|\p{N}[\p{L}\p{N}_]*|\?\?|->|\S'


def read_line(line: Column) -> Column:
    """The tokens of a line with a blank before and after each; strings have nothing in them."""
    kept = F.regexp_extract_all(line, F.lit(WORD), F.lit(0))
    emptied = F.transform(kept, lambda t: F.when(t.startswith('"') & (F.length(t) > 1), '""').otherwise(t))
    return F.concat(F.lit(" "), F.array_join(F.when(F.contains(line, F.lit('"')), emptied).otherwise(kept), " "), F.lit(" "))


def _shape(language: str) -> str:
    return SHAPE.format(modifiers=MODIFIERS[language].replace(" ", "|"), keywords=KEYWORDS[language].replace(" ", "|"))


def _said() -> Column:
    """Modifiers, keyword, name and tail of a line that declares something in its language; null of others."""
    said, nul = F.lit(None).cast("array<string>"), "\0"
    for language in DECLARED:
        parts = F.split(F.regexp_replace("_read", _shape(language), nul.join(f"${k}" for k in range(1, 5))), nul, 4)
        said = F.when((F.col("language") == language) & F.col("_read").rlike(_shape(language)), parts).otherwise(said)
    return said


#: A fact, whether a line tells it, its name.
Told = tuple[str, Column, Column]


def _declared(language: str) -> list[Told]:
    modifiers, keyword, name, tail = (F.get("_said", F.lit(k)) for k in range(4))

    def fact(fact_name: str, keywords: str, may: str, must: str, tail_has: str) -> Told:
        allowed = modifiers.rlike(f"^(?:(?:{may.replace(' ', '|')}) )*$") if may else F.lit(False)
        holds = F.col("_said").isNotNull() & (F.col("language") == language) & keyword.isin(*keywords.split()) & ((modifiers == "") | allowed)
        for m in must.split():
            holds &= F.contains(F.concat(F.lit(" "), modifiers), F.lit(f" {m} "))
        return fact_name, holds & tail.rlike(tail_has) if tail_has else holds, name

    return [fact(*shape) for shape in DECLARED[language]]


def _told(language: str) -> list[Told]:
    own = F.col("language") == language
    found = [(f, own & F.col("_read").rlike(p), F.replace(F.regexp_extract("_read", p, 1), F.lit(" "), F.lit(""))) for f, p in TOLD[language]]
    for name, marks in FRAMEWORKS[language].items():
        holds = reduce(lambda a, b: a | b, (F.contains("_read", F.lit(f" {m} ")) for m in marks))
        if name == "dagger":
            holds &= ~F.contains("_read", F.lit("import dagger . hilt "))
        found.append(("framework", own & holds, F.lit(name)))
    return found


def _each(rows: DataFrame, conditions: list[Column], name: str) -> DataFrame:
    """A row for each condition that holds, with its number from 0.

    The numbers are a column first, which is compiled, and nothing but numbers, or what is compiled gets too long to run fast.
    A generator would interpret the conditions, and one that isn't outer would put a filter before itself that evaluates them twice.
    """
    holding = F.array(*(F.when(c, F.lit(n)) for n, c in enumerate(conditions)))
    return rows.withColumn("_all", holding).withColumn(name, F.explode_outer("_all")).drop("_all").where(F.col(name).isNotNull())


def line_facts(files: DataFrame) -> DataFrame:
    """path, language, line, fact, name of all that lines tell; of the fact `framework` the name is the framework's.

    files: path, language, text. A line may tell several facts.
    """
    lines = files.select("path", "language", F.posexplode(F.split("text", "\r?\n")).alias("_n", "_line")).withColumn("_read", read_line(F.col("_line")))
    declared, told = ([x for language in DECLARED for x in f(language)] for f in (_declared, _told))
    found = _each(lines.withColumn("_said", _said()), [holds for _, holds, _ in declared + told], "_f")
    name = F.when(F.col("_f") < len(declared), declared[0][2])
    for n, (_, _, own) in enumerate(told, len(declared)):
        name = name.when(F.col("_f") == n, own)
    fact = F.get(F.array(*(F.lit(f) for f, _, _ in declared + told)), F.col("_f"))
    return found.select("path", "language", (F.col("_n") + 1).alias("line"), fact.alias("fact"), name.alias("name"))


def doubles(facts: DataFrame) -> DataFrame:
    """path, line, name, kind of the test doubles among facts: by the end of the name."""
    kind = reduce(lambda c, k: c.when(F.col("name").endswith(k), k.lower()), DOUBLES, F.when(F.lit(False), ""))
    return facts.where("fact = 'double'").select("path", "line", "name", kind.alias("kind"))


def signals(facts: DataFrame) -> DataFrame:
    """path, line, rule, choice: the conventions that facts speak of, one row a fact that is a choice.

    Types, test classes (in files of tests) and protocols are told by how they are named, the others by what they are.
    """
    test = F.col("path").rlike("(?i)(^|/)(tests?|src/test)/|tests?\\.(swift|kt)$")
    fact, name = F.col("fact"), F.col("name")
    rules = {
        "structural.adt_pattern": {"enum": "enum", "sealed": "sealed", "subclass": "class_hierarchy"},
        "structural.error_modeling": {"throws": "throws", "result": "result", "nullable": "nullable"},
        "idiom.collection_init": {"collection_literal": "literal", "collection_factory": "literal", "collection_constructor": "constructor"},
        "idiom.computed_vs_property": {"lazy": "lazy", "computed": "computed"},
    }
    told = [("naming.type_class", fact == "type", type_name_choice(name)), ("naming.test_class", (fact == "type") & test, test_name_choice(name)), ("naming.module_protocol", fact == "protocol", protocol_name_choice(name))]
    told += [(rule, fact == f, F.lit(c)) for rule, choices in rules.items() for f, c in choices.items()]
    found = _each(facts, [holds for _, holds, _ in told], "_s")
    choice = reduce(lambda c, x: c.when(F.col("_s") == x[0], x[1][2]), enumerate(told), F.when(F.lit(False), ""))
    rule = F.get(F.array(*(F.lit(r) for r, _, _ in told)), F.col("_s"))
    return found.select("path", "line", rule.alias("rule"), choice.alias("choice"))
