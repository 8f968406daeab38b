"""Source texts as rows of tokens, with their lines, the brackets that enclose them and what stands around them.

Texts move once, by path; tokens are made where they land, and every window below is over a path or more, so none needs an
exchange of its own. A file's tokens lie in one task, files being bounded by what source_tree reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: A string on one line, a word, a number, blanks, two signs that belong together, any other sign. Nothing is left out.
TOKEN = r'(?s)"(?:[^"\\\n]|\\[^\n])*"|[\p{L}_][\p{L}\p{N}_]*|\p{N}[\p{L}\p{N}_]*|\s+|\?\?|->|.'
BLANK = r"^\s"
#: What TOKEN finds in a line but for blanks, each with the blanks before it; no token but blanks goes beyond a line.
SPACED = r'(?s)[ \t\x0B\f\r]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\p{L}_][\p{L}\p{N}_]*+|\p{N}[\p{L}\p{N}_]*+|\?\?|->|.)'
BLANKS = " \t\x0b\f\r"
PIECE = 256  # tokens that become rows together


def of_file() -> WindowSpec:
    """A file's tokens in order."""
    return Window.partitionBy("path").orderBy("pos")


def count_in(c: Column, sign: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))


def tokens(files: DataFrame) -> DataFrame:
    """A row a token that isn't blank: path, language, pos (from 0, without blanks), tok, line, gap (blanks before it) and
    statement (a number that grows at each line and semicolon).

    files: path (unique), language, text. Comments are tokens like all else; a quote without its partner is a sign. Texts are
    few bytes for the work that they make, so their partitions are as many as the session's shuffles have, never fewer.
    """
    found = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").select("path", "language", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))
    before = of_file().rowsBetween(Window.unboundedPreceding, -1)
    blank = F.col("tok").rlike(BLANK)
    placed = found.withColumns({
        "line": F.coalesce(F.sum(count_in(F.col("tok"), "\n")).over(before), F.lit(0)) + 1,
        "gap": F.coalesce(F.lag(blank).over(of_file()), F.lit(False)),
        "_ends": F.coalesce(F.lag((F.col("tok") == ";") | (blank & F.contains("tok", F.lit("\n")))).over(of_file()), F.lit(False)),
    })
    placed = placed.withColumn("statement", F.sum(F.col("_ends").cast("int")).over(of_file().rowsBetween(Window.unboundedPreceding, 0))).where(~blank)
    return placed.withColumn("pos", F.row_number().over(of_file()) - 1).select("path", "language", "pos", "tok", F.col("line").cast("int").alias("line"), "gap", "statement")


def in_context(files: DataFrame, ahead: int, behind: int) -> DataFrame:
    """around(tokens(files)) without the statement, by no window and no sort; line_behind has lines too.

    files: as for `tokens`; further columns stay. A file's tokens are dealt to pieces that overlap by what is asked for, and a
    row reads its piece: no row is longer than a piece.
    """

    def read(line: Column, n: Column) -> Column:
        found = F.regexp_extract_all(F.rtrim(line, F.lit(BLANKS)), F.lit(SPACED), F.lit(0))
        gap = lambda x, k: ((n > 0) & (k == 0)) | F.ascii(x).isin(*map(ord, BLANKS))
        return F.transform(found, lambda x, k: F.struct(F.ltrim(x, F.lit(BLANKS)).alias("tok"), (n + 1).alias("line"), gap(x, k).alias("gap")))

    def piece(start: Column) -> Column:
        end = F.least(start + PIECE, F.greatest(F.size("_all"), F.lit(1))) - 1 + ahead
        return F.struct(start.alias("start"), F.transform(F.sequence(start - behind, end), lambda k: F.get("_all", k)).alias("piece"))

    # generators are outer and nothing is filtered before them: what is filtered or inferred there is computed twice
    dealt = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    lists = dealt.withColumn("_all", F.flatten(F.transform(F.split("text", "\n"), read))).drop("text")
    last = F.greatest(F.size("_all") - 1, F.lit(0))
    pieces = lists.withColumn("_p", F.explode_outer(F.transform(F.sequence(F.lit(0), last, F.lit(PIECE)), piece))).drop("_all")
    kept = [c for c in pieces.columns if c != "_p"]
    rows = pieces.select(*kept, F.col("_p.start").alias("_start"), F.col("_p.piece").alias("_piece"))
    rows = rows.select("*", F.posexplode_outer("_piece").alias("_at", "_t")).where((F.col("_at") >= behind) & (F.col("_at") < F.size("_piece") - ahead) & F.col("_t.tok").isNotNull())
    own = [(F.col("_start") + F.col("_at") - behind).alias("pos"), *(F.col("_t")[c].alias(c) for c in ("tok", "line", "gap"))]
    # one slice, and columns of it later: code for all of them beside the generator is too long to be compiled
    rows = rows.select(*kept, *own, F.slice("_piece", F.col("_at") - behind + 1, F.lit(behind + 1 + ahead)).alias("_near"))
    near = lambda n, c: F.get("_near", F.lit(behind + n))[c]
    later = [near(n, c).alias(f"{short}{n}") for n in range(1, ahead + 1) for c, short in (("tok", "a"), ("gap", "g"), ("line", "l"))]
    earlier = [near(-n, c).alias(f"{short}{n}") for n in range(1, behind + 1) for c, short in (("tok", "b"), ("line", "m"))]
    return rows.select(*kept, "pos", "tok", "line", "gap", *later, *earlier)


def around(rows: DataFrame, ahead: int = 5, behind: int = 1) -> DataFrame:
    """tokens with what stands around each, as columns for `ahead`, `gap_ahead`, `line_ahead` and `behind`."""
    w = of_file()
    columns = {f"{short}{n}": F.lead(c, n).over(w) for n in range(1, ahead + 1) for short, c in (("a", "tok"), ("g", "gap"), ("l", "line"))}
    return rows.withColumns(columns | {f"b{n}": F.lag("tok", n).over(w) for n in range(1, behind + 1)})


def ahead(n: int) -> Column:
    """The n-th token after this one."""
    return F.col(f"a{n}")


def gap_ahead(n: int) -> Column:
    return F.col(f"g{n}")


def line_ahead(n: int) -> Column:
    return F.col(f"l{n}") if n else F.col("line")


def behind(n: int) -> Column:
    return F.col(f"b{n}")


def line_behind(n: int) -> Column:
    return F.col(f"m{n}")


def with_comments(rows: DataFrame) -> DataFrame:
    """tokens (with what is around them) with comment: whether one lies behind // on its line or between /* and */."""
    slash = (F.col("tok") == "/") & ~gap_ahead(1)
    ends = (F.col("tok") == "*") & (ahead(1) == "/") & ~gap_ahead(1)
    running = of_file().rowsBetween(Window.unboundedPreceding, 0)
    line = F.last(F.when(slash & (ahead(1) == "/"), F.col("line")), ignorenulls=True).over(running)
    block = F.last(F.when(slash & (ahead(1) == "*"), True).when(ends, False), ignorenulls=True).over(running)
    return rows.withColumn("comment", F.coalesce(line == F.col("line"), F.lit(False)) | F.coalesce(block, F.lit(False)))


def with_statement_ends(rows: DataFrame) -> DataFrame:
    """tokens (with what is around them) with end: the last line of the statement that begins two tokens later; and coalesces:
    whether a ?? follows its first token. One sort backwards, in which what comes next has been seen."""
    back = Window.partitionBy("path").orderBy(F.desc("pos"))
    running = back.rowsBetween(Window.unboundedPreceding, 0)
    last = F.coalesce(F.lag("statement").over(back) != F.col("statement"), F.lit(True))
    seen = rows.withColumn("_last", last).withColumns({
        "_end": F.last(F.when(F.col("_last"), F.col("line")), ignorenulls=True).over(running),
        "_next": F.last(F.when(F.col("tok") == "??", F.struct("pos", "statement")), ignorenulls=True).over(running),
    })
    two = seen.withColumns({"end": F.lag("_end", 2).over(back), "_next": F.lag("_next", 2).over(back), "_own": F.lag("statement", 2).over(back)})
    follows_it = (F.col("_next.statement") == F.col("_own")) & (F.col("_next.pos") > F.col("pos") + 2)
    return two.withColumn("coalesces", F.coalesce(follows_it, F.lit(False))).drop("_last", "_end", "_next", "_own")


def is_string(c: Column, filled: bool = True) -> Column:
    """Whether a token is a string (with something in it)."""
    return c.startswith('"') & (F.length(c) > (2 if filled else 1))


def follows(*signs: str | Column | None, near: bool = False) -> Column:
    """Whether the next tokens are these; a column is a condition of its own; near: without blanks before them."""
    found = F.lit(True)
    for n, sign in enumerate(signs, 1):
        if isinstance(sign, str):
            found &= ahead(n) == sign
        elif sign is not None:
            found &= sign
        if near:
            found &= ~gap_ahead(n)
    return F.coalesce(found, F.lit(False))


def brackets(rows: DataFrame, opening: str, closing: str, *carried: str) -> DataFrame:
    """The opening tokens of rows with `close`: the struct of pos, line and the carried columns where the bracket ends.

    The depth is a running sum; of one path and depth, the token after an opening one closes it. Null where nothing does.
    """
    step = F.when(F.col("tok") == opening, 1).when(F.col("tok") == closing, -1)
    found = rows.where(F.col("tok").isin(opening, closing)).withColumn("_depth", F.sum(step).over(of_file().rowsBetween(Window.unboundedPreceding, 0)))
    found = found.withColumn("depth", F.col("_depth") + F.when(F.col("tok") == closing, 1).otherwise(0))
    level = Window.partitionBy("path", "depth").orderBy("pos")
    end = F.when(F.lead("tok").over(level) == closing, F.lead(F.struct("pos", "line", *carried)).over(level))
    return found.withColumn("close", end).where(F.col("tok") == opening).drop("_depth")


def blocks(rows: DataFrame) -> DataFrame:
    """path, depth, first_line, last_line (null if it never ends), tokens (in it) of each block in braces."""
    found = brackets(rows, "{", "}")
    return found.select("path", "depth", F.col("line").alias("first_line"), F.col("close.line").alias("last_line"), (F.col("close.pos") - F.col("pos") - 1).alias("tokens"))
