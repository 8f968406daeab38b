"""The tool surface: questions over a set of tables, each answered by a DataFrame.

Tables are given by name; a question names those that it needs. Limits are held within the bounds that each tool has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.checks import slug_ok
from quarrylight.operators import graph, joins, ledger, lookup
from quarrylight.operators.stored import PostingIndex
from quarrylight.plans import audit, history, search, symbols
from quarrylight.plans.runs import Outcome, Runner
from quarrylight.sources import gitlog
from quarrylight.streaming import detectors


class UnknownTable(LookupError):
    """A question needs a table that isn't there."""


class Engine:
    """Answers from tables; every answer is a plan that Spark runs when it is read."""

    def __init__(self, tables: Mapping[str, DataFrame], as_of: datetime | None = None, indexes: Mapping[str, PostingIndex] | None = None):
        """indexes: by the names of tables, postings that serve questions for single terms in their place."""
        self.tables, self.as_of, self.indexes = dict(tables), as_of, dict(indexes or {})

    def _table(self, name: str, project: str | None = None) -> DataFrame:
        if name not in self.tables:
            raise UnknownTable(f"no table {name!r}; there are {', '.join(sorted(self.tables))}")
        rows = self.tables[name]
        return rows if project is None else rows.where(F.col("project") == project)

    @staticmethod
    def _held(n: int, most: int) -> int:
        return max(1, min(most, n))

    def _now(self) -> Column:
        return F.lit(self.as_of) if self.as_of else F.current_timestamp()

    # code ------------------------------------------------------------------------------------------------------------

    def find_hotspots(self, project: str, top_n: int = 20, min_score: float = 0.0) -> DataFrame:
        """hotspots: project, path, hotspot_score, ..."""
        return history.find_hotspots(self._table("hotspots", project), self._held(top_n, 100), min_score)

    def list_functions(self, project: str, path: str, min_ccn: int = 0) -> DataFrame:
        """functions: project, path, name, start_line, ccn, ..."""
        rows = self._table("functions", project).where((F.col("path") == path) & (F.coalesce("ccn", F.lit(0)) >= min_ccn))
        return rows.orderBy(F.desc("ccn"), "start_line")

    def find_owners(self, project: str, path: str, top_n: int = 5) -> DataFrame:
        """owned_by: project, path, author, weight, ..."""
        return history.find_owners(self._table("owned_by", project).where(F.col("path") == path), self._held(top_n, 20))

    def find_references(self, names: Sequence[str], project: str) -> DataFrame:
        """occurrences, evicted: project, symbol (tables, or indexes by symbol); runs: project."""
        runs = self._table("runs", project)
        asked = runs.sparkSession.createDataFrame([(project, x) for x in names], "project string, symbol string")
        own = [self.indexes[t].lookup(*names, project=project) if t in self.indexes else self._table(t, project).join(F.broadcast(asked), ["project", "symbol"], "left_semi") for t in ("occurrences", "evicted")]
        return symbols.find_references(*own, runs, asked)

    def find_version_skew(self, slugs: Sequence[str] | None = None, ecosystem: str | None = None, least: str = "unknown", top_n: int = 50) -> DataFrame:
        """dependencies: slug, purl, ecosystem, version, scope_id. All projects, or a bundle's."""
        rows, warnings = lookup.apply_filters(self._table("dependencies"), {"slugs": lookup.one_of("slug"), "ecosystem": lookup.equals("ecosystem")}, {"slugs": slugs, "ecosystem": ecosystem})
        assert not warnings
        return symbols.find_skew(symbols.skew_groups(rows), least, self._held(top_n, 500))

    def find_dead_symbols(self, project: str, limit: int = 200) -> DataFrame:
        """dead_symbols: project, state, confidence, symbol_key, ..."""
        return self._table("dead_symbols", project).orderBy("state", "symbol_key").limit(self._held(limit, 200))

    def find_public_api(self, project: str, limit: int = 500) -> DataFrame:
        """public_api: project, fqn, line, ..."""
        return self._table("public_api", project).orderBy("fqn", "line").limit(self._held(limit, 500))

    def find_cross_module_contracts(self, project: str, limit: int = 200) -> DataFrame:
        """contracts: project, consumer, producer, removed, ..."""
        return self._table("contracts", project).orderBy(F.desc("removed"), "consumer", "producer").limit(self._held(limit, 200))

    def test_impact(self, name: str, project: str, max_hops: int = 3, limit: int = 100) -> tuple[DataFrame, bool]:
        """(tests that reach a symbol with the fewest hops, whether there are more). calls: project, src, dst; tests: project, name.

        The name may be the end of a qualified name, if just one has that end.
        """
        calls = self._table("calls", project)
        known = calls.select(F.col("dst").alias("name")).union(calls.select("src")).distinct()
        asked = calls.sparkSession.createDataFrame([(name,)], "name string")
        found = joins.suffix_lookup(asked, known, "name").first()
        if found["status"] != "ok":
            raise LookupError(f"{name!r}: {found['status']}")
        start = calls.sparkSession.createDataFrame([(found["match"],)], "node string")
        callers = graph.trace(calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, max_hops)
        hit = callers.join(self._table("tests", project).select(F.col("name").alias("node")).distinct(), "node", "left_semi")
        return lookup.truncated(hit.orderBy("hop", "node"), self._held(limit, 500))

    def find_occurrences(self, symbol: int, phases: Sequence[str], commit: str | None = None) -> DataFrame:
        """postings: symbol_id, doc_key, phase, commit_sha (a table, or an index by symbol_id); one a document key."""
        if "postings" in self.indexes:
            return search.served_documents(self.indexes["postings"], symbol, list(phases), commit)
        rows = self._table("postings")
        return search.term_documents(rows if commit is None else rows.where(F.col("commit_sha") == commit), symbol, list(phases))

    def search_code(self, project: str, pattern: str, limit: int = 100) -> DataFrame:
        """source_files: project, path, text."""
        return search.code_lines(self._table("source_files", project), pattern).orderBy("path", "line").limit(self._held(limit, 1000))

    def query(self, sql: str) -> DataFrame:
        """Spark SQL over the tables by their names."""
        spark = next(iter(self.tables.values())).sparkSession
        return spark.sql(sql, **self.tables) if "{" in sql else self._with_views(sql)

    def _with_views(self, sql: str) -> DataFrame:
        """The plan keeps the tables, so that the views go again; a view that the session has by a name comes back."""
        spark, before = next(iter(self.tables.values())).sparkSession, {}
        for t in spark.catalog.listTables():
            if t.isTemporary and t.name in self.tables:
                before[t.name] = spark.table(t.name)
        try:
            for name, rows in self.tables.items():
                rows.createOrReplaceTempView(name)
            return spark.sql(sql)
        finally:
            for name in self.tables:
                before[name].createOrReplaceTempView(name) if name in before else spark.catalog.dropTempView(name)

    def get_architecture(self, project: str) -> DataFrame:
        """imports: project, src, dst; one row a module with how many it uses and is used by."""
        edges = self._table("imports", project).select("src", "dst").distinct()
        out, into = edges.groupBy(F.col("src").alias("module")).agg(F.count("*").alias("uses")), edges.groupBy(F.col("dst").alias("module")).agg(F.count("*").alias("used_by"))
        return out.join(into, "module", "full_outer").fillna(0).orderBy("module")

    def get_code_snippet(self, project: str, path: str, first: int, last: int) -> DataFrame:
        """source_files: project, path, text."""
        return search.snippet(self._table("source_files", project), path, first, last)

    def detect_changes(self, project: str) -> DataFrame:
        """manifests: project, at, path, blob; files that differ between the last two manifests of a project."""
        rows = self._table("manifests", project)
        times = [r["at"] for r in rows.select("at").distinct().orderBy(F.desc("at")).limit(2).collect()]
        at = lambda k: rows.where(F.col("at") == F.lit(times[k])) if k < len(times) else rows.limit(0)
        return history.dirty_files(at(1).select("path", "blob"), at(0).select("path", "blob")).orderBy("path")

    # git -------------------------------------------------------------------------------------------------------------

    def git_log(self, project: str, limit: int = 50, since: datetime | None = None, author: str | None = None) -> tuple[DataFrame, bool]:
        """(commits, newest first; whether there are more). commits: project, sha, committed_at, email, ..."""
        rows, _ = lookup.apply_filters(self._table("commits", project), {"since": lookup.since("committed_at"), "author": lookup.contains("email")}, {"since": since, "author": author})
        return lookup.truncated(rows.orderBy(F.desc("committed_at"), "sha"), self._held(limit, 200))

    def git_blame(self, project: str, path: str) -> DataFrame:
        """blame_texts: project, path, text."""
        return gitlog.blame(self._table("blame_texts", project).where(F.col("path") == path))

    def git_show(self, project: str, sha: str) -> DataFrame:
        """diff_texts: project, sha, text (a commit's diff); its files with their counts of lines."""
        return gitlog.diff(self._table("diff_texts", project).where(F.col("sha") == sha).withColumn("blob", F.col("sha"))).drop("blob").orderBy("path")

    def git_diff(self, project: str, sha: str, full: bool = False) -> tuple[DataFrame, bool]:
        """(lines of a commit's diff, whether there are more): up to 2000 in full, else 500."""
        text = self._table("diff_texts", project).where(F.col("sha") == sha)
        lines = text.select(F.posexplode(F.split("text", "\r?\n")).alias("line", "content")).orderBy("line")
        return lookup.truncated(lines, 2000 if full else 500)

    def git_ls_tree(self, project: str) -> tuple[DataFrame, bool]:
        """(up to 500 files of a tree, whether there are more). tree_texts: project, text."""
        return lookup.truncated(gitlog.ls_tree(self._table("tree_texts", project)).orderBy("path"), 500)

    # memory ------------------------------------------------------------------------------------------------------------

    def lookup(self, table: str, filters: Mapping[str, object], order_by: str, limit: int = 20) -> tuple[DataFrame, int, list[str]]:
        """(rows, how many there are, warnings) by equality on the table's columns, newest first."""
        known = {c: lookup.equals(c) for c in self._table(table).columns}
        rows, warnings = lookup.apply_filters(self._table(table), known, filters)
        rest = [c for c in rows.columns if c != order_by]
        return lookup.page(rows, [F.desc_nulls_last(order_by), *rest], limit), rows.count(), warnings

    def list_projects(self) -> DataFrame:
        return self._table("projects").orderBy("slug")

    def bundle_members(self, bundle: str) -> DataFrame:
        return self._table("bundle_members").where(F.col("bundle") == bundle).orderBy("slug")

    def bundle_status(self, bundle: str) -> DataFrame:
        """bundle_members: bundle, slug; runs: project, run_id, started_at, success."""
        members = self.bundle_members(bundle).select("bundle", F.col("slug").alias("member"))
        return audit.bundle_status(audit.bundle_health(members, self._table("runs").withColumn("member", F.col("project")), self._now()))

    def slug_kind(self, slugs: Sequence[str]) -> DataFrame:
        asked = self._table("projects").sparkSession.createDataFrame([(x,) for x in slugs], "slug string")
        return ledger.slug_kind(asked, self._table("bundle_members"), self._table("projects"))

    def register_project(self, new: DataFrame) -> DataFrame:
        """The table of projects with new or changed ones (slug and its columns); slugs keep their form."""
        wrong = [r["slug"] for r in new.where(~slug_ok(F.col("slug"))).select("slug").take(5)]
        if wrong:
            raise ValueError(f"no slug: {', '.join(map(str, wrong))}")
        return ledger.merge_projects(self._table("projects"), new, [c for c in ("language_profile", "created_at") if c in new.columns])

    def add_to_bundle(self, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(members with the new ones, errors). new: bundle, slug."""
        return ledger.add_members(self._table("bundle_members"), new, self._table("projects"))

    def delete_bundle(self, bundle: str, cascade: bool = False) -> DataFrame:
        return ledger.delete_bundle(self._table("bundle_members"), bundle, cascade)

    def list_extractors(self) -> DataFrame:
        """extractors with when each last ran, over all projects."""
        last = self._table("runs").groupBy("extractor").agg(F.max("started_at").alias("last_run_at"))
        return self._table("extractors").join(last, "extractor", "left").orderBy("extractor")

    def project_overview(self, project: str) -> DataFrame:
        """label, n, last_run_at: rows of a project in every table that has projects."""
        own = {k: v.where(F.col("project") == project) for k, v in self.tables.items() if "project" in v.columns}
        return search.overview(own, self._table("runs", project))

    def decide(self, decisions: DataFrame, makers: Sequence[str], slices: str = r"^[A-Z]+-\d+$") -> tuple[DataFrame, DataFrame]:
        """(decisions to be kept, those with an error and which)."""
        return ledger.valid_decisions(decisions, makers, slices)

    def splice_decision(self, section: str, body: str) -> DataFrame:
        """decision_texts (slug, text) with a section's body replaced or appended, and whether that changes anything."""
        return search.spliced(self._table("decision_texts"), "text", section, body)

    def supersede_decision(self, changes: DataFrame) -> DataFrame:
        """decision_documents (slug, title, status, body) after changes (old, new, reason)."""
        return ledger.superseded(self._table("decision_documents"), changes)

    def health(self) -> DataFrame:
        return audit.health(self.tables, self._table("runs"), self._table("projects"))

    def search_decisions(self, keyword: str, section: str | None = None, project: str | None = None, limit: int = 20) -> DataFrame:
        """decision_records: slug, status, section, body; superseded ones are left out."""
        rows, _ = lookup.apply_filters(self._table("decision_records"), {"section": lookup.equals("section"), "project": lookup.starts_with("slug")}, {"section": section, "project": project})
        return search.keyword_search(rows.where("status <> 'superseded'"), "body", keyword).orderBy("slug", "section").limit(self._held(limit, 200))

    def prime(self, project: str, role: str, tokens: int = 2000) -> str:
        """A text that starts a session: the project, its last three decisions (decisions: project, title, body, at), cut to a budget."""
        last = self._table("decisions", project).orderBy(F.desc("at"), "title").limit(3).collect()
        text = "\n".join([f"# {project} ({role})", *(f"## {r['title']}\n{r['body']}" for r in last)])
        return text[: tokens * 4]

    # operations ----------------------------------------------------------------------------------------------------------

    def run_extractor(self, runner: Runner, name: str, project: str, state: str | None = None, timeout_seconds: float = 300.0) -> Outcome:
        """Run an extractor of a runner; what it wrote is in the runner's tables, how it went in its ledger."""
        return runner.run(name, project, state, timeout_seconds)

    def unstick_issue(self, issue_id: str, tokens: Sequence[str], force: bool = False, most: int = 5) -> tuple[list[int], bool]:
        """(ids of the processes that may hold an issue's lock, whether they may be ended). Nothing is ended here.

        issues: issue_id, run_id, locked_at; processes: pid, etime, pcpu, command. Those that run as long as the lock is held,
        or else those that have long been idle; more than `most` only by force. No lock, no processes.
        """
        own = self._table("issues").where(F.col("issue_id") == issue_id)
        if not own.where("run_id is not null").take(1):
            return [], False
        processes = self._table("processes")
        found = detectors.lock_holders(own, processes, tokens, self._now()).select("pid").distinct().orderBy("pid").limit(1000).collect()
        found = found or detectors.long_idle(processes, tokens).select("pid").distinct().orderBy("pid").limit(1000).collect()
        return [r["pid"] for r in found], bool(found) and (force or len(found) <= most)

    # audit -------------------------------------------------------------------------------------------------------------

    def audit(self, project: str, per_section: int = 100) -> str:
        """A report in Markdown. findings: project, section, position, severity, message."""
        return audit.render(project, audit.sections(self._table("findings", project), self._held(per_section, 1000), F.col("position")))

    def audit_status(self, profile: DataFrame) -> DataFrame:
        """projects: project, language; extractors: extractor; runs; profile: language, extractor."""
        return audit.audit_status(self._table("projects"), self._table("extractors"), profile, self._table("runs"))
