"""A feed that is given in pages, newest first, as a table and as a stream whose offset is what has been seen.

A page is {"remaining": n, "nodes": [{"number", "updatedAt", ...}], "next": cursor or null}. The driver follows the cursors
down to what has been seen and plans a partition for some pages that follow each other (option `pages`); the nodes themselves are read in tasks. A page that can't be had is tried
again, three times in all with growing pauses; below a floor of remaining calls reading ends with an error at once.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SHAPE = "number long, updated_at string, node string"


class TooFewCalls(RuntimeError):
    """The feed allows too few further calls."""


class Pages:
    """Pages of a feed under an address: a folder (page-<cursor>.json, page-.json first) or an HTTP address (?cursor=...)."""

    def __init__(self, options: dict[str, str]):
        self.address = options["address"].rstrip("/")
        self.tries, self.pause, self.floor = int(options.get("tries", 3)), float(options.get("pause", 0.5)), int(options.get("floor", 100))
        self.each = int(options.get("pages", 100))

    def get(self, cursor: str) -> dict[str, Any]:
        for n in range(self.tries):
            if n:
                time.sleep(self.pause * 2 ** (n - 1))
            try:
                page = json.loads(self._read(cursor))
                break
            except (OSError, ValueError):
                if n + 1 == self.tries:
                    raise
        if page.get("remaining", self.floor) < self.floor:
            raise TooFewCalls(f"{page['remaining']} calls remain, {self.floor} have to")
        return page

    def _read(self, cursor: str) -> bytes:
        if self.address.startswith("http"):
            with urllib.request.urlopen(f"{self.address}?cursor={cursor}", timeout=30) as answer:
                return answer.read()
        with open(f"{self.address.removeprefix('file:')}/page-{cursor}.json", "rb") as file:
            return file.read()


def seen_of(node: dict[str, Any]) -> tuple[str, int]:
    """What nodes are ordered by: when they changed (a UTC time in ISO form), then their number."""
    return node["updatedAt"], int(node["number"])


class SomePages(InputPartition):
    def __init__(self, cursors: list[str], after: dict, upto: dict | None):
        super().__init__(cursors)
        self.cursors, self.after, self.upto = cursors, after, upto


class _Reading:
    """Shared by both readers: which pages hold what has come after an offset, and their nodes.

    An offset is the newest time seen and the numbers seen at that time, so that another node of the same time isn't lost.
    """

    pages: Pages

    def newest(self) -> dict:
        nodes = self.pages.get("")["nodes"]
        if not nodes:
            return {"at": "", "numbers": []}
        at = max(n["updatedAt"] for n in nodes)
        return {"at": at, "numbers": sorted(int(n["number"]) for n in nodes if n["updatedAt"] == at)}

    def planned(self, after: dict, upto: dict | None) -> list[SomePages]:
        cursors, cursor = [], ""
        while cursor is not None:
            page = self.pages.get(cursor)
            if page["nodes"] and max(n["updatedAt"] for n in page["nodes"]) < after["at"]:
                break  # all older than what has been seen
            cursors.append(cursor)
            if page["nodes"] and min(n["updatedAt"] for n in page["nodes"]) < after["at"]:
                break
            cursor = page["next"]
        each = self.pages.each
        return [SomePages(cursors[k : k + each], after, upto) for k in range(0, len(cursors), each)]

    def nodes(self, part: SomePages) -> Iterator[tuple[int, str, str]]:
        for node in (n for cursor in part.cursors for n in self.pages.get(cursor)["nodes"]):
            at, number = seen_of(node)
            new = at > part.after["at"] or (at == part.after["at"] and number not in part.after["numbers"])
            old = part.upto is None or at < part.upto["at"] or (at == part.upto["at"] and number in part.upto["numbers"])
            if new and old:
                yield number, at, json.dumps(node)


class PagedTable(_Reading, DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.pages, self.since = Pages(options), options.get("since", "")

    def partitions(self) -> Sequence[SomePages]:
        return self.planned({"at": self.since, "numbers": []}, None)

    def read(self, partition: SomePages) -> Iterator[tuple]:
        yield from self.nodes(partition)


class PagedStream(_Reading, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.pages, self.since = Pages(options), options.get("since", "")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": self.since, "numbers": []}

    def latestOffset(self) -> dict:  # noqa: N802
        return self.newest()

    def partitions(self, start: dict, end: dict) -> Sequence[SomePages]:
        return self.planned(start, end)

    def read(self, partition: SomePages) -> Iterator[tuple]:
        yield from self.nodes(partition)


class PagedFeed(DataSource):
    """Options: address; since (an ISO time: older nodes are left out), tries, pause (seconds), floor (calls), pages (in a task)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema: Any) -> PagedTable:
        return PagedTable(dict(self.options))

    def streamReader(self, schema: Any) -> PagedStream:  # noqa: N802
        return PagedStream(dict(self.options))


def paged(spark: SparkSession, address: str, stream: bool = False, **options: str) -> DataFrame:
    """number, updated_at and node (JSON) of the nodes of a feed."""
    spark.dataSource.register(PagedFeed)
    reader = spark.readStream if stream else spark.read
    return reader.format("paged").options(address=address, **options).load()
