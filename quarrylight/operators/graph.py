"""Reachability, traces and strongly connected components by rounds of joins.

A round is a join on edges; its result is written to the shared folder where the session names one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quarrylight.session import Steps, cut


def trace(edges: DataFrame, start: DataFrame, depth: int = 5) -> DataFrame:
    """node, hop: what the start nodes (column node) reach along src -> dst within 1 .. depth hops, with the fewest."""
    front = start.select("node").distinct()
    seen = front.withColumn("hop", F.lit(0))
    links = edges.select("src", "dst").distinct()
    for hop in range(1, max(1, min(5, depth)) + 1):
        front = front.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        seen = cut(seen.unionByName(front.withColumn("hop", F.lit(hop))))
        front = seen.where(F.col("hop") == hop).select("node")
    return seen.where("hop > 0")


def reachability(edges: DataFrame, most_rounds: int = 40, most_pairs: int = 1_000_000_000) -> DataFrame:
    """(src, dst) of every path, by doubling its length each round.

    The result has a row a pair, which may be the square of the nodes: more than most_pairs are an error, and `trace` answers
    for given nodes without it.
    """
    held = cut(edges.select("src", "dst").distinct())
    size = held.count()
    for _ in range(most_rounds):
        further = held.alias("a").join(held.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        held = cut(held.unionByName(further).distinct())
        now = held.count()
        if now == size:
            return held
        if now > most_pairs:
            raise ValueError(f"more than {most_pairs} pairs of nodes reach each other: ask from given nodes by trace")
        size = now
    raise RuntimeError("reachability did not settle")


def components_of(edges: list[tuple]) -> list[tuple]:
    """(node, component) of a few edges: depth first forward, then backward in the order of leaving."""
    out, back = defaultdict(list), defaultdict(list)
    for a, b in edges:
        out[a].append(b)
        back[b].append(a)

    def walk(start, links: dict, seen: set) -> list:
        left, path = [], [(start, iter(links[start]))]
        seen.add(start)
        while path:
            node, rest = path[-1]
            for x in rest:
                if x not in seen:
                    seen.add(x)
                    path.append((x, iter(links[x])))
                    break
            else:
                left.append(node)
                path.pop()
        return left

    order, seen = [], set()
    for node in sorted({x for e in edges for x in e}):
        if node not in seen:
            order += walk(node, out, seen)
    found, seen = [], set()
    for node in reversed(order):
        if node not in seen:
            own = walk(node, back, seen)
            found += [(x, min(own)) for x in own] if len(own) > 1 else []
    return found


def _contracted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of edges in order of src: rows (false, node, label, many) for every src and (true, label of src, dst, false) for every edge
    that is left, in chunks of about `most` edges.

    A component of some of the edges is part of one of all, so it may be one node from here on. The first and last src of a
    chunk may have edges in another one and stay as they are: so each node has one label.
    """
    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        src, dst = (sum((b.column(k).to_pylist() for b in held), []) for k in (0, 1))
        own = set(src) - {src[0], src[-1]}
        label = dict(components_of([e for e in zip(src, dst, strict=True) if e[0] in own and e[1] in own]))
        nodes = dict.fromkeys(src)
        left = [(label.get(a, a), b) for a, b in zip(src, dst, strict=True) if label.get(a, a) != label.get(b, b)]
        columns = [
            [False] * len(nodes) + [True] * len(left), [*nodes, *(a for a, _ in left)],
            [*(label.get(n, n) for n in nodes), *(b for _, b in left)], [*(n in label for n in nodes), *[False] * len(left)],
        ]
        kind = held[0].schema.field(0).type
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.bool_(), kind, kind, pa.bool_()), strict=True)], ["edge", "a", "b", "many"])

    held, size = [], 0
    for batch in (b.slice(at, most) for b in batches for at in range(0, b.num_rows, most)):
        held, size = [*held, batch], size + batch.num_rows
        if size >= most:
            yield chunk(held)
            held, size = [], 0
    if held:
        yield chunk(held)


def strong_components(edges: DataFrame, most_rounds: int = 200, small: int = 20_000, chunk: int = 50_000) -> DataFrame:
    """node, component (its least node) of every strongly connected component of two nodes or more.

    First edges are sorted by src in ranges, and what is a component among `chunk` of them that follow each other becomes one
    node; nodes without way out go with the join that renames the ends. Then the rounds of `_rounds` work on what is left. Every
    table of theirs is written compressed and goes with the next one.
    """
    links = edges.select("src", "dst").where("src <> dst")
    steps = Steps(edges.sparkSession, "components")
    kind = links.schema["src"].dataType
    # sorted in ranges of src, a range has all edges of a src, so equal ones meet without another exchange
    ranged = links.repartitionByRange("src").distinct().sortWithinPartitions("src")
    shape = StructType([StructField("edge", BooleanType()), StructField("a", kind), StructField("b", kind), StructField("many", BooleanType())])
    local = steps.table(ranged.mapInArrow(lambda batches: _contracted(batches, chunk), shape))
    nodes = steps.table(local.where("not edge").groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"), F.max("many").alias("many")))
    ends = local.where("edge").join(nodes.select(F.col("node").alias("b"), F.col("label").alias("dst")), "b").select(F.col("a").alias("src"), "dst")
    left = steps.table(ends.where("src <> dst").distinct(), local)
    found = _rounds(left, steps, most_rounds, small).select(F.col("node").alias("label"), "component")
    return nodes.join(found, "label", "left").where("many or component is not null").select("node", F.coalesce("component", "label").alias("component"))


def _rounds(left: DataFrame, steps: Steps, most_rounds: int, small: int) -> DataFrame:
    """node, component of distinct edges between different nodes.

    Nodes without way in or out are trimmed; then the least label is passed forward and, among nodes of one forward label,
    backward from its owner. What both reach is a component; the rest goes on without it. No paths are built. Once at most
    `small` edges are left, the driver finishes them.
    """
    found = None
    for _ in range(most_rounds):
        rest = left.take(small + 1)
        if len(rest) <= small:
            kind = left.schema["src"].dataType
            shape = StructType([StructField("node", kind), StructField("component", kind)])
            own = left.sparkSession.createDataFrame(components_of([tuple(r) for r in rest]), shape)
            return own if found is None else found.unionByName(own)
        size = left.count()
        while True:
            left = steps.table(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), left)
            now = left.count()
            if now == size:
                break
            size = now
        if not size:
            break
        first = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().select("node", F.col("node").alias("label"))
        labels = _spread(left, first, steps)
        both = left.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
        inner = steps.table(both.where("a = b").select("src", "dst"), left)
        owners = labels.where("node = label").select("node", "label")
        hit = _backward(inner, owners, steps)
        own = hit.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").join(hit, "label").select("node", F.col("label").alias("component"))
        found = steps.table(own if found is None else found.unionByName(own), labels, *([found] if found is not None else []))
        gone = hit.select("node")
        left = steps.table(inner.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), inner, hit)
    else:
        raise RuntimeError("components did not settle")
    return found if found is not None else left.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)


def _spread(edges: DataFrame, labels: DataFrame, steps: Steps) -> DataFrame:
    """The least label that reaches each node."""
    labels = steps.table(labels)
    while True:
        passed = edges.join(labels.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "label")
        both = labels.select("node", "label", F.col("label").alias("was")).unionByName(passed, allowMissingColumns=True)
        new = steps.table(both.groupBy("node").agg(F.min("label").alias("label"), (F.min("label") < F.min("was")).alias("moved")), labels)
        if not new.where("moved").take(1):
            return new
        labels = new


def _backward(edges: DataFrame, owners: DataFrame, steps: Steps) -> DataFrame:
    """Nodes that reach their label's owner along edges within the label."""
    hit = steps.table(owners)
    size = hit.count()
    while True:
        came = edges.join(hit.select(F.col("node").alias("dst"), "label"), "dst").select(F.col("src").alias("node"), "label")
        hit = steps.table(hit.unionByName(came).distinct(), hit)
        now = hit.count()
        if now == size:
            return hit
        size = now
