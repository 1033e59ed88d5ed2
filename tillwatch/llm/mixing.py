"""Mix documents of overlapping sources to target weights by a min-cost flow.

Documents with the same set of sources form a pattern. A flow leads the words of each pattern to the sources of the
pattern, and from there to quotas that the weights give. The first copy of a pattern costs nothing; each further copy is cut
into slices whose cost rises, so words are repeated only where a quota cannot be met without, and about evenly. Costs lie on the
arcs into patterns alone, so the cheapest path is the cheapest slice with room, and augmenting slice by slice, in order of cost,
keeps every flow on the way one of least cost (successive shortest paths; each slice is one maximum flow).

The driver sees one row per pattern, never documents. Documents of a pattern stand in a seeded order (by hash), each at the
sum of the sizes before it; a pattern's flow is a stretch of that line, and of the line laid behind itself for repeats. So a document is taken
not at all, once or more, and one at the end of a stretch gives only its first words, by which quotas are met to the word.

Null texts have size 0; words are runs of characters other than white space (U+0009 to U+000D, space). A null source is a source of its own,
the last one. Documents without sources are not taken. Repeated rows each count. An empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch.llm.sharding import HASH_RANGE, key_text, unit_hash
from tillwatch.session import Workspace

WORD = r"[^\x20\x09-\x0D]+"
MAX_PATTERNS = 20_000
SLICES = 8
ROWS_PER_CELL = 2_000
COPIES_AT_ONCE = 4_096
PLAN = "pattern array<string>, p int, tokens long, flow long, stretches array<struct<source: string, first: long, last: long>>"


@dataclass
class Mix:
    """``documents``: id, size, sources (keys), taken, taken_for; ``sources``: key, source, source_size, target, quota, reached."""

    documents: DataFrame
    sources: DataFrame


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float, total: int) -> list[float]:
    """``share * total`` dealt by weight; none over ``most`` times its size, what is over goes to the others by weight."""
    out, left, weight = [0.0] * len(sizes), share * total, sum(weights)
    for i in sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i]):
        if most * sizes[i] <= left / weight * weights[i]:
            out[i] = float(most * sizes[i])
            left, weight = left - most * sizes[i], weight - weights[i]
        else:
            out[i] = left / weight * weights[i]
    return out


class Network:
    """Arcs with room, and maximum flows on top of what flows already (blocking flows over shortest ways)."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for at, to, r in ((a, b, room), (b, a, 0)):
            self.arcs[at].append(len(self.to))
            self.to.append(to)
            self.room.append(r)
        return len(self.to) - 2

    def levels(self, start: int, end: int) -> list[int]:
        level = [-1] * len(self.arcs)
        level[start] = 0
        todo = deque([start])
        while todo:
            at = todo.popleft()
            for e in self.arcs[at]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[at] + 1
                    todo.append(self.to[e])
        return level

    def fill(self, start: int, end: int) -> None:
        while (level := self.levels(start, end))[end] >= 0:
            turn = [0] * len(self.arcs)
            way: list[int] = []
            at = start
            while True:
                if at == end:
                    least = min(self.room[e] for e in way)
                    for e in way:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    cut = next(i for i, e in enumerate(way) if not self.room[e])
                    at = self.to[way[cut] ^ 1]
                    del way[cut:]
                    continue
                while turn[at] < len(self.arcs[at]):
                    e = self.arcs[at][turn[at]]
                    if self.room[e] and level[self.to[e]] == level[at] + 1:
                        way.append(e)
                        at = self.to[e]
                        break
                    turn[at] += 1
                else:
                    if at == start:
                        break
                    at = self.to[way.pop() ^ 1]
                    turn[at] += 1


def route(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], most: int, slices: int = SLICES) -> list[dict[int, int]]:
    """Words from each pattern (sources, words) to each of its sources: quotas met as far as can be, repeats at least cost."""
    first = 1 + len(patterns)
    end = first + len(quotas)
    net = Network(end + 1)
    supply = [net.arc(0, 1 + p, 0) for p in range(len(patterns))]
    ways = [{s: net.arc(1 + p, first + s, most * size) for s in sources} for p, (sources, size) in enumerate(patterns)]
    for s, quota in enumerate(quotas):
        net.arc(first + s, end, quota)
    steps = [(0, 1, 1)] + [(copy * slices + i, copy * slices + i + 1, slices) for copy in range(1, most) for i in range(slices)]
    for a, b, parts in steps:  # in order of cost
        for p, (_, size) in enumerate(patterns):
            net.room[supply[p]] += b * size // parts - a * size // parts
        net.fill(0, end)
    return [{s: net.room[e ^ 1] for s, e in arcs.items() if net.room[e ^ 1]} for arcs in ways]


def narrowed(rows: DataFrame, limit: int) -> tuple[DataFrame, list]:
    """Rows, and their patterns with words. Beyond ``limit`` patterns the smaller ones count for one of their sources only, by hash."""
    sums = rows.filter(F.size("pattern") > 0).groupBy("pattern").agg(F.sum("size").alias("tokens"))
    found = sums.orderBy(F.desc("tokens"), "pattern").limit(limit + 1).collect()
    if len(found) <= limit:
        return rows, found
    spark = rows.sparkSession
    kept = spark.createDataFrame([(r.pattern, True) for r in found[:limit]], "pattern array<string>, _kept boolean")
    one = F.expr("array(pattern[cast(place % size(pattern) as int)])")
    rows = rows.join(F.broadcast(kept), "pattern", "left").withColumn("pattern", F.when(F.coalesce("_kept", F.size("pattern") < 2), F.col("pattern")).otherwise(one)).drop("_kept")
    sums = rows.filter(F.size("pattern") > 0).groupBy("pattern").agg(F.sum("size").alias("tokens")).orderBy("pattern")
    found = sums.limit(2 * limit + 1).collect()
    if len(found) > 2 * limit:
        raise ValueError(f"more than {limit} sources")
    return rows, found


def placed(rows: DataFrame, n_rows: int) -> DataFrame:
    """Each row with ``first``, the sizes before it in its pattern's order: by place, then id.

    A pattern is cut along place into coarse and fine cells; only sums of cells are added up over a pattern, and rows are
    ordered within a fine cell. Equal rows are counted first.
    """
    cells = min(max(64, n_rows // ROWS_PER_CELL), 1 << 24)
    wide = math.isqrt(cells)
    cut = rows.withColumn("fine", F.floor(F.col("place") * F.lit(float(cells)) / F.lit(HASH_RANGE)).cast("int"))
    before = lambda by, order: W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    fine = cut.groupBy("p", "fine").agg(F.sum("size").alias("in_cell")).withColumn("coarse", F.floor(F.col("fine") / wide))
    coarse = fine.groupBy("p", "coarse").agg(F.sum("in_cell").alias("in_coarse"))
    coarse = coarse.select("p", "coarse", F.coalesce(F.sum("in_coarse").over(before(["p"], ["coarse"])), F.lit(0)).alias("to_coarse"))
    heads = fine.join(coarse, ["p", "coarse"]).select("p", "fine", (F.col("to_coarse") + F.coalesce(F.sum("in_cell").over(before(["p", "coarse"], ["fine"])), F.lit(0))).alias("base"))
    equal = cut.groupBy("p", "fine", "place", "id", "size").agg(F.count(F.lit(1)).alias("n"))
    start = F.coalesce(F.sum(F.col("size") * F.col("n")).over(before(["p", "fine"], ["place", "id", "size"])), F.lit(0))
    return equal.withColumn("first", start).join(heads, ["p", "fine"]).withColumn("first", F.col("first") + F.col("base")).select("p", "id", "size", "n", "first")


def written_out(counted: DataFrame, workspace: Workspace) -> DataFrame:
    """A row for each of the ``n`` equal rows; many are dealt out in pieces."""
    counted = workspace.stage(counted, "placed")
    few = counted.filter(F.col("n") <= COPIES_AT_ONCE).withColumn("_from", F.lit(0).cast("long")).withColumn("_to", F.col("n") - 1)
    pieces = counted.filter(F.col("n") > COPIES_AT_ONCE).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES_AT_ONCE).cast("long"))))
    many = pieces.withColumn("_to", F.least(F.col("_from") + COPIES_AT_ONCE, F.col("n")) - 1).repartition("p", "first", "_from")
    out = few.unionByName(many).withColumn("_copy", F.explode(F.sequence("_from", "_to")))
    return out.withColumn("first", F.col("first") + F.col("_copy") * F.col("size")).drop("_from", "_to", "_copy", "n")


def mix(
    documents: DataFrame, workspace: Workspace, members: Column, weights: Sequence[int], share: float = 1.5, most: int = 2, seed: int = 0, key: str = "doc_id", text: str = "text", max_patterns: int = MAX_PATTERNS
) -> Mix:
    """Take ``share`` times all words from ``documents``, dealt over the sources by weight, no document more than ``most`` times.

    ``members`` is the array of a document's sources. Weights go to the sources by code point, null last, and repeat. A source's target
    ends at ``most`` times the words of its documents. Where sources overlap so that quotas cannot all be met, as much is taken as can be.
    """
    spark = documents.sparkSession
    workspace = Workspace(spark, f"{workspace.folder}/mix-{uuid.uuid4().hex}")
    given = F.coalesce(members, F.array().cast("array<string>"))
    order = F.concat(F.lit(f"{seed}:"), key_text(F.col(key)), F.lit(":"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    rows = documents.select(
        F.col(key).alias("id"),
        n_words(F.col(text)).alias("size"),
        F.array_sort(F.array_distinct(F.transform(given, key_text))).alias("pattern"),
        unit_hash(order).alias("place"),
    )
    rows = workspace.stage(rows, "sizes")
    n_rows, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    rows, found = narrowed(rows, max_patterns)
    names = sorted({s for r in found for s in r.pattern})
    number = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in found:
        for s in r.pattern:
            sizes[number[s]] += r.tokens
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, most, total)
    quotas = [math.floor(t + 0.5) for t in goal]
    found.sort(key=lambda r: r.pattern)
    flows = route([([number[s] for s in r.pattern], r.tokens) for r in found], quotas, most)
    plan, reached = [], [0] * len(names)
    for p, (r, flow) in enumerate(zip(found, flows, strict=True)):
        at, stretches = 0, []
        for s, words in sorted(flow.items()):
            stretches.append((names[s], at, at + words))
            at, reached[s] = at + words, reached[s] + words
        plan.append((r.pattern, p, r.tokens, at, stretches))
    table = F.broadcast(spark.createDataFrame(plan, PLAN))  # at most 2 * max_patterns rows
    line = placed(rows.join(table.select("pattern", "p"), "pattern").drop("pattern"), n_rows)
    starts = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda c: c * F.col("tokens") + F.col("first"))
    overlap = lambda a, b: F.aggregate(starts, F.lit(0).cast("long"), lambda sum_, s: sum_ + F.greatest(F.lit(0).cast("long"), F.least(b, s + F.col("size")) - F.greatest(a, s)))
    parts = F.transform("stretches", lambda x: F.struct(x["source"].alias("source"), overlap(x["first"], x["last"]).alias("words")))
    out = written_out(line, workspace).join(table, "p").select("id", "size", F.col("pattern").alias("sources"), overlap(F.lit(0), F.col("flow")).alias("taken"), F.filter(parts, lambda x: x["words"] > 0).alias("taken_for"))
    none = rows.filter(F.size("pattern") == 0).select("id", "size", F.col("pattern").alias("sources"), F.lit(0).cast("long").alias("taken"), F.expr("cast(array() as array<struct<source: string, words: long>>)").alias("taken_for"))
    listed = [(s, None if s == "null" else s[1:], sizes[i], goal[i], quotas[i], reached[i]) for s, i in number.items()]
    return Mix(out.unionByName(none), spark.createDataFrame(listed, "key string, source string, source_size long, target double, quota long, reached long"))


def mix_documents(documents: DataFrame, workspace: Workspace, weights: Sequence[int]) -> DataFrame:
    """Every document of a table with one ``source`` each: its size, its source's size and target, and the words taken of it."""
    mixed = mix(documents, workspace, F.array(F.col("source").cast("string")), weights)
    rows = mixed.documents.withColumn("key", F.col("sources")[0])
    return rows.join(F.broadcast(mixed.sources), "key").select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
