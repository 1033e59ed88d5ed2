"""Exact top-k search by inner product over KD-trees, one tree per shard of vectors.

A tree splits at the median of the widest dimension and keeps the tight bounding box and the smallest id of each node.
A query's best inner product with a box is ``sum(max(q * low, q * high))``. Nodes are visited best bound first, and a
node is skipped when its bound is below the k-th score so far, or equal with only larger ids. The k-th score is
passed on: a first round over one shard gives each query a k-th score to start from, and tasks carry it from tree to tree.

Vectors are dealt into shards by row number, so equal vectors spread; trees are written once to the shared
folder. Queries are taken in blocks of a fixed size, the only thing that is broadcast.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch.session import Workspace

ROWS_PER_SHARD = 8192
LEAF = 128
QUERY_BLOCK = 4096
EXACT = 2.0**52  # below this, sums of products of integers are exact in doubles

FOUND = T.StructType([T.StructField("query", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("uid", T.LongType()), T.StructField("score", T.LongType())])
TREE = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("shard", T.LongType()), T.StructField("tree", T.BinaryType())])


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null if the vector is null or holds null or non-finite components."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(wide, lambda x: F.floor(x * scale)))


def build_tree(rows: np.ndarray, ids: np.ndarray, uids: np.ndarray, leaf: int = LEAF) -> dict:
    """KD-tree over integer rows: the rows in leaf order, and per node its range, children, box and smallest id."""
    order = np.arange(len(rows))
    nodes: list[list[int]] = []  # start, end, left child (-1 for a leaf); the right child follows it
    lows, highs = [], []

    def add(start: int, end: int) -> int:
        part = rows[order[start:end]]
        nodes.append([start, end, -1])
        lows.append(part.min(axis=0) if len(part) else np.zeros(rows.shape[1]))
        highs.append(part.max(axis=0) if len(part) else np.zeros(rows.shape[1]))
        return len(nodes) - 1

    todo = [add(0, len(rows))]
    while todo:
        at = todo.pop()
        start, end, _ = nodes[at]
        spread = highs[at] - lows[at]
        if end - start <= leaf or not spread.size or not spread.max():
            continue
        middle = (end - start) // 2
        part = order[start:end]
        order[start:end] = part[np.argpartition(rows[part, int(spread.argmax())], middle, kind="introselect")]
        nodes[at][2] = add(start, start + middle)
        add(start + middle, end)
        todo += [nodes[at][2], nodes[at][2] + 1]
    ids = ids[order]
    smallest = np.array([ids[s:e].min() if e > s else 0 for s, e, _ in nodes])
    return {"rows": rows[order], "ids": ids, "uids": uids[order], "nodes": np.array(nodes), "low": np.array(lows), "high": np.array(highs), "smallest": smallest}


def search(tree: dict, queries: np.ndarray, own: np.ndarray, best: list[list[tuple]], k: int) -> None:
    """Bring ``best``, the k best (-score, id, uid) of each query so far, up to date with a tree."""
    big = float(max(np.abs(tree["rows"]).max(initial=0), 1)) * float(max(np.abs(queries).max(initial=0), 1)) * max(queries.shape[1], 1)
    kind = np.float64 if big < EXACT else np.int64
    rows, q = tree["rows"].astype(kind), queries.astype(kind)
    low, high = tree["low"].astype(kind), tree["high"].astype(kind)
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    nodes, smallest, ids, uids = tree["nodes"].tolist(), tree["smallest"].tolist(), tree["ids"], tree["uids"]
    for i in range(len(q)):
        mine, bound = best[i], bounds[i].tolist()
        heap = [(-bound[0], 0)]
        while heap:
            minus, at = heapq.heappop(heap)
            full = len(mine) == k
            if full and (minus, smallest[at]) > mine[-1][:2]:
                if minus > mine[-1][0]:
                    break
                continue
            start, end, left = nodes[at]
            if left >= 0:
                for child in (left, left + 1):
                    if not full or (-bound[child], smallest[child]) <= mine[-1][:2]:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            scores = rows[start:end] @ q[i]
            hits = np.flatnonzero(scores >= -mine[-1][0]) if full else np.arange(end - start)
            if len(hits) > 4 * k:  # the k best by (score, id, uid), one more for the query itself
                hits = hits[np.lexsort((uids[start + hits], ids[start + hits], -scores[hits]))[: k + 1]]
            fresh = [(-int(scores[h]), int(ids[start + h]), int(uids[start + h])) for h in hits if uids[start + h] != own[i]]
            mine[:] = heapq.nsmallest(k, mine + fresh)


def top_k(vectors: DataFrame, workspace: Workspace, k: int = 5, every: int = 50, scale: int = 256, rows_per_shard: int = ROWS_PER_SHARD, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k best matches of every row whose vec_id is divisible by ``every``, among all rows but the row itself.

    Scores are inner products of ``floor(scale * x)``; ties go to the smaller vec_id, then to the earlier row. Rows whose vector is
    null or has null or non-finite components, and rows without vec_id, take no part. Vectors of different length are not
    compared. Repeated rows are rows of their own: each is a candidate for the other. Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantized(F.col("embedding"), scale).alias("v"))
    rows = whole.filter("vec_id is not null and v is not null").withColumn("dim", F.size("v")).withColumn("uid", F.monotonically_increasing_id())
    rows = workspace.stage(rows, "vectors")
    shards = max(1, -(-rows.count() // rows_per_shard))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        matrix = np.array(part["v"].tolist(), dtype=np.int64).reshape(len(part), -1)
        tree = build_tree(matrix, part["vec_id"].to_numpy(), part["uid"].to_numpy())
        return pd.DataFrame({"dim": [part["dim"].iloc[0]], "shard": [part["shard"].iloc[0]], "tree": [pickle.dumps(tree)]})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("long"))
    trees = workspace.stage(dealt.groupBy("dim", "shard").applyInPandas(grow, TREE), "trees")
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    blocks = max(1, -(-asked.count() // query_block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    out = None
    for number in range(blocks):
        found = _search_block(spark, asked.filter(F.col("block") == number), trees, workspace, k, number)
        out = found if out is None else out.unionByName(found)
    per_query = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    best = out.withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= k)
    named = best.join(asked.select(F.col("uid").alias("query"), F.col("vec_id").alias("query_id")), "query")
    return named.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search_block(spark, asked: DataFrame, trees: DataFrame, workspace: Workspace, k: int, number: int) -> DataFrame:
    """The k best of each query of a block in the trees of each task."""
    by_dim: dict[int, list] = {}
    for row in asked.select("uid", "dim", "v").collect():  # a block: about query_block rows
        by_dim.setdefault(row.dim, []).append((row.uid, row.v))
    block = {d: (np.array([u for u, _ in x], dtype=np.int64), np.array([v for _, v in x], dtype=np.int64).reshape(len(x), -1)) for d, x in by_dim.items()}
    queries = spark.sparkContext.broadcast(block)

    def scan(start):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[int, list] = {}
            for batch in batches:
                for dim, blob in zip(batch["dim"], batch["tree"], strict=True):
                    if dim not in queries.value:
                        continue
                    own, q = queries.value[dim]
                    if dim not in best:
                        best[dim] = [list(start.value.get(int(u), ())) for u in own] if start else [[] for _ in own]
                    search(pickle.loads(blob), q, own, best[dim], k)
            for dim, lists in best.items():
                own = queries.value[dim][0]
                cells = [(int(own[i]), m[1], m[2], -m[0]) for i, mine in enumerate(lists) for m in mine]
                yield pd.DataFrame(cells, columns=FOUND.names).astype("int64")

        return run

    pilot = trees.filter(F.col("shard") == 0).mapInPandas(scan(None), FOUND)
    first: dict[int, list] = {}
    for row in pilot.collect():  # at most k rows a query of the block
        first.setdefault(row.query, []).append((-row.score, row.vec_id, row.uid))
    known = spark.sparkContext.broadcast({u: sorted(m)[:k] for u, m in first.items()})
    rest = trees.filter(F.col("shard") != 0).mapInPandas(scan(known), FOUND).distinct()
    pieces = workspace.stage(rest.unionByName(pilot).distinct(), f"found-{number}")
    return pieces
