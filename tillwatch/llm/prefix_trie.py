"""The trie of conversation prefixes, by sorted shards and the skeleton of their splitters.

A conversation is a path of turns; a turn is known by 32 hexadecimal digits of the SHA-256 of role and text, so texts are not
shuffled. Equal paths are counted first. Distinct paths are then cut into shards of neighbours by splitter paths. A node whose
conversations lie in more than one shard is a prefix of a splitter, so the trie of splitters (the skeleton, which is broadcast) holds all nodes that a
shard cannot finish. Each shard runs once along its sorted paths with a stack of open nodes, finishes all its other nodes, and leaves a
partial aggregate for each skeleton node it meets. The partial aggregates are added up per node, and the skeleton, of at most
SKELETON nodes, is summed from the leaves to the root.

Splitters come from a sample and are cut where they part from their neighbour; they decide how work is dealt, not what comes out. A hot prefix is
split like any other; hot paths are one row. A path must fit in memory (32 bytes a turn); nothing else of a shard must.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.mixing import n_words
from tillwatch.session import Workspace

DIGITS = 32  # hexadecimal digits of a turn
SHARED = 3  # the most turns taken from another conversation
FAMILY = 20
IDS_PER_BLOCK = 10  # bits: ids that share all higher bits are joined in one task
TURNS_PER_SHARD = 4_000
MOST_SHARDS = 4_096
SAMPLED = 4  # paths for each splitter
SPLITTER_TURNS = 512
SKELETON = 1 << 18
NO_ENDS = hashlib.sha256(b"").hexdigest()

PATHS = "path string, words array<int>, n long, least long, ends string"
CLOSED = "place long, depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string, skeleton int"
NODES = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string, skeleton int, parent_skeleton int"


def turns(conversations: DataFrame) -> DataFrame:
    """A row for each conversation: digests and word counts of its turns, by turn (null first), equal turns by digest.

    Null role and text count as empty. Rows without conv_id are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGITS)
    turn = F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce(F.col("turn"), F.lit(0)).alias("turn"), digest.alias("digest"), n_words(F.col("text")).cast("int").alias("words"))
    rows = conversations.filter("conv_id is not null").select("conv_id", turn.alias("of"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("of")).alias("of")).select("conv_id", F.col("of.digest").alias("digests"), F.col("of.words").alias("words"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Every conversation c with its first h turns from conversation c - c % FAMILY, if that exists; h = crc32(c) % 4."""
    base = own.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("digests", 1, SHARED).alias("base_digests"), F.slice("words", 1, SHARED).alias("base_words"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)).cast("int")
    rows = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(base, "base", "left")

    def joined(shared: str, mine: str) -> Column:
        first = F.coalesce(F.slice(shared, F.lit(1), F.col("h")), F.slice(mine, 1, 0))
        return F.concat(first, F.slice(mine, F.col("h") + 1, F.greatest(F.size(mine), F.lit(1))))

    return rows.select("conv_id", joined("base_digests", "digests").alias("digests"), joined("base_words", "words").alias("words"))


def with_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct paths from blocks of their ids, sorted by path and block; the ids are hashed as they come."""
    key = row = sha = None
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if r.path_key != key:
                if row:
                    out.append((*row, sha.hexdigest()))
                key, row, sha = r.path_key, [r.path, r.words, r.n, r.least], hashlib.sha256(r.ids.encode())
            else:
                row[2], row[3] = row[2] + r.n, min(row[3], r.least)
                sha.update(b"," + r.ids.encode())
        if out:
            yield pd.DataFrame(out, columns=["path", "words", "n", "least", "ends"])
    if row:
        yield pd.DataFrame([(*row, sha.hexdigest())], columns=["path", "words", "n", "least", "ends"])


def distinct_paths(rows: DataFrame) -> DataFrame:
    """Each path once: its word counts, how many conversations it has, their smallest id and the digest of their ids in order."""
    path = F.array_join("digests", "")
    keyed = rows.select("conv_id", path.alias("path"), "words", F.shiftright("conv_id", IDS_PER_BLOCK).alias("block")).withColumn("path_key", F.substring(F.sha2("path", 256), 1, DIGITS))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = keyed.groupBy("path_key", "block").agg(F.first("path").alias("path"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), ids.alias("ids"))
    return blocks.repartition("path_key").sortWithinPartitions("path_key", "block").mapInPandas(with_ends, PATHS)


def shared_turns(a: str, b: str) -> int:
    n = min(len(a), len(b))
    at = 0
    while at < n and a[at : at + DIGITS] == b[at : at + DIGITS]:
        at += DIGITS
    return at // DIGITS


def splitters(sample: list[str], shards: int) -> list[str]:
    """At most ``shards - 1`` paths between the sampled ones, each cut one turn after it parts from the one before; their trie has at most SKELETON nodes."""
    paths = sorted(set(sample))
    step = max(1, len(paths) // shards)
    out, size = [], 1
    for i in range(step, len(paths), step):
        cut = paths[i][: DIGITS * (shared_turns(paths[i - 1], paths[i]) + 1)]
        if not out or cut > out[-1]:
            size += len(cut) // DIGITS - (shared_turns(out[-1], cut) if out else 0)
            if size > SKELETON:
                break
            out.append(cut)
    return out


def skeleton_of(cuts: list[str]) -> dict[str, int]:
    """All prefixes of the splitters, the root first, numbered so that parents come before children."""
    nodes = {""}
    for cut in cuts:
        nodes.update(cut[:end] for end in range(DIGITS, len(cut) + 1, DIGITS))
    return {node: i for i, node in enumerate(sorted(nodes, key=lambda n: (len(n), n)))}


def closing(skeleton: dict[str, int]):
    """Sorted paths to closed nodes, children before parents."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # An open node: digest, words, skeleton number or -1, n_convs, least, n_children, n_leaves, saved, ends
        stack: list[list] = []
        path, place = "", 0
        columns = [c.split()[0] for c in CLOSED.split(", ")]

        def pop(out: list) -> None:
            nonlocal place
            _, words, number, n, least, children, leaves, saved, ends = stack.pop()
            if number < 0:
                leaves = leaves or 1
                saved += (n - 1) * words
                above = stack[-1]
                above[3] += n
                above[4] = least if above[4] is None else min(above[4], least)
                above[5] += 1
                above[6] += leaves
                above[7] += saved
            out.append((place, len(stack), least, n, children, leaves, saved, words, ends, number))
            place += 1

        for batch in batches:
            out: list = []
            for r in batch.itertuples(index=False):
                keep = shared_turns(path, r.path) + 1 if stack else 0
                while len(stack) > keep:
                    pop(out)
                path = r.path
                for depth in range(len(stack), len(path) // DIGITS + 1):
                    number = skeleton.get(path[: DIGITS * depth], -1) if not stack or stack[-1][2] >= 0 else -1
                    stack.append([path[DIGITS * (depth - 1) : DIGITS * depth], int(r.words[depth - 1]) if depth else 0, number, 0, None, 0, 0, 0, None])
                top = stack[-1]
                top[3] += r.n
                top[4] = r.least if top[4] is None else min(top[4], r.least)
                top[8] = r.ends
                if len(out) > 8192:
                    yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})
                    out = []
            yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})
        out = []
        while stack:
            pop(out)
        yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})

    return task


def with_parents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Closed nodes in reverse, so parents before children: each gets its parent's conv_id, or the number of its parent in the skeleton."""
    above: list[tuple[int | None, int]] = []  # of the open node at each depth: conv_id, number
    for batch in batches:
        parents, numbers = [], []
        for depth, conv_id, number in zip(batch["depth"].to_numpy(), batch["conv_id"].array, batch["skeleton"].to_numpy(), strict=True):
            del above[depth:]
            conv, parent = above[-1] if above else (None, -1)
            parents.append(None if parent >= 0 else conv)
            numbers.append(parent)
            above.append((None if number >= 0 else int(conv_id), int(number)))
        out = batch.drop(columns="place")
        out["parent_conv_id"], out["parent_skeleton"] = pd.array(parents, dtype="Int64"), numbers
        yield out[[c.split()[0] for c in NODES.split(", ")]].astype({"conv_id": "Int64"})


def finished(skeleton: dict[str, int], partial: list) -> list[tuple]:
    """The skeleton's nodes from their summed partial aggregates, leaves first."""
    of = {r.skeleton: r for r in partial}
    least = {i: r.conv_id for i, r in of.items()}
    total = {i: [r.n_convs, r.n_children, r.n_leaves, r.saved_tokens] for i, r in of.items()}
    above = {i: skeleton[node[:-DIGITS]] for node, i in skeleton.items() if node}
    for i in sorted(of, reverse=True):
        sums = total[i]
        sums[2] = sums[2] or 1
        if i in above:
            sums[3] += (sums[0] - 1) * of[i].words
            up = total[above[i]]
            up[0], up[1], up[2], up[3] = up[0] + sums[0], up[1] + 1, up[2] + sums[2], up[3] + sums[3]
            ids = [c for c in (least[above[i]], least[i]) if c is not None]
            least[above[i]] = min(ids)
    depth = {i: len(node) // DIGITS for node, i in skeleton.items()}
    return [(i, least[i], depth[i], least[above[i]] if i in above else None, *total[i], of[i].ends) for i in sorted(of)]


def trie(rows: DataFrame, workspace: Workspace, turns_per_shard: int = TURNS_PER_SHARD) -> DataFrame:
    """The nodes of the trie of ``rows`` (conv_id, digests, words): see ``prefix_trie``."""
    spark = rows.sparkSession
    workspace = Workspace(spark, f"{workspace.folder}/trie-{uuid.uuid4().hex}")
    paths = workspace.stage(distinct_paths(rows), "paths")
    n_paths, n_turns = paths.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words") + 1), F.lit(0))).first()
    shards = int(min(MOST_SHARDS, max(2, n_turns // turns_per_shard)))
    fraction = min(1.0, shards * SAMPLED / max(n_paths, 1))
    sample = [r[0] for r in paths.select(F.substring("path", 1, DIGITS * SPLITTER_TURNS)).sample(fraction, seed=1).limit(4 * shards * SAMPLED).collect()]
    cuts = splitters(sample, shards)
    skeleton = skeleton_of(cuts)

    @F.pandas_udf("int")
    def shard_of(path: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(cuts, p) for p in path], dtype=np.int32)

    dealt = paths.withColumn("shard", shard_of("path")).repartition(len(cuts) + 1, "shard").sortWithinPartitions("shard", "path")
    closed = dealt.select("path", "words", "n", "least", "ends").mapInPandas(closing(skeleton), CLOSED)
    nodes = workspace.stage(closed.sortWithinPartitions(F.desc("place")).mapInPandas(with_parents, NODES), "nodes")
    partial = nodes.filter("skeleton >= 0").groupBy("skeleton")
    partial = partial.agg(F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.max("ends").alias("ends"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]).collect()
    columns = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
    top = spark.createDataFrame(finished(skeleton, partial), f"skeleton int, {columns}")
    names = [c.split()[0] for c in columns.split(", ")]
    parent = F.broadcast(top.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("_parent")))  # at most SKELETON rows
    rest = nodes.filter("skeleton < 0").join(parent, "parent_skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
    return rest.select(*names).unionByName(top.select(*names)).withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS))).drop("ends")


def prefix_trie(conversations: DataFrame, workspace: Workspace) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations, from the root of no turns.

    Its smallest conversation, depth, the parent's smallest conversation, numbers of conversations, children and leaves below, the
    words that storing the subtree once saves, and the digest of the ids that end there. Repeated rows are turns of their own. An empty table gives no rows.
    """
    own = workspace.stage(turns(conversations), "turns")
    return trie(rebuilt(own), workspace).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
