from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tillwatch.llm import prefix_trie as trie

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[: trie.DIGITS]


def brute_force(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, digest(role, text)), (role, text)))
    own = {c: [x for _, x in sorted(t)] for c, t in own.items()}
    paths = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + t[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
            if d:
                children[p[: d - 1]].add(p[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        words = len(node[-1][1].split()) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in below)
    return Counter(
        (
            min(m),
            len(node),
            min(members[node[:-1]]) if node else None,
            len(m),
            len(children[node]),
            leaves[node],
            saved[node],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if paths[c] == node).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def conversations(spark, rows):
    return spark.createDataFrame(rows, CONVERSATIONS).withColumns({c: F.lit("x") for c in ("path", "words", "n", "depth", "h", "base", "digests", "ends", "shard", "place", "of", "block")})


def random_rows(rng, n=150):
    said = ["yes", "no", "", None, "three  words\there", "äß 😀", "é"]
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randint(-45, 120), 1 << 40, 20, None])
        for turn in range(rng.randint(1, 4)):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(said)))
    return rows


@pytest.mark.parametrize("turns_per_shard", [1, 40, 10_000])
def test_equals_brute_force(spark, workspace, turns_per_shard):
    rows = random_rows(random.Random(turns_per_shard))
    own = workspace.stage(trie.turns(conversations(spark, rows)), "own")
    got = trie.trie(trie.rebuilt(own), workspace, turns_per_shard).collect()
    assert Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got) == brute_force(rows)


def test_hot_conversations_and_long_ones(spark, workspace):
    rows = [(c, turn, "user", text) for c in range(2000) for turn, text in enumerate(["hello there", "same", "as ever"] + ([f"but {c}"] if c % 7 == 0 else []))]
    rows += [(5000, turn, "user", f"turn {turn % 50}") for turn in range(3000)] + [(5020, turn, "user", f"turn {turn % 50}") for turn in range(2500)]
    got = trie.prefix_trie(conversations(spark, rows), workspace)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_force(rows)


def test_splitters_hold_every_node_that_shards_share():
    rng = random.Random(4)
    paths = sorted({"".join(rng.choice("ab") * trie.DIGITS for _ in range(rng.randint(0, 7))) for _ in range(300)})
    cuts = trie.splitters(rng.sample(paths, 60), 12)
    assert cuts == sorted(set(cuts)) and 5 <= len(cuts) <= 30
    skeleton = trie.skeleton_of(cuts)
    shards = defaultdict(set)
    for p in paths:
        for end in range(0, len(p) + 1, trie.DIGITS):
            shards[p[:end]].add(trie.bisect.bisect_right(cuts, p))
    assert all(node in skeleton for node, found in shards.items() if len(found) > 1) and all(node in shards for node in skeleton)


def test_conversations_without_turns_and_empty_tables(spark, workspace):
    assert trie.prefix_trie(conversations(spark, []), workspace).collect() == []
    assert trie.prefix_trie(conversations(spark, [(None, 0, "user", "x")]), workspace).collect() == []
    c = next(c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    got = trie.prefix_trie(conversations(spark, [(c, 0, "user", "x")]), workspace).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
