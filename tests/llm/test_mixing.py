from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tillwatch.llm import mixing

CLASHES = ("id", "p", "n", "first", "tokens", "flow", "key", "pattern", "place", "size", "taken", "fine", "base", "target")


def table(spark, rows, kind="array<string>"):
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, source {kind}")
    return docs.withColumns({name: F.lit("x") for name in CLASHES})


def sized(text):
    return len((text or "").split())


def test_targets_are_dealt_by_weight_and_end_at_twice_the_source():
    assert mixing.targets([100, 100, 100], [1, 1, 1], 1.5, 2, 300) == [150, 150, 150]
    got = mixing.targets([10, 1000, 1000], [3, 1, 2], 1.5, 2, 2010)
    assert got[0] == 20 and abs(sum(got) - 3015) < 1e-9 and abs(got[2] - 2 * got[1]) < 1e-9
    assert mixing.targets([0, 5], [1, 1], 1.5, 2, 5) == [0, 7.5] and mixing.targets([], [], 1.5, 2, 0) == []
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 50, 10**6, 10**12]) for _ in range(rng.randint(1, 9))]
        got = mixing.targets(sizes, [[3, 1, 2][i % 3] for i in range(len(sizes))], 1.5, 2, sum(sizes))
        assert abs(sum(got) - 1.5 * sum(sizes)) <= 1e-9 * sum(sizes) and all(0 <= t <= 2 * s for t, s in zip(got, sizes))


def most_flow(patterns, quotas, copies):
    """The least cut: which sources' quotas are cut, else all that leads to them."""
    cuts = []
    for kept in itertools.product([False, True], repeat=len(quotas)):
        cuts.append(sum(q for q, k in zip(quotas, kept) if not k) + sum(copies * size for sources, size in patterns if any(kept[s] for s in sources)))
    return min(cuts)


def test_flows_are_largest_and_repeat_least():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 5)
        patterns = [(sorted(rng.sample(range(n), rng.randint(1, n))), rng.randint(0, 40)) for _ in range(rng.randint(1, 8))]
        quotas = [rng.randint(0, 80) for _ in range(n)]
        flows = mixing.route(patterns, quotas, 2)
        into = Counter()
        for flow, (sources, size) in zip(flows, patterns):
            assert set(flow) <= set(sources) and sum(flow.values()) <= 2 * size
            into.update(flow)
        assert all(into[s] <= q for s, q in enumerate(quotas))
        assert sum(into.values()) == most_flow(patterns, quotas, 2)
        assert sum(min(sum(f.values()), size) for f, (_, size) in zip(flows, patterns)) == most_flow(patterns, quotas, 1)


def test_repeats_are_even():
    flows = mixing.route([([0], 800), ([0], 800), ([0], 800)], [3600], 2)
    assert [sum(f.values()) for f in flows] == [1200] * 3


def test_overlapping_sources(spark, workspace):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(0, 30), rng.sample(["a", "b", "c", None], rng.randint(0, 3))) for i in range(400)]
    rows += [(5, "again and again", ["b", "b"])] * 50 + [(None, None, None), (None, "x y", ["a"]), (9, "long " * 20_000, ["c", "a"])]
    mixed = mixing.mix(table(spark, rows), workspace, F.col("source"), [3, 1, 2])
    got, again = (mixing.mix(table(spark, rows), workspace, F.col("source"), [3, 1, 2]).documents.collect() for _ in range(2))
    assert Counter(map(str, got)) == Counter(map(str, again)) == Counter(map(str, mixed.documents.collect()))
    assert Counter((r.id, r.size) for r in got) == Counter((i, sized(t)) for i, t, _ in rows)
    reached = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(x.words for x in r.taken_for)
        for x in r.taken_for:
            assert x.source in r.sources
            reached[x.source] += x.words
    sources = mixed.sources.collect()
    assert [r.source for r in sources] == ["a", "b", "c", None]
    assert all(reached[r.key] == r.reached <= r.quota for r in sources) and sum(r.reached for r in sources) > 0.9 * sum(r.quota for r in sources)


def test_one_source_a_document(spark, workspace):
    rng = random.Random(11)
    rows = [(i, "w\t\x0bé " * rng.randint(0, 20), rng.choice(["hot", "hot", "hot", "b", "", None, "é", "😀"])) for i in range(600)]
    got = mixing.mix_documents(table(spark, rows, "string"), workspace, [3, 1, 2]).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, sized(t)) for i, t, _ in rows)
    source = {i: s for i, _, s in rows}
    words = Counter()
    for i, t, s in rows:
        words[s] += sized(t)
    order = sorted((s for s in words if s is not None)) + [None]
    goal = dict(zip(order, mixing.targets([words[s] for s in order], [3, 1, 2, 3, 1, 2], 1.5, 2, sum(words.values()))))
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == words[s] and abs(r.target - goal[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in order)


def test_many_equal_rows_are_written_in_pieces(spark, workspace, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES_AT_ONCE", 16)
    got = mixing.mix_documents(table(spark, [(1, "a b c", "s")] * 100 + [(2, "d", "s")], "string"), workspace, [1]).collect()
    assert len(got) == 101 and sum(r.taken for r in got) == 452 and {r.size for r in got if r.doc_id == 1} == {3}


def test_more_patterns_than_the_driver_takes(spark, workspace):
    rng = random.Random(2)
    names = [f"s{i}" for i in range(6)]
    rows = [(i, "w " * rng.randint(1, 9), rng.sample(names, rng.randint(1, 4))) for i in range(300)]
    mixed = mixing.mix(table(spark, rows), workspace, F.col("source"), [1], max_patterns=8)
    got = mixed.documents.collect()
    assert len(got) == 300 and len({tuple(r.sources) for r in got}) <= 16 and all(set(s[1:] for s in r.sources) <= set(rows[r.id][2]) for r in got)
    assert all(abs(r.reached - r.quota) <= 1 for r in mixed.sources.collect())


def test_empty_table(spark, workspace):
    assert mixing.mix_documents(table(spark, [], "string"), workspace, [3, 1, 2]).collect() == []
    assert mixing.mix_documents(table(spark, [(1, None, None)], "string"), workspace, [3, 1, 2]).collect()[0].taken == 0
