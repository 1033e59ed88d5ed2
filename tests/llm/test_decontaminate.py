from __future__ import annotations

import random
import time

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import LONG
from tillwatch.llm import decontaminate as dc

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"


def brute(item, text, least):
    used_a, used_b, tiles = [0] * len(item), [0] * len(text), []
    while True:
        best, places = 0, []
        for x in range(len(item)):
            for y in range(len(text)):
                n = 0
                while x + n < len(item) and y + n < len(text) and item[x + n] == text[y + n] and not used_a[x + n] and not used_b[y + n]:
                    n += 1
                if n > best:
                    best, places = n, [(x, y)]
                elif n == best and n:
                    places.append((x, y))
        if best < least:
            return tiles
        for x, y in places:
            if not any(used_a[x : x + best]) and not any(used_b[y : y + best]):
                used_a[x : x + best] = used_b[y : y + best] = [1] * best
                tiles.append((x, y, best))


def test_tiles_equal_brute_force():
    for seed in range(300):
        rng = random.Random(seed)
        item, text = ([rng.randint(1, 3) for _ in range(rng.randint(1, n))] for n in (25, 40))
        least = rng.randint(1, 4)
        assert dc.tile(np.array(item), np.array(text), least) == brute(item, text, least)


def test_coverage_equals_brute_force_on_whole_texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 20)))) for i in range(12)]
    ready = dc.index(items, 3)
    for _ in range(60):
        text = " ".join(rng.choice([*vocabulary, "zz"]) for _ in range(rng.randint(0, 60)))
        expected = []
        for i, t in items:
            item = t.split()
            covered = sum(n for _, _, n in brute(item, text.split(), min(3, len(item))))
            if covered and covered >= 0.5 * len(item):
                expected.append((i, covered))
        assert [(x["item_id"], x["covered"]) for x in dc.leaks_of(text, ready, 3, 0.5)] == expected


def test_leaks_in_documents(spark, documents):
    words = ITEM.split()
    reordered = " ".join(words[12:] + ["and"] + words[6:12] + ["then"] + words[:6])
    rows = [
        (1, f"before {ITEM}, after"), (2, reordered.upper()), (3, "###".join(words)), (4, " ".join(words[:9]) + " other text"), (5, None), (6, ""), (7, LONG + " " + ITEM),
        (7, LONG + " " + ITEM), (None, ITEM), (8, " ".join(reversed(words))), (9, "short item"), (10, "short text item"),
    ]
    benchmark = spark.createDataFrame([(100, ITEM), (101, "short item"), (102, None), (103, ""), (104, "!!"), (100, ITEM)], "item_id bigint, text string")
    got = dc.leaks(documents(rows), benchmark).collect()
    assert sorted((r.doc_id or -1, r.item_id) for r in got) == sorted([(d, 100) for d in (1, 2, 3, 7, 7, -1)] * 2 + [(9, 101)])
    assert {r.n_tiles for r in got if r.doc_id == 2} == {3} and all(r.coverage == 1 for r in got)
    blocks = dc.leaks(documents(rows), benchmark, block_words=3).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, got))
    assert dc.leaks(documents(rows), benchmark.limit(0)).collect() == [] and dc.leaks(documents(rows).limit(0), benchmark).collect() == []
    assert set(documents(rows).columns) < set(dc.with_leaks(documents(rows), benchmark).columns)


def test_repeated_phrases_take_time_in_proportion():
    item = [w for i in range(100) for w in (*[1] * 5, 10 + i)]
    text = [w for _ in range(4000) for w in (*[1] * 5, 2)]
    start = time.process_time()
    tiles = dc.tile(np.array(item), np.array(text), 5)
    assert len(tiles) == 100 and {n for _, _, n in tiles} == {5} and time.process_time() - start < 1.5


def test_one_block_at_a_time(spark, documents):
    benchmark = spark.createDataFrame([(i, f"{ITEM} {i} {i}") for i in range(6)], "item_id bigint, text string")
    assert dc.block_count(benchmark, 20) > 3
    docs = documents([(1, f"{ITEM} 3 3"), (2, None), (2, "none of it"), (1, f"{ITEM} 3 3")]).withColumn("leaks", F.lit("old"))
    found = dc.with_leaks(docs, benchmark, block_words=20)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 0  # each block was looked up and written before
    got = [(r.doc_id, sorted(x.item_id for x in r.leaks)) for r in found.collect()]
    assert sorted(got) == [(1, list(range(6))), (1, list(range(6))), (2, []), (2, [])] and sorted(found.columns) == sorted(docs.columns)
