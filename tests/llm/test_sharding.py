from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tillwatch.llm import sharding


def shards(spark, keys, weights):
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint")
    return dict(map(tuple, rows.select("k", sharding.rendezvous(F.col("k"), weights)).collect()))


def test_rows_get_gapless_slots_and_right_digests(documents, workspace):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", "same", "äß😀", f"t{i}"])) for i in range(300)] + [(7, "twice"), (7, "twice"), (None, "no id"), (None, None)]
    got = sharding.shard_documents(documents(rows), workspace, [1.0] * 40).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.doc_id == 7}) == 1


def test_a_key_with_most_rows_is_numbered_in_pieces(spark, workspace):
    rows = spark.range(900).selectExpr("if(id < 700, 5, id) as doc_id", "0 as shard", "if(id < 700, 77, id * 1000003) as place")
    got = sharding.with_slots(rows, "shard", ["doc_id"], workspace, rows_per_bucket=20, chunk=64).collect()
    assert sorted(r.slot for r in got) == list(range(900)) and sum(r.doc_id == 5 for r in got) == 700
    assert len(sharding.with_slots(rows.limit(0), "shard", ["doc_id"], workspace).collect()) == 0


def test_weights_and_changes_of_the_shard_count(spark):
    keys = list(range(4000))
    few, more = shards(spark, keys, [1.0, 2.0, 0.0, 1.0]), shards(spark, keys, [1.0, 2.0, 0.0, 1.0, 4.0])
    share = Counter(few.values())
    assert share[2] == 0 and 0.45 < share[1] / len(keys) < 0.55
    assert all(more[k] in (few[k], 4) for k in keys)
    assert 0.45 < sum(more[k] == 4 for k in keys) / len(keys) < 0.55
