from __future__ import annotations

import itertools
import random
import zlib

import numpy as np

from tests.llm.conftest import LONG
from tillwatch.llm import crf
from tillwatch.llm import toxicity as tx

TOXIC = ["moron", "scum", "trash"]
PLAIN = [f"{a}{b}" for a in ("the", "an", "on", "ing", "tion") for b in ("er", "re", "st", "ou", "nd")]


def text(rng, toxic, n=30):
    words = [rng.choice(PLAIN) for _ in range(n)]
    if toxic:
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(n)] = rng.choice(TOXIC) + rng.choice(["", ".", "%%%", "!"])
    return " ".join(words).capitalize()


def corpus(n=500, seed=1):
    rng = random.Random(seed)
    toxic = [int(rng.random() < 0.25) for _ in range(n)]
    return [(i, text(rng, y)) for i, y in enumerate(toxic)], [(i, 1, y) for i, y in enumerate(toxic)]


def test_marginals_and_best_tags_equal_brute_force():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 5):
        scores, between, start, end = rng.normal(size=(n, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
        weight, best = np.zeros((n, 3)), (-1e9, None)
        for tags in itertools.product(range(3), repeat=n):
            w = start[tags[0]] + sum(scores[i, t] for i, t in enumerate(tags)) + sum(between[a, b] for a, b in itertools.pairwise(tags))
            for i, t in enumerate(tags):
                weight[i, t] += np.exp(w)
            best = max(best, (w + end[tags[-1]], tags))
        assert np.allclose(weight / weight.sum(1, keepdims=True), crf.marginals(scores, between, start, np.array([0])))
        assert crf.viterbi(scores, between, start, end) == list(best[1])
    scores, between, start, first = rng.normal(size=(3000, 2)), rng.normal(size=(2, 2)), rng.normal(size=2), np.array([0, 5, 6, 700, 2999])
    apart = np.concatenate([crf.marginals(x, between, start, np.array([0])) for x in np.split(scores, first[1:])])
    assert np.allclose(apart, crf.marginals(scores, between, start, first))


def test_held_out_accuracy_and_spans(spark, documents):
    docs, labels = corpus()
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    scored = tx.with_toxicity(documents(docs), known).collect()
    truth = {i: y for i, _, y in labels}
    mine = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.toxicity.score >= 0.5) == bool(truth[r.doc_id]) for r in mine) / len(mine) > 0.95
    found = [r.text[s.start : s.end].lower() for r in scored for s in r.toxicity.spans]
    assert found and all(f.rstrip(".%!") in TOXIC for f in found)


def test_only_text_and_allowed_labels_matter(spark, documents):
    docs, labels = corpus(300)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    flipped = [(i, q, 1 - y if held(i) else y) for i, q, y in labels]
    scores = []
    for rows in (labels, flipped):
        known = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
        scores.append([r[0] for r in tx.with_toxicity(documents(docs), known).select("toxicity.score").collect()])
    assert scores[0] == scores[1]
    ids = [*range(20), None]
    table = documents([(i, "x") for i in ids])
    assert [r[0] for r in table.select(tx.held_out(table["doc_id"])).collect()] == [held(i) for i in range(20)] + [True]


def test_edge_rows(spark, documents):
    docs, labels = corpus(200)
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (4, 1, 0), (4, 1, 1), (99999, 0, 1)], "doc_id bigint, quality int, toxic int")
    edge = [(1001, None), (1002, ""), (1003, " \n"), (1004, LONG), (1004, LONG), (None, "moron scum trash")]
    got = tx.with_toxicity(documents(docs + edge), known).filter("doc_id > 1000 or doc_id is null").collect()
    assert len(got) == 6 and all(0 <= r.toxicity.score <= 1 for r in got)
    by = {r.doc_id: r.toxicity.score for r in got}
    assert by[1001] == by[1002] == by[1003] < 0.5 < by[None] and by[1004] < 0.5
    for labels_ in (known.limit(0), known.filter("toxic = 0")):
        assert all(r.toxicity.score < 0.5 for r in tx.with_toxicity(documents(edge), labels_).collect())
    assert tx.with_toxicity(documents(docs).limit(0), known).collect() == []
    assert list(tx.scored([t for _, t in docs[:9]], tx.fit([]), {}, 0.5)) and tx.training_rows(documents(docs), known, sample=5) != []


def test_batches_do_not_change_scores(monkeypatch):
    docs, labels = corpus(120)
    model = tx.fit([(t, y, i % 2) for (i, t), (_, _, y) in zip(docs, labels, strict=True)])
    texts = [t for _, t in docs]
    whole = [x["score"] for x in tx.scored(texts, model, {}, 0.5)]
    monkeypatch.setattr(tx, "BATCH_TOKENS", 40)
    assert np.allclose(whole, [x["score"] for x in tx.scored(texts, model, {}, 0.5)])
