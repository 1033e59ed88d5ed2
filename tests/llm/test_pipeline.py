from __future__ import annotations

import random

import pytest

from tests.llm.test_toxicity import PLAIN, TOXIC

ITEM = "onre the hand erti into whole story of it was then ended here with no one left to tell any"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    at = str(tmp_path_factory.mktemp("tables"))
    prose = lambda n: " ".join(rng.choice(PLAIN) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        text, toxic = prose(60), i % 4 == 0
        if toxic:
            text += " " + " ".join(rng.choice(TOXIC) for _ in range(3))
        rows.append([i, text])
        labels.append((i, 1, int(toxic)))
    rows[1][1] = rows[2][1] = prose(80)  # copies
    rows[3][1] = rows[1][1] + " end"
    rows[5][1] += " " + ITEM
    rows[6][1] += " mail x@y.org 10.0.0.1"
    rows[7][1], rows[9][1] = None, ""
    docs = [(i, t, "en", "s", len(t or ""), "more") for i, t in rows]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, cls string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_take_effect(spark, folder):
    import corpus_pipeline as pipeline

    got = {r.doc_id: r for r in pipeline.run(spark, folder).collect()}
    clean = {i for i in range(240) if i % 4} - {2, 3, 5}
    assert set(got) == clean
    assert got[6].text.endswith("mail [EMAIL] [IP]") and got[6].n_chars == len(got[6].text)
    assert got[7].ids == got[9].ids == [] and got[7].text is None
    tokenizers = pytest.importorskip("tokenizers")
    from tillwatch.llm.queries import tokenizer_file

    library = tokenizers.Tokenizer.from_file(tokenizer_file())
    assert got[1].ids == library.encode(got[1].text, add_special_tokens=False).ids and got[1].n_tokens == len(got[1].ids)


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    import corpus_pipeline as pipeline

    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns[:5] == pipeline.DOCUMENT and (name == "bpe" or out.columns == pipeline.DOCUMENT)
        assert out.count() == 0
