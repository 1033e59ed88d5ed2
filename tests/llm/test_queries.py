from __future__ import annotations

import pytest

from checks.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id item_id coverage",
    "op2": "doc_id size text_crc32 law shard slot grown_shard",
    "op3": "page_id url text n_chars",
    "op4": "query_id rank vec_id score",
    "op5": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op6": "doc_id n_shingles component_id",
    "op7": "doc_id held_out score predicted",
    "op8": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op9": "page_id host path rule verdict",
    "op10": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11": "doc_id size source_size target taken",
    "op12": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op13": "vec_id component n deviation whitened explained identity_error",
}


def test_one_query_for_each_operator():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(n.split("_")[0] for n in names) == sorted(COLUMNS) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op2_sharding", "op4_topk", "op11_mixing", "op12_prefix_trie"])
def test_sql(spark, name):
    from tillwatch.llm import queries

    if name in queries.oracle_sql():
        assert compare(spark, connect(FOLDER), FOLDER, queries.queries()[name], queries.oracle_sql()[name])[0] == ""


@pytest.mark.parametrize("name", ["op3_html", "op5_pii", "op8_secrets", "op9_url_filter", "op10_bpe"])
def test_a_row_for_each_row(spark, name):
    from tillwatch.llm import queries

    out = queries.queries()[name](spark, FOLDER)
    assert out.columns[: len(COLUMNS[name.split("_")[0]].split())] == COLUMNS[name.split("_")[0]].split()
    source = "pages" if "page_id" in out.columns else "documents"
    assert out.count() == spark.read.parquet(f"{FOLDER}/{source}.parquet").count()
