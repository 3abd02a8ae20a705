"""The contract's queries: DuckDB's rows where SQL can express them, and their shape on real tables."""

import pytest

from tests.conftest import rows_of
from textloom.llm import queries as Q

SHAPES = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op2_language_id": "doc_id held_out lang_pred score",
    "op3_benchmark_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated", "op4_quality_classifier": "doc_id held_out score predicted",
    "op5_ngram_jaccard": "doc_id n_shingles component_id", "op6_substring_dedup": "doc_id n_words n_removed kept_sha256", "op7_token_output": "doc_id start n_tokens ids_crc32",
    "op8_url_filters": "page_id host path rule verdict", "op9_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans", "op10_source_mixing": "doc_id size source_size target taken",
    "op11_multiprobe_neighbours": "query_id rank vec_id score", "op12_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op13_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
}


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, data, duck, name):
    got, want = Q.QUERIES[name](spark, data).toPandas(), duck.sql(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_shape(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    assert df.columns[: len(SHAPES[name].split())] == SHAPES[name].split()
    rows = spark.read.parquet(f"{data}/{'pages' if name.startswith('op8') else 'documents'}.parquet").count()
    if name not in Q.ORACLES and not name.startswith("op11"):
        assert df.count() == rows


def test_pipeline_stages(spark, data):
    import corpus_pipeline as P
    from tests.llm import brute

    docs = spark.read.parquet(f"{data}/documents.parquet")
    item = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in P.STAGES:
        out = stage(spark, docs, data)
        if name != "token_output":
            assert out.columns == docs.columns
        rows = out.cache().collect()
        ids = {r.doc_id for r in rows}
        if name == "quality_rules":
            assert all(not brute.quality(before[i])[5] for i in ids)
        if name == "ngram_jaccard":
            assert ids == set(brute.components(sorted(before.items())).values())
        if name == "decontamination":
            assert ids == {i for i, t in before.items() if not brute.contaminated(t, item)[4]}
        if name == "source_mixing":
            assert ids <= set(before)
        if name == "token_output":
            assert len(rows) == docs.count()
            break
        docs, before = out, {r.doc_id: r.text for r in rows}
