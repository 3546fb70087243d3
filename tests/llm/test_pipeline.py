import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = [n for n, _ in corpus_pipeline.STAGES], docs.count()
    assert names == ["toxicity", "jaccard_join", "substring_dedup", "secret_scans", "best_fit_packing"]
    columns, sizes = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes[name] = docs.count()
        if name != names[-1]:
            assert docs.columns == columns
    assert before >= sizes["toxicity"] > sizes["jaccard_join"] == sizes["substring_dedup"] == sizes["secret_scans"]
    assert sizes["jaccard_join"] > 0.8 * before
    packed = docs.collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in spark.read.parquet(str(tmp_path / "secret_scans")).collect()}


@pytest.mark.parametrize("schema", ["doc_id bigint, text string, lang string, source string, n_chars bigint"])
def test_stages_take_an_empty_table(spark, schema):
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
