"""run() writes each stage's rows but the last's and reads them again."""

import corpus_pipeline


def test_stages_are_written(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(docs.inputFiles())
        return docs.where("doc_id > 0")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage), ("three", stage)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 2
    assert "documents.parquet" in seen[0][0] and "/one/" in seen[1][0] and "/two/" in seen[2][0]
