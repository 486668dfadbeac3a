"""The pipeline's stages on a small folder of tables, each against what it must do to planted rows."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    out = str(tmp_path_factory.mktemp("tables"))
    vocabulary = {x: ["".join(rng.choice(s) for _ in range(rng.randint(2, 3))) for _ in range(300)] for x, s in {"en": ["the", "ing", "tion", "er"], "fr": ["eau", "ou", "elle", "é"]}.items()}
    text = lambda x, n: " ".join(rng.choice(vocabulary[x]) for _ in range(n))
    rows = [(i, text("en" if i % 2 else "fr", 150), "en" if i % 2 else "fr", f"s{i % 3}") for i in range(60)]
    passage, item = text("en", 60), text("en", 30)
    rows.append((100, rows[3][1], "en", "s"))
    rows.append((101, rows[5][1] + " extra", "en", "s"))
    rows += [(110 + k, f"{text('en', 100)} {passage} {text('en', 40)}", "en", "s") for k in range(3)]
    rows += [(120, f"{text('en', 90)} {item} {text('en', 50)}", "en", "s"), (121, item + " end", "en", "s"), (130, None, "en", None), (131, "... 12", None, "s")]
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "cast(length(text) as bigint) AS n_chars", "1 AS rejected", "'x' AS kept")
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, item), (2, text("fr", 20))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, rows, passage, item


def test_each_stage(spark, folder, tmp_path):
    sf_dir, rows, passage, item = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append((name, {r["doc_id"]: r for r in docs.collect()}, docs.columns))
    assert [n for n, _, _ in seen] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "bpe_encoding"]
    assert all(c == columns for _, _, c in seen[:4])
    text = {r[0]: r[1] for r in rows}
    assert set(seen[0][1]) == set(text) - {130, 131}
    assert set(seen[1][1]) == set(seen[0][1]) - {100, 101}
    cut = seen[2][1]
    assert set(cut) == set(seen[1][1])
    for i, r in cut.items():
        if i in (111, 112):
            assert passage not in r["text"] and len(r["text"].split()) == 140 and r["n_chars"] == len(r["text"])
        elif i not in (121, 120):
            assert r["text"] == text[i]
    clean = seen[3][1]
    assert set(clean) == set(cut) - {121} and item not in clean[120]["text"] and all(clean[i]["text"] == cut[i]["text"] for i in clean if i != 120)
    assert set(seen[4][1]) == set(clean) and all(r["n_tokens"] == len(r["ids"]) > 0 for r in seen[4][1].values())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == set(clean)


def test_no_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder[0])
        assert out.count() == 0
        docs = out if "text" in out.columns else docs
