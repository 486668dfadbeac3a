"""Generation, analysis, exports and power on hand-written rows."""

import json
import math
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadmill.operators import analysis, export, generation, power, prompts
from threadmill.plans import study
from threadmill.sources import schemas

SET = "submission_id string, model string, strategy string, comments array<struct<body: string, author_type: string>>"


def replies(spark, rows):
    return analysis.measured(spark.createDataFrame(rows, "submission_id string, group string, body string"))


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.integers(1, 60), min_size=1, max_size=40), min_size=1, max_size=6))
def test_length_stats_as_in_python(spark, groups):
    rows = [("s", f"g{g}", "w " * n) for g, lengths in enumerate(groups) for n in lengths]
    got = {r["group"]: r for r in analysis.length_stats(replies(spark, rows)).collect()}
    for g, lengths in enumerate(groups):
        r, n = got[f"g{g}"], len(lengths)
        assert r["n"] == n and r["mean"] == pytest.approx(statistics.mean(lengths)) and r["median"] == statistics.median(lengths)
        assert r["sd"] == pytest.approx(statistics.pstdev(lengths), abs=1e-9) and r["p90"] == sorted(lengths)[int(n * 0.9)]


@pytest.mark.parametrize("n,p90", [(1, 1), (9, 9), (10, 10), (11, 10), (20, 19)])
def test_p90_is_by_index(spark, n, p90):
    assert analysis.length_stats(replies(spark, [("s", "g", "w " * k) for k in range(1, n + 1)])).first()["p90"] == p90


def test_rates_and_empty_groups(spark):
    rows = [("a", "real", "x?"), ("b", "real", "y"), ("a", "m/dg", "z"), ("b", "m/dg", "z?"), ("c", "m/dg", "z"), ("d", "m/dg", "z"), ("d", "m/sag", "z")]
    dimension = spark.createDataFrame([(g,) for g in ("real", "m/dg", "m/sag", "m/sagii")], "group string")
    got = {r["group"]: (r["n"], r["rate"], r["ratio"]) for r in analysis.needle_rates(replies(spark, rows), dimension).collect()}
    assert got == {"real": (2, 50.0, 1.0), "m/dg": (4, 25.0, 2.0), "m/sag": (1, 0.0, None), "m/sagii": (0, None, None)}
    none = analysis.needle_rates(replies(spark, rows).where("group <> 'real'"), dimension).collect()
    assert all(r["ratio"] is None for r in none)


def test_bands_are_half_open_and_suppressed(spark):
    sizes = [24] * 30 + [25] * 29 + [49] + [50] * 15 + [99] * 14 + [100, 9_999] * 15 + [10_000] * 40
    r = analysis.needle_rates_by_band(replies(spark, [("s", "g", ("? " if i % 2 else "w ") * n) for i, n in enumerate(sizes)])).first()
    assert r["w0_25"] == 50.0 and r["w25_50"] is not None and r["w50_100"] is None and r["w100_10000"] is not None


def test_coverage_counts_missing_and_blank(spark):
    sets = [("a", "m", "x", [("b", "c"), (" \xa0", "c")]), ("a", "m", "y", []), ("b", "m", "x", [("b", "c")])]
    generated = spark.createDataFrame(sets, SET)
    ids = generated.select("submission_id")
    got = {(r["model"], r["strategy"]): (r["replies"], r["missing_sets"], r["blank_bodies"]) for r in analysis.coverage(ids, generated, ("m", "n"), ("x", "y")).collect()}
    assert got == {("m", "x"): (3, 0, 1), ("m", "y"): (0, 2, 0), ("n", "x"): (0, 2, 0), ("n", "y"): (0, 2, 0)}
    assert tuple(analysis.incomplete(ids, generated, ("m",), ("x",)).first()) == (2, 0) and tuple(analysis.incomplete(ids, generated, ("m",), ("x", "y")).first()) == (2, 2)


def test_pattern_threads(spark):
    rows = [("none", "real", "x"), ("none", "m/dg", "y"), ("real", "real", "x?"), ("real", "m/dg", "y"), ("both", "real", "x?"), ("both", "m/dg", "y?"), ("synthetic", "real", "x"), ("synthetic", "m/dg", "y?"), ("two", "real", "x?"), ("two", "real", "z"), ("alone", "real", "?")]
    frame = replies(spark, rows)
    assert sorted(r[0] for r in analysis.pattern_threads(frame).collect()) == ["alone", "real"]
    assert tuple(analysis.pattern_share(frame, 8).first()) == (2, 25.0)


def test_boxes_leave_outliers_out(spark):
    r = analysis.box_inputs(replies(spark, [("s", "g", "w " * n) for n in [*range(1, 12), 100]])).first()
    assert (r["low"], r["high"], r["median"]) == (1, 11, 6.5)


def test_order_of_replies(spark):
    rows = [("s", 5.0, "f", 0, 3, "c"), ("s", None, "f", 0, 9, "a"), ("s", 5.0, "f", 0, 4, "d"), ("s", 1.0, "f", 0, 7, "b")]
    frame = spark.createDataFrame(rows, "submission_id string, created_utc double, file_name string, file_block long, seq long, body string")
    assert [c["body"] for c in export.ordered_replies(frame, "body").first()["comments"]] == ["a", "b", "c", "d"]


def threads_frame(spark, sizes=(1, 3, 2)):
    return spark.createDataFrame([(f"s{i}", "T", "body", n) for i, n in enumerate(sizes)], "id string, title string, selftext string, n_comments long")


def test_strategies(spark):
    rows = threads_frame(spark)
    calls = generation.Calls(provider=lambda prompt, n, role: json.dumps([{"body": str(prompt.count("Comment ")), "author_type": role}] * (n + 1)), tries=1)
    for strategy, want in (("dg", {"s1": ["0"] * 3}), ("sag", {"s1": ["0"] * 3}), ("sagii", {"s1": ["0", "1", "2"]})):
        got = {r["submission_id"]: r for r in generation.generate(rows, generation.PROVIDERS["grok"], strategy, calls).collect()}
        assert [c["body"] for c in got["s1"]["comments"]] == want["s1"] and got["s1"]["calls"] == (1 if strategy == "dg" else 3)
        assert {r["status"] for r in got.values()} == {"done"} and len(got) == 3
    with pytest.raises(ValueError):
        generation.generate(rows, generation.PROVIDERS["grok"], "other")


def failing(prompt, n, role):
    raise ConnectionError("down")


def test_failures_are_kept_and_retried(spark, tmp_path):
    rows, path, provider = threads_frame(spark), str(tmp_path / "ck"), generation.PROVIDERS["openai"]
    bad = generation.Calls(provider=failing, tries=2, wait=lambda a: 0.0)
    study.generate_missing(spark, rows.where("id = 's1'"), provider, "sag", path, bad)
    r = study.generated_sets(spark, path).first()
    assert (r["status"], r["failures"], len(r["comments"]), r["comments"][0]["body"]) == ("failed", 3, 3, "") and "down" in r["error"]
    study.generate_missing(spark, rows, provider, "sag", path)
    assert {r["submission_id"]: r["status"] for r in study.generated_sets(spark, path).collect()} == {"s0": "done", "s1": "failed", "s2": "done"}
    study.generate_missing(spark, rows, provider, "sag", path, retry_failed=True)
    assert {r["status"] for r in study.generated_sets(spark, path).collect()} == {"done"}
    assert spark.read.json(path).count() == 4


@pytest.mark.parametrize("text,n,bodies", [('{"comments":[{"body":"a"},3,{"body":null}]}', 5, ["a", ""]), ('[{"body":"a"},{"body":"b"}]', 1, ["a"]), ('[{"body":7}]', 1, ["7"]), ("[]", 2, [])])
def test_validated_answers(text, n, bodies):
    assert [r["body"] for r in generation.validated(text, n)] == bodies


def test_invalid_answers_raise():
    for text in ("7", '{"comments": 3}', "no"):
        with pytest.raises(ValueError):
            generation.validated(text, 1)


def test_registry_and_choice():
    r = generation.registry(["grok=other"], ["openai=low"])
    assert r["grok"].model_id == "other" and r["openai"].reasoning_effort == "low"
    for bad in (["x=1"], ["grok"]):
        with pytest.raises(ValueError):
            generation.registry(bad)
    with pytest.raises(ValueError):
        generation.registry([], ["grok=huge"])
    assert generation.chosen("dg, sag", generation.STRATEGIES) == ["dg", "sag"]
    with pytest.raises(ValueError):
        generation.chosen("dg,x", generation.STRATEGIES)


def test_workload_and_cost(spark):
    got = {r["strategy"]: r for r in generation.workload(threads_frame(spark)).collect()}
    base = 5 / 4 + 200
    assert (got["dg"]["calls"], got["dg"]["tokens_in"], got["dg"]["tokens_out"]) == (3, 3 * base, 480)
    assert got["sag"]["tokens_in"] == 6 * base and got["sagii"]["tokens_in"] == 6 * base + 80 * (0 + 3 + 1)
    tokens = spark.createDataFrame([("grok", 2e6, 1e6), ("openai", 1e6, 0.0)], "model string, tokens_in double, tokens_out double")
    cost = {r["model"]: r["cost"] for r in generation.cost(tokens, generation.price_table(spark)).collect()}
    assert cost == {"grok": 8.0, "openai": 1.25, "TOTAL": 9.25}


def test_prompts(spark):
    row = spark.createDataFrame([("T{n}", None, 2, ["x", "y"])], "title string, selftext string, n_comments long, prior array<string>")
    t = prompts.Templates(thread="{title}|{body}|{n}|{mix}|{other}", incremental="{prior}#{role}")
    got = row.select(prompts.thread_prompt(t, prompts.role_mix(F.lit(1), F.lit(2))).alias("a"), prompts.incremental_prompt(F.lit("r"), F.col("prior"), t).alias("b")).first()
    assert got["a"] == "T{n}||2|1 by clinicians and 2 by laypersons|{other}" and got["b"] == "Comment 1: x\n\nComment 2: y\n\n#r"


def test_ratio_arms(spark):
    r = generation.ratio_arms(threads_frame(spark), prompts.RATIO_ARMS).where("submission_id = 's1'").first()
    assert r["n_top_level_comments"] == 3 and all(len(r[a]) == 3 for a in prompts.RATIO_ARMS)


def test_analysis_dataset_and_statistics(spark, tmp_path):
    from tests.test_corpus import posts_frame, replies_frame

    posts = posts_frame(spark, [{"id": "p", "title": None}, {"id": "q"}])
    own = replies_frame(spark, [{"parent_id": "t3_p", "body": "second?", "created_utc": 2.0}, {"parent_id": "t3_p", "body": "[removed]"}, {"parent_id": "t3_p", "body": "first", "created_utc": 1.0, "author_flair_text": "P"}])
    sets = [("p", "grok", "dg", [("x", "c")]), ("zz", "grok", "dg", [("x", "c")]), ("q", "openai", "sag", [("y", "c"), ("", "c")])]
    generated = spark.createDataFrame(sets, SET)
    records = study.analysis_dataset(posts, own, generated)
    got = {r["submission_id"]: r for r in records.collect()}
    assert set(got) == {"p", "q"} and got["p"]["title"] == "" and got["p"]["n_comments"] == 3 and got["q"]["real_comments"] == [] and got["q"]["n_comments"] == 0
    assert [c["body"] for c in got["p"]["real_comments"]] == ["first", "second?"] and len(got["p"]["synthetic"]["grok"]["dg"]) == 1 and got["p"]["synthetic"]["gemini"]["sagii"] == []
    study.write_analysis(records, str(tmp_path))
    assert spark.read.json(str(tmp_path / "analysis_dataset.jsonl.gz")).count() == 2
    real = spark.createDataFrame([("p", "first"), ("p", "second?")], "submission_id string, body string")
    tables = study.statistics(real, generated)
    assert tables["lengths"].count() == 10 and {r["group"]: r["n"] for r in tables["rates"].collect()}["real"] == 2
    assert tables["coverage"].count() == 9 and tables["incomplete"].first()["incomplete"] == 3
    t = analysis.totals_by_strategy(spark.createDataFrame([([1, 2], None), ([3], [1])], "a array<int>, b array<int>"), ("a", "b")).first()
    assert tuple(t) == (2, 3, 1, 1.5, 0.5)


def test_sheets(spark):
    threads = spark.createDataFrame([("a", "What: [is]* this/that? and so on and on", "B", 1, 1), ("b", None, None, 0, 0)], "submission_id string, title string, selftext string, n_clinician int, n_layperson int")
    real = spark.createDataFrame([("a", 1, None, "x"), ("a", 2, "P", "[removed]"), ("a", 3, "P", None)], "submission_id string, pos int, flair string, body string")
    made = spark.createDataFrame([("a", "sagii", 1, "c", "y"), ("a", "dg", 1, "c", "z")], "submission_id string, strategy string, pos int, author_type string, body string")
    rows = sorted(map(tuple, export.sheet_rows(threads, real, made).collect()))
    first = [r for r in rows if r[0] == 1]
    assert first[0][1] == "1. What is this that? an".replace("?", "").replace("this that", "thisthat")[:31] or len(first[0][1]) <= 31
    assert not set(export.ILLEGAL) & set(first[0][1])
    assert [r[3:] for r in first if r[2] == 1] == [(0, "Real Comments", None), (1, "Author Type", "Comment"), (2, "No flair", "x"), (3, "P", "")]
    assert [r[3:] for r in first if r[2] == 0][3] == (3, "Real breakdown:", "1 clinician, 1 layperson (2 total)")
    assert [r[4:] for r in first if r[2] == 4][-1] == ("c", "y") and [r for r in rows if r[0] == 2][0][1] == "2. OP 2"


def test_combined_records(spark):
    from tests.test_corpus import posts_frame, replies_frame

    arms = generation.ratio_arms(threads_frame(spark, (1,)).withColumn("id", F.lit("p")), prompts.RATIO_ARMS)
    own = replies_frame(spark, [{"id": "1", "parent_id": "t3_p"}]).withColumn("submission_id", F.lit("p"))
    r = export.combined_records(posts_frame(spark, [{"id": "p"}, {"id": "q"}]), own, arms).collect()
    assert len(r) == 1 and r[0]["submission"]["id"] == "p" and r[0]["real_comments"][0]["is_submitter"] is False and len(r[0]["submission"]) == 12 and len(r[0]["real_comments"][0]) == 7


def test_power(spark):
    z = statistics.NormalDist()
    rows = spark.createDataFrame([(0.103, 0.0805, 3882.0, 6475.0), (0.5, 0.5, 10.0, 10.0), (0.0, 0.0, 10.0, 10.0)], "p1 double, p2 double, n1 double, n2 double")
    got = [r["power"] for r in power.contrasts(rows).collect()]
    want = z.cdf(abs(0.103 - 0.0805) / math.sqrt(0.103 * 0.897 / 3882 + 0.0805 * 0.9195 / 6475) - z.inv_cdf(0.975))
    assert got[0] == pytest.approx(want) and got[1] == pytest.approx(0.025) and got[2] is None
    n = rows.select(power.required_n(F.col("p1"), F.col("p2"), 6475 / 3882).alias("n")).first()["n"]
    again = spark.createDataFrame([(0.103, 0.0805, float(n), n * 6475 / 3882)], rows.schema)
    assert power.contrasts(again).first()["power"] == pytest.approx(0.8, abs=1e-3)
    assert spark.range(1).select(power.interaction_threads(F.lit(15.94), 4, 3000.0).alias("n")).first()["n"] == 3000
    p = spark.createDataFrame([(0.01,), (0.02,), (0.5,)], "p_value double")
    assert [round(r["p_adjusted"], 6) for r in power.benjamini_hochberg(p).orderBy("p_value").collect()] == [0.03, 0.03, 0.5]


def test_schemas_parse():
    assert "removal_type" in schemas.REPLY.simpleString() and len(schemas.REPLIES) == 13


def test_arms_and_first_replies(spark):
    rows = spark.createDataFrame([("a", [("x", "c"), ("y", "l")], [])], "submission_id string, dg array<struct<body: string, author_type: string>>, sag array<struct<body: string, author_type: string>>")
    assert sorted(map(tuple, export.arms_long(rows, ("dg", "sag")).collect())) == [("a", "dg", 0, "c", "x"), ("a", "dg", 1, "l", "y")]
    assert [c["body"] for c in export.first_replies(rows, 1, "dg").first()["dg"]] == ["x"]
