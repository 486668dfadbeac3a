"""Ingest, corpus building and eligibility on hand-written rows."""

import base64
import gzip
import json

import pytest
from pyspark.sql import functions as F

from threadmill.operators import corpus, match, sampling, threads
from threadmill.plans import ingest, study
from threadmill.sources import ndjson, schemas
from threadmill.streaming.ingest import matched_stream, write_stream


def write(path, lines, end="\n"):
    import zstandard

    data = ("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + end).encode()
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(zstandard.compress(data) if path.suffix == ".zst" else data)


@pytest.fixture
def dumps(tmp_path):
    write(tmp_path / "d/x/RC_2025-01.zst", [{"subreddit": "AskThings", "id": "1"}, {"subreddit": "asktHINGS", "id": "2"}, {"subreddit": "other", "id": "3"}, "", "   "])
    write(tmp_path / "d/RS_2025-02.zst", [{"subreddit": "ASKTHINGS", "id": "4"}, {"subreddit": "Else", "id": "5"}], end="")
    write(tmp_path / "d/notes.zst", [{"subreddit": "AskThings", "id": "9"}])
    return str(tmp_path / "d")


def ids(frame):
    return sorted(json.loads(r["raw"])["id"] for r in frame.select("raw").collect())


@pytest.mark.parametrize("mode,values,found", [("exact", ["askthings"], ["1", "2", "4"]), ("partial", ["thing", "els"], ["1", "2", "4", "5"]), ("regex", ["^else$", "^o"], ["3", "5"]), ("regex", ["ELSE"], []), ("exact", [], [])])
def test_match_modes(spark, dumps, mode, values, found):
    lines = ndjson.read_lines(spark, dumps, ndjson.DUMP_NAME, recursive=True).where("trim(value) <> ''")
    assert ids(match.matching(match.classify(lines, match.Match("subreddit", tuple(values), mode)))) == found


def test_value_list_is_joined(spark):
    rows = spark.createDataFrame([("A",), ("b",), (None,), ("c",)], "f string")
    values = spark.createDataFrame([("a",), ("B ",), ("",)], "v string")
    assert sorted(r["f"] for r in match.match_values(rows, "f", values).collect()) == ["A", "b"]


def test_errors_are_counted_and_gated(spark, tmp_path):
    good, bad = {"subreddit": "a"}, ["{broken", {"x": 1}, {"subreddit": None}]
    write(tmp_path / "RC_1.txt", [good] * 99 + bad[:1])
    write(tmp_path / "RC_2.txt", [good] * 10 + bad)
    plan = ingest.Ingest(str(tmp_path), match.Match("subreddit", ("a",)))
    report = {r["file_name"]: r for r in ingest.manifest(spark, plan).collect()}
    assert (report["RC_1.txt"]["lines_processed"], report["RC_1.txt"]["error_lines"], report["RC_1.txt"]["lines_matched"]) == (100, 1, 99)
    assert report["RC_2.txt"]["error_lines"] == 3 and report["RC_2.txt"]["kind"] == "COMMENT"
    with pytest.raises(ingest.TooManyErrors, match="RC_2.txt: 3 of 13"):
        ingest.run(spark, plan, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_split_write_and_resume(spark, dumps, tmp_path):
    plan, out = ingest.Ingest(dumps, match.Match("subreddit", ("askthings", "else")), error_percent=60), str(tmp_path / "out")
    assert not ingest.is_done(spark, plan, out)
    ingest.run(spark, plan, out)
    assert ingest.is_done(spark, plan, out) and not ingest.is_done(spark, ingest.Ingest(dumps, match.Match("subreddit", ("else",))), out)
    back = spark.read.text(f"{out}/matched").where("kind = 'SUBMISSION' AND prefix = 'a'")
    assert [json.loads(r["value"])["id"] for r in back.collect()] == ["4"]
    names = {(r["kind"], r["value_lc"]): r["display"] for r in spark.read.json(f"{out}/names").collect()}
    assert names == {("COMMENT", "askthings"): "AskThings", ("SUBMISSION", "askthings"): "ASKTHINGS", ("SUBMISSION", "else"): "Else"}


def test_kind_of_other_names_raises(spark):
    assert [r[0] for r in spark.createDataFrame([("RS_1",), ("RC_1",)], "n string").select(ndjson.file_kind(F.col("n"))).collect()] == ["SUBMISSION", "COMMENT"]
    with pytest.raises(Exception, match="neither"):
        spark.createDataFrame([("X",)], "n string").select(ndjson.file_kind(F.col("n"))).collect()


def test_long_windows(spark, tmp_path):
    import zstandard

    data = b"".join(b'{"subreddit":"a","id":"%d"}\n' % i for i in range(1000))
    params = zstandard.ZstdCompressionParameters.from_level(3, window_log=30, enable_ldm=True, write_content_size=False)
    (tmp_path / "RC_w.zst").write_bytes(zstandard.ZstdCompressor(compression_params=params).compress(data + b"tail"))
    rows = ndjson.read_long_window(spark, str(tmp_path))
    assert rows.count() == 1001 and rows.agg(F.max("seq")).first()[0] == 1000


def test_tolerant_and_strict_readers(spark, tmp_path):
    write(tmp_path / "c.jsonl", [{"submission_id": "a", "comments": [{"body": "x", "author_type": "c"}]}, {"model": "m"}, '{"submission_id": "b", "comm'], end="")
    assert [r["submission_id"] for r in ndjson.read_tolerant_checkpoint(spark, str(tmp_path / "c.jsonl"), schemas.GENERATED).collect()] == ["a"]
    with pytest.raises(Exception):
        ndjson.read_jsonl(spark, str(tmp_path / "c.jsonl"), schemas.GENERATED).collect()
    assert ndjson.read_if_present(spark, str(tmp_path / "none"), schemas.POST).count() == 0
    with pytest.raises(FileNotFoundError):
        ndjson.read_if_present(spark, str(tmp_path / "none"), schemas.POST, required=True)


def posts_frame(spark, rows):
    defaults = {"title": "t", "selftext": "x" * 40, "author": None, "preview": None, "score": 1, "created_utc": 5.0}
    full = [tuple((defaults | r).get(f) for f in schemas.POST.names) + ("f", 0, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.POST) + ", file_name string, file_block long, seq long")


def replies_frame(spark, rows):
    defaults = {"body": "b", "author": None, "link_id": "t3_p", "parent_id": "t3_p"}
    full = [tuple((defaults | r).get(f) for f in schemas.REPLY.names) + ("f", 0, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.REPLY) + ", file_name string, file_block long, seq long")


def test_text_gate(spark):
    texts = ["a" * 29, "a" * 30, "\xa0" * 5 + "a" * 29 + "\xa0", "　" * 40, None, "", " " + "a" * 31]
    rows = posts_frame(spark, [{"id": str(i), "selftext": x} for i, x in enumerate(texts)] + [{"id": ""}, {"id": None}])
    assert [r["id"] for r in corpus.candidates(rows).orderBy("seq").collect()] == ["1", "6"]


def test_reply_filters_and_counts(spark):
    posts = posts_frame(spark, [{"id": "p"}, {"id": "q"}])
    rows = [
        {"id": "1"}, {"id": "2", "author": "AutoModerator"}, {"id": "3", "author": "automoderator", "author_flair_text": "LAYPERSON/not verified"}, *({"id": f"m{i}", "_meta": (x,)} for i, x in enumerate(["deleted", "removed", "removed by reddit"])),
        {"id": "4", "_meta": ("other",)}, {"id": "5", "_meta": (None,), "author_flair_text": ""}, {"id": "6", "parent_id": "t1_z"}, {"id": "7", "link_id": "t3_zz", "parent_id": "t3_zz"}, {"id": "8", "link_id": "p", "parent_id": "p"}, {"id": "9", "link_id": None}, {"id": "1"},
        {"id": "10", "author_flair_text": "a layperson here"}, {"id": "11", "author_flair_text": "Physician"},
    ]
    kept = corpus.retained_replies(replies_frame(spark, rows), posts)
    assert sorted(r["id"] for r in kept.collect()) == ["1", "1", "10", "11", "3", "4", "5"]
    m = corpus.thread_metadata(kept).collect()
    assert [(r["submission_id"], r["total_comments"], r["layperson_comments"], r["clinician_comments"], round(r["layperson_fraction"], 6)) for r in m] == [("p", 7, 2, 5, round(2 / 7, 6))]
    built = study.build_corpus(posts, replies_frame(spark, rows))
    assert [(r["id"], r["total_top_level_comments"]) for r in built.posts.collect()] == [("p", 7)]


def test_last_record_wins_at_the_first_place(spark):
    rows = posts_frame(spark, [{"id": "a", "title": "1"}, {"id": "b", "title": "2"}, {"id": "a", "title": "3"}])
    got = corpus.last_wins(rows).orderBy("first_seq").collect()
    assert [(r["id"], r["title"]) for r in got] == [("a", "3"), ("b", "2")]


def test_written_corpus_reads_back(spark, tmp_path):
    posts, replies = posts_frame(spark, [{"id": "p", "score": None}]), replies_frame(spark, [{"id": "1"}])
    built = study.build_corpus(posts, replies)
    study.write_corpus(built, str(tmp_path))
    line = next(x for f in (tmp_path / "submissions_corpus.jsonl").glob("part*") for x in f.read_text().splitlines())
    assert json.loads(line)["score"] is None and "score" in json.loads(line)
    back = study.read_corpus(spark, str(tmp_path))
    assert back[0].count() == 1 and back[1].count() == 1
    csv = "".join(f.read_bytes().decode() for f in sorted((tmp_path / "submission_metadata.csv").glob("part*")))
    assert csv == "submission_id,total_comments,layperson_comments,layperson_fraction\r\np,1,0,0.0\r\n"


@pytest.mark.parametrize("own,reply,stays", [("x", "x", False), (None, None, True), ("", "", True), ("X", "x", True), ("x", None, True)])
def test_self_replies(spark, own, reply, stays):
    rows = threads.top_level(replies_frame(spark, [{"id": "1", "author": reply}, {"id": "2", "parent_id": "t1_p"}]))
    assert threads.without_self_replies(rows, posts_frame(spark, [{"id": "p", "author": own}])).count() == int(stays)


def test_orphans_stay(spark):
    rows = threads.top_level(replies_frame(spark, [{"id": "1", "author": "x", "parent_id": "t3_zz"}]))
    assert threads.without_self_replies(rows, posts_frame(spark, [{"id": "p", "author": "x"}])).count() == 1


@pytest.mark.parametrize("preview,text,image", [('{"images":[1]}', "", True), ("{}", "", False), (None, None, False), ("[]", "a", False), (None, "see x.JPG", True), (None, "on imgur.com/a", True), (None, "jpg", False)])
def test_images(spark, preview, text, image):
    rows = spark.createDataFrame([(preview, text)], "preview string, selftext string")
    assert rows.select(threads.has_image().alias("x")).first()["x"] is image


def test_eligibility_by_round(spark):
    posts = posts_frame(spark, [{"id": "p", "title": "my health", "author": "a"}, {"id": "q", "title": "well", "selftext": "x.png"}, {"id": "r", "title": "none"}, {"id": "s", "selftext": "an illness"}])
    replies = replies_frame(spark, [{"parent_id": "t3_p", "author": "a"}, {"parent_id": "t3_p", "body": "[removed]"}, {"parent_id": "t3_q"}, {"parent_id": "t3_r", "body": None}, {"parent_id": "t3_s", "body": "[deleted]"}, {"parent_id": "t3_s", "author_flair_text": "Layperson"}])
    got = {name: {r["id"]: (r["n_comments"], r["n_layperson"], r["n_clinician"]) for r in threads.eligible(posts, replies, rules).collect()} for name, rules in threads.ROUNDS.items()}
    assert set(got["1"]) == {"p", "q", "r", "s"} and set(got["1a"]) == {"p"} and set(got["2"]) == {"p"}
    assert got["3"] == {"p": (2, 0, 2), "q": (1, 0, 1), "s": (2, 1, 1)}
    assert set(got["4"]) == set(got["5"]) == {"r", "s"} and got["5"]["s"] == (2, 1, 1)


def test_samples(spark):
    rows = spark.range(500).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("id"))
    small, large = ([r["id"] for r in sampling.hash_sample(rows, n).collect()] for n in (50, 80))
    assert set(small) < set(large) and small == sorted(small) and len(small) == 50
    assert small == [r["id"] for r in sampling.hash_sample(rows.repartition(7), 50).collect()] and sampling.hash_sample(rows, 0).count() == 500
    import random

    want = sorted(random.Random(42).sample(range(500), 20))
    assert [int(r["id"]) for r in sampling.random_module_sample(rows.repartition(6), 20).collect()] == want
    assert sampling.random_module_sample(rows, 500).count() == 500


def test_role_sequence(spark):
    r = spark.createDataFrame([(3, 2), (0, 0)], "c int, l int").select(sampling.role_sequence("c", "l").alias("r")).collect()
    assert sorted(r[0]["r"]) == ["clinician"] * 3 + ["layperson"] * 2 and r[1]["r"] == []


def test_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in/a.gz", "wt") as f:
        f.write('{"k":"A"}\n{"k":"b"}\n{bad\n')
    run = lambda: write_stream(matched_stream(spark, str(tmp_path / "in"), match.Match("k", ("a",))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    (tmp_path / "in/b.txt").write_text('{"k":"a"}\n')
    run()
    assert sorted(r["observed"] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["A", "a"]


def test_generated_files_and_manifest(spark, tmp_path):
    record = {"submission_id": "a", "comments": [{"body": "x", "author_type": "c"}]}
    write(tmp_path / "g/my_model_dg.jsonl", [record | {"n_comments": 1}, record | {"n_comments": 2}, '{"subm'])
    write(tmp_path / "g/grok_sag.jsonl", [record | {"model": "grok", "strategy": "sag"}])
    got = {(r["submission_id"], r["model"], r["strategy"]): r["n_comments"] for r in ndjson.read_generated_files(spark, str(tmp_path / "g"), schemas.GENERATED).collect()}
    assert got == {("a", "my_model", "dg"): 2, ("a", "grok", "sag"): None}
    (tmp_path / "status.json").write_text(json.dumps({"args": "f:v", "type": "x", "completed_prefixes": [], "files": [["in", "out", True, 10, 1, 3], ["i2", "o2", False, 0, 0, 0]]}, indent=1))
    assert [tuple(r) for r in ndjson.read_manifest(spark, str(tmp_path / "status.json")).collect()] == [("in", "out", True, 10, 1, 3), ("i2", "o2", False, 0, 0, 0)]


def test_files_by_size_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    """No task holds all lines: each file is a folder of parts, and sizes are those of the folders."""
    from threadmill import record_queries

    texts = {i: None if i % 9 == 0 else "" if i % 7 == 0 else "é" * (i * 37 % 101) for i in range(1, 81)}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(record_queries, "fresh_folder", lambda spark: str(tmp_path / "out"))
    got = sorted(map(tuple, record_queries.files_by_size(spark, str(tmp_path)).select("turn", "name", "bytes").collect()))
    sizes = {f"k{k}": sum(len(base64.b64encode(t.encode())) + 1 for i, t in texts.items() if t is not None and i % 5 == k) for k in range(5)}
    assert got == [(turn, name, sizes[name]) for turn, name in enumerate(sorted(sizes, key=lambda n: (-sizes[n], n)), 1)]
    assert min(len(list((tmp_path / "out" / f"k={name}").glob("part-*"))) for name in sizes) > 1


def test_generated_files_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    from threadmill import record_queries

    rows = [(c, t, "assistant" if t else "user", f"text {c} {t}") for c in range(60) for t in range(5)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(record_queries, "fresh_folder", lambda spark: str(tmp_path / "out"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, record_queries.generated_files(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    model, strategy = ("gemini", "openai", "grok"), ("dg", "sag", "sagii")
    assert got == sorted((str(c), model[c % 3], strategy[i], n) for c in range(60) for i, n in ((0, 1), (1, 2), (2, 1)))
    assert min(len(list(d.glob("part-*"))) for d in (tmp_path / "out").iterdir()) > 1 and len(list((tmp_path / "out").iterdir())) == 9


def test_folders_largest_first(spark, tmp_path):
    """Equal folders go by name whatever their files are called; hidden files do not count."""
    for name, length in (("b/z", 2), ("b/a", 1), ("a/y", 3), ("c/x", 4), ("c/_SUCCESS", 9), ("d/.x.crc", 9)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * length)
    rows = lambda **how: [(r["path"].removeprefix(f"file:{tmp_path}/"), r["bytes"], r["turn"]) for r in ndjson.largest_first(spark, str(tmp_path), **how).orderBy("turn").collect()]
    assert rows(folders=True) == [("c", 4, 1), ("a", 3, 2), ("b", 3, 3)]
    assert rows() == [("c/x", 4, 1), ("a/y", 3, 2), ("b/z", 2, 3), ("b/a", 1, 4)]


def test_counts_in_flight(spark):
    from pyspark.sql import Observation

    seen = Observation()
    lines = spark.createDataFrame([('{"k":"a"}',), ("{",), ('{"k":"b"}',)], "value string")
    match.counted(match.classify(lines, match.Match("k", ("a",))), seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"lines": 3, "errors": 1, "matches": 1}
