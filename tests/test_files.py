"""Files: TSV sources and sinks, checkpoints, validators, the runner, the configured run, the stream."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from kinlink.operators import matching, validate
from kinlink.plans import pipeline
from kinlink.sources import tables
from kinlink.streaming.scoring import score_stream

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def text_of(path):
    return "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_tsv_round_trip(spark, tmp_path):
    at = put(tmp_path / "s.tsv", HEAD + "S1-1\tNA\t\tUS\nS1-2\tnull\tx\nS1-1\tLater\t\"a \"\"b\"\"\"\tFR\n")
    d = tables.read_records(spark, at)
    got = [tuple(r)[:4] for r in d.orderBy("pos").collect()]
    assert got == [("S1-1", "NA", "", "US"), ("S1-2", "null", "x", ""), ("S1-1", "Later", 'a "b"', "FR")]
    assert [r.business_name for r in tables.last_of_each(d).orderBy("entity_id").collect()] == ["Later", "null"]
    tables.write_tsv(d.repartition(3), out := str(tmp_path / "out"), "pos")
    lines = text_of(out).split("\n")
    assert lines[0] == HEAD.strip() and lines[1:4] == ["S1-1\tNA\t\tUS", "S1-2\tnull\tx\t", 'S1-1\tLater\t"a ""b"""\tFR']
    assert [tuple(r)[:4] for r in tables.read_records(spark, out).orderBy("pos").collect()] == got
    assert sorted(r[0] for r in tables.read_ids(spark, at).collect()) == ["S1-1", "S1-2"]
    assert tables.read_tsv(spark, at, ["country"]).columns == ["country"]


def test_truth_and_lists(spark, tmp_path):
    t = tables.read_truth(spark, put(tmp_path / "t.tsv", "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-151, S3-222 ,S2-151\nS1-2\tS2-101\nS1-3\t\n"))
    assert {r[0]: (r.match_list, r.match_count) for r in t.collect()} == {"S1-1": (["S2-151", "S3-222", "S2-151"], 3), "S1-2": (["S2-101"], 1), "S1-3": ([], 0)}
    assert {r[0]: r.matches for r in tables.truth_sets(t).collect()}["S1-1"] == ["S2-151", "S3-222"]
    c = put(tmp_path / "c.tsv", "source1_entity_id\tcandidate_entity_ids\nS1-1\tS3-1, S2-11\nS1-9\tS2-1\nS1-2\t\n")
    known = spark.createDataFrame([("S1-1",), ("S1-2",)], "source1_entity_id string")
    assert [tuple(r) for r in tables.read_candidates(spark, c, known).orderBy("pos").collect()] == [("S1-1", 0, "S3-1"), ("S1-1", 1, "S2-11")]
    with pytest.raises(FileNotFoundError):
        tables.resolve_input(spark, str(tmp_path), "none.tsv")
    assert tables.resolve_input(spark, "/none", "c.tsv", str(tmp_path)) == c
    with pytest.raises(FileNotFoundError):
        tables.load_config(str(tmp_path / "none.yaml"))


def test_checkpoints_merge(spark, tmp_path):
    a, b = put(tmp_path / "a.tsv", "source1_entity_id\tx\ty\nS1-1\told\told\nS1-1\tS2-1\t\n"), put(tmp_path / "b.tsv", "S1-2\tS2-2,S2-3\tS2-2\nS1-9\tq\tq\nS1-4\n")
    s = spark.createDataFrame([(f"S1-{i}", i) for i in (3, 2, 1)], "entity_id string, pos long")
    got = pipeline.merge_checkpoints(s, [tables.read_checkpoint(spark, a), tables.read_checkpoint(spark, b)]).orderBy("pos").collect()
    assert [(r[0], r.candidate_entity_ids, r.matched_entity_ids) for r in got] == [("S1-1", "S2-1", ""), ("S1-2", "S2-2,S2-3", "S2-2"), ("S1-3", "", "")]


def found(d):
    return {(r.file, r.finding): (r.level, r.n, r.examples) for r in d.collect()}


def test_submission(spark, tmp_path):
    for i, n in ((1, 3), (2, 4), (3, 4)):
        put(tmp_path / f"test_source{i}.tsv", HEAD + "".join(f"S{i}-{k}\ta\tb\tUS\n" for k in range(n)))
    at = lambda name, text: put(tmp_path / name, text)
    good = at("m.tsv", "source1_entity_id\tmatched_entity_ids\nS1-0\tS2-1,S3-1\nS1-1\t\nS1-2\tS2-2\n")
    cand = at("c.tsv", "source1_entity_id\tcandidate_entity_ids\nS1-0\tS2-1,S3-1\nS1-1\t\nS1-2\tS2-3\n")
    got = validate.validate_submission(spark, good, cand, str(tmp_path), True)
    assert found(got) == {("matching", "matches_outside_candidates"): ("warning", 1, "S1-2")} and validate.passes(got)
    bad = at("b.tsv", "Source1_Entity_ID \tmatched_entity_ids\nS1-0\tS2-1,S2-1\nS1-0\tS1-1,X,S2-9\nno tab here\n\nS1-8\tS2-1, S2-1\n")
    got = validate.validate_submission(spark, bad, None, str(tmp_path), True)
    f = found(got)
    assert {k: (f["matching", k][1], f["matching", k][2]) for k in ("malformed_row", "duplicate_row", "repeated_id", "self_match", "wrong_prefix", "unknown_id", "missing_row", "extra_row")} == {
        "malformed_row": (1, "no tab here"), "duplicate_row": (1, "S1-0"), "repeated_id": (1, "S1-0"), "self_match": (1, "S1-1"), "wrong_prefix": (2, " S2-1,X"), "unknown_id": (1, "S2-9"), "missing_row": (2, "S1-1,S1-2"), "extra_row": (1, "S1-8"),
    }
    assert not validate.passes(got)
    one = lambda name, text: [k[1] for k in found(validate.validate_submission(spark, at(name, text), "none", str(tmp_path)))]
    assert one("x.tsv", "source1_entity_id,matched_entity_ids\n") == ["ids_not_checked", "comma_separated", "no_file"]
    assert "unexpected_header" in one("y.tsv", "a\tb\n") and "empty_file" in one("z.tsv", "")
    assert found(validate.validate_submission(spark, good, None, str(tmp_path / "none"))) == {("test_source1.tsv", "no_file"): ("error", 1, f"{tmp_path}/none/test_source1.tsv")}


def test_final_and_recovery_checks(spark):
    rows = lambda d: spark.createDataFrame(d, "source1_entity_id string, ids string")
    required, targets = spark.createDataFrame([("a",), ("b",)], "source1_entity_id string"), spark.createDataFrame([("S2-1",), ("S2-111",)], "entity_id string")
    got = {r.check: r.n for r in validate.final_check(rows([("a", "S2-111,S2-7"), ("a", "")]), rows([("a", "S2-1, S2-111"), ("b", "")]), required, targets).collect()}
    assert {k: n for k, n in got.items() if n} == {"matches_duplicate_rows": 1, "matches_missing_rows": 1, "matches_outside_candidates": 1, "matches_unknown": 1}
    r = validate.recovery_check(spark.createDataFrame([("a", "S2-1"), ("a", "X-1,S3-1"), ("", ""), ("q", None), ("source1_entity_id", "x")], "source1_entity_id string, matched_entity_ids string"), required).first()
    assert (r["rows"], r.records, r.duplicate_rows, r.wrong_ids, r.outside_partition, r.remaining, r.malformed_rows) == (3, 2, 1, 1, 1, 1, 1)
    shown = spark.createDataFrame([(list("gfedcba"),), (["b", "a"],)], "x array<string>").select(validate.examples(F.col("x"))).collect()
    assert [x[0] for x in shown] == ["7 total, e.g. a, b, c, d, e, ...", "a, b"]


SOURCES = {
    1: [("S1-1", "Pacific Best Garden LLC", "363 Blue Spruce Road", "US"), ("S1-2", "Boulangerie Patisserie", "15 Rue de Paris, Lyon", "France"), ("S1-3", "Pacific Best Garden", "363 Blue Spruce Road", "Norway")],
    2: [("S2-101", "Pacific Best Garden, Inc", "363 Blue Spruce Road, Clinton", "US"), ("S2-103", "Boulangerie Patisserie SAS", "15 Rue de Paris, Lyon", "France"), ("S2-1", "Pacific Best Garden", "363 Blue Spruce Road", "Norway")],
    3: [("S3-201", "Unlike Anything", "9 Else", "US")],
}


@pytest.fixture
def sources(tmp_path):
    for i, rows in SOURCES.items():
        put(tmp_path / f"test_source{i}.tsv", HEAD + "".join("\t".join(r) + "\n" for r in rows))
    m = matching.MatchingClassifier([2.0 if n in ("name_token_jaccard", "addr_token_jaccard") else 0.0 for n in matching.FEATURES], -1.0, [0.0] * 25, [1.0] * 25, True)
    m.save(str(tmp_path / "model.json"))
    return tmp_path


def test_full_run_and_resume(spark, sources):
    at = str(sources)
    run = lambda **k: pipeline.run_pipeline(spark, at, f"{at}/m", f"{at}/c", f"{at}/ck", f"{at}/model.json", 0.6, **k).first()
    first = run(limit=1)
    assert (first.entities, first.matches) == (1, 1)
    got = run()
    assert (got.entities, got.matches, got.singletons) == (3, 2, 1)
    # Norway is none of the countries that are run, and records meet in their own country only.
    assert text_of(f"{at}/m") == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-101\nS1-2\tS2-103\nS1-3\t\n"
    assert spark.read.parquet(f"{at}/ck").count() == 2
    with pytest.raises(FileNotFoundError):
        pipeline.run_pipeline(spark, f"{at}/none", f"{at}/m", f"{at}/c", f"{at}/ck", f"{at}/model.json")


def test_configured_run_reuses_candidates(spark, sources):
    at = str(sources)
    paths = [f"{at}/test_source{i}.tsv" for i in (1, 2, 3)]
    truth = put(sources / "truth.tsv", "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-101\nS1-2\tS2-103\nS1-3\tS2-1\n")
    put(sources / "config.yaml", f"matching:\n  threshold: 0.6\n  model_path: {at}/model.json\nblocking:\n  max_candidates_per_entity: 5\n")
    run = pipeline.EntityResolution.load(f"{at}/config.yaml")
    out = run.run(spark, *paths, f"{at}/cand", f"{at}/match", truth)
    assert run.model is not None and out["evaluation"].first().macro_f05 == 1.0 and out["summary"].first().matches == 3
    # A candidate file that is there is used as it is; lists keep its order, unknown records are ignored.
    c = put(sources / "given.tsv", "source1_entity_id\tcandidate_entity_ids\nS1-1\tS3-201,S2-101\nS1-8\tS2-1\n")
    got = run.run(spark, *paths, c, f"{at}/match", threshold=0.0)
    assert got["candidates"] == 2 and text_of(f"{at}/match") == "source1_entity_id\tmatched_entity_ids\nS1-1\tS3-201,S2-101\nS1-2\t\nS1-3\t\n"


def test_prediction_from_a_candidate_file(spark, sources):
    at = str(sources)
    paths = [f"{at}/test_source{i}.tsv" for i in (1, 2, 3)]
    c = put(sources / "given.tsv", "source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-101,S3-201,S2-404\nS1-3\t\n")
    assert pipeline.run_prediction(spark, f"{at}/model.json", 0.6, *paths, f"{at}/p", c).first().matches == 1
    assert pipeline.run_prediction(spark, f"{at}/model.json", 0.6, *paths, f"{at}/p").first().singletons == 3


def test_stream_resumes(spark, sources, tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    schema = "entity_id string, business_name string, business_address string, country string"
    targets = spark.createDataFrame(SOURCES[2] + SOURCES[3], schema)
    m = matching.MatchingClassifier.load(f"{sources}/model.json")

    def batch(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(at / name))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(at))
        score_stream(stream, targets, m, str(tmp_path / "out"), str(tmp_path / "state"), 0.6).awaitTermination()
        return {r[0]: r[1] for r in spark.read.parquet(str(tmp_path / "out")).select("source1_entity_id", "matched_entity_ids").collect()}

    assert batch(SOURCES[1][:1], "a") == {"S1-1": "S2-101"}
    assert batch(SOURCES[1][1:], "b") == {"S1-1": "S2-101", "S1-2": "S2-103", "S1-3": "S2-1"}
    assert len(os.listdir(tmp_path / "out")) == 2
