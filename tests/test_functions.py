"""Text functions, similarities, blocking and decisions on small tables of cases."""

import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from kinlink.functions import similarity as S
from kinlink.functions import text as T
from kinlink.operators import blocking, evaluate, matching, sampling, validate
from kinlink.operators.records import prepare

TARGETS = [
    ("S2-101", "Pacific Best Garden, Inc", "363 Blue Spruce Road, Clinton, AR", "US"),
    ("S3-201", "Inc Pacific Best Garden", "0363 Blue Spruce Rd, Clinton, Arkansas", "US"),
    ("S2-102", "Green Logistics Private Limited", "7 Kashinath Mullick Lane, Calcutta, WB", "India"),
    ("S3-202", "Green Logistics Center", "#7 Kashinath Mullick Lane, Calcutta", "India"),
    ("S2-103", "Boulangerie Patisserie SAS", "15 Rue de Paris, Lyon", "France"),
    ("S3-203", "Boulangerie Lyon", "15 Rue de Paris", "France"),
    ("S2-104", "Nordic Solutions GmbH", "42 Fjord Way, Oslo", "Norway"),
    ("S2-105", "Mystery Traders", "Unknown Road", ""),
]
COLS = "entity_id string, business_name string, business_address string, country string"


def apply(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string").select(f(F.col("c")).alias("x"), "i").orderBy("i").select("x").collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (T.clean_text, {None: "", "": "", "foo   bar\t\nbaz": "foo bar baz", "foo​­bar": "foobar", "é": "é", "a 　b": "a b"}),
        (T.clean_business_name, {"ACME CORP": "acme corp", "Smith & Jones": "smith and jones", "Acme Corp.": "acme corp", "Acme...Corp": "acme.corp", "R&D": "r&d"}),
        (T.strip_legal_suffixes, {"acme inc": "acme", "acme corporation": "acme", "acme and sons": "acme", "infosys pvt ltd": "infosys", "wipro private limited": "wipro", "singh bros": "singh", "volkswagen gmbh": "volkswagen", "the quick brown fox": "the quick brown fox", "acme & sons": "acme & sons", "limited edition store": "limited edition store", "ltd": "ltd", "ACME INC": "ACME INC", "acme,": "acme,", "\u00a0acme inc. \t": "acme", "acme, inc,": "acme, inc,"}),
        (T.strip_all_suffixes, {"Acme Services Pvt. Ltd.": "acme", "X Group, Inc.": "x", "x" + " inc" * 8: "x", "a, ltd. co llc": "a", "inc": "inc"}),
        (T.clean_address, {"100 Main St": "100 main street", "200 Park Ave": "200 park avenue", "No. 5, Rd": "number 5, road"}),
        (T.normalize_country, {"USA": "united states", "u.s.": "united states", "Bharat": "india", "FR": "france", "UK": "united kingdom", "Brazil": "brazil", None: ""}),
        (T.extract_tokens, {"acme,corp.inc": ["acme", "corp", "inc"], "b a b": ["a", "b"], "": []}),
        (T.extract_numeric_tokens, {"PIN 007001": ["007001"], "9 10 9": ["10", "9"], "none": [], "1\u200b2 3": ["12", "3"]}),
        (T.extract_normalized_numbers, {"007 7 0": ["0", "7"]}),
        (T.extract_core_name_tokens, {"www.qualitychs.com": ["qualitychs"], "Quality Chs": ["chs", "quality"]}),
    ],
)
def test_text(spark, f, cases):
    assert apply(spark, f, list(cases)) == list(cases.values())


def test_similarity(spark):
    pairs = [("kitten", "sitting"), ("", ""), ("", "a"), ("abc", "abc"), ("testing", "tester"), ("société", "societe"), ("corporation", "corporate")]
    d = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.levenshtein_similarity(F.col("a"), F.col("b")).alias("lev"), S.lcs_similarity(F.col("a"), F.col("b")).alias("lcs"), S.char_ngram_jaccard(F.col("a"), F.col("b")).alias("ng"), S.indel_similarity(F.col("a"), F.col("b")).alias("indel"))
    got = {(r.a, r.b): r for r in d.collect()}
    assert got["kitten", "sitting"].lev == pytest.approx(1 - 3 / 7)
    assert got["", ""].lev == 1 and got["", "a"].lev == 0 and got["société", "societe"].lev == pytest.approx(1 - 2 / 7)
    assert got["testing", "tester"].lcs > 0.5 and got["corporation", "corporate"].ng > 0.5
    assert got["kitten", "sitting"].indel == pytest.approx(2 * 4 / 13) and got["", ""].indel == 1
    r = spark.createDataFrame([(["b", "a"], ["a", "c"]), ([], ["a"])], "x array<string>, y array<string>").select(S.token_sort_similarity(F.col("x"), F.col("y")), S.jaccard_similarity(F.col("x"), F.col("y")), S.dice_similarity(F.col("x"), F.col("y"))).collect()
    assert tuple(r[0]) == pytest.approx((SequenceMatcher(None, "a b", "a c").ratio(), 1 / 3, 0.5)) and tuple(r[1]) == (0, 0, 0)


def test_indel_of_long_texts(spark):
    """As the plain table, also for many long texts: a row of the table must not be copied for each cell."""
    r = random.Random(3)
    made = lambda n: "".join(r.choice("abcdeé \U0001f600") for _ in range(n))
    pairs = [(made(300), made(300)) for _ in range(4000)] + [(made(n), made(m)) for n in range(5) for m in range(5)]

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(below(x, b, row))
        return row[-1]

    def below(x, b, above):
        left = 0
        yield 0
        for j, y in enumerate(b):
            left = above[j] + 1 if x == y else max(above[j + 1], left)
            yield left

    began = time.time()
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", S.indel_similarity(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()
    assert time.time() - began < 30
    for (a, b), x in list(zip(pairs, got, strict=True))[-30:]:
        assert x.x == pytest.approx(1.0 if a == b else 2 * plain(a, b) / (len(a) + len(b)))


def test_blocking(spark):
    asked = [("Pacific Best Garden LLC", "Different Street", "US"), ("Completely Different Name", "7 Kashinath Mullick Lane, Calcutta", "India"), ("Pacific Nursery", "363 Spruce Rd", "US"), ("Pacific Best Garden Inc", "7 Kashinath Mullick Lane", ""), ("Pacific Best Garden", "363 Blue Spruce Road", "India"), ("Mystery Traders", "Unknown Road", "US"), ("Boulangerie Patisserie", "15 Rue de Paris, Lyon", "France"), ("Nordic Solutions", "42 Fjord Way", "Norway"), ("Xylophone Quantum Quasar 9999", "Outer Space Station Alpha", "US")]
    s = spark.createDataFrame([(f"S1-{i}", *r) for i, r in enumerate(asked)], COLS).withColumn("pos", F.monotonically_increasing_id())
    t = spark.createDataFrame(TARGETS, COLS).withColumn("pos", F.monotonically_increasing_id())
    got = {r[0]: set(r[1].split(",")) - {""} for r in blocking.candidate_lists(blocking.candidates(prepare(s), prepare(t)), s).collect()}
    assert {"S2-101", "S3-201"} <= got["S1-0"] and "S2-102" in got["S1-1"] and "S2-101" in got["S1-2"] and {"S2-101", "S2-102"} <= got["S1-3"]
    assert "S2-101" not in got["S1-4"] and "S2-105" in got["S1-5"] and {"S2-103", "S3-203"} <= got["S1-6"] and "S2-104" in got["S1-7"] and got["S1-8"] == set()


def test_rare_tokens(spark):
    t = spark.createDataFrame([(f"S2-{i}", f"Universal Words {i}", "", "") for i in range(50)] + [("S2-99", "Zanzibar Special Craft", "", "")], COLS).withColumn("pos", F.monotonically_increasing_id())
    keys = {r.key for r in blocking.index_targets(prepare(t), 10).filter("index = 'rare'").collect()}
    assert "zanzibar" in keys and "words" not in keys


def test_features_and_decisions(spark):
    s = spark.createDataFrame([("S1-1", "Apex Technology Solutions Inc.", "1 A St", "US"), ("S1-2", "", "", ""), ("S1-3", "Lone", "9 Oak St", "US")], COLS)
    t = spark.createDataFrame([("S2-1", "Apex Technology Solutions", "1 A St", "US"), ("S3-1", "Sharma Electronics Private Limited", "7 B Rd", "India")], COLS)
    f = {(r[0], r[1]): r for r in matching.features(spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-2", "S2-1")], "source1_entity_id string, candidate_entity_id string"), prepare(s), prepare(t)).collect()}
    a, b, c = f["S1-1", "S2-1"], f["S1-1", "S3-1"], f["S1-2", "S2-1"]
    assert a.name_core_match == a.addr_exact_match == a.country_exact_match == 1 and a.num_jaccard >= 0.9
    assert b.name_token_jaccard == 0 and b.country_mismatch == 1 and b.num_disagreement == 1
    assert c.name_missing_1 == c.addr_missing_1 == c.country_missing == 1 and c.name_missing_2 == 0
    scored = spark.createDataFrame([("S1-1", "S2-1", 0.9), ("S1-1", "S3-1", 0.95), ("S1-1", "S3-1", 0.5), ("S1-2", "S2-1", 0.79)], "source1_entity_id string, candidate_entity_id string, score double")
    assert dict(map(tuple, matching.matches(scored, s, 0.8).collect())) == {"S1-1": "S3-1,S2-1", "S1-2": "", "S1-3": ""}


def test_model(spark, tmp_path):
    rows = [(1, *[1.0] * 25)] * 30 + [(0, *[0.0] * 25)] * 60
    d = spark.createDataFrame(rows, "label int, " + ", ".join(f"{c} double" for c in matching.FEATURES))
    m = matching.MatchingClassifier().fit(d)
    got = {r.label: r.score for r in m.predict_proba(d).select("label", "score").distinct().collect()}
    assert got[1] > 0.7 and got[0] < 0.3
    m.save(str(tmp_path / "m.json"))
    assert matching.MatchingClassifier.load(str(tmp_path / "m.json")) == m
    with pytest.raises(ValueError):
        matching.MatchingClassifier().predict_proba(d)


def test_metrics(spark):
    pair = "source1_entity_id string, candidate_entity_id string"
    p = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), ("c", "9")], pair)
    t = spark.createDataFrame([("a", "1"), ("a", "2")], pair)
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "source1_entity_id string")
    e = {r[0]: r for r in evaluate.entity_scores(p, t, ids).collect()}
    assert e["a"].f05 == pytest.approx(0.7142857) and e["b"].f05 == 1 and e["c"].f05 == 0
    assert evaluate.evaluate(p, t, ids).first().singleton_accuracy == 0.5
    scored = p.withColumn("score", F.when(F.col("candidate_entity_id") < "3", 0.9).otherwise(0.6))
    grid = evaluate.threshold_grid(scored, t, ids, 0.5, 0.9, 0.05).collect()
    best = next(r for r in grid if r.best)
    assert best.macro_f05 == 1 and best.tau == 0.65
    found = {r.finding: r.n for r in validate.validate_lists(spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-2", "S1-2"), ("S1-9", "")], "source1_entity_id string, ids string"), spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "source1_entity_id string"), spark.createDataFrame([("S2-1",)], "entity_id string")).collect()}
    assert found == {"duplicate_row": 0, "repeated_id": 1, "self_match": 1, "wrong_prefix": 0, "missing_row": 1, "extra_row": 1, "unknown_id": 0}


def test_fast_candidates_ignore_normal_countries(spark):
    s = prepare(spark.createDataFrame([("S1-1", "Pacific Best Garden", "363 Blue Spruce Road", "India")], COLS))
    t = prepare(spark.createDataFrame(TARGETS, COLS))
    pairs = lambda d: {r.candidate_entity_id for r in d.collect()}
    assert "S2-101" in pairs(blocking.fast_candidates(s, t)) and "S2-101" not in pairs(blocking.candidates(s, t))
    assert pairs(blocking.fast_candidates(s, t, partition="raw_country")) <= {"S2-102", "S3-202"}
    weights = {r.candidate_entity_id: r.weight for r in blocking.fast_candidates(s, t).collect()}
    assert weights["S2-101"] >= 190  # exact and sorted keys are the same


def test_indexes_are_built_once_and_probed(spark):
    t = prepare(spark.createDataFrame(TARGETS, COLS))
    s = prepare(spark.createDataFrame([("S1-1", "Pacific Best Garden LLC", "Different Street", "US"), ("S1-2", "Completely Different Name", "7 Kashinath Mullick Lane, Calcutta", "India")], COLS))
    names = {tuple(r) for r in blocking.generate_name_candidates(s, blocking.build_name_index(t)).collect()}
    addresses = {tuple(r) for r in blocking.generate_address_candidates(s, blocking.build_address_index(t)).collect()}
    assert {("S1-1", "S2-101"), ("S1-1", "S3-201")} <= names and ("S1-2", "S2-102") in addresses


def test_simple_features(spark):
    s = spark.createDataFrame([("S1-1", "Big Co", "1 A St", "us"), ("S1-2", "", "", "UNKNOWN")], COLS)
    t = spark.createDataFrame([("S2-1", "Big co", "1 A St", "US")], COLS)
    pair = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-1"), ("S1-3", "S2-1")], "source1_entity_id string, candidate_entity_id string")
    f = {r[0]: r for r in matching.heuristic_score(matching.simple_features(pair, s, t)).collect()}
    assert set(f) == {"S1-1", "S1-2"}
    a, b = f["S1-1"], f["S1-2"]
    assert a.name_jaccard == pytest.approx(1 / 3) and a.name_exact_match == 0 and a.address_jaccard == 1 and a.country_match == 1 and b.country_match == 0.5
    assert a.name_ratio == pytest.approx(5 / 6) and a.score == pytest.approx(0.6 * a.name_token_sort_ratio + 0.3 + 0.1)


def test_scores_match_with_and_without_the_bound(spark):
    s, t = prepare(spark.createDataFrame([("S1-1", "Pacific Best Garden", "363 Blue Spruce Road", "US"), ("S1-2", "Nordic", "Oslo", "")], COLS)), prepare(spark.createDataFrame(TARGETS, COLS))
    pairs = s.select(F.col("entity_id").alias("source1_entity_id")).join(t.select(F.col("entity_id").alias("candidate_entity_id")), F.lit(True))
    m = matching.MatchingClassifier([0.5] * 25, -4.0, [0.1] * 25, [1.0] * 25, True)
    every = {(r[0], r[1]): r.score for r in m.predict_proba(matching.features(pairs, s, t)).collect()}
    for tau in (0.05, 0.3, 0.6):
        got = {(r[0], r[1]): r.score for r in m.score_matches(pairs, s, t, tau).collect()}
        assert {k: v for k, v in got.items() if v >= tau} == {k: pytest.approx(v) for k, v in every.items() if v >= tau}


def test_input_order_of_matches(spark):
    ids = spark.createDataFrame([("S1-1",), ("S1-2",)], "source1_entity_id string")
    scored = spark.createDataFrame([("S1-1", "S2-9", 0.6, 0), ("S1-1", "S2-1", 0.9, 1), ("S1-1", "S2-9", 0.7, 2), ("S1-1", "S2-5", 0.4, 3), ("S1-7", "S2-5", 0.9, 4)], "source1_entity_id string, candidate_entity_id string, score double, pos long")
    assert dict(map(tuple, matching.format_matching_results(ids, scored).collect())) == {"S1-1": "S2-9,S2-1", "S1-2": ""}


def test_select_threshold_and_breakdowns(spark):
    pair = "source1_entity_id string, candidate_entity_id string"
    ids = spark.createDataFrame([("a",), ("b",)], "source1_entity_id string")
    t = spark.createDataFrame([("a", "S2-1")], pair)
    scored = spark.createDataFrame([("a", "S2-1", 0.6), ("a", "S3-2", 0.3), ("b", "S2-3", 0.4)], pair + ", score double")
    assert evaluate.select_threshold(scored, t, ids, [0.2, 0.5, 0.8]) == (0.5, 1.0)
    tau, best = evaluate.select_threshold(scored, t, ids)
    assert tau == 0.45 and best == 1
    by = {r.source: r for r in evaluate.scores_by_source(scored, t, ids).collect()}
    assert (by["S2"].tp, by["S2"].fp, by["S3"].fp, by["S3"].fn) == (1, 1, 1, 0) and by["S3"].macro_f05 == 0.5 and by["S2"].singleton_accuracy == 0
    where = spark.createDataFrame([("a", "US"), ("b", "India")], "source1_entity_id string, country string")
    by = {r.country: r for r in evaluate.scores_by_country(scored, t, ids, where).collect()}
    assert by["India"].macro_f05 == 0 and by["US"].tp == 1 and by["US"].entities == 1


def test_merged_profiles(spark):
    d = spark.createDataFrame([("S1-1", "A", "x y", "India"), ("S2-1", "", "z", "India"), ("S2-2", "Bcd", "", "US")], COLS)
    one = evaluate.profile_source(d)
    both = evaluate.merge_profiles(one.unionByName(one)).first()
    assert both.rows == 6 and both.missing_business_name == 2 and both.prefix_S2 == 4 and both.max_business_name == 3 and both.mean_business_name == one.first().mean_business_name


def test_samples_by_hash(spark):
    d = spark.range(5000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("c"))
    order = [r.c for r in d.orderBy(sampling.rank_key("c", 3)).collect()]
    for n in (0, 1, 2, 17, 1000, 4999, 5000, 6000):
        assert sorted(r.c for r in sampling.first_by_hash(d, "c", n, 3).collect()) == sorted(order[:n])


def test_synthetic_pairs(spark):
    s = spark.createDataFrame([(f"S1-{i}",) for i in range(20)], "entity_id string")
    t = spark.createDataFrame([(f"S{2 + i % 2}-{i}",) for i in range(60)], "entity_id string")
    truth = spark.createDataFrame([("S1-0", "S2-0"), ("S1-0", "S3-1"), ("S1-99", "S2-2")], "source1_entity_id string, candidate_entity_id string")
    got = sampling.synthetic_pairs(s, t, truth).collect()
    assert {(r[0], r[1]) for r in got if r.label} == {("S1-0", "S2-0"), ("S1-0", "S3-1")}
    per = {}
    for r in got:
        if not r.label:
            per.setdefault(r[0], set()).add(r[1])
    assert len(per["S1-0"]) == 8 and all(len(per[f"S1-{i}"]) == 2 for i in range(1, 20)) and not per["S1-0"] & {"S2-0", "S3-1"}
    assert all(r.source == r.candidate_entity_id[:2] for r in got)
