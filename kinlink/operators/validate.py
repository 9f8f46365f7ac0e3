"""Checks of result files and tables: findings as rows of a table.

A finding has a kind, a level (error or warning), the number of offenders and the first five of them. Offenders are counted
and their first five are kept in each task, so no list of all of them is ever made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import exists, first_line, read_ids, with_pos

EXAMPLES = 5
MATCHING_HEADER = ["source1_entity_id", "matched_entity_ids"]
CANDIDATE_HEADER = ["source1_entity_id", "candidate_entity_ids"]


def _found(offenders: DataFrame, kind: str, level: str = "error") -> DataFrame:
    """offenders: one column of different ids."""
    c = offenders.columns[0]
    top = offenders.orderBy(c).limit(EXAMPLES).agg(F.array_join(F.array_sort(F.collect_list(c)), ",").alias("examples"), F.lit(1).alias("one"))
    n = offenders.agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    return n.join(top, "one").select(F.lit(kind).alias("finding"), F.lit(level).alias("level"), "n", "examples")


def _all(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def _said(spark: SparkSession, kind: str, text: str, level: str = "error") -> DataFrame:
    return spark.createDataFrame([(kind, level, 1, text)], "finding string, level string, n long, examples string")


def list_offenders(rows: DataFrame, required: DataFrame, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """Offenders of a result table (source1_entity_id, ids) by kind. required: source1_entity_id; known: entity_id."""
    d = rows.select("source1_entity_id", F.when(F.btrim("ids") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("ids", ",")).alias("l"))
    each = d.select("source1_entity_id", F.explode("l").alias("x"))
    own, two_or_three = F.col("x").startswith("S1-"), F.col("x").startswith("S2-") | F.col("x").startswith("S3-")
    found = {
        "duplicate_row": d.groupBy("source1_entity_id").count().filter("count > 1").select("source1_entity_id"),
        "repeated_id": d.filter(F.size("l") != F.size(F.array_distinct("l"))).select("source1_entity_id").distinct(),
        "self_match": each.filter(own).select("x").distinct(),
        "wrong_prefix": each.filter(~own & ~two_or_three).select("x").distinct(),
        "missing_row": required.select("source1_entity_id").distinct().join(d, "source1_entity_id", "left_anti"),
        "extra_row": d.join(required, "source1_entity_id", "left_anti").select("source1_entity_id").distinct(),
    }
    if known is not None:
        found["unknown_id"] = each.filter(two_or_three).select("x").distinct().join(known.select(F.col("entity_id").alias("x")), "x", "left_anti")
    return found


def validate_lists(rows: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Findings of a result table, also those without offenders."""
    return _all([_found(v, k) for k, v in list_offenders(rows, required, known).items()])


def outside(matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """source1_entity_id of records with a match that is no candidate of theirs. Both: source1_entity_id, candidate_entity_id."""
    pair = ["source1_entity_id", "candidate_entity_id"]
    return matched.select(*pair).join(candidates.select(*pair), pair, "left_anti").select("source1_entity_id").distinct()


def _parsed(lines: DataFrame) -> DataFrame:
    """value, whether it has a tab, and what is before and behind the first."""
    return lines.select("value", F.contains("value", F.lit("\t")).alias("ok"), F.substring_index("value", "\t", 1).alias("source1_entity_id"), F.regexp_replace("value", r"^[^\t]*+\t?", "").alias("ids"))


def validate_file(spark: SparkSession, path: str, header: list[str], required: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Findings of one file of lists and its pairs (source1_entity_id, candidate_entity_id), which are None where it can't be read on."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if not exists(spark, path):
        return _said(spark, "no_file", path), None
    first = first_line(spark, path)
    if first is None:
        return _said(spark, "empty_file", name), None
    if "\t" not in first and "," in first:
        return _said(spark, "comma_separated", name), None
    if [c.strip().lower() for c in first.split("\t")] != header:
        return _said(spark, "unexpected_header", first), None
    rows = _parsed(with_pos(spark.read.option("lineSep", "\n").text(path), path).filter("pos <> 0"))
    malformed = rows.filter(~F.col("ok") & (F.btrim("value") != "")).select("value")
    good = rows.filter("ok")
    ids = F.when(F.btrim("ids") == "", F.expr("cast(array() as array<string>)")).otherwise(F.array_distinct(F.split("ids", ",")))
    pairs = good.select("source1_entity_id", F.explode(ids).alias("candidate_entity_id"))
    return _found(malformed, "malformed_row").unionByName(validate_lists(good, required, known)), pairs


def validate_submission(spark: SparkSession, matching: str, candidate: str | None, test_dir: str, check_ids: bool = False) -> DataFrame:
    """All findings of a submission with offenders: file, finding, level, n, examples. It passes if none is an error."""
    source1 = f"{test_dir}/test_source1.tsv"
    tag = lambda d, name: d.filter("n > 0").select(F.lit(name).alias("file"), *d.columns)
    if not exists(spark, source1):
        return tag(_said(spark, "no_file", source1), "test_source1.tsv")
    required = read_ids(spark, source1).withColumnRenamed("entity_id", "source1_entity_id")
    known, out = None, []
    if check_ids:
        paths = [f"{test_dir}/test_source{i}.tsv" for i in (2, 3)]
        if all(exists(spark, p) for p in paths):
            known = read_ids(spark, paths[0]).unionByName(read_ids(spark, paths[1]))
        else:
            out.append(tag(_said(spark, "ids_not_checked", test_dir, "warning"), "test_source2.tsv"))
    else:
        out.append(tag(_said(spark, "ids_not_checked", "", "warning"), "test_source2.tsv"))
    found, matched = validate_file(spark, matching, MATCHING_HEADER, required, known)
    out.append(tag(found, "matching"))
    proposed = None
    if candidate and exists(spark, candidate):
        found, proposed = validate_file(spark, candidate, CANDIDATE_HEADER, required, known)
        out.append(tag(found, "candidates"))
    elif candidate:
        out.append(tag(_said(spark, "no_file", candidate, "warning"), "candidates"))
    if matched is not None and proposed is not None:
        out.append(tag(_found(outside(matched, proposed), "matches_outside_candidates", "warning"), "matching"))
    return _all(out)


def final_check(matches: DataFrame, candidates: DataFrame, required: DataFrame, targets: DataFrame) -> DataFrame:
    """check, n, ok: the integrity of both outputs. matches, candidates: source1_entity_id, ids; required: source1_entity_id; targets: entity_id."""
    trimmed = lambda d: d.select(F.btrim("source1_entity_id").alias("source1_entity_id"), F.explode(F.filter(F.transform(F.split("ids", ","), lambda x: F.btrim(x)), lambda x: x != "")).alias("candidate_entity_id"))
    pair = ["source1_entity_id", "candidate_entity_id"]
    ids = required.select(F.btrim("source1_entity_id").alias("source1_entity_id"))
    count = lambda d, name: d.agg(F.lit(name).alias("check"), F.count("*").alias("n"))
    out = []
    for name, d in (("candidates", candidates), ("matches", matches)):
        own = d.select(F.btrim("source1_entity_id").alias("source1_entity_id"))
        both = own.withColumn("d", F.lit(1)).unionByName(ids.withColumn("d", F.lit(-1))).agg(F.lit(f"{name}_row_count_off").alias("check"), F.abs(F.coalesce(F.sum("d"), F.lit(0))).alias("n"))
        out += [both, count(own.groupBy("source1_entity_id").count().filter("count > 1"), f"{name}_duplicate_rows")]
        out += [count(own.join(ids, "source1_entity_id", "left_anti"), f"{name}_extra_rows"), count(ids.join(own, "source1_entity_id", "left_anti"), f"{name}_missing_rows")]
    m = trimmed(matches)
    out += [count(m.join(trimmed(candidates).distinct(), pair, "left_anti"), "matches_outside_candidates"), count(m.join(targets.select(F.col("entity_id").alias("candidate_entity_id")), "candidate_entity_id", "left_anti"), "matches_unknown")]
    return _all(out).select("check", F.col("n").cast("long").alias("n"), (F.col("n") == 0).alias("ok"))


def recovery_check(rows: DataFrame, partition: DataFrame) -> DataFrame:
    """One row about a checkpoint (source1_entity_id, matched_entity_ids; raw rows) of a partition (source1_entity_id)."""
    d = rows.filter(F.btrim("source1_entity_id") != "source1_entity_id").select(F.btrim("source1_entity_id").alias("id"), F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.btrim(x)), lambda x: x != "").alias("l"))
    inside = partition.select(F.btrim("source1_entity_id").alias("id")).distinct().withColumn("inside", F.lit(1))
    wrong = F.size(F.filter("l", lambda x: ~x.startswith("S2-") & ~x.startswith("S3-")))
    per = d.filter("id <> ''").groupBy("id").agg(F.count("*").alias("rows"), F.sum(wrong).alias("wrong")).join(inside, "id", "full")
    here = F.col("rows").isNotNull()
    out = per.agg(F.lit(1).alias("one"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count_if(here).alias("records"), F.coalesce(F.sum(F.when(here, F.col("rows") - 1)), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("wrong_ids"), F.count_if(here & F.col("inside").isNull()).alias("outside_partition"), F.count_if(~here).alias("remaining"))
    return out.join(d.agg(F.lit(1).alias("one"), F.count_if(F.col("id") == "").alias("malformed_rows")), "one").drop("one")


def passes(findings: DataFrame) -> bool:
    return findings.filter("level = 'error' and n > 0").isEmpty()


def examples(ids: Column) -> Column:
    """The first five of an array of ids, and how many there are if more."""
    shown = F.array_join(F.slice(F.array_sort(ids), 1, EXAMPLES), ", ")
    return F.when(F.size(ids) > EXAMPLES, F.concat(F.size(ids).cast("string"), F.lit(" total, e.g. "), shown, F.lit(", ..."))).otherwise(shown)
