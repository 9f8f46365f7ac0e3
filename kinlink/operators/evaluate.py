"""Profiles, evaluation and threshold search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import f_beta

PAIR = ["source1_entity_id", "candidate_entity_id"]


def profile_source(records: DataFrame) -> DataFrame:
    """One row: counts, missing values and lengths. Spark merges partial profiles itself."""
    out = [F.count("*").alias("rows")]
    for c in ("entity_id", "business_name", "business_address", "country"):
        blank = F.btrim(F.coalesce(c, F.lit(""))) == ""
        size = F.when(blank, 0).otherwise(F.length(c))
        out += [F.count_if(blank).alias(f"missing_{c}"), F.min(size).alias(f"min_{c}"), F.max(size).alias(f"max_{c}"), F.round(F.avg(size), 2).alias(f"mean_{c}")]
    out += [F.count_if(F.col("entity_id").startswith(p)).alias(f"prefix_{p[:2]}") for p in ("S1-", "S2-", "S3-")]
    return records.agg(*out)


def country_counts(records: DataFrame, limit: int | None = None) -> DataFrame:
    d = records.groupBy(F.btrim(F.coalesce("country", F.lit(""))).alias("country")).agg(F.count("*").alias("n"))
    return d.orderBy(F.desc("n"), "country").limit(limit) if limit else d


def profile_truth(truth: DataFrame) -> DataFrame:
    """truth: source1_entity_id, match_list."""
    n = F.size("match_list")
    starts = lambda p: F.size(F.filter("match_list", lambda x: x.startswith(p)))
    return truth.agg(F.count("*").alias("rows"), F.count_if(n == 0).alias("singletons"), F.count_if(n > 0).alias("has_matches"), F.sum(starts("S2-")).alias("s2_matches"), F.sum(starts("S3-")).alias("s3_matches"))


def match_count_distribution(truth: DataFrame) -> DataFrame:
    return truth.groupBy(F.size("match_list").alias("match_count")).agg(F.count("*").alias("n"))


def entity_scores(predicted: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """Precision, recall and F0.5 of every id; an id without true pairs is right if it has no predicted ones."""
    both = predicted.select(*PAIR).distinct().withColumn("p", F.lit(1)).join(truth.select(*PAIR).distinct().withColumn("t", F.lit(1)), PAIR, "full")
    per = both.groupBy("source1_entity_id").agg(F.count("p").alias("n_pred"), F.count("t").alias("n_true"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"))
    d = ids.join(per, "source1_entity_id", "left").fillna(0)
    return _rated(d)


def _rated(d: DataFrame) -> DataFrame:
    """d (n_pred, n_true, tp) with precision, recall and f05."""
    empty = (F.col("n_true") == 0) & (F.col("n_pred") == 0)
    p = F.when(empty, 1.0).otherwise(F.col("tp") / F.greatest("n_pred", F.lit(1)))
    r = F.when(empty, 1.0).otherwise(F.col("tp") / F.greatest("n_true", F.lit(1)))
    return d.withColumns({"precision": p, "recall": r}).withColumn("f05", f_beta(F.col("precision"), F.col("recall")))


def evaluate(predicted: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """One row of macro means; singleton accuracy is 1 if there is no singleton."""
    return _means(entity_scores(predicted, truth, ids), []).drop("entities", "tp", "fp", "fn")


def pair_metrics(predicted: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pair counts and micro metrics, in all or by columns that both sides have."""
    by = by or []
    both = predicted.select(*PAIR, *by).distinct().withColumn("p", F.lit(1)).join(truth.select(*PAIR, *by).distinct().withColumn("t", F.lit(1)), PAIR + by, "full")
    a = both.groupBy(*by).agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    a = a.withColumns({"precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))})
    return a.withColumn("f05", f_beta(F.col("precision"), F.col("recall")))


def candidate_recall(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true pairs, those among pairs, and their share (1 if there is no true pair)."""
    hit = truth.select(*PAIR).distinct().join(pairs.select(*PAIR).distinct().withColumn("c", F.lit(1)), PAIR, "left")
    a = hit.agg(F.count("*").alias("true_pairs"), F.count("c").alias("retrieved"))
    return a.withColumn("recall", F.when(F.col("true_pairs") == 0, 1.0).otherwise(F.col("retrieved") / F.greatest("true_pairs", F.lit(1))))


def _means(e: DataFrame, by: list[str]) -> DataFrame:
    """Macro means of entity_scores by columns; singleton accuracy is 1 if there is no singleton."""
    single = F.col("n_true") == 0
    return e.groupBy(*by).agg(
        F.count("*").alias("entities"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f05").alias("macro_f05"),
        F.coalesce(F.avg(F.when(single, F.when(F.col("n_pred") == 0, 1.0).otherwise(0.0))), F.lit(1.0)).alias("singleton_accuracy"), F.coalesce(F.avg(F.when(~single, F.col("f05"))), F.lit(0.0)).alias("non_singleton_f05"),
        F.sum("tp").alias("tp"), F.sum(F.col("n_pred") - F.col("tp")).alias("fp"), F.sum(F.col("n_true") - F.col("tp")).alias("fn"),
    )


def scores_by_country(predicted: DataFrame, truth: DataFrame, ids: DataFrame, countries: DataFrame) -> DataFrame:
    """Macro means and pair counts of the ids of each country. countries: source1_entity_id, country."""
    return _means(entity_scores(predicted, truth, ids).join(countries.select(PAIR[0], "country"), PAIR[0], "left"), ["country"])


def scores_by_source(predicted: DataFrame, truth: DataFrame, ids: DataFrame, sources: tuple[str, ...] = ("S2", "S3")) -> DataFrame:
    """Macro means and pair counts over all ids, with the pairs of one source of targets at a time: an id without true pairs there is a singleton there."""
    of = lambda d: d.select(PAIR[0], PAIR[1], F.substr(PAIR[1], F.lit(1), F.lit(2)).alias("source")).distinct()
    both = of(predicted).withColumn("p", F.lit(1)).join(of(truth).withColumn("t", F.lit(1)), [*PAIR, "source"], "full")
    per = both.groupBy(PAIR[0], "source").agg(F.count("p").alias("n_pred"), F.count("t").alias("n_true"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"))
    every = ids.select(PAIR[0], F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"))
    return _means(_rated(every.join(per, [PAIR[0], "source"], "left").fillna(0)), ["source"])


def threshold_grid(scored: DataFrame, truth: DataFrame, ids: DataFrame, low: float = 0.40, high: float = 0.95, step: float = 0.02, thresholds: list[float] | None = None) -> DataFrame:
    """macro_f05 of every threshold of the grid; best marks the lowest of the best.

    Each pair counts in the bands up to its score: counts per id and band, summed downwards over the grid,
    so a pair is not copied for every threshold; ids meet the short grid only as counts.
    """
    taus = thresholds or [round(low + i * step, 4) for i in range(int((high - low) / step + 1e-9) + 1)]
    grid = scored.sparkSession.createDataFrame([(i, t) for i, t in enumerate(taus)], "i int, tau double")
    top = F.aggregate(F.array(*[F.lit(t) for t in taus]), F.lit(-1), lambda n, t: F.when(F.col("score") >= t, n + 1).otherwise(n))
    s = scored.groupBy(*PAIR).agg(F.max("score").alias("score")).join(truth.select(*PAIR).distinct().withColumn("t", F.lit(1)), PAIR, "left").withColumn("band", top).filter("band >= 0")
    bands = s.groupBy("source1_entity_id").agg(*[f for i in range(len(taus)) for f in (F.count_if(F.col("band") >= i).alias(f"p{i}"), F.count_if((F.col("band") >= i) & F.col("t").isNotNull()).alias(f"t{i}"))])
    true = truth.select(*PAIR).distinct().groupBy("source1_entity_id").agg(F.count("*").alias("n_true"))
    d = ids.join(bands, "source1_entity_id", "left").join(true, "source1_entity_id", "left").fillna(0)

    def f05(i: int):
        n, k = F.col(f"p{i}"), F.col(f"t{i}")
        score = f_beta(k / F.greatest(n, F.lit(1)), k / F.greatest("n_true", F.lit(1)))
        return F.avg(F.when((n == 0) & (F.col("n_true") == 0), 1.0).otherwise(score)).alias(f"f{i}")

    row = d.agg(*[f05(i) for i in range(len(taus))]).select(F.posexplode(F.array(*[F.col(f"f{i}") for i in range(len(taus))])).alias("i", "macro_f05"))
    out = row.join(grid, "i")
    best = F.row_number().over(Window.orderBy(F.desc("macro_f05"), "tau")) == 1
    return out.select("tau", "macro_f05", best.alias("best"))


def select_threshold(scored: DataFrame, truth: DataFrame, ids: DataFrame, thresholds: list[float] | None = None) -> tuple[float, float]:
    """The first of the best of the thresholds, by default 0.05 to 0.95 in steps of 0.05, and its macro F0.5."""
    taus = thresholds or [round(0.05 * i, 2) for i in range(1, 20)]
    best = threshold_grid(scored, truth, ids, thresholds=taus).filter("best").first()
    return best["tau"], best["macro_f05"]


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """One row of profile_source, over the rows of the parts' profiles."""
    total = F.sum("rows")
    out = [total.alias("rows")]
    for c in profiles.columns[1:]:
        kind = c.split("_", 1)[0]
        made = F.round(F.sum(F.col(c) * F.col("rows")) / F.greatest(total, F.lit(1)), 2) if kind == "mean" else {"min": F.min, "max": F.max}.get(kind, F.sum)(c)
        out.append(made.alias(c))
    return profiles.agg(*out)


def not_in_candidates(matches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of matches that were no candidates."""
    return matches.select(*PAIR).join(pairs.select(*PAIR), PAIR, "left_anti")
