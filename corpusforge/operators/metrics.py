"""Evaluation of a scored table (label 0/1, probability p, optional weight and groups): counts, ranking, calibration, thresholds.

Ranking metrics first aggregate by distinct score. Cumulative sums over scores then run in three levels: within
fine score ranges, over the totals of those in each coarse range, and over the totals of coarse ranges, so no
task sorts all scores, also where they crowd together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.operators.percentiles import percentiles

RANGES = 1024


def _ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty).cast("double"))


def confusion(scored: DataFrame, threshold: float | Column, *groups: str, weight: str | None = None, predicted: Column | None = None) -> DataFrame:
    """tp, fp, tn, fn and the rates from them; precision, recall and f1 of nothing are 0, fpr and fnr are NULL. One pass."""
    hit = predicted if predicted is not None else F.col("p") >= threshold
    w = F.col(weight) if weight else F.lit(1)
    part = lambda y, h: F.sum(F.when((F.col("label") == y) & (hit if h else ~hit), w).otherwise(0))
    out = scored.groupBy(*groups).agg(part(1, True).alias("tp"), part(0, True).alias("fp"), part(0, False).alias("tn"), part(1, False).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return out.withColumns({
        "accuracy": _ratio(tp + tn, tp + fp + tn + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "fpr": _ratio(fp, fp + tn, None), "fnr": _ratio(fn, fn + tp, None),
    })


def by_score(scored: DataFrame, *groups: str, weight: str | None = None) -> DataFrame:
    """Each distinct score with pos, neg and the sums pos_ge, neg_ge of all scores at least as high."""
    w = F.col(weight) if weight else F.lit(1)
    per = scored.groupBy(*groups, "p").agg(F.sum(F.when(F.col("label") == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 0, w).otherwise(0)).alias("neg"))
    return from_the_top(per, ["pos", "neg"], *groups)


def from_the_top(per: DataFrame, names: list[str], *groups: str) -> DataFrame:
    """per, one row for each score p, with the sums {name}_ge of all scores at least as high."""
    per = per.withColumn("_r", F.floor(F.col("p") * RANGES)).withColumn("_f", F.floor(F.col("p") * RANGES * RANGES))
    fine = per.groupBy(*groups, "_r", "_f").agg(*[F.sum(n).alias(f"_f_{n}") for n in names])
    coarse = fine.groupBy(*groups, "_r").agg(*[F.sum(f"_f_{n}").alias(f"_r_{n}") for n in names])
    above = lambda keys, order: Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c, keys, order: F.coalesce(F.sum(c).over(above(keys, order)), F.lit(0))
    coarse = coarse.select(*groups, "_r", *[earlier(f"_r_{n}", groups, "_r").alias(f"_r_{n}") for n in names])
    fine = fine.select(*groups, "_r", "_f", *[earlier(f"_f_{n}", [*groups, "_r"], "_f").alias(f"_f_{n}") for n in names]).join(coarse, [*groups, "_r"])
    fine = fine.select(*groups, "_f", *[(F.col(f"_r_{n}") + F.col(f"_f_{n}")).alias(f"_a_{n}") for n in names])
    inside = Window.partitionBy(*groups, "_f").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = per.drop("_r").join(fine, [*groups, "_f"]).withColumns({f"{n}_ge": F.col(f"_a_{n}") + F.sum(n).over(inside) for n in names})
    return out.drop("_f", *[f"_a_{n}" for n in names])


def ranking(scored: DataFrame, *groups: str, weight: str | None = None) -> DataFrame:
    """roc_auc (ties count half, NULL for one class) and average precision over distinct scores."""
    per = by_score(scored, *groups, weight=weight)
    above = F.col("pos_ge") - F.col("pos")
    out = per.groupBy(*groups).agg(F.sum(F.col("neg") * (above + F.col("pos") / 2)).alias("_u"), F.sum(F.col("pos") * F.col("pos_ge") / (F.col("pos_ge") + F.col("neg_ge"))).alias("_a"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return out.select(*groups, _ratio(F.col("_u"), F.col("_p") * F.col("_n"), None).alias("roc_auc"), _ratio(F.col("_a"), F.col("_p"), None).alias("average_precision"))


def brier(scored: DataFrame, *groups: str) -> DataFrame:
    return scored.groupBy(*groups).agg(F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("brier"))


def score_bin(bins: int = 10) -> Column:
    """The bin of p: edges i / bins as doubles, closed on the left, the last one on both sides."""
    return reduce(lambda a, b: a + b, [F.when(F.col("p") >= i * (1.0 / bins), 1).otherwise(0) for i in range(1, bins)])


def reliability(scored: DataFrame, *groups: str, bins: int = 10, weight: str | None = None) -> DataFrame:
    """The bins that hold rows: mass, mean probability, positive rate."""
    w = F.col(weight) if weight else F.lit(1.0)
    out = scored.groupBy(*groups, score_bin(bins).alias("bin")).agg(F.count("*").alias("n"), F.sum(w).alias("mass"), F.sum(w * F.col("p")).alias("_p"), F.sum(w * F.col("label")).alias("_y"))
    return out.select(*groups, "bin", "n", "mass", (F.col("_p") / F.col("mass")).alias("mean_probability"), (F.col("_y") / F.col("mass")).alias("positive_rate"))


def calibration_error(scored: DataFrame, *groups: str, bins: int = 10, weight: str | None = None) -> DataFrame:
    r = reliability(scored, *groups, bins=bins, weight=weight)
    return r.groupBy(*groups).agg((F.sum(F.col("mass") * F.abs(F.col("mean_probability") - F.col("positive_rate"))) / F.sum("mass")).alias("ece"))


def verdict(safe: float, phishing: float, p: str = "p") -> Column:
    """PHISHING from the upper threshold on, SUSPICIOUS from the lower, else SAFE."""
    return F.when(F.col(p) >= phishing, "PHISHING").when(F.col(p) >= safe, "SUSPICIOUS").otherwise("SAFE")


def risk_score(safe: float, phishing: float, p: str = "p") -> Column:
    """0 to 100 between the thresholds, rounded half to even."""
    span = max(phishing - safe, 1e-6)
    return F.bround(F.greatest(F.least((F.col(p) - safe) / span * 100, F.lit(100.0)), F.lit(0.0)), 0).cast("int")


def clean_thresholds(safe, phishing) -> tuple[float, float]:
    """Numbers in 0..1 with safe below phishing; anything else falls back to 0.45 and 0.85."""
    def number(x, default):
        try:
            x = float(x)
        except (TypeError, ValueError):
            return default
        return default if x != x else min(max(x, 0.0), 1.0)

    safe, phishing = number(safe, 0.45), number(phishing, 0.85)
    if phishing <= safe:
        safe, phishing = (safe, 1.0) if safe < 1 else (0.8, 0.85)
    return safe, phishing


def policy_rates(scored: DataFrame, safe: float, phishing: float, *groups: str) -> DataFrame:
    """Rates of the three verdicts, and false_safe and false_phishing within their classes (0 without the class; fnr 1)."""
    v = verdict(safe, phishing)
    share = lambda c: F.avg(c.cast("double"))
    within = lambda y, c: F.avg(F.when(F.col("label") == y, c.cast("double")))
    return scored.groupBy(*groups).agg(
        F.count("*").alias("n"), F.count_if(v == "SAFE").alias("n_safe"), F.count_if(v == "SUSPICIOUS").alias("n_suspicious"), F.count_if(v == "PHISHING").alias("n_phishing"),
        share(v == "SAFE").alias("safe_rate"), share(v == "SUSPICIOUS").alias("suspicious_rate"), share(v == "PHISHING").alias("phishing_rate"),
        F.coalesce(within(1, v == "SAFE"), F.lit(0.0)).alias("false_safe"), F.coalesce(within(0, v == "PHISHING"), F.lit(0.0)).alias("false_phishing"), F.coalesce(within(1, v != "PHISHING"), F.lit(1.0)).alias("fnr"),
    )


def cohort_errors(scored: DataFrame, threshold: float, cohorts: list[str], tags: str = "tags") -> DataFrame:
    """Per overlapping cohort: rows, errors and rates; NULL where a cohort is empty."""
    hit = F.col("p") >= threshold
    found = scored.select("label", "p", F.explode(tags).alias("cohort")).groupBy("cohort").agg(
        F.count_if(F.col("label") == 0).alias("n_legitimate"), F.count_if((F.col("label") == 0) & hit).alias("fp"), F.count_if(F.col("label") == 1).alias("n_phishing"), F.count_if((F.col("label") == 1) & ~hit).alias("fn"))
    want = scored.sparkSession.createDataFrame([(c,) for c in cohorts], "cohort string")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return want.join(found, "cohort", "left").select("cohort", *[n(c).alias(c) for c in ("n_legitimate", "fp", "n_phishing", "fn")], _ratio(n("fp"), n("n_legitimate"), None).alias("fpr"), _ratio(n("fn"), n("n_phishing"), None).alias("fnr"))


def one_class(scored: DataFrame, threshold: float, ok: Column | None = None) -> DataFrame:
    """A phishing-only holdout: recall with failed rows as missed; fpr is NULL by definition."""
    ok = F.lit(True) if ok is None else ok
    hit = ok & (F.col("p") >= threshold)
    counts = (
        F.count("*").alias("n"), F.count_if(hit).alias("detected"), F.count_if(~ok).alias("failed"), F.avg(hit.cast("double")).alias("recall"), F.avg((~hit).cast("double")).alias("fnr"),
        F.min("p").alias("min_p"), F.max("p").alias("max_p"), F.lit(None).cast("double").alias("fpr"),
    )
    return percentiles(scored, [], "p", {"median_p": 0.5}, *counts)


def domain_fpr(scored: DataFrame, threshold: float, domain: str) -> DataFrame:
    """Share of legitimate rows, and of domains with any legitimate row, that are called positive."""
    per = scored.filter("label = 0").groupBy(domain).agg(F.count("*").alias("n"), F.count_if(F.col("p") >= threshold).alias("hits"))
    return per.agg((F.sum("hits") / F.sum("n")).alias("url_fpr"), F.avg((F.col("hits") > 0).cast("double")).alias("domain_fpr"), F.count("*").alias("n_domains"))


def sweep(scored: DataFrame, threshold: float, deltas: list[float], *groups: str) -> DataFrame:
    """Confusion counts at thresholds threshold + delta, clipped to 0..1; the rows are read once, each counted for every delta."""
    cuts = F.array(*[F.struct(F.lit(d).alias("delta"), F.lit(min(max(threshold + d, 0.0), 1.0)).alias("threshold")) for d in deltas])
    per = scored.groupBy(*groups, "p", "label").agg(F.count("*").alias("n")).select(*groups, "p", "label", "n", F.explode(cuts).alias("_c")).select(*groups, "p", "label", "n", "_c.*")
    hit = F.col("p") >= F.col("threshold")
    count = lambda y, h: F.sum(F.when((F.col("label") == y) & (hit if h else ~hit), F.col("n")).otherwise(0))
    return per.groupBy(*groups, "delta", "threshold").agg(count(1, True).alias("tp"), count(0, True).alias("fp"), count(0, False).alias("tn"), count(1, False).alias("fn"))


def counterfactual(variants: DataFrame, base: str, variant: str, threshold: float, home: str = "homepage", limit: float = 0.1) -> DataFrame:
    """Per variant type, how far p moves from its base's home page: n, median, mean, max, share up, crossings, systematic, always_up."""
    homes = variants.filter(F.col(variant) == home).groupBy(F.col(base).alias("_b")).agg(F.max("p").alias("_h"))
    d = F.col("p") - F.col("_h")
    joined = variants.filter(F.col(variant) != home).join(homes, F.col(base) == F.col("_b"))
    crossed = (F.col("_h") < threshold) & (F.col("p") >= threshold)
    moved = (
        F.count("*").alias("n"), F.avg(d).alias("mean_delta"), F.max(d).alias("max_delta"), F.avg((d > 0).cast("double")).alias("share_up"),
        F.count_if(crossed).alias("crossed"), F.bool_and(d > 0).alias("always_up"),
    )
    out = percentiles(joined, [variant], d, {"median_delta": 0.5}, *moved)
    return out.withColumn("systematic", (F.col("median_delta") >= limit) | (F.col("crossed") * 2 > F.col("n")))


def gates(metrics: DataFrame, requirements: list[tuple[str, str, float]]) -> DataFrame:
    """(metric, requirement, actual, passed) and a last row overall. metrics is one row wide; an operator is >=, <=, > or <."""
    rows = []
    for name, op, bound in requirements:
        ok = {">=": F.col(name) >= bound, "<=": F.col(name) <= bound, ">": F.col(name) > bound, "<": F.col(name) < bound}[op]
        rows.append(F.struct(F.lit(name).alias("metric"), F.lit(f"{op} {bound}").alias("requirement"), F.col(name).cast("double").alias("actual"), F.coalesce(ok, F.lit(False)).alias("passed")))
    every = reduce(lambda a, b: a & b, [r["passed"] for r in rows])
    rows.append(F.struct(F.lit("overall").alias("metric"), F.lit("all").alias("requirement"), F.lit(None).cast("double").alias("actual"), every.alias("passed")))
    return metrics.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def leaderboard(results: DataFrame) -> DataFrame:
    """Rank by gate, then lower fpr, higher recall, f1 and average precision, lower Brier; the last run of a model counts."""
    last = results.withColumn("_n", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("run")))).filter("_n = 1").drop("_n")
    order = Window.orderBy(F.desc("passed"), "fpr", F.desc("recall"), F.desc("f1"), F.desc("average_precision"), "brier", "model")
    return last.withColumn("rank", F.row_number().over(order))


def improves(fpr: Column, recall: Column, old_fpr: Column, old_recall: Column, guard: float = 98.0, fpr_step: float = 0.2, recall_step: float = 1.0) -> Column:
    """Whether a candidate improves on an incumbent meaningfully; all in percentage points, NULL counts as 0.

    Reaching the guard does. Otherwise the fpr falls by fpr_step at a loss of recall of recall_step at most, or
    recall rises by recall_step at a rise of fpr of fpr_step at most; never by leaving the guard.
    """
    fpr, recall, old_fpr, old_recall = (F.coalesce(c, F.lit(0.0)) for c in (fpr, recall, old_fpr, old_recall))
    traded = ((old_fpr - fpr >= fpr_step) & (recall >= old_recall - recall_step)) | ((recall - old_recall >= recall_step) & (fpr <= old_fpr + fpr_step))
    return F.when((recall >= guard) & (old_recall < guard), True).otherwise(traded)


def candidate_loop(candidates: list, evaluate: Callable[[object], tuple[float, float, float]], incumbent: tuple[float, float, float], spark, patience: int = 3, guard: float = 98.0) -> tuple[int | None, str, DataFrame]:
    """(index of the winner or None, stop reason, table of trials): candidates are tried in order.

    evaluate gives (fpr, recall, precision) in percentage points on the validation part, which Spark computes.
    One that improves meaningfully and ranks higher becomes the incumbent; after ``patience`` in a row that do
    not improve the loop stops. Only these few numbers are on the driver.
    """
    rank = lambda m: (m[1] >= guard, -m[0], m[1], m[2])
    held, winner, idle, reason, rows = incumbent, None, 0, "candidates_exhausted", []
    for i, candidate in enumerate(candidates):
        new = evaluate(candidate)
        pair = spark.createDataFrame([(*map(float, new[:2]), *map(float, held[:2]))], "a double, b double, c double, d double")
        better = pair.select(improves(F.col("a"), F.col("b"), F.col("c"), F.col("d"), guard)).first()[0]
        rows.append((i, *map(float, new), bool(better), winner))
        if better and rank(new) > rank(held):
            held, winner = new, i
        idle = 0 if better else idle + 1
        if idle >= patience:
            reason = "no_meaningful_improvement"
            break
    return winner, reason, spark.createDataFrame(rows, "trial int, fpr double, recall double, precision double, improves boolean, against int")


def selection_score() -> Column:
    return 0.35 * F.col("recall") + 0.25 * F.col("average_precision") + 0.2 * F.col("f1") - 0.3 * F.col("fpr") - 0.1 * F.col("brier")


def compare_models(scored: DataFrame, threshold: float, model: str, baseline: str, candidate: str) -> DataFrame:
    """Metrics of two models on the same rows, and the candidate's gain, one row per metric."""
    names = ["accuracy", "precision", "recall", "f1", "fpr", "fnr"]
    wide = confusion(scored, threshold, model).join(ranking(scored, model), model).join(brier(scored, model), model)
    names += ["roc_auc", "average_precision", "brier"]
    long = wide.select(model, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select(model, "m.*")
    pick = lambda name: F.max(F.when(F.col(model) == name, F.col("value")))
    return long.groupBy("metric").agg(pick(baseline).alias("baseline"), pick(candidate).alias("candidate")).withColumn("delta", F.col("candidate") - F.col("baseline"))


def failures(scored: DataFrame, threshold: float, key: str, n: int = 100) -> DataFrame:
    """The n false positives and n false negatives with the highest and lowest p."""
    kind = F.when((F.col("label") == 0) & (F.col("p") >= threshold), "false_positive").when((F.col("label") == 1) & (F.col("p") < threshold), "false_negative")
    far = F.when(F.col("kind") == "false_positive", F.col("p")).otherwise(-F.col("p"))
    wrong = scored.withColumn("kind", kind).filter("kind IS NOT NULL")
    return wrong.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc(far), key))).filter(F.col("rank") <= n)


def expectations(df: DataFrame, expected: str, actual: str) -> DataFrame:
    ok = F.col(expected).eqNullSafe(F.col(actual))
    return df.agg(F.count("*").alias("n"), F.count_if(ok).alias("passed"), F.bool_and(ok).alias("all_passed"))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, counted; both 0 for equal tables, repeats included."""
    a = left.exceptAll(right).agg(F.count("*").alias("only_left"))
    return a.crossJoin(right.exceptAll(left).agg(F.count("*").alias("only_right")))


def distribution(scored: DataFrame, *groups: str, value: str = "p") -> DataFrame:
    """Minimum, exact percentiles and maximum."""
    names = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    rest = (F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    return percentiles(scored, list(groups), value, names, *rest).select(*groups, "n", "min", *names, "max", "mean")


def binned_misses(positives: DataFrame, threshold: float, edges: dict[str, list[float]], flags: list[str]) -> DataFrame:
    """samples, missed and miss_rate of positives by right-closed bins of numbers and by yes/no flags; one pass over the rows."""
    def bin_of(c, cuts):
        out = F.when(F.col(c) <= cuts[0], f"<={cuts[0]:g}")
        for a, b in zip(cuts, cuts[1:]):
            out = out.when(F.col(c) <= b, f"({a:g},{b:g}]")
        return out.otherwise(f">{cuts[-1]:g}")

    dims = [F.struct(F.lit(c).alias("dimension"), bin_of(c, cuts).alias("value")) for c, cuts in edges.items()] + [F.struct(F.lit(c).alias("dimension"), F.when(F.col(c), "yes").otherwise("no").alias("value")) for c in flags]
    long = positives.select(F.explode(F.array(*dims)).alias("d"), (F.col("p") < threshold).alias("miss")).select("d.*", "miss")
    return long.groupBy("dimension", "value").agg(F.count("*").alias("samples"), F.count_if("miss").alias("missed"), F.avg(F.col("miss").cast("double")).alias("miss_rate"))


def worst_groups(misses: DataFrame, n: int = 20) -> DataFrame:
    """The n rows of binned_misses with the most missed, then the highest rate."""
    return misses.orderBy(F.desc("missed"), F.desc("miss_rate"), "dimension", "value").limit(n)


def error_groups(scored: DataFrame, threshold: float, groups: dict[str, str]) -> DataFrame:
    """False positives and negatives by each grouping: (group_type, key)."""
    hit = F.col("p") >= threshold
    long = scored.select(F.explode(F.array(*[F.struct(F.lit(t).alias("group_type"), F.col(c).cast("string").alias("key")) for t, c in groups.items()])).alias("g"), ((F.col("label") == 0) & hit).alias("fp"), ((F.col("label") == 1) & ~hit).alias("fn"))
    return long.select("g.*", "fp", "fn").groupBy("group_type", "key").agg(F.count("*").alias("n"), F.count_if("fp").alias("fp"), F.count_if("fn").alias("fn"), F.avg((F.col("fp") | F.col("fn")).cast("double")).alias("error_rate"))


def error_contrast(scored: DataFrame, threshold: float, features: list[str]) -> DataFrame:
    """Mean of each feature among false positives, right legitimate rows, false negatives and detected ones."""
    hit = F.col("p") >= threshold
    kinds = {"false_positive": (F.col("label") == 0) & hit, "correct_legitimate": (F.col("label") == 0) & ~hit, "false_negative": (F.col("label") == 1) & ~hit, "detected": (F.col("label") == 1) & hit}
    wide = scored.agg(*[F.avg(F.when(c, F.col(f))).alias(f"{f}|{k}") for f in features for k, c in kinds.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col(f"`{f}|{k}`").alias(k) for k in kinds]) for f in features])).alias("r")).select("r.*")


def _thresholds(per: DataFrame) -> DataFrame:
    """by_score with totals and the neighbours that rules need."""
    every = per.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return per.crossJoin(F.broadcast(every))  # one row


def budget_thresholds(scored: DataFrame, below_safe: float = 0.02, at_phishing: float = 0.01, defaults: tuple[float, float] = (0.45, 0.85)) -> DataFrame:
    """(safe, phishing): the highest score with few enough positives below it, the lowest negative score (or 1) with few enough negatives from it on; safe gives way."""
    per = _thresholds(by_score(scored))
    safe = F.max(F.when((F.col("pos") > 0) & ((F.col("all_pos") - F.col("pos_ge")) <= below_safe * F.col("all_pos")), F.col("p")))
    phishing = F.min(F.when((F.col("neg") > 0) & (F.col("neg_ge") <= at_phishing * F.col("all_neg")), F.col("p")))
    one = F.when(F.coalesce(F.sum(F.when(F.col("p") >= 1, F.col("neg"))), F.lit(0)) <= at_phishing * F.max("all_neg"), 1.0)
    out = per.agg(F.when(F.max("all_pos") > 0, safe).otherwise(defaults[0]).alias("safe"), F.coalesce(phishing, one, F.lit(defaults[1])).alias("phishing"))
    return out.withColumn("safe", F.when(F.col("phishing") <= F.col("safe"), F.least("safe", F.greatest(F.col("phishing") - 0.05, F.lit(0.0)))).otherwise(F.col("safe")))


def next_negative_threshold(scored: DataFrame, budget: float = 0.02, below_safe: float = 0.02, defaults: tuple[float, float] = (0.45, 0.85)) -> DataFrame:
    """(safe, phishing) by sorted index: the positive score of index floor(below_safe * positives), which gives way, and
    the lowest negative score above the cut that leaves floor(budget * negatives) of them, infinity if there is none."""
    per = _thresholds(by_score(scored))
    below = F.col("all_pos") - F.col("pos_ge") + F.col("pos")
    safe = F.min(F.when((F.col("pos") > 0) & (below >= F.least(F.floor(below_safe * F.col("all_pos")) + 1, "all_pos")), F.col("p")))
    fits = (F.col("neg") > 0) & (F.col("neg_ge") <= F.floor(budget * F.col("all_neg")))
    phishing = F.when(F.sum("neg") > 0, F.coalesce(F.min(F.when(fits, F.col("p"))), F.lit(float("inf")))).otherwise(defaults[1])
    out = per.agg(F.coalesce(safe, F.lit(defaults[0])).alias("safe"), phishing.alias("phishing"))
    return out.withColumn("safe", F.when(F.col("phishing") <= F.col("safe"), F.least("safe", F.greatest(F.col("phishing") - 0.05, F.lit(0.0)))).otherwise(F.col("safe")))


def false_positive_threshold(scored: DataFrame, budget: float = 0.005) -> DataFrame:
    """The negative score that must be exceeded so that at most floor(budget * negatives) are; predict p > above."""
    per = _thresholds(by_score(scored)).filter("neg > 0")
    over = F.col("neg_ge") > F.floor(budget * F.col("all_neg"))
    return per.agg(F.coalesce(F.max(F.when(over, F.col("p"))), F.lit(-1.0)).alias("above"))


#: The next number above 1: no probability reaches it.
ABOVE_ONE = 1.0 + 2.0**-52


def _one_more(scored: DataFrame, p: float, columns: dict[str, Column]) -> DataFrame:
    return scored.sparkSession.range(1).select(F.lit(p).alias("p"), *[c.alias(n) for n, c in columns.items()])


def domain_threshold(scored: DataFrame, domain: str, limit: float = 0.02) -> DataFrame:
    """Most recall with at most ``limit`` of the legitimate domains hit; ties to the higher threshold.

    Asked for are the scores of positives, the highest of each legitimate domain, and one above 1, which always fits.
    """
    neg = F.col("label") == 0
    tops = scored.filter(neg).groupBy(domain).agg(F.max("p").alias("p")).select("p", F.lit(1).alias("t"), F.lit(0).alias("y"), F.lit(0).alias("c"))
    every = scored.select("p", F.lit(0).alias("t"), (F.col("label") == 1).cast("int").alias("y"), neg.cast("int").alias("c"))
    both = tops.unionByName(every).unionByName(_one_more(scored, ABOVE_ONE, {n: F.lit(0) for n in "tyc"}))
    per = from_the_top(both.groupBy("p").agg(*[F.sum(c).alias(c) for c in "tyc"]), ["t", "y", "c"])
    total = per.agg(*[F.sum(c).alias(f"all_{c}") for c in "tyc"])
    per = per.crossJoin(F.broadcast(total)).filter("t > 0 OR y > 0 OR p > 1").filter(F.col("t_ge") <= limit * F.col("all_t"))  # one row
    best = per.orderBy(F.desc("y_ge"), F.desc("p")).limit(1)
    rate = lambda c: _ratio(F.col(f"{c}_ge"), F.col(f"all_{c}"))
    return best.select(F.col("p").alias("phishing"), rate("y").alias("recall"), rate("t").alias("domain_fpr"), rate("c").alias("url_fpr"))


def weighted_threshold(scored: DataFrame, weight: str, dynamic: str, limit: float = 0.01, below_safe: float = 0.02) -> DataFrame:
    """(safe, phishing, feasible, recall, weighted_fpr, dynamic_fpr).

    phishing: of the negative scores and 1 those with weighted fpr and fpr of dynamic negatives within limits, most
    recall, then the lowest; the next number above 1 if infeasible. safe: the highest positive score (or 0) with
    at most a share below_safe of the weight of positives below it; it gives way to phishing.
    """
    neg, pos = F.col("label") == 0, F.col("label") == 1
    zero = lambda c, x: F.when(c, x).otherwise(0)
    rows = scored.select("p", zero(neg, F.col(weight)).alias("w"), zero(neg & F.col(dynamic), 1).alias("d"), pos.cast("int").alias("y"), neg.cast("int").alias("c"), zero(pos, F.col(weight)).alias("v"))
    names = ["w", "d", "y", "v"]
    rows = rows.unionByName(_one_more(scored, 1.0, {"w": F.lit(0), "d": F.lit(0), "y": F.lit(0), "c": F.lit(1), "v": F.lit(0)}))
    per = from_the_top(rows.groupBy("p").agg(*[F.sum(c).alias(c) for c in [*names, "c"]]), names)
    per = per.crossJoin(F.broadcast(per.agg(*[F.sum(x).alias(f"all_{x}") for x in names])))  # one row
    weighted, moving = F.col("w_ge") / F.greatest("all_w", F.lit(1.0)), _ratio(F.col("d_ge"), F.col("all_d"))
    fits = (F.col("c") > 0) & (weighted <= limit) & (F.col("d_ge") <= limit * F.col("all_d"))
    found = F.struct("p", _ratio(F.col("y_ge"), F.col("all_y")).alias("recall"), weighted.alias("weighted_fpr"), moving.alias("dynamic_fpr"))
    low = (F.col("all_v") - F.col("v_ge")) / F.greatest("all_v", F.lit(1.0)) <= below_safe
    best = per.agg(F.max_by(F.when(fits, found), F.when(fits, F.struct("y_ge", -F.col("p")))).alias("b"), F.max(F.when((F.col("y") > 0) & low, F.col("p"))).alias("s"))
    phishing, safe = F.coalesce("b.p", F.lit(ABOVE_ONE)), F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(0.0))
    return best.select(
        F.when(safe >= phishing, F.greatest(phishing - 1e-6, F.lit(0.0))).otherwise(safe).alias("safe"), phishing.alias("phishing"), F.col("b").isNotNull().alias("feasible"),
        F.coalesce("b.recall", F.lit(0.0)).alias("recall"), F.col("b.weighted_fpr").alias("weighted_fpr"), F.col("b.dynamic_fpr").alias("dynamic_fpr"),
    )


def guarded_threshold(scored: DataFrame, safe: float = 0.45, guard: float = 0.98) -> DataFrame:
    """Scores above safe: least fpr with recall of at least ``guard``, else most recall, then least fpr, then the higher score."""
    per = _thresholds(by_score(scored)).filter(F.col("p") > safe)
    recall, fpr = F.col("pos_ge") / F.greatest("all_pos", F.lit(1)), F.col("neg_ge") / F.greatest("all_neg", F.lit(1))
    per = per.select("p", recall.alias("recall"), fpr.alias("fpr"), (F.col("pos_ge") / (F.col("pos_ge") + F.col("neg_ge"))).alias("precision"))
    met = F.col("recall") >= guard
    best = per.orderBy(F.desc(met), F.when(met, F.col("fpr")), F.when(~met, -F.col("recall")), "fpr", F.desc("recall"), F.desc("precision"), F.desc("p")).limit(1)
    return best.select(F.col("p").alias("phishing"), "recall", "fpr", met.alias("guard_met"))


def grid_threshold(scored: DataFrame, limit: float = 0.015, high: float = 0.999) -> DataFrame:
    """Most recall with fpr within limit over all scores and a grid that ends at high; ties to lower fpr, then to the higher threshold.

    Between two scores all thresholds count alike, so of the grid only its end can win, where it is above all
    scores. Where nothing fits, phishing, recall and fpr are NULL and feasible is false.
    """
    end = _one_more(scored, high, {"pos": F.lit(0), "neg": F.lit(0)})
    per = scored.groupBy("p").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")).unionByName(end)
    per = _thresholds(from_the_top(per.groupBy("p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), ["pos", "neg"]))
    fits = F.col("neg_ge") <= limit * F.col("all_neg")
    found = F.struct("p", _ratio(F.col("pos_ge"), F.col("all_pos")).alias("recall"), _ratio(F.col("neg_ge"), F.col("all_neg")).alias("fpr"))
    best = per.agg(F.max_by(F.when(fits, found), F.when(fits, F.struct("pos_ge", -F.col("neg_ge"), "p"))).alias("b"))
    return best.select(F.col("b.p").alias("phishing"), F.col("b.recall").alias("recall"), F.col("b.fpr").alias("fpr"), F.col("b").isNotNull().alias("feasible"))


#: Ids, severities and order of the items.
def evidence(f: dict[str, Column] | None = None) -> Column:
    """Ordered evidence items from feature columns; the scheme always gives one."""
    c = lambda name: F.col(name)
    item = lambda id_, severity, polarity, feature: F.struct(F.lit(id_).alias("id"), F.lit(severity).alias("severity"), F.lit(polarity).alias("polarity"), F.lit(feature).alias("feature"), c(feature).cast("double").alias("value"))
    rules = [
        (c("IsHTTPS") == 1, item("https_enabled", "info", "neutral", "IsHTTPS")), (c("IsHTTPS") == 0, item("http_scheme", "warning", "negative", "IsHTTPS")), (c("IsDomainIP") == 1, item("ip_host", "danger", "negative", "IsDomainIP")),
        (c("HasSuspiciousToken") == 1, item("suspicious_token", "warning", "negative", "HasSuspiciousToken")), (c("HasUserInfo") == 1, item("userinfo", "danger", "negative", "HasUserInfo")), (c("HasPort") == 1, item("explicit_port", "warning", "negative", "HasPort")),
        (c("URLPercentEncodingCount") > 0, item("encoding", "warning", "negative", "URLPercentEncodingCount")), (c("SubdomainDepth") >= 3, item("deep_subdomains", "warning", "negative", "SubdomainDepth")),
    ]
    return F.array_compact(F.array(*[F.when(cond, it) for cond, it in rules]))


#: Hosts with their approved paths; for a numeric playback route, also what its query pairs may be.
OFFICIAL_PATHS = {
    "chatgpt.com": ("/",), "www.youtube.com": ("/",), "gemini.google.com": ("/app",), "mail.google.com": ("/mail/u/0/",), "netflix.com": ("/browse",), "www.netflix.com": ("/browse",), "www.canva.com": ("/templates",),
    "www.instagram.com": ("/accounts/onetap/",), "cybercrime.gov.in": ("/",), "www.cybercrime.gov.in": ("/",),
    "www.indiacode.nic.in": tuple(f"/handle/123456789/{n}" for n in ("1522", "1999", "2000", "2006", "2008", "2013")),
}
PLAYBACK = (("netflix.com", "www.netflix.com"), "/watch/[0-9]+", "trackId=[0-9]+|ctx=.*")
SHOPPING = (("amazon.com", "www.amazon.com"), ("/", "/s", "/cart", "/gp/buy/spc/handlers/display[.]html", "(?i)/gp/cart/view[.]html(?:/.*)?", "(?i)/(?:[^/]+/)?dp/[A-Z0-9]{10}(?:/.*)?", "(?i)/gp/product/[A-Z0-9]{10}(?:/.*)?"))


def official_policy(spark) -> DataFrame:
    """The built-in route policy as a table (host, path_pattern, pair_pattern)."""
    exact = [(h, p.replace(".", "[.]"), None) for h, paths in OFFICIAL_PATHS.items() for p in paths]
    rows = exact + [(h, PLAYBACK[1], PLAYBACK[2]) for h in PLAYBACK[0]] + [(h, p, None) for h in SHOPPING[0] for p in SHOPPING[1]]
    return spark.createDataFrame(rows, "host string, path_pattern string, pair_pattern string")


def route_policy(df: DataFrame, policy: DataFrame, safe: float, url: str = "normalized_url", p: str = "p") -> DataFrame:
    """df with policy_applied and effective_p: loopback hosts, and approved routes of exact hosts, end just below safe.

    policy has (host, path_pattern), and may have pair_pattern, which then every key=value pair of the query must
    match; official_policy is one. A route counts only for https, a clean authority, no redirect-like key, no
    embedded absolute URL and no doubly encoded value. The raw score stays.
    """
    from corpusforge.functions import urls as U

    df = df.withColumn("_u", U.parts(F.col(url))).withColumn("_q", U.query_pairs(F.col("_u")["query"])).withColumn("_h", F.regexp_replace(F.col("_u")["host"], r"\.+$", "")).withColumn("_k", F.monotonically_increasing_id())
    u = F.col("_u")
    local = (F.col("_h") == "localhost") | F.col("_h").endswith(".localhost") | F.col("_h").rlike(r"^127\.[0-9]+\.[0-9]+\.[0-9]+$") | (F.col("_h") == "::1")
    markers = ("continue", "dest", "destination", "next", "redirect", "return", "target", "url")
    embedded = F.exists("_q", lambda x: F.lower(x["key"]).isin(*markers) | F.lower(x["value"]).rlike("^(?:https?:)?//"))
    clean = (u["scheme"] == "https") & u["userinfo"].isNull() & u["port"].isNull() & ~F.col(url).contains("%") & ~embedded & (F.col(p) >= safe)
    pair = F.col("pair_pattern") if "pair_pattern" in policy.columns else F.lit(None).cast("string")
    rules = policy.groupBy(F.col("host").alias("_host")).agg(F.collect_list(F.struct(F.col("path_pattern").alias("path"), pair.alias("pair"))).alias("_rules"))
    joined = df.join(rules, F.col("_h") == F.col("_host"), "left")
    whole = lambda text, pattern: F.regexp(text, F.concat(F.lit("^(?:"), pattern, F.lit(")$")))
    allowed = lambda r: r["pair"].isNull() | F.forall("_q", lambda x: whole(F.concat(x["key"], F.lit("="), x["value"]), r["pair"]))
    route = clean & F.coalesce(F.exists("_rules", lambda r: whole(u["path"], r["path"]) & allowed(r)), F.lit(False))
    applied = F.coalesce(local | route, F.lit(False))
    return joined.withColumn("policy_applied", applied).withColumn("effective_p", F.when(applied, F.least(F.col(p), F.lit(max(0.0, safe - 1e-6)))).otherwise(F.col(p))).drop("_u", "_q", "_h", "_k", "_host", "_rules")


def legitimate_only(scored: DataFrame, safe: float, phishing: float, facets: dict[str, str], tags: str | None = None) -> DataFrame:
    """A set of legitimate rows: verdict counts, fpr and the range of p, overall and by each facet and tag. One pass."""
    keys = [F.struct(F.lit("all").alias("facet"), F.lit("all").alias("key"))] + [F.struct(F.lit(f).alias("facet"), F.col(c).cast("string").alias("key")) for f, c in facets.items()]
    every = F.array(*keys)
    if tags:
        every = F.concat(every, F.transform(tags, lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("key"))))
    v = verdict(safe, phishing)
    long = scored.select(F.explode(every).alias("k"), "p", v.alias("v")).select("k.*", "p", "v")
    return long.groupBy("facet", "key").agg(F.count("*").alias("n"), *[F.count_if(F.col("v") == x).alias(x.lower()) for x in ("SAFE", "SUSPICIOUS", "PHISHING")],
                                            F.avg((F.col("v") == "PHISHING").cast("double")).alias("fpr"), F.min("p").alias("min_p"), F.avg("p").alias("avg_p"), F.max("p").alias("max_p"))


def hard_recall(scored: DataFrame, threshold: float, tags: str, domain: str, training: DataFrame) -> DataFrame:
    """Recall of positives by tag, without rows of domains that training has."""
    rows = scored.filter("label = 1").join(training.select(domain).distinct(), domain, "left_anti")
    return rows.select("p", F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("samples"), F.count_if(F.col("p") >= threshold).alias("detected"), F.avg((F.col("p") >= threshold).cast("double")).alias("recall"))


def coverage(counts: DataFrame, core: list[str]) -> DataFrame:
    """Whether the classes explain each other away: supports if every core tag has no legitimate and some phishing rows.

    counts has (tag, label, n).
    """
    want = counts.sparkSession.createDataFrame([(t,) for t in core], "tag string")
    per = counts.groupBy("tag").agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("l"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("p"))
    rows = want.join(per, "tag", "left").select("tag", F.coalesce("l", F.lit(0)).alias("n_legitimate"), F.coalesce("p", F.lit(0)).alias("n_phishing"))
    return rows.agg(F.bool_and((F.col("n_legitimate") == 0) & (F.col("n_phishing") > 0)).alias("supports"), F.count_if(F.col("n_legitimate") == 0).alias("tags_without_legitimate"))


#: The paths under which reports of different shapes keep a metric.
REPORT_PATHS = {
    "recall": ("recall", "metrics.recall", "test.recall", "test_metrics.recall", "evaluation.recall"), "precision": ("precision", "metrics.precision", "test.precision", "test_metrics.precision", "evaluation.precision"),
    "fpr": ("false_positive_rate", "fpr", "metrics.fpr", "metrics.false_positive_rate", "test.fpr", "test_metrics.false_positive_rate"), "roc_auc": ("roc_auc", "metrics.roc_auc", "test.roc_auc", "test_metrics.roc_auc"),
    "average_precision": ("pr_auc", "average_precision", "metrics.pr_auc", "metrics.average_precision", "test_metrics.pr_auc"), "brier": ("brier_score", "brier", "metrics.brier_score", "metrics.brier", "test_metrics.brier_score"),
}


def report_metrics(reports: DataFrame, key: str, text: str) -> DataFrame:
    """(key, metric..., complete) from JSON reports of different shapes: the first path that holds a number."""
    found = {m: F.coalesce(*[F.expr(f"try_cast(get_json_object(`{text}`, '$.{p}') AS double)") for p in paths]) for m, paths in REPORT_PATHS.items()}
    out = reports.select(key, *[c.alias(m) for m, c in found.items()])
    return out.withColumn("complete", reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in found]))


def select_candidate(metrics: DataFrame, incumbent: str, margin: float = 0.0) -> DataFrame:
    """The model with the highest selection score among those that pass; the incumbent stays unless it is beaten by more than margin."""
    scored = metrics.filter("passed").withColumn("score", selection_score())
    held = F.max(F.when(F.col("model") == incumbent, F.col("score")))
    best = scored.agg(F.max_by("model", F.struct("score", "model")).alias("best"), F.max("score").alias("best_score"), held.alias("held"))
    return best.select(F.when(F.col("held").isNotNull() & (F.col("best_score") - F.col("held") <= margin), F.lit(incumbent)).otherwise(F.col("best")).alias("model"), "best_score", "held")
