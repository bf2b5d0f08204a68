"""Metrics of answers, retrieval, extraction and running times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.functions import columns as C

QA_TARGETS = {"exact_match": 0.4, "token_f1": 0.55, "coverage": 0.8}
RETRIEVAL_TARGETS = {"recall_10": 0.7, "precision_10": 0.6, "mrr": 0.6}


def qa_rows(answers: DataFrame) -> DataFrame:
    """(question_id, exact_match, precision, recall, f1, coverage) of answers (question_id, predicted, gold, context)."""
    f = C.token_f1("predicted", "gold")
    rows = answers.withColumn("f", f)
    exact = (C.normalise_answer("predicted") == C.normalise_answer("gold")).cast("int")
    cover = F.when(F.col("context").isNotNull(), C.answer_coverage("gold", "context"))
    return rows.select("question_id", exact.alias("exact_match"), *[F.round(F.col(f"f.{k}"), 6).alias(k) for k in ("precision", "recall", "f1")], F.round(cover, 6).alias("coverage"))


def qa_summary(rows: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.avg(c), 4)
    out = rows.agg(C.rows().alias("questions"), mean("exact_match").alias("exact_match"), mean("f1").alias("token_f1"), mean("precision").alias("precision"), mean("recall").alias("recall"), mean("coverage").alias("coverage"))
    met = F.lit(True)
    for k, v in QA_TARGETS.items():
        met = met & (F.coalesce(F.col(k), F.lit(0.0)) >= v)
    return out.withColumn("meets_targets", met)


def retrieval_rows(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """A row for each query with relevant documents: reciprocal rank, and recall, precision and NDCG at each k.

    ranked: (query_id, doc_id, rank); relevant: (query_id, doc_id).  Precision divides by what was retrieved.
    """
    rel = relevant.select("query_id", "doc_id").distinct()
    size = rel.groupBy("query_id").agg(C.rows().alias("rel"))
    hits = ranked.join(rel.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").select("query_id", "rank", F.coalesce("hit", F.lit(0)).alias("hit"))
    at = lambda k, e: F.sum(F.when(F.col("rank") <= k, e).otherwise(0))
    gain = F.col("hit") / F.log2(F.col("rank") + 1)
    aggs = [F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first")]
    for k in ks:
        aggs += [at(k, F.col("hit")).alias(f"h{k}"), at(k, F.lit(1)).alias(f"n{k}"), at(k, gain).alias(f"g{k}")]
    q = size.join(hits.groupBy("query_id").agg(*aggs), "query_id", "left")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("rel")).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    cols = [F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank")]
    for k in ks:
        h, n, g = (F.coalesce(F.col(f"{x}{k}"), F.lit(0)) for x in "hng")
        cols += [F.round(h / F.col("rel"), 6).alias(f"recall_{k}"), F.round(F.coalesce(F.try_divide(h, n), F.lit(0.0)), 6).alias(f"precision_{k}"), F.round(g / ideal(k), 6).alias(f"ndcg_{k}")]
    return q.select("query_id", *cols)


def retrieval_summary(rows: DataFrame) -> DataFrame:
    out = rows.agg(C.rows().alias("queries"), F.round(F.avg("reciprocal_rank"), 4).alias("mrr"), *[F.round(F.avg(c), 4).alias(c) for c in rows.columns if c[-1].isdigit()])
    met = F.lit(True)
    for k, v in RETRIEVAL_TARGETS.items():
        met = met & (F.coalesce(F.col(k), F.lit(0.0)) >= v)
    return out.withColumn("meets_targets", met)


def extraction_counts(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row: true and false positives, false negatives, precision, recall, F1 of multisets of keys.

    The i-th copy of a value on one side matches the i-th copy on the other, which is what matching one to one in
    order gives, without a loop.
    """
    count = lambda df, n: df.groupBy(*keys).agg(C.rows().alias(n))
    both = count(predicted, "__p").join(count(truth, "__t"), keys, "full").select(F.coalesce("__p", F.lit(0)).alias("p"), F.coalesce("__t", F.lit(0)).alias("t"))
    s = both.agg(F.coalesce(F.sum(F.least("p", "t")), F.lit(0)).alias("tp"), F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.coalesce(F.sum("t"), F.lit(0)).alias("t"))
    zero = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    return s.select("tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"), zero(F.try_divide("tp", "p")).alias("precision"), zero(F.try_divide("tp", "t")).alias("recall"), zero(F.try_divide(2 * F.col("tp"), F.col("p") + F.col("t"))).alias("f1"))


def distance_accuracy(errors: DataFrame, km: str = "km", near: float = 25.0, far: float = 200.0) -> DataFrame:
    """One row: located pairs, mean and median error, shares within near, between, and beyond far."""
    share = lambda t: F.round(F.coalesce(F.avg(t.cast("double")), F.lit(0.0)), 6)
    e = F.col(km)
    return errors.where(e.isNotNull()).agg(C.rows().alias("pairs"), F.round(F.coalesce(F.avg(e), F.lit(0.0)), 4).alias("mean_km"), F.round(F.percentile(e, F.lit(0.5)), 4).alias("median_km"), share(e <= near).alias("near"), share((e > near) & (e <= far)).alias("middle"), share(e > far).alias("far"))


def latency(timings: DataFrame, seconds: str = "total_duration_seconds") -> DataFrame:
    """One row: runs, p50, p95, p99 (interpolated), mean, population deviation in ms, chunks a second, hours of GPU."""
    ms = F.col(seconds) * 1000
    p = lambda q: F.round(F.percentile(ms, F.lit(q)), 4)
    return timings.where(F.col(seconds).isNotNull()).agg(C.rows().alias("runs"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.round(F.avg(ms), 4).alias("mean"), F.round(F.stddev_pop(ms), 4).alias("deviation"), F.round(F.try_divide(C.rows(), F.sum(seconds)), 6).alias("chunks_a_second"), F.round(F.coalesce(F.sum("gpu_hours"), F.lit(0.0)), 4).alias("gpu_hours"))


EFFICIENCY_TARGETS = {"overhead": 0.5, "throughput": 10.0, "p95": 500.0}  # per cent at most, chunks a second at least, ms at most


def efficiency_targets(timings: DataFrame, seconds: str = "total_duration_seconds", overhead_percent: float = 0.0) -> DataFrame:
    """One row: chunks a second and p95 in ms of timed runs, and whether overhead, throughput and p95 meet their targets; without runs only overhead can."""
    t = EFFICIENCY_TARGETS
    s = latency(timings, seconds).select("runs", "p95", "chunks_a_second")
    return s.select("runs", "p95", "chunks_a_second", F.lit(overhead_percent < t["overhead"]).alias("overhead_met"), F.coalesce(F.col("chunks_a_second") >= t["throughput"], F.lit(False)).alias("throughput_met"), F.coalesce(F.col("p95") < t["p95"], F.lit(False)).alias("p95_met"))


def overall_scores(rows: DataFrame, dimension: str = "dimension_name") -> DataFrame:
    """One row: mean F1 of the dimensions (dimension, f1) and the share that has any; 0 without dimensions."""
    return rows.where(F.col(dimension).isNotNull()).agg(C.rows().alias("dimensions"), F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 6).alias("combined_f1"), F.round(F.coalesce(F.avg((F.col("f1") > 0).cast("int")), F.lit(0.0)), 6).alias("success_rate"))


def component_times(timings: DataFrame) -> DataFrame:
    """(component, part, runs, total, mean, least, greatest): nested durations, parts of components included."""
    c = timings.where("components is not null").select(F.explode("components").alias("component", "v"))
    own = c.select("component", F.lit("").alias("part"), F.col("v.duration_seconds").alias("s"))
    inner = c.where("v.components is not null").select("component", F.explode("v.components").alias("part", "s"))
    g = own.unionByName(inner).where("s is not null").groupBy("component", "part")
    return g.agg(C.rows().alias("runs"), F.round(F.sum("s"), 4).alias("total"), F.round(F.avg("s"), 6).alias("mean"), F.min("s").alias("least"), F.max("s").alias("greatest"))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: pairs and Pearson's r, null below two pairs or without spread."""
    r = F.corr(x, y)
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    spread = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return ok.agg(C.rows().alias("pairs"), F.round(F.when((C.rows() >= 2) & spread, r), 6).alias("r"))


def overhead(baseline_s: float, instrumented_s: float) -> float:
    return max(0.0, (instrumented_s - baseline_s) / baseline_s * 100) if baseline_s else 0.0


def improvement(baseline: DataFrame, other: DataFrame, measures: list[str]) -> DataFrame:
    """(measure, baseline, other, change, percent) of two one-row summaries; percent is null from a baseline of 0."""
    long = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias(name)) for m in measures])).alias("x")).select("x.*")
    both = long(baseline, "baseline").join(long(other, "other"), "measure")
    change = F.col("other") - F.col("baseline")
    return both.select("measure", "baseline", "other", F.round(change, 6).alias("change"), F.round(100 * F.try_divide(change, F.abs("baseline")), 4).alias("percent"))


def rolled_up(rows: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Counters by group and in total, in one pass: precision, recall and F1 of tp, fp and fn where they are among the sums."""
    g = rows.rollup(*by).agg(*[F.sum(s).alias(s) for s in sums])
    if {"tp", "fp", "fn"} <= set(sums):
        zero = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
        tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
        g = g.withColumns({"precision": zero(F.try_divide(tp, tp + fp)), "recall": zero(F.try_divide(tp, tp + fn)), "f1": zero(F.try_divide(2 * tp, 2 * tp + fp + fn))})
    return g
