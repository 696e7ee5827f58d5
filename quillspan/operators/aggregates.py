"""Grouped metrics over run heads, with exact percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import scalars
from quillspan.schemas import HOUR

GROUPS = ("project", "time_bucket", "run_type", "tag", "model", "provider", "error", "feedback_key")
VALUES = ("prompt_tokens", "completion_tokens", "total_tokens", "prompt_cost", "completion_cost", "total_cost", "evaluator_score")
RANKED = ("latency_nanos", "first_token_latency_nanos")
#: Steps of an octave in which ranks are looked up.
STEPS = 64
BINS = ("lt_0", "0_to_0_25", "0_25_to_0_5", "0_5_to_0_75", "0_75_to_1", "gt_1")


def finite(x: Column) -> Column:
    """Null for what isn't a finite number."""
    v = x.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def numeric_stats(column: str, percentiles: Sequence[int] = (), name: str | None = None) -> list[Column]:
    """Count, sum, mean, least and largest of the finite values, and percentiles by nearest rank; all null but the count if there are none."""
    v, name = finite(F.col(column)), name or column
    out = [F.count(v).alias(f"{name}_count"), F.sum(v).alias(f"{name}_sum"), F.avg(v).alias(f"{name}_avg"), F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max")]
    if percentiles:
        ranked = F.array_sort(F.collect_list(v))
        out += [scalars.nearest_rank(ranked, p).alias(f"{name}_p{p}") for p in percentiles]
    return out


def bin_counts(score: Column) -> list[Column]:
    edges = [score < 0, (score >= 0) & (score < 0.25), (score >= 0.25) & (score < 0.5), (score >= 0.5) & (score < 0.75), (score >= 0.75) & (score <= 1), score > 1]
    return [F.count_if(e).alias(f"score_{b}") for e, b in zip(edges, BINS, strict=True)]


def group_columns(runs: DataFrame, groups: Sequence[str], bucket: int | None) -> tuple[DataFrame, list[str]]:
    """Runs with their group values as text. A run with several tags is in several groups, one without in ``untagged``."""
    if unknown := [g for g in groups if g not in GROUPS]:
        raise ValueError(f"unknown group: {', '.join(unknown)}")
    if "time_bucket" in groups and not (bucket and bucket > 0):
        raise ValueError("a time bucket needs a positive width")
    names = {"project": "project_name", "time_bucket": "time_bucket_start_unix_nano", "run_type": "run_type", "tag": "tag", "model": "model_name", "provider": "provider_name", "error": "error", "feedback_key": "feedback_key"}
    out = runs
    if "tag" in groups:
        out = out.withColumn("tag", F.explode(F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit("untagged")))))
    made = {"time_bucket": lambda: scalars.bucket(F.col("start_time_unix_nano"), bucket).cast("string"), "model": lambda: F.coalesce("model_name", F.lit("unknown")), "provider": lambda: F.coalesce("provider_name", F.lit("unknown")), "error": lambda: (F.col("status") == "error").cast("string")}
    keys = [names[g] for g in groups if g != "feedback_key"]
    return out.withColumns({f"_{names[g]}": made[g]() if g in made else F.col(names[g]) for g in groups if g != "feedback_key"}), keys


def scored(runs: DataFrame, feedback: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Runs with each numeric score given to them by either of their ids: one equality join, no OR."""
    marks = feedback.where(F.col("score_number").isNotNull() & F.col("run_id").isNotNull())
    if keys:
        marks = marks.where(F.col("key").isin(*keys))
    marks = marks.select(F.col("run_id").alias("_id"), F.col("project_name").alias("_project"), F.col("key").alias("feedback_key"), F.col("score_number").alias("feedback_score"), F.col("id").alias("_feedback"))
    both = runs.withColumn("_id", F.explode(F.array_distinct(F.filter(F.array("run_id", "generated_run_id"), lambda x: x.isNotNull()))))
    return both.join(marks, "_id").where(F.col("_project").isNull() | (F.col("_project") == F.col("project_name"))).drop("_id", "_project")


def sorted_percentiles(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], percentiles: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """``keys`` and nearest-rank percentiles of ``columns``, for groups of any size.

    Values are counted first. A histogram of ``STEPS`` steps an octave, of a few thousand
    rows a group at most, tells the step that holds each rank; only the values
    of these steps are then sorted, so no task sorts a whole group.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("m"), finite(F.col(c)).alias("v")) for c in columns])).alias("x")
    counted = rows.select(*keys, each).where("x.v IS NOT NULL").groupBy(*keys, F.col("x.m").alias("_m"), F.col("x.v").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    # A step's number grows with the value: octaves cut in STEPS, both signs, zero in between.
    size = lambda v: F.floor(F.log2(v) * STEPS) + 1100 * STEPS
    v = F.col("_v")
    stepped = counted.withColumn("_s", F.when(v > 0, size(v)).when(v < 0, -size(-v)).otherwise(F.lit(0)))
    group = Window.partitionBy(*keys, "_m")
    steps = stepped.groupBy(*keys, "_m", "_s").agg(F.sum("_n").alias("_h")).withColumn("_upto", F.sum("_h").over(group.orderBy("_s"))).withColumn("_all", F.sum("_h").over(group))
    ranks = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.floor(((F.col("_all") - 1) * p + 99) / 100).alias("at")) for p in percentiles])).alias("_r")
    wanted = steps.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_m").alias("_wm"), F.col("_s").alias("_ws"), F.col("_upto").alias("_wu"), F.col("_h").alias("_wh"), ranks)
    wanted = wanted.where("_r.at < _wu AND _r.at >= _wu - _wh").select("*", F.col("_r.p").alias("_p"), (F.col("_r.at") - (F.col("_wu") - F.col("_wh"))).alias("_at")).drop("_r", "_wu", "_wh")
    same = (F.col("_m") == F.col("_wm")) & (F.col("_s") == F.col("_ws"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = stepped.join(wanted, same)
    found = inside.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys, "_m", "_p").orderBy("_v"))).where(F.col("_upto") > F.col("_at"))
    return found.groupBy(*keys).agg(*[F.min(F.when((F.col("_m") == c) & (F.col("_p") == p), v)).alias(f"{c}_p{p}") for c in columns for p in percentiles])


def aggregate(runs: DataFrame, groups: Sequence[str] = (), bucket: int | None = HOUR, feedback: DataFrame | None = None, feedback_keys: Sequence[str] | None = None) -> DataFrame:
    """One row a group; without groups one row, or none without runs.

    With the group ``feedback_key`` a run counts once for each score, and runs
    without scores drop out. Without it, scores asked for come as further columns
    and runs aren't counted again.
    """
    if "feedback_key" in groups:
        if feedback is None:
            raise ValueError("grouping by feedback key needs the feedback table")
        runs = scored(runs, feedback, feedback_keys)
    grouped, keys = group_columns(runs, groups, bucket)
    columns = [F.col(f"_{k}").alias(k) for k in keys] + ([F.col("feedback_key")] if "feedback_key" in groups else [])
    names = keys + (["feedback_key"] if "feedback_key" in groups else [])
    # An hour's values fit an array; groups without a time bound are of any size, so their ranks come from a sort.
    within = (50, 95, 99) if "time_bucket" in groups else ()
    measures = [F.count(F.lit(1)).alias("count"), F.count_if(F.col("status") == "error").alias("error_count")]
    for c in RANKED:
        measures += numeric_stats(c, within)
    for c in VALUES:
        measures += numeric_stats(c)
    if "feedback_key" in groups:
        measures += [*numeric_stats("feedback_score", within), *bin_counts(F.col("feedback_score"))]
    out = grouped.groupBy(*columns).agg(*measures).where("count > 0")
    if not within:
        ranked = [*RANKED, *(["feedback_score"] if "feedback_key" in groups else [])]
        keyed = grouped.select(*columns, *[c for c in ranked if c not in names])
        ranks = sorted_percentiles(keyed, names, ranked)
        if names:
            ranks = ranks.withColumnsRenamed({n: f"_r_{n}" for n in names})
            same = F.lit(True)
            for n in names:
                same = same & F.col(n).eqNullSafe(F.col(f"_r_{n}"))
            out = out.join(ranks, same, "left").drop(*[f"_r_{n}" for n in names])
        else:
            out = out.crossJoin(ranks)
    out = out.withColumn("error_rate", F.col("error_count") / F.col("count"))
    if feedback is not None and feedback_keys and "feedback_key" not in groups:
        scores, _ = group_columns(scored(runs, feedback, feedback_keys), groups, bucket)
        each = scores.groupBy(*[F.col(f"_{k}").alias(k) for k in keys], F.col("feedback_key").alias("_key")).agg(*numeric_stats("feedback_score", (50, 95, 99)), *bin_counts(F.col("feedback_score")))
        packed = each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_key", F.struct(*[c for c in each.columns if c not in (*keys, "_key")])))).alias("feedback"))
        out = out.join(packed, keys, "left") if keys else out.crossJoin(packed)
    out = out.select(*names, *[c for c in out.columns if c not in names])
    return out.orderBy(*names) if names else out


def filter_stats(heads: DataFrame) -> DataFrame:
    """Distinct values of the filterable fields in each project, by one pass of explode and distinct count."""
    pairs = F.concat(
        F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in ("run_type", "model_name", "provider_name")]),
        F.transform("tags", lambda t: F.struct(F.lit("tag").alias("f"), t.alias("v"))),
        F.transform("metadata", lambda m: F.struct(F.lit("metadata_key").alias("f"), m["key"].alias("v"))),
    )
    each = heads.select("project_name", F.explode(pairs).alias("p")).where("p.v IS NOT NULL")
    return each.groupBy("project_name", F.col("p.f").alias("field")).agg(F.count_distinct("p.v").alias("distinct_values"))
