"""Rates with numerators, denominators and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions import rules
from tracewell.operators.grouping import level_rank


def rate(k: Column, n: Column, state: Column) -> Column:
    """k / n where it was measured, else null."""
    return F.when((state == "OK") & (n > 0), k / n)


def dominant_state(state: Column) -> Column:
    """Aggregate: OK if any row is, else the empty state that says most."""
    place = F.coalesce(*[F.when(state == s, F.lit(i)) for i, s in enumerate(("OK", *rules.EMPTY_STATES))])
    return F.element_at(F.array(*map(F.lit, ("OK", *rules.EMPTY_STATES))), F.min(place) + 1)


def thresholds(observations: DataFrame, by, min_level: str = "medium", attack_only: bool = True) -> DataFrame:
    """k, n, rate, state by stratum: cells at min_level or above among measured ones. Controls (no record) only count with attack_only=False."""
    inside = F.col("record_uid").isNotNull() if attack_only else F.lit(True)
    measured = inside & (F.col("state") == "OK")
    at = _reaches(min_level)
    out = observations.groupBy(*by).agg(F.count_if(measured & at).alias("k"), F.count_if(measured).alias("n"), dominant_state(F.col("state")).alias("any_state"), F.count_if(F.col("state") != "OK").alias("excluded"))
    state = F.when(F.col("n") > 0, "OK").when(F.col("any_state") == "OK", "N/A").otherwise(F.col("any_state"))
    return out.withColumn("state", state).withColumn("rate", rate(F.col("k"), F.col("n"), F.col("state"))).drop("any_state")


def strata(observations: DataFrame, key: str, min_level: str = "medium") -> DataFrame:
    """thresholds() of all strata and overall, in one pass."""
    measured = F.col("record_uid").isNotNull() & (F.col("state") == "OK")
    at = _reaches(min_level)
    return observations.rollup(key).agg(F.count_if(measured & at).alias("k"), F.count_if(measured).alias("n"), F.grouping(key).cast("int").alias("overall"))


def both_populations(observations: DataFrame, min_level: str = "medium") -> DataFrame:
    """One row, one pass: k and n over all cells and over attack cells, the controls among n, and whether k is the same."""
    attack, ok = F.col("record_uid").isNotNull(), F.col("state") == "OK"
    hit = ok & _reaches(min_level)
    out = observations.agg(F.count_if(hit).alias("k_all"), F.count_if(ok).alias("n_all"), F.count_if(hit & attack).alias("k_attack"), F.count_if(ok & attack).alias("n_attack"))
    return out.withColumns({"controls_in_denominator": F.col("n_all") - F.col("n_attack"), "numerator_unchanged": F.col("k_all") == F.col("k_attack")})


def _reaches(min_level: str) -> Column:
    return F.coalesce(level_rank(F.col("level")), F.lit(0)) >= rules.LEVELS.index(min_level) + 1


#: matrices with their denominators
HEATMAPS = (("coverage", "all_valid"), ("detection", "observed"), ("detection", "all_valid"))


def heatmap(observations: DataFrame, min_level: str = "medium", attack_only: bool = True) -> DataFrame:
    """matrix, row, column, denominator_kind, min_level, k, n, rate, state: every pipeline for each placement of an attack cell.

    coverage: cells in which the pipeline saw the payload, of all measured ones. detection: cells with a finding at
    min_level or above that this pipeline carries and saw, of those it saw (observed), or that it carries, of all measured ones (all_valid).
    A row's state is OK if it has a measured cell, else its empty state that says most; a rate without a denominator is null.
    """
    attack, ok = F.col("record_uid").isNotNull(), F.col("state") == "OK"
    valid = ok & attack if attack_only else ok
    at, pipes = _reaches(min_level), rules.PIPELINES
    # one pass: pipelines are columns until the counts are made
    sums = [F.max(attack).alias("has_attack"), F.count_if(valid).alias("valid"), dominant_state(F.col("state")).alias("any_state")]
    for k, p in enumerate(pipes):
        seen, carried = valid & F.array_contains("pipelines", p), at & F.array_contains("attributed_pipelines", p)
        sums += [F.count_if(seen).alias(f"s{k}"), F.count_if(seen & carried).alias(f"d{k}"), F.count_if(valid & carried).alias(f"a{k}")]
    cells = []
    for k, p in enumerate(pipes):
        for n, (matrix, kind) in enumerate(HEATMAPS):
            up, down = ((f"s{k}", "valid"), (f"d{k}", f"s{k}"), (f"a{k}", "valid"))[n]
            cells.append(F.struct(F.lit(matrix).alias("matrix"), F.lit(p).alias("column"), F.lit(kind).alias("denominator_kind"), F.col(up).alias("k"), F.col(down).alias("n")))
    rows = observations.filter("placement_id IS NOT NULL").groupBy("placement_id").agg(*sums).filter("has_attack")
    state = F.when(F.col("valid") > 0, "OK").when(F.col("any_state") == "OK", "N/A").otherwise(F.col("any_state"))
    out = rows.select(F.col("placement_id").alias("row"), state.alias("row_state"), F.explode(F.array(*cells)).alias("c")).select("c.matrix", "row", "c.column", "c.denominator_kind", F.lit(min_level).alias("min_level"), "c.k", "c.n", "row_state")
    out = out.withColumn("state", F.when((F.col("row_state") == "OK") & (F.col("n") == 0), "N/A").otherwise(F.col("row_state"))).drop("row_state")
    return out.withColumn("rate", rate(F.col("k"), F.col("n"), F.col("state")))


HEATMAP_HEADER = "matrix,row,column,denominator_kind,min_level,k,n,rate,state"


def heatmap_lines(rows: DataFrame) -> DataFrame:
    """Each row of a heat map as a CSV line in the order of HEATMAP_HEADER; rates with six decimals."""
    shown = F.when(F.col("rate").isNull(), "").otherwise(F.format_string("%.6f", F.col("rate")))
    parts = [shown if c == "rate" else F.col(c).cast("string") for c in HEATMAP_HEADER.split(",")]
    return rows.select(F.concat_ws(",", *parts).alias("line"))


def pipeline_totals(rows: DataFrame) -> DataFrame:
    """k and n of a heat map's rows summed by matrix, denominator and pipeline, with their rate."""
    out = rows.groupBy("matrix", "denominator_kind", "column").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    return out.withColumn("rate", F.when(F.col("n") > 0, F.col("k") / F.col("n")))


def transform_coverage(observations: DataFrame, pipeline: str = "http-source") -> DataFrame:
    """Measured attack cells by transform, and those whose payload the pipeline saw."""
    valid = F.col("record_uid").isNotNull() & (F.col("state") == "OK")
    return observations.groupBy("transform_id").agg(F.count_if(valid & F.array_contains("pipelines", pipeline)).alias("k"), F.count_if(valid).alias("n"))


def marginals(observations: DataFrame) -> DataFrame:
    """Level distribution of measured attack cells, null levels too."""
    return observations.filter("record_uid IS NOT NULL AND state = 'OK'").groupBy("level").agg(F.count(F.lit(1)).alias("cells"))


def pipeline_coverage(observations: DataFrame) -> DataFrame:
    """Measured attack cells that each pipeline saw."""
    valid = F.col("record_uid").isNotNull() & (F.col("state") == "OK")
    sums = observations.agg(F.count_if(valid).alias("n"), *[F.count_if(valid & F.array_contains("pipelines", p)).alias(f"k{i}") for i, p in enumerate(rules.PIPELINES)])
    return sums.select("n", F.explode(F.array(*[F.struct(F.lit(p).alias("pipeline"), F.col(f"k{i}").alias("k")) for i, p in enumerate(rules.PIPELINES)])).alias("x")).select("x.pipeline", "x.k", "n")


def ordered_values(observations: DataFrame, field: str, order: tuple[str, ...] = ()) -> DataFrame:
    """value, place: the distinct values of attack cells, those of a known order first, the others by name."""
    values = observations.filter(F.col("record_uid").isNotNull() & F.col(field).isNotNull()).select(F.col(field).alias("value")).distinct()
    known = F.array_position(F.array(*map(F.lit, order)), F.col("value")) if order else F.lit(0)
    rank = F.when(known > 0, known).otherwise(len(order) + 1)
    # a row for each value of a fixed vocabulary
    return values.withColumn("place", F.row_number().over(W.orderBy(rank, "value")))


def state_counts(observations: DataFrame) -> DataFrame:
    return observations.agg(*[F.count_if(F.col("state") == s).alias(s.replace("/", "_").lower()) for s in ("OK", *rules.EMPTY_STATES)])


def observation_violations(observations: DataFrame) -> DataFrame:
    """cell_id and the first invariant that each bad row breaks: a cell without an id, an unknown state, level or pipeline, a level or attribution without a measurement."""
    state, level = F.col("state"), F.col("level")
    strange = lambda c: F.size(F.array_except(F.coalesce(F.col(c), F.array().cast("array<string>")), F.array(*map(F.lit, rules.PIPELINES)))) > 0
    rule = (
        F.when(F.coalesce(F.col("cell_id"), F.lit("")) == "", "cell-id-missing")
        .when(~F.coalesce(state.isin("OK", *rules.EMPTY_STATES), F.lit(False)), "unknown-state")
        .when(level.isNotNull() & ~level.isin(*rules.LEVELS), "unknown-level")
        .when((state != "OK") & level.isNotNull(), "level-without-measurement")
        .when(strange("pipelines") | strange("attributed_pipelines"), "unknown-pipeline")
        .when((state != "OK") & (F.size("attributed_pipelines") > 0), "attribution-without-measurement")
    )
    return observations.select("cell_id", rule.alias("violation")).filter("violation IS NOT NULL")


def merge_checks(checks: DataFrame) -> DataFrame:
    """A check over several runs: it fails if it fails in one; the first failure's detail stays. checks: case_id, key, run_ord, status, detail."""
    order = F.struct((F.col("status") != "fail").cast("int"), F.col("run_ord"))
    return checks.groupBy("case_id", "key").agg(F.when(F.bool_or(F.col("status") == "fail"), "fail").when(F.bool_or(F.col("status") == "pass"), "pass").otherwise("skipped").alias("status"), F.min_by("detail", order).alias("detail"), F.count(F.lit(1)).alias("runs"))


def run_summary(cases: DataFrame) -> DataFrame:
    counts = {s: F.count_if(F.col("status") == s).alias(s) for s in ("pass", "fail", "skipped", "error")}
    out = cases.agg(*counts.values())
    return out.withColumn("exit_code", F.when((F.col("fail") + F.col("error")) > 0, 1).otherwise(0))
