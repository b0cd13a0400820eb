"""Per-series forecasts with quantiles, as table operations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from devicehealth.functions.numeric import total
from devicehealth.operators.ordering import ordered_position
from devicehealth.operators.quantiles import quantiles


def align(forecast: DataFrame, truth: DataFrame, key: str, time: str) -> DataFrame:
    """Forecast rows next to the observed value of the same series and time."""
    return forecast.join(truth, [key, time])


def with_future(history: DataFrame, future: DataFrame) -> DataFrame:
    """History and future rows in one frame; columns the future lacks are NULL there."""
    past = history.withColumn("is_future", F.lit(False))
    return past.unionByName(future.withColumn("is_future", F.lit(True)), allowMissingColumns=True)


def known_covariates(history: DataFrame, future: DataFrame, ids: Sequence[str]) -> list[str]:
    """Columns both frames share besides the ids: known into the future."""
    return [c for c in history.columns if c in future.columns and c not in ids]


def regular_grid(df: DataFrame, key: str, time: str, target: str, unit: str = "hour", agg=F.avg) -> DataFrame:
    """One row per series and period between its first and last; empty periods hold NULL."""
    period = F.date_trunc(unit, F.col(time)).cast("timestamp_ntz")
    seen = df.groupBy(key, period.alias(time)).agg(agg(target).alias(target))
    spans = seen.groupBy(key).agg(F.min(time).alias("_from"), F.max(time).alias("_to"))
    grid = spans.select(key, F.explode(F.sequence("_from", "_to", F.expr(f"interval 1 {unit}"))).alias(time))
    return grid.join(seen, [key, time], "left")


def seasonal_forecast(df: DataFrame, key: str, time: str, target: str, horizon: int, quantile_levels: Sequence[float] = (0.1, 0.5, 0.9),
                      season: int = 7, unit: str = "day", target_name: str | None = None) -> DataFrame:
    """Repeat the last season; quantiles add the series' own one-season-back errors.

    ``df`` is a regular grid. The lagged value comes from a join on (series, time), so a long series
    spreads over tasks instead of being sorted in one. Missing history counts as zero.
    """
    step = f"interval {season} {unit}"
    series = df.select(key, time, F.coalesce(target, F.lit(0.0)).alias("_y"))
    lagged = series.select(key, (F.col(time) + F.expr(step)).alias(time), F.col("_y").alias("_back"))
    errors = series.join(lagged, [key, time]).select(key, (F.col("_y") - F.col("_back")).alias("error"))
    spread = quantiles(errors, ["error"], quantile_levels, by=[key])
    levels = spread.groupBy(key).agg(*[
        F.max(F.when(F.col("prob") == float(q), F.col("value"))).alias(f"_e{i}") for i, q in enumerate(quantile_levels)])

    ends = series.groupBy(key).agg(F.max(time).alias("_end"))
    steps = ends.select(key, "_end", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_h"))
    back = ((F.col("_h") - 1) % season) + 1 - season
    wanted = steps.select(
        key, (F.col("_end") + F.col("_h") * F.expr(f"interval 1 {unit}")).alias(time),
        (F.col("_end") + back * F.expr(f"interval 1 {unit}")).alias("_source"))
    source = series.withColumnsRenamed({time: "_source", "_y": "predictions"})
    found = wanted.join(source, [key, "_source"], "left").withColumn("predictions", F.coalesce("predictions", F.lit(0.0)))
    return found.join(levels, key, "left").select(
        key, time, F.lit(target_name or target).alias("target_name"), "predictions",
        *[(F.col("predictions") + F.coalesce(F.col(f"_e{i}"), F.lit(0.0))).alias(str(q)) for i, q in enumerate(quantile_levels)])


def several_targets(df: DataFrame, key: str, time: str, targets: Sequence[str], horizon: int, **options) -> DataFrame:
    """Forecast several target columns of the same series in one plan."""
    long = df.select(key, time, *[F.col(t).cast("double").alias(t) for t in targets]).unpivot([key, time], list(targets), "_name", "_value")
    tagged = long.withColumn("_series", F.struct(F.col(key), F.col("_name")))
    out = seasonal_forecast(tagged, "_series", time, "_value", horizon, **options)
    rest = [f"`{c}`" for c in out.columns if c not in ("_series", "target_name")]
    return out.select(F.col(f"_series.{key}").alias(key), F.col("_series._name").alias("target_name"), *rest)


def as_arrays(df: DataFrame, key: str, time: str, target: str, covariates: Sequence[str] = (), points: int = 10_000) -> DataFrame:
    """Array form: ``(key, chunk, times, target, past_covariates)``, values in time order.

    The chunks of a series in order are its whole history; ``points`` bounds one array, however long
    the series.
    """
    placed = ordered_position(df.withColumn("_at", F.col(time).cast("timestamp").cast("double")), "_at", [key], [target])
    chunk = F.floor((F.col("position") - 1) / points).cast("int").alias("chunk")
    gathered = F.array_sort(F.collect_list(F.struct(time, target, *covariates)))
    packed = placed.groupBy(key, chunk).agg(gathered.alias("_p"))

    def array_of(column):
        return F.transform("_p", lambda p: p[column].cast("double"))

    arrays = [array_of(c) for c in covariates]
    covered = F.map_from_arrays(F.array(*[F.lit(c) for c in covariates]), F.array(*arrays)).alias("past_covariates")
    return packed.select(key, "chunk", F.transform("_p", lambda p: p[time]).alias("times"),
                         array_of(target).alias("target"), *([covered] if covariates else []))


def from_arrays(df: DataFrame, key: str, target: str = "target") -> DataFrame:
    """Array form back to one row per point with its 0-based step inside the chunk."""
    return df.select(key, "chunk", F.posexplode(target).alias("step", target))


def score_forecast(forecast: DataFrame, truth: DataFrame, key: str, time: str, target: str, low: str = "0.1", high: str = "0.9") -> DataFrame:
    """Mean absolute and squared error and how often the truth fell between the outer quantiles."""
    both = align(forecast, truth, key, time)
    error = F.col("predictions") - F.col(target)
    inside = F.col(target).between(F.col(f"`{low}`"), F.col(f"`{high}`"))
    return both.agg(F.count("*").alias("points"), F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"),
                    F.avg(inside.cast("double")).alias("coverage"))


def _solve(terms: int, ridge: float):
    """Pandas UDF: coefficients from the upper triangle of X'X and from X'y, one series per row."""
    upper = np.triu_indices(terms)

    @F.pandas_udf("array<double>")
    def solve(products: pd.Series, targets: pd.Series) -> pd.Series:
        out = []
        for flat, right in zip(products, targets):
            square = np.zeros((terms, terms))
            square[upper] = flat
            square = square + np.triu(square, 1).T
            # The intercept is not shrunk.
            square[np.arange(1, terms), np.arange(1, terms)] += ridge
            out.append(np.linalg.lstsq(square, np.asarray(right, float), rcond=None)[0])
        return pd.Series(out)

    return solve


def ridge_forecast(history: DataFrame, future: DataFrame, key: str, time: str, target: str, covariates: Sequence[str],
                   quantile_levels: Sequence[float] = (0.1, 0.5, 0.9), ridge: float = 1.0) -> DataFrame:
    """Per-series ridge regression on trend and covariates; quantiles add the series' own residuals.

    The sums a regression needs are plain aggregates, combined before the shuffle, so a series of any
    length costs its task one small matrix. Without covariates it is a trend forecast.
    """
    origin = history.agg(F.min(time)).first()[0]
    days = (F.col(time).cast("timestamp").cast("double") - F.lit(origin).cast("timestamp").cast("double")) / 86400.0
    terms = [F.lit(1.0), F.col("_trend"), *[F.col(c).cast("double") for c in covariates]]
    upper = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    past = history.withColumn("_trend", days).na.drop(subset=[target, *covariates])
    sums = past.groupBy(key).agg(F.array(*[F.sum(terms[i] * terms[j]) for i, j in upper]).alias("_xx"),
                                 F.array(*[F.sum(t * F.col(target)) for t in terms]).alias("_xy"))
    fitted = sums.select(key, _solve(len(terms), ridge)("_xx", "_xy").alias("_beta"))
    estimate = total([F.col("_beta")[i] * t for i, t in enumerate(terms)])
    errors = past.join(fitted, key).select(key, (F.col(target) - estimate).alias("error"))
    spread = quantiles(errors, ["error"], quantile_levels, by=[key]).groupBy(key).agg(*[
        F.max(F.when(F.col("prob") == float(q), F.col("value"))).alias(f"_e{i}") for i, q in enumerate(quantile_levels)])
    predicted = future.withColumn("_trend", days).join(fitted, key).join(spread, key).withColumn("predictions", estimate)
    return predicted.select(key, time, F.lit(target).alias("target_name"), "predictions", *[
        (F.col("predictions") + F.col(f"_e{i}")).alias(str(q)) for i, q in enumerate(quantile_levels)])


def one_hot(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """0/1 columns for all but the first category, as covariates of a regression."""
    return df.withColumns({f"{column}_{c}": (F.col(column) == c).cast("double") for c in list(categories)[1:]})


def categories_of(df: DataFrame, column: str) -> list[str]:
    """Distinct categories in name order: a short list, fetched as model parameters."""
    return [r[0] for r in df.where(F.col(column).isNotNull()).groupBy(column).agg(F.lit(1)).orderBy(column).select(column).collect()]


def lag_frame(df: DataFrame, key: str, time: str, target: str, lags: Sequence[int], unit: str = "day",
              covariates: Sequence[str] = ()) -> DataFrame:
    """Rows with ``lag_k`` columns, including future rows whose target is still unknown.

    Every point is sent to the rows it is a lag of and one pivot on (series, time) collects them, so a
    long series is never ordered in one task. With every lag at least the horizon, a row needs no
    earlier prediction.
    """
    shifts = [0, *lags]
    names = {0: target, **{k: f"lag_{k}" for k in lags}}
    sent = df.select(key, time, F.col(target).cast("double").alias("_y"), F.explode(F.array(*[F.lit(k) for k in shifts])).alias("_k"))
    placed = sent.select(key, (F.col(time) + F.col("_k") * F.expr(f"interval 1 {unit}")).alias(time), "_k", "_y")
    wide = placed.groupBy(key, time).agg(*[F.max(F.when(F.col("_k") == k, F.col("_y"))).alias(names[k]) for k in shifts])
    return wide.join(df.select(key, time, *covariates), [key, time], "left") if covariates else wide


def fit_pooled(lagged: DataFrame, target: str, features: Sequence[str], ridge: float = 0.1) -> PipelineModel:
    """One regression over the lags of all series: every series learns from the others."""
    train = lagged.na.drop(subset=[target, *features])
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep"),
                            LinearRegression(featuresCol="_features", labelCol=target, predictionCol="predictions", regParam=ridge,
                                             elasticNetParam=0.0)]).fit(train)


def predict_pooled(model: PipelineModel, lagged: DataFrame, key: str, time: str, target: str,
                   quantile_levels: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Forecast the rows of a lag frame whose target is unknown, with quantiles of each series' residuals."""
    scored = model.transform(lagged)
    errors = scored.where(F.col(target).isNotNull()).select(key, (F.col(target) - F.col("predictions")).alias("error"))
    spread = quantiles(errors, ["error"], quantile_levels, by=[key]).groupBy(key).agg(*[
        F.max(F.when(F.col("prob") == float(q), F.col("value"))).alias(f"_e{i}") for i, q in enumerate(quantile_levels)])
    ahead = scored.where(F.col(target).isNull()).join(spread, key, "left")
    return ahead.select(key, time, F.lit(target).alias("target_name"), "predictions", *[
        (F.col("predictions") + F.coalesce(F.col(f"_e{i}"), F.lit(0.0))).alias(str(q)) for i, q in enumerate(quantile_levels)])
