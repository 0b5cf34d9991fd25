"""Police response against place, time, country and label.

Designs are small (a handful of columns), so every model here reduces the
rows to a few sums on the executors; only those sums reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Equivalence bound of the mean comparison.
EQUIVALENCE_BOUND = 0.184


def grid_month_rate(events: DataFrame, flag: str, step: float = 1.0) -> DataFrame:
    """Events, flagged events and rate per grid cell and month."""
    cells = events.groupBy(
        F.floor(F.col("latitude") / F.lit(step)).cast("int").alias("cell_lat"),
        F.floor(F.col("longitude") / F.lit(step)).cast("int").alias("cell_lon"),
        F.trunc("event_date", "month").alias("month"),
    ).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col(flag)).alias("flagged"))
    return cells.withColumn("rate", F.col("flagged").cast("double") / F.col("events").cast("double"))


def cell_rates(events: DataFrame, flag: str, step: float = 1.0) -> DataFrame:
    """cell_lat, cell_lon, events, flagged, rate of every grid cell with events."""
    y, x = (F.floor(F.col(c) / F.lit(step)).cast("int") for c in ("latitude", "longitude"))
    kept = events.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    cells = kept.groupBy(y.alias("cell_lat"), x.alias("cell_lon")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col(flag)).alias("flagged"))
    return cells.withColumn("rate", F.col("flagged").cast("double") / F.col("events").cast("double"))


def neighbours(cells: DataFrame) -> DataFrame:
    """cell_lat, cell_lon and near_lat, near_lon: the up to eight cells around that exist too.

    Every cell names its eight sides, which meet the cells by an equi-join; the
    pairs are at most eight times the cells.
    """
    sides = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)])
    each = cells.select("cell_lat", "cell_lon", F.inline(sides))
    near = each.select("cell_lat", "cell_lon", (F.col("cell_lat") + F.col("dy")).alias("near_lat"), (F.col("cell_lon") + F.col("dx")).alias("near_lon"))
    return near.join(cells.select(F.col("cell_lat").alias("near_lat"), F.col("cell_lon").alias("near_lon")), ["near_lat", "near_lon"]).select("cell_lat", "cell_lon", "near_lat", "near_lon")


def spatial_lag(cells: DataFrame, value: str = "rate") -> DataFrame:
    """``cells`` with neighbours (their number) and lag: the mean value of the neighbours, null without any."""
    other = cells.select(F.col("cell_lat").alias("near_lat"), F.col("cell_lon").alias("near_lon"), F.col(value).alias("near_value"))
    met = neighbours(cells).join(other, ["near_lat", "near_lon"])
    lag = met.groupBy("cell_lat", "cell_lon").agg(F.count(F.lit(1)).alias("neighbours"), F.avg("near_value").alias("lag"))
    return cells.join(lag, ["cell_lat", "cell_lon"], "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))


def morans_i(cells: DataFrame, value: str = "rate") -> DataFrame:
    """One row: cells, pairs, morans_i, expected and its z score under randomly dealt normal values.

    Neighbours weigh 1 each.  One aggregation over the cells and one over the
    pairs; null where no value varies or no cells touch.
    """
    mean = cells.agg(F.avg(value)).scalar()
    z = cells.select("cell_lat", "cell_lon", (F.col(value) - mean).alias("z"))
    other = z.select(F.col("cell_lat").alias("near_lat"), F.col("cell_lon").alias("near_lon"), F.col("z").alias("near_z"))
    met = neighbours(z).join(z, ["cell_lat", "cell_lon"]).join(other, ["near_lat", "near_lon"])
    degree = met.groupBy("cell_lat", "cell_lon").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("z") * F.col("near_z")).alias("zz"))
    pairs = degree.agg(F.sum("k").alias("pairs"), F.sum("zz").alias("cross"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    both = z.agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("z") * F.col("z")).alias("var")).join(pairs)
    n, w = F.col("cells").cast("double"), F.coalesce("pairs", F.lit(0)).cast("double")
    index = F.try_divide(n * F.col("cross"), w * F.col("var"))
    expected = F.try_divide(F.lit(-1.0), n - 1)
    # S1 is twice the pairs and S2 four times the squared numbers of neighbours, as the weights are 0 and 1
    spread = F.try_divide(n * n * 2 * w - n * 4 * F.col("squares") + 3 * w * w, w * w * (n * n - 1)) - expected * expected
    return both.select(
        "cells", F.coalesce("pairs", F.lit(0).cast("long")).alias("pairs"), index.alias("morans_i"), expected.alias("expected"),
        F.try_divide(index - expected, F.sqrt(spread)).alias("z_score"),
    )


def indicator_columns(column: str, levels: Sequence[str]) -> dict[str, Column]:
    """0/1 columns for all levels but the first, which is the base."""
    return {
        f"{column}={level}": F.coalesce((F.col(column) == level).cast("double"), F.lit(0.0))
        for level in levels[1:]
    }


def fit_binary(df: DataFrame, features: Sequence[str], label: str, link: str = "logit", weight: str | None = None):
    """Binomial regression of a 0/1 label (logit or probit)."""
    ready = VectorAssembler(inputCols=list(features), outputCol="__x").transform(df)
    glm = GeneralizedLinearRegression(
        family="binomial", link=link, featuresCol="__x", labelCol=label,
        predictionCol="probability", linkPredictionCol="linear", maxIter=25,
    )
    if weight:
        glm = glm.setWeightCol(weight)
    return glm.fit(ready), ready


def coefficient_table(spark, features: Sequence[str], model) -> DataFrame:
    """Terms and coefficients; as many rows as the design has columns."""
    rows = [("(intercept)", float(model.intercept))]
    rows += [(f, float(c)) for f, c in zip(features, model.coefficients)]
    return spark.createDataFrame(rows, "term string, coefficient double")


def grouped_counts(df: DataFrame, by: Sequence[str], flag: str) -> DataFrame:
    """Rows per feature combination and outcome.

    Regressions on a few discrete features get the same estimates from these
    weighted rows, and read far fewer of them.
    """
    return df.groupBy(*by, F.col(flag).cast("double").alias("y")).agg(
        F.count(F.lit(1)).cast("double").alias("w")
    )


def two_step_selection(
    df: DataFrame,
    select_features: Sequence[str],
    selected: str,
    outcome_features: Sequence[str],
    outcome: str,
    weight: str | None = None,
):
    """Selection by probit, then the outcome with the inverse Mills ratio.

    The probit's mean is the normal distribution of its linear predictor, so
    the ratio needs no other special function.
    """
    probit, ready = fit_binary(df, select_features, selected, "probit", weight)
    scored = probit.transform(ready)
    density = F.exp(-F.col("linear") * F.col("linear") / 2) / F.lit(math.sqrt(2 * math.pi))
    scored = scored.withColumn("mills_ratio", density / F.col("probability")).drop("__x")
    chosen = scored.where(F.col(selected) == 1)
    columns = [*outcome_features, "mills_ratio"]
    assembled = VectorAssembler(inputCols=columns, outputCol="__z").transform(chosen)
    regression = LinearRegression(featuresCol="__z", labelCol=outcome, solver="normal")
    if weight:
        regression = regression.setWeightCol(weight)
    return probit, regression.fit(assembled), columns


def two_step_errors(
    df: DataFrame,
    select_features: Sequence[str],
    selected: str,
    outcome_features: Sequence[str],
    outcome: str,
    weight: str | None = None,
) -> list[tuple[str, float, float]]:
    """Outcome terms of ``two_step_selection`` with standard errors that know the ratio was estimated.

    The moments of both steps are stacked; their sandwich covers any variance
    of the outcome and the noise of the first step.  Each task adds up the
    cross products of its rows; only sums of the size of the design squared
    leave it.  A weight counts equal rows.
    """
    probit, regression, columns = two_step_selection(df, select_features, selected, outcome_features, outcome, weight)
    names = ["(intercept)", *columns]
    gamma = np.array([probit.intercept, *probit.coefficients])
    beta = np.array([regression.intercept, *regression.coefficients])
    a, k = len(gamma), len(gamma) + len(beta)
    inputs = [*select_features, *outcome_features]
    ready = df.select(
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(inputs)], F.col(selected).cast("double").alias("d"),
        F.coalesce(F.col(outcome).cast("double"), F.lit(0.0)).alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
    )
    first = len(select_features)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, middle = np.zeros((k, k)), np.zeros((k, k))
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy() for i in range(len(inputs))], axis=1) if inputs else np.zeros((len(batch), 0))
            d, y, w = (batch.column(c).to_numpy() for c in ("d", "y", "w"))
            z = np.column_stack([np.ones(len(d)), x[:, :first]])
            linear = z @ gamma
            density = np.exp(-linear * linear / 2) / math.sqrt(2 * math.pi)
            below = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in linear])
            above = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in linear])
            ratio = density / below
            turn = ratio * (ratio + linear)
            v = np.column_stack([np.ones(len(d)), x[:, first:], ratio])
            u = d * (y - v @ beta)
            g = np.column_stack([(d * ratio - (1 - d) * density / above)[:, None] * z, u[:, None] * v])
            middle += (w[:, None] * g).T @ g
            slope[:a, :a] += (w * density * density / (below * above))[:, None].T * z.T @ z
            slope[a:, a:] += (w * d * v.T) @ v
            slope[a:, :a] -= beta[-1] * ((w * d * turn) * v.T) @ z
            slope[-1, :a] += (w * u * turn) @ z
        flat = np.concatenate([slope.ravel(), middle.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "value"])

    sums = ready.mapInArrow(summed, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    flat = np.zeros(2 * k * k)
    flat[sums["at"].to_numpy()] = sums["value"].to_numpy()
    slope, middle = flat[: k * k].reshape(k, k), flat[k * k :].reshape(k, k)
    back = np.linalg.inv(slope)
    spread = np.sqrt(np.diag(back @ middle @ back.T))
    return [(n, float(b), float(e)) for n, b, e in zip(names, beta, spread[a:])]


def clustered_errors(
    df: DataFrame, features: Sequence[str], label: str, cluster: str, model, weight: str | None = None
) -> list[tuple[str, float, float]]:
    """Coefficients of a logit with cluster-robust standard errors.

    Scores are added up per cluster and then multiplied into the k x k middle
    matrix on the executors; the driver inverts one k x k matrix.
    """
    names = ["(intercept)", *features]
    beta = [float(model.intercept), *[float(c) for c in model.coefficients]]
    k = len(names)
    terms = [F.lit(1.0), *[F.col(f) for f in features]]
    linear = F.lit(0.0)
    for b, x in zip(beta, terms):
        linear = linear + F.lit(b) * x
    base = df.select(
        F.col(cluster).alias("g"),
        F.col(label).cast("double").alias("y"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-linear))).alias("p"),
        (F.col(weight) if weight else F.lit(1.0)).alias("w"),
        *[x.alias(f"x{i}") for i, x in enumerate(terms)],
    )
    spread = F.col("w") * F.col("p") * (F.lit(1.0) - F.col("p"))
    residual = F.col("w") * (F.col("y") - F.col("p"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    per_cluster = base.groupBy("g").agg(
        *[F.sum(residual * F.col(f"x{i}")).alias(f"s{i}") for i in range(k)],
        *[F.sum(spread * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i, j in pairs],
    )
    row = per_cluster.agg(
        F.count(F.lit(1)).alias("clusters"),
        *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in pairs],
        *[F.sum(f"h{i}_{j}").alias(f"h{i}_{j}") for i, j in pairs],
    ).first()
    middle, hessian = np.zeros((k, k)), np.zeros((k, k))
    for i, j in pairs:
        middle[i, j] = middle[j, i] = row[f"m{i}_{j}"]
        hessian[i, j] = hessian[j, i] = row[f"h{i}_{j}"]
    bread = np.linalg.inv(hessian)
    g = row["clusters"]
    correction = g / (g - 1) if g > 1 else 1.0
    covariance = correction * bread @ middle @ bread
    return [(n, b, float(math.sqrt(covariance[i, i]))) for i, (n, b) in enumerate(zip(names, beta))]


def mean_equivalence(
    df: DataFrame, value: Column, group: str, first: str, second: str, bound: float = EQUIVALENCE_BOUND
) -> DataFrame:
    """Two one-sided tests: difference of means against -bound and +bound."""
    x = value.cast("double")
    one, two = F.col(group) == first, F.col(group) == second
    row = df.agg(
        F.count_if(one).alias("n1"),
        F.count_if(two).alias("n2"),
        F.avg(F.when(one, x)).alias("mean1"),
        F.avg(F.when(two, x)).alias("mean2"),
        F.var_samp(F.when(one, x)).alias("v1"),
        F.var_samp(F.when(two, x)).alias("v2"),
    )
    error = F.sqrt(
        F.try_divide(F.col("v1"), F.col("n1").cast("double"))
        + F.try_divide(F.col("v2"), F.col("n2").cast("double"))
    )
    out = row.withColumns({"difference": F.col("mean1") - F.col("mean2"), "error": error})
    return out.select(
        "n1",
        "n2",
        "difference",
        "error",
        F.try_divide(F.col("difference") + F.lit(bound), F.col("error")).alias("t_lower"),
        F.try_divide(F.col("difference") - F.lit(bound), F.col("error")).alias("t_upper"),
    )
