"""Statistics of evaluations: intervals, precision and recall, resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.959963984540054


def wilson(successes: Column, n: Column) -> Column:
    """The 95 % interval of a share, as struct<low, high>; null without trials."""
    p, z2 = successes / n, Z * Z
    centre, spread, scale = p + z2 / (2 * n), Z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n), 1 + z2 / n
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), (centre - spread) / scale).alias("low"), F.least(F.lit(1.0), (centre + spread) / scale).alias("high")))


def precision_recall(found: DataFrame, expected: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """True positives, precision and recall of distinct rows by group; null where there is nothing to divide by."""
    f, e = found.select(*by, *key).distinct(), expected.select(*by, *key).distinct()
    both = f.withColumn("_f", F.lit(1)).join(e.withColumn("_e", F.lit(1)), [*by, *key], "full")
    agg = both.groupBy(*by).agg(F.count("_f").alias("n_found"), F.count("_e").alias("n_expected"), F.count_if(F.col("_f").isNotNull() & F.col("_e").isNotNull()).alias("hits"))
    share = lambda n: F.when(F.col(n) > 0, F.round(F.col("hits") / F.col(n), 6))
    return agg.withColumn("precision", share("n_found")).withColumn("recall", share("n_expected"))


def clustered_bootstrap(rows: DataFrame, cluster: str, value: str, by: str, resamples: int = 2000, seed: int = 11) -> DataFrame:
    """The 95 % interval of a mean when whole clusters are drawn. Only sums by cluster are resampled: one small group for each ``by``."""
    sums = rows.groupBy(by, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(cluster)
        draw = np.random.default_rng(seed).integers(0, len(group), (resamples, len(group)))
        s, n = group["s"].to_numpy(float), group["n"].to_numpy(float)
        means = np.sort(s[draw].sum(axis=1) / np.maximum(1, n[draw].sum(axis=1)))
        low, high = means[int(0.025 * (resamples - 1))], means[int(0.975 * (resamples - 1))]
        return pd.DataFrame({by: [group[by].iloc[0]], "mean": [s.sum() / max(1, n.sum())], "low": [low], "high": [high]})

    return sums.groupBy(by).applyInPandas(run, f"{by} string, mean double, low double, high double")


def ranked_percentile(rows: DataFrame, value: str, by: str, rank: str) -> DataFrame:
    """A percentile by picking a row. ``rank`` is SQL on n (rows of the group) that gives the zero-based place in ascending order."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(value)
    ranked = rows.where(F.col(value).isNotNull()).select(by, value, (F.row_number().over(w) - 1).alias("_k"), F.count("*").over(Window.partitionBy(by)).alias("n"))
    return ranked.where(f"_k = CAST({rank} AS BIGINT)").select(by, F.col(value).alias("value"))
