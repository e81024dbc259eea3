"""Feature encoder: fit = one row of numeric statistics and a table of categories; encode = that row joined on a constant key
(a one-row broadcast), one equi-join per categorical column, and plain column arithmetic.

Two different statistics are kept on purpose: imputation means ignore nulls, while the
scaler is fitted on nulls filled with 0 (population std, 0 -> 1).  Categories are the
distinct values after null -> "unknown", counted as rows (feature, category, n), so a column of any number of
categories is a table of that many rows and never a value of one row; a value outside them encodes as no hot column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.config import MISSING_WARN_PCT


@dataclass
class Fitted:
    stats: DataFrame  # one row
    categories: DataFrame  # (feature, category, n)


def categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, category, n) of the given columns, null as "unknown"; combined before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("category"),
                               F.col(c).isNotNull().alias("known")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.feature", "p.category").agg(
        F.count("*").alias("n"), F.count_if("p.known").alias("known"))


def fit(df: DataFrame, numeric: list[str], categorical: list[str]) -> Fitted:
    aggs = [F.count("*").alias("num_samples")]
    for c in numeric:
        z = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        aggs += [F.avg(c).alias(f"{c}__mean"),
                 (100.0 * F.count_if(F.col(c).isNull()) / F.count("*")).alias(f"{c}__missing_pct"),
                 F.avg(z).alias(f"{c}__scale_mean"), F.stddev_pop(z).alias(f"{c}__std_raw")]
    aggs += [(100.0 * F.count_if(F.col(c).isNull()) / F.count("*")).alias(f"{c}__missing_pct") for c in categorical]
    out = df.agg(*aggs)
    for c in numeric:
        out = out.withColumn(f"{c}__scale_std", F.when(F.col(f"{c}__std_raw") == 0, F.lit(1.0))
                             .otherwise(F.col(f"{c}__std_raw"))).drop(f"{c}__std_raw")
    cats = categories(df, categorical)
    # the commonest known value of every feature, the first of equal ones
    mode = lambda c: F.min(F.when((F.col("feature") == c) & (F.col("known") > 0), F.struct(-F.col("known"), F.col("category"))))["category"]
    modes = cats.agg(*[F.coalesce(mode(c), F.lit("unknown")).alias(f"{c}__mode") for c in categorical])
    one = lambda d: d.withColumn("_one", F.lit(1))
    return Fitted(one(out).join(F.broadcast(one(modes)), "_one").drop("_one"), cats.select("feature", "category", "n"))


def fit_stats_long(fitted: Fitted, numeric: list[str], categorical: list[str]) -> DataFrame:
    """enc_fit_stats as one row per feature with the > 40 % missing warning."""
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("mean"), F.lit(None).cast("string").alias("mode"),
                     F.col(f"{c}__missing_pct").alias("missing_pct")) for c in numeric]
    rows += [F.struct(F.lit(c).alias("feature"), F.lit(None).cast("double").alias("mean"), F.col(f"{c}__mode").alias("mode"),
                      F.col(f"{c}__missing_pct").alias("missing_pct")) for c in categorical]
    out = fitted.stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumn("warning", F.col("missing_pct") > MISSING_WARN_PCT)


def encode(df: DataFrame, fitted: Fitted, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Adds <c>_standardized per numeric column, imputed_features, and onehot_names: the hot column of every categorical
    column (null where its value was not fitted); a one-hot vector of any length is its hot column's name."""
    j = df.withColumn("_k", F.lit(1)).join(F.broadcast(fitted.stats.withColumn("_k", F.lit(1))), "_k")
    hot = []
    for c in categorical:
        known = fitted.categories.filter(F.col("feature") == c).select(F.col("category").alias(f"_c_{c}"))
        value = F.coalesce(F.col(c).cast("string"), F.col(f"{c}__mode"))
        j = j.join(known, value == F.col(f"_c_{c}"), "left")
        hot.append(F.concat(F.lit(f"{c}_"), F.col(f"_c_{c}")))
    cols = {}
    for c in numeric:
        x = F.coalesce(F.col(c).cast("double"), F.col(f"{c}__mean"))
        cols[f"{c}_standardized"] = (x - F.col(f"{c}__scale_mean")) / F.col(f"{c}__scale_std")
    imputed = F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in numeric + categorical])
    cols["imputed_features"] = F.filter(imputed, lambda x: x.isNotNull())
    cols["onehot_names"] = F.array(*hot)
    return j.withColumns(cols).select(*df.columns, *cols)
