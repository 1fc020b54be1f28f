"""Distribution regression on region embeddings.

Rows are regions (thousands at most), columns are embedding positions.  The
embedding is pivoted wide with the position list passed explicitly (so the
pivot needs no extra pass), assembled into an ``ml`` vector and fitted with
``pyspark.ml``: ridge regression with a cross-validated penalty (M7) and a
binomial GLM with probit link weighted by trials (M8).  The spatial smooth
term (M9) is approximated by random Fourier features of the region centroids
with Student-t(3) frequencies (the spectral density of a Matern-3/2 kernel).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regemb.operators.lookup import lookup_join, text
from regemb.session import scratch_path

# FIXED VALUES: feature-name prefixes left out of the regression (place codes)
SKIP_PREFIXES = ["POBP_", "RELP_", "POWPUMA_", "POWSP", "MIGSP_", "MIGPUMA_"]


def prefix_filter(catalogue: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    """Drop catalogue entries whose name starts with any prefix."""
    prefixes = SKIP_PREFIXES if prefixes is None else prefixes
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | F.col("feature_name").startswith(p)
    return catalogue.where(~cond)


def wide(values: DataFrame, positions: list[int], key: str = "region",
         prefix: str = "e") -> DataFrame:
    """Long ``(region, pos, value)`` -> one column per position (absent = 0)."""
    w = values.groupBy(key).pivot("pos", positions).agg(F.first("value"))
    return w.select(key, *[F.coalesce(F.col(str(p)), F.lit(0.0)).alias(f"{prefix}{p}")
                           for p in positions])


def align(df: DataFrame, side: DataFrame, key: str = "region") -> DataFrame:
    """``df`` with the columns of ``side``, one row each; a key that ``side`` lacks
    or repeats raises in the plan."""
    return lookup_join(df, side, [(text(key), text(key))], [c for c in side.columns if c != key],
                       how="strict", what="the side table")


def design_matrix(emb_wide: DataFrame, extra: DataFrame | None = None,
                  key: str = "region") -> DataFrame:
    """M6: embedding columns (++ extra columns such as centroid xyz) as ``features``.

    The result has one row per region; checkpoint it before iterative fits
    (each optimiser step is a job over it).  A region without extra columns
    is an error (J9), raised when the result is computed.
    """
    df = emb_wide if extra is None else align(emb_wide, extra, key)
    cols = [c for c in df.columns if c != key]
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df) \
        .select(key, "features")


def two_party_target(votes: DataFrame) -> DataFrame:
    """``n = D + R`` trials, ``y = D`` successes, ``share = y / n``."""
    return votes.select("region", (F.col("votes_D") + F.col("votes_R")).alias("n"),
                        F.col("votes_D").alias("y")) \
        .withColumn("share", F.col("y") / F.col("n"))


def split(df: DataFrame, key: str = "region", test_fraction: float = 0.1,
          seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """K5: stable hash split of regions (same split on any partitioning)."""
    u = (F.abs(F.xxhash64(F.col(key), F.lit(seed))) % 1_000_000) / 1_000_000.0
    return df.where(u >= test_fraction), df.where(u < test_fraction)


def ridge_cv(train: DataFrame, label: str = "share", reg_params: list[float] | None = None,
             folds: int = 3, weight: str | None = None, seed: int = 0):
    """M7: ridge regression, penalty chosen by k-fold cross validation."""
    reg_params = reg_params or [1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0]
    # L2 only: "auto" takes the exact normal equations where they are allowed (up to
    # 4,096 columns) and L-BFGS on the same objective beyond
    lr = LinearRegression(featuresCol="features", labelCol=label, elasticNetParam=0.0,
                          solver="auto", maxIter=500, tol=1e-9, standardization=False)
    if weight:
        lr.setWeightCol(weight)
    grid = ParamGridBuilder().addGrid(lr.regParam, reg_params).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, numFolds=folds, seed=seed,
                        parallelism=4,
                        evaluator=RegressionEvaluator(labelCol=label, metricName="rmse"))
    return cv.fit(train).bestModel


def probit_binomial(train: DataFrame, label: str = "share", trials: str = "n",
                    reg: float = 1e-3):
    """M8 + O21: binomial GLM with probit link, label y/n weighted by n."""
    glr = GeneralizedLinearRegression(family="binomial", link="probit", featuresCol="features",
                                      labelCol=label, weightCol=trials, regParam=reg,
                                      maxIter=50)
    return glr.fit(train)


def logit_binomial(train: DataFrame, successes: str = "y", trials: str = "n",
                   reg: float = 1e-3, max_iter: int = 200):
    """M8 for any number of columns: binomial regression with logit link.

    The probit fit solves normal equations and so stops at 4,096 columns.  Here
    a region is two weighted rows, its successes and its failures, and the fit
    is L-BFGS, whose state grows linearly with the columns.  ``transform`` gives
    the share in ``probability[1]``.  The model is saved and loaded: a fresh one
    carries its training summary and so the session, which tasks cannot be sent
    once the session has observed a query.
    """
    two = F.array(F.struct(F.lit(1.0).alias("_label"), F.col(successes).cast("double").alias("_w")),
                  F.struct(F.lit(0.0).alias("_label"),
                           (F.col(trials) - F.col(successes)).cast("double").alias("_w")))
    rows = train.select("features", F.inline(two)).where(F.col("_w") > 0)
    model = LogisticRegression(featuresCol="features", labelCol="_label", weightCol="_w",
                               regParam=reg, elasticNetParam=0.0, standardization=False,
                               maxIter=max_iter).fit(rows)
    path = scratch_path(train.sparkSession, "logit")
    model.save(path)
    return LogisticRegressionModel.load(path)


def explained_variance(pred: DataFrame, label: str = "share",
                       prediction: str = "prediction") -> DataFrame:
    """``1 - Var(y - yhat) / Var(y)`` (population variances)."""
    return pred.agg((F.lit(1.0) - F.var_pop(F.col(label) - F.col(prediction))
                     / F.var_pop(F.col(label))).alias("explained_variance"))


def top_coefficients(coefs: DataFrame, n: int = 19) -> DataFrame:
    """K4: the ``n`` coefficients of largest magnitude."""
    return coefs.orderBy(F.desc(F.abs(F.col("coef"))), "feature_name").limit(n)


def matern32_features(xyz: DataFrame, n_freqs: int = 64, length_km: float = 560.0,
                      variance: float = 0.18, seed: int = 0, key: str = "region") -> DataFrame:
    """M9: random features of a Matern-3/2 kernel on ``x, y, z`` (km).

    Frequencies: z / sqrt(u / 3) * sqrt(3) / length with z ~ N(0, I3) and
    u ~ chi2(3) (multivariate t with 3 degrees of freedom).  Features
    ``sqrt(variance / D) * [sin(w.x); cos(w.x)]``.  Approximate; columns
    ``m0..m{2D-1}``.
    """
    rs = np.random.default_rng(seed)
    z = rs.normal(size=(3, n_freqs))
    u = rs.chisquare(3, size=n_freqs)
    w = z / np.sqrt(u / 3.0) * math.sqrt(3.0) / length_km
    scale = math.sqrt(variance / n_freqs)
    cols = []
    for j in range(n_freqs):
        ang = F.col("x") * float(w[0, j]) + F.col("y") * float(w[1, j]) + F.col("z") * float(w[2, j])
        cols.append((F.lit(scale) * F.sin(ang)).alias(f"m{j}"))
    for j in range(n_freqs):
        ang = F.col("x") * float(w[0, j]) + F.col("y") * float(w[1, j]) + F.col("z") * float(w[2, j])
        cols.append((F.lit(scale) * F.cos(ang)).alias(f"m{n_freqs + j}"))
    return xyz.select(key, *cols)


def coefficient_table(model, names: list[str]) -> DataFrame:
    """Coefficients of a fitted linear model with their feature names."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    coefs = [float(c) for c in model.coefficients]
    return spark.createDataFrame(list(zip(names, coefs)), "feature_name string, coef double")


def predict(model, df: DataFrame) -> DataFrame:
    return model.transform(df)


__all__ = ["prefix_filter", "wide", "design_matrix", "two_party_target", "split", "ridge_cv",
           "probit_binomial", "logit_binomial", "explained_variance", "top_coefficients", "matern32_features",
           "coefficient_table", "predict", "Column"]
