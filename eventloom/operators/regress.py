"""Within-contract pre/post regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def within_regression(df: DataFrame, by: list[str], contract: str, y: str, post: str, w: str) -> DataFrame:
    """Weighted slope of y on post with a fixed effect per contract, one row per group.

    Contract means are unweighted; rows need y, post and a positive weight. No variation in post, or no
    degrees of freedom, gives nulls. Residuals come from a second aggregate, which doesn't cancel.
    """
    ok = df.where(F.col(y).isNotNull() & F.col(post).isNotNull() & (F.col(w) > 0) & F.col(contract).isNotNull())
    in_contract = Window.partitionBy(*by, contract)
    d = ok.select(*by, contract, F.col(post).alias("p"), F.col(y).alias("y"), F.col(w).alias("w"), (F.col(y) - F.avg(y).over(in_contract)).alias("yd"), (F.col(post) - F.avg(post).over(in_contract)).alias("xd"))
    mean = lambda v: F.sum(F.when(F.col("p") == v, F.col("w") * F.col("y"))) / F.nullif(F.sum(F.when(F.col("p") == v, F.col("w"))), F.lit(0.0))
    fit = d.groupBy(*by).agg(
        F.count("*").alias("n_obs"), F.countDistinct(contract).alias("n_contracts"), F.sum(F.expr("w * xd * xd")).alias("denom"), F.sum(F.expr("w * xd * yd")).alias("cross"), mean(0).alias("pre_mean"), mean(1).alias("post_mean")
    ).withColumn("coef", F.when(F.col("denom") > 1e-12, F.col("cross") / F.col("denom")))
    rest = d.join(fit.select(*by, "coef"), by) if by else d.crossJoin(F.broadcast(fit.select("coef")))
    rss = rest.groupBy(*by).agg(F.sum(F.expr("w * pow(yd - coef * xd, 2)")).alias("rss"))
    out = fit.join(rss, by) if by else fit.crossJoin(rss)
    df_ = F.col("n_obs") - F.col("n_contracts") - 1
    out = out.withColumn("se", F.when((df_ > 0) & (F.col("denom") > 1e-12), F.sqrt(F.col("rss") / df_ / F.col("denom"))))
    return out.select(*by, "n_obs", "n_contracts", "coef", "se", F.when(F.col("se") > 0, F.col("coef") / F.col("se")).alias("t_stat"), "pre_mean", "post_mean", (F.col("post_mean") - F.col("pre_mean")).alias("difference"))
