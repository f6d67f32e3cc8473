"""Two-group tests on a long (metric, group, value) frame.

Each test is aggregation over the detail rows (partial + final, shuffle of
one small buffer per task and key) followed by closed-form arithmetic on the
aggregated rows.  p-values are Column expressions on those result rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlytics.functions.pvalues import p_value_col
from cartlytics.plans.ordered import attach, exact_quantiles, ranked_values
from cartlytics.session import materialise


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def group_stats(long: DataFrame, value: str = "value") -> DataFrame:
    """Per (metric, group): n, mean, sample variance, population skewness and
    excess kurtosis in ONE aggregation (partial + final); the t-tests and the
    normality test read the same aggregate, so Spark computes it once."""
    return long.where(F.col(value).isNotNull()).groupBy("metric", "group").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"),
        F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"))


def group_moments(long: DataFrame, a=0, b=1, value: str = "value") -> DataFrame:
    """Per metric: n, mean, sample variance of groups a and b (pivot of the two
    :func:`group_stats` rows of each metric)."""
    g = group_stats(long, value)
    aggs = []
    for tag, grp in (("a", a), ("b", b)):
        sel = F.col("group") == grp
        aggs += [F.coalesce(F.max(F.when(sel, F.col("n"))), F.lit(0)).alias(f"n_{tag}"),
                 F.max(F.when(sel, F.col("mean"))).alias(f"mean_{tag}"),
                 F.max(F.when(sel, F.col("var"))).alias(f"var_{tag}")]
    return g.groupBy("metric").agg(*aggs)


def t_test(long: DataFrame, equal_var: bool = True, a=0, b=1, with_p: bool = True,
           value: str = "value", alpha: float = 0.05) -> DataFrame:
    """X10 (pooled, equal_var=True) / X11 (Welch): t of a minus b and its df."""
    m = group_moments(long, a, b, value)
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    va, vb = F.col("var_a"), F.col("var_b")
    diff = F.col("mean_a") - F.col("mean_b")
    if equal_var:
        dof = na + nb - 2.0
        sp2 = ((na - 1.0) * va + (nb - 1.0) * vb) / dof
        t = F.try_divide(diff, F.sqrt(sp2 * (1.0 / na + 1.0 / nb)))
    else:
        sa, sb = va / na, vb / nb
        t = F.try_divide(diff, F.sqrt(sa + sb))
        dof = F.try_divide((sa + sb) * (sa + sb), sa * sa / (na - 1.0) + sb * sb / (nb - 1.0))
    out = m.select("metric", "n_a", "n_b", "mean_a", "mean_b", t.alias("t"), dof.alias("df"))
    if with_p:
        out = out.withColumn("p_value", p_value_col("t", "t", "df")).withColumn("differ", F.col("p_value") < alpha)
    return out


def normality(long: DataFrame, alpha: float = 0.05, with_p: bool = True,
              value: str = "value") -> DataFrame:
    """D'Agostino-Pearson K^2 per (metric, group) from population skewness
    and excess kurtosis (one aggregation); p = exp(-K^2 / 2) is closed form.
    Groups with fewer than 8 values get NULL statistics (the skewness test is
    not defined there)."""
    s = group_stats(long, value)
    ok = F.col("n") >= 8
    out = s.select("metric", "group", "n", "skew", "kurt",
                   *[F.when(ok, c).alias(c_name) for c, c_name in zip(
                       dagostino_columns(F.col("n").cast("double"), F.col("skew"), F.col("kurt")),
                       ["z_skew", "z_kurt", "k2"])])
    out = out.withColumn("p_value", F.exp(-F.col("k2") / 2.0))
    return out.withColumn("normal", F.col("p_value") > alpha) if with_p else out


def dagostino_columns(n: Column, g1: Column, excess_kurt: Column) -> list[Column]:
    """Z of the skewness test, Z of the kurtosis test and K^2 = Z1^2 + Z2^2."""
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1.0 + F.sqrt(2.0 * (beta2 - 1.0))
    z1 = F.try_divide(F.asinh(F.try_divide(y, F.sqrt(2.0 / (w2 - 1.0)))), F.sqrt(0.5 * F.ln(w2)))
    b2 = excess_kurt + 3.0
    e = 3.0 * (n - 1) / (n + 1)
    varb2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - e) / F.sqrt(varb2)
    sb1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + F.sqrt(1.0 + 4.0 / (sb1 * sb1)))
    d = 1.0 + x * F.sqrt(2.0 / (a - 4.0))
    t2 = F.signum(d) * F.cbrt(F.try_divide(1.0 - 2.0 / a, F.abs(d)))
    z2 = (1.0 - 2.0 / (9.0 * a) - t2) / F.sqrt(2.0 / (9.0 * a))
    return [z1.alias("z_skew"), z2.alias("z_kurt"), (z1 * z1 + z2 * z2).alias("k2")]


def levene(long: DataFrame, alpha: float = 0.05, with_p: bool = True, value: str = "value",
           n_buckets: int | None = None) -> DataFrame:
    """Levene / Brown-Forsythe W with centre = group median.

    Medians come from the exact ordered-quantile plan (no group gathered in one
    task); |x - median| moments per group are one more aggregation.
    """
    data = long.where(F.col(value).isNotNull())
    med = exact_quantiles(data, value, [0.5], keys=["metric", "group"], n_buckets=n_buckets) \
        .select("metric", "group", F.col("quantile").alias("_med"))
    z = attach(data, med, ["metric", "group"]).withColumn("_z", F.abs(F.col(value) - F.col("_med")))
    g = z.groupBy("metric", "group").agg(
        F.count("_z").alias("_n"), F.avg("_z").alias("_zbar"),
        (F.coalesce(F.var_samp("_z"), F.lit(0.0)) * (F.count("_z") - 1)).alias("_ss"))
    w = Window.partitionBy("metric")
    g = g.withColumn("_zall", F.sum(F.col("_n") * F.col("_zbar")).over(w) / F.sum("_n").over(w))
    out = g.groupBy("metric").agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("_n") * (F.col("_zbar") - F.col("_zall")) * (F.col("_zbar") - F.col("_zall"))).alias("_between"),
        F.sum("_ss").alias("_within"))
    out = out.select("metric", "n", "k",
                     F.try_divide((F.col("n") - F.col("k")) * F.col("_between"),
                                  (F.col("k") - 1) * F.col("_within")).alias("w"),
                     (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"))
    if with_p:
        out = out.withColumn("p_value", p_value_col("f", "w", "df1", "df2")) \
                 .withColumn("equal_var", F.col("p_value") > alpha)
    return out


def mann_whitney(long: DataFrame, a=0, b=1, with_p: bool = True, value: str = "value",
                 n_buckets: int | None = None, alpha: float = 0.05) -> DataFrame:
    """U of group a, two-sided, tie-corrected normal approximation with
    continuity correction.  Average ranks come from the prefix counts
    over distinct values: rank = before + (t + 1) / 2."""
    data = long.where(F.col("group").isin(a, b))
    r = ranked_values(data, value, keys=["metric"], n_buckets=n_buckets,
                      counts={"_ca": F.col("group") == a, "_cb": F.col("group") == b})
    t = F.col("n").cast("double")
    rank = F.col("before") + (t + 1.0) / 2.0
    s = r.rows.groupBy("metric").agg(
        F.sum(F.col("_ca") * rank).alias("_ra"), F.sum("_ca").alias("n_a"), F.sum("_cb").alias("n_b"),
        F.sum(t * t * t - t).alias("_ties"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    u_a = F.col("_ra") - na * (na + 1.0) / 2.0
    mu = na * nb / 2.0
    sd = F.sqrt(na * nb / 12.0 * ((n + 1.0) - F.try_divide(F.col("_ties"), n * (n - 1.0))))
    out = s.select("metric", "n_a", "n_b", u_a.alias("u_a"), mu.alias("_mu"), sd.alias("_sd"))
    out = out.withColumn("z", F.try_divide(
        F.greatest(F.col("u_a"), na * nb - F.col("u_a")) - F.col("_mu") - 0.5, F.col("_sd"))
    ).drop("_mu", "_sd")
    if with_p:
        # the continuity correction can take z below 0: then nothing speaks against equality
        p = F.when(F.col("z") <= 0, F.lit(1.0)).otherwise(p_value_col("z", "z"))
        out = out.withColumn("p_value", p).withColumn("differ", F.col("p_value") < alpha)
    return out


def contingency(df: DataFrame, row: str, col: str) -> DataFrame:
    """AGG11: dense (row, col, observed, expected) table including zero cells.

    One scan: the observed counts are a partial+final aggregate, written once; margins and total are sums of
    these few rows.  The zero cells come from giving each category of the longer list every category of the shorter
    one; a cell's observed count is then found by a join on both categories (NULL is a category).
    """
    observed = materialise(df.groupBy(F.col(row).alias("_r"), F.col(col).alias("_c")).agg(F.count(F.lit(1)).alias("observed")))
    rows = observed.groupBy("_r").agg(F.sum("observed").alias("_nr"))
    cols = observed.groupBy("_c").agg(F.sum("observed").alias("_nc"))
    long, short = (rows, cols) if rows.count() >= cols.count() else (cols, rows)
    every = short.agg(F.collect_list(F.struct(*short.columns)).alias("list")).select("list").scalar()
    grid = long.withColumn("_x", F.explode(every)).select(*long.columns, "_x.*")
    seen = observed.select(F.col("_r").alias("_or"), F.col("_c").alias("_oc"), "observed")
    total = observed.agg(F.sum("observed").alias("n")).select("n").scalar()
    dense = grid.join(seen, F.col("_r").eqNullSafe(F.col("_or")) & F.col("_c").eqNullSafe(F.col("_oc")), "left")
    return dense.select(F.col("_r").alias(row), F.col("_c").alias(col), F.coalesce("observed", F.lit(0)).alias("observed"),
                        (F.col("_nr") * F.col("_nc").cast("double") / total).alias("expected"))


def chi2_independence(df: DataFrame, row: str, col: str, correction: bool = True,
                      with_p: bool = True, alpha: float = 0.05) -> DataFrame:
    """Pearson chi-square; Yates' correction when dof = 1 (and correction)."""
    d = F.abs(F.col("observed") - F.col("expected"))
    yates = d - F.least(F.lit(0.5), d)
    s = contingency(df, row, col).agg(
        F.countDistinct(row).alias("_r"), F.countDistinct(col).alias("_k"),
        F.sum(d * d / F.col("expected")).alias("_plain"), F.sum(yates * yates / F.col("expected")).alias("_yates"))
    dof = (F.col("_r") - 1) * (F.col("_k") - 1)
    stat = F.when(dof == 1, F.col("_yates")).otherwise(F.col("_plain")) if correction else F.col("_plain")
    out = s.select(stat.alias("statistic"), dof.alias("dof"))
    if with_p:
        out = out.withColumn("p_value", p_value_col("chi2", "statistic", "dof")).withColumn("dependent", F.col("p_value") < alpha)
    return out
