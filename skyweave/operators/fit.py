"""Clipped least-squares fits of offsets for each group, as grouped sums.

A fit is a set of normal equations: sums of products over the rows that are still in, solved as columns of the group's
row. A round solves them, measures residuals, takes their median and MAD, and drops rows beyond the limit that
follows; a group whose rows stay the same repeats its round, so that all groups take the same number of rounds. No
group is ever one frame, however large.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.sources.shared import written


@dataclass(frozen=True)
class Rules:
    """What a fit needs and when rows are dropped: beyond clip_sigma times 1.4826 MAD, but not below clip_min nor above clip_max arcsec."""

    degree: int = 2
    least: int = 20
    rounds: int = 3
    clip_min: float = 1.5
    clip_sigma: float = 3.0
    clip_max: float = 10.0


def _terms(degree: int) -> list[Column]:
    x, y = F.col("x"), F.col("y")
    return [F.lit(1.0), x, y] + ([x * x, x * y, y * y] if degree > 1 else [])


def solve(rows: DataFrame, by: list[str], degree: int) -> DataFrame:
    """by, n, cx, cy: least squares of ox and oy on the terms, by elimination over the sums; null where singular."""
    t = _terms(degree)
    p = len(t)
    sums = [F.count("*").alias("n")]
    for i in range(p):
        sums += [F.sum(t[i] * t[j]).alias(f"a{i}{j}") for j in range(i, p)]
        sums += [F.sum(t[i] * F.col(o)).alias(f"{o}{i}") for o in ("ox", "oy")]
    s = rows.groupBy(*by).agg(*sums)
    for k in range(p):  # pivots are positive unless the terms depend on each other
        own = F.col(f"a{k}{k}")
        pivot = F.when(own > 1e-12 * F.greatest(F.lit(1e-9), F.col("n")), own)
        new = {f"a{i}{j}": F.col(f"a{i}{j}") - F.col(f"a{k}{i}") / pivot * F.col(f"a{k}{j}") for i in range(k + 1, p) for j in range(i, p)}
        new |= {f"{o}{i}": F.col(f"{o}{i}") - F.col(f"a{k}{i}") / pivot * F.col(f"{o}{k}") for i in range(k + 1, p) for o in ("ox", "oy")}
        s = s.withColumns(new | {f"d{k}": pivot})
    for k in range(p - 1, -1, -1):
        for o in ("ox", "oy"):
            rest = F.col(f"{o}{k}")
            for j in range(k + 1, p):
                rest = rest - F.col(f"a{k}{j}") * F.col(f"{o}{j}")
            s = s.withColumn(f"{o}{k}", rest / F.col(f"d{k}"))
    whole = [F.when(F.col(f"{o}0").isNotNull(), F.array(*(F.col(f"{o}{k}") for k in range(p)))) for o in ("ox", "oy")]
    return s.select(*by, "n", whole[0].alias("cx"), whole[1].alias("cy"))


def _residual(degree: int) -> Column:
    """Arcsec between a row's offset and the fit (offsets are degrees)."""
    t = _terms(degree)
    fitted = lambda c: sum((F.col(c)[k] * t[k] for k in range(1, len(t))), F.col(c)[0])
    return F.sqrt(F.pow(F.col("ox") - fitted("cx"), 2) + F.pow(F.col("oy") - fitted("cy"), 2)) * 3600


def robust_fit(rows: DataFrame, by: list[str], rules: Rules = Rules()) -> DataFrame:
    """By, status, n_in, kept, sigma, limit, cx, cy for each group of rows (by, x, y, ox, oy).

    Status: ok; too_few (fewer than `least` rows whose numbers are all finite); too_few_after_clipping; singular. Only ok
    has coefficients. The MAD is that of all finite residuals, dropped rows too; where it is 0 the standard deviation
    stands for it (of more than 10 rows), and where that is 0 too the limit is clip_max.
    """
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    fine = number("x") & number("y") & number("ox") & number("oy")
    base = rows.select(*by, *(F.col(c).cast("double").alias(c) for c in ("x", "y", "ox", "oy")))
    groups = base.groupBy(*by).agg(F.count(F.when(fine, 1)).alias("n_in"))
    now = written(base.where(fine).withColumn("inside", F.lit(True)))
    info = None
    for _ in range(rules.rounds):
        alive = now.groupBy(*by).agg(F.count(F.when(F.col("inside"), 1)).alias("m")).where(F.col("m") >= rules.least).select(*by)
        fit = solve(now.where("inside").join(alive, by, "left_semi"), by, rules.degree)
        left = now.join(fit.select(*by, "cx", "cy"), by).withColumn("r", _residual(rules.degree)).drop("cx", "cy")
        middle = left.groupBy(*by).agg(F.median("r").alias("mid"), F.stddev_pop("r").alias("std"), F.count("r").alias("m"))
        spread = left.join(middle, by).groupBy(*by).agg(F.median(F.abs(F.col("r") - F.col("mid"))).alias("mad"), F.first("std").alias("std"), F.first("m").alias("m"))
        sigma = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).when(F.col("m") > 10, F.col("std")).otherwise(0.0)
        limit = F.least(F.lit(rules.clip_max), F.when(F.col("sigma") > 0, F.greatest(F.lit(rules.clip_min), rules.clip_sigma * F.col("sigma"))).otherwise(rules.clip_max))
        info = written(spread.withColumn("sigma", sigma).select(*by, "sigma", limit.alias("limit")))
        clipped = left.join(info, by).select(*by, "x", "y", "ox", "oy", (F.col("inside") & F.coalesce(F.col("r") <= F.col("limit"), F.lit(True))).alias("inside"))  # no residual: singular
        now = written(clipped)  # groups without enough rows are gone
    kept = now.groupBy(*by).agg(F.count(F.when(F.col("inside"), 1)).alias("kept"))
    last = solve(now.where("inside"), by, rules.degree).select(*by, "cx", "cy")
    out = groups.join(kept, by, "left").join(info, by, "left").join(last, by, "left")
    status = F.when(F.col("n_in") < rules.least, "too_few").when(F.col("kept").isNull() | (F.col("kept") < rules.least), "too_few_after_clipping").when(F.col("cx").isNull() | F.col("cy").isNull(), "singular").otherwise("ok")
    out = out.withColumn("status", status)
    ok = F.col("status") == "ok"
    return out.select(*by, "status", "n_in", F.coalesce("kept", F.lit(0)).alias("kept"), *(F.when(ok, F.col(c)).alias(c) for c in ("sigma", "limit", "cx", "cy")))


def ladder(primary: DataFrame, fallback: DataFrame, by: list[str], rules: Rules = Rules(), second: Rules = Rules(degree=1, least=10)) -> DataFrame:
    """Groups with too few tie points are tried once more, on the tie points of a wider match and by simpler rules; others
    keep what they have. `used` is primary, fallback or none (the raw positions stay)."""
    one = written(robust_fit(primary, by, rules))
    again = one.where("status = 'too_few'").select(*by)
    missing = fallback.select(*by).distinct().join(one.select(*by), by, "left_anti")
    two = robust_fit(fallback.join(again.union(missing), by, "left_semi"), by, second)
    both = one.join(again, by, "left_anti").withColumn("used", F.lit("primary")).unionByName(two.withColumn("used", F.lit("fallback")))
    alone = one.join(two.select(*by), by, "left_anti").join(again, by, "left_semi").withColumn("used", F.lit("none"))
    return both.unionByName(alone).withColumn("used", F.when(F.col("status") == "ok", F.col("used")).otherwise("none"))
