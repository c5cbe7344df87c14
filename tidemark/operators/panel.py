"""Return panels: prices on a calendar, returns, eligibility, baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIP = 80.0  # of log indices, before they are turned into levels


def log_ratio(price: Column, before: Column) -> Column:
    """ln(price / before) where both are positive, else null."""
    return F.when((price > 0) & (before > 0), F.ln(price / before))


def adjacent_log_return(panel: DataFrame, key: str = "security_id", week: str = "week", price: str = "price") -> DataFrame:
    """The log return from the week before. The panel has every week of its calendar, so a gap is never bridged."""
    w = Window.partitionBy(key).orderBy(week)
    return panel.withColumn("log_return", log_ratio(F.col(price), F.lag(price).over(w)))


def basket(panel: DataFrame, weight: Column, by: tuple[str, ...] = ("week",)) -> DataFrame:
    """The weighted mean of the observed returns, weights renormalised over what is observed."""
    seen = F.col("log_return").isNotNull()
    total = F.sum(F.when(seen, weight))
    return panel.groupBy(*by).agg(
        F.when(total > 1e-12, F.sum(F.when(seen, weight * F.col("log_return"))) / total).alias("basket_return"),
        F.avg(F.when(seen, F.lit(1).cast("double")).otherwise(F.lit(0).cast("double"))).alias("observed_fraction"),
        F.sum(seen.cast("int")).alias("observed"),
    )


def level(returns: Column, over) -> Column:
    """exp of the running sum of returns, clipped."""
    return F.exp(F.least(F.greatest(F.sum(returns).over(over), F.lit(-CLIP)), F.lit(CLIP)))


def drawdown(df: DataFrame, key: list[str], order: str, index: str) -> DataFrame:
    """The running peak from an origin of 1, and the fall below it."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.lit(1).cast("double"), F.max(index).over(w))
    return df.withColumn("peak", peak).withColumn("drawdown", F.col(index) / F.col("peak") - 1)


def eligibility(returns: DataFrame, train_end: str, least_weeks: int, least_train: int, coverage: float, key: str = "security_id") -> DataFrame:
    """A row for each key: its life, and the first reason to leave it out, if any."""
    seen = F.col("log_return").isNotNull()
    until = F.col("week") <= F.lit(train_end).cast("date")
    life = returns.groupBy(key).agg(
        F.min(F.when(seen, F.col("week"))).alias("first_week"),
        F.max(F.when(seen, F.col("week"))).alias("last_week"),
        F.count(F.when(seen, 1)).alias("weeks"),
        F.count(F.when(seen & until, 1)).alias("train_weeks"),
        F.min(F.when(seen & until, F.col("week"))).alias("train_first"),
        F.max(F.when(seen & until, F.col("week"))).alias("train_last"),
    )
    span = F.floor(F.datediff("train_last", "train_first") / 7) + 1
    life = life.withColumn("coverage", F.when(F.col("train_weeks") > 0, F.col("train_weeks") / span).otherwise(F.lit(0).cast("double")))
    reason = F.when(F.col("weeks") < least_weeks, "insufficient_pre_cutoff_weeks").when(F.col("train_weeks") < least_train, "insufficient_training_weeks").when(F.col("coverage") < coverage, "low_pre_cutoff_coverage")
    return life.withColumn("reason", reason)


def usd_per_unit(quotes: DataFrame, scale: Column, least: int = 20) -> DataFrame:
    """quotes(code, week, direct, inverse) to (code, week, direction, usd): dollars for a unit as it is quoted. An inverse quote is turned over;
    what is not finite goes; of the directions that have ``least`` values the direct one counts, and codes without one have no rows.
    """
    both = quotes.unpivot(["code", "week"], ["direct", "inverse"], "direction", "quote").filter(F.col("quote").isNotNull())
    usd = F.when(F.col("direction") == "direct", F.col("quote")).otherwise(F.try_divide(F.lit(1.0), F.col("quote"))) * scale
    usable = both.withColumn("usd", usd).filter(F.col("usd").isNotNull() & ~F.isnan("usd") & (F.abs("usd") < float("inf"))).drop("quote")
    enough = usable.groupBy("code", "direction").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    first = enough.groupBy("code").agg(F.min("direction").alias("direction"))  # direct comes before inverse
    return usable.join(first, ["code", "direction"]).select("code", "week", "direction", "usd")
