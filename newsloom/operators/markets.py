"""Market quotes: derivations, fallbacks, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Seconds that a snapshot of each class is fresh, points of a spark line, ounces to 10 grams, rupees a dollar if unknown.
TTL = {"stocks": 60, "crypto": 45, "metals": 180, "forex": 90, "commodities": 120}
POINTS, OUNCE_TO_10G, DEFAULT_RATE = 20, 0.3215, 83.0


def quotes(raw: DataFrame) -> DataFrame:
    """symbol, price, prev_close -> with change and change_pct; missing numbers are 0, of no previous close the percentage is 0."""
    price, before = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("price", "prev_close"))
    return raw.select("symbol", F.round(price, 2).alias("price"), F.round(price - before, 2).alias("change"), F.round(F.coalesce(F.try_divide((price - before) * 100, before), F.lit(0.0)), 2).alias("change_pct"))


def spark_lines(candles: DataFrame, points: int = POINTS, order: tuple[str, ...] = ("at",)) -> DataFrame:
    """The last closes that are not null of each symbol: (symbol, n, close), n from 1 for the latest. Each task keeps its own last ones only."""
    latest = Window.partitionBy("symbol").orderBy(*[F.desc(c) for c in order])
    last = candles.where("close is not null").withColumn("n", F.row_number().over(latest)).where(F.col("n") <= points)
    return last.select("symbol", F.col("n").cast("long").alias("n"), F.round("close", 2).alias("close"))


def close_to_close(candles: DataFrame, day: str = "day", order: tuple[str, ...] = ("at",)) -> DataFrame:
    """candles (symbol, day, order columns, close) with the change of each close on the one before; rows without a close go.

    A symbol's history is ordered day by day, so no task orders all of it; the last close of the day before is carried over by
    a window over days, of which there are few.
    """
    known = candles.where("close is not null")
    own = Window.partitionBy("symbol", day).orderBy(*order)
    last = known.groupBy("symbol", day).agg(F.max_by("close", F.struct(*order)).alias("__last"))
    carried = last.withColumn("__before", F.lag("__last").over(Window.partitionBy("symbol").orderBy(day))).drop("__last")
    joined = known.withColumn("__lag", F.lag("close").over(own)).join(carried, ["symbol", day])
    change = F.col("close") - F.coalesce("__lag", "__before")
    return joined.withColumn("change", F.round(change, 2)).drop("__lag", "__before")


def crypto_quotes(raw: DataFrame, labels: DataFrame) -> DataFrame:
    """(symbol, price_usd, price_inr, change_pct, market_cap_usd) of a map column `coins`; an unlabelled coin is its name in capitals."""
    each = raw.select(F.explode("coins").alias("coin", "q"))
    number = lambda c: F.coalesce(F.col(f"q.{c}").cast("double"), F.lit(0.0))
    return each.join(F.broadcast(labels), "coin", "left").select(
        F.coalesce("label", F.upper("coin")).alias("symbol"), F.round(number("usd"), 2).alias("price_usd"), F.round(number("inr"), 2).alias("price_inr"), F.round(number("usd_24h_change"), 2).alias("change_pct"), number("usd_market_cap").cast("long").alias("market_cap_usd")
    )


def metal_prices(rates: DataFrame) -> DataFrame:
    """symbol, rate (units a dollar) -> price in dollars; null for a rate that is not positive."""
    return rates.select("symbol", F.when(F.col("rate") > 0, F.round(F.lit(1.0) / F.col("rate"), 4)).alias("price"))


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """By label: the first source's numbers, and the second's where they are missing."""
    a, b = first.alias("a"), second.alias("b")
    return a.join(b, F.col("a.label") == F.col("b.label"), "full_outer").select(F.coalesce("a.label", "b.label").alias("label"), *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("price", "change", "change_pct")))


def in_rupees(metals: DataFrame, forex: DataFrame, pair: str = "USD/INR") -> DataFrame:
    """price_inr of 10 grams by one rate for all metals, DEFAULT_RATE where the pair is missing."""
    rate = forex.where(F.col("label") == pair).agg(F.coalesce(F.max("price"), F.lit(DEFAULT_RATE)).alias("fx"))  # one row
    return metals.crossJoin(F.broadcast(rate)).withColumn("price_inr", F.round(F.col("price") * OUNCE_TO_10G * F.col("fx"), 0)).drop("fx")


def fresh(snapshots: DataFrame, as_of: Column) -> DataFrame:
    """The latest snapshot of each key while it is fresh and not empty: (asset_class, fetched_at, payload)."""
    ttl = F.element_at(F.create_map(*[F.lit(x) for kv in TTL.items() for x in kv]), F.col("asset_class"))
    latest = snapshots.withColumn("n", F.row_number().over(Window.partitionBy("asset_class").orderBy(F.desc("fetched_at")))).where("n = 1").drop("n")
    alive = F.unix_micros(as_of.cast("timestamp")) <= F.unix_micros(F.col("fetched_at").cast("timestamp")) + ttl * 1_000_000
    return latest.where(alive & F.col("payload").isNotNull() & ~F.col("payload").isin("", "{}"))


def by_class(long: DataFrame, labels: DataFrame) -> DataFrame:
    """(asset_class, quotes): the quotes of the labels (asset_class, position, label) in their order, of one without any only the label.

    The labels are a dimension, which bounds the arrays; quotes of others are not shown.
    """
    met = labels.join(long.join(F.broadcast(labels.select("asset_class", "label")), ["asset_class", "label"], "left_semi"), ["asset_class", "label"], "left")
    listed = met.groupBy("asset_class").agg(F.array_sort(F.collect_list(F.struct("position", "label", "price", "change", "change_pct"))).alias("quotes"))
    return listed.withColumn("quotes", F.transform("quotes", lambda q: q.dropFields("position")))


def board(**classes: DataFrame) -> DataFrame:
    """One long table (asset_class, label, price, change, change_pct) of all classes that are given."""
    out = None
    for name, df in sorted(classes.items()):
        part = df.select(F.lit(name).alias("asset_class"), "label", "price", "change", "change_pct")
        out = part if out is None else out.unionByName(part)
    return out
