"""Landed answers of market-data providers as rows. A file that is no such answer has no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What the providers call their fields.
QUOTES = "quoteResponse struct<result array<struct<symbol string, regularMarketPrice double, regularMarketChange double, regularMarketChangePercent double, regularMarketDayHigh double, regularMarketDayLow double, regularMarketPreviousClose double, currency string>>>"
CANDLES = "chart struct<result array<struct<meta struct<symbol string>, indicators struct<quote array<struct<close array<double>>>>>>>"
COINS = "map<string, struct<usd double, inr double, usd_24h_change double, usd_market_cap double>>"
RATES = "rates map<string, double>"


def _answers(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Answers, one to a file or one to a line."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def rounded(x: Column) -> Column:
    """To two places; a missing number is 0."""
    return F.round(F.coalesce(x, F.lit(0.0)), 2)


def quotes(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(symbol, price, change, change_pct, high, low, prev_close, currency)."""
    each = _answers(spark, path, QUOTES, multi_line).select(F.explode("quoteResponse.result").alias("q"))
    numbers = {"price": "Price", "change": "Change", "change_pct": "ChangePercent", "high": "DayHigh", "low": "DayLow", "prev_close": "PreviousClose"}
    return each.select("q.symbol", *(rounded(F.col(f"q.regularMarket{field}")).alias(name) for name, field in numbers.items()), F.coalesce("q.currency", F.lit("")).alias("currency"))


def candles(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, at, close): closes in order, nulls among them."""
    each = _answers(spark, path, CANDLES).select(F.get("chart.result", F.lit(0)).alias("r"))
    closes = F.get("r.indicators.quote", F.lit(0))["close"]
    return each.select(F.col("r.meta.symbol").alias("symbol"), F.posexplode(closes).alias("at", "close"))


def coins(spark: SparkSession, path: str) -> DataFrame:
    """(coins): the map of a coin's name to its numbers, one row per answer."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", COINS).alias("coins")).where("coins is not null")


def rates(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, rate): units of each symbol a dollar."""
    return _answers(spark, path, RATES).select(F.explode("rates").alias("symbol", "rate"))
