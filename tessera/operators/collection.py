"""Holdings: additive entries, their rows with names and prices, and what they are worth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import merge_additive

ENTRY_KEY = ("portfolio_id", "printing_id", "variant", "condition")
VALUED_BY = "cardmarket"


def add_entries(collection: DataFrame, entries: DataFrame, order: str = "seq") -> DataFrame:
    """Quantities are added up for each key; cost and time stay those of the first entry."""
    return merge_additive(collection, entries, ENTRY_KEY, order, ["quantity"])


def collection_rows(entries: DataFrame, printing_rows: DataFrame, prices: DataFrame, source: str = VALUED_BY) -> DataFrame:
    """Entries with their printing and the price of one source; null without one. The printing's id, variant and so on
    keep their names, the entry's are those of ENTRY_KEY with entry_variant."""
    price = prices.where(F.col("source") == source).select("printing_id", "market", "currency")
    mine = entries.withColumnRenamed("variant", "entry_variant")
    shown = printing_rows.select(F.col("id").alias("printing_id"), "name", "set_code", "set_name", "number", "variant")
    return mine.join(shown, "printing_id").join(price, "printing_id", "left")


def collection_value(rows: DataFrame, default_currency: str = "GBP") -> DataFrame:
    """portfolio_id, quantity, value and currency: the first one known, from the entry added last."""
    value = F.coalesce("market", F.lit(0.0)) * F.col("quantity")
    latest = F.max_by("currency", F.when(F.col("currency").isNotNull(), F.struct("added_at", "printing_id")))
    return rows.groupBy("portfolio_id").agg(
        F.sum("quantity").alias("quantity"),
        F.sum(value.cast("decimal(28,6)")).cast("double").alias("value"),
        F.coalesce(latest, F.lit(default_currency)).alias("currency"),
    )


def listing(rows: DataFrame, portfolio_id: int) -> DataFrame:
    """A portfolio's entries (see collection_rows), the last added first; equal times in order of the printing's id."""
    return rows.where(F.col("portfolio_id") == portfolio_id).orderBy(F.desc("added_at"), "printing_id", "entry_variant")


def default_portfolio(portfolios: DataFrame) -> DataFrame:
    """The portfolio with the least id."""
    return portfolios.orderBy("id").limit(1)


def record_correction(corrections: DataFrame, path: str) -> None:
    """Appends to the log of corrected scans."""
    corrections.write.mode("append").parquet(path)
