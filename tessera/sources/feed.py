"""The catalogue's nested JSON feed, its manifests and price guide, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = "groupId bigint, name string, abbreviation string, publishedOn string"
PRODUCT = "productId bigint, name string, cleanName string, imageUrl string, groupId bigint, extendedData array<struct<name:string,displayName:string,value:string>>"
PRICE = "productId bigint, subTypeName string, marketPrice double, lowPrice double, midPrice double, directLowPrice double"
MANIFEST = "version string, generatedAt string, games array<struct<game:string,version:string,printingsCount:bigint,catalogUrl:string,indexUrl:string,indexIdsUrl:string,deltas:array<struct<`from`:string,`to`:string,url:string>>>>"
# The feed's category of each game.
CATEGORIES = {"mtg": 1, "yugioh": 2, "pokemon": 3, "onepiece": 68, "lorcana": 71}


def results(spark: SparkSession, path: str, item: str, field: str = "results") -> DataFrame:
    """The items of an envelope's list with their place `pos`; an absent list is empty. Files are read in parallel."""
    fields = ",".join(_typed(item))
    rows = spark.read.schema(f"success boolean, errors array<string>, {field} array<struct<{fields}>>").json(path, multiLine=True)
    return rows.select(F.posexplode(F.coalesce(F.col(field), F.array().cast(f"array<struct<{fields}>>"))).alias("pos", "item")).select("pos", "item.*")


def _typed(item: str) -> list[str]:
    """name:type of each column of a flat DDL string."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(item + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, _, kind = item[start:i].strip().partition(" ")
            out.append(f"{name}:{kind}")
            start = i + 1
    return out


def groups(spark: SparkSession, path: str) -> DataFrame:
    return results(spark, path, GROUP).drop("pos")


def products(spark: SparkSession, path: str) -> DataFrame:
    return results(spark, path, PRODUCT)


def prices(spark: SparkSession, path: str) -> DataFrame:
    """Price lines; a file is one group's, whose id is the last number in its path."""
    fields = ",".join(_typed(PRICE))
    rows = spark.read.schema(f"success boolean, results array<struct<{fields}>>").json(path, multiLine=True)
    group = F.regexp_extract(F.col("_metadata.file_path"), r"([0-9]+)[^0-9/]*$", 1).try_cast("bigint")
    return rows.select(group.alias("groupId"), F.posexplode("results").alias("pos", "item")).select("groupId", "pos", "item.*")


def price_guide(spark: SparkSession, path: str, item: str) -> DataFrame:
    return results(spark, path, item, "priceGuides").drop("pos")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each game of a manifest."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("games").alias("g")).select("g.*")


def stored_keys(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the files under a folder, without their contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def category_of(spark: SparkSession) -> DataFrame:
    """Games and their category; five rows."""
    return spark.createDataFrame(sorted(CATEGORIES.items()), "game string, category int")
