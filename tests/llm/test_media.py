"""What media columns keep on disk, and that a payload is checked against the digest that it is stored under."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, media


def test_media_tables_keep_digests_as_bytes(spark):
    frame = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    with common.scope(spark) as made:
        assert media.media_columns(frame).count() == 3_000
        size = sum(os.path.getsize(f"{d}/{x}") for p in made for d, _, names in os.walk(p.removeprefix("file://")) for x in names if x.endswith(".parquet") and "media-docs" not in d)
    assert size < 3_000 * 250  # rows, places and what is known of each: 32 bytes a digest, none of them twice in a table


def test_a_payload_of_another_digest_is_an_error(spark):
    _, places, at = media.store_once(spark.createDataFrame([(1, "one")], "doc_id long, text string"))
    with pytest.raises(Exception, match="not the one that was stored"):
        media.described(places.withColumn("digest", F.unhex(F.lit("00" * 32))), at).collect()
