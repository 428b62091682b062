"""From readings of a card to a printing: serials first, else the picture with what the corner says."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reading as R
from ..functions import vector as V
from ..scratch import written

NEAR_LIMIT, ALTERNATIVES, PIECE = 400, 10, 4


def near_printings(reads: DataFrame, printings: DataFrame, limit: int = NEAR_LIMIT) -> DataFrame:
    """scan_id, serial and the columns of printings whose number is the serial read or a digit away from it.

    Both sides are taken apart into patterns with one masked digit, so this is an equality join; a printing that meets
    a read by several patterns is one row. The first `limit` by release and id stay, with their place as `ordinal`.
    """
    left = reads.select("scan_id", "game_id", "serial", F.explode(R.near_serial_patterns(F.upper("serial"))).alias("pattern"))
    right = printings.withColumn("pattern", F.explode(R.near_serial_patterns(F.upper("number"))))
    met = left.join(right, ["game_id", "pattern"]).drop("pattern").dropDuplicates(["scan_id", "id"])
    order = Window.partitionBy("scan_id").orderBy(F.desc_nulls_last("release_date"), "id")
    return met.withColumn("ordinal", F.row_number().over(order)).where(F.col("ordinal") <= limit)


def with_image_score(near: DataFrame, embeddings: DataFrame, index: DataFrame) -> DataFrame:
    """near with `image_score`: the product of the scan's embedding and the printing's last index row, null without one.

    near is written once; of the index only rows of its printings are shuffled.
    """
    near = written(near, "near")
    last = index.join(near.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.max_by("embedding", "row").alias("__v"))
    out = near.join(last, "id", "left").join(embeddings.select("scan_id", F.col("embedding").alias("__q")), "scan_id", "left")
    return out.withColumn("image_score", V.dot(F.col("__q"), F.col("__v"))).drop("__v", "__q")


def with_choice(near: DataFrame) -> DataFrame:
    """near (scan_id, serial as read, lines, number, name, image_score, ordinal) with `choice`: the best-backed
    printing's serial, what was read, exact, name_score and image_score; the first of equal ones.

    A window over a scan's printings, of which there are NEAR_LIMIT at most, so near is planned once.
    """
    exact = F.col("number") == F.col("serial")
    rows = near.withColumn("__name", R.name_similarity(F.col("lines"), F.col("name")))
    what = F.struct(F.col("serial").alias("read"), F.col("number").alias("serial"), exact.alias("exact"), F.col("__name").alias("name_score"), "image_score")
    score = V.choice_score(F.col("__name"), exact, F.col("image_score"))
    best = F.max_by(what, F.struct(score, -F.col("ordinal"))).over(Window.partitionBy("scan_id"))
    return rows.withColumn("choice", best).drop("__name")


def choose_serial(chosen: DataFrame) -> DataFrame:
    """scan_id, read, serial, exact, name_score, image_score of each scan of rows with_choice."""
    return chosen.groupBy("scan_id").agg(F.first("choice").alias("c")).select("scan_id", "c.read", "c.serial", "c.exact", "c.name_score", "c.image_score")


def rank_by_serial(chosen: DataFrame) -> DataFrame:
    """The printings (with_choice) that carry the chosen serial and their `place`: by picture and a bonus for the
    serial's own set, then plain before others, then catalogue order."""
    rows = chosen.where(F.col("number") == F.col("choice.serial"))
    rows = rows.withColumn("home", R.compact_set_code(F.col("set_code")) == R.serial_set(F.col("choice.serial")))
    key = F.coalesce("image_score", F.lit(-1.0)) + F.when(F.col("home"), V.HOME_BONUS).otherwise(0.0)
    order = Window.partitionBy("scan_id").orderBy(key.desc(), (F.col("variant") == "normal").desc(), "ordinal")
    return rows.withColumn("place", F.row_number().over(order))


def serial_results(ranked: DataFrame) -> DataFrame:
    """scan_id, printing_id, serial, n and a confidence struct, from ranked printings with what settled the serial."""
    two = ranked.groupBy("scan_id").agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("place") == 1, F.col("id"))).alias("printing_id"),
        F.max(F.when(F.col("place") == 1, F.col("image_score"))).alias("top"),
        F.max(F.when(F.col("place") == 2, F.col("image_score"))).alias("second"),
        F.first("choice").alias("c"),
    )
    rows = two.select("*", "c.serial", "c.read", "c.exact", "c.name_score", "c.image_score")
    confidence = V.serial_confidence(*map(F.col, ("serial", "n", "top", "second", "read", "exact", "name_score", "image_score")))
    return rows.select("scan_id", "printing_id", "serial", "n", confidence.alias("confidence"))


def rank_by_corner(candidates: DataFrame, corners: DataFrame) -> DataFrame:
    """Printings (scan_id, ordinal, set_code, number, set_total, language) with evidence in the corner read (scan_id,
    corner), best first: score, matched_on and place."""
    rows = candidates.join(corners, "scan_id")
    rows = rows.withColumn("e", V.corner_evidence(F.col("set_code"), F.col("number"), F.col("set_total"), F.col("language"), F.col("corner"))).where("e.score > 0")
    order = Window.partitionBy("scan_id").orderBy(F.desc("score"), "ordinal")
    return rows.select("*", "e.score", "e.matched_on").drop("e").withColumn("place", F.row_number().over(order))


def picture_results(tops: DataFrame, printings: DataFrame, corners: DataFrame | None = None) -> DataFrame:
    """scan_id, printing_id and a confidence struct of scans without a usable serial.

    tops: scan_id, art_id, id, top, second, frames (see search.top_pair). printings: the candidates' ones as scan_id,
    ordinal, id and the corner's columns; the first ordinal of a scan is the matched printing. A corner counts only
    where the best artwork has several printings.
    """
    n = printings.join(tops.select("scan_id", F.col("art_id").alias("best")), "scan_id").groupBy("scan_id").agg(
        F.sum((F.col("art_id") == F.col("best")).cast("int")).alias("n"), F.min_by("id", "ordinal").alias("first_id")
    )
    rows = tops.join(n, "scan_id", "left")
    if corners is None:
        rows = rows.withColumn("read_id", F.lit(None).cast("string"))
    else:
        best = rank_by_corner(printings, corners).where("place = 1").select("scan_id", F.col("id").alias("read_id"))
        rows = rows.join(best, "scan_id", "left").withColumn("read_id", F.when(F.col("n") > 1, F.col("read_id")))
    chosen = F.coalesce("read_id", "first_id")
    agrees = V.ocr_agreement(F.when(F.col("read_id").isNotNull(), 1).otherwise(0), F.col("read_id"), chosen)
    confidence = V.picture_confidence(F.col("top"), F.col("second"), F.col("frames"), agrees, F.lit(None).cast("double"))
    return rows.select("scan_id", chosen.alias("printing_id"), confidence.alias("confidence"))


def finish(by_serial: DataFrame, by_picture: DataFrame) -> DataFrame:
    """The serial's result of a scan where there is one, else the picture's."""
    one = by_serial.select("scan_id", "printing_id", "confidence", F.lit("serial").alias("by"))
    rest = by_picture.join(by_serial.select("scan_id"), "scan_id", "left_anti")
    return one.unionByName(rest.select("scan_id", "printing_id", "confidence", F.lit("picture").alias("by")))


def other_candidates(expanded: DataFrame, printings: DataFrame, by_serial: DataFrame) -> DataFrame:
    """Expanded artworks none of whose printings (scan_id, art_id, id) is among those that the serial names."""
    named = printings.join(by_serial.select("scan_id", "id"), ["scan_id", "id"]).select("scan_id", "art_id").distinct()
    return expanded.join(named, ["scan_id", "art_id"], "left_anti")


def alternatives(printings: DataFrame, chosen: DataFrame, limit: int = ALTERNATIVES) -> DataFrame:
    """The first `limit` candidates' printings (scan_id, ordinal, id) of a scan but the chosen one (scan_id,
    printing_id), with their `place`."""
    rest = printings.join(chosen.select("scan_id", F.col("printing_id").alias("id")), ["scan_id", "id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("scan_id").orderBy("ordinal"))
    return rest.withColumn("place", place).where(F.col("place") <= limit)


def first_reading(readings: DataFrame) -> DataFrame:
    """The first orientation with a serial, of readings (frame_id, turn, lines); turns count in their order."""
    rows = readings.withColumn("serial", R.parse_serial(F.col("lines"))).where("serial IS NOT NULL")
    best = F.min_by(F.struct("serial", "lines", "turn"), F.col("turn")).alias("r")
    return rows.groupBy("frame_id").agg(best).select("frame_id", "r.*")


def named_in(texts: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """key, name, similarity (above 0) of texts (key, lines) and names (name) that have words in common, with slips.

    A word with up to e slips in a line leaves one of its e + 1 pieces whole, so texts and words are joined on equal
    pieces (by their first PIECE signs at most), and only what meets is compared.
    """
    words = names.select("name").distinct().select("name", F.posexplode(R.name_words(F.col("name"))).alias("n", "word"))
    of = words.groupBy("name").agg(F.count("*").alias("n"))
    each = words.select("word").distinct().withColumn("piece", F.explode(R.pieces(F.col("word"), PIECE)))
    plain = texts.select(key, F.transform("lines", R.alphanumeric).alias("lines"))
    parts = plain.select(key, F.explode("lines").alias("line")).select(key, F.explode(R.parts(F.col("line"), PIECE)).alias("piece")).distinct()
    met = parts.join(each, "piece").select(key, "word").distinct().join(plain, key)
    found = met.where(F.exists("lines", lambda x: R.contains_approximately(x, F.col("word"), R.allowed_edits(F.col("word"))))).select(key, "word")
    hits = found.join(words, "word").groupBy(key, "name").agg(F.count("*").alias("hits"))
    return hits.join(of, "name").select(key, "name", (F.col("hits") / F.col("n")).alias("similarity"))
