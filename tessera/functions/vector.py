"""Vector functions and evidence scores, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import numbers_match

# Weights and limits of the evidence.
HIGH, CHECK, WEAK = 0.78, 0.60, 0.5
HOME_BONUS, CLEAR_LEAD = 0.05, 0.03
NAME_WEIGHT, EXACT_WEIGHT, IMAGE_WEIGHT = 1.0, 0.4, 0.6
NAME_AGREES, NAME_CONFIDENT, IMAGE_AGREES = 0.5, 0.7, 0.6


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision, in index order; null where the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, v: s + v))


def l2_normalise(v: Column) -> Column:
    """A vector of length 1; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp01(x: Column) -> Column:
    """Within 0 and 1; null and NaN give 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0))))


def mean_abs_diff(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v)
    return total / F.size(a)


def scene_distance(a: Column, b: Column) -> Column:
    """The mean difference of two thumbnails, each less its own mean."""

    def mean(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)

    # bound once: a lambda that names a mean would compute it for every cell
    means = F.transform(F.array(F.struct(mean(a).alias("a"), mean(b).alias("b"))), lambda m: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs((x - m["a"]) - (y - m["b"]))), F.lit(0.0), lambda s, v: s + v))
    return means[0] / F.size(a)


def picture_confidence(top: Column, second: Column, frames: Column, ocr_agrees: Column, sharpness: Column) -> Column:
    """struct(tier, score, top_score, gap, reasons) of a match by picture; a null top is no candidate at all."""
    gap = F.when(second.isNull(), top).otherwise(top - second)
    raw = 0.6 * top + 0.25 * F.least(F.lit(1.0), gap * 8)
    raw = raw + F.when(ocr_agrees, 0.1).when(~ocr_agrees, -0.15).otherwise(0.0)
    raw = raw + F.when(frames >= 3, 0.05).otherwise(0.0) - F.when(sharpness < 0.35, 0.1).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    tier = F.when(top < WEAK, "low").when(score >= HIGH, "high").when(score >= CHECK, "check").otherwise("low")
    reasons = F.array_compact(
        F.array(
            F.when(ocr_agrees, "set/number matched").when(~ocr_agrees, "set/number disagreed"),
            F.when(frames >= 3, F.concat(frames.cast("string"), F.lit(" frames agreed"))),
            F.when(sharpness < 0.35, "blurry frame"),
            F.when(top < WEAK, "weak match"),
        )
    )
    none = top.isNull()
    return F.struct(
        F.when(none, "low").otherwise(tier).alias("tier"),
        F.when(none, 0.0).otherwise(score).alias("score"),
        F.coalesce(top, F.lit(0.0)).alias("top_score"),
        F.when(none, 0.0).otherwise(gap).alias("gap"),
        F.when(none, F.array(F.lit("no candidates"))).otherwise(reasons).alias("reasons"),
    )


def corner_evidence(set_code: Column, number: Column, total: Column, language: Column, corner: Column) -> Column:
    """struct(score, matched_on) of a printing against a parsed corner; null where nothing was readable."""
    hits = (
        ("set", 0.5, F.upper(set_code) == corner["set_code"]),
        ("number", 0.4, numbers_match(corner["number"], number)),
        ("setTotal", 0.2, numbers_match(corner["set_total"], total)),
        ("language", 0.1, language == corner["language"]),
    )
    score = sum((F.when(hit, w).otherwise(0.0) for _, w, hit in hits), F.lit(0.0))
    on = F.array_compact(F.array(*[F.when(hit, name) for name, _, hit in hits]))
    read = corner["set_code"].isNotNull() | corner["number"].isNotNull() | corner["set_total"].isNotNull()
    return F.when(read, F.struct(score.alias("score"), on.alias("matched_on")))


def ocr_agreement(n_scores: Column, first_id: Column, chosen_id: Column) -> Column:
    """Null without evidence, false without a choice, else whether the best-scored printing is the chosen one."""
    return F.when(n_scores > 0, F.when(chosen_id.isNull(), False).otherwise(first_id == chosen_id))


def choice_score(name_score: Column, exact: Column, image_score: Column) -> Column:
    return NAME_WEIGHT * name_score + EXACT_WEIGHT * exact.cast("int") + IMAGE_WEIGHT * F.coalesce(image_score, F.lit(0.0))


def serial_confidence(serial: Column, n: Column, top: Column, second: Column, read: Column, exact: Column, name_score: Column, image_score: Column) -> Column:
    """struct(tier, score, top_score, gap, reasons) of a match by serial; a null `read` is no corroboration."""
    gap = F.when(top.isNotNull() & second.isNotNull() & (n > 1), top - second).otherwise(0.0)
    single, clear = n == 1, gap >= CLEAR_LEAD
    named, looks = name_score >= NAME_AGREES, F.coalesce(image_score, F.lit(0.0)) >= IMAGE_AGREES
    known = read.isNotNull()
    doubtful = known & F.when(~exact, name_score < NAME_CONFIDENT).otherwise(~named & ~looks)
    base = F.when(single, 0.95).when(clear, 0.9).otherwise(0.7)
    reasons = F.array_compact(
        F.array(
            F.concat(F.lit("serial "), serial, F.lit(" read from the card")),
            F.when(single, "only one printing has it").otherwise(F.concat(n.cast("string"), F.lit(" printings share it"))),
            F.when(~single, F.when(clear, "artwork picks one").otherwise("printings look alike — check which")),
            F.when(
                known,
                F.when(~exact, F.concat(F.lit("read as "), read, F.lit(", but the card name matches "), serial))
                .when(named, "card name agrees")
                .when(looks, "picture agrees")
                .otherwise("serial not yet confirmed by the name or picture"),
            ),
        )
    )
    return F.struct(
        F.when(doubtful, "check").when(single | clear, "high").otherwise("check").alias("tier"),
        F.when(doubtful, F.least(base, F.lit(0.7))).otherwise(base).alias("score"),
        F.coalesce(top, F.lit(0.0)).alias("top_score"),
        F.when(single, F.coalesce(top, F.lit(0.0))).otherwise(gap).alias("gap"),
        reasons.alias("reasons"),
    )
