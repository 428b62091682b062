"""String, number and key functions of the catalogue, as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns and words with a given meaning.
VARIANT_PATTERNS = ((r"reverse\s*holo|reverse\s*foil", "reverse"), (r"1st\s*edition|first\s*edition", "first_edition"), (r"foil|holo|hyper|prism|cold\s*foil", "foil"))
NUMBER_OVER_TOTAL = r"(?U)^\s*([A-Za-z0-9\-]+?)\s*/\s*([A-Za-z0-9]+)\s*$"
OUTER_SPACE = r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+$"
LEADING_NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
CURRENCY_SIGNS = {"GBP": "£", "EUR": "€"}
OTHER_SIGN = "$"


def matched(s: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit(""))


def normalise_number(s: Column) -> Column:
    """Upper case, letters and digits only, without leading zeros before a digit."""
    return F.regexp_replace(F.regexp_replace(F.upper(s), "[^A-Z0-9]", ""), r"^0+(?=[0-9])", "")


@F.pandas_udf(StringType())
def decomposed(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, which Spark has no function for."""
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not "̀" <= c <= "ͯ"))


def normalise_name(s: Column, ascii_only: bool = False) -> Column:
    """Lower case without accents, other signs as single spaces. Names of ASCII signs stay in the JVM; with ascii_only
    all are known to be such."""
    other = F.when(~s.rlike(r"^[\x00-\x7F]*$"), s)  # Python gets nulls for the rest
    folded = F.lower(s) if ascii_only else F.coalesce(decomposed(other), F.lower(s))
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def normalise_set_code(s: Column) -> Column:
    return F.regexp_replace(F.upper(s), "[^A-Z0-9]", "")


def set_id(game: Column, code: Column) -> Column:
    return F.concat_ws(":", game, normalise_set_code(code))


def printing_id(game: Column, code: Column, number: Column, variant: Column, language: Column | None = None) -> Column:
    return F.concat_ws(":", game, normalise_set_code(code), normalise_number(number), variant, F.lit("en") if language is None else language)


def match_key(code: Column, number: Column, name: Column, ascii_only: bool = False) -> Column:
    return F.concat_ws("|", normalise_set_code(code), normalise_number(number), normalise_name(name, ascii_only))


def variant_of(name: Column) -> Column:
    """The first variant whose words the product name has, else normal."""
    out = F.when(name.rlike(f"(?i){VARIANT_PATTERNS[0][0]}"), VARIANT_PATTERNS[0][1])
    for pattern, variant in VARIANT_PATTERNS[1:]:
        out = out.when(name.rlike(f"(?i){pattern}"), variant)
    return out.otherwise("normal")


def split_number(raw: Column) -> Column:
    """struct(number, total) of a collector number such as 025/198; no total without a slash."""
    has = raw.rlike(NUMBER_OVER_TOTAL)
    return F.struct(
        F.when(has, F.regexp_extract(raw, NUMBER_OVER_TOTAL, 1)).otherwise(F.regexp_replace(raw, OUTER_SPACE, "")).alias("number"),
        F.when(has, F.regexp_extract(raw, NUMBER_OVER_TOTAL, 2)).alias("total"),
    )


def parse_money(s: Column) -> Column:
    """The number that a text starts with, where it is finite and not negative."""
    v = matched(s.cast("string"), LEADING_NUMBER).try_cast("double")
    return F.when((v >= 0) & (v < F.lit(float("inf"))), v)


def extended(items: Column, field: str) -> Column:
    """The value of the first item named `field` by name or display name."""
    return F.get(F.filter(items, lambda x: (x["name"] == field) | (x["displayName"] == field)), F.lit(0))["value"]


def next_version(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def without_last_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/$", "")


def pack_url(origin: Column, base: Column, key: Column) -> Column:
    """The public address of a stored pack: under the base address where one is set."""
    return F.concat(without_last_slash(F.coalesce(F.nullif(base, F.lit("")), origin)), F.lit("/packs/"), key)


def ids_key(key: Column) -> Column:
    return F.regexp_replace(key, r"\.bin$", ".ids")


def uri_component(s: Column) -> Column:
    """Percent-encoding with the signs that a URI component leaves as they are."""
    out = F.url_encode(s)
    for code, sign in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def with_version_param(url: Column, etag: Column) -> Column:
    joint = F.when(url.contains("?"), "&").otherwise("?")
    return F.when(etag.isNull() | (etag == ""), url).otherwise(F.concat(url, joint, F.lit("e="), uri_component(etag)))


def is_index_stale(stored: Column, remote: Column) -> Column:
    return remote.isNotNull() & ~remote.eqNullSafe(stored)


def index_needs_download(held: Column, stored: Column, remote: Column) -> Column:
    """A missing index is fetched; one that is held only if the server names another copy."""
    return ~held | is_index_stale(stored, remote)


def host_of(url: Column) -> Column:
    """The host that a fetcher's pace is kept for; null for what is no address."""
    return F.try_parse_url(url, F.lit("HOST"))


def is_mutable_pack(path: Column) -> Column:
    """Index packs grow in place; other packs never change."""
    return path.rlike(r"/index-[^/]*\.(bin|ids)$")


def numbers_match(a: Column, b: Column) -> Column:
    some = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return some & (normalise_number(a) == normalise_number(b))


def currency_sign(currency: Column) -> Column:
    out = F.when(currency == "GBP", CURRENCY_SIGNS["GBP"]).when(currency == "EUR", CURRENCY_SIGNS["EUR"])
    return out.otherwise(OTHER_SIGN)


def format_price(market: Column, trend: Column, low: Column, currency: Column) -> Column:
    """Sign and two places of the best known price, or a dash. Halves round up from the decimal form."""
    v = F.coalesce(market, trend, low)
    return F.when(v.isNull(), "—").otherwise(F.concat(currency_sign(currency), F.format_string("%.2f", v)))


def labelled_printing(path: Column) -> Column:
    """The printing id in a test photo's name: <id>[__note].jpg."""
    return matched(path, r"([^/]+?)(?:__[^/]*)?\.jpe?g$")


def pack_key(game: Column, kind: str, *versions: Column) -> Column:
    """games/<game>/<kind>-<version>[-<version>].json, or .bin for an index."""
    return F.concat(F.lit("games/"), game, F.lit(f"/{kind}-"), F.concat_ws("-", *versions), F.lit(".bin" if kind == "index" else ".json"))


def decoded_base64(s: Column) -> Column:
    return F.unbase64(F.regexp_replace(s, r"\s", ""))


def day_of(iso: Column) -> Column:
    return F.substring(iso, 1, 10)
