"""Format-preserving pseudonyms of personal data, in DataFrame functions alone.

A value is found by one regular expression, validated, and replaced by another valid value of the same format: a
Feistel network keyed by `key` permutes all values of a format, so equal values stay linked across documents and
different ones never meet. Round functions are SHA-256 of key, format, round and the other half.

kind   | what is validated                                | what is permuted
email  | a mailbox and a domain with a dot                | letters and digits of the mailbox, each within its class
iban   | checksum modulo 97, 15 to 34 signs               | the account's digits; check digits follow, letters stay
card   | 13 to 19 digits with a Luhn check digit          | all but the last digit; the check digit follows
ssn    | nnn-nn-nnnn, no part zero, area not 666 or 9nn   | the 898 * 99 * 9999 valid numbers
phone  | + country code or a bracketed area code          | the digits after the country code
ip     | four numbers up to 255                           | the 2^32 addresses
date   | yyyy-mm-dd, dd.mm.yyyy or mm/dd/yyyy on a calendar | days of 28-year blocks from 1901 to 2096, else of the year

What is not valid stays as it is, like the signs between digits. Words or digits right before or after a number (hex
keys, longer numbers) make it no match. Null texts stay null (no values); empty texts stay empty; repeated rows stay.
Equal texts have equal results whatever the other columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 8
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: In order of precedence at one start.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])",
    "date": r"(?<![A-Za-z0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![A-Za-z0-9]|[./-][0-9])",
    "ip": rf"(?<![A-Za-z0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![A-Za-z0-9]|\.[0-9])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4})(?![A-Za-z0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: 28 years from 1901 repeat weekdays and leap years: 10,227 days = 21 * 487.
BLOCK_YEARS, BLOCK_DAYS, BLOCK_RADIX, FIRST_YEAR, LAST_YEAR = 28, 10_227, 487, 1901, 2096


def number(s: Column) -> Column:
    return F.coalesce(s.try_cast("long"), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def mixed(*parts: Column) -> Column:
    """A 60-bit number from SHA-256 of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, r1: Column, b: Column, r2: Column, key: Column, form: Column) -> Column:
    """The image of (a, b), 0 <= a < r1, 0 <= b < r2, as a struct; a permutation of all such pairs for a key and format."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s: Column, r: Column) -> Column:
        mix = mixed(key, form, r, F.when(r % 2 == 0, s["b"]).otherwise(s["a"]))
        left = F.when(r % 2 == 0, F.pmod(s["a"] + F.pmod(mix, r1), r1)).otherwise(s["a"])
        right = F.when(r % 2 == 0, s["b"]).otherwise(F.pmod(s["b"] + F.pmod(mix, r2), r2))
        return F.struct(left.alias("a"), right.alias("b"))

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, turn)


def ten_to(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permuted_digits(d: Column, key: Column, form: str) -> Column:
    """Another string of as many digits (36 at most), from a permutation of all of them."""
    n = F.length(d)
    h = F.floor(n / 2).cast("int")
    name = F.concat(F.lit(form), n.cast("string"))
    image = feistel(number(F.substring(d, F.lit(1), h)), ten_to(h), number(F.substring(d, h + 1, n - h)), ten_to(n - h), key, name)
    return let(image, lambda x: F.concat(F.when(h > 0, F.lpad(x["a"].cast("string"), h, "0")).otherwise(""), F.lpad(x["b"].cast("string"), n - h, "0")))


def only(s: Column, kept: str) -> Column:
    return F.regexp_replace(s, f"[^{kept}]", "")


def laid_out(like: Column, signs: Column, kind: str = "0-9") -> Column:
    """`like` with its signs of a kind replaced in order by those of `signs`."""
    place = F.sequence(F.lit(1), F.length(like))

    def filled(new: Column) -> Column:
        def sign(i: Column) -> Column:
            c = F.substring(like, i, F.lit(1))
            return F.when(c.rlike(f"[{kind}]"), F.substring(new, F.length(only(F.substring(like, F.lit(1), i), kind)), F.lit(1))).otherwise(c)

        return F.array_join(F.transform(place, sign), "")

    return let(signs, filled)


def luhn_sum(d: Column) -> Column:
    """The Luhn sum of digits that a check digit will follow."""
    n = F.length(d)

    def value(i: Column) -> Column:
        v = number(F.substring(d, i, F.lit(1)))
        twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return F.when((n - i) % 2 == 0, twice).otherwise(v)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0).cast("long"), lambda s, x: s + x)


def check_digit(d: Column) -> Column:
    return F.pmod(-luhn_sum(d), F.lit(10)).cast("string")


def body_of(d: Column) -> Column:
    return F.substring(d, F.lit(1), F.length(d) - 1)


def card_valid(m: Column) -> Column:
    return let(only(m, "0-9"), lambda d: check_digit(body_of(d)) == F.right(d, F.lit(1)))


def card(m: Column, key: Column) -> Column:
    body = let(body_of(only(m, "0-9")), lambda d: permuted_digits(d, key, "card"))
    return let(body, lambda new: laid_out(m, F.concat(new, check_digit(new))))


def mod97(s: Column) -> Column:
    """The remainder of an IBAN's letters and digits, read as a number with A = 10 to Z = 35."""

    def add(r: Column, i: Column) -> Column:
        c = F.ascii(F.substring(s, i, F.lit(1)))
        return F.when(c >= 65, (r * 100 + c - 55) % 97).otherwise((r * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)


def iban_valid(m: Column) -> Column:
    turned = let(only(m, "A-Z0-9"), lambda s: F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4)))
    return let(turned, lambda s: F.length(s).between(15, 34) & (mod97(s) == 1))


def iban(m: Column, key: Column) -> Column:
    country = F.substring(m, 1, 2)

    def permuted(account: Column) -> Column:
        return let(only(account, "0-9"), lambda d: F.when(F.length(d) > 0, laid_out(account, permuted_digits(d, key, "iban"))).otherwise(account))

    def checked(account: Column) -> Column:
        check = F.lpad((F.lit(98) - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
        return laid_out(m, F.concat(country, check, account), "A-Z0-9")

    return let(let(let(only(m, "A-Z0-9"), lambda s: F.substring(s, F.lit(5), F.length(s))), permuted), checked)


def ssn_valid(m: Column) -> Column:
    area = F.substring(m, 1, 3)
    return ~area.rlike("^(000|666|9..)$") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")


def ssn(m: Column, key: Column) -> Column:
    area = number(F.substring(m, 1, 3))
    a = F.when(area > 666, area - 2).otherwise(area - 1)
    b = (number(F.substring(m, 5, 2)) - 1) * 9999 + number(F.substring(m, 8, 4)) - 1

    def shown(x: Column) -> Column:
        back = F.when(x["a"] >= 665, x["a"] + 2).otherwise(x["a"] + 1)
        return F.concat_ws("-", F.lpad(back.cast("string"), 3, "0"), F.lpad((F.floor(x["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((x["b"] % 9999 + 1).cast("string"), 4, "0"))

    return let(feistel(a, F.lit(898), b, F.lit(99 * 9999), key, F.lit("ssn")), shown)


def ip(m: Column, key: Column) -> Column:
    o = F.split(m, r"\.")
    image = feistel(number(o[0]) * 256 + number(o[1]), F.lit(65536), number(o[2]) * 256 + number(o[3]), F.lit(65536), key, F.lit("ip"))
    return let(image, lambda x: F.concat_ws(".", *[v.cast("string") for v in (F.floor(x["a"] / 256), x["a"] % 256, F.floor(x["b"] / 256), x["b"] % 256)]))


def phone(m: Column, key: Column) -> Column:
    """The country code ends at the first sign between digits; without any, it is one digit."""

    def after(head: Column) -> Column:
        rest = F.substring(m, F.length(head) + 1, F.length(m))
        return F.concat(head, let(rest, lambda s: laid_out(s, let(only(s, "0-9"), lambda d: permuted_digits(d, key, "phone")))))

    return let(F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[ .(-])|\+[0-9])?", 0), after)


def parsed_date(m: Column) -> Column:
    """Null for what is on no calendar."""
    iso = F.when(m.contains("-"), m).when(m.contains("/"), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2))).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    return F.when(F.substring(iso, 1, 4) != "0000", iso.try_cast("date"))


def date(m: Column, key: Column) -> Column:
    def block(d: Column) -> Column:
        y = F.year(d)
        in_block = y.between(FIRST_YEAR, LAST_YEAR)
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        start = F.make_date(F.when(in_block, y - (y - FIRST_YEAR) % BLOCK_YEARS).otherwise(y), F.lit(1), F.lit(1))
        r2 = F.when(in_block, BLOCK_RADIX).when(leap, 61).otherwise(73)
        r1 = F.when(in_block, BLOCK_DAYS // BLOCK_RADIX).when(leap, 6).otherwise(5)
        return F.struct(start.alias("start"), F.datediff(d, start).alias("at"), r1.alias("r1"), r2.alias("r2"))

    def moved(b: Column) -> Column:
        image = feistel(F.floor(b["at"] / b["r2"]), b["r1"], b["at"] % b["r2"], b["r2"], key, F.concat(F.lit("date"), b["start"].cast("string")))
        return let(image, lambda x: F.date_add(b["start"], (x["a"] * b["r2"] + x["b"]).cast("int")))

    def shown(d: Column) -> Column:
        y, mon, day = (F.lpad(f(d).cast("string"), n, "0") for f, n in ((F.year, 4), (F.month, 2), (F.day, 2)))
        return F.when(m.contains("-"), F.concat_ws("-", y, mon, day)).when(m.contains("/"), F.concat_ws("/", mon, day, y)).otherwise(F.concat_ws(".", day, mon, y))

    return let(let(let(parsed_date(m), block), moved), shown)


def shifted(s: Column, other: Column, key: Column, r: Column) -> Column:
    """Each ASCII letter or digit of s moved within its class by a keyed function of the other half."""
    hashes = F.concat(*[F.sha2(F.concat_ws(":", key, F.lit("email"), r, F.lit(i), other), 256) for i in (0, 1)])

    def filled(noise: Column) -> Column:
        def sign(i: Column) -> Column:
            k = F.conv(F.substring(noise, F.pmod(i * 2, F.lit(124)) + 1, F.lit(4)), 16, 10).cast("int")

            def moved(c: Column) -> Column:
                to = [F.char(F.lit(lo) + F.pmod(c - lo + k, F.lit(n))) for lo, n in ((97, 26), (65, 26), (48, 10))]
                return F.when(c.between(97, 122), to[0]).when(c.between(65, 90), to[1]).when(c.between(48, 57), to[2]).otherwise(F.char(c))

            return let(F.ascii(F.substring(s, i, F.lit(1))), moved)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), sign), "")

    return F.when(F.length(s) == 0, s).otherwise(let(hashes, filled))


def email(m: Column, key: Column) -> Column:
    box = F.substring_index(m, "@", 1)
    h = F.floor(F.length(box) / 2).cast("int")
    halves = F.struct(F.substring(box, F.lit(1), h).alias("a"), F.substring(box, h + 1, F.length(box)).alias("b"))

    def turn(s: Column, r: Column) -> Column:
        # the half that moves comes second; then the halves change places, an even number of times in all
        return let(s["a"], lambda moving: F.struct(s["b"].alias("a"), shifted(moving, s["b"], key, r).alias("b")))

    image = F.aggregate(F.array(*map(F.lit, range(ROUNDS))), halves, turn)
    return let(image, lambda x: F.concat(x["a"], x["b"], F.substring(m, F.length(box) + 1, F.length(m))))


def kind_of(m: Column) -> Column:
    """The kind of a match of ANY; null where it isn't valid."""
    whole = {k: m.rlike(f"^(?:{p})$") for k, p in PATTERNS.items()}
    return (
        F.when(m.contains("@"), "email")
        .when(whole["iban"], F.when(iban_valid(m), "iban"))
        .when(whole["ssn"], F.when(ssn_valid(m), "ssn"))
        .when(whole["date"], F.when(parsed_date(m).isNotNull(), "date"))
        .when(whole["ip"], "ip")
        .when(whole["card"], F.when(card_valid(m), "card"))
        .otherwise("phone")
    )


def pseudonym(m: Column, kind: Column, key: Column) -> Column:
    out = F.when(kind == "email", email(m, key))
    for name, f in (("iban", iban), ("ssn", ssn), ("date", date), ("ip", ip), ("card", card), ("phone", phone)):
        out = out.when(kind == name, f(m, key))
    return out.otherwise(m)


def found(text: Column) -> Column:
    """The matches of ANY in order, as an array of structs (m, kind)."""
    matches = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.transform(matches, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))


def pseudonymised(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """docs with valid values in `column` replaced, and a last column `pii` (or a free name like it): a struct of the
    number of values of each kind."""
    at, name, secret = free_name(docs.columns, "matches"), free_name(docs.columns, "pii"), F.lit(key)
    rows = docs.withColumn(at, found(F.col(column)))
    texts = F.split(F.col(column), ANY, -1)
    # a text without matches is not cut again
    new = F.when(F.size(at) > 0, F.array_join(F.zip_with(texts, F.transform(at, lambda x: pseudonym(x["m"], x["kind"], secret)), lambda t, p: F.concat(t, F.coalesce(p, F.lit("")))), "")).otherwise(F.col(column))

    def count(kind: str) -> Column:
        return F.size(F.filter(at, lambda x: x["kind"] == kind)).cast("long").alias(kind)

    counts = F.struct(*map(count, PATTERNS))
    return rows.select(*[new.alias(c) if c == column else F.col(c) for c in docs.columns], counts.alias(name))


def scrub(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, and the number of values of each kind, of each row of docs (doc_id, text)."""
    out = pseudonymised(docs.select("doc_id", "text"), key)
    return out.select("doc_id", "text", *[F.col(f"pii.{k}").alias(f"n_{k}") for k in PATTERNS])
