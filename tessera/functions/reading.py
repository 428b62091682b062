"""What text read off a card says: set codes, numbers, serials and names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import matched

# Printed forms, marks of languages, and look-alikes of digits.
HYPHENATED = r"\b([A-Z]{2,4}[0-9]{0,2})[-–]([A-Z]{2})?([0-9]{1,4})\b"
SPACES = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
NUMBER_OVER_TOTAL = r"\b([0-9]{1,3})" + SPACES + r"*/" + SPACES + r"*([0-9]{1,3})\b"
BARE_CODE = r"\b([A-Z]{2,5})\b"
BARE_NUMBER = r"\b([0-9]{1,4})\b"
NOT_CODES = r"\b(THE|AND|FOR|INC|LTD|ILLUS|NM|EN|US)\b"
LANGUAGES = (("ja", r"\bJP\b|日本語|ポケモン"), ("de", r"(?i)\bDE\b|\bDeutsch\b"), ("fr", r"(?i)\bFR\b|\bFrançais\b"), ("es", r"(?i)\bES\b|\bEspañol\b"), ("it", r"(?i)\bIT\b|\bItaliano\b"))
LOOKS_LIKE, DIGITS = "OQDILSBZ", "00011582"
SERIAL_PREFIXES = "OP|ST|EB|PRB"
DASHES = "[–—−‐‑_]"
HYPHENATED_SERIAL = rf"(0P|{SERIAL_PREFIXES})([0-9{LOOKS_LIKE}]{{2}})-([0-9{LOOKS_LIKE}]{{3}})(?![0-9])"
JOINED_SERIAL = rf"({SERIAL_PREFIXES})([0-9]{{2}})([0-9]{{3}})(?![0-9])"
PROMO_SERIAL = r"(?:^|[^A-Z])P-([0-9]{3})(?![0-9])"
MIN_NAME_WORD = 4


def parse_corner(lines: Column) -> Column:
    """struct(set_code, number, set_total, language) of the lines of a card's corner.

    A hyphenated code comes first, then number/total (its number only if there is none yet), then a bare code that is
    no stop word, then a bare number; marks of a language count only if the number names none.
    """
    text = F.trim(F.regexp_replace(F.array_join(lines, " "), SPACES + "+", " "))
    upper = F.upper(text)
    code = F.coalesce(matched(upper, HYPHENATED, 1), matched(F.regexp_replace(upper, NOT_CODES, " "), BARE_CODE))
    number = F.coalesce(matched(upper, HYPHENATED, 3), matched(upper, NUMBER_OVER_TOTAL, 1), matched(upper, BARE_NUMBER))
    marked = F.when(text.rlike(LANGUAGES[0][1]), LANGUAGES[0][0])
    for name, pattern in LANGUAGES[1:]:
        marked = marked.when(text.rlike(pattern), name)
    language = F.coalesce(F.lower(matched(upper, HYPHENATED, 2)), marked)
    return F.struct(code.alias("set_code"), number.alias("number"), matched(upper, NUMBER_OVER_TOTAL, 2).alias("set_total"), language.alias("language"))


def fix_digits(s: Column) -> Column:
    return F.translate(s, LOOKS_LIKE, DIGITS)


def parse_serial_line(line: Column) -> Column:
    """The serial in one line: hyphenated (look-alikes of digits allowed), else unhyphenated, else a promotion's."""
    plain = F.regexp_replace(F.upper(line), SPACES + "+", "")
    compact = F.regexp_replace(F.regexp_replace(F.upper(line), DASHES, "-"), SPACES + "+", "")
    prefix = F.regexp_replace(F.regexp_extract(compact, HYPHENATED_SERIAL, 1), "^0P$", "OP")
    digits = [fix_digits(F.regexp_extract(compact, HYPHENATED_SERIAL, i)) for i in (2, 3)]
    joined = [F.regexp_extract(compact, JOINED_SERIAL, i) for i in (1, 2, 3)]
    return (
        F.when(compact.rlike(HYPHENATED_SERIAL), F.concat(prefix, digits[0], F.lit("-"), digits[1]))
        .when(compact.rlike(JOINED_SERIAL), F.concat(joined[0], joined[1], F.lit("-"), joined[2]))
        .when(plain.rlike(PROMO_SERIAL), F.concat(F.lit("P-"), F.regexp_extract(plain, PROMO_SERIAL, 1)))
    )


def parse_serial(lines: Column) -> Column:
    """The serial of the first line that has one."""
    return F.get(F.filter(F.transform(lines, parse_serial_line), lambda x: x.isNotNull()), F.lit(0))


def serial_for_game(game: Column, lines: Column) -> Column:
    """Only one game prints serials."""
    return F.when(game == "onepiece", parse_serial(lines))


def serial_set(serial: Column) -> Column:
    return F.split_part(serial, F.lit("-"), F.lit(1))


def compact_set_code(code: Column) -> Column:
    return F.regexp_replace(F.upper(code), f"{SPACES}|-", "")


def near_serial_patterns(serial: Column) -> Column:
    """The serial and, for each digit, the serial with that digit masked by _ ."""
    masked = F.transform(
        F.filter(F.sequence(F.lit(1), F.length(serial)), lambda i: F.substring(serial, i, F.lit(1)).rlike("[0-9]")),
        lambda i: F.concat(F.substring(serial, F.lit(1), i - 1), F.lit("_"), F.substring(serial, i + 1, F.length(serial))),
    )
    return F.when(F.length(serial) > 0, F.concat(F.array(serial), masked)).otherwise(F.array(serial))


def alphanumeric(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def contains_approximately(haystack: Column, needle: Column, edits: Column) -> Column:
    """Whether some part of the haystack is within so many edits of the needle.

    Parts from (length - edits) to (length + edits) signs are enough; levenshtein stops at its threshold.
    """
    n = F.length(needle)
    exact = haystack.contains(needle)

    def starts_at(i: Column) -> Column:
        return F.exists(F.sequence(F.greatest(F.lit(0), n - edits), n + edits), lambda k: F.levenshtein(F.substring(haystack, i, k), needle) <= edits)

    def cut(i: Column) -> Column:
        return F.floor(n * i / (edits + 1)).cast("int")

    # of (edits + 1) pieces of the needle one is whole in every such part: without any, nothing needs to be tried
    piece = F.exists(F.sequence(F.lit(0), edits), lambda i: haystack.contains(F.substring(needle, cut(i) + 1, cut(i + 1) - cut(i))))
    some = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(haystack))), starts_at)
    return exact | (n <= edits) | ((edits > 0) & piece & some)


def name_words(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: F.length(w) >= MIN_NAME_WORD)


def allowed_edits(word: Column) -> Column:
    return F.when(F.length(word) >= 8, 2).when(F.length(word) >= 5, 1).otherwise(0)


def pieces(word: Column, most: int) -> Column:
    """The beginnings, `most` signs at most, of (edits + 1) pieces of a word: with so many slips one piece stays whole."""
    edits, n = allowed_edits(word), F.length(word)
    cut = lambda i: F.floor(n * i / (edits + 1)).cast("int")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), edits), lambda i: F.substring(word, cut(i) + 1, F.least(cut(i + 1) - cut(i), F.lit(most)))))


def parts(line: Column, most: int) -> Column:
    """All parts of a line of 2 to `most` signs."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(line)))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.lit(most)), lambda k: F.transform(starts, lambda i: F.substring(line, i, k)))))


def name_similarity(lines: Column, name: Column) -> Column:
    """The share of a name's longer words that the lines have, longer ones with slips; 0 without such words."""
    words, plain = name_words(name), F.transform(lines, alphanumeric)
    found = F.filter(words, lambda w: F.exists(plain, lambda line: contains_approximately(line, w, allowed_edits(w))))
    return F.when(F.size(words) > 0, F.size(found) / F.size(words)).otherwise(F.lit(0.0))
