"""Text similarity and clean-up as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters by phonetic code (fixed values).
CODES = {"BFPV": "1", "CGJKQSXZ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6"}


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / bytes of the longer; 1 for two empty texts."""
    size = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(size == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / size)


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; 1 for two texts without words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    x, y = words(a), words(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(both / (F.size(x) + F.size(y) - both))


def phonetic(c: Column) -> Column:
    """First letter and three codes; any letter without a code, H and W too, parts equal codes. 0000 without letters."""
    letters = F.upper(F.regexp_replace(c, "[^A-Za-z]", ""))
    source = "".join(CODES) + "AEIOUYHW"
    target = "".join(code * len(group) for group, code in CODES.items()) + "0" * 8
    coded = F.translate(letters, source, target)
    runs = F.regexp_replace(coded, r"(.)\1+", "$1")
    rest = F.replace(F.substring(runs, 2, 1_000_000), F.lit("0"), F.lit(""))
    return F.when(F.coalesce(F.length(letters), F.lit(0)) == 0, "0000").otherwise(F.substring(F.concat(F.substring(letters, 1, 1), rest, F.lit("000")), 1, 4))


def sanitized(c: Column, limit: int | None = None, replacements: dict[str, str] | None = None) -> Column:
    """Without tags and control characters, lower-cased, white space collapsed, cut to whole characters within limit bytes.

    A tag runs from < to the next >, or to the end; a > that ends none goes, too.
    All control characters but line ends and tabs go, those of U+0080 to U+009F as well.
    """
    bare = F.regexp_replace(c, "<[^>]*(?:>|\\z)|>", "")
    bare = F.regexp_replace(bare, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")
    for old, new in (replacements or {}).items():
        bare = F.replace(bare, F.lit(old), F.lit(new))
    clean = F.trim(F.regexp_replace(F.lower(bare), r"[\t\r\n \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+", " "))
    if limit is None:
        return clean
    # what is left of a character that the cut parts is no valid end
    cut = F.substring(F.encode(clean, "UTF-8"), 1, limit)
    return F.when(F.octet_length(clean) <= limit, clean).otherwise(F.decode(F.substring(cut, F.lit(1), F.length(cut) - F.length(F.regexp_extract(F.hex(cut), "((?:F[0-7](?:[89AB][0-9A-F]){0,2}|E[0-9A-F](?:[89AB][0-9A-F])?|[CD][0-9A-F])?)$", 1)) / 2), "UTF-8"))


def slug(c: Column) -> Column:
    return F.replace(F.replace(F.lower(c), F.lit(" "), F.lit("-")), F.lit("."), F.lit(""))


def safe_identifier(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_-]+", "-")


def midnight(c: Column) -> Column:
    """YYYYMMDD or YYYY-MM-DD as the first moment of the day; null for anything else."""
    day = F.when(c.rlike(r"^\d{8}$"), F.try_to_date(c, "yyyyMMdd")).when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00Z"))


def first_filled(*cols: Column) -> Column:
    """The first that is not null or blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])
