"""Rules for the fields of a record: which of them a value breaks first, whether a range of days can be asked for, which shard a key falls to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of well-formed fields, of which a value must match the whole.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"
USERNAME = r"^[a-zA-Z0-9_-]{3,32}\z"
BATCH_ID = r"^[A-Z0-9]{3,20}\z"
URI = r"^https?://[^\s/$.?#].[^\s]*\z|^[a-zA-Z][a-zA-Z0-9+.-]*:[^\s]*\z"
# Patterns that no value may hold.
INJECTION = (r"(?i)(union|select|insert|update|delete|drop|create|alter|exec|execute)", r"(?i)(script|javascript|vbscript|onload|onerror)", r"""['";]""")


def required(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def shorter(c: Column, least: int) -> Column:
    return F.octet_length(c) < least


def longer(c: Column, most: int) -> Column:
    return F.octet_length(c) > most


def unlike(c: Column, pattern: str) -> Column:
    return ~c.rlike(pattern)


def injected(c: Column) -> Column:
    return c.rlike(INJECTION[0]) | c.rlike(INJECTION[1]) | c.rlike(INJECTION[2])


def scripted(c: Column) -> Column:
    """Whether a value holds a sign of markup, or `script` in lower case."""
    return c.contains("<") | c.contains(">") | c.contains("script")


def first_broken(**rules: Column) -> Column:
    """The name of the first rule that is broken, null if none is.

    A rule is a condition that holds where it is broken. One that is null, as
    all but `required` are of a null value, counts as kept. Lengths are of bytes.
    """
    out = F.when(F.lit(False), F.lit(""))
    for name, broken in rules.items():
        out = out.when(broken, F.lit(name))
    return out


def range_problem(start: Column, end: Column, today: Column) -> Column:
    """Why a range of days (YYYY-MM-DD, both ends included) can't be asked for on a day, null if it can.

    An end that is null or no date is its own problem. A range is to begin a
    year from today at the latest, to end five years ago at the earliest, and to
    span two years at most (365 days each).
    """
    day = lambda c: F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}\z"), c.try_cast("date"))
    a, b = day(start), day(end)
    return first_broken(start=a.isNull(), end=b.isNull(), order=a > b, future=F.datediff(a, today) > 365, past=F.datediff(today, b) > 365 * 5, span=F.datediff(b, a) > 365 * 2)


def hash_shard(key: Column, shards: int) -> Column:
    """Spread evenly by the first 32 bits of the key's MD5; null keys as empty ones."""
    return F.conv(F.substring(F.md5(F.coalesce(key, F.lit(""))), 1, 8), 16, 10).cast("long") % shards


def range_shard(key: Column, shards: int) -> Column:
    """By the first letter from a to z in equal ranges; what comes before goes with a, what comes after with z, empty and null with a."""
    letter = F.ascii(F.when(F.length(key) > 0, key).otherwise("a")) - ord("a")
    return F.greatest(F.least(F.floor(letter / max(26 // shards, 1)), F.lit(shards - 1)), F.lit(0)).cast("long")


def composite_shard(key: Column, shards: int) -> Column:
    return (hash_shard(key, shards) + range_shard(key, shards)) % shards
