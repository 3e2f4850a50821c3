"""What may be asked, how heavy a question is, and what a transaction must bring along, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that change data, forms of queries, and weights and bands of complexity.
UPDATES = ("INSERT", "DELETE", "LOAD", "CLEAR", "CREATE", "DROP", "COPY", "MOVE", "ADD")
FORMS = ("SELECT", "ASK", "CONSTRUCT", "DESCRIBE")
JOINS, AGGREGATION, OPTIONAL, UNION, SUBQUERY = 2, 3, 2, 3, 4
BANDS = ((2, "Simple"), (6, "Moderate"), (10, "Complex"))
#: Rows and characters that a result may have.
MOST_ROWS, MOST_CHARS = 10_000, 10_000


def query_body(text: Column) -> Column:
    """A query without the comments, base and prefixes that it begins with."""
    return F.regexp_replace(text, r"(?i)\A(?:\s+|#[^\n]*(?:\n|\z)|(?:PREFIX\s+[^\s:]*:|BASE)\s*<[^>]*>)*", "")


def query_problem(text: Column, forms: tuple[str, ...] = FORMS) -> Column:
    """Why a query is refused, null if it is not: `update WORD` for a word that changes data, `form` for a form not among those allowed.

    Words count as such, outside of texts and IRIs, so that `?address` or
    "please add" are no reason.
    """
    bare = F.upper(F.regexp_replace(query_body(text), r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|<[^>\s]*>", " "))
    word = F.regexp_extract(bare, r"(?<![?$:\w])(" + "|".join(UPDATES) + r")(?![\w:])", 1)
    form = F.regexp_extract(bare, r"\A(\w+)", 1)
    return F.when(word != "", F.concat(F.lit("update "), word)).when(~form.isin(*forms), "form")


def query_features(text: Column) -> dict[str, Column]:
    """joins, aggregation, optional, union, subquery: what a query's text tells of its weight; score and level."""
    low = F.lower(text)
    times = lambda mark: F.length(low) - F.length(F.replace(low, F.lit(mark), F.lit("")))
    out = {
        "joins": low.contains("join") | (times(".") > 3),
        "aggregation": low.contains("count") | low.contains("sum") | low.contains("avg") | low.contains("group by"),
        "optional": low.contains("optional"),
        "union": low.contains("union"),
        "subquery": times("{") > 1,
    }
    score = sum((F.when(out[k], w).otherwise(0) for k, w in zip(out, (JOINS, AGGREGATION, OPTIONAL, UNION, SUBQUERY))), F.lit(0))
    level = F.when(F.lit(False), "")
    for most, name in BANDS:
        level = level.when(score <= most, name)
    return out | {"score": score, "level": level.otherwise("Very Complex")}


def result_problem(rows: Column, query: Column) -> Column:
    """Why a result or its query is too large to hand out, null if neither is."""
    return F.when(F.length(query) > MOST_CHARS, "query").when(rows > MOST_ROWS, "rows")


def required_signatures(kind: Column, largest_output: Column, test_type: Column) -> Column:
    """How many signatures a transaction needs: two for compliance, transfers of over 1000 and critical quality tests, else one."""
    critical = test_type.contains("REGULATORY") | test_type.contains("COMPLIANCE") | test_type.contains("CERTIFICATION")
    two = (kind == "Compliance") | ((kind == "Transfer") & (largest_output > 1000.0)) | ((kind == "Quality") & critical)
    return F.when(two, 2).otherwise(1)


def transaction_problem(kind: Column, inputs: Column, outputs: Column, test_type: Column, compliance: Column, signatures: Column) -> Column:
    """What a transaction breaks first: signatures, then what its kind must have; null if nothing.

    inputs: how many; outputs: an array of values. A transfer's outputs must sum
    up to as much as it has inputs, to within 0.001.
    """
    many, total = F.coalesce(F.size(outputs), F.lit(0)), F.aggregate(F.coalesce(outputs, F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)
    needed = required_signatures(kind, F.array_max(outputs), test_type)
    return (
        F.when(signatures < needed, "signatures")
        .when((kind == "Production") & (many == 0), "outputs")
        .when((kind == "Processing") & ((inputs == 0) | (many == 0)), "inputs and outputs")
        .when((kind == "Transfer") & (F.abs(inputs - total) > 0.001), "balance")
        .when((kind == "Quality") & test_type.isNull(), "quality data")
        .when((kind == "Compliance") & compliance.isNull(), "compliance info")
    )
