"""RDF terms as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"


def nt(value: Column | str, kind: Column | str, datatype: Column | str | None = None, lang: Column | str | None = None) -> Column:
    """The N-Triples form of a term."""
    v, kind, datatype, lang = (F.col(c) if isinstance(c, str) else c for c in (value, kind, datatype, lang))
    text = F.concat(F.lit('"'), F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    out = F.when(kind == "iri", F.concat(F.lit("<"), v, F.lit(">"))).when(kind == "bnode", F.concat(F.lit("_:"), v)).when(kind == "triple", v)
    if lang is not None:
        out = out.when(lang.isNotNull(), F.concat(text, F.lit("@"), lang))
    if datatype is not None:
        out = out.when(datatype.isNotNull() & (datatype != XSD + "string"), F.concat(text, F.lit("^^<"), datatype, F.lit(">")))
    return out.otherwise(text)


def nt_text(value: str, kind: str, datatype: str | None = None, lang: str | None = None) -> str:
    """nt() of one term."""
    if kind == "iri":
        return f"<{value}>"
    if kind in ("bnode", "triple"):
        return f"_:{value}" if kind == "bnode" else value
    if "\\" in value or '"' in value or "\n" in value:
        value = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    return f'"{value}"@{lang}' if lang is not None else f'"{value}"' if datatype is None or datatype == XSD + "string" else f'"{value}"^^<{datatype}>'


def local_name(iri: Column) -> Column:
    """What follows the last # of an IRI, or else its last /."""
    return F.element_at(F.split(iri, "[#/]"), -1)


def namespace(iri: Column) -> Column:
    """What stands before the first # of an IRI, or else before its last /."""
    return F.when(iri.contains("#"), F.substring_index(iri, "#", 1)).when(iri.contains("/"), F.regexp_extract(iri, "^(.*)/[^/]*$", 1)).otherwise(iri)
