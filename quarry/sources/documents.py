"""RDF documents of any format: which it is, RDF/XML, one parser after another, and graphs back to Turtle."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.terms import nt
from quarry.sources.quads import _LINE, COLUMNS, RDF, SCHEMA, parse_nquads, turtle_triples

# Prefixes that normalised Turtle declares, and those of exported graphs.
REQUIRED = {"rdf": RDF, "rdfs": "http://www.w3.org/2000/01/rdf-schema#"}
EXPORTED = {"ex": "http://example.org/", "rdf": RDF, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#"}

#: Quads that a task holds before it hands them on; a document's own are held together.
ROWS_AT_A_TIME = 10_000

_XML = "{http://www.w3.org/XML/1998/namespace}"


def rdf_format(text: Column, path: Column) -> Column:
    """turtle, rdfxml, ntriples or nquads: told by what a document holds, and only then by the end of its path."""
    bare = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    by_line = F.forall(lines, lambda x: (x == "") | x.startswith("#") | x.endswith(" ."))
    end = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    xml = text.contains("<?xml") | text.contains("<rdf:RDF")
    named = F.when(end.isin("owl", "rdf", "xml") & xml, "rdfxml").when(end == "nt", "ntriples").when(end == "nq", "nquads").otherwise("turtle")
    return F.when(bare.startswith("@base") | text.contains("@prefix"), "turtle").when(bare.startswith("<?xml") | text.contains("<rdf:RDF"), "rdfxml").when(by_line, "ntriples").otherwise(named)


def normalized_turtle(text: Column) -> Column:
    """Turtle with the required prefixes declared, and names with slashes (p:a/b) written out where their prefix is declared."""
    missing = F.concat_ws("\n", *[F.when(~text.contains(f"@prefix {p}:"), F.lit(f"@prefix {p}: <{iri}> .")) for p, iri in REQUIRED.items()])
    whole = F.when(missing == "", text).otherwise(F.concat(missing, F.lit("\n"), text))
    declared = r"@prefix\s+([A-Za-z][\w-]*):\s*<([^>]+)>\s*\."
    names, spaces = F.regexp_extract_all(whole, F.lit(declared), 1), F.regexp_extract_all(whole, F.lit(declared), 2)
    literal = lambda c: F.regexp_replace(c, r"([\\$])", r"\\$1")
    each = F.arrays_zip(names.alias("name"), spaces.alias("space"))
    return F.aggregate(each, whole, lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"\b"), p["name"], F.lit(r":([A-Za-z0-9._~-]+(?:/[A-Za-z0-9._~-]+)+)\b")), F.concat(F.lit("<"), literal(p["space"]), F.lit("$1>"))))


def ntriples(text: str) -> list[tuple]:
    """(s, s_kind, p, o, o_kind, o_dt, o_lang) of an N-Triples document; ValueError where a line is none."""
    out = []
    line = re.compile(_LINE)
    for row in text.splitlines():
        if not row.strip() or row.lstrip().startswith("#"):
            continue
        if not (m := line.match(row)) or m[4] or m[1].startswith('"'):
            raise ValueError(f"N-Triples: {row[:40]!r}")
        (s,), (o,) = (turtle_triples(f"<urn:s> <urn:p> {t} .") for t in (m[1], m[3]))
        out.append((s[3], s[4], m[2], *o[3:]))
    return out


def rdfxml(text: str) -> list[tuple]:
    """(s, s_kind, p, o, o_kind, o_dt, o_lang) of an RDF/XML document; ValueError where it is none.

    Typed nodes, about, ID, nodeID, attributes as properties, resource, datatype,
    language, li, and the parse types Resource, Collection and Literal.
    """
    try:
        root = ET.fromstring(text.strip())
    except ET.ParseError as e:
        raise ValueError(f"RDF/XML: {e}") from e
    r = "{" + RDF + "}"
    iri = lambda tag: tag[1:].replace("}", "", 1) if tag[0] == "{" else tag
    out, blank = [], 0

    def fresh() -> tuple:
        nonlocal blank
        blank += 1
        return (f"x{blank}", "bnode")

    def against(base: str, v: str) -> str:
        if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", v) or not base:
            return v
        return base.split("#")[0] + v if v.startswith("#") or not v else re.sub(r"[^/]*$", "", base.split("#")[0]) + v

    def add(s: tuple, p: str, o: tuple) -> None:
        out.append((s[0], s[1], p, *o))

    def node(e, base: str, lang: str | None) -> tuple:
        base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang)
        if (v := e.get(r + "about")) is not None:
            s = (against(base, v), "iri")
        elif (v := e.get(r + "ID")) is not None:
            s = (against(base, "#" + v), "iri")
        else:
            s = (e.get(r + "nodeID"), "bnode") if e.get(r + "nodeID") is not None else fresh()
        if e.tag != r + "Description":
            add(s, RDF + "type", (iri(e.tag), "iri", None, None))
        for k, v in e.attrib.items():
            if k == r + "type":
                add(s, RDF + "type", (against(base, v), "iri", None, None))
            elif not k.startswith((r, _XML)):
                add(s, iri(k), (v, "literal", RDF + "langString" if lang else None, lang or None))
        properties(e, s, base, lang)
        return s

    def properties(e, s: tuple, base: str, lang: str | None) -> None:
        counted = 0
        for p in e:
            b, la = p.get(_XML + "base", base), p.get(_XML + "lang", lang)
            name = iri(p.tag)
            if p.tag == r + "li":
                counted += 1
                name = f"{RDF}_{counted}"
            kind = p.get(r + "parseType")
            if kind == "Resource":
                o = fresh()
                add(s, name, (*o, None, None))
                properties(p, o, b, la)
            elif kind == "Collection":
                cells = [(node(x, b, la), fresh()) for x in p]
                add(s, name, (*(cells[0][1] if cells else (RDF + "nil", "iri")), None, None))
                for i, (item, cell) in enumerate(cells):
                    add(cell, RDF + "first", (*item, None, None))
                    add(cell, RDF + "rest", (*(cells[i + 1][1] if i + 1 < len(cells) else (RDF + "nil", "iri")), None, None))
            elif kind == "Literal":
                add(s, name, ((p.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in p), "literal", RDF + "XMLLiteral", None))
            elif p.get(r + "resource") is not None:
                add(s, name, (against(b, p.get(r + "resource")), "iri", None, None))
            elif p.get(r + "nodeID") is not None:
                add(s, name, (p.get(r + "nodeID"), "bnode", None, None))
            elif len(p):
                add(s, name, (*node(p[0], b, la), None, None))
            else:
                dt = p.get(r + "datatype")
                add(s, name, (p.text or "", "literal", against(b, dt) if dt else RDF + "langString" if la else None, la if la and not dt else None))

    if root.tag == r + "RDF":
        for e in root:
            node(e, root.get(_XML + "base", ""), root.get(_XML + "lang"))
    else:
        node(root, "", None)
    return out


PARSERS = {"turtle": turtle_triples, "ntriples": ntriples, "rdfxml": rdfxml}


def parse_documents(files: DataFrame, text: str = "text", graph: str = "g", order: tuple[str, ...] = ("turtle", "ntriples", "rdfxml"), strict: bool = False, raw_predicate: str = "urn:quarry:hasData") -> tuple[DataFrame, DataFrame]:
    """Quads of documents, each into its row's graph, and (g, format, triples) of each: the first parser in order that takes it.

    A document that none takes is one quad that holds it as a literal, of format
    raw with its lines that are neither empty nor comments nor declarations as
    triples; an error if strict. A null document is an empty one. A document is
    parsed in one task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for batch in batches:
            for g, t in zip(batch["g"], batch["t"]):
                if len(out) >= ROWS_AT_A_TIME:
                    yield pd.DataFrame(out, columns=[*COLUMNS, "format", "lines"])
                    out = []
                t, rows = t or "", None
                for kind in order:
                    try:
                        rows = PARSERS[kind](t)
                    except (ValueError, KeyError, RecursionError):
                        continue
                    out += [(g, *row, kind, None) for row in dict.fromkeys(rows)] or [(g, *[None] * 7, kind, 0)]
                    break
                if rows is None:
                    if strict:
                        raise ValueError(f"no parser takes the document of {g}")
                    lines = sum(1 for x in t.splitlines() if x.strip() and not x.strip().startswith(("#", "@prefix", "@base")))
                    out.append((g, g or "urn:quarry:document", "iri", raw_predicate, t, "literal", None, None, "raw", lines))
        yield pd.DataFrame(out, columns=[*COLUMNS, "format", "lines"])

    rows = files.select(F.col(graph).alias("g"), F.col(text).alias("t")).mapInPandas(run, f"{SCHEMA}, format string, lines long")
    counts = rows.groupBy("g", "format").agg(F.coalesce(F.sum("lines"), F.count("s")).alias("triples"))
    return rows.where("s is not null").select(*COLUMNS).dropDuplicates(), counts


def read_documents(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """parse_documents() of files, a graph for each, named by its path. Files split among tasks whole."""
    return parse_documents(spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("g")), strict=strict)


def _short(term: Column, kind: Column, prefixes: dict[str, str]) -> Column:
    """term, an IRI in angle brackets, by the first prefix that leaves a plain local name."""
    out = F.when(F.lit(False), F.lit(""))
    for p, iri in prefixes.items():
        rest = F.substring(term, F.lit(len(iri) + 2), F.length(term) - len(iri) - 2)
        out = out.when((kind == "iri") & term.startswith("<" + iri) & rest.rlike(r"^[A-Za-z0-9_]+\z"), F.concat(F.lit(p + ":"), rest))
    return out.otherwise(term)


def turtle_documents(quads: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """g, text: each named graph as a Turtle document, a subject's predicates and objects together, all in order.

    The prefixes are declared first, and shorten what they fit. A graph's triples
    are gathered once and are one row, so graphs should be of block size
    (write_turtle() has no such bound).
    """
    term = F.struct(nt("s", "s_kind").alias("s"), F.col("s_kind"), F.col("p"), nt("o", "o_kind", "o_dt", "o_lang").alias("o"), F.col("o_kind"))
    rows = quads.where("g is not null").groupBy("g").agg(F.collect_set(term).alias("terms"))
    return turtle_texts(rows, "terms", prefixes).select("g", "text")


def turtle_texts(graphs: DataFrame, terms: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """graphs with text: the triples of its array terms as a Turtle document.

    terms: s and o in the form of N-Triples, s_kind, p, o_kind. Triples are sorted
    by what is written of them, and each writes what the one before it has not.
    """
    prefixes = EXPORTED if prefixes is None else prefixes
    head = "".join(f"@prefix {p}: <{iri}> .\n" for p, iri in prefixes.items())
    short = lambda term, kind: _short(term, kind, prefixes)
    spaced = lambda term: F.concat(term, F.lit(" "))
    plain = F.transform(terms, lambda x: F.struct(spaced(short(x["s"], x["s_kind"])).alias("s"), spaced(short(F.concat(F.lit("<"), x["p"], F.lit(">")), F.lit("iri"))).alias("p"), short(x["o"], x["o_kind"]).alias("o")))
    whole = F.filter(plain, lambda x: x["s"].isNotNull() & x["p"].isNotNull() & x["o"].isNotNull())
    at = "_".join(["sorted", *graphs.columns])  # a name that graphs does not have

    def piece(x: Column, i: Column) -> Column:
        before, after = F.get(at, i - 1), F.get(at, i + 1)
        start = F.when((before["s"] == x["s"]) & (before["p"] == x["p"]), F.lit(" , ")).when(before["s"] == x["s"], F.concat(F.lit(" ;\n    "), x["p"])).otherwise(F.concat(x["s"], x["p"]))
        return F.concat(start, x["o"], F.when(after["s"] == x["s"], F.lit("")).otherwise(F.lit(" .\n")))

    text = F.concat(F.lit(head + "\n" if head else ""), F.array_join(F.transform(at, piece), ""))
    return graphs.withColumn(at, F.sort_array(F.array_distinct(whole))).withColumn("text", text).drop(at)


def write_turtle(quads: DataFrame, path: str) -> None:
    """Quads as Turtle files of one triple a line: a folder for each graph, of any size, each file a document by itself.

    Rows are dealt by ranges of graph and subject, so that large graphs are
    written by many tasks and each subject lies in one file.
    """
    line = F.concat(nt("s", "s_kind"), F.lit(" <"), F.col("p"), F.lit("> "), nt("o", "o_kind", "o_dt", "o_lang"), F.lit(" ."))
    rows = quads.select(F.coalesce("g", F.lit("default")).alias("g"), "s", line.alias("value")).distinct()
    rows.repartitionByRange("g", "s").sortWithinPartitions("g", "s", "value").select("g", "value").write.partitionBy("g").text(path)


def read_turtle_lines(spark: SparkSession, path: str) -> DataFrame:
    """What write_turtle() wrote: files split, as a line is a triple."""
    lines = spark.read.text(path)  # with g, from the folders' names
    graph = F.when(F.col("g") != "default", F.concat(F.lit(" <"), F.col("g"), F.lit("> ."))).otherwise(" .")
    return parse_nquads(lines.select(F.concat(F.regexp_replace("value", r" \.\z", ""), graph).alias("value")))

