"""The quads table: its schema, N-Quads in and out, Turtle in, tables as quads."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarry.functions.terms import XSD, nt
from quarry.operators.ledger import rows_hash

SCHEMA = "g string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"
COLUMNS = ["g", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"

_TERM = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)'
_LINE = rf"^\s*{_TERM}\s+<([^>]*)>\s+{_TERM}\s*(?:<([^>]*)>)?\s*\.\s*(?:#.*)?$"


def _unescaped(c: Column) -> Column:
    out = F.replace(c, F.lit("\\\\"), F.lit("\u0000"))
    for mark, char in (("n", "\n"), ("t", "\t"), ("r", "\r"), ('"', '"')):
        out = F.replace(out, F.lit("\\" + mark), F.lit(char))
    return F.replace(out, F.lit("\u0000"), F.lit("\\"))


def _kind(term: Column) -> Column:
    return F.when(term.startswith("<"), "iri").when(term.startswith("_:"), "bnode").otherwise("literal")


def _value(term: Column) -> Column:
    literal = _unescaped(F.regexp_extract(term, r'^"((?:[^"\\]|\\.)*)"', 1))
    return F.when(term.startswith("<"), F.substring(term, F.lit(2), F.length(term) - 2)).when(term.startswith("_:"), F.substring(term, F.lit(3), F.length(term))).otherwise(literal)


def parse_nquads(lines: DataFrame, col: str = "value") -> DataFrame:
    """Quads of N-Quads or N-Triples lines, each a row; comments and blank or broken lines are left out, repeats too."""
    part = lambda i: F.regexp_extract(col, _LINE, i)
    s, o = part(1), part(3)
    data = F.nullif(F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1), F.lit(""))
    lang = F.nullif(F.regexp_extract(o, r'"@([A-Za-z0-9-]+)$', 1), F.lit(""))
    rows = lines.where(F.col(col).rlike(_LINE)).select(F.nullif(part(4), F.lit("")).alias("g"), _value(s).alias("s"), _kind(s).alias("s_kind"), part(2).alias("p"), _value(o).alias("o"), _kind(o).alias("o_kind"), data.alias("o_dt"), lang.alias("o_lang"))
    return rows.dropDuplicates()


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    """Line by line, so files split."""
    return parse_nquads(spark.read.text(path))


def render_nquads(quads: DataFrame) -> DataFrame:
    graph = F.when(F.col("g").isNull(), "").otherwise(F.concat(F.lit(" <"), F.col("g"), F.lit(">")))
    return quads.select(F.concat(nt("s", "s_kind"), F.lit(" <"), F.col("p"), F.lit("> "), nt("o", "o_kind", "o_dt", "o_lang"), graph, F.lit(" .")).alias("value"))


def write_nquads(quads: DataFrame, path: str) -> None:
    render_nquads(quads).write.text(path)


_TOKEN = re.compile(
    r'\s+|#[^\n]*|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*""")|(?P<text>"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')|(?P<iri><[^>\s]*>)|(?P<word>@[A-Za-z][A-Za-z0-9-]*|\^\^)|(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<name>_:[\w-]+|[\w-]*:[\w./-]*\w|[\w-]*:|\b(?:a|true|false|PREFIX|BASE)\b)|(?P<mark>[.;,\[\]()])'
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "'": "'", "\\": "\\"}


#: Tokens of Turtle that is made of IRIs, prefixed names, named blank nodes and plain texts; any other character is a token of its own.
_PLAIN = re.compile(r'<[^>\s]*>|"[^"\n]*"|_:[\w-]+|(?![\d-])(?:[\w-]*:[\w./-]*\w|[\w-]*:)|@prefix(?![\w-])|\S')


def _plain_triples(text: str) -> list[tuple] | None:
    """turtle_triples() of a document that is as plain as most are, told without looking further; None of any other."""
    if "\\" in text or "'" in text or '"""' in text:
        return None
    tokens, out, prefixes, known, i = _PLAIN.findall(text), [], {}, {}, 0
    tokens += [""] * 4

    def term(t: str) -> tuple | None:
        if t.startswith("_:"):
            found = (t[2:], "bnode")
        elif t[:1] in ("<", '"') and len(t) > 1:
            found = (t[1:-1], "iri" if t[0] == "<" else "literal")
        else:
            prefix, colon, local = t.partition(":")
            if not colon or prefix not in prefixes:
                return None
            found = (prefixes[prefix] + local, "iri")
        known[t] = found
        return found

    while tokens[i]:
        if tokens[i] == "@prefix":
            name, iri = tokens[i + 1], tokens[i + 2]
            if name[-1:] != ":" or len(name) > 1 and not name[:-1].replace("-", "_").isidentifier() or iri[:1] != "<" or len(iri) < 2 or tokens[i + 3] != ".":
                return None
            prefixes[name[:-1]] = iri[1:-1]
            known.clear()
            i += 4
            continue
        s = known.get(tokens[i]) or term(tokens[i])
        if not s or s[1] == "literal":
            return None
        mark = ";"
        while mark == ";":
            p, mark, i = known.get(tokens[i + 1]) or term(tokens[i + 1]), ",", i + 1
            if not p or p[1] != "iri":
                return None
            while mark == ",":
                o, mark, i = known.get(tokens[i + 1]) or term(tokens[i + 1]), tokens[i + 2], i + 2
                if not o:
                    return None
                out.append((*s, p[0], *o, None, None))
        if mark != ".":
            return None
        i += 1
    return out


def turtle_triples(text: str) -> list[tuple]:
    """(s, s_kind, p, o, o_kind, o_dt, o_lang) of a Turtle document; ValueError where it is none.

    Prefixes, bases, lists of predicates and objects, blank nodes, collections,
    numbers, booleans, texts with data type or language.
    """
    found = _plain_triples(text)
    return _any_triples(text) if found is None else found


def _any_triples(text: str) -> list[tuple]:
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"Turtle: {text[at : at + 20]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    prefixes, base, out, blank, i = {}, "", [], 0, 0

    def take(want: str | None = None):
        nonlocal i
        if i >= len(tokens) or want and tokens[i][1] != want:
            raise ValueError(f"Turtle: {want or 'a term'} expected")
        i += 1
        return tokens[i - 1]

    def peek() -> str:
        return tokens[i][1] if i < len(tokens) else ""

    def iri(token) -> str:
        kind, v = token
        if kind == "iri":
            return v[1:-1] if ":" in v else base + v[1:-1]
        prefix, _, local = v.partition(":")
        if kind != "name" or prefix not in prefixes:
            raise ValueError(f"Turtle: unknown prefix in {v}")
        return prefixes[prefix] + local

    def fresh() -> tuple:
        nonlocal blank
        blank += 1
        return (f"b{blank}", "bnode", None, None)

    def term() -> tuple:
        kind, v = take()
        if v == "[":
            node = fresh()
            if peek() != "]":
                properties(node)
            take("]")
            return node
        if v == "(":
            items = []
            while peek() != ")":
                items.append(term())
            take(")")
            rest = (RDF + "nil", "iri", None, None)
            for item in reversed(items):
                node = fresh()
                out.append((node, RDF + "first", item))
                out.append((node, RDF + "rest", rest))
                rest = node
            return rest
        if kind == "number":
            return (v, "literal", XSD + ("double" if "e" in v.lower() else "decimal" if "." in v else "integer"), None)
        if v in ("true", "false"):
            return (v, "literal", XSD + "boolean", None)
        if kind in ("text", "long"):
            n = 3 if kind == "long" else 1
            value = re.sub(r"\\u([0-9A-Fa-f]{4})|\\(.)", lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPES[m[2]], v[n:-n], flags=re.DOTALL)
            if peek().startswith("@"):
                return (value, "literal", RDF + "langString", take()[1][1:])
            if peek() == "^^":
                take()
                return (value, "literal", iri(take()), None)
            return (value, "literal", None, None)
        if v.startswith("_:"):
            return (v[2:], "bnode", None, None)
        return (iri((kind, v)), "iri", None, None)

    def properties(node: tuple) -> None:
        while True:
            verb = take()
            p = RDF + "type" if verb[1] == "a" else iri(verb)
            while True:
                out.append((node, p, term()))
                if peek() != ",":
                    break
                take()
            while peek() == ";":
                take()
            if peek() in (".", "]", "") or tokens[i - 1][1] != ";":
                return

    while i < len(tokens):
        if peek().lower() in ("@prefix", "prefix", "@base", "base"):
            word = take()[1]
            if "prefix" in word.lower():
                name = take()[1]
                prefixes[name[:-1]] = take()[1][1:-1]
            else:
                base = take()[1][1:-1]
            if word.startswith("@"):
                take(".")
            continue
        node = term()
        if peek() != ".":
            properties(node)
        take(".")
    return [(s[0], s[1], p, o[0], o[1], o[2], o[3]) for s, p, o in out]


def _turtle_rows(g: str | None, text: str | None, strict: bool, raw_predicate: str) -> list[tuple]:
    try:
        return turtle_triples(text or "")
    except (ValueError, KeyError):
        if strict:
            raise
        return [(g or "urn:quarry:document", "iri", raw_predicate, text, "literal", None, None)]


def parse_turtle(files: DataFrame, text: str = "text", graph: str = "g", strict: bool = False, raw_predicate: str = "urn:quarry:hasData") -> DataFrame:
    """Quads of Turtle documents, each into its row's graph; blank nodes are told apart by graph.

    A document that does not parse is one quad that holds it as a literal, or an error if strict.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(g, *row) for g, t in zip(batch["g"], batch["t"]) for row in _turtle_rows(g, t, strict, raw_predicate)]
            yield pd.DataFrame(out, columns=COLUMNS)

    return files.select(F.col(graph).alias("g"), F.col(text).alias("t")).mapInPandas(run, SCHEMA).dropDuplicates()


def turtle_hashes(files: DataFrame, text: str = "text", graph: str = "g", strict: bool = False, raw_predicate: str = "urn:quarry:hasData") -> DataFrame:
    """files with triples and hash instead of text: of parse_turtle() the count and graph_hash(), where a document is all of its graph. It stays in its row."""
    kept = [c for c in files.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            told = [(len(rows), rows_hash(rows)) for rows in (dict.fromkeys(_turtle_rows(g, t, strict, raw_predicate)) for g, t in zip(column(graph).to_pylist(), column(text).to_pylist()))]
            yield pa.record_batch([*map(column, kept), pa.array([n for n, _ in told], pa.int64()), pa.array([h for _, h in told], pa.string())], [*kept, "triples", "hash"])

    return files.mapInArrow(run, StructType([*[files.schema[c] for c in kept], StructField("triples", LongType()), StructField("hash", StringType())]))


def read_turtle(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Turtle files, a graph for each, named by its path."""
    return parse_turtle(spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("g")), strict=strict)


def as_quads(df: DataFrame, subject: Column, predicates: dict[str, tuple[Column, str, str | None]], graph: Column | None = None) -> DataFrame:
    """A table as quads: predicates maps an IRI to a column, its kind and its data type. Null values make no quad."""
    rows = F.array(*[F.struct(F.lit(p).alias("p"), c.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("o_dt")) for p, (c, kind, dt) in predicates.items()])
    g = (graph if graph is not None else F.lit(None)).cast("string")
    return df.select(g.alias("g"), subject.alias("s"), F.explode(rows).alias("x")).where("x.o is not null").select("g", "s", F.lit("iri").alias("s_kind"), "x.p", "x.o", "x.o_kind", "x.o_dt", F.lit(None).cast("string").alias("o_lang"))
