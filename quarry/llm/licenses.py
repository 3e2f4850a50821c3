"""Licence scans: notice phrases and identifier tags by Aho-Corasick, expressions of tags by a shunting-yard parser."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.chunks import slices
from quarry.llm.common import read, text_or_empty
from quarry.llm.words import LOWER, as_bytes, fold_table

# Phrases whose every place counts, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: More phrases of notices; where one lies within another, only the longer one counts.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "apache license 2 0": "apache-2.0",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "eclipse public license": "epl",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "cc by sa": "cc-by-sa",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by 4 0": "cc-by-4.0",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "cc0": "cc0",
    "cc0 1 0": "cc0-1.0",
    "released into the public domain": "public-domain",
    "dedicated to the public domain": "public-domain",
}

#: Tags that an expression follows, and whether identifiers of no known family are taken from it.
TAGS = {"spdx-license-identifier:": True, "license-expression:": True, "@license": False, "license:": False, 'license":': False, "licence:": False}

#: How much a label restricts use, from 0 to 1, by the beginning of the identifier: the longest that fits counts.
FAMILIES = {
    "public-domain": 0.1, "cc0": 0.1, "unlicense": 0.1, "0bsd": 0.1,
    "mit": 0.2, "apache": 0.2, "bsd": 0.2, "isc": 0.2, "zlib": 0.2, "python": 0.2, "psf": 0.2, "bsl": 0.2, "cc-by": 0.2, "ofl": 0.2, "unicode": 0.2, "artistic": 0.2,
    "mpl": 0.4, "lgpl": 0.4, "epl": 0.4, "cddl": 0.4, "odbl": 0.4,
    "gpl": 0.6, "cc-by-sa": 0.6, "eupl": 0.6,
    "agpl": 0.7, "sspl": 0.7,
    "cc-by-nc": 0.8, "cc-by-nd": 0.8,
    "reserved": 1.0,
}
UNKNOWN = 0.9
#: A linking exception leaves a strong copyleft no stricter than this.
EXCEPTED = 0.4
_EXCEPTION = re.compile(r"(?:^|-)(?:classpath|linking|gcc|llvm|openssl|bison|autoconf|font|syscall|libtool|runtime|universal-foss)")

_WORD, _BINDS = fold_table(), {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*(\(|\)|[a-z0-9](?:[a-z0-9.+:_-]*[a-z0-9+])?)")
#: What may stand between a tag and its expression.
_LEAD = re.compile(r"[ \t\"'=:\[]*")


def restriction(label: str) -> float:
    """How much a label restricts use: that of its family, or UNKNOWN."""
    cut = label
    while cut:
        if cut in FAMILIES:
            return FAMILIES[cut]
        cut = re.sub(r"(^|[-.+_])[^-.+_]*$", "", cut)
    return UNKNOWN


def to_postfix(tokens: Iterable[str]) -> tuple[list[str], int]:
    """The operands and operators of a licence expression in postfix order, and how many of tokens it takes.

    `with` binds closest, then `and`, then `or`; an exception is an operand of
    `with`. The longest run of tokens from the first that is an expression
    counts; [] and 0 if there is none. Reads no further than the first token
    that cannot follow.
    """
    out: list[str] = []
    held: list[str] = []
    whole = 0, [], 0  # of the longest expression: operands and operators put out, operators held, tokens
    operand, depth = True, 0  # what must come next, and open parentheses
    for n, token in enumerate(tokens, 1):
        if operand and token == "(":
            held.append(token)
            depth += 1
        elif operand and token not in _BINDS and token != ")":
            out.append(token)
            operand = False
        elif not operand and token in _BINDS:
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        elif not operand and token == ")" and depth:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
        else:
            break
        if not operand and not depth:
            whole = len(out), held[::-1], n
    return out[: whole[0]] + whole[1], whole[2]


def evaluate(postfix: list[str]) -> tuple[float, list[str]]:
    """How much an expression restricts use, and its labels: of alternatives the freest, of what applies together the strictest."""
    held: list[tuple[float, list[str]]] = []
    for token in postfix:
        if token not in _BINDS:
            held.append((restriction(token), [token]))
            continue
        (y, right), (x, left) = held.pop(), held.pop()
        if token == "with":
            held.append((min(x, EXCEPTED) if x < UNKNOWN and _EXCEPTION.search(right[0]) else x, left))
        else:
            held.append(((min if token == "or" else max)(x, y), left + right))
    return held.pop() if held else (0.0, [])


def expression(text: str, at: int = 0, any_identifier: bool = True) -> tuple[str, float, list[str]] | None:
    """The expression that begins at a place of text (lower case), how much it restricts use and its labels; None if there is none.

    Without any_identifier, it ends before an identifier of no known family.
    """
    read: list[str] = []

    def tokens() -> Iterator[str]:
        here = at
        while found := _TOKEN.match(text, here):
            here, token = found.end(), found[1]
            if not (any_identifier or token in _BINDS or token in "()" or read[-1:] == ["with"]) and restriction(token) == UNKNOWN:
                return
            read.append(token)
            yield token

    postfix, used = to_postfix(tokens())
    if not postfix:
        return None
    level, labels = evaluate(postfix)
    return " ".join(read[:used]).replace("( ", "(").replace(" )", ")"), level, labels


@cache
def _automata(base: tuple, notices: tuple, tags: tuple):
    phrases, marks = ahocorasick.Automaton(), ahocorasick.Automaton()
    both = dict.fromkeys([*dict(base), *dict(notices)])
    for phrase in both:
        words = " ".join(phrase.encode().translate(_WORD).decode("latin-1").split())
        phrases.add_word(f" {words} ", (len(words) + 2, words.count(" ") + 1, dict(base).get(phrase), dict(notices).get(phrase)))
    for tag, free in tags:
        marks.add_word(tag.encode().decode("latin-1"), (len(tag.encode()), free))
    phrases.make_automaton()
    marks.make_automaton()
    return phrases, marks


def findings(text: bytes, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: dict[str, bool] = TAGS) -> tuple[int, list[tuple]]:
    """The number of words of a text, and (kind, label, word, expression, restriction) of all that is found, by kind and place.

    kind: `base` and `notice` are phrases, `tag` an identifier of a tag's
    expression. word: where it begins, in words from 0.
    """
    phrases, marks = _automata(tuple(base.items()), tuple(notices.items()), tuple(tags.items()))
    low = text.translate(LOWER)
    words = low.translate(_WORD).split()
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found: list[tuple] = []
    own: list[tuple[int, int, str]] = []
    before, counted = 0, 0  # words that begin before a place of joined
    for end, (length, size, of_base, of_notice) in phrases.iter(joined):
        begin = end - length + 1
        before = before + joined.count(" ", counted, begin) if begin >= counted else joined.count(" ", 0, begin)
        counted = begin
        if of_base:
            found.append(("base", of_base, before, None, restriction(of_base)))
        if of_notice:
            own.append((before, before + size, of_notice))
    own.sort(key=lambda x: (x[0], -x[1]))
    reach = -1
    for begin, end, label in own:
        if end > reach:  # else it lies within one that began earlier
            found.append(("notice", label, begin, None, restriction(label)))
            reach = end
    if b"licen" in low:
        plain, told = low.decode("latin-1"), -1
        hits = sorted((end + 1 - length, end + 1, free) for end, (length, free) in marks.iter(plain))
        inside = np.r_[False, np.frombuffer(low.translate(_WORD), dtype=np.uint8) != 32]
        begun = np.cumsum(inside[1:] & ~inside[:-1])  # words that begin up to each byte
        for begin, end, free in hits:
            if begin < told:
                continue  # one tag within another
            told = end
            if parsed := expression(plain, _LEAD.match(plain, end).end(), free):
                place = int(begun[begin - 1]) if begin else 0
                found += [("tag", label, place, parsed[0], parsed[1]) for label in dict.fromkeys(parsed[2])]
    return len(words), found


FOUND = "array<struct<kind:string,label:string,word:long,expression:string,restriction:double>>"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("word", pa.int64()), ("expression", pa.string()), ("restriction", pa.float64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words long and found: all licences that each whole text names, see findings().

    One row for each of docs, also where they repeat an id. A null or empty text
    has no words and nothing found. Nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [f.name for f in _FOUND.value_type]
        for batch in batches:
            for part in slices(batch, "text"):
                each = [findings(t) for t in as_bytes(part.column("text"))]
                # identifiers are ASCII, as the patterns take no others
                rows = pa.array([[dict(zip(keys, f)) for f in found] for _, found in each], _FOUND)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.array([n for n, _ in each], dtype=np.int64)), rows], ["id", "n_words", "found"])

    out = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words long, found {FOUND}")
    return out.withColumnRenamed("id", id_col)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What licences every document names; score: how much the strictest of them restricts its use, 0 where it names none."""
    rows = scan(read(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["kind"] == "base")
    names = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")
    places = F.transform(base, lambda x: x["word"])
    strict = F.coalesce(F.array_max(F.transform("found", lambda x: x["restriction"])), F.lit(0.0))
    return rows.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), names(base).alias("base_labels"), names(F.col("found")).alias("labels"), strict.alias("score"))


QUERIES = {"op13_license_scan": op13_license_scan}
