"""op13: base phrases against brute force, tags and expressions against worked cases."""

import random
import re

from quarry.llm import licenses as L

SCHEMA = "doc_id long, text string, n_words long, found string, label string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(t):
    w = words(t)
    found = [(i, label) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")) for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def texts():
    rng = random.Random(1)
    parts = ["CC", "by", "-", ".\n", "General", "PUBLIC", "license", "all", "Rights", "reserved", "İ", "é", "x", "2", " ", "\x00", "ccby", "日本"]
    out = ["".join(rng.choice(parts) + rng.choice([" ", "", "\n", ", "]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return out + [None, "", " ", "cc by", "cc by cc by cc by", "all rights reserved", "all rights\n\nreserved, " * 5000, "cc" * 9, "CC-BY-NC", "xcc by", "cc by x" * 3, "long " * 20_000 + "cc by"]


def test_base_phrases(spark, tmp_path):
    rows = [(i, t, 1, "f", "l") for i, t in enumerate(texts())] + [(0, "cc by", 1, None, None), (None, "all rights reserved", None, None, None), (None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op13_license_scan(spark, str(tmp_path))
    assert [c for c, _ in got.dtypes] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    found = got.collect()
    assert sorted(((r["doc_id"], *r[1:6]) for r in found), key=repr) == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    for r in found:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_empty(spark):
    assert L.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_expressions():
    of = lambda t, free=True: (lambda e: e and (e[1], sorted(set(e[2]))))(L.expression(t, any_identifier=free))
    assert of("mit") == (0.2, ["mit"])
    assert of("mit or gpl-3.0-only and agpl-3.0") == (0.2, ["agpl-3.0", "gpl-3.0-only", "mit"])
    assert of("(mit or gpl-3.0-only) and agpl-3.0") == (0.7, ["agpl-3.0", "gpl-3.0-only", "mit"])
    assert of("gpl-2.0-or-later with classpath-exception-2.0 and mit") == (0.4, ["gpl-2.0-or-later", "mit"])
    assert of("gpl-2.0-or-later with odd-thing") == (0.6, ["gpl-2.0-or-later"])
    assert of("cc-by-nc-4.0 or cc-by-sa-4.0") == (0.6, ["cc-by-nc-4.0", "cc-by-sa-4.0"])
    assert of("licenseref-own and cc0-1.0") == (0.9, ["cc0-1.0", "licenseref-own"])
    assert of("see the file", free=False) is None and of("see the file") == (0.9, ["see"])
    assert of("(mit") is None and of("and mit") is None and of(")") is None and of("") is None
    assert of("mit or (gpl") == (0.2, ["mit"]) and of("mit)") == (0.2, ["mit"]) and of("mit or") == (0.2, ["mit"])
    assert L.expression("((mit) or isc)*/")[0] == "((mit) or isc)"
    assert L.expression("(" * 3000 + "mit" + ")" * 3000)[1] == 0.2


def test_tags_and_notices():
    found = lambda t: sorted({(kind, label, word) for kind, label, word, *_ in L.findings(t.encode())[1]})
    assert found("x y\n// SPDX-License-Identifier: MIT OR Apache-2.0\nz") == [("tag", "apache-2.0", 2), ("tag", "mit", 2)]
    assert found('{"license": "ISC"}') == [("tag", "isc", 0)]
    assert found("License: see below") == []
    assert found("Licensed under the Apache License, Version 2.0.") == [("notice", "apache-2.0", 3)]
    assert found("the GNU General Public License, version 3.") == [("base", "gpl", 2), ("notice", "gpl-3.0", 1)]
    assert found("Released under the MIT License.") == [("notice", "mit", 3)]
    assert found("under CC BY-NC 4.0.") == [("base", "cc-by", 1), ("notice", "cc-by-nc-4.0", 1)]
    assert found("license: license: mit licence: isc") == [("tag", "isc", 3), ("tag", "mit", 1)]
    assert len(L.findings(b"license: mit or " * 30_000)[1]) == 30_000  # in time that grows with the text
