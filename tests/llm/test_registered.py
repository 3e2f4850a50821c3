"""The registered corpus queries: SQL where there is any, contract columns on small odd tables, and the pipeline end to end."""

import os
import re

import duckdb
import pytest

import corpus_pipeline
from quarry.llm import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("conversations", "documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    result = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in result.fetchall())
    assert want and sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == want


CONTRACTS = {
    "op1_winnowing": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op2_embedding_neardup": ["vec_id", "n_links", "component_id", "kept"],
    "op3_bpe_round_trip": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_simhash": ["doc_id", "fingerprint", "component_id"],
    "op6_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op7_suffix_array_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op8_ppm_score": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op10_line_dedup": ["doc_id"],
    "op11_source_divergence": ["lang", "source", "part", "item", "value", "rank"],
    "op12_lexical_search": ["item_id", "rank", "doc_id", "score"],
    "op13_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
}
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key string, row int"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables with nulls, an empty text, copies, a null id and columns with clashing names."""
    where = str(tmp_path_factory.mktemp("small"))
    line = "one two three four five six seven eight nine ten"
    texts = [line, line, f"{line}\nanother line of its own", "", None, "short", "You are a stupid idiot and I hate you", "All rights reserved. " * 3, "naïve 日本語 " * 30, "x" * 300]
    docs = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or ""), "k", 1) for i, t in enumerate(texts)] + [(None, line, "en", None, 0, None, None)]
    spark.createDataFrame(docs, DOCUMENTS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 6), "k") for i in range(8)], "doc_id long, quality int, toxic int, key string").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(0, "two three nothing"), (1, None), (2, "All rights")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [1.0, 0.0], None)], "vec_id long, embedding array<float>, label int").write.parquet(f"{where}/embeddings.parquet")
    return where


@pytest.mark.parametrize("name", CONTRACTS)
def test_contract_columns(spark, small, name):
    df = registry.queries()[name](spark, small)
    assert df.columns[: len(CONTRACTS[name])] == CONTRACTS[name]
    rows = df.collect()
    if name.startswith(("op11", "op12")):
        assert rows
    elif name.startswith("op6"):
        assert {r["doc_id"] for r in rows} == {None, *range(10)}
    else:
        assert len(rows) == (5 if name.startswith("op2") else 11)
    if name == "op2_embedding_neardup":
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows} == {0: (1, 0, True), 1: (1, 0, False), 2: (0, 2, True), 3: (0, 3, True), 4: (0, 4, True)}
    if name == "op4_simhash":
        assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in rows)


@pytest.mark.parametrize("name", CONTRACTS)
def test_no_documents(spark, tmp_path, small, name):
    for table in ("documents", "labels", "benchmark", "embeddings"):
        spark.read.parquet(f"{small}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert registry.queries()[name](spark, str(tmp_path)).collect() == []


def test_pipeline(spark, tmp_path):
    """Copies, near copies, repeated lines and passages go; clean documents stay whole, and their pieces fill sequences without gaps."""
    import random

    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage, a, b = text(60), text(120), text(150)
    texts = {1: a, 2: a, 3: b, 4: b + " end", 5: f"{text(30)} {passage} {text(40)}", 6: f"{text(40)} {passage} {text(30)}", 7: text(90), 8: None, 9: text(9000)}
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCUMENTS.rsplit(", key", 1)[0]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    # of 2 and 4 nothing is left after line dedup, so that they and 8 are one group of empty texts
    assert set(pieces) == {1, 2, 3, 5, 6, 7, 9} and len(pieces[9]) > 1
    size = lambda d: sum(n for _, _, n in pieces[d])
    assert size(2) == 1 and size(6) < size(5) * 0.75
    for parts in pieces.values():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(parts)):
            assert (piece, start) == (k, at) and 0 < length <= 4096
            at += length
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
