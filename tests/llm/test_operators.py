"""Each operator against brute force, on small tables with nulls, empty texts, ties, repeated rows and odd columns."""

import base64
import hashlib
import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from quarry.llm import bpe, chat, linededup, neardup, packing, ppm, repeats, simhash, suffix, toxicity, winnow
from quarry.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _w string, id string, bucket int"


def lower(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(t):
    return [w for w in lower(t).translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]


def texts():
    rng = random.Random(5)
    vocabulary = ["the", "of", "über", "naïve", "日本語", "😀", "x.", "'s", "İ", "a,b"] + ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(120)]
    out = [" ".join(rng.choice(vocabulary) + ("\n" if rng.random() < 0.1 else "") for _ in range(rng.randint(1, 80))) for _ in range(40)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    out += [passage + " " + out[0], out[1] + passage, "é" + passage + "ü", passage * 2, "aaaa" * 90, "aaaa" * 90, out[3], out[3] + " end"]
    out += [None, "", " ", "\n\n", " \t ", "word", "Word", "  two  blanks ", "\x00 zero", " ".join(["again"] * 300), "x" * 30_000]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, "w", "i", 3) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and repeated rows."""
    return spark.createDataFrame([(None, "some text here", None, None, None, None, None, None)] * 2 + [(1, None, None, None, None, None, None, None), (1, None, None, None, None, None, None, None), (2, "the same words twice", "", "", 0, "", "", 0), (2, "the same words twice", "", "", 0, "", "", 0)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return {r[0]: r for r in df.collect()}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bpe(docs, odd, empty):
    path = P.path(bpe.RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(docs)
    got, whole, back = rows(encoded), rows(bpe.encode(docs, offsets=True)), rows(bpe.decode(encoded))
    for i, t in enumerate(texts()):
        t = t or ""
        assert got[i].ids == own.encode_ordinary(t) == whole[i].ids
        assert bytes(back[i].bytes) == t.encode()
        for token, a, b in zip(whole[i].ids, whole[i].starts, whole[i].ends):
            assert own.decode_single_token_bytes(token) in t[a:b].encode()
    assert bpe.encode(odd).count() == 6 and bpe.encode(empty).count() == 0 and bpe.decode(bpe.encode(empty)).count() == 0


def test_bpe_split_character(spark):
    ids = rows(bpe.encode(spark.createDataFrame([(0, "😀")], "doc_id long, text string")))[0].ids
    assert len(ids) > 1
    cut = bpe.decode(spark.createDataFrame([(0, ids[:1]), (1, None), (2, [])], "doc_id long, ids array<int>"))
    assert [bytes(r.bytes) for r in cut.orderBy("doc_id").collect()][1:] == [b"", b""]
    assert "�" in rows(bpe.as_text(cut))[0].text


def test_packing(docs, odd, empty):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(P.path(packing.VOCABULARY))
    made.encode_special_tokens = True
    pieces = packing.token_pieces(docs, capacity=64)
    got = defaultdict(dict)
    for r in pieces.collect():
        got[r.doc_id][r.piece] = r
    lengths = []
    for i, t in enumerate(texts()):
        ids = made.encode(t or "", add_special_tokens=False).ids + [1]
        assert len(got[i]) == -(-len(ids) // 64)
        for p, r in got[i].items():
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start : r.start + r.length] and r.start == 64 * p
            lengths.append(r.length)
    placed = packing.pack(pieces.drop("ids"), ["doc_id", "piece"], capacity=64).collect()
    assert sorted(r.length for r in placed) == sorted(lengths)
    by = defaultdict(list)
    for r in placed:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 64
    assert len(by) <= -(-sum(lengths) // 64) + 3
    assert packing.pack(packing.token_pieces(odd).drop("ids"), ["doc_id", "piece"]).count() == 6
    assert packing.pack(packing.token_pieces(empty).drop("ids"), ["doc_id", "piece"]).count() == 0


def test_plan_is_best_fit():
    rng = random.Random(2)
    for _ in range(50):
        histogram = Counter(rng.randint(1, 50) for _ in range(rng.randint(1, 200)))
        free, want = [], 0
        for n in sorted(Counter(histogram).elements(), reverse=True):
            fits = [f for f in free if f >= n]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - n)
            else:
                free.append(50 - n)
        want = len(free)
        used = set()
        for n, a, b, first, items, offset in packing.plan(list(histogram.items()), 50):
            used |= {first + (r - a) // items for r in range(a, b)}
        assert len(used) == want


def brute_simhash(t, k):
    w = words(t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, odd, empty):
    got = rows(simhash.near_duplicates(docs))
    bits = {i: brute_simhash(t or "", 3) for i, t in enumerate(texts())}
    low = dict.fromkeys(bits)
    for i in bits:
        todo, seen = [i], {i}
        while todo:
            x = todo.pop()
            new = {y for y in bits if (bits[x] ^ bits[y]).bit_count() <= 3} - seen
            seen |= new
            todo += new
        low[i] = min(seen)
    assert {i: (r.bits % 2**64, r.component_id) for i, r in got.items()} == {i: (bits[i], low[i]) for i in bits}
    assert simhash.near_duplicates(odd).count() == 6 and simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 2


@pytest.mark.parametrize("sweep", [2, 1024])
def test_simhash_links(spark, sweep, monkeypatch):
    """All distances up to 3, in one block, across blocks, and large buckets."""
    rng = random.Random(4)
    base = rng.getrandbits(64)
    made = {base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 3, 3, 4, 6) for _ in range(40)} | {base ^ sum(1 << b for b in rng.sample(range(20), 3)) for _ in range(40)} | {rng.getrandbits(64) for _ in range(50)}
    monkeypatch.setattr(simhash.bucket_links, "__defaults__", (sweep,))
    signed = [x - 2**64 if x >> 63 else x for x in made]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "bits long")).distinct().collect()
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 3 for r in found)
    group = {r.node: r.component for r in components(spark.createDataFrame([(r.a, r.b) for r in found], "a long, b long")).collect()}
    pairs = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 3]
    assert pairs and all(group[a] == group[b] for a, b in pairs)


def test_neardup(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 16))
    made = [(i, (base[i % 6] + rng.normal(scale=0.28, size=16)).tolist(), i % 2) for i in range(150)]
    made += [(200 + i, made[0][1], 0) for i in range(5)] + [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [None] * 16, 0), (304, made[0][1], None), (305, [1.0, 2.0], 0), (306, [], 0), (307, [float("inf")] * 16, 1), (308, [x * 1e30 for x in made[0][1]], 0)]
    frame = spark.createDataFrame([(*m, "x") for m in made], "vec_id long, embedding array<float>, label int, node string")
    got = rows(neardup.near_duplicates(frame, tile=20))
    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v, label in made if v and label is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    label = {i: c for i, _, c in made}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in good.items()}
    near = {i: {j for j in unit if j != i and label[i] == label[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93} for i in unit}
    assert sum(map(len, near.values())) > 200
    for i, _, _ in made:
        seen, todo = {i}, [i]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert (got[i].n_links, got[i].component_id) == (len(near.get(i, ())), min(seen)), i
    assert neardup.near_duplicates(frame.limit(0)).count() == 0


def test_quantisation_bound():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = neardup.quantised(x)
    near = (q.astype(float) @ q.T) * s[:, None] * s
    assert (np.abs(near - x @ x.T) <= e[:, None] + (1 + e[:, None]) * e + 1e-12).all()


def test_winnow(docs, odd, empty, spark):
    got = rows(winnow.winnow(docs))
    by_words = defaultdict(set)
    for i, t in enumerate(texts()):
        w = [x for x in (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
        marks = got[i].marks
        grams = max(1, len(w) - winnow.GRAM + 1) if w else 0
        places = [m.place for m in marks]
        assert places == sorted(set(places)) and (not grams or places) and all(p < grams for p in places)
        for low in range(max(0, grams - winnow.WINDOW + 1)):
            assert any(low <= p < low + winnow.WINDOW for p in places)
        by_words[tuple(w)].add(tuple(marks))
    assert all(len(v) == 1 for v in by_words.values())
    # rightmost of equal ones: a text of one word again and again marks the end of each window
    again = next(i for i, t in enumerate(texts()) if t and t.startswith("again again"))
    assert [m.place for m in got[again].marks] == list(range(3, 296))
    # any run of GRAM + WINDOW - 1 equal words leaves a common mark
    run = " ".join(f"r{i}" for i in range(winnow.GRAM + winnow.WINDOW - 1))
    two = rows(winnow.winnow(spark.createDataFrame([(0, f"a b c {run} d e"), (1, f"q {run} z z z y")], "doc_id long, text string")))
    assert {m.hash for m in two[0].marks} & {m.hash for m in two[1].marks}
    assert winnow.winnow(odd).count() == 6 and winnow.winnow(empty).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_with_next(spark, empty, parts):
    made = [(i * i, f"t{i}") for i in range(30)] + [(None, "none"), (None, "nil"), (9, "tie")]
    got = winnow.with_next(spark.createDataFrame(made, "doc_id long, text string"), "doc_id", [F.col("text")], ["text"], parts).collect()
    order = sorted(made, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sorted((r.text, r.next_text) for r in got) == sorted((a[1], b[1]) for a, b in zip(order, order[1:] + order[:1]))
    assert winnow.with_next(empty, "doc_id", [F.col("text")], ["text"], parts).count() == 0


def test_line_dedup(spark, docs, odd, empty):
    rng = random.Random(9)
    base = [" ".join(rng.choice(["the", "of", *(f"w{k}" for k in range(60))]) for _ in range(rng.randint(1, 30))) for _ in range(25)]
    made = texts()
    for _ in range(30):
        lines = []
        for _ in range(4):
            w = rng.choice(base).split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(["The", f"n{rng.randint(0, 500)}"])
            lines.append(" ".join(w))
        made.append("\n".join(lines))
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(made)], "doc_id long, text string, line string")
    got = rows(linededup.dedup_lines(frame))
    sets, removed = [], 0
    for i, t in enumerate(made):
        kept, gone = [], 0
        for line in (t or "").split("\n"):
            s = set(words(line))
            hit = bool(s) and any(10 * len(s & o) >= 8 * len(s | o) for o in sets)
            if s:
                sets.append(s)
            gone += hit
            kept += [] if hit else [line]
        removed += gone
        assert got[i].n_removed == gone and got[i].text == (t if not gone else "\n".join(kept)), i
    assert removed > 40
    assert linededup.dedup_lines(odd).count() == 6 and linededup.dedup_lines(empty).count() == 0


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(300):
        x = np.array([rng.randint(0, rng.choice([1, 3, 26])) for _ in range(rng.randint(1, 80))])
        assert suffix.suffix_array(x, 1000, limit=rng.choice([3, 10**6])).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


@pytest.mark.parametrize("crowd", [1, 20_000])
def test_repeats(docs, odd, empty, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    got = rows(repeats.remove_repeats(docs))
    seen, removed = set(), 0
    for i, t in enumerate(texts()):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for at in range(len(b) - 99):
            s = b[at : at + 100]
            if s in seen:
                cover[at : at + 100] = b"\1" * 100
            seen.add(s)
        runs = sum(1 for at in range(len(b)) if cover[at] and not (at and cover[at - 1]))
        removed += sum(cover)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(b), sum(cover), runs, bytes(x for x, c in zip(b, cover) if not c)), i
    assert removed > 1000
    assert repeats.remove_repeats(odd).count() == 6 and repeats.remove_repeats(empty).count() == 0
    for r in repeats.remove_repeats(docs, whole_chars=True).collect():
        bytes(r.kept).decode()


def test_ppm(docs, odd, empty):
    learn = F.col("doc_id") % 3 != 0
    got = rows(ppm.score(docs, learn, order=3))
    all_ = {i: words(t or "") + [""] for i, t in enumerate(texts())}
    count = Counter(w for i, ws in all_.items() if i % 3 for w in ws)
    n, v = sum(count.values()), len(count)
    edges = defaultdict(Counter)
    for w, c in count.items():
        s = [256, *w.encode(), 256]
        for i in range(1, len(s)):
            for k in range(min(3, i) + 1):
                edges[tuple(s[i - k : i])][s[i]] += c

    def lp(w):
        s, out = [256, *w.encode(), 256], 0.0
        for i in range(1, len(s)):
            out_of = set()
            for k in range(min(3, i), -1, -1):
                here = edges.get(tuple(s[i - k : i]), {})
                left = {x: m for x, m in here.items() if x not in out_of}
                total, d = sum(left.values()), len(left)
                if s[i] in left:
                    out += math.log10(left[s[i]] / (total + d))
                    break
                if d:
                    out += math.log10(d / (total + d))
                out_of |= set(here)
            else:
                out -= math.log10(257 - len(out_of))
        return out

    for i, ws in all_.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score == pytest.approx(sum(map(lp, ws)))
    # all symbols after a context share a probability of one
    assert sum(10 ** lp(w) for w in [""]) < 1
    assert ppm.score(odd, learn).count() == 6 and ppm.score(empty, learn).count() == 0
    assert ppm.score(docs, F.lit(False)).where("base_score <> 0").count() == 0


def test_toxicity(spark, docs, odd, empty):
    rng = random.Random(6)
    plain = ["".join(rng.choice("aeioubcdr") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    made = []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w[rng.randrange(len(w))] = "glork" + rng.choice(["ed", "ing", "s", "", "ius", "um", "or", "en"])
        made.append((i, " ".join(w), int(bad)))
    labels = spark.createDataFrame([(i, y) for i, _, y in made] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame([m[:2] for m in made], "doc_id long, text string"), labels)
    test = spark.createDataFrame([(0, "oba ceda glorkish bado"), (1, "oba ceda bado " * 20), (2, "deb " * 3000 + "glorkest"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(test, model).collect()}
    assert got[0] > 0.5 > got[1] and got[2] > 0.5 and got[3] == got[4] and 0 <= got[3] <= 1
    kept = toxicity.reject_toxic(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == 6
    assert toxicity.score(empty, model).count() == 0


def test_chat(spark):
    calls = spark.createDataFrame(
        [("c", "a", None, "f", '{"y":2,"x":1.5}'), ("c", "b", "a", "f", '{"x":"no","z":1}'), ("c", "d", "b", "g", "{}"), ("c", "e", "zz", "f", "not json"), ("c", "k1", "k2", "f", '{"x":1}'), ("c", "k2", "k1", "f", '{"x":1}'), ("c", "k3", "k1", "f", '{"x":1}'), ("c", None, None, "f", None), ("c", "t", None, "f", '{"x":1}'), ("c", "t", None, "f", '{"x":2}'), ("o", "b", None, "f", '{"x":1,"y":[1,"é"]}')],
        "conv_id string, call_id string, parent_id string, name string, arguments string",
    )
    results = spark.createDataFrame([("c", "a", "ok"), ("c", "b", "2"), ("c", "b", "1"), ("c", "gone", "?"), ("c", None, "?")], "conv_id string, call_id string, content string")
    schema = {"type": "object", "properties": {"x": {"type": "number", "maximum": 2}}, "required": ["x"]}
    schemas = spark.createDataFrame([("f", json.dumps(schema))], "name string, schema string")
    got = {(r.conv_id, r.call_id, r.json): r for r in chat.link_calls(calls, results, schemas).collect()}
    assert len(got) == 11
    one = lambda conv, call: next(r for k, r in got.items() if k[:2] == (conv, call))
    assert one("c", "a").errors == [] and one("c", "a").json == '{"arguments":{"x":1.5,"y":2},"id":"a","name":"f","result":"ok"}'
    assert [one("c", x).level for x in ("a", "b", "d", "e", "k1", "k2", "k3")] == [0, 1, 2, 0, None, None, None]
    assert one("c", "b").errors == ["several results", "$.x: not number"] and '"result":"1"' in one("c", "b").json
    assert one("c", "d").errors == ["no result", "unknown tool"] and "arguments are no JSON" in one("c", "e").errors
    assert "cycle" in one("c", "k3").errors and "no id" in one("c", None).errors and "id is not unique" in one("c", "t").errors
    assert "é" in one("o", "b").json
    assert chat.link_calls(calls.limit(0), results, schemas).count() == 0


def test_chat_long_chain(spark):
    n = 700
    nodes = spark.createDataFrame([("c", i, i - 1 if i else None) for i in range(n)], "conv_id string, call_id long, parent_id long")
    assert {r.call_id: r.level for r in chat.levels(nodes).collect()} == {i: i for i in range(n)}
