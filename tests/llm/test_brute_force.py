"""The queries against plain Python over a small table, and parts against exhaustive search."""
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparlink.llm import importance, packing, queries, simhash
from sparlink.llm.bpe_trie import TrieBpe
from sparlink.llm.common import tokenizer_path
from sparlink.llm.media_sniff import automaton, found_media
from sparlink.llm.tokens import Encoder


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(tokenizer_path())


def rows(spark, sf, name):
    return queries.QUERIES[name](spark, sf).collect()


def u4(ids):
    return np.array(ids, "<u4").tobytes()


def test_op2(spark, sf, docs, lib):
    for r in rows(spark, sf, "op2_bpe"):
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(u4(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


_ENC, _TRIE, _LIB = [], [], []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcdeéüß .,!?'\n\t<|>ΣİA1½漢̇क़ \x1c"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=4))
def test_encoders_on_any_text(texts):
    if not _ENC:
        _ENC.append(Encoder(tokenizer_path()))
        _TRIE.append(TrieBpe(tokenizer_path()))
        _LIB.append(Tokenizer.from_file(tokenizer_path()))
    texts = [*texts, "it's <|endoftext|>aaaa'll"]
    want = [x.ids for x in _LIB[0].encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in _ENC[0].encode(pa.array(texts)).to_pylist()] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in _TRIE[0].codec(pa.array(texts))[0].to_pylist()] == want


def test_op3_keeps_clean(spark, sf):
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = rows(spark, sf, "op3_quality_classifier")
    clean = [r.kept for r in got if labels.get(r.doc_id) == (1, 0)]
    assert sum(clean) >= 0.95 * len(clean)
    bad = [r.kept for r in got if labels.get(r.doc_id, (1, 0))[0] == 0]
    assert sum(bad) <= 0.5 * len(bad)


def test_kth_greatest(spark):
    random.seed(3)
    xs = [random.gauss(0, 50) for _ in range(500)] + [7.25] * 20
    df = spark.createDataFrame([(x,) for x in xs], "key double")
    for k in (1, 2, 250, 300, 519, 520):
        want = sorted(xs, reverse=True)[k - 1] if k < len(xs) else float("-inf")
        assert importance.kth_greatest(df, k) == want
    assert importance.kth_greatest(df, 0) == float("inf") and importance.kth_greatest(df, 600) == float("-inf")


def test_op4(spark, sf):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first = {}
    for p in sorted(pages):
        first.setdefault(pages[p], p)
    for r in rows(spark, sf, "op4_warc"):
        b = pages[r.page_id]
        revisit = len(b) >= 100 and first[b] != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first[b]) if revisit else ("response", None))


def test_op5(spark, sf, docs):
    for r in rows(spark, sf, "op5_media"):
        t = docs[r.doc_id].encode()
        p = t + bytes(64 if not t else -len(t) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_bytes == len(p) + 44 and r.corrected


def test_carving():
    import gzip
    import io
    import struct
    import zipfile

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\x00;"
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    wav = b"RIFF" + struct.pack("<I", 40) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", 4) + b"abcd"
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02\x11\xff\x00\x22\xff\xd9"
    parts = [("image/png", png), ("image/gif", gif), ("application/zip", z.getvalue()), ("audio/wav", wav), ("image/jpeg", jpg), ("application/gzip", gzip.compress(b"x" * 100))]
    blob, want = b"junk BM %PDF-1.4 RIFFxxxx", []
    for kind, b in parts:
        want.append((len(blob), len(b), kind))
        blob += b + b" fLaC PK\x03\x04 "
    assert found_media(blob, automaton()) == want
    assert found_media(png[:-1], automaton()) == []


def test_op6(spark, sf, docs, lib):
    got, at = {r.doc_id: r for r in rows(spark, sf, "op6_token_ids")}, 0
    for d in sorted(docs):
        ids = [*lib.encode(docs[d], add_special_tokens=False).ids, 1]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(u4(ids)))
        at += len(ids)


def test_op7(spark, sf, docs):
    tokens = {d: [*t.encode().lower().split(), b"\n"] for d, t in docs.items()}
    fold = {d: zlib.crc32(str(d).encode()) % 5 for d in docs}

    def learn(folds):
        c, pair = Counter(), Counter()
        for d, t in tokens.items():
            if fold[d] in folds:
                c.update(t)
                pair.update(zip([b"\n", *t], t))
        return c, pair, sum(c.values()) + 0.5 * (len(c) + 1)

    ca, pa_, floor_a = learn({0, 3, 4})
    c, pair, floor = learn({0, 2, 3, 4})
    seen = {}
    for d, t in tokens.items():
        if fold[d] == 2:
            for p, w in zip([b"\n", *t], t):
                seen.setdefault(ca[p].bit_length(), []).append((pa_[p, w] / ca[p] if ca[p] else 0, (ca[w] + 0.5) / floor_a))
    weight = dict.fromkeys(range(64), 0.5)
    for b, xs in seen.items():
        x = np.array(xs)
        for _ in range(100):
            weight[b] = float(np.clip((weight[b] * x[:, 0] / (weight[b] * x[:, 0] + (1 - weight[b]) * x[:, 1])).mean(), 1e-6, 1 - 1e-6))
    weight[0] = 0.0
    got = rows(spark, sf, "op7_lm")
    for r in got:
        t = tokens[r.doc_id]
        base = sum(math.log10((c[w] + 0.5) / floor) for w in t)
        score = sum(math.log10(weight[c[p].bit_length()] * pair[p, w] / max(c[p], 1) + (1 - weight[c[p].bit_length()]) * (c[w] + 0.5) / floor) for p, w in zip([b"\n", *t], t))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold[r.doc_id] == 1, len(t), sum(c[w] > 0 for w in t), sum(c.values()))
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-6)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op8(spark, sf, docs):
    key = lambda x: x.encode().strip().lower()
    n = Counter(k for t in docs.values() for k in {key(x) for x in t.split("\n")})
    for r in rows(spark, sf, "op8_line_dedup"):
        lines = docs[r.doc_id].split("\n")
        left = [x for x in lines if not (key(x) and n[key(x)] >= 10)]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest())


def test_op9(spark, sf, docs, lib):
    by = {}
    for r in rows(spark, sf, "op9_packing"):
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == docs.keys()
    for d, ps in by.items():
        ids, at = np.array([*lib.encode(docs[d], add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(ps, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    length = Counter()
    for ps in by.values():
        for r in ps:
            length[r.sequence_id] += r.length
    pad = sum(0 if n & (n - 1) == 0 else 4096 - n for n in length.values())
    assert max(length.values()) <= 4096 and pad <= 0.01 * sum(length.values())


def test_window_cuts_are_cheapest():
    random.seed(5)
    for _ in range(60):
        size = random.randint(4, 12)
        at = np.cumsum([random.randint(1, size) for _ in range(random.randint(1, 9))])
        pen = np.array([random.choice([0, 1, 3]) for _ in at], float)

        def cost(cuts, at=at, pen=pen, size=size):
            where = dict(zip(at.tolist(), pen.tolist()))
            ends = [0, *cuts]
            return sum(size - (b - a) + where[b] for a, b in zip(ends, ends[1:-1])), all(b - a <= size for a, b in zip(ends, ends[1:]))

        best = min(c for m in range(1 << (len(at) - 1)) if (x := cost([v for i, v in enumerate(at.tolist()) if i == len(at) - 1 or m >> i & 1]))[1] for c in [x[0]])
        assert cost(packing.window_cuts(at, pen, size)) == (best, True)


def test_op10(spark, sf, docs):
    fp = {d: np.uint64(simhash.fingerprint(t.encode()) & (1 << 64) - 1) for d, t in docs.items()}
    left = dict.fromkeys(docs)
    for d in sorted(docs):
        if left[d] is None:
            todo, left[d] = [d], d
            while todo:
                x = todo.pop()
                for y in docs:
                    if left[y] is None and int(fp[x] ^ fp[y]).bit_count() <= 3:
                        left[y] = d
                        todo.append(y)
    got = rows(spark, sf, "op10_simhash")
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{int(fp[d]):016x}", left[d]) for d in docs}


def test_tile_links_lose_none():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False))) for b in base for _ in range(40)]
    fps = np.unique(np.array([*base, *near, *rng.integers(0, 1 << 63, 800, dtype=np.uint64)], dtype=np.uint64))
    dist = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    want = simhash.groups(len(fps), *np.nonzero(dist))
    place = {int(x): i for i, x in enumerate(fps)}
    half = rng.random(len(fps)) < 0.5
    parts = [simhash.tile_links(fps[half], None, 3), simhash.tile_links(fps[~half], None, 3), simhash.tile_links(fps[half], fps[~half], 3)]
    i = np.array([place[int(x)] for a, _ in parts for x in a])
    j = np.array([place[int(x)] for _, b in parts for x in b])
    assert (simhash.groups(len(fps), i, j) == want).all() and len(i) < 3 * len(fps)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as P

    given = spark.read.parquet(f"{sf}/documents.parquet")
    state, seen = given, []
    for name, stage in P.STAGES[:-1]:
        state = P.written(stage(spark, state, sf), "stage")
        assert state.columns == given.columns
        seen.append((name, {r.doc_id for r in state.collect()}))
    for (_, a), (_, b) in zip([("", set(docs)), *seen], seen):
        assert b <= a
    got = P.run(spark, sf).collect()
    assert {r.doc_id for r in got} == seen[-1][1]
    assert {"ids", "sequence_id", "offset"} <= set(got[0].asDict())
