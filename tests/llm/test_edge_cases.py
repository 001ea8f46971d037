"""Every operator on nulls, empty and very long texts, ties and repeated rows, empty tables, clashing extra columns."""
import hashlib
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from sparlink.llm import bpe_trie, deleted_lm, importance, line_dedup, media_sniff, packing, quality_rules, simhash, token_shards, warc
from sparlink.llm.common import new_dir, tokenizer_path

LONG = "word " * 30_000 + "end."
TEXTS = [(1, "Hello world's <|endoftext|> 12.\nSame line\nSame line"), (2, None), (3, ""), (3, ""), (4, " \t\n "), (5, LONG), (None, "no id here"), (None, None), (7, "Same line\nİstanbul é ﬁ 漢字 \x1c!"),
         (7, "Same line\nİstanbul é ﬁ 漢字 \x1c!"), (8, "x" * 200_000), (9, "a b c d")]
#: Names that the operators use inside.
EXTRA = "kept string, n_lines string, key string, row string, id string, fp string, text2 string, shard string, media string, salt string, host string"


@pytest.fixture(scope="module")
def docs(spark):
    n = len(EXTRA.split(","))
    return spark.createDataFrame([(i, t, None if i == 2 else "src", *["?"] * n) for i, t in TEXTS], f"doc_id long, text string, source string, {EXTRA}")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(lib, text):
    return lib.encode(text or "", add_special_tokens=False).ids


def test_bpe(docs, empty, lib):
    got = bpe_trie.bpe_encode_decode(docs).collect()
    assert len(got) == len(TEXTS)
    want = sorted((str(i), np.array(ids_of(lib, t), "<u4").tobytes(), lib.decode(ids_of(lib, t), skip_special_tokens=False)) for i, t in TEXTS)
    assert sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in got) == want
    assert bpe_trie.bpe_encode_decode(empty).count() == 0


def test_quality_rules(docs, empty):
    got = {(r.row.doc_id, r.row.text): r for r in quality_rules.quality_rules(docs).collect()}
    assert got[2, None].n_words == 0 and got[2, None].base_failed and not got[2, None].kept
    long = got[5, LONG]
    assert (long.n_words, long.n_repeat_words) == (30_001, 30_000) and long.base_failed
    assert got[1, TEXTS[0][1]].n_dup_lines == 1
    assert quality_rules.quality_rules(docs).count() == len(TEXTS)
    assert quality_rules.quality_rules(empty).count() == 0


def test_importance(spark, docs, empty):
    labels = spark.createDataFrame([(1, True), (9, True), (5, False), (99, True), (None, True)], "id long, target boolean")
    got = importance.importance_resample(docs, labels).collect()
    assert len(got) == len(TEXTS) and all(r.kept is not None for r in got)
    assert all(r.log_weight == 0 for r in got if not (r.row.text or "").split())
    none = importance.importance_resample(docs, labels.where("false")).collect()
    assert all(r.kept for r in none)
    assert importance.importance_resample(empty, labels).count() == 0
    assert sum(r.kept for r in importance.importance_resample(docs, labels, k=3).collect()) >= 3


def test_warc(spark):
    page = "<html>" + "x" * 200
    rows = [(1, "http://a/ b\r\nX: y", page), (2, "http://b", page), (2, "http://c", page), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "n", page), (7, "big", "é" * 300_000), (1, "http://a2", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as kind", "3 as first", "4 as payload")
    folder = new_dir(spark, "warc")
    warc.write_warc(df, folder, roll=2000)
    got = warc.read_warc(spark, folder).collect()
    assert len(got) == len(rows)
    same = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got if r.payload_digest == hashlib.sha256(page.encode()).hexdigest())
    assert same == [("1", "response", None), ("1", "revisit", 1), ("2", "revisit", 1), ("2", "revisit", 1), ("None", "revisit", 1)]
    assert {r.record_type for r in got if r.payload_bytes < 100} == {"response"}
    assert next(bytes(r.payload) for r in got if r.page_id == 7) == ("é" * 300_000).encode()
    again = new_dir(spark, "warc")
    assert warc.write_warc(df.repartition(3), again, roll=2000) == warc.write_warc(df, folder + "b", roll=2000)
    assert warc.read_warc(spark, folder, False).where("record_type = 'response'").count() == 6
    none = new_dir(spark, "warc")
    assert warc.write_warc(df.where("false"), none) == [] and warc.read_warc(spark, none).count() == 0


def test_warc_damage(spark):
    data = warc.warc_record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert warc.parse_record(data)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(data.replace(b"abc", b"abd"))


def test_media(spark, docs, empty):
    from pyspark.sql import functions as F

    stored = docs.select("doc_id", "text", "kept", F.lit("image/png").alias("declared"), media_sniff.wav_of(media_sniff.text_payload(F.col("text"))).alias("m"))
    got = media_sniff.sniffed(stored, "m", "declared").collect()
    assert len(got) == len(TEXTS)
    for r in got:
        t = (r.row.text or "").encode()
        want = t + bytes(64 if not t else -len(t) % 64)
        assert bytes(r.samples) == want and r.media_type == "audio/wav" and r.corrected
    assert media_sniff.sniffed(stored.where("false"), "m", "declared").count() == 0
    nulls = spark.createDataFrame([(None, "image/gif"), (bytearray(), None), (bytearray(b"BM junk"), "x")], "m binary, declared string")
    assert [(r.media_type, r.parts, r.samples) for r in media_sniff.sniffed(nulls, "m", "declared").collect()] == [("image/gif", [], None), (None, [], None), ("x", [], None)]


def test_token_shards(spark, docs, empty, lib):
    done = token_shards.write_token_shards(docs, new_dir(spark, "ids"), seq_len=64)
    got = token_shards.read_documents(spark, done).orderBy("start").collect()
    assert len(got) == len(TEXTS) and [r.doc_id for r in got] == sorted((i for i, _ in TEXTS), key=lambda x: -1 if x is None else x)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = sorted((str(i), len(ids_of(lib, t)) + 1, zlib.crc32(np.array([*ids_of(lib, t), 1], "<u4").tobytes())) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    seqs = token_shards.Sequences(done.folder)
    flat = [seqs[i] for i in range(len(seqs))]
    assert sum(m.true_count for _, m in flat) == at and all(len(x) == 64 for x, _ in flat)
    none = token_shards.write_token_shards(empty, new_dir(spark, "ids"))
    assert none.shards == [] and token_shards.read_documents(spark, none).count() == 0


def test_lm(docs, empty):
    got = deleted_lm.lm_scores(docs).collect()
    assert len(got) == len(TEXTS)
    assert {r.n_tokens for r in got if r.doc_id in ("2", "3", "4")} == {1}
    assert all(r.score < 0 and r.base_score < 0 for r in got)
    assert deleted_lm.lm_scores(empty).count() == 0


@pytest.mark.parametrize("most_keys", [1_000_000, 0])
def test_line_dedup(docs, empty, most_keys):
    got = line_dedup.drop_repeated_lines(docs, min_docs=3, most_keys=most_keys).collect()
    assert len(got) == len(TEXTS)
    by = {(r.doc_id, r.text): r for r in got}
    assert by[1, "Hello world's <|endoftext|> 12."].n_dropped == 2
    assert by[2, ""].n_lines == 1 and by[5, LONG].n_dropped == 0
    assert by[7, "İstanbul é ﬁ 漢字 \x1c!"].kept == "?"
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_packing(docs, empty, lib):
    got = packing.pack(docs, size=256).collect()
    length = {}
    for r in got:
        length[r.sequence_id] = length.get(r.sequence_id, 0) + r.length
    assert max(length.values()) <= 256
    total = sum(len(ids_of(lib, t)) + 1 for _, t in TEXTS)
    assert sum(r.length for r in got) == total
    for s in length:
        own = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    five = b"".join(bytes(r.ids) for r in sorted((r for r in got if r.doc_id == 5), key=lambda r: r.start))
    assert five == np.array([*ids_of(lib, LONG), 2], "<u4").tobytes()
    assert packing.pack(empty).count() == 0


def test_simhash(spark, docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    by = {(r.doc_id, i): r for i, r in enumerate(got)}
    assert {r.component_id for r in got if r.doc_id in (2, 3, 4)} == {2} and all(r.fp == 0 for r in got if r.doc_id in (2, 3, 4))
    assert {r.component_id for (d, _), r in by.items() if d == 7} == {7}
    assert simhash.near_duplicates(empty).count() == 0
    one = xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(b"A  b") == np.array([one], "<u8").view("<i8")[0]
