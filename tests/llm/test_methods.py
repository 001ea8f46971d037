"""Each operator's method against plain Python: verdicts, weights, orders, shards, tiles, first occurrences."""
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparlink.llm import bpe_trie, common, deleted_lm, importance, line_dedup, queries, quality_rules, shingle_links, simhash, token_shards, warc
from sparlink.llm.common import new_dir, tokenizer_path

RND = random.Random(11)


def words(n, of=4000):
    return [f"w{RND.randrange(of)}" for _ in range(n)]


# Operator 1


def hosts(spark, of):
    """of: host -> (good documents, failing ones)."""
    rows = [(h, "short" if i >= good else " ".join(words(60))) for h, (good, bad) in of.items() for i in range(good + bad)]
    return spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")


def test_good_documents_of_a_bad_host_go_and_an_unlucky_small_host_stays(spark):
    docs = hosts(spark, {**{f"h{i}": (36, 4) for i in range(15)}, "bad": (20, 60), "small": (1, 2), None: (30, 3)})
    got = quality_rules.quality_rules(docs).collect()
    kept = Counter((r.row.source, r.base_failed, r.kept) for r in got)
    assert kept["bad", False, False] == 20 and not kept["bad", False, True]
    assert kept["small", False, True] == 1 and kept[None, False, True] == 30 and kept["h3", False, True] == 36
    assert not any(k for (_, failed, k) in kept if failed and k)


def test_hosts_that_are_all_alike_lose_none(spark):
    got = quality_rules.quality_rules(hosts(spark, {f"h{i}": (5, 20) for i in range(6)})).collect()
    assert sum(r.kept for r in got) == 30


def test_measures_carry_the_asked_columns_only(spark):
    got = quality_rules.quality_rules(hosts(spark, {"a": (2, 1)}), carry=["doc_id"])
    assert got.schema["row"].dataType.names == ["doc_id"] and got.count() == 3


# Operator 2


def test_long_words_take_linear_time_and_share_prefixes():
    lib, trie = Tokenizer.from_file(tokenizer_path()), bpe_trie.TrieBpe(tokenizer_path())
    word = "".join(RND.choice("abcdefghij") for _ in range(300_000))
    texts = [word, word[:100_000] + "zz", word[:100_000], "a", "ab", None, "", "aa aa aaa"]
    ids, decoded = trie.codec(pa.array(texts))
    for t, i, d in zip(texts, ids.to_pylist(), decoded.to_pylist(), strict=True):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(i, "<u4").tolist() == want and d == lib.decode(want, skip_special_tokens=False)
    some = np.array([5, 0, 1, 40_000], "<u4")
    assert trie.decode(pa.array([some.tobytes(), b""])).to_pylist() == [lib.decode(some.tolist(), skip_special_tokens=False), ""]


# Operator 3


def plain_features(text):
    parts = [p for run in (text or "").encode().lower().split() for p in importance._PART.findall(run)]
    return parts, list(zip(parts, parts[1:]))


def test_log_weights_are_those_of_the_two_models(spark):
    docs = [(i, " ".join(words(RND.randrange(0, 40), 30) + (["good!"] * 9 if i % 2 else ["bad."] * 9))) for i in range(120)] + [(500, None), (501, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2 == 1) for i in range(60)], "id long, target boolean")
    singles, pairs = Counter(), Counter()
    ts, tp = Counter(), Counter()
    for i, t in docs:
        s, p = plain_features(t)
        singles.update(s)
        pairs.update(p)
        if i < 60 and i % 2:
            ts.update(s)
            tp.update(p)
    total, target = sum(singles.values()) + sum(pairs.values()), sum(ts.values()) + sum(tp.values())

    def weight(n, t):
        e = n / total * target
        return math.log((t + 2) / (e + 2)) if abs(t - e) > 4 * math.sqrt(e + 1) else 0.0

    got = {r.row.doc_id: r for r in importance.importance_resample(df, labels, k=40, buckets=1 << 22).collect()}
    for i, t in docs:
        s, p = plain_features(t)
        want = sum(weight(singles[x], ts[x]) for x in s) + sum(weight(pairs[x], tp[x]) for x in p)
        assert got[i].log_weight == pytest.approx(want, abs=1e-9) and got[i].n_features == len(s) + len(p)
    assert got[1].log_weight != 0
    keys = sorted((r.key for r in got.values()), reverse=True)
    assert {i for i, r in got.items() if r.kept} == {i for i, r in got.items() if r.key >= keys[39]}


def test_weights_dont_depend_on_how_rows_are_dealt(spark, sf):
    df, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), queries.quality_targets(spark.read.parquet(f"{sf}/labels.parquet"))
    df = df.union(df.limit(50))
    got = [sorted((r.row.doc_id, r.log_weight, r.kept) for r in importance.importance_resample(df.repartition(n), labels).collect()) for n in (1, 7)]
    assert got[0] == got[1]


def test_figures_of_documents_that_did_not_teach(spark):
    docs = [(i, " ".join(words(30, 50) + (["junk", "spam"] * 5 if i % 3 == 0 else []))) for i in range(300)]
    got = importance.held_out_figures(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 3 > 0) for i in range(300)], "id long, target boolean"))
    assert (got["targets"], got["others"]) == (200, 100) and got["roc_area"] > 0.95 and got["others_dropped"] > 0.9 and got["targets_kept"] >= 0.99


def test_repeated_ids_give_one_labelled_row(spark):
    df = spark.createDataFrame([(1, f"text {i}") for i in range(40)] + [(2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, True), (1, False), (2, True), (3, True), (None, True)], "id long, target boolean")
    assert sorted((r.text, r.target) for r in importance.labelled(df, labels, "doc_id", "text", 10).collect()) == [("b", True), ("text 0", False)]


# Operators 4, 6 and 9: shards


def keyed(spark, n=60_000):
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, 77).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.col("id") * 1_000_003 % 999_999_937).cast("long").alias("id"),
                                 F.xxhash64("id").alias("h"), (10 + F.col("id") % 90).cast("long").alias("size"))


def test_bounds_dont_depend_on_how_rows_are_dealt(spark):
    df = common.written(keyed(spark), "keyed")
    got = [common.order_bounds(df.repartition(n), 50, 1 << 40) for n in (3, 8, 16)]
    assert all((x[0] == got[0][0]).all() and (x[1] == got[0][1]).all() for x in got)
    rows = df.toPandas()
    shard = common.shard_of(got[0], pa.array(df.select("id").toArrow()["id"].combine_chunks()), pa.array(rows.h.to_numpy()))
    size = np.bincount(shard, weights=rows["size"].to_numpy())
    assert len(size) == 50 and size.max() < 1.5 * size.mean()  # a third of all rows have one id
    order = sorted(range(len(rows)), key=lambda i: (-(1 << 63) if np.isnan(rows.id[i]) else rows.id[i], rows.h[i]))
    assert (np.diff(shard[order]) >= 0).all()


def test_more_bytes_give_more_shards(spark):
    df = keyed(spark, 5000)
    assert len(common.order_bounds(df, 2, 10_000)[0]) > 20 and len(common.order_bounds(df, 2, 1 << 40)[0]) == 1
    assert len(common.order_bounds(df.where("false"), 4, 1)[0]) == 0


def test_warc_bytes_dont_depend_on_how_rows_are_dealt(spark):
    pages = common.written(spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).cast("long").alias("page_id"), F.lit("http://a").alias("url"),
                                                    F.repeat(F.concat(F.lit("p"), (F.col("id") % 1700).cast("string")), 60).alias("html")), "pages")
    files = []
    for n in (3, 8):
        folder = new_dir(spark, "warc")
        shards = warc.write_warc(pages.repartition(n), folder, roll=4000, shards=6)
        fs, where = common.open_fs(folder)
        files.append({name: hashlib.sha256(fs.open_input_stream(f"{where}/{name}", compression=None).read()).hexdigest() for s in shards for name in warc.files_of(fs, where, s[0])})
        assert warc.read_warc(spark, folder).count() == 3000 and len(shards) == 6 and sum(s[2] for s in shards) == 3000
    assert files[0] == files[1] and len(files[0]) > 10


def test_sequences_are_views_of_the_ids(spark):
    docs = spark.createDataFrame([(7 if i % 3 else i, " ".join(words(RND.randrange(50)))) for i in range(300)], "doc_id long, text string")
    done = token_shards.write_token_shards(docs, new_dir(spark, "ids"), seq_len=16, shards=5)
    lib = Tokenizer.from_file(tokenizer_path())
    got = token_shards.read_documents(spark, done).orderBy("start").collect()
    want = Counter((r.doc_id, zlib.crc32(np.array([*lib.encode(r.text, add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in docs.collect())
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want and [r.doc_id for r in got] == sorted(r.doc_id for r in got) and len(done.shards) == 5
    seqs = token_shards.Sequences(done.folder)
    flat = np.concatenate([ids[: mask.true_count] for ids, mask in map(seqs.__getitem__, range(len(seqs)))])
    assert len(flat) == sum(r.n_tokens for r in got) and not seqs[0][0].flags.owndata
    assert all(zlib.crc32(flat[r.start : r.start + r.n_tokens].astype("<u4").tobytes()) == r.ids_crc32 for r in got)


# Operator 7


def test_three_orders(spark):
    docs = {i: " ".join(words(RND.randrange(40), 12)) for i in range(150)} | {900: "", 901: "w1"}
    tokens = {d: [*t.encode().split(), b"\n"] for d, t in docs.items()}
    fold = {d: zlib.crc32(str(d).encode()) % 5 for d in docs}

    def learn(folds):
        c = [Counter(), Counter(), Counter()]
        for d, t in tokens.items():
            if fold[d] in folds:
                p = [b"\n", b"\n", *t]
                for i in range(len(t)):
                    for k in range(3):
                        c[k][tuple(p[i + 2 - k : i + 3])] += 1
        ends = sum(fold[d] in folds for d in docs)
        return c, ends, sum(c[0].values()) + 0.5 * (len(c[0]) + 1)

    def context(model, i, p, k):
        c, ends, _ = model
        return ends if i == 0 else c[k - 1][tuple(p[i + 2 - k : i + 2])]

    def prob(model, weights, i, p):
        c, _, floor = model
        out = (c[0][p[i + 2],] + 0.5) / floor
        for k, w in enumerate(weights, 1):
            n = context(model, i, p, k)
            x = w[n.bit_length()]
            out = x * c[k][tuple(p[i + 2 - k : i + 3])] / max(n, 1) + (1 - x) * out
        return out

    under, whole, weights = learn({0, 3, 4}), learn({0, 2, 3, 4}), []
    for k in (1, 2):
        seen = {}
        for d, t in tokens.items():
            if fold[d] == 2:
                p = [b"\n", b"\n", *t]
                for i in range(len(t)):
                    n = context(under, i, p, k)
                    seen.setdefault(n.bit_length(), []).append((under[0][k][tuple(p[i + 2 - k : i + 3])] / n if n else 0, prob(under, weights, i, p)))
        w = dict.fromkeys(range(64), 0.5)
        for b, xs in seen.items():
            x = np.array(xs)
            for _ in range(100):
                w[b] = float(np.clip((w[b] * x[:, 0] / (w[b] * x[:, 0] + (1 - w[b]) * x[:, 1])).mean(), 1e-6, 1 - 1e-6))
        w[0] = 0.0
        weights.append(w)
    df = spark.createDataFrame([(d, t) for d, t in docs.items()], "doc_id long, text string").repartition(5)
    for r in deleted_lm.lm_scores(df, order=3).collect():
        p = [b"\n", b"\n", *tokens[int(r.doc_id)]]
        assert r.score == pytest.approx(sum(math.log10(prob(whole, weights, i, p)) for i in range(len(p) - 2)), rel=1e-4)


def test_one_order_is_the_base(spark):
    df = spark.createDataFrame([(i, " ".join(words(20, 30))) for i in range(30)], "doc_id long, text string")
    assert all(r.score == pytest.approx(r.base_score) for r in deleted_lm.lm_scores(df, order=1).collect())


# Operator 8


@pytest.mark.parametrize("most_keys", [1_000_000, 0])
def test_the_first_occurrence_stays(spark, most_keys):
    rows = [(3, "x\nSame\nsame "), (2, "SAME\ny\nsame\ntwo"), (None, "same\nlast"), (5, "two\nsame"), (6, None), (6, ""), (2, "z"), (9, "same"), (9, "same")]
    df = spark.createDataFrame([(i, t, "?") for i, t in rows], "doc_id long, text string, owner string").repartition(3)
    got = line_dedup.drop_repeated_lines(df, min_docs=2, keep="first", id_col="doc_id", most_keys=most_keys).collect()
    want = [(3, "x", 2), (2, "SAME\ny\ntwo", 1), (None, "last", 1), (5, "", 2), (6, "", 0), (6, "", 0), (2, "z", 0), (9, "", 1), (9, "", 1)]
    assert sorted(((r.doc_id, r.text, r.n_dropped) for r in got), key=str) == sorted(want, key=str)
    alike = spark.createDataFrame([(1, "a\nb")] * 3, "doc_id long, text string")
    assert {r.text for r in line_dedup.drop_repeated_lines(alike, min_docs=2, keep="first", id_col="doc_id", most_keys=most_keys).collect()} == {"a\nb"}


def test_both_ways_of_many_keys_agree(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = [sorted((r.doc_id, r.text, r.n_dropped) for r in line_dedup.drop_repeated_lines(df, min_docs=3, keep="first", id_col="doc_id", most_keys=n).collect()) for n in (1_000_000, 0)]
    assert got[0] == got[1] and sum(x[2] for x in got[0])
    with pytest.raises(ValueError):
        line_dedup.drop_repeated_lines(df, keep="last")


# Operator 10


def test_fingerprints_bit_by_bit():
    for n in (0, 1, 2, 3, 4, 9, 400):
        text = " ".join(words(n, 20)).upper()
        w = text.lower().split()
        sh = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
        h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in sh]
        want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
        assert simhash.fingerprint(text.encode()) % (1 << 64) == want


def test_links_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 64)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 6), replace=False))) for b in base for _ in range(3)]
    fps = np.unique(np.array([*base, *near], dtype=np.uint64))
    want = simhash.groups(len(fps), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    got = simhash.links(spark, df, len(fps), 3).collect()
    at = {int(x): i for i, x in enumerate(fps)}
    assert (simhash.groups(len(fps), np.array([at[r.a] for r in got]), np.array([at[r.b] for r in got])) == want).all()


def test_stars(spark):
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    assert simhash._are_stars(frame([(3, 1), (2, 1), (9, 4)])) and simhash._are_stars(frame([]))
    assert not simhash._are_stars(frame([(3, 2), (2, 1)])) and not simhash._are_stars(frame([(3, 1), (3, 2)]))


# The pipeline's near copies


def test_a_set_fingerprint_bit_by_bit():
    rng = np.random.default_rng(3)
    count = np.array([3, 0, 1, 2, 70_000, 0, 5])
    flat = rng.integers(0, 1 << 64, int(count.sum()), dtype=np.uint64)
    got = shingle_links.set_fingerprints(flat, count)
    for fp, own in zip(got, np.split(flat, np.cumsum(count)[:-1]), strict=True):
        bits = sum(1 << b for b in range(64) if int(((own >> np.uint64(b)) & np.uint64(1)).sum()) * 2 > len(own))
        assert int(fp) == bits


def test_a_large_group_around_a_hub_that_joins_few(spark, monkeypatch):
    """Texts that share two thirds of their shingles with all others, and a near copy of each: links within tiles and between them."""
    monkeypatch.setattr(shingle_links, "TILE", 8)
    shared = words(260)
    rows = []
    for i in range(40):
        own = [*shared, *words(48)]
        twin = [*own[:-1], "other"]
        rows += [(i, " ".join(own)), (100 + i, " ".join(twin))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    five = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    jac = lambda a, b: len(five[a] & five[b]) / len(five[a] | five[b])
    assert jac(0, 100) > 0.9 and max(jac(i, j) for i in range(5) for j in range(i)) < 0.8
    assert sorted(r.doc_id for r in shingle_links.without_copies(docs).collect()) == list(range(40))
