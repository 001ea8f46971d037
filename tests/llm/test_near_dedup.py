"""The pipeline's near-dedup stage against all pairs' Jaccard similarities, and on null and repeated doc_ids."""
import random

import corpus_pipeline as P


def five(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def left(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = P.near_dedup(spark, docs, "").collect()
    return sorted(((r.doc_id, r.text) for r in got), key=str)


def test_near_copies_go(spark):
    rnd = random.Random(3)
    rows, base = [], []
    for i in range(60):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(100, 400))]
        base.append((i, " ".join(words), 0))
        for at in rnd.sample(range(len(words)), max(1, len(words) // rnd.randrange(30, 70))):
            words[at] = f"x{rnd.randrange(5000)}"
        rows.append((100 + i, " ".join(words), 0))
    rows = [*base, *rows]
    # Components of all pairs at 0.8 and more.
    sets, root = {i: five(t) for i, t, _ in rows}, {i: i for i, _, _ in rows}
    for i in range(60):
        a, b = sets[i], sets[100 + i]
        if len(a & b) >= 0.8 * len(a | b):
            root[100 + i] = i
    want = sorted(set(root.values()))
    assert 65 < len(want) < 110  # both kinds of pairs
    assert sorted(i for i, _ in left(spark, rows)) == want


def test_a_chain_whose_hub_joins_only_a_part(spark):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(12):  # neighbours are similar, the ends are not
        rows.append((i, " ".join(words), 0))
        for at in range(i * 30 + 2, i * 30 + 22, 5):
            words[at] = f"x{at}"
    a, b, z = five(rows[0][1]), five(rows[1][1]), five(rows[-1][1])
    assert len(a & b) >= 0.8 * len(a | b) and len(a & z) < 0.5 * len(a | z)
    assert [i for i, _ in left(spark, rows)] == [0]
