"""The pipeline's near-dedup stage on null and repeated doc_ids: rows go by themselves, one of each group stays."""
import random

import corpus_pipeline as P

RND = random.Random(5)
A, B, C, D = (" ".join(f"w{RND.randrange(5000)}" for _ in range(100)) for _ in range(4))
NEAR_A = " ".join(["other", *A.split()[1:]])


def left(spark, rows):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_chars int")
    return sorted(((r.doc_id, r.text) for r in P.near_dedup(spark, docs, "").collect()), key=str)


def test_rows_without_id_stay_unless_they_are_copies(spark):
    got = left(spark, [(1, A), (None, NEAR_A), (None, B), (None, C)])
    assert got == sorted([(1, A), (None, B), (None, C)], key=str)


def test_one_row_of_a_group_without_ids_stays(spark):
    assert left(spark, [(None, A), (None, A), (None, B)]) == sorted([(None, A), (None, B)], key=str)


def test_an_id_on_two_texts(spark):
    got = left(spark, [(1, A), (2, NEAR_A), (2, B), (3, B), (4, C), (4, D)])
    assert got == sorted([(1, A), (2, B), (4, C), (4, D)], key=str)


def test_repeated_rows_and_texts_without_words(spark):
    assert left(spark, [(5, A), (5, A), (6, None), (7, ""), (8, " \n"), (9, "one"), (9, "One")]) in ([(5, A), (6, None), (9, x)] for x in ("one", "One"))
    assert left(spark, [(1, A)]) == [(1, A)] and left(spark, []) == []
