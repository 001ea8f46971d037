"""The pipeline's near-dedup compares all fingerprints by tiles, whatever cells the texts are in."""
from pyspark.sql import functions as F

from sparlink.llm import shingle_links as SL


def test_close_texts_of_no_common_cell(spark):
    words = [f"w{i}" for i in range(4000)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(f"v{i}" for i in range(4000)))]
    rows = SL.tagged(spark.createDataFrame(docs, "doc_id long, text string"), "text", 5)
    apart = rows.withColumn("bands", F.array("rid")).localCheckpoint()
    node = {r.row.doc_id: (r.node, r.fp) for r in apart.collect()}
    assert bin((node[1][1] ^ node[2][1]) & (2**64 - 1)).count("1") <= 3
    got = {r.node: r.root for r in SL.similar_groups(apart).collect()}
    low, high = sorted((node[1][0], node[2][0]))
    assert got == {high: low}
