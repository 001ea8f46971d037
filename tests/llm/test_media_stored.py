from pyspark.sql import functions as F

from sparlink.llm import queries


def test_features_come_from_stored_bytes(spark, sf, monkeypatch):
    """A store that damages the media shows in the result."""
    tags, real = [], queries.written

    def lossy(df, tag, *more):
        tags.append(tag)
        return real(df, tag, *more).withColumn("media", F.expr("substring(media, 1, 40)"))

    monkeypatch.setattr(queries, "written", lossy)
    got = queries.op5_media(spark, sf).select("media_bytes").distinct().collect()
    assert tags == ["media"] and [r.media_bytes for r in got] == [40]
