"""The queries of this subpackage: opN_<name>, each over its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_trie import bpe_encode_decode
from .common import new_dir, tokenizer_path, utf8, written
from .deleted_lm import lm_scores
from .importance import importance_resample
from .line_dedup import drop_repeated_lines
from .media_sniff import sniffed, text_payload, wav_of
from .packing import pack
from .quality_rules import quality_rules
from .simhash import near_duplicates
from .token_shards import read_documents, write_token_shards
from .warc import read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return got.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "op4")
    write_warc(_table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe_encode_decode(_table(spark, sf_dir, "documents"), path=tokenizer_path())
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def quality_targets(labels: DataFrame) -> DataFrame:
    """(doc_id, target): labelled documents of good quality that are not toxic, against all other labelled ones."""
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return known.select("doc_id", F.expr("q = 1 and t = 0").alias("target"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    got = importance_resample(docs, quality_targets(_table(spark, sf_dir, "labels")))
    return got.select("row.doc_id", "n_features", "log_weight", "kept")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    stored = docs.select("doc_id", F.octet_length(utf8(F.col("text"))).cast("long").alias("n_bytes"), F.lit("application/octet-stream").alias("declared"), wav_of(text_payload(F.col("text"))).alias("media"))
    stored = written(stored, "media")  # what follows reads the stored bytes
    stored = stored.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    got = sniffed(stored, "media", "declared")
    n = F.octet_length("samples").cast("long")
    tail = F.crc32(F.expr("substring(samples, -64, 64)"))
    feature = F.concat_ws(";", "media_type", F.concat(F.lit("parts="), F.size("parts")), F.concat(F.lit("carved="), F.array_join(F.transform("parts", lambda x: x["type"]), ",")), F.concat(F.lit("seconds="), n / F.lit(8000.0)))
    return got.select("row.doc_id", "row.n_bytes", n.alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), tail.alias("tail_crc32"),
                      "row.media_bytes", "row.media_sha256", feature.alias("feature"), "corrected")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = write_token_shards(_table(spark, sf_dir, "documents"), new_dir(spark, "op6"), path=tokenizer_path(), end_id=1)
    return read_documents(spark, done)


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lm_scores(_table(spark, sf_dir, "documents"))
    return got.withColumn("doc_id", F.col("doc_id").cast("long"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    got = drop_repeated_lines(docs, "text", min_docs=10, least=1)
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pack(_table(spark, sf_dir, "documents"), path=tokenizer_path(), end_id=2, size=4096)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, seed=42, radius=3)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {
    "op1_quality_rules": op1_quality_rules, "op2_bpe": op2_bpe, "op3_quality_classifier": op3_quality_classifier, "op4_warc": op4_warc, "op5_media": op5_media,
    "op6_token_ids": op6_token_ids, "op7_lm": op7_lm, "op8_line_dedup": op8_line_dedup, "op9_packing": op9_packing, "op10_simhash": op10_simhash,
}
OP1_SQL = r"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents),
w as (select *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
win as (select r, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
tri as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from win),
rep as (select r, i from (select r, i, count(*) over (partition by r, g) as n from tri) where n > 1),
cov as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from rep) group by r),
m as (select w.r, doc_id, source, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words from w left join cov using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
h as (select source, count(*) as n, count(*) filter (where base_failed) as f from b group by source),
pr as (select sum(f) / sum(n) as mean, avg(f / n) as mr, var_pop(f / n) as v from h),
st as (select mean, least(greatest(case when v > 0 then mr * (1 - mr) / v - 1 else 1e6 end, 1), 1e6) as s from pr),
v as (select source, (f + mean * s) / (n + s) as rate, n + s as weight, least(0.8, greatest(0.3, 3 * mean)) as most from h, st)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rate - 2.33 * sqrt(rate * (1 - rate) / (weight + 1)) <= most as kept
from b join v on b.source is not distinct from v.source
"""

OP8_SQL = """
with rows as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
lines as (select r, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from rows),
keyed as (select r, i, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
often as (select key from keyed where length(key) >= 1 group by key having count(distinct r) >= 10),
marked as (select k.r, k.i, k.line, o.key is not null as dropped from keyed k left join often o on k.key = o.key)
select any_value(rows.doc_id) as doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
from marked join rows using (r) group by r
"""

OP4_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as payload_digest, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes from pages),
f as (select *, min(page_id) over (partition by html) as first from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from f
"""

ORACLES: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op4_warc": OP4_SQL, "op8_line_dedup": OP8_SQL}
