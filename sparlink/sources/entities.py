"""Entity tables: scans of delimited files, the union of targets, gold links, folds, and result files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "name", "address", "country")])


def scan_lines(spark: SparkSession, path: str, quote: str = "") -> DataFrame:
    """Tab-separated entity rows by position: header skipped, missing columns empty; quote '"' for quoted files."""
    df = spark.read.csv(path, sep="\t", header=True, enforceSchema=True, schema=ENTITY, quote=quote, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False)
    return df.fillna("")


def scan_sniffed(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Columns found by parts of their header names (id, name, addr, country); the last that fits wins."""
    df = spark.read.csv(path, sep=sep, header=True, quote="" if sep == "\t" else '"')
    found: dict[str, str] = {}
    for c in df.columns:
        for part, to in (("country", "country"), ("addr", "address"), ("name", "name"), ("id", "entity_id")):
            if part in c.lower():
                found[to] = c
                break
    return df.select(*((F.col(f"`{found[c]}`") if c in found else F.lit("")).alias(c) for c in ENTITY.names)).fillna("")


def scan_named(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated rows with alternative column names and optional postal code and phone."""
    df = spark.read.csv(path, header=True, quote='"')
    first = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns), F.lit(""))
    return df.select(first("entity_id").alias("entity_id"), first("name", "entity_name").alias("name"), first("address").alias("address"),
                     first("country", "country_code", "address_country").alias("country"), first("postal_code", "zip").alias("postal_code"), first("phone").alias("phone"))


def union_targets(second: DataFrame, third: DataFrame, order: Column) -> DataFrame:
    """Both target tables with source and ord: the second table's rows come first, each in the given order.

    ord is sortable, not dense: (source, key) as a struct would do as well; it needs no window over all rows."""
    return second.withColumn("source", F.lit(2)).unionByName(third.withColumn("source", F.lit(3))).withColumn("ord", order)


def gold_links(df: DataFrame, s1_col: str = "source1_entity_id", list_col: str = "matched_entity_ids") -> DataFrame:
    """(s1_id, target_id) of comma-joined lists; entities without matches keep a row with a null target."""
    ids = F.filter(F.transform(F.split(F.coalesce(list_col, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(F.col(s1_col).alias("s1_id"), F.explode_outer(ids).alias("target_id"))


def fold_map(spark: SparkSession, path: str) -> DataFrame:
    """(s1_id, fold) of one JSON object from id to fold."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("s1_id", "fold"))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """(order, line_no) of df: the column's place from 1 in ascending order; no task has more than a range."""
    kind = df.schema[order].dataType.simpleString()
    rows = df.select(order).orderBy(order).rdd.zipWithIndex().map(lambda x: (x[0][0], x[1] + 1))
    return df.sparkSession.createDataFrame(rows, f"{order} {kind}, line_no long")


def joined_lists(s1: DataFrame, links: DataFrame, name: str, order: Column | None = None) -> DataFrame:
    """(s1_id, name): every S1 id with its distinct targets joined by commas, by id or in the given order; "" for none."""
    if order is None:
        lists = links.groupBy("s1_id").agg(F.array_join(F.sort_array(F.collect_set("target_id")), ",").alias(name))
    else:
        own = links.select("s1_id", F.struct(order.alias("o"), F.col("target_id").alias("t")).alias("x"))
        lists = own.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("x")), lambda x: x["t"]), ",").alias(name))
    return s1.select("s1_id").join(lists, "s1_id", "left").fillna("", [name])


def write_lists(df: DataFrame, path: str, single: bool = False, order: str | None = None) -> None:
    """A tab-separated result file with a header; one file only if asked, as the folder otherwise. order: a column by
    whose ranges the rows are sorted, so that the files, in the order of their names, are sorted as a whole."""
    df = df.coalesce(1) if single else df
    (df if order is None else df.sortWithinPartitions(order) if single else df.orderBy(order)).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


#: Accented letters of the fixture and the letters they fold to.
_FIXTURE_FOLD = ("üêÓíéÍçÜäóÖÉÈñöÊÄÑÇè", "ueOieIcUaoOEEnoEANCe")


def fixture_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities made from documents: (entity_id, name, address, country, cid, doc_id, source).

    Documents that share their first three words are one business (cid); the first is the query entity, the others its
    copies in the two target tables. One shuffle, by those words.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    plain = F.regexp_replace(F.translate("text", *_FIXTURE_FOLD), r"[^\x00-\x7F]", "")
    t = F.slice(F.split(F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " ")), " ", 6), 1, 5)  # no later word is used
    w = docs.select("doc_id", "lang", t.alias("t")).withColumn("stem", F.array_join(F.slice("t", 1, 3), " "))
    of = lambda i, other: F.coalesce(F.get("t", F.lit(i - 1)), F.lit(other))
    from pyspark.sql import Window

    own = Window.partitionBy("stem")
    c = w.withColumn("cid", F.min("doc_id").over(own)).withColumn("rn", F.row_number().over(own.orderBy("doc_id")))
    d, rn = F.col("doc_id"), F.col("rn")
    sp = F.lit(" ")
    base = F.when((d % 13 == 0) & (rn > 1), F.concat(of(3, ""), sp, F.get("t", F.lit(0)), sp, of(2, ""))).otherwise(F.col("stem"))
    legal = F.when(d % 5 == 0, " Inc.").when(d % 5 == 1, " LLC").when(d % 5 == 2, " Pvt Ltd").when(d % 5 == 3, " & Co").otherwise("")
    alias = F.when(d % 17 == 0, F.concat(F.lit(" dba "), of(4, "north"), sp, of(5, "star"))).otherwise("")
    number = (100 + F.col("cid") % 900 + F.when((d % 11 == 0) & (rn > 1), 1).otherwise(0)).cast("string")
    street = F.when(d % 3 == 0, "St").when(d % 3 == 1, "Road").otherwise("Ave")
    postal = F.when(d % 7 == 0, "").otherwise(F.concat(sp, (10000 + F.col("cid") % 90000).cast("string")))
    address = F.when(d % 31 == 0, "").otherwise(F.concat(number, sp, of(2, "main"), sp, street, postal))
    country = F.when(F.col("lang") == "en", "US").when(F.col("lang") == "fr", "France").when(F.col("lang") == "de", "India").otherwise("")
    source = F.when(rn == 1, 1).when(d % 2 == 0, 2).otherwise(3)
    return c.select(F.concat(F.lit("S"), source.cast("string"), F.lit("-"), d.cast("string")).alias("entity_id"), F.concat(base, legal, alias).alias("name"),
                    address.alias("address"), country.alias("country"), "cid", "doc_id", source.alias("source"))
