"""python -m sparlink.plans.package MATCHES CANDIDATES SOURCE1 OUT.zip: validates two result files and packs them.

The files are tab-separated id lists with a header, small enough for one machine once written as single files.
"""
from __future__ import annotations

import sys
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import line_problems, matches_outside, validate_lists
from ..sources.entities import gold_links, scan_lines


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """(s1_id, ids) of a result file."""
    return spark.read.csv(path, sep="\t", header=True, quote="", enforceSchema=True, schema="s1_id string, ids string").fillna("")


def problems(spark: SparkSession, matches: str, candidates: str, source: str) -> list[str]:
    """What is wrong with two result files; an empty list if nothing is."""
    ids = scan_lines(spark, source).select(F.col("entity_id").alias("s1_id"))
    out = []
    for path in (matches, candidates):
        out += [f"{path}: {r.n} lines: {r.problem}" for r in line_problems(spark, path).collect()]
        out += [f"{path}: {r.n} times {r.check}: {r.examples}" for r in validate_lists(read_lists(spark, path), ids).collect()]
    links = [gold_links(read_lists(spark, p), "s1_id", "ids").where("target_id is not null") for p in (matches, candidates)]
    outside = matches_outside(*links).count()
    return out + [f"{outside} matches aren't candidates"] * bool(outside)


def pack(paths: dict[str, str], to: str) -> None:
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for name, path in paths.items():
            z.write(path, name)


def main(args: list[str]) -> int:
    matches, candidates, source, to = args
    spark = SparkSession.builder.appName("package").getOrCreate()
    found = problems(spark, matches, candidates, source)
    print("\n".join(found) or "valid")
    if not found:
        pack({"matching_results.tsv": matches, "candidate_pairs.tsv": candidates}, to)
    return bool(found)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
