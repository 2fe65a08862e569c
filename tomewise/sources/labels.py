"""Class labels: a TSV lookup, and its making from a Turtle file."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Patterns of a subject with its type, a notation and a Japanese label. Fixed values.
SUBJECT, NOTATION, LABEL = r"(?m)^ndc9:(\S+) a ([^;]+);", r'skos:notation "([^"]*)"', r'skos:prefLabel "([^"]*)"@ja'


def read_labels(spark: SparkSession, path: str | Path) -> DataFrame:
    """(ndc3, label); blank lines and lines that start with ``#`` are skipped."""
    return spark.read.schema("ndc3 string, label string").csv(Path(path).resolve().as_uri(), sep="\t", comment="#", quote="")


def no_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "ndc3 string, label string")


def labels_of_turtle(spark: SparkSession, path: str | Path) -> DataFrame:
    """(ndc3, label) of the three-digit classes of a Turtle file, variants left out, sorted; a repeated class raises ``ValueError``."""
    blocks = spark.read.option("lineSep", "\n.\n").text(Path(path).resolve().as_uri())
    part = lambda pattern, k: F.regexp_extract("value", pattern, k)
    rows = blocks.where(F.regexp_like("value", F.lit(SUBJECT)) & F.regexp_like("value", F.lit(LABEL))).select(part(SUBJECT, 2).alias("kind"), part(NOTATION, 1).alias("ndc3"), part(LABEL, 1).alias("label"))
    rows = rows.where(F.regexp_like("ndc3", F.lit("^[0-9]{3}$")) & ~F.contains("kind", F.lit("ndcv:Variant"))).select("ndc3", "label")
    twice = [r["ndc3"] for r in rows.groupBy("ndc3").agg(F.count("*").alias("n")).where("n > 1").orderBy("ndc3").collect()]
    if twice:
        raise ValueError(f"Repeated classes: {', '.join(twice)}")
    return rows.orderBy("ndc3")
