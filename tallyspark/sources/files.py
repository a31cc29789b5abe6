"""Readers and writers with the checks the engine relies on."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: largest upload accepted as one interactive file, in bytes.
MAX_UPLOAD = 1_000_000

#: Columns of each kind of register or statement file; all are read as text.
FIELDS = {
    "terms": ("term_id", "session", "term_name", "is_active"),
    "students": ("student_id", "name", "class", "term_id", "aliases"),
    "guardians": ("guardian_id", "name", "phone_suffix"),
    "relationships": ("student_id", "guardian_id"),
    "fees": ("student_id", "fee_id", "fee_name", "term_id", "amount", "priority"),
    "statement": ("reference", "date", "amount", "payer", "narration", "direction"),
}


def check_upload(path: str) -> None:
    """Refuses what cannot be an interactive CSV upload: another suffix, too large, not UTF-8, without header."""
    file = Path(path)
    if file.suffix.lower() != ".csv":
        raise ValueError("not a .csv file")
    if file.stat().st_size > MAX_UPLOAD:
        raise ValueError("the file is too large")
    try:
        text = file.read_bytes().decode("utf-8-sig")
    except UnicodeDecodeError as wrong:
        raise ValueError("the file is not UTF-8") from wrong
    if not text.strip():
        raise ValueError("the file has no header")


def read_csv(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """All columns as text, line breaks in quotes kept, short rows filled with null, extra columns preserved."""
    df = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", multiLine=True, escape='"', mode="PERMISSIVE")
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    for name in FIELDS.get(kind or "", ()):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def read_headerless(spark: SparkSession, path: str) -> DataFrame:
    """(question, choices, answer) of six-column rows without header."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("question", "a", "b", "c", "d", "answer")])
    df = spark.read.csv(path, schema=schema, header=False, multiLine=True, escape='"')
    return df.where("answer is not null").select("question", F.array("a", "b", "c", "d").alias("choices"), "answer")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object a line with a declared schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines with keys in alphabetical order, in the order of the given columns; the folder must be new."""
    ordered = df.orderBy(*order) if order else df
    ordered.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("errorifexists").text(path)


def append_only(df: DataFrame, path: str) -> None:
    """The only writer of an event log: adds files, never replaces any."""
    df.write.mode("append").parquet(path)


def snapshot(df: DataFrame, path: str) -> None:
    """A backup that never overwrites."""
    df.write.mode("errorifexists").parquet(path)
