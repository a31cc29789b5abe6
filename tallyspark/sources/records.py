"""Case files, calibration records, configuration, manifests and run folders."""

from __future__ import annotations

import hashlib
import json
import tomllib
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.calibration import FEATURES, VERSION


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One case per YAML file, read on the workers: (path, problem, case) with the case in the declared schema, or a problem."""
    from yaml import YAMLError, safe_load

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, problems = [], []
            for content in batch["content"]:
                try:
                    case = safe_load(bytes(content).decode("utf-8"))
                    problem = None if isinstance(case, dict) else "no mapping"
                except (UnicodeDecodeError, YAMLError):
                    case, problem = None, "no YAML"
                texts.append(json.dumps(case, default=str) if problem is None else None)
                problems.append(problem)
            yield pd.DataFrame({"path": batch["path"], "problem": problems, "text": texts})

    read = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, problem string, text string")
    return read.select("path", "problem", F.from_json("text", schema).alias("case"))


def calibration_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, refused) of records (features map<string,double>, features_version int, label boolean): refused ones carry the reason."""
    known = F.array(*map(F.lit, FEATURES))
    lacking = F.size(F.array_except(known, F.map_keys("features"))) > 0
    reason = F.when(F.col("features").isNull(), "no features").when(lacking, "missing feature").when(F.col("label").isNull(), "no label").when(F.coalesce("features_version", F.lit(-1)) != VERSION, "other version")
    judged = rows.withColumn("reason", reason)
    good = judged.where("reason is null").select(*(F.col("features")[f].alias(f) for f in FEATURES), "features_version", "label")
    return good, judged.where("reason is not null")


def load_config(path: str, locked: dict[str, object] | None = None) -> dict:
    """A JSON or TOML configuration; values that are locked must be as given."""
    text = Path(path).read_text(encoding="utf-8")
    config = tomllib.loads(text) if path.endswith(".toml") else json.loads(text)
    wrong = {k: config.get(k) for k, v in (locked or {}).items() if config.get(k) != v}
    if wrong:
        raise ValueError(f"locked values differ: {wrong}")
    return config


def canonical_hash(value: object, without: tuple[str, ...] = ()) -> str:
    """Digest of a value as JSON with sorted keys and no blanks; ``without`` names keys that do not count, such as a review."""
    kept = {k: v for k, v in value.items() if k not in without} if isinstance(value, dict) else value
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files, read on the workers."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_manifest(manifest: dict, path: str) -> None:
    """A manifest as readable JSON with sorted keys; it must be new."""
    with open(path, "x", encoding="utf-8") as out:
        json.dump(manifest, out, indent=2, sort_keys=True, ensure_ascii=False)


def run_folder(base: str, label: str, now: datetime | None = None) -> Path:
    """A new folder named by the moment in UTC and a label; it must not exist."""
    place = Path(base) / f"{(now or datetime.now(UTC)).astimezone(UTC):%Y%m%dT%H%M%SZ}-{label}"
    place.mkdir(parents=True, exist_ok=False)
    return place


def promote(draft: str, target: str, reviewer: str, checksum: str) -> dict:
    """Moves a reviewed draft of a case to its place if it is what was reviewed, and marks it so."""
    case = json.loads(Path(draft).read_text(encoding="utf-8"))
    if not reviewer.strip():
        raise ValueError("a review needs a reviewer")
    if canonical_hash(case, ("review",)) != checksum:
        raise ValueError("the draft is not what was reviewed")
    case["review"] = {"status": "reviewed", "reviewer": reviewer, "content_sha256": checksum}
    write_manifest(case, target)
    Path(draft).unlink()
    return case


def first_of_format(rows: DataFrame, kind: str, n: int) -> DataFrame:
    """The first n rows of a format in the order of their lines. rows: (line_no, format, ...)."""
    return rows.where(F.col("format") == kind).orderBy("line_no").limit(n)


def missing_formats(rows: DataFrame, wanted: tuple[str, ...] = ("app", "chat")) -> DataFrame:
    """(split, missing) of splits that lack a format. rows: (split, format)."""
    have = rows.groupBy("split").agg(F.collect_set("format").alias("have"))
    return have.select("split", F.array_except(F.array(*map(F.lit, wanted)), "have").alias("missing")).where(F.size("missing") > 0)


def mean_speed(rows: DataFrame) -> DataFrame:
    """(model, tokens_per_second, runs) of benchmark rows; runs without a figure do not count."""
    return rows.groupBy("model").agg(F.round(F.avg("tokens_per_second"), 6).alias("tokens_per_second"), F.count("tokens_per_second").alias("runs"))


def demo_rows(spark: SparkSession) -> dict[str, DataFrame]:
    """Invented rows of every kind of file, for trying an import."""
    make = spark.createDataFrame
    return {
        "students": make([(1, "STU-1", "Ada Quill", "JSS1", "T1", "Addy;"), (2, "STU-2", "Ben Quill", "SS1", "T1", "")], "row_no int, student_id string, name string, class string, term_id string, aliases string"),
        "guardians": make([(1, "G-1", "Mrs Cora Quill", "1234")], "row_no int, guardian_id string, name string, phone_suffix string"),
        "relationships": make([(1, "STU-1", "G-1"), (2, "STU-2", "G-1")], "row_no int, student_id string, guardian_id string"),
        "fees": make([("STU-1", "F1", "T1", 1, "50,000", "10"), ("STU-2", "F1", "T1", 2, "45,000", "10")], "student_id string, fee_id string, term_id string, row_no int, amount string, priority string"),
        "statement": make([("demo.csv", 1, "REF-1", "2026-01-05", "50,000", "C Quill", "fees STU-1", "credit"), ("demo.csv", 2, None, "2026-01-06", "45,000", "C Quill", "fees Ben", None)], "file string, row_no int, reference string, date string, amount string, payer string, narration string, direction string"),
    }
