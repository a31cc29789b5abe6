"""Statements and ledgers as streams: each payment once, however often its file arrives, and balances with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyspark.operators.ingest import statement_outcomes


def statement_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of statement files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def import_stream(rows: DataFrame, place: str) -> None:
    """Imports statement files until no more are there: the accepted payments of every micro-batch are appended to
    ``place``/accepted under the batch's number. A file lies in one micro-batch, so equal rows in it are told apart by their
    occurrence, as in a batch import; what earlier batches accepted is looked up in the table, and a batch that is
    repeated after a failure replaces only its own part. rows: (file, row_no, reference, date, amount, payer, narration, direction)."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = _earlier(spark, f"{place}/accepted", number)
        out = statement_outcomes(batch, stored).where("outcome in ('accepted', 'near_duplicate')")
        full = out.join(batch.select("file", "row_no", "date", "payer", "narration"), ["file", "row_no"])
        full.select("dedup_hash", F.col("date").alias("posted_at"), "amount_minor", "payer", "narration", "outcome").write.mode("overwrite").parquet(f"{place}/accepted/batch={number}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()


def _earlier(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """What the batches before ``number`` accepted, or None."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.parquet(path).where(F.col("batch") < number) if there else None


_SIGNS = {"charge_created": 1, "allocation": -1, "credit_application": -1}


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One student's events in order of their numbers: what is owed, events that may still be reversed, reversals that came
    before what they name."""
    owed, seen, ids, amounts, early = state.get if state.exists else (0, 0, [], [], [])
    open_, waiting = dict(zip(ids, amounts)), set(early)
    for frame in frames:
        for event, kind, amount, target in frame.sort_values("event_id")[["event_id", "event_type", "amount_minor", "reverses_event_id"]].itertuples(index=False):
            seen += 1
            if kind == "reversal":
                if int(target) in open_:
                    owed -= open_.pop(int(target))
                else:
                    waiting.add(int(target))
            elif event in waiting:
                waiting.discard(event)
            elif kind in _SIGNS:
                open_[int(event)] = _SIGNS[kind] * int(amount)
                owed += _SIGNS[kind] * int(amount)
    state.update((owed, seen, list(open_), list(open_.values()), list(waiting)))
    yield pd.DataFrame({"student_id": [key[0]], "owed": [owed], "events": [seen]})


def student_balances(events: DataFrame) -> DataFrame:
    """(student_id, owed, events) of every student with new events, as a stream with state: charges less what was paid, net of
    reversals, which may come before or after in the log. The state of a student grows with the student's events only."""
    kind = dict(events.dtypes)["student_id"]
    return events.select("student_id", "event_id", "event_type", "amount_minor", "reverses_event_id").groupBy("student_id").applyInPandasWithState(
        _fold, f"student_id {kind}, owed bigint, events bigint", "owed bigint, seen bigint, ids array<bigint>, amounts array<bigint>, early array<bigint>", "update", GroupStateTimeout.NoTimeout
    )


def student_stream(events: DataFrame, place: str) -> None:
    """Writes the balances of every micro-batch to ``place``/balances under the batch's number."""
    sink = append_once(f"{place}/balances")
    student_balances(events).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{place}/balance-state").trigger(availableNow=True).start().awaitTermination()


def append_once(path: str):
    """A sink for foreachBatch: a batch is written under its number, so a repeated batch replaces only itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
