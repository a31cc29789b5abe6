"""Raw CSV records into valid rows and rejects with a reason.

Method: structural indexing. A batch of records is one byte buffer; a mask of its quotes and the prefix
parity of that mask tell, for every byte, whether it lies inside quotes. Commas outside are delimiters,
quotes at odd places break the rules of RFC 4180, and counts per record follow from prefix sums. Field
values are cut out of the buffer column by column and checked with vectorised patterns.

The reason is the first that holds of ``quoting``, ``column_count``, ``amount``, ``direction``, ``date``;
null means a valid row. A null record counts as an empty one (one empty field). A single line end after the
record is its terminator. A leading byte-order mark and outer blanks of amount, direction and date are no
fault; valid rows carry those three fields without outer blanks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("reference", "date", "amount", "payer", "narration", "direction")
_AMOUNT = r"^₦?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]{1,2})?$"
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ](?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?(?:Z|[+-](?:[01][0-9]|2[0-3])(?::?[0-5][0-9])?)?)?$"
_DMY = r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"
_DAYS = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
_NL, _CR, _QUOTE, _COMMA = 10, 13, 34, 44


def structure(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(badly quoted per record, positions of delimiters, number of delimiters per record).

    offsets: n + 1 byte positions; record k is buffer[offsets[k]:offsets[k + 1]].
    """
    n, size = len(offsets) - 1, len(buffer)
    starts, ends = offsets[:-1], offsets[1:]
    quote = buffer == _QUOTE
    seen = np.concatenate([[0], np.cumsum(quote)])  # quotes before a position, over the whole buffer
    lengths = ends - starts
    record = np.repeat(np.arange(n), lengths)
    inside = ((seen[:-1] - seen[starts][record]) & 1).astype(bool)
    delimiter = (buffer == _COMMA) & ~inside
    bad = ((seen[ends] - seen[starts]) & 1).astype(bool)
    before, after = np.zeros(size, bool), np.zeros(size, bool)  # may stand before an opening / after a closing quote
    if size:
        edge = delimiter | quote
        before[1:], after[:-1] = edge[:-1], edge[1:]
        some = lengths > 0
        before[starts[some]] = True
        after[ends[some] - 1] = True
    fault = (quote & ~inside & ~before) | (quote & inside & ~after) | (((buffer == _NL) | (buffer == _CR)) & ~inside)
    bad |= np.bincount(record[fault], minlength=n).astype(bool)
    return bad, np.flatnonzero(delimiter), np.bincount(record[delimiter], minlength=n)


def _cut(buffer: pa.Buffer, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Spans of a buffer as strings, unquoted; built from one gather."""
    data = np.frombuffer(buffer, np.uint8)
    quoted = (ends > starts) & (data[np.minimum(starts, max(len(data) - 1, 0))] == _QUOTE) if len(data) else np.zeros(len(starts), bool)
    starts, ends = starts + quoted, ends - quoted
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    take = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths) + np.repeat(starts, lengths)
    text = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[take].tobytes()))
    return pc.replace_substring(text, '""', '"')


def _existing_day(dates: pa.Array, iso: np.ndarray, dmy: np.ndarray) -> np.ndarray:
    def part(rows: np.ndarray, a: int, z: int) -> np.ndarray:
        if not rows.any():
            return np.zeros(0, np.int64)
        return pc.utf8_slice_codeunits(dates.filter(pa.array(rows)), a, z).cast(pa.int64()).to_numpy(zero_copy_only=False)

    y, m, d = (np.zeros(len(dates), np.int64) for _ in range(3))
    y[iso], m[iso], d[iso] = part(iso, 0, 4), part(iso, 5, 7), part(iso, 8, 10)
    d[dmy], m[dmy], y[dmy] = part(dmy, 0, 2), part(dmy, 3, 5), part(dmy, 6, 10)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    month = np.where((m >= 1) & (m <= 12), m, 0)
    return (y >= 1) & (d >= 1) & (d <= _DAYS[month] + ((month == 2) & leap))


def parse(lines: pa.Array) -> pa.StructArray:
    """reason and the six fields of each record of a batch; the fields are null where there is a reason."""
    lines = pc.fill_null(lines.cast(pa.string()), "")
    lines = pc.replace_substring_regex(pc.replace_substring_regex(lines, "^\ufeff", ""), "(\r\n|\n|\r)$", "")
    lines = pa.concat_arrays([lines.chunk(k) for k in range(lines.num_chunks)]) if isinstance(lines, pa.ChunkedArray) else lines
    n = len(lines)
    offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = lines.buffers()[2] if n and lines.buffers()[2] is not None else pa.py_buffer(b"")
    raw = raw.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    offsets = offsets - offsets[0]
    bad, where, count = structure(np.frombuffer(raw, np.uint8), offsets)
    reason = np.full(n, None, object)
    reason[count != len(FIELDS) - 1] = "column_count"
    reason[bad] = "quoting"
    good = np.flatnonzero(reason == None)  # noqa: E711
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    columns: dict[str, pa.Array] = {}
    for k, name in enumerate(FIELDS):
        a = offsets[good] if k == 0 else where[first[good] + k - 1] + 1
        z = offsets[good + 1] if k == len(FIELDS) - 1 else where[first[good] + k]
        columns[name] = _cut(raw, a, z)
    for name in ("amount", "direction", "date"):
        columns[name] = pc.utf8_trim_whitespace(columns[name])
    as_bools = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
    amount = as_bools(pc.match_substring_regex(columns["amount"], _AMOUNT))
    direction = as_bools(pc.is_in(pc.utf8_lower(columns["direction"]), pa.array(["credit", "debit", ""])))
    iso, dmy = (as_bools(pc.match_substring_regex(columns["date"], p)) for p in (_ISO, _DMY))
    date = _existing_day(columns["date"], iso, dmy)
    reason[good] = np.select([~amount, ~direction, ~date], ["amount", "direction", "date"], "")
    valid = np.full(n, -1, np.int64)
    valid[good] = np.arange(len(good))
    fine = reason == ""
    reason[fine] = None
    index = pa.array(valid, pa.int64(), mask=~fine)
    return pa.StructArray.from_arrays([pa.array(reason, pa.string()), *(columns[f].take(index) for f in FIELDS)], ["reason", *FIELDS])


@F.arrow_udf(T.StructType([T.StructField(name, T.StringType()) for name in ("reason", *FIELDS)]))
def _parsed(lines: pa.Array) -> pa.Array:
    return parse(lines)


def parsed(line: Column) -> Column:
    """A struct of ``reason`` (null for a valid row) and the six fields."""
    return _parsed(line.cast("string"))


#: Marked so that a filter on the result does not make the planner run it a second time.
_parsed = _parsed.asNondeterministic()


def rejects(df: DataFrame, key: str = "line_id", line: str = "raw_line") -> DataFrame:
    """(key, reason) of the records that give no valid row."""
    out = df.select(F.col(f"`{key}`").alias(key), parsed(F.col(f"`{line}`")).alias("_parsed"))
    return out.select(key, F.col("_parsed.reason").alias("reason")).where("reason is not null")


def accepted(df: DataFrame, key: str = "line_id", line: str = "raw_line") -> DataFrame:
    """(key, the six fields) of the records that give a valid row."""
    out = df.select(F.col(f"`{key}`").alias(key), parsed(F.col(f"`{line}`")).alias("_parsed"))
    return out.where("_parsed.reason is null").select(key, *(F.col(f"_parsed.{f}").alias(f) for f in FIELDS))
