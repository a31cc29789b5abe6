import csv
import io
import re
from datetime import date

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.operators import records


def reasons(*lines):
    return records.parse(pa.array(lines, pa.string())).field("reason").to_pylist()


GOOD = 'R1,2025-01-31,"1,000.50",Ada,"fees, ""A""\nline two",credit'


@pytest.mark.parametrize(
    "line, reason",
    [
        (GOOD, None), ("﻿" + GOOD, None), (GOOD + "\r\n", None), ("R,31/01/2025,₦5,p,n,", None), ('"",2025-01-01T10:00Z,5.5,p,n, Debit ', None), ("R,2025-01-01 23:59:59+01:00,5,p,n,CREDIT", None),
        ('R,2025-01-01,5,"p,n,credit', "quoting"), ('R,2025-01-01,5,p"x,n,credit', "quoting"), ('R,2025-01-01,5, "p",n,credit', "quoting"), ('R,2025-01-01,5,"p"x,n,credit', "quoting"), ("R,2025-01-01,5,p\nq,n,credit", "quoting"),
        ("R,2025-01-01,5,p,n", "column_count"), ("R,2025-01-01,5,p,n,credit,", "column_count"), ("", "column_count"), (None, "column_count"), ("R;2025-01-01;5;p;n;credit", "column_count"),
        ("R,2025-01-01,,p,n,credit", "amount"), ("R,2025-01-01,₦ 5,p,n,credit", "amount"), ('R,2025-01-01,"12,34",p,n,credit', "amount"), ("R,2025-01-01,5.123,p,n,credit", "amount"), ("R,2025-01-01,-5,p,n,credit", "amount"), ("R,bad,abc,p,n,Dr", "amount"),
        ("R,bad,5,p,n,Dr", "direction"), ("R,2025-02-30,5,p,n,credit", "date"), ("R,,5,p,n,credit", "date"), ("R,2025-1-1,5,p,n,credit", "date"), ("R,2025-01-01T24:00,5,p,n,credit", "date"), ("R,31/02/2025,5,p,n,credit", "date"), ("R,0000-01-01,5,p,n,credit", "date"),
    ],
)
def test_reason(line, reason):
    assert reasons(line) == [reason] and reasons("x", line, GOOD) == ["column_count", reason, None]


def test_fields_are_unquoted():
    row = records.parse(pa.array([GOOD])).to_pylist()[0]
    assert row == {"reason": None, "reference": "R1", "date": "2025-01-31", "amount": "1,000.50", "payer": "Ada", "narration": 'fees, "A"\nline two', "direction": "credit"}


def brute(line):
    """A character by character reading of the rules."""
    fields, at, n = [], 0, len(line)
    while True:
        if at < n and line[at] == '"':
            at, text = at + 1, ""
            while True:
                if at >= n:
                    return "quoting"
                if line[at] == '"':
                    if line[at + 1 : at + 2] == '"':
                        text, at = text + '"', at + 2
                        continue
                    at += 1
                    break
                text, at = text + line[at], at + 1
            if at < n and line[at] != ",":
                return "quoting"
        else:
            end = line.find(",", at)
            text = line[at : end if end >= 0 else n]
            if any(c in text for c in '"\r\n'):
                return "quoting"
            at += len(text)
        fields.append(text)
        if at >= n:
            break
        at += 1
    if len(fields) != 6:
        return "column_count"
    if not re.fullmatch(r"₦?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]{1,2})?", fields[2].strip()):
        return "amount"
    if fields[5].strip().lower() not in ("credit", "debit", ""):
        return "direction"
    m = re.fullmatch(r"([0-9]{4})-([0-9]{2})-([0-9]{2})", fields[1].strip())
    try:
        date(*map(int, m.groups())) if m else 1 / 0
    except (ValueError, ZeroDivisionError):
        return "date"
    return None


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text('",\n₦1a', max_size=14) | st.builds(lambda a, b: f'R,2025-01-01,{a},"{b}",n,credit', st.text("1,.₦", max_size=5), st.text('",a\n', max_size=5)), max_size=6))
def test_equals_the_plain_reading(lines):
    lines = [x.rstrip("\n") for x in lines]
    assert reasons(*lines) == [brute(x) for x in lines]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text('",\nab ₦', max_size=6), min_size=4, max_size=4))
def test_round_trip_of_written_records(parts):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow([parts[0], "2025-01-01", "5", parts[1], parts[2], "credit"])
    row = records.parse(pa.array([out.getvalue()])).to_pylist()[0]
    assert row["reason"] is None and (row["reference"], row["payer"], row["narration"]) == tuple(parts[:3])


def test_tables(spark):
    df = spark.createDataFrame([(1, GOOD, "x"), (2, "a,b", "y"), (3, None, "z"), (4, GOOD, "w")], "line_id bigint, raw_line string, reason string")
    assert {(r.line_id, r.reason) for r in records.rejects(df).collect()} == {(2, "column_count"), (3, "column_count")}
    assert sorted(r.line_id for r in records.accepted(df).collect()) == [1, 4]
    assert records.rejects(df.limit(0)).count() == 0 and records.accepted(df.limit(0)).columns == ["line_id", *records.FIELDS]
    long = spark.createDataFrame([(1, "R,2025-01-01,5,p," + "n" * 200_000 + ",credit")], "line_id bigint, raw_line string")
    assert records.accepted(long).first().narration == "n" * 200_000
