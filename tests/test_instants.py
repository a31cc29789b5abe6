from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pyarrow as pa
import pytest

from tallyspark.functions.zones import zone_table
from tallyspark.operators import instants

ZONES = {"lagos": ("Africa/Lagos", True), "ny": ("America/New_York", False), "berlin": ("Europe/Berlin", True), "london": ("Europe/London", True), "kolkata": ("Asia/Kolkata", True)}


def convert(*pairs):
    zones = {f: (zone_table(z), d) for f, (z, d) in ZONES.items()}
    return instants.convert(pa.array([t for t, _ in pairs], pa.string()), pa.array([f for _, f in pairs], pa.string()), zones).to_pylist()


def us(*parts, zone="UTC", fold=0):
    at = datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold).astimezone(timezone.utc)
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


@pytest.mark.parametrize(
    "text, feed, expected",
    [
        ("2025-07-03T22:54:41Z", "ny", us(2025, 7, 3, 22, 54, 41)),
        ("2025-07-03 22:54", "lagos", us(2025, 7, 3, 22, 54, zone="Africa/Lagos")),
        ("03/07/2025", "lagos", us(2025, 7, 3, zone="Africa/Lagos")),
        ("03/07/2025", "ny", us(2025, 3, 7, zone="America/New_York")),
        ("3.7.25", "berlin", us(2025, 7, 3, zone="Europe/Berlin")),
        ("5-JUN-2026", "lagos", us(2026, 6, 5, zone="Africa/Lagos")),
        ("11 Jan 26", "lagos", us(2026, 1, 11, zone="Africa/Lagos")),
        ("20241128", "kolkata", us(2024, 11, 28, zone="Asia/Kolkata")),
        ("20260422151846", "kolkata", us(2026, 4, 22, 15, 18, 46, zone="Asia/Kolkata")),
        ("20250709T121040Z", "kolkata", us(2025, 7, 9, 12, 10, 40)),
        ("1771326546", "lagos", 1771326546_000_000),
        ("1747942707804", "lagos", 1747942707_804_000),
        ("24/06/2025 8:59 PM", "lagos", us(2025, 6, 24, 20, 59, zone="Africa/Lagos")),
        ("24/06/2025 12:05 AM", "lagos", us(2025, 6, 24, 0, 5, zone="Africa/Lagos")),
        ("Wed, 13 Nov 2024 18:03:55 +0100", "ny", us(2024, 11, 13, 17, 3, 55)),
        ("2025-07-30 03:00:35 WAT", "lagos", us(2025, 7, 30, 2, 0, 35)),
        ("2024-11-03 01:49:34 EST", "ny", us(2024, 11, 3, 6, 49, 34)),
        ("2024-11-03 01:49:34 EDT", "ny", us(2024, 11, 3, 5, 49, 34)),
        ("2024-11-03 01:49:34", "ny", us(2024, 11, 3, 5, 49, 34)),
        ("2025-03-09 02:38:13 America/New_York", "ny", us(2025, 3, 9, 7, 38, 13)),
        ("2025-10-26T02:30:00", "berlin", us(2025, 10, 26, 0, 30)),
        ("2025-03-30T02:30:00", "berlin", us(2025, 3, 30, 1, 30)),
        ("2026-01-29T16:05:58.0494619+05:30", "ny", us(2026, 1, 29, 10, 35, 58, 49461)),
        ("  2025-01-01 ", "lagos", us(2025, 1, 1, zone="Africa/Lagos")),
        ("2024-02-29", "lagos", us(2024, 2, 29, zone="Africa/Lagos")),
    ],
)
def test_notations(text, feed, expected):
    assert convert((text, feed)) == [expected]


@pytest.mark.parametrize("text", [None, "", "   ", "pending", "n/a", "--", "2025-02-29", "2025-13-04 10:00", "31/31/2025", "0000-00-00", "2025-01-01 25:00", "2025-01-01 10:61", "13:00 PM", "2025-01-01X10:00:00", "12345", "2025-01-01 10:00:00 Nowhere/City", "2025-01-01 10:00:00 XYZ", "١٢/٠٣/٢٠٢٥", "2025/01-01", "x" * 5000])
def test_no_instant(text):
    assert convert((text, "lagos")) == [None]


def test_a_feed_without_zone_gives_only_what_needs_none():
    assert convert(("2025-01-01", "who"), ("2025-01-01", None), ("2025-01-01T00:00:00Z", None), ("1735689600", "who")) == [None, None, us(2025, 1, 1), 1735689600_000_000]
    assert convert() == []


@pytest.mark.parametrize("name", ["Europe/London", "America/New_York", "Africa/Lagos", "Asia/Kolkata", "Australia/Sydney"])
def test_zone_tables_agree_with_the_standard_library(name):
    import numpy as np

    rng = np.random.default_rng(5)
    walls = rng.integers(1_600_000_000, 1_900_000_000, 3000) // 900 * 900
    ours = zone_table(name).to_utc(walls * 1_000_000) // 1_000_000
    zone = ZoneInfo(name)
    for wall, at in zip(walls.tolist(), ours.tolist()):
        assert at == int(datetime.fromtimestamp(wall, timezone.utc).replace(tzinfo=zone).timestamp()), wall


def test_table_with_clashing_columns(spark):
    df = spark.createDataFrame([("2025-01-01", "lagos", 5), (None, "lagos", 6)], "text string, feed string, utc_us int")
    zones = spark.createDataFrame([("lagos", "Africa/Lagos", True)], "feed string, zone string, day_first boolean")
    got = instants.with_instants(df, "text", "feed", zones, "at").orderBy("utc_us").collect()
    assert [r.at for r in got] == [us(2024, 12, 31, 23), None] and got[0].utc_us == 5
    assert instants.with_instants(df.limit(0), "text", "feed", zones).count() == 0
