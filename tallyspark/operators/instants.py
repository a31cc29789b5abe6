"""Mixed timestamp texts to one UTC instant (microseconds since 1970-01-01).

Method: every text is reduced to a *shape mask* (digits and letters by class, anything else as it is, all
run lengths kept). All texts of one mask have the same layout, so a mask is compiled to a parser once per
worker, and each batch is parsed mask by mask with array arithmetic on the raw bytes. Wall times are moved
to UTC through transition tables of the zone data, again as arrays.

Rules. Outer blanks do not matter. A text without zone is wall time of its feed's zone; a date alone is its
00:00; an abbreviation is one of the feed's zone; a repeated wall time is the first one; a skipped one moves
forward by the gap. Only digits: 8 or 14 are calendar date or wall time, 10 or 13 Unix seconds or
milliseconds. Two-digit years are 20xx. The order of all-number dates that do not start with the year is a
property of the feed. Null, blank, words and impossible dates give null, as does a text that needs a zone or
an order its (unknown or null) feed does not give. More than six fractional digits are cut to microseconds.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.zones import ZoneTable, tzdata_version, zone_table

#: At most so many feeds may be shipped with the task; the table is configuration, not data.
MAX_FEEDS = 100_000
#: Masks kept compiled per worker; beyond that the least recently used is compiled again.
MASK_CACHE = 4_096
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_DAYS = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])

_CLOCK = r"(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9{1,12}))?)?(?: ?(?P<ap>AA)(?!A))?"
_ZONE = r"(?: ?(?:(?P<off>[+-]99(?::?99)?)|(?P<zone>A+(?:[/_+-][A9]+)+)|(?P<abbr>A{1,5})))?"
_LAYOUTS = [
    re.compile(rf"^(?:A{{3,9}},? )?{body}(?:(?P<sep>A| |, ?){_CLOCK}{_ZONE})?$")
    for body in (
        r"(?P<y>9999)(?P<d1>[-/. ])(?P<m>99?)(?P<d2>[-/. ])(?P<d>99?)",
        r"(?P<n1>99?)(?P<d1>[-/. ])(?P<n2>99?)(?P<d2>[-/. ])(?P<y>9999|99)",
        r"(?P<d>99?)(?P<d1>[-/. ]?)(?P<mon>A{3,9})(?P<d2>[-/. ,]{0,2})(?P<y>9999|99)",
        r"(?P<mon>A{3,9}) (?P<d>99?),? (?P<y>9999)",
    )
] + [
    re.compile(rf"^(?P<y>9999)(?P<m>99)(?P<d>99)(?:(?P<sep>A)(?P<h>99)(?P<mi>99)(?P<s>99)(?:\.(?P<f>9{{1,12}}))?{_ZONE})?$"),
    re.compile(r"^(?P<y>9999)(?P<m>99)(?P<d>99)(?P<h>99)(?P<mi>99)(?P<s>99)$"),
]


@dataclass(frozen=True)
class Layout:
    """Where the parts of a mask lie: name to (start, end)."""

    parts: dict[str, tuple[int, int]]
    epoch: int = 0  # 10 or 13: Unix seconds or milliseconds


@functools.lru_cache(maxsize=MASK_CACHE)
def compile_mask(mask: str) -> Layout | None:
    """The layout of a mask, or None if no text of this shape denotes an instant."""
    if mask in ("9" * 10, "9" * 13):
        return Layout({}, len(mask))
    for pattern in _LAYOUTS:
        if m := pattern.match(mask):
            parts = {k: m.span(k) for k in m.groupdict() if m.span(k)[0] >= 0}
            first, second = parts.get("d1"), parts.get("d2")
            if first and second and mask[slice(*first)].strip(" ,") != mask[slice(*second)].strip(" ,"):
                continue
            return Layout(parts)
    return None


def shape_masks(texts: pa.Array) -> pa.Array:
    """Digits become 9, ASCII letters A; everything else stays."""
    return pc.replace_substring_regex(pc.replace_substring_regex(texts, r"[A-Za-z]", "A"), r"[0-9]", "9")


def _matrix(texts: pa.Array, width: int) -> np.ndarray:
    """Texts of one byte length as a byte matrix, without a copy per text."""
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset] if pa.types.is_string(texts.type) else 0
    return flat[start : start + len(texts) * width].reshape(len(texts), width)


def _number(b: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(b), np.int64)
    for k in range(*span):
        out = out * 10 + (b[:, k].astype(np.int64) - 48)
    return out


def _words(b: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    return np.ascontiguousarray(b[:, span[0] : span[1]]).view(f"S{span[1] - span[0]}").ravel()


def _month(b: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    words, back = np.unique(_words(b, span), return_inverse=True)
    full = ("january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december", "sept")

    def code(w: bytes) -> int:
        t = w.decode().lower()
        return _MONTHS.index(t[:3]) + 1 if t in _MONTHS or t in full else 0

    return np.array([code(w) for w in words], np.int64)[back]


def days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of proleptic Gregorian dates."""
    y = y - (m <= 2)
    era = np.floor_divide(y, 400)
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146_097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719_468


def _parse(layout: Layout, b: np.ndarray, feeds: np.ndarray, rules: list[tuple[ZoneTable | None, bool | None]]) -> tuple[np.ndarray, np.ndarray]:
    """(utc microseconds, valid) of the rows of one mask; feeds: an index into rules per row."""
    n, p = len(b), layout.parts
    if layout.epoch:
        return _number(b, (0, layout.epoch)) * (1_000_000 if layout.epoch == 10 else 1_000), np.ones(n, bool)
    ok = np.ones(n, bool)
    y = _number(b, p["y"])
    y = y + 2000 if p["y"][1] - p["y"][0] == 2 else y
    if "n1" in p:
        first = np.array([r[1] is True for r in rules])[feeds]
        ok &= np.array([r[1] is not None for r in rules])[feeds]
        one, two = _number(b, p["n1"]), _number(b, p["n2"])
        d, m = np.where(first, one, two), np.where(first, two, one)
    else:
        d, m = _number(b, p["d"]), _month(b, p["mon"]) if "mon" in p else _number(b, p["m"])
    ok &= (m >= 1) & (m <= 12) & (d >= 1) & (y >= 1)
    mm = np.clip(m, 1, 12)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    ok &= d <= _DAYS[mm - 1] + ((mm == 2) & leap)
    seconds, micros = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if "h" in p:
        if "sep" in p and p["sep"][1] - p["sep"][0] == 1 and not np.isin(b[:, p["sep"][0]], list(b" ,")).all():
            ok &= np.isin(b[:, p["sep"][0]], list(b"Tt ,"))
        h, mi = _number(b, p["h"]), _number(b, p["mi"])
        s = _number(b, p["s"]) if "s" in p else 0
        if "ap" in p:
            half = np.char.lower(_words(b, p["ap"]))
            ok &= ((half == b"am") | (half == b"pm")) & (h >= 1) & (h <= 12)
            h = h % 12 + np.where(half == b"pm", 12, 0)
        ok &= (h < 24) & (mi < 60) & (s < 60)
        seconds = h * 3600 + mi * 60 + s
        if "f" in p:
            digits = min(p["f"][1] - p["f"][0], 6)
            micros = _number(b, (p["f"][0], p["f"][0] + digits)) * 10 ** (6 - digits)
    wall = (days_from_civil(np.where(ok, y, 1970), np.where(ok, m, 1), np.where(ok, d, 1)) * 86_400 + seconds) * 1_000_000 + micros
    out = wall.copy()
    if "off" in p:
        a, z = p["off"]
        hours = _number(b, (a + 1, a + 3))
        minutes = _number(b, (z - 2, z)) if z - a > 3 else np.zeros(n, np.int64)
        ok &= (hours <= 18) & (minutes < 60)
        out = wall - np.where(b[:, a] == ord("-"), -1, 1) * (hours * 60 + minutes) * 60_000_000
    elif "zone" in p:
        names, back = np.unique(_words(b, p["zone"]), return_inverse=True)
        for k, name in enumerate(names):
            rows = back == k
            if (t := zone_table(name.decode())) is None:
                ok[rows] = False
            else:
                out[rows] = t.to_utc(wall[rows])
    elif "abbr" in p:
        names, back = np.unique(np.char.upper(_words(b, p["abbr"])), return_inverse=True)
        pair = back.astype(np.int64) * len(rules) + feeds
        for key in np.unique(pair):
            rows, name, t = pair == key, names[key // len(rules)].decode(), rules[key % len(rules)][0]
            known = t.abbreviations if t is not None else {}
            if name in known:
                out[rows] = wall[rows] - known[name] * 1_000_000
            elif name not in ("Z", "UTC", "GMT", "UT"):
                ok[rows] = False
    else:
        for k in np.unique(feeds):
            rows = feeds == k
            if rules[k][0] is None:
                ok[rows] = False
            else:
                out[rows] = rules[k][0].to_utc(wall[rows])
    return out, ok


def convert(texts: pa.Array, feeds: pa.Array, zones: dict[str, tuple[ZoneTable | None, bool | None]]) -> pa.Array:
    """UTC microseconds of a batch of texts, null where a text denotes no instant."""
    n = len(texts)
    texts = pc.utf8_trim_whitespace(pc.replace_substring_regex(texts.cast(pa.string()), "[\u00a0\u2009\u202f]", " "))
    coded = feeds.cast(pa.string()).dictionary_encode()
    names = [*coded.dictionary.to_pylist(), None]
    rules = [zones.get(x, (None, None)) for x in names]
    feed = np.asarray(coded.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False), np.int64)
    masks = shape_masks(texts).dictionary_encode()
    code = np.asarray(masks.indices.fill_null(-1).to_numpy(zero_copy_only=False), np.int64)
    out, ok = np.zeros(n, np.int64), np.zeros(n, bool)
    order = np.argsort(code, kind="stable")
    bounds = np.searchsorted(code[order], np.arange(len(masks.dictionary) + 1))
    for k, mask in enumerate(masks.dictionary.to_pylist()):
        layout = compile_mask(mask) if mask.isascii() else None
        if layout is None:
            continue
        rows = order[bounds[k] : bounds[k + 1]]
        out[rows], ok[rows] = _parse(layout, _matrix(texts.take(pa.array(rows)), len(mask)), feed[rows], rules)
    return pa.array(out, pa.int64(), mask=~ok)


def feed_rules(feed_zones: DataFrame) -> dict[str, tuple[str, bool]]:
    """feed -> (zone, day first) from the configuration table, whose size is checked."""
    rows = feed_zones.select("feed", "zone", "day_first").limit(MAX_FEEDS + 1).collect()
    if len(rows) > MAX_FEEDS:
        raise ValueError(f"more than {MAX_FEEDS} feeds: this is no configuration table")
    return {r.feed: (r.zone, r.day_first) for r in rows if r.feed is not None}


def utc_micros(text: Column, feed: Column, rules: dict[str, tuple[str, bool]]) -> Column:
    """A column of UTC microseconds (bigint, null where the text denotes no instant). The transition
    tables are built here, on the driver, so that every worker uses one release of the zone data."""
    udf = _converter(rules)
    return udf(text.cast("string"), feed.cast("string"))


def _converter(rules: dict[str, tuple[str, bool]]) -> Callable:
    tables = {z: zone_table(z) for z, _ in rules.values() if z is not None}
    zones = {f: (tables.get(z), day_first) for f, (z, day_first) in rules.items()}

    @F.arrow_udf("bigint")
    def instants(texts: pa.Array, feeds: pa.Array) -> pa.Array:
        return convert(texts, feeds, zones)

    # marked so that a filter on the result does not make the planner run it a second time
    return instants.asNondeterministic()


def with_instants(df: DataFrame, text: str, feed: str, feed_zones: DataFrame, out: str = "utc_us") -> DataFrame:
    """``df`` with a column ``out`` of the instants of ``text``; all other columns stay as they are."""
    return df.withColumn(out, utc_micros(F.col(f"`{text}`"), F.col(f"`{feed}`"), feed_rules(feed_zones)))


def zone_data_version() -> str:
    return tzdata_version()
