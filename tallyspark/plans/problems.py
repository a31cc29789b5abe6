"""Queries of the data-preparation problems that belong to the core: timestamps (5) and reject rows (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import instants, records
from tallyspark.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, row_id, utc_us): every text of both tables that denotes an instant."""
    rules = instants.feed_rules(table(spark, folder, "feed_zones"))

    def found(name: str, text: str, feed: str) -> DataFrame:
        return table(spark, folder, name, "row_id", text, feed).select(
            F.lit(name).alias("table_name"),
            "row_id",
            instants.utc_micros(F.col(text), F.col(feed), rules).alias("utc_us"),
        )

    both = found("bank_statement", "date", "feed").unionByName(found("canonical_transactions", "posted_at", "source"))
    return both.where("utc_us is not null")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """(line_id, reason): the raw records that give no valid row."""
    return records.rejects(table(spark, folder, "statement_lines", "line_id", "raw_line"))


def p7_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(line_id, reference, date, amount, payer, narration, direction): the valid rows."""
    return records.accepted(table(spark, folder, "statement_lines", "line_id", "raw_line"))


QUERIES = {"p5_found": p5_found, "p7_found": p7_found, "p7_rows": p7_rows}
_FIELD = '"(?:[^"]|"")*"|[^",\\r\\n]*'
_CUT = ", ".join(f"regexp_extract(l, '(?s)^({_FIELD}),({_FIELD}),({_FIELD}),({_FIELD}),({_FIELD}),({_FIELD})$', {k}) as f{k}" for k in range(1, 7))
_BARE = "case when starts_with({f}, '\"') then replace(substr({f}, 2, length({f}) - 2), '\"\"', '\"') else {f} end"
_STRIP = "regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_ISO = "[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ](?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?(?:Z|[+-](?:[01][0-9]|2[0-3])(?::?[0-5][0-9])?)?)?"
_PARSED = (
    "with r as (select line_id, regexp_replace(regexp_replace(coalesce(raw_line, ''), '^\\x{FEFF}', ''), '(\\r\\n|\\n|\\r)$', '') as l from statement_lines), "
    f"q as (select *, regexp_full_match(l, '(?s)(?:{_FIELD})(?:,(?:{_FIELD}))*') as formed, regexp_replace(l, '\"(?:[^\"]|\"\")*\"', '', 'g') as bare from r), "
    f"f as (select line_id, formed, length(bare) - length(replace(bare, ',', '')) + 1 as n, {_CUT} from q), "
    "v as (select line_id, formed, n, "
    + ", ".join(f"{_BARE.format(f=f'f{k}')} as {name}" for k, name in ((1, "reference"), (4, "payer"), (5, "narration")))
    + ", "
    + ", ".join(f"{_STRIP.format(x=_BARE.format(f=f'f{k}'))} as {name}" for k, name in ((2, "date"), (3, "amount"), (6, "direction")))
    + " from f), d as (select *, case when regexp_full_match(date, '"
    + _ISO
    + "') then substr(date, 1, 10) when regexp_full_match(date, '[0-9]{2}/[0-9]{2}/[0-9]{4}') then substr(date, 7, 4) || '-' || substr(date, 4, 2) || '-' || substr(date, 1, 2) end as day from v), "
    "p as (select *, case when not formed then 'quoting' when n <> 6 then 'column_count' when not regexp_full_match(amount, '₦?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\\.[0-9]{1,2})?') then 'amount' "
    "when lower(direction) not in ('credit', 'debit', '') then 'direction' when day is null or substr(day, 1, 4) = '0000' or try_cast(day as date) is null then 'date' end as reason from d) "
)
ORACLE: dict[str, str] = {
    "p7_found": _PARSED + "select line_id, reason from p where reason is not null",
    "p7_rows": _PARSED + "select line_id, reference, date, amount, payer, narration, direction from p where reason is null",
}
