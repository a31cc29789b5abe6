"""Money: texts to integer minor units and back. Everything is a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The reference's rules for an amount: an optional sign of the currency, plain digits or groups of three, at
#: most two decimals. ASCII digits only; an exponent, a minus sign or a third decimal is no amount.
AMOUNT_PATTERN = r"^[+]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)?([.][0-9]{0,2})?$"


def parse_money(text: Column) -> Column:
    """Minor units (bigint) of an authored amount, or null if the text is none."""
    bare = F.trim(F.replace(F.trim(text), F.lit("₦"), F.lit("")))
    digits = F.replace(bare, F.lit(","), F.lit(""))
    good = bare.rlike(AMOUNT_PATTERN) & bare.rlike("[0-9]")
    return F.when(good, (digits.try_cast("decimal(38,2)") * 100).try_cast("bigint"))


def format_money(minor: Column) -> Column:
    """'₦1,234.56' with a leading minus sign for negative amounts."""
    size = F.abs(minor)
    whole = F.format_number((size - size % 100) / 100, 0)
    return F.concat(F.when(minor < 0, "-").otherwise(""), F.lit("₦"), whole, F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def format_money_plain(minor: Column) -> Column:
    """'1234.56' without grouping, as an input field shows it."""
    size = F.abs(minor)
    whole = ((size - size % 100) / 100).cast("bigint").cast("string")
    return F.concat(F.when(minor < 0, "-").otherwise(""), whole, F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))
