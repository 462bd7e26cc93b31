"""Spelling, money and calendar expressions; all of them stay inside the JVM.

None of them raises on dirty values: blank keys, NaN, infinite and overflowing amounts all become null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import TimestampNTZType

BLANKS = " \t\r\n"
SATS = 100_000_000


def clean(c: Column) -> Column:
    """Without blanks, tabs and line ends at either side; null if nothing is left."""
    x = F.btrim(c.cast("string"), F.lit(BLANKS))
    return F.when(x != "", x)


def norm_hash(c: Column) -> Column:
    """The one form of a block hash or txid: trimmed, without a leading 0x, in lower case."""
    x = F.lower(F.btrim(c.cast("string"), F.lit(BLANKS)))
    x = F.when(F.startswith(x, F.lit("0x")), F.substring(x, 3, 1 << 30)).otherwise(x)
    return F.when(x != "", x)


def norm_address(c: Column) -> Column:
    """The one form of an address: trimmed; bech32-like addresses (vx1 in any case) are lower-cased."""
    x = F.btrim(c.cast("string"), F.lit(BLANKS))
    x = F.when(F.lower(F.substring(x, 1, 3)) == "vx1", F.lower(x)).otherwise(x)
    return F.when(x != "", x)


def norm_word(c: Column) -> Column:
    """Trimmed, in lower case, null if blank: source names, event types."""
    return F.lower(clean(c))


def sats(c: Column) -> Column:
    """Coins to satoshis, rounding halves up; null for null, NaN, infinite and overflowing amounts."""
    return F.when(~F.isnan(c) & (F.abs(c) < 9.0e10), F.floor(c * SATS + F.lit(0.5)).cast("bigint"))


def epoch_day(df: DataFrame, name: str) -> Column:
    """Days since 1970-01-01 (UTC) of a timestamp column, whatever the session's time zone is."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, TimestampNTZType):
        return F.unix_date(F.to_date(c))
    return F.floor(F.unix_seconds(c) / F.lit(86400)).cast("int")


def day_text(c: Column) -> Column:
    """YYYY-MM-DD of a number of days since 1970-01-01."""
    return F.date_from_unix_date(c).cast("string")


def java_hash(c: Column) -> Column:
    """The 32-bit polynomial string hash (h = 31 h + code, wrapping), as a signed bigint."""
    wrap = lambda x: F.pmod(x + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)
    codes = F.filter(F.split(c, ""), lambda x: x != "")
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, x: wrap(h * 31 + F.ascii(x).cast("bigint")))


def bin_of(c: Column, bins: int) -> Column:
    """Storage bin of a key: |hash| modulo bins, free of the overflow at the smallest 32-bit number."""
    return F.pmod(F.abs(java_hash(c)), F.lit(bins)).cast("tinyint")
