"""Scalar functions as column expressions: Tokyo time, digits, hashes and masks. All stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKYO = "Asia/Tokyo"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utc_from_tokyo(ts: str | Column) -> Column:
    """The instant of a naive Tokyo time, in whatever zone the session is; a date means Tokyo midnight."""
    naive = _col(ts).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(TOKYO), F.current_timezone(), naive).cast("timestamp")


def tokyo_time(ts: str | Column) -> Column:
    """The naive Tokyo time of an instant (a naive time is taken in the session's zone)."""
    return F.convert_timezone(None, F.lit(TOKYO), _col(ts))


def tokyo_date(ts: str | Column) -> Column:
    """The Tokyo calendar date of an instant."""
    return F.to_date(tokyo_time(ts))


def instant(text: str | Column) -> Column:
    """ISO text with its offset as an instant; null if it is none."""
    return F.try_to_timestamp(_col(text))


def date_from_slashes(text: str | Column) -> Column:
    """YYYY/MM/DD as a date; null if there is no such day."""
    return F.try_to_timestamp(_col(text), F.lit("yyyy/MM/dd")).cast("date")


def plain_digits(text: str | Column) -> Column:
    """Full-width digits become ASCII digits; both kinds of comma go."""
    return F.translate(text, "０１２３４５６７８９，,", "0123456789")


def whole_number(text: str | Column) -> Column:
    """Typed digits as a number; placeholders and other text are null, never 0."""
    return plain_digits(_col(text)).try_cast("long")


def percent(text: str | Column) -> Column:
    """'10%' as 0.1; null if there is no number."""
    return F.replace(plain_digits(_col(text)), F.lit("%"), F.lit("")).try_cast("decimal(28,6)").cast("double") / 100


def month_start(at: str | Column) -> Column:
    return F.to_date(F.trunc(at, "MM"))


def month_end(at: str) -> Column:
    return F.last_day(at)


def list_to_text(values: str) -> Column:
    """Values joined by commas; null stays null and an empty list gives an empty text."""
    return F.array_join(values, ",")


def row_hash(*columns: str) -> Column:
    """A hash that tells rows apart, nulls from empty texts included."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])), 256)


def email_domain(email: str) -> Column:
    return F.split_part(F.col(email), F.lit("@"), F.lit(2))


def phone_last4(phone: str) -> Column:
    return F.right(F.regexp_replace(plain_digits(phone), "[^0-9]", ""), F.lit(4))


def birth_year(date: str) -> Column:
    return F.year(date).cast("long")


def initial(text: str) -> Column:
    """The first character and three stars; null stays null."""
    return F.concat(F.left(F.col(text), F.lit(1)), F.lit("***"))


def pseudonym(key: str, product: str) -> Column:
    """A key that differs by product; null stays null."""
    return F.sha2(F.concat(F.lit(f"{product}:"), F.col(key).cast("string")), 256)


def hashed_account(company: str | Column) -> Column:
    """The key of a company name in its normal form."""
    return F.substring(F.sha2(company, 256), 1, 16)


def account_key(company: str | Column) -> Column:
    """The key of a company name as written; null if nothing is left of it."""
    from .identity import normal_company

    return hashed_account(normal_company(_col(company)))


def with_tax(amount: str | Column, rate: float | Column) -> Column:
    return F.round(_col(amount) * (1 + rate)).cast("long")


def without_tax(amount: str | Column, rate: float | Column) -> Column:
    return F.round(_col(amount) / (1 + rate)).cast("long")
