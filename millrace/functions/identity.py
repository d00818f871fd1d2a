"""Identity keys: normalised contact data, keyed hashes and their order of preference.

Spark SQL has neither NFKC nor HMAC; both run in one Arrow-batched function. The salt comes from the environment, is
held in a closure, and appears in no plan.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import free_name

#: Hiragana from U+3041 to U+3096 lie this far below their katakana.
_TO_KATAKANA = {c: c + 0x60 for c in range(0x3041, 0x3097)}
#: Legal forms dropped from company names (fixed values).
LEGAL_FORMS = ("株式会社", "有限会社", "(株)", "(有)")
#: Identities whose keys a task remembers.
REMEMBERED = 100_000
KEYS = ("member_key", "link_key", "key_method", "household_key")


def email_of(value: str | None) -> str | None:
    """NFKC, trimmed, lower case, without +tag; parted at the first @; None unless both parts are there."""
    local, _, domain = unicodedata.normalize("NFKC", value or "").strip().lower().partition("@")
    local = local.split("+")[0]
    return f"{local}@{domain}" if local and domain else None


def phone_of(value: str | None) -> str | None:
    """Digits of any script, national form of numbers with country code 81; None below nine digits."""
    digits = "".join(c for c in unicodedata.normalize("NFKC", value or "") if c.isdecimal())
    if len(digits) in (11, 12) and digits[:2] == "81":
        digits = f"0{digits[2:]}"
    return digits if len(digits) >= 9 else None


def kana_of(value: str | None) -> str | None:
    """NFKC katakana without spaces; None if nothing is left."""
    return re.sub(r"\s", "", unicodedata.normalize("NFKC", value or "")).translate(_TO_KATAKANA) or None


def company_of(value: str | None) -> str | None:
    """NFKC without legal form and spaces; None if nothing is left."""
    name = unicodedata.normalize("NFKC", value or "")
    for form in LEGAL_FORMS:
        name = name.replace(form, "")
    return re.sub(r"\s", "", name) or None


def _batched(f):
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([f(None if pd.isna(v) else v) for v in values], dtype=object)

    # Made when called: a function of Spark needs a session, an import does not.
    return lambda column: F.pandas_udf(run, "string")(column)


normal_email, normal_phone, normal_kana, normal_company = map(_batched, (email_of, phone_of, kana_of, company_of))


def salt_from(variable: str) -> str:
    """The salt; fails before any work if it is missing, naming only the variable."""
    if not (found := os.environ.get(variable)):
        raise RuntimeError(f"the environment variable {variable} is not set")
    return found


def hmac_hex(salt: str, purpose: str, value: str) -> str:
    return hmac.new(salt.encode(), f"{purpose}:{value}".encode(), hashlib.sha256).hexdigest()


def keyed(salt: str, purpose: str, value: str | Column) -> Column:
    """HMAC-SHA256 of purpose and value in hex; null stays null."""
    return _batched(lambda v: None if v is None else hmac_hex(salt, purpose, v))(value)


def identity_of(salt: str, source: str, own_id: str, email: str | None, phone: str | None, kana: str | None, by_phone: bool = True) -> tuple[str, str | None, str]:
    """member_key, link_key and key_method of one record from its raw contact data."""
    address, number, reading = email_of(email), phone_of(phone), kana_of(kana)
    pair = f"{number}|{reading}" if number and reading else None
    choices = {"email": address, "phone": number if by_phone else None, "phone_kana": pair, "source_local": f"{source}|{own_id}"}
    method = next(m for m, v in choices.items() if v)
    return hmac_hex(salt, method, choices[method]), hmac_hex(salt, "phone_kana", pair) if pair else None, method


def household_of(salt: str, member_key: str, guardian: str | None) -> str:
    """The household of the guardian, if that has a usable e-mail, or else of the member."""
    payer = email_of(guardian)
    return hmac_hex(salt, "household", hmac_hex(salt, "email", payer) if payer else member_key)


def with_keys(df: DataFrame, salt: str, source: str, source_id: str | Column, email: str | None, phone: str | None, kana: str | None, guardian: str | None = None, by_phone: bool = True) -> DataFrame:
    """df with member_key, link_key, key_method and household_key, in one pass of one function.

    The e-mail decides; without one the phone (unless by_phone is off), then phone and kana, then the source's own
    id. A name of None means that the source has no such column. Each task remembers the keys of REMEMBERED contacts.
    Other columns keep their names, whatever they are; the four key columns are replaced.
    """

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, tuple] = {}
        for batch in batches:
            out = []
            for values in zip(*batch, strict=True):
                own, *contact, payer = (None if pd.isna(v) else v for v in values)
                key = tuple(contact) if any(contact) else None
                found = known.get(key) if key else None
                if found is None:
                    found = identity_of(salt, source, own or "", *contact, by_phone)
                    if key and found[2] != "source_local":
                        known[key] = found
                out.append((*found, household_of(salt, found[0], payer)))
            if len(known) > REMEMBERED:
                known.clear()
            yield pd.DataFrame(out, columns=list(KEYS))

    def text(c: str | Column | None) -> Column:
        return F.lit(None).cast("string") if c is None else (F.col(c) if isinstance(c, str) else c).cast("string")

    name = free_name(df, "keys")
    found = df.withColumn(name, F.pandas_udf(run, ", ".join(f"{k} string" for k in KEYS))(*map(text, (source_id, email, phone, kana, guardian))))
    return found.select(*[F.col(f"`{c}`") for c in df.columns if c not in KEYS], *[f"{name}.{k}" for k in KEYS])
