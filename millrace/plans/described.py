"""Classes, masks and descriptions of the columns of every silver and gold table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from .access import Described

_PERSON = {"name": "initial", "name_kana": "initial", "email": "email_domain", "phone": "phone_last4", "birth_date": "birth_year"}
_ACCOUNT = {"contact_name": "initial", "sales_owner": "initial"}
_GUARDIAN = {"guardian_email": "email_domain"}
#: Direct columns with their masks, by table (fixed values, as those below).
DIRECT = {"dim_member": _PERSON, "dim_member_by_product": _PERSON, "int_member_source_rows": _PERSON, "int_member_live_rows": _PERSON, "c_member_current": _PERSON | _GUARDIAN, "dim_account": _ACCOUNT}
SENSITIVE = ("health_notes", "medical_conditions")
KEYS = ("member_key", "household_key")
#: Tables whose person keys are keys to be pseudonymised.
KEYED = ("dim_member", "dim_member_by_product", "int_member_source_rows", "int_member_live_rows", "c_member_current", "dim_household", "dim_household_by_product", "c_contract_current", "scd_contract", "xref_member", "fct_session", "fct_booking", "fct_payment", "fct_activity", "dim_member_product")
QUASI = {
    "dim_member": ("first_seen_at",),
    "dim_member_by_product": ("joined_at", "source_member_id"),
    "int_member_source_rows": ("source_member_id", "link_key", "joined_at"),
    "int_member_live_rows": ("source_member_id", "link_key", "joined_at"),
    "c_member_current": ("member_id", "link_key"),
    "dim_household": ("first_seen_at",),
    "dim_household_by_product": ("first_seen_at",),
    "c_contract_current": ("member_id", "payer_member_id"),
    "scd_contract": ("member_id", "payer_member_id"),
    "xref_member": ("source_member_id", "source_member_key"),
    "int_link_map": ("link_key", "email_member_key"),
    "audit_access_log": ("principal",),
}
#: Products that must not see a column: D's own id of a person is a derived key.
OMIT = {("dim_member_by_product", "source_member_id"): ("D",)}
_UNITS = {"_at": "Instant, UTC.", "_date": "Day.", "_jst": "Tokyo day.", "_key": "Key.", "_id": "Id in its source.", "_month": "First day of the month.", "_tax": "Yen without tax.", "_incl": "Yen with tax.", "_rate": "Share.", "_pct": "Percent."}


def description(table: str, column: str) -> str:
    unit = next((u for end, u in _UNITS.items() if column.endswith(end)), "")
    return f"{column.replace('_', ' ').capitalize()} of {table.replace('_', ' ')}. {unit}".strip()


def described(models: Mapping[str, DataFrame]) -> dict[str, list[Described]]:
    out = {}
    for table, df in models.items():
        direct, quasi, own = DIRECT.get(table, {}), QUASI.get(table, ()), []
        for c in df.columns:
            pii = "sensitive" if c in SENSITIVE else "direct" if c in direct else "quasi" if c in quasi else "none"
            own.append(Described(c, pii, direct.get(c), c in KEYS and table in KEYED, OMIT.get((table, c), ()), description(table, c)))
        out[table] = own
    return out
