"""The landed datasets: where their files lie, what their contracts say, and which columns identify people."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.contracts import Check, Contract, at_least, between, contains, matches, one_of

#: Header aliases of the account sheet (fixed values).
ACCOUNT_HEADERS = {
    "会社名": "company_name",
    "企業名": "company_name",
    "担当者": "contact_name",
    "担当者名": "contact_name",
    "契約人数": "seats",
    "利用人数": "seats",
    "月額料金": "monthly_fee_yen",
    "月額(円)": "monthly_fee_yen",
    "ステータス": "contract_status",
    "契約状況": "contract_status",
    "営業担当": "sales_owner",
    "営業担当者": "sales_owner",
}
#: Columns that landing adds; a file may bring them.
LANDED = "member_key string?, link_key string?, key_method string?, household_key string?"
_EVENT = "event_id string, occurred_at timestamp, recorded_at timestamp, member_id string"
_CHANGE = "op string, changed_at timestamp, lsn bigint"
_DAY = r"\d{4}/\d{2}/\d{2}$"


@dataclass(frozen=True)
class Dataset:
    """Files below a folder, `kind` parquet or the encoding of delimited text, and the rules of one file."""

    source: str
    name: str
    pattern: str
    kind: str
    fields: str
    checks: Callable[[], list[Check]] = list
    unique: tuple[tuple[str, ...], ...] = ()
    strict: bool = True
    aliases: dict[str, str] = field(default_factory=dict)
    #: The source's id of a person, and the columns email, phone, kana, guardian; None if rows are no people.
    person: Callable[[], Column] | None = None
    contact: tuple[str | None, str | None, str | None, str | None] = (None, None, None, None)
    by_phone: bool = True
    #: People without an id of their own are counted by their key.
    by_key: bool = False

    def contract(self) -> Contract:
        columns, types, nullable = [], {}, []
        for entry in self.fields.split(", "):
            name, kind = entry.rsplit(" ", 1)
            columns.append(name)
            types[name] = kind.removesuffix("?")
            if kind.endswith("?"):
                nullable.append(name)
        return Contract(columns, nullable, self.checks(), self.unique, types, self.strict)


def _parquet(source, name, fields, **more) -> Dataset:
    return Dataset(source, name, f"{source}/{name}/dt=*/*.parquet", "parquet", fields, **more)


def _digits(column: str) -> Check:
    return matches(column, r"\d+$")


DATASETS = (
    _parquet("A", "member_registered", f"{_EVENT}, email string?, name string, name_kana string?, phone string?, birth_date date, guardian_member_id string?, guardian_email string?, health_notes string?", checks=lambda: [contains("email", "@")], strict=False, person=lambda: F.col("member_id"), contact=("email", "phone", "name_kana", "guardian_email")),
    _parquet("A", "app_opened", _EVENT, strict=False),
    _parquet("A", "workout_completed", f"{_EVENT}, workout_type string, duration_min bigint", checks=lambda: [at_least("duration_min", 1)], strict=False),
    _parquet("A", "purchase_made", f"{_EVENT}, sku string, amount_tax_incl bigint, tax_rate double", checks=lambda: [at_least("amount_tax_incl", 0), between("tax_rate", 0, 1)], strict=False),
    _parquet("B", "customers", "tenant_id string, member_no bigint, name string, name_kana string?, email string?, phone string?, created_at timestamp_ntz, is_deleted boolean, deleted_at timestamp_ntz?", checks=lambda: [matches("tenant_id", r"T\d{3}$"), at_least("member_no", 1), contains("email", "@")], unique=(("tenant_id", "member_no"),), person=lambda: F.concat_ws("/", "tenant_id", F.col("member_no").cast("string")), contact=("email", "phone", "name_kana", None)),
    _parquet("B", "bookings", "tenant_id string, booking_no bigint, member_no bigint, class_start_at timestamp_ntz, created_at timestamp_ntz, status string, price_ex_tax bigint, tax_rate double, is_deleted boolean", checks=lambda: [matches("tenant_id", r"T\d{3}$"), at_least("booking_no", 1), at_least("member_no", 1), one_of("status", ["booked", "attended", "cancelled", "no_show"]), at_least("price_ex_tax", 0), between("tax_rate", 0, 1)], unique=(("tenant_id", "booking_no"),)),
    _parquet("C", "members", f"{_CHANGE}, member_id bigint, name string, name_kana string?, email string?, phone string?, birth_date date, guardian_email string?, medical_conditions string?, facility_id string, status string, joined_on date", checks=lambda: [*_change_checks(), at_least("member_id", 1), contains("email", "@")], person=lambda: F.col("member_id").cast("string"), contact=("email", "phone", "name_kana", "guardian_email")),
    _parquet("C", "contracts_fy2025", f"{_CHANGE}, contract_id bigint, member_id bigint, plan_cd string, monthly_fee bigint, start_dt date, end_dt date?, family_group_id bigint?, status string", checks=lambda: [*_change_checks(), at_least("monthly_fee", 0)]),
    _parquet("C", "contracts_fy2026", f"{_CHANGE}, contract_id bigint, member_id bigint, plan_id string, price_ex_tax bigint, tax_rate double, effective_from date, effective_to date?, payer_member_id bigint?, billing_cycle string, status string", checks=lambda: [*_change_checks(), at_least("price_ex_tax", 0), between("tax_rate", 0, 1)]),
    _parquet("C", "visits", f"{_CHANGE}, visit_id bigint, member_id bigint, checked_in_at timestamp, facility_id string", checks=lambda: [*_change_checks(), at_least("visit_id", 0), at_least("member_id", 0)]),
    Dataset("D", "invoices", "D/invoices/dt=*/*.csv", "cp932", "請求番号 string, 請求日 string, 氏名 string, 氏名カナ string, 電話番号 string, 生年月日 string, プランコード string, 請求金額（税抜） string, 消費税率 string, 入金状況 string", checks=lambda: [matches("請求番号", r"INV\d{7}$"), matches("請求日", _DAY), matches("生年月日", _DAY), _digits("請求金額（税抜）"), matches("消費税率", r"\d+%$")], person=lambda: F.col("請求番号"), contact=(None, "電話番号", "氏名カナ", None), by_phone=False, by_key=True),
    Dataset("D", "refunds", "D/refunds/dt=*/*.csv", "cp932", "返金番号 string, 元請求番号 string, 返金日 string, 返金額（税抜） string", checks=lambda: [matches("返金番号", r"RF\d{6}$"), matches("元請求番号", r"INV\d{7}$"), matches("返金日", _DAY), _digits("返金額（税抜）")]),
    Dataset("E", "accounts", "E/accounts/month=*/*.csv", "utf-8-sig", "company_name string, contact_name string?, seats string?, monthly_fee_yen string?, contract_status string, sales_owner string?", aliases=ACCOUNT_HEADERS),
    Dataset("KPI", "reported_kpis", "reported_kpis/*/kpis.parquet", "parquet", "product string, reported_as string, period_month date, value double, definition string", checks=lambda: [one_of("product", list("ABCDE"))]),
)


def _change_checks() -> list[Check]:
    return [one_of("op", ["I", "U", "D"]), at_least("lsn", 1)]


def dataset(source: str, name: str) -> Dataset:
    return next(d for d in DATASETS if (d.source, d.name) == (source, name))
