"""Models over a lake: bronze normalisation, people, households, plans, facts and histories."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import history, kpis, metrics
from ..sources import tables
from . import landing
from .stages import Model

Frames = Mapping[str, DataFrame]
#: Consumption tax of the older contracts, which state it in no column.
TAX = 0.10
PEOPLE = ("source", "source_member_id", "member_key", "link_key", "key_method", "household_key", "name", "name_kana", "email", "phone", "birth_date", "health_notes", "medical_conditions", "joined_at", "is_deleted", "source_priority")
PRODUCTS = ("A", "B", "C", "D")
PLANS = "plan_ref string, source string, generation string, source_plan_code string, plan_key string, plan_name string, billing_period_months int"
AUDIT = "event_id string, occurred_at timestamp, recorded_at timestamp, principal string, role string, sql_hash string, sql_normalized string, referenced_tables array<string>, referenced_columns array<string>, sensitive_columns array<string>, touched_sensitive boolean"
AUDITED = {"query_executed": f"{AUDIT}, row_count long", "query_denied": f"{AUDIT}, deny_reason string"}


def bronze(spark: SparkSession, lake: str) -> dict[str, DataFrame]:
    """Types, UTC and names only, and one row for each event; nothing else is dropped."""
    out = {}
    for name in ("member_registered", "app_opened", "workout_completed", "purchase_made"):
        own = tables.events(spark, f"{lake}/A/{name}").withColumn("file", F.col("landed_from"))
        out[f"a_{name}"] = history.deduplicated(own).drop("file", "landed_from")
    for name in ("customers", "bookings"):
        own = tables.snapshots(spark, f"{lake}/B/{name}").withColumn("snapshot_date", F.to_date("snapshot_date"))
        out[f"b_{name}"] = own.withColumns({c: scalars.utc_from_tokyo(c) for c, t in own.dtypes if t == "timestamp_ntz"})
    for name in ("members", "contracts_fy2025", "contracts_fy2026", "visits"):
        out[f"c_{name}"] = tables.snapshots(spark, f"{lake}/C/{name}").drop("snapshot_date")
    out["d_invoices"] = d_invoices(tables.snapshots(spark, f"{lake}/D/invoices"))
    out["d_refunds"] = d_refunds(tables.snapshots(spark, f"{lake}/D/refunds"))
    out["e_accounts"] = e_accounts(spark.read.option("basePath", f"{lake}/E/accounts").parquet(f"{lake}/E/accounts"))
    out["reported_kpis"] = spark.read.parquet(f"{lake}/reported_kpis").select("product", "reported_as", "period_month", "value", "definition")
    for name in landing.META:
        out[name] = landing.meta(spark, lake, name)
    for name, schema in AUDITED.items():
        out[name] = history.deduplicated(tables.optional_table(spark, f"{lake}/audit/{name}", schema).withColumn("file", F.col("event_id"))).drop("file")
    return out


def d_invoices(rows: DataFrame) -> DataFrame:
    names = {"請求番号": "invoice_no", "氏名": "name", "氏名カナ": "name_kana", "電話番号": "phone", "プランコード": "plan_code", "入金状況": "payment_status"}
    own = [F.col(f"`{c}`").alias(n) for c, n in names.items()]
    dates = [scalars.date_from_slashes(F.col("`請求日`")).alias("invoice_date"), scalars.date_from_slashes(F.col("`生年月日`")).alias("birth_date")]
    amounts = [scalars.whole_number(F.col("`請求金額（税抜）`")).alias("amount_ex_tax"), scalars.percent(F.col("`消費税率`")).alias("tax_rate")]
    return rows.select(*own, *dates, *amounts, "member_key", "link_key", "key_method", "household_key", F.to_date("snapshot_date").alias("file_date"), "ingested_at")


def d_refunds(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("`返金番号`").alias("refund_no"), F.col("`元請求番号`").alias("invoice_no"), scalars.date_from_slashes(F.col("`返金日`")).alias("refund_date"), scalars.whole_number(F.col("`返金額（税抜）`")).alias("refund_amount_ex_tax"), F.to_date("snapshot_date").alias("file_date"), "ingested_at")


def e_accounts(rows: DataFrame) -> DataFrame:
    return rows.select("company_name", "account_key", "contact_name", scalars.whole_number("seats").alias("seats"), scalars.whole_number("monthly_fee_yen").alias("monthly_fee_yen"), "contract_status", "sales_owner", F.to_date(F.concat(F.col("month").cast("string").substr(1, 7), F.lit("-01"))).alias("report_month"), "ingested_at")


def c_member_current(log: DataFrame) -> DataFrame:
    """The last state of every member; an erased one stays, marked."""
    last = history.latest_per_key(log, ["member_id"], "changed_at", "lsn")
    return last.withColumn("is_deleted", F.col("op") == "D").withColumnRenamed("changed_at", "last_changed_at").drop("op", "lsn", "ingested_at", "landed_from")


def source_rows(b: Frames, current: DataFrame) -> DataFrame:
    """A row for each member record of each product in its current state, with the keys of landing."""

    def shaped(df: DataFrame, source: str, priority: int, **own: Column) -> DataFrame:
        have = own | {"source": F.lit(source), "source_priority": F.lit(priority)}
        kinds = {"birth_date": "date"}
        return df.select(*[(have[c] if c in have else F.col(c) if c in df.columns else F.lit(None).cast(kinds.get(c, "string"))).alias(c) for c in PEOPLE])

    a = shaped(b["a_member_registered"], "A", 1, source_member_id=F.col("member_id"), joined_at=F.col("occurred_at"), is_deleted=F.lit(False))
    c = shaped(current, "C", 2, source_member_id=F.col("member_id").cast("string"), joined_at=scalars.utc_from_tokyo("joined_on"))
    latest = history.latest_per_key(b["b_customers"], ["tenant_id", "member_no"], "snapshot_date")
    bs = shaped(latest, "B", 3, source_member_id=F.concat("tenant_id", F.lit("/"), F.col("member_no").cast("string")), joined_at=F.col("created_at"))
    # D has no ids: its people are who their keys say they are, from their first invoice on.
    first = b["d_invoices"].groupBy("member_key").agg(F.min("invoice_date").alias("first_invoice"))
    last = history.latest_per_key(b["d_invoices"], ["member_key"], "invoice_date", "invoice_no").join(first, "member_key")
    d = shaped(last, "D", 4, source_member_id=F.col("member_key"), joined_at=scalars.utc_from_tokyo("first_invoice"), is_deleted=F.lit(False))
    return a.unionByName(c).unionByName(bs).unionByName(d)


def link_map(live: DataFrame) -> DataFrame:
    """For each link the smallest key that an e-mail gave, and how many such keys there are."""
    own = F.when(F.col("key_method") == "email", F.col("member_key"))
    return live.filter("link_key is not null").groupBy("link_key").agg(F.min(own).alias("email_member_key"), F.countDistinct(own).alias("n_email_keys"))


def xref_member(live: DataFrame, links: DataFrame) -> DataFrame:
    """The one key of each source's record: an e-mail key of its link, if there is one, or its own."""
    key = F.coalesce("email_member_key", "member_key")
    return live.join(links, "link_key", "left").select("source", "source_member_id", F.col("member_key").alias("source_member_key"), key.alias("member_key"), (F.coalesce("n_email_keys", F.lit(0)) > 1).alias("link_ambiguous"))


def _canonical(live: DataFrame, xref: DataFrame) -> DataFrame:
    return live.drop("member_key").join(xref.select("source", "source_member_id", "member_key"), ["source", "source_member_id"])


def dim_member(live: DataFrame, xref: DataFrame) -> DataFrame:
    """One row a person: attributes of the product of the highest priority, then of the earliest start; flags of all.

    One aggregation with partial sums on both sides of the shuffle; ties end at the smallest source id.
    """
    rows = _canonical(live, xref)
    attributes = ("household_key", "key_method", "name", "name_kana", "email", "phone", "birth_date")
    order = F.struct("source_priority", F.col("joined_at").isNull(), "joined_at", "source_member_id")
    flags = [F.bool_or(F.col("source") == p).alias(f"in_{p.lower()}") for p in PRODUCTS]
    found = rows.groupBy("member_key").agg(F.min_by(F.struct(*attributes), order).alias("best"), F.max("health_notes").alias("health_notes"), F.max("medical_conditions").alias("medical_conditions"), F.min("joined_at").alias("first_seen_at"), *flags)
    n = sum((F.col(f"in_{p.lower()}").cast("int") for p in PRODUCTS[1:]), F.col("in_a").cast("int"))
    return found.select("member_key", *[f"best.{a}" for a in attributes], "health_notes", "medical_conditions", "first_seen_at", *[f"in_{p.lower()}" for p in PRODUCTS], n.alias("n_products"))


def dim_member_by_product(live: DataFrame, xref: DataFrame) -> DataFrame:
    """What each product itself knows of its live members."""
    own = ("source_member_id", "household_key", "key_method", "name", "name_kana", "email", "phone", "birth_date", "health_notes", "medical_conditions", "joined_at")
    return _canonical(live, xref).select(F.col("source").alias("product"), "member_key", *own)


def dim_household(members: DataFrame) -> DataFrame:
    flags = [F.bool_or(f"in_{p.lower()}").alias(f"in_{p.lower()}") for p in PRODUCTS]
    return members.groupBy("household_key").agg(F.count("*").alias("n_members"), (F.count("*") > 1).alias("is_family"), *flags, F.min("first_seen_at").alias("first_seen_at"))


def dim_household_by_product(members: DataFrame) -> DataFrame:
    n = F.countDistinct("member_key")
    return members.groupBy("product", "household_key").agg(n.alias("n_members"), (n > 1).alias("is_family"), F.min("joined_at").alias("first_seen_at"))


def dim_member_product(members: DataFrame) -> DataFrame:
    """A row for each member and product it is a customer of."""
    held = F.array_compact(F.array(*[F.when(F.col(f"in_{p.lower()}"), F.lit(p)) for p in PRODUCTS]))
    return members.select("member_key", F.explode(held).alias("product"))


def dim_account(accounts: DataFrame) -> DataFrame:
    """The last month of each account; active if that is the last month of all and it is not cancelled."""
    last = history.latest_per_key(accounts, ["account_key"], "report_month")
    span = accounts.groupBy("account_key").agg(F.min("report_month").alias("first_month"), F.max("report_month").alias("last_month"))
    newest = span.agg(F.max("last_month").alias("newest"))
    status = F.when(F.col("contract_status") == "契約中", "active").when(F.col("contract_status") == "解約", "cancelled").otherwise("unknown")
    rows = last.join(span, "account_key").crossJoin(F.broadcast(newest))  # one row
    live = (F.col("last_month") == F.col("newest")) & (F.col("contract_status") != "解約")
    return rows.select("account_key", "company_name", "contact_name", "sales_owner", "seats", "monthly_fee_yen", "first_month", "last_month", status.alias("status"), live.alias("is_active"))


def c_contract_log(fy2025: DataFrame, fy2026: DataFrame) -> DataFrame:
    """Both generations in one shape; the side of the tax that one does not state is derived."""
    common = ("op", "changed_at", "lsn", "contract_id", "member_id")
    old = fy2025.select(F.lit("FY2025").alias("generation"), *common, F.concat(F.lit("C25:"), "plan_cd").alias("plan_ref"), F.col("monthly_fee").alias("monthly_fee_tax_incl"), scalars.without_tax("monthly_fee", TAX).alias("monthly_fee_ex_tax"), F.col("start_dt").alias("start_date"), F.col("end_dt").alias("end_date"), F.col("family_group_id").alias("payer_member_id"), "status")
    new = fy2026.select(F.lit("FY2026").alias("generation"), *common, F.concat(F.lit("C26:"), "plan_id").alias("plan_ref"), scalars.with_tax("price_ex_tax", F.col("tax_rate")).alias("monthly_fee_tax_incl"), F.col("price_ex_tax").alias("monthly_fee_ex_tax"), F.col("effective_from").alias("start_date"), F.col("effective_to").alias("end_date"), "payer_member_id", "status")
    return old.unionByName(new)


def scd_contract(log: DataFrame, plans: DataFrame, xref: DataFrame) -> DataFrame:
    """Contract versions of live members."""
    tracked = ["member_id", "plan_ref", "monthly_fee_tax_incl", "monthly_fee_ex_tax", "start_date", "end_date", "payer_member_id", "status"]
    versions = history.scd2(log, ["contract_id"], tracked, ["changed_at", "lsn"], "changed_at", "op", carry=["generation"])
    members = xref.filter("source = 'C'").select(F.col("source_member_id").alias("own_id"), "member_key")
    joined = versions.join(F.broadcast(plans.select("plan_ref", "plan_key")), "plan_ref", "left").join(members, F.col("member_id").cast("string") == F.col("own_id"))
    return joined.select("contract_id", "generation", "member_id", "member_key", "plan_ref", "plan_key", "monthly_fee_tax_incl", "monthly_fee_ex_tax", "start_date", "end_date", "payer_member_id", "status", "valid_from", "valid_to", "is_current", "is_deleted")


def c_contract_current(versions: DataFrame) -> DataFrame:
    return versions.filter("is_current and not is_deleted").drop("valid_to", "is_current", "is_deleted")


def _of(xref: DataFrame, source: str) -> DataFrame:
    """The keys of one product's live members; joining them drops what deleted members left."""
    return xref.filter(F.col("source") == source).select(F.col("source_member_id").alias("own_id"), "member_key")


def visit_states(visits: DataFrame) -> DataFrame:
    """The last state of every visit that is not deleted."""
    return history.latest_per_key(visits, ["visit_id"], "changed_at", "lsn").filter("op <> 'D'")


def booking_states(bookings: DataFrame) -> DataFrame:
    return history.latest_per_key(bookings, ["tenant_id", "booking_no"], "snapshot_date")


def fct_session(workouts: DataFrame, visits: DataFrame, xref: DataFrame) -> DataFrame:
    return sessions_of(workouts, visit_states(visits), xref)


def sessions_of(workouts: DataFrame, visits: DataFrame, xref: DataFrame) -> DataFrame:
    """Sessions from workouts and the last states of visits."""
    a = workouts.join(_of(xref, "A"), F.col("member_id") == F.col("own_id"))
    a = a.select(F.col("event_id").alias("session_id"), F.lit("A").alias("source"), F.lit("workout").alias("session_type"), "member_key", F.col("occurred_at").alias("started_at"), "duration_min", F.lit(None).cast("string").alias("facility_id"))
    c = visits.join(_of(xref, "C"), F.col("member_id").cast("string") == F.col("own_id"))
    c = c.select(F.concat(F.lit("C-"), F.col("visit_id").cast("string")).alias("session_id"), F.lit("C").alias("source"), F.lit("visit").alias("session_type"), "member_key", F.col("checked_in_at").alias("started_at"), F.lit(None).cast("long").alias("duration_min"), "facility_id")
    return a.unionByName(c).withColumn("session_date_jst", scalars.tokyo_date("started_at"))


def fct_booking(bookings: DataFrame, xref: DataFrame) -> DataFrame:
    return bookings_of(booking_states(bookings), xref)


def bookings_of(last: DataFrame, xref: DataFrame) -> DataFrame:
    """Bookings from their last states."""
    member = F.concat("tenant_id", F.lit("/"), F.col("member_no").cast("string"))
    rows = last.join(_of(xref, "B"), member == F.col("own_id"))
    return rows.select(F.concat("tenant_id", F.lit("/"), F.col("booking_no").cast("string")).alias("booking_id"), "tenant_id", "member_key", F.col("created_at").alias("booked_at"), "class_start_at", scalars.tokyo_date("class_start_at").alias("class_date_jst"), "status", "price_ex_tax", scalars.with_tax("price_ex_tax", F.col("tax_rate")).alias("price_tax_incl"), "tax_rate", "is_deleted", F.col("snapshot_date").alias("as_of_snapshot"))


def fct_payment(purchases: DataFrame, invoices: DataFrame, refunds: DataFrame, xref: DataFrame) -> DataFrame:
    """Money from purchases, invoices and refunds (negative), with and without tax; the amount as stated is kept."""

    def shaped(df, payment_id, source, kind, plan, at, ex, incl, original, basis, sign=1):
        amounts = [(sign * ex).alias("amount_ex_tax"), (sign * incl).alias("amount_tax_incl"), (sign * original).alias("amount_original")]
        return df.select(F.col(payment_id).alias("payment_id"), F.lit(source).alias("source"), F.lit(kind).alias("payment_type"), "member_key", plan.alias("plan_ref"), at.alias("occurred_at"), *amounts, F.lit(basis).alias("amount_original_basis"), "tax_rate")

    plan = F.concat(F.lit("D:"), F.col("plan_code"))
    a = purchases.join(_of(xref, "A"), F.col("member_id") == F.col("own_id"))
    out = shaped(a, "event_id", "A", "charge", F.lit(None).cast("string"), F.col("occurred_at"), scalars.without_tax("amount_tax_incl", F.col("tax_rate")), F.col("amount_tax_incl"), F.col("amount_tax_incl"), "tax_incl")
    charged = invoices.select("invoice_no", "plan_code", "tax_rate", F.col("member_key").alias("invoiced"), "invoice_date", "amount_ex_tax")
    ex = F.col("amount_ex_tax")
    d = charged.join(_of(xref, "D"), F.col("invoiced") == F.col("own_id"))
    out = out.unionByName(shaped(d, "invoice_no", "D", "charge", plan, scalars.utc_from_tokyo("invoice_date"), ex, scalars.with_tax(ex, F.col("tax_rate")), ex, "ex_tax"))
    # A refund without its invoice has no member and goes.
    back = refunds.select("refund_no", "invoice_no", "refund_date", F.col("refund_amount_ex_tax").alias("back")).join(charged, "invoice_no").join(_of(xref, "D"), F.col("invoiced") == F.col("own_id"))
    return out.unionByName(shaped(back, "refund_no", "D", "refund", plan, scalars.utc_from_tokyo("refund_date"), F.col("back"), scalars.with_tax("back", F.col("tax_rate")), F.col("back"), "ex_tax", -1))


def fct_activity(sessions: DataFrame, bookings: DataFrame) -> DataFrame:
    s = sessions.select(F.col("session_id").alias("activity_id"), "member_key", F.col("started_at").alias("occurred_at"), F.col("session_date_jst").alias("activity_date_jst"), F.col("session_type").alias("activity_type"), "source")
    held = bookings.filter("status = 'attended' and not is_deleted")
    return s.unionByName(held.select(F.col("booking_id").alias("activity_id"), "member_key", F.col("class_start_at").alias("occurred_at"), F.col("class_date_jst").alias("activity_date_jst"), F.lit("booking_attended").alias("activity_type"), F.lit("B").alias("source")))


def identity_quality(rows: DataFrame, live: DataFrame, links: DataFrame) -> DataFrame:
    """How people were identified, by source; what was deleted there; and links that hold several e-mail keys."""
    n = F.countDistinct("source_member_id").alias("n")
    methods = live.groupBy("source", F.col("key_method").alias("category")).agg(n)
    deleted = rows.filter("is_deleted").groupBy("source").agg(n).select("source", F.lit("deleted_in_source").alias("category"), "n")
    ambiguous = links.filter("n_email_keys > 1").agg(F.count("*").alias("n")).select(F.lit("ALL").alias("source"), F.lit("ambiguous_link").alias("category"), "n")
    return methods.unionByName(deleted).unionByName(ambiguous)


def ingest_quality_daily(landed: DataFrame, quarantined: DataFrame) -> DataFrame:
    """What each delivery brought and what was quarantined; a delivery that was quarantined whole shows with zeros."""
    keys = ["source", "dataset", "partition_date"]
    good = landed.groupBy(*keys).agg(F.sum("files_landed").alias("files_landed"), F.sum("rows_landed").alias("rows_landed"))
    bad = quarantined.groupBy(*keys).agg(F.count("*").alias("files_quarantined"), F.sum("n_violations").alias("violations"))
    return good.join(bad, keys, "full_outer").na.fill(0, ["files_landed", "rows_landed", "files_quarantined", "violations"])


def audit_access_log(executed: DataFrame, denied: DataFrame) -> DataFrame:
    lists = ("referenced_tables", "referenced_columns", "sensitive_columns")

    def shaped(df, outcome, rows, reason):
        return df.select("event_id", "occurred_at", F.lit(outcome).alias("outcome"), "principal", "role", "sql_hash", "sql_normalized", *[scalars.list_to_text(c).alias(c) for c in lists], "touched_sensitive", rows.alias("row_count"), reason.alias("deny_reason"))

    return shaped(executed, "executed", F.col("row_count"), F.lit(None).cast("string")).unionByName(shaped(denied, "denied", F.lit(None).cast("long"), F.col("deny_reason")))


#: Every silver and gold table but the metrics: what it is made of, and how. The st_ tables hold states that several others need.
GRAPH = {
    "st_bookings": Model(("b_bookings",), lambda t: booking_states(t["b_bookings"]), passing=True),
    "st_visits": Model(("c_visits",), lambda t: visit_states(t["c_visits"]), passing=True),
    "st_contract_log": Model(("c_contracts_fy2025", "c_contracts_fy2026"), lambda t: c_contract_log(t["c_contracts_fy2025"], t["c_contracts_fy2026"]), passing=True),
    "dim_plan": Model(("plan_seed",), lambda t: t["plan_seed"]),
    "dim_month": Model(("period",), lambda t: metrics.month_spine(t["period"], "period_start", "period_end")),
    "dim_account": Model(("e_accounts",), lambda t: dim_account(t["e_accounts"])),
    "c_member_current": Model(("c_members",), lambda t: c_member_current(t["c_members"])),
    "int_member_source_rows": Model(("a_member_registered", "c_member_current", "b_customers", "d_invoices"), lambda t: source_rows(t, t["c_member_current"])),
    "int_member_live_rows": Model(("int_member_source_rows",), lambda t: t["int_member_source_rows"].filter("not is_deleted")),
    "int_link_map": Model(("int_member_live_rows",), lambda t: link_map(t["int_member_live_rows"])),
    "xref_member": Model(("int_member_live_rows", "int_link_map"), lambda t: xref_member(t["int_member_live_rows"], t["int_link_map"])),
    "dim_member": Model(("int_member_live_rows", "xref_member"), lambda t: dim_member(t["int_member_live_rows"], t["xref_member"])),
    "dim_member_by_product": Model(("int_member_live_rows", "xref_member"), lambda t: dim_member_by_product(t["int_member_live_rows"], t["xref_member"])),
    "dim_household": Model(("dim_member",), lambda t: dim_household(t["dim_member"])),
    "dim_household_by_product": Model(("dim_member_by_product",), lambda t: dim_household_by_product(t["dim_member_by_product"])),
    "dim_member_product": Model(("dim_member",), lambda t: dim_member_product(t["dim_member"])),
    "scd_contract": Model(("st_contract_log", "dim_plan", "xref_member"), lambda t: scd_contract(t["st_contract_log"], t["dim_plan"], t["xref_member"])),
    "c_contract_current": Model(("scd_contract",), lambda t: c_contract_current(t["scd_contract"])),
    "fct_session": Model(("a_workout_completed", "st_visits", "xref_member"), lambda t: sessions_of(t["a_workout_completed"], t["st_visits"], t["xref_member"])),
    "fct_booking": Model(("st_bookings", "xref_member"), lambda t: bookings_of(t["st_bookings"], t["xref_member"])),
    "fct_payment": Model(("a_purchase_made", "d_invoices", "d_refunds", "xref_member"), lambda t: fct_payment(t["a_purchase_made"], t["d_invoices"], t["d_refunds"], t["xref_member"])),
    "fct_activity": Model(("fct_session", "fct_booking"), lambda t: fct_activity(t["fct_session"], t["fct_booking"])),
    "identity_quality": Model(("int_member_source_rows", "int_member_live_rows", "int_link_map"), lambda t: identity_quality(t["int_member_source_rows"], t["int_member_live_rows"], t["int_link_map"])),
    "ingest_quality_daily": Model(("landing_log", "quarantine_log"), lambda t: ingest_quality_daily(t["landing_log"], t["quarantine_log"])),
    "audit_access_log": Model(("query_executed", "query_denied"), lambda t: audit_access_log(t["query_executed"], t["query_denied"])),
}


def reported(b: Frames, spine: DataFrame) -> DataFrame:
    """The sixteen measures by month as the five products count them themselves, from bronze; states that are there are taken."""
    opened = b["a_app_opened"].withColumn("day", F.to_date("occurred_at"))
    workouts, bought = b["a_workout_completed"].withColumn("day", F.to_date("occurred_at")), b["a_purchase_made"].withColumn("day", F.to_date("occurred_at"))
    bookings = b["st_bookings"] if "st_bookings" in b else booking_states(b["b_bookings"])
    bookings = bookings.withColumns({"who": F.concat_ws("/", "tenant_id", "member_no"), "made": scalars.tokyo_date("created_at"), "held": scalars.tokyo_date("class_start_at")})
    log = b["st_contract_log"] if "st_contract_log" in b else c_contract_log(b["c_contracts_fy2025"], b["c_contracts_fy2026"])
    contracts = history.latest_per_key(log, ["contract_id"], "changed_at", "lsn").filter("op <> 'D'")
    visits = (b["st_visits"] if "st_visits" in b else visit_states(b["c_visits"])).withColumn("day", scalars.tokyo_date("checked_in_at"))
    invoices, refunds = b["d_invoices"], b["d_refunds"]
    accounts = b["e_accounts"].filter("contract_status <> '解約'")
    b_active = kpis.windowed_distinct(bookings, "who", "made", spine, 28)
    c_active = kpis.alive_distinct(contracts, "member_id", "start_date", "end_date", spine)
    openers = kpis.windowed_distinct(opened, "member_id", "day", spine, 28)
    return kpis.reported(
        {
            ("A", "active_users", "opened the app in 30 days, UTC"): kpis.windowed_distinct(opened, "member_id", "day", spine, 30),
            ("A", "iap_revenue", "purchases with tax, UTC month"): kpis.month_total(bought, "amount_tax_incl", "day", spine),
            ("A", "workouts_per_user", "workouts in the month for each opener in 28 days"): kpis.ratio(kpis.month_rows(workouts, "day", spine), openers),
            ("B", "active_customers", "made a booking in 28 days"): b_active,
            ("B", "booking_revenue", "price without tax of classes in the month, not cancelled"): kpis.month_total(bookings.filter("status <> 'cancelled'"), "price_ex_tax", "held", spine),
            ("B", "bookings_per_customer", "bookings made for each active customer"): kpis.ratio(kpis.month_rows(bookings, "made", spine), b_active),
            ("B", "lost_customers", "customers without a booking in 60 days"): kpis.ever_less_recent(bookings, "who", "made", spine, 60),
            ("C", "active_members", "a contract alive on the last day"): c_active,
            ("C", "monthly_revenue", "fees with tax of the contracts alive on the last day"): kpis.alive_total(contracts, "monthly_fee_tax_incl", "start_date", "end_date", spine),
            ("C", "churned_members", "contracts that end in the month"): kpis.month_rows(contracts.filter("end_date is not null"), "end_date", spine),
            ("C", "avg_visits_per_member", "visits in the month for each active member"): kpis.ratio(kpis.month_rows(visits, "day", spine), c_active),
            ("D", "billed_customers", "invoiced in the month"): kpis.month_distinct(invoices, "member_key", "invoice_date", spine),
            ("D", "net_sales", "invoices less refunds, without tax"): kpis.difference(kpis.month_total(invoices, "amount_ex_tax", "invoice_date", spine), kpis.month_total(refunds, "refund_amount_ex_tax", "refund_date", spine)),
            ("D", "cancelled_customers", "invoiced once, not in 60 days"): kpis.ever_less_recent(invoices, "member_key", "invoice_date", spine, 60),
            ("E", "seats_under_contract", "seats of accounts under contract"): kpis.month_total(accounts, F.coalesce("seats", F.lit(0)), "report_month", spine),
            ("E", "mrr", "fees of accounts under contract"): kpis.month_total(accounts, F.coalesce("monthly_fee_yen", F.lit(0)), "report_month", spine),
        }
    )
