"""The whole way of a small lake: landing, models, metrics, access, gateway, catalog and command line."""

import datetime as dt
import decimal
import io
import json
from pathlib import Path

import pytest

from millrace import cli
from millrace.functions import identity
from millrace.operators import quality
from millrace.plans import access, catalog, gateway, landing, platform, server, silver
from millrace.plans import spec as specs
from millrace.plans.described import described

from . import lake as files


def key(mail):
    return identity.hmac_hex(files.SALT, "email", mail)


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    files.incoming(spark, root / "in")
    report = landing.land(spark, f"{root}/in", f"{root}/lake", files.SALT, files.NOW, period=files.PERIOD)
    return root, report


@pytest.fixture(scope="module")
def models(spark, lake):
    root, _ = lake
    return platform.build(spark, f"{root}/lake", f"{root}/warehouse/tables")


@pytest.fixture(scope="module")
def allowed(models, lake):
    return platform.build_roles(models, f"{lake[0]}/warehouse/roles")


def test_no_table_is_planned_further_back_than_its_inputs(spark, lake, models):
    """Of a stored table only its direct inputs are scanned; all of them are tables of the build or of bronze."""
    graph = platform.graph()
    have = platform.sources(spark, f"{lake[0]}/lake") | models
    states = {n: graph[n].make(have) for n in graph if graph[n].passing}
    for name, model in graph.items():
        of = have | states
        scanned = set(model.make({i: of[i] for i in model.inputs}).inputFiles())
        direct = {f for i in model.inputs for f in of[i].inputFiles()}
        assert scanned <= direct, name
    assert set(models) == {n for n in graph if not graph[n].passing}


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_bad_files_are_quarantined_whole_with_reasons_and_no_values(lake):
    root, report = lake
    found = {(s, d, day): (stage, reason) for _, s, d, _, day, stage, _, reason, _ in report.quarantined}
    assert found == {
        ("A", "member_registered", "2026-02-03"): ("contract", "not_nullable on member_id"),
        ("A", "member_registered", "2026-02-04"): ("read", "ArrowInvalid"),
        ("B", "bookings", "2026-04-30"): ("contract", "column_in_dataframe on is_deleted; column_in_dataframe on price_ex_tax; column_in_dataframe on status"),
        ("C", "members", "2026-02-02"): ("contract", "isin on op"),
        ("D", "invoices", "2026-03-31"): ("contract", "column_in_dataframe on 請求金額（税抜）; column_in_schema on 請求額"),
        ("D", "invoices", "2026-04-30"): ("read", "UnicodeDecodeError"),
        ("D", "refunds", "2026-02-28"): ("read", "EmptyFile"),
        ("E", "accounts", "2026-04"): ("contract", "unknown_column_name on 備考2"),
    }
    reasons = list(Path(root, "lake/quarantine").rglob("*.reason.json"))
    assert len(reasons) == 8 and all("secret" not in p.read_text() and "nine@" not in p.read_text() for p in reasons)
    document = json.loads(next(p for p in reasons if "/C/" in str(p)).read_text())
    assert (document["stage"], document["violations"]) == ("contract", [{"column": "op", "check": "isin", "n_rows": 1}])
    assert not [p for p in Path(root, "in").rglob("*") if p.suffix in (".parquet", ".csv") and p.is_file() and ".dir" not in str(p)]


def test_meta_tables_and_ingest_quality(spark, lake, models):
    root, report = lake
    assert (report.run_id, "B", "email", 1) in report.identities and (report.run_id, "B", "phone", 1) in report.identities
    assert {r[2] for r in report.identities if r[1] == "D"} == {"phone_kana"}
    assert rows(landing.meta(spark, f"{root}/lake", "period"), "period_start", "period_end") == {files.PERIOD}
    daily = {(r.source, r.dataset, str(r.partition_date)): (r.files_landed, r.files_quarantined) for r in models["ingest_quality_daily"].collect()}
    assert daily["A", "member_registered", "2026-02-01"] == (1, 0) and daily["E", "accounts", "2026-04"] == (0, 1)


def test_people_links_and_households(models):
    sky = key("sky@example.com")
    xref = {(r.source, r.source_member_id): r.member_key for r in models["xref_member"].collect()}
    invoiced = [v for (s, _), v in xref.items() if s == "D"]
    assert xref["A", "m1"] == xref["B", "T001/1"] == xref["C", "7"] == sky and sky in invoiced and len(invoiced) == 2
    assert ("B", "T001/2") not in xref and ("C", "8") not in xref
    one = models["dim_member"].filter(f"member_key = '{sky}'").first()
    assert (one["name"], one.n_products, one.in_a, one.in_d, one.medical_conditions, one.health_notes) == ("佐藤翔太", 4, True, True, "knee", "note")
    house = {r.household_key: (r.n_members, r.is_family) for r in models["dim_household"].collect()}
    assert house[one.household_key] == (2, True)
    assert rows(models["dim_member_by_product"].filter("product = 'B'"), "name", "birth_date") == {("Sato S", None)}
    assert rows(models["dim_member_product"].filter(f"member_key = '{sky}'"), "product") == {("A",), ("B",), ("C",), ("D",)}


def test_contract_history(models):
    versions = [(r.valid_from.day, r.is_deleted, r.is_current) for r in models["scd_contract"].filter("contract_id = 1").orderBy("valid_from").collect()]
    assert versions == [(1, False, False), (3, True, False), (4, False, True)]
    assert quality.history_breaks(models["scd_contract"], ["contract_id"]).count() == 0
    assert rows(models["c_contract_current"], "contract_id", "generation", "plan_key", "monthly_fee_ex_tax", "monthly_fee_tax_incl") == {(1, "FY2025", "standard_monthly", 1000, 1100), (3, "FY2025", "standard_monthly", 1000, 1100), (4, "FY2026", None, 2000, 2200)}
    unmapped = quality.without_parent(models["scd_contract"], "plan_ref", models["dim_plan"], "plan_ref")
    assert rows(unmapped, "plan_ref") == {("C26:P999",)}


def test_facts(models):
    assert rows(models["fct_activity"], "activity_id", "activity_type") == {("w1", "workout"), ("w2", "workout"), ("C-1", "visit"), ("T001/1", "booking_attended")}
    paid = {r.payment_id: (r.payment_type, r.amount_ex_tax, r.amount_tax_incl, r.amount_original_basis) for r in models["fct_payment"].collect()}
    assert paid == {"p1": ("charge", 100, 110, "tax_incl"), "INV0000001": ("charge", 1000, 1100, "ex_tax"), "INV0000002": ("charge", 3000, 3300, "ex_tax"), "RF000001": ("refund", -100, -110, "ex_tax")}
    at = models["fct_payment"].filter("payment_id = 'INV0000001'").first().occurred_at
    assert at == dt.datetime(2026, 2, 19, 15)
    accounts = {r.company_name: (r.seats, r.monthly_fee_yen, r.status, r.is_active) for r in models["dim_account"].collect()}
    assert accounts == {"山(株)": (None, 1200, "active", True), "Old Inc": (5, 500, "cancelled", False)}
    quality_rows = rows(models["identity_quality"], "source", "category", "n")
    assert {("B", "deleted_in_source", 1), ("C", "deleted_in_source", 1), ("ALL", "ambiguous_link", 0), ("D", "phone_kana", 2)} <= quality_rows


def test_metrics_and_reconciliation(models):
    feb, mar = dt.date(2026, 2, 1), dt.date(2026, 3, 1)
    active = {(r.period_month, r["product"]): r.active_members for r in models["metric_active_members"].collect()}
    assert active == {(feb, "ALL"): 1, (feb, "A"): 1, (feb, "B"): 1, (feb, "C"): 1, (feb, "D"): 1, (mar, "ALL"): 1, (mar, "A"): 1, (mar, "B"): 0, (mar, "C"): 0, (mar, "D"): 0}
    revenue = {(r.period_month, r["product"]): r.net_revenue for r in models["metric_net_revenue"].collect()}
    assert revenue == {(feb, "ALL"): 1100, (feb, "A"): 0, (feb, "D"): 1100, (mar, "ALL"): 3300, (mar, "A"): 110, (mar, "D"): 3190}
    churn = {(r.period_month, r["product"]): r.churned_members for r in models["metric_churned_members"].collect()}
    assert churn[feb, "ALL"] == 0 and churn[mar, "ALL"] == 1 and churn[mar, "B"] == 1
    each = {(r.period_month, r["product"]): r.sessions_per_active_member for r in models["metric_sessions_per_active_member"].collect()}
    assert each[feb, "ALL"] == decimal.Decimal(3) and each[mar, "C"] == 0
    recon = {r.reported_as: (r.canonical_value, r.comparable, r.explained) for n in ("active_members", "net_revenue") for r in models[f"recon_{n}"].collect()}
    assert recon == {"active_users": (1, True, False), "net_sales": (3190, True, True), "mrr": (None, False, None)}


def test_reported_measures(spark, lake, models):
    bronze = silver.bronze(spark, f"{lake[0]}/lake")
    found = {(r.reported_as, r.period_month.month): r.value for r in silver.reported(bronze, models["dim_month"]).collect()}
    want = {
        ("active_users", 2): 1, ("active_users", 3): 2, ("iap_revenue", 2): 610, ("iap_revenue", 3): 0, ("workouts_per_user", 2): 1, ("workouts_per_user", 3): 0.5, ("active_customers", 2): 1, ("active_customers", 3): 2, ("booking_revenue", 2): 1000, ("booking_revenue", 3): 500,
        ("bookings_per_customer", 3): 1, ("lost_customers", 3): 0, ("active_members", 2): 2, ("active_members", 3): 2, ("monthly_revenue", 2): 3300, ("monthly_revenue", 3): 4400, ("churned_members", 3): 1, ("avg_visits_per_member", 2): 0.5, ("billed_customers", 2): 1, ("net_sales", 3): 2800, ("cancelled_customers", 3): 0,
        ("seats_under_contract", 2): 15, ("seats_under_contract", 3): 0, ("mrr", 2): 1500, ("mrr", 3): 1200,
    }
    assert {k: found[k] for k in want} == want and len(found) == 32


def test_reconciliation_keeps_null_and_false_apart(spark):
    metric = specs.Metric("m", "sum_by_month", {}, known_variants=(specs.Variant("A", "in", "d", "higher", 0, 10), specs.Variant("A", "out", "d", "higher", 0, 10), specs.Variant("A", "wrong", "d", "higher", 1, 10), specs.Variant("A", "near", "d", "higher", 5, 10), specs.Variant("B", "none", "d", "any", 0, 10), specs.Variant("C", "apart", "d", comparable=False, note="n")))
    own = spark.createDataFrame([("x", "A", 1000), ("x", "B", 0)], "period_month string, product string, m long")
    reported = spark.createDataFrame([("A", "in", "x", 1050.0, ""), ("A", "out", "x", 1200.0, ""), ("A", "wrong", "x", 950.0, ""), ("A", "near", "x", 960.0, ""), ("B", "none", "x", 1.0, ""), ("C", "apart", "x", 1.0, "")], "product string, reported_as string, period_month string, value double, definition string")
    got = {r.reported_as: r.explained for r in specs.reconciliation(metric, own, reported).collect()}
    assert got == {"in": True, "out": False, "wrong": False, "near": True, "none": False, "apart": None}


def test_specification_and_policy_are_validated(spark, lake):
    good = {"version": 1, "metrics": [{"name": "m", "kind": "sum_by_month", "scopes": {"ALL": "all"}}]}
    assert specs.parse(good).metrics[0].name == "m"
    for change in ({"kind": "other"}, {"name": "product"}, {"scopes": {"D": "population"}}, {"scopes": {"D": "odd"}}, {"scopes": {}}, {"known_variants": [{"product": "A", "reported_as": "x", "definition": "d"}]}, {"known_variants": [{"product": "A", "reported_as": "x", "definition": "d", "comparable": False}]}, {"kind": "rows_per_active", "definition": {"active_metric": "m"}}):
        with pytest.raises(specs.SpecError):
            specs.parse({"version": 1, "metrics": [good["metrics"][0] | change]})
    for bad in ({"version": 2}, {"version": 1, "metrics": good["metrics"] * 2}):
        with pytest.raises(specs.SpecError):
            specs.parse(bad)
    unknown = specs.unknown_reported(specs.load(), spark.read.parquet(f"{lake[0]}/lake/reported_kpis"))
    assert rows(unknown, "product", "reported_as") == {("C", "unheard_of")}
    role = {"products": ["A"], "sensitive": "exclude", "direct": "mask"}
    assert access.parse({"version": 1, "roles": {"r": role}}).role("r").products == ("A",)
    for change in ({"products": "some"}, {"sensitive": "x"}, {"direct": "x"}, {"keys": "x"}, {"products": "all", "keys": "pseudonym"}):
        with pytest.raises(access.PolicyError):
            access.parse({"version": 1, "roles": {"r": role | change}})
    for tables in ([{"name": "t", "row_scope": {"kind": "flags"}}], [{"name": "t", "audience": "x", "row_scope": {"kind": "none"}}], [{"name": "t", "row_scope": {"kind": "none"}}] * 2):
        with pytest.raises(access.PolicyError):
            access.parse({"version": 1, "roles": {"r": role}, "tables": tables})


def test_roles_see_their_rows_masks_and_pseudonyms(spark, lake, models, allowed):
    roles = f"{lake[0]}/warehouse/roles"
    assert {r: len(t) for r, t in allowed.items()} == {"analyst": 19, "privacy_officer": 20, "product_a": 15, "product_b": 16, "product_c": 17, "product_d": 16, "product_e": 14}
    sky = key("sky@example.com")
    analyst = spark.read.parquet(f"{roles}/analyst/dim_member").filter(f"member_key = '{sky}'").first()
    assert (analyst.name_initial, analyst.email_domain, analyst.phone_last4, analyst.birth_date_year) == ("佐***", "Example.com", "5678", 1990)
    assert not {"health_notes", "name", "email"} & set(analyst.asDict())
    assert "health_notes" in spark.read.parquet(f"{roles}/privacy_officer/dim_member").columns
    d = spark.read.parquet(f"{roles}/product_d/dim_member")
    assert "source_member_id" not in d.columns and rows(d, "product") == {("D",)} and sky not in {r.member_key for r in d.collect()}
    assert rows(spark.read.parquet(f"{roles}/product_a/metric_active_members"), "product") == {("A",)}
    seen = {p: spark.read.parquet(f"{roles}/product_{p}/dim_member") for p in "abcd"}
    assert quality.linkable_keys(seen, "member_key", models["dim_member"]).count() == 0
    assert rows(quality.linkable_keys({"x": seen["a"], "y": seen["a"]}, "member_key", models["dim_member"]), "problem") == {("in two roles",)}
    own = models["int_member_live_rows"].filter("source = 'B'").select(models["dim_member_by_product"].columns[2])
    assert quality.known_elsewhere_only(models["dim_member_by_product"].filter("product = 'B'"), own, ["source_member_id"]).count() == 0
    assert quality.without_live_source(models["dim_member"], models["xref_member"]).count() == 0
    assert access.undeclared(described(models), models) == [] and access.exposed(access.load(), allowed) == []
    open_ = access.Policy((access.Role("r", ("A",), "exclude", "clear"),), (access.Rule("dim_member", access.RowScope("flags", columns={"A": "in_a"})),))
    assert access.exposed(open_, access.allowlist(open_, models, described(models)))
    flagged = access.copy(models["dim_member"], open_.roles[0], open_.rules[0].scope, described(models)["dim_member"])
    assert {r.in_a for r in flagged.collect()} == {True}


REFUSED = """select * from parquet.`/tmp/x.parquet`|select * from range(3)|select reflect('java.lang.System', 'getenv', 'HOME') from dim_member|select java_method('java.lang.System', 'getenv', 'HOME') from dim_member
select transform(member_key) using 'cat' from dim_member|set spark.sql.runSQLOnFiles = true|insert into dim_member select * from dim_member|drop view dim_member|create view v as select 1|select 1; select 2|select (((
select * from default.dim_member|select * from fct_payment_secret|select health_notes from dim_member|select * from dim_member lateral view explode(array(1)) t as x|select explode(array(1)) from dim_member|table dim_member|values (1)
select input_file_name() from dim_member|select current_user() from dim_member|cache table dim_member|show tables|describe dim_member|select :x from dim_member|select ? from dim_member|select try_reflect('java.lang.System', 'getenv', 'HOME')
with fct_payment_secret as (select 1 as a) select * from (select * from fct_payment_secret) x join other on true|select * from (with other as (select 1 as a) select * from other) x, other|select count(struct(*)) from dim_member|explain select 1|use default
select member_key from dim_member where member_key in (select x from secret_table)|select * from dim_member tablesample (5 percent)|select * from dim_member a, lateral (select a.member_key) b""".replace("\n", "|").split("|")


@pytest.fixture(scope="module")
def analyst(spark, lake, allowed):
    return gateway.Gateway(spark, "analyst", "ann", allowed, f"{lake[0]}/warehouse/roles", f"{lake[0]}/audit")


def test_gateway_refuses_and_audits(spark, lake, analyst):
    for sql in REFUSED:
        with pytest.raises(gateway.Denied):
            analyst.query(sql)
    denied = spark.read.parquet(f"{lake[0]}/audit/query_denied")
    assert denied.count() == len(REFUSED) and denied.filter("length(sql_hash) = 64 and deny_reason <> '' and principal = 'ann'").count() == len(REFUSED)
    assert {tuple(r.sensitive_columns) for r in denied.collect() if "health_notes" in r.referenced_columns} == {("health_notes",)}


def test_gateway_answers_with_lineage_cap_and_one_event(spark, lake, allowed, analyst):
    got = analyst.query("with m as (select member_key, n_products from dim_member) select a.n_products, count(*) as n from m a join m b on a.member_key = b.member_key group by 1 order by n desc, 1")
    assert got.columns == ["n_products", "n"] and got.analysis.columns == ["dim_member.member_key", "dim_member.n_products"]
    assert len(analyst.query("select * from dim_member", 1).rows) == 1 and len(analyst.query("select * from dim_member limit 2", 1000).rows) == 2
    for limit in (0, 1001):
        with pytest.raises(gateway.Denied):
            analyst.query("select member_key from dim_member", limit)
    assert spark.read.parquet(f"{lake[0]}/audit/query_executed").count() == 3
    officer = gateway.Gateway(spark, "privacy_officer", "pat", allowed, f"{lake[0]}/warehouse/roles", f"{lake[0]}/audit")
    assert officer.query("select max(health_notes) as x from dim_member").analysis.sensitive == ["health_notes"]
    log = silver.audit_access_log(spark.read.parquet(f"{lake[0]}/audit/query_executed"), spark.read.parquet(f"{lake[0]}/audit/query_denied"))
    assert rows(log.filter("touched_sensitive"), "principal", "outcome", "sensitive_columns") >= {("pat", "executed", "health_notes")}


def test_normal_form_hides_literals():
    a, b = gateway.normal_form("SELECT  x FROM t -- note\n where y = 'Bob' and z=12"), gateway.normal_form("select x from t where y = 'O''Hara' and z = 3.5e2 ;")
    assert a == b and "Bob" not in a


def test_gateway_set_up_and_failing_audit(spark, lake, allowed):
    for role, principal, folder in (("nobody", "ann", "roles"), ("analyst", " ", "roles"), ("analyst", "ann", "nowhere")):
        with pytest.raises(gateway.GatewayError):
            gateway.Gateway(spark, role, principal, allowed, f"{lake[0]}/warehouse/{folder}", f"{lake[0]}/audit")
    blocked = lake[0] / "blocked"
    blocked.write_text("a file")
    own = gateway.Gateway(spark, "analyst", "ann", allowed, f"{lake[0]}/warehouse/roles", str(blocked))
    with pytest.raises(Exception):  # noqa: B017  no event, no rows
        own.query("select member_key from dim_member")


#: What the data layer has to refuse by itself, with nothing run or written; {out} is a folder of the test, {other} another role's table.
REFUSED = (
    "select * from parquet.`{other}`", "select * from csv.`/etc/hosts`", "select * from text.`/etc/*`", "create table leaked using parquet location '{other}'", "create table t as select 1",
    "create temporary view v as select 1", "create or replace temporary view dim_member using parquet options (path '{other}')", "insert overwrite directory '{out}' using csv select 1", "from dim_member insert overwrite directory '{out}' using csv select member_key",
    "insert into dim_member select * from dim_member", "execute immediate 'select 1'", "execute immediate \"insert overwrite directory '{out}' using csv select 1\"", "begin insert overwrite directory '{out}' using csv select 1; end",
    "set spark.sql.runSQLOnFiles = true", "reset", "add jar '/tmp/other.jar'", "create function f as 'java.lang.Math'", "declare x int", "use default", "show tables", "describe dim_member", "explain select 1", "cache table dim_member", "drop view dim_member", "truncate table dim_member", "msck repair table dim_member",
    "load data inpath '/etc/hosts' into table dim_member", "select java_method('java.lang.System', 'getenv', 'PATH')", "with x as (select reflect('java.lang.System', 'getenv', 'PATH') as y) select y from x", "select nvl(java_method('java.lang.System', 'getenv', 'PATH'), '') from dim_member",
    "select member_key from dim_member order by java_method('java.lang.System', 'getenv', 'PATH')", "select sum(length(reflect('java.lang.System', 'getenv', 'PATH'))) over () from dim_member", "select member_key from dim_member where exists (select reflect('java.lang.System', 'getenv', 'PATH'))",
    "select transform(member_key) using 'cat' from dim_member", "select explode(array(1, 2))", "select * from range(5)", "select input_file_name() from dim_member", "select _metadata.file_path from dim_member", "select current_user()", "select * from global_temp.other_session", "select * from other_session",
    "select health_notes from dim_member", "select * from nothing", "select * from silver.dim_member",
)


def test_the_data_layer_holds_alone(spark, lake, allowed):
    folder, out = f"{lake[0]}/warehouse/roles/analyst", lake[0] / "written"
    spark.createDataFrame([("x",)], "v string").createOrReplaceGlobalTempView("other_session")
    spark.createDataFrame([("x",)], "v string").createOrReplaceTempView("other_session")
    before = {t.name for t in spark.catalog.listTables()}
    data, other = gateway.DataLayer(spark, {"dim_member": f"{folder}/dim_member"}), f"{lake[0]}/warehouse/roles/privacy_officer/dim_member"
    for sql in REFUSED:
        with pytest.raises(Exception):  # noqa: B017  a refusal of its own, or the engine's
            data.read(sql.format(out=out, other=other)).collect()
        assert not out.exists(), sql
    for sql in ("create table leaked using parquet location '{other}'", "select * from leaked", "select health_notes from dim_member"):
        with pytest.raises(Exception):  # noqa: B017
            gateway.execute_readonly(spark, folder, sql.format(other=other))
    assert {t.name for t in spark.catalog.listTables()} == before and spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_the_data_layer_reads_what_the_role_has(spark, lake, allowed):
    data = gateway.DataLayer(spark, {"dim_member": f"{lake[0]}/warehouse/roles/analyst/dim_member"})
    reads = [
        "select member_key from dim_member",
        "with a as (select * from dim_member), b as (select member_key, count(*) as n from a group by 1 having count(*) > 0) select b.member_key, sum(n) over (order by n) from b join a on a.member_key = b.member_key order by 1 limit 2",
        "select nvl(member_key, 'x'), left(member_key, 1), startswith(member_key, 'a'), contains(member_key, 'a'), ceil(1.2), split_part(member_key, '.', 1), try_divide(1, 0), date_trunc('month', date '2026-01-02') from dim_member where member_key in (select member_key from dim_member)",
        "select member_key from dim_member union select 'x' except select 'y' intersect select 'y'",
        "select grouping(member_key), count(*), median(1), max_by(member_key, member_key) from dim_member group by rollup(member_key)",
    ]
    for sql in reads:
        assert data.read(sql).collect() == data.spark.sql(sql).collect(), sql


def test_every_engine_error_is_an_event(spark, lake, allowed, monkeypatch):
    own = gateway.Gateway(spark, "analyst", "eve", allowed, f"{lake[0]}/warehouse/roles", f"{lake[0]}/audit_eve")
    monkeypatch.setattr(own.data, "read", lambda sql: (_ for _ in ()).throw(RuntimeError("no such thing as 'Bob'")))
    with pytest.raises(gateway.Denied, match="RuntimeError: failed"):
        own.query("select member_key from dim_member")
    events = spark.read.parquet(f"{lake[0]}/audit_eve/query_denied").collect()
    assert len(events) == 1 and "Bob" not in str(events[0])


def test_catalog_and_client(spark, lake, models, allowed, analyst, monkeypatch):
    full = catalog.build(models, described(models), specs.load())
    assert full == catalog.build(models, described(models), specs.load())
    member = next(t for t in full["tables"] if t["name"] == "dim_member")
    assert "dim_household" in member["downstream"] and {"name": "email", "type": "string", "pii": "direct", "mask": "email_domain"}.items() <= next(c for c in member["columns"] if c["name"] == "email").items()
    own = catalog.of_role(full, "product_e", allowed)
    assert {t["name"] for t in own["tables"]} == set(allowed["product_e"]) and "ALL" not in json.dumps(own["tables"])
    client = catalog.Client(analyst, catalog.of_role(full, "analyst", allowed))
    assert client.search_tables("members")[0]["name"] == "dim_member"
    latest = client.get_metric("active_members")["latest"]
    assert {(r["period_month"], r["product"], r["value"]) for r in latest} >= {("2026-03-01", "ALL", 1)}
    assert client.describe_table("dim_member")["name"] == "dim_member" and "denied" in client.run_query("drop table x")
    with pytest.raises(LookupError):
        client.describe_table("nothing")
    monkeypatch.delenv(catalog.ROLE, raising=False)
    with pytest.raises(gateway.GatewayError):
        catalog.from_environment(spark, allowed, full, "", "")


def test_command_line(spark, lake, allowed, capsys, monkeypatch):
    where = ["--lake", f"{lake[0]}/lake", "--warehouse", f"{lake[0]}/warehouse"]
    assert cli.main([*where, "query", "analyst", "ann", "select count(*) as n from dim_member"], spark) == 0
    assert json.loads(capsys.readouterr().out)["rows"] == [[3]]
    assert cli.main([*where, "query", "analyst", "ann", "drop table x"], spark) == 1
    assert cli.main([*where, "query", "nobody", "ann", "select 1"], spark) == 2
    assert cli.main([*where, "check-access"], spark) == 0 and cli.main([*where, "check-metrics"], spark) == 1
    monkeypatch.delenv("NO_SALT", raising=False)
    assert cli.main([*where, "ingest", "nowhere", "--salt-variable", "NO_SALT"], spark) == 2
    monkeypatch.setenv("NO_SALT", "x")
    assert cli.main([*where, "ingest", "nowhere", "--salt-variable", "NO_SALT"], spark) == 2
    assert cli.main([*where, "ingest", "nowhere", "--salt-variable", "NO_SALT", "--more"], spark) == 0
    assert cli.main([*where, "scan"], spark) == 1
    assert "A.member_registered.email: undeclared" in capsys.readouterr().err


def asked(server, *messages):
    """The answers to these messages, as they go over the line."""
    out = io.StringIO()
    server.serve((m if isinstance(m, str) else json.dumps({"jsonrpc": "2.0"} | m) for m in messages), out)
    return [json.loads(line) for line in out.getvalue().splitlines()]


def call(name, /, **arguments):
    return {"id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}}


@pytest.fixture(scope="module")
def tool_server(spark, lake, models, allowed):
    def of(role):
        own = gateway.Gateway(spark, role, "mia", allowed, f"{lake[0]}/warehouse/roles", f"{lake[0]}/audit_server_{role}")
        return server.Server(catalog.Client(own, catalog.of_role(catalog.build(models, described(models), specs.load()), role, allowed)))

    return of


def test_server_speaks_the_protocol(tool_server):
    own = tool_server("analyst")
    got = asked(own, {"id": 0, "method": "initialize", "params": {"protocolVersion": "2024-11-05"}}, {"method": "notifications/initialized"}, "", {"id": "x", "method": "ping"}, {"id": 2, "method": "tools/list"}, "{no json", "[]", {"id": 3, "method": "resources/list"}, {"id": 4, "method": "tools/call", "params": {"name": "drop_table"}})
    assert [g.get("id") for g in got] == [0, "x", 2, None, None, 3, 4]
    assert got[0]["result"]["protocolVersion"] == "2024-11-05" and got[1]["result"] == {}
    listed = {t["name"]: t["inputSchema"] for t in got[2]["result"]["tools"]}
    assert set(listed) == {"search_tables", "describe_table", "get_metric", "run_query"} and listed["run_query"]["required"] == ["sql"]
    assert [g["error"]["code"] for g in got[3:]] == [server.NOT_JSON, server.NOT_A_REQUEST, server.NO_METHOD, server.BAD_PARAMETERS]


def test_server_tools(tool_server, lake, spark):
    own = tool_server("analyst")
    found, table, metric, result, none = (g["result"] for g in asked(own, call("search_tables", query="members"), call("describe_table", name="dim_member"), call("get_metric", name="active_members"), call("run_query", sql="select count(*) as n from dim_member", limit=5), call("describe_table", name="nothing")))
    assert found["structuredContent"]["tables"][0]["name"] == "dim_member" and table["structuredContent"]["name"] == "dim_member"
    assert metric["structuredContent"]["latest"] and not metric["isError"]
    assert result["structuredContent"] == {"columns": ["n"], "rows": [[3]], "row_count": 1} and json.loads(result["content"][0]["text"]) == result["structuredContent"]
    assert none["isError"] and "nothing" in none["content"][0]["text"]
    refused, argued, typed = asked(own, call("run_query", sql="select health_notes from dim_member"), call("run_query", sql="select 1", role="privacy_officer"), call("run_query", sql="select 1", limit="many"))
    assert refused["result"]["isError"] and "query denied" in refused["result"]["content"][0]["text"]
    assert argued["error"]["code"] == typed["error"]["code"] == server.BAD_PARAMETERS
    events = spark.read.parquet(f"{lake[0]}/audit_server_analyst/query_denied").collect()
    assert [(e.principal, e.role, e.sensitive_columns, e.touched_sensitive) for e in events] == [("mia", "analyst", ["health_notes"], True)]
    read = asked(tool_server("privacy_officer"), call("run_query", sql="select max(health_notes) as x from dim_member"))
    assert read[0]["result"]["structuredContent"]["rows"] == [["note"]]


@pytest.mark.parametrize(("role", "principal"), [(None, "ann"), ("analyst", None), ("root", "ann"), ("analyst", "  ")])
def test_server_does_not_start_without_role_and_principal(spark, lake, allowed, capsys, monkeypatch, role, principal):
    for name, value in ((catalog.ROLE, role), (catalog.PRINCIPAL, principal)):
        monkeypatch.setenv(name, value) if value is not None else monkeypatch.delenv(name, raising=False)
    assert cli.main(["--lake", f"{lake[0]}/lake", "--warehouse", f"{lake[0]}/warehouse", "serve-mcp"], spark) == 2
    said = capsys.readouterr()
    assert said.out == "" and said.err.startswith("serve-mcp:")
