"""A small lake of five sources: files as they come in, good ones and bad ones."""

import datetime as dt
from pathlib import Path


UTC = dt.timezone.utc
NOW = dt.datetime(2026, 5, 1, 12, tzinfo=UTC)
SALT = "pepper"


def at(day, hour=3):
    return dt.datetime.fromisoformat(f"2026-{day}T{hour:02d}:00:00").replace(tzinfo=UTC)


def local(day, hour=12):
    return dt.datetime.fromisoformat(f"2026-{day}T{hour:02d}:00:00")


def day(text):
    return dt.date.fromisoformat(f"2026-{text}")


def parquet(spark, rows, schema, path):
    """One file of these rows at path."""
    folder = f"{path}.dir"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    next(Path(folder).glob("part-*.parquet")).rename(path)


def text(path, lines, encoding):
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes("\r\n".join(lines).encode(encoding))


EVENT = "event_id string, occurred_at timestamp, recorded_at timestamp, member_id string"
PERSON = f"{EVENT}, email string, name string, name_kana string, phone string, birth_date date, guardian_member_id string, guardian_email string, health_notes string"
CHANGE = "op string, changed_at timestamp, lsn bigint"
INVOICES = "請求番号,請求日,氏名,氏名カナ,電話番号,生年月日,プランコード,請求金額（税抜）,消費税率,入金状況"


def incoming(spark, root):
    b = dt.date(1990, 1, 2)
    people = [
        ("e1", at("02-01"), at("02-01", 4), "m1", " Sky+news@Example.com", "佐藤翔太", "さとう しょうた", "+81 90 1234 5678", b, None, None, "note"),
        ("e1", at("02-01"), at("02-01", 5), "m1", "later@example.com", "佐藤翔太", "さとう しょうた", "090-1234-5678", b, None, None, "note"),
        ("e2", at("02-02"), at("02-02", 4), "m2", "child@example.com", "Kid", None, None, b, "m1", "sky@example.com", None),
    ]
    parquet(spark, people, PERSON, f"{root}/A/member_registered/dt=2026-02-01/part-0.parquet")
    parquet(spark, [("e9", at("02-03"), at("02-03"), None, None, "x", None, None, b, None, None, None)], PERSON, f"{root}/A/member_registered/dt=2026-02-03/part-0.parquet")
    Path(f"{root}/A/member_registered/dt=2026-02-04").mkdir(parents=True)
    Path(f"{root}/A/member_registered/dt=2026-02-04/part-0.parquet").write_bytes(b"no parquet")
    parquet(spark, [("o1", at("02-10"), at("02-10"), "m1"), ("o2", at("03-30"), at("03-30"), "m1"), ("o3", at("03-30"), at("03-30"), "m2")], EVENT, f"{root}/A/app_opened/dt=2026-02-10/part-0.parquet")
    parquet(spark, [("w1", at("02-10"), at("02-10"), "m1", "run", 30), ("w2", at("03-20"), at("03-20"), "m2", "run", 20)], f"{EVENT}, workout_type string, duration_min int", f"{root}/A/workout_completed/dt=2026-02-10/part-0.parquet")
    # 2026-02-28 15:30 UTC is March in Tokyo.
    parquet(spark, [("p1", dt.datetime(2026, 2, 28, 15, 30, tzinfo=UTC), at("03-01"), "m1", "sku", 110, 0.1), ("p2", at("02-05"), at("02-05"), "gone", "sku", 500, 0.1)], f"{EVENT}, sku string, amount_tax_incl bigint, tax_rate double", f"{root}/A/purchase_made/dt=2026-02-28/part-0.parquet")

    customers = "tenant_id string, member_no bigint, name string, name_kana string, email string, phone string, created_at timestamp_ntz, is_deleted boolean, deleted_at timestamp_ntz"
    parquet(spark, [("T001", 1, "Sato", None, "sky@example.com", None, local("02-03"), False, None), ("T001", 2, "Out", None, None, "0312345678", local("02-03"), False, None)], customers, f"{root}/B/customers/dt=2026-02-28/snapshot.parquet")
    parquet(spark, [("T001", 1, "Sato S", None, "sky@example.com", None, local("02-03"), False, None), ("T001", 2, "Out", None, None, "0312345678", local("02-03"), True, local("03-10"))], customers, f"{root}/B/customers/dt=2026-03-31/snapshot.parquet")
    bookings = "tenant_id string, booking_no bigint, member_no bigint, class_start_at timestamp_ntz, created_at timestamp_ntz, status string, price_ex_tax bigint, tax_rate double, is_deleted boolean"
    rows = [("T001", 1, 1, local("02-20"), local("02-10"), "attended", 1000, 0.1, False), ("T001", 2, 1, local("03-20"), local("03-10"), "cancelled", 500, 0.1, False), ("T001", 3, 2, local("03-20"), local("03-11"), "attended", 500, 0.1, False)]
    parquet(spark, rows, bookings, f"{root}/B/bookings/dt=2026-03-31/snapshot.parquet")
    parquet(spark, [("T001", 9, 1, local("02-20"), local("02-10"), 0.1)], "tenant_id string, booking_no bigint, member_no bigint, class_start_at timestamp_ntz, created_at timestamp_ntz, tax_rate double", f"{root}/B/bookings/dt=2026-04-30/snapshot.parquet")

    members = f"{CHANGE}, member_id bigint, name string, name_kana string, email string, phone string, birth_date date, guardian_email string, medical_conditions string, facility_id string, status string, joined_on date"
    own = lambda op, when, lsn, i, mail: (op, at(when), lsn, i, f"C{i}", None, mail, None, b, None, "knee", "F1", "ok", day("02-01"))
    parquet(spark, [own("I", "02-01", 1, 7, "sky@example.com"), own("I", "02-01", 2, 8, "eight@example.com"), own("D", "03-01", 3, 8, "eight@example.com")], members, f"{root}/C/members/dt=2026-02-01/part-000.parquet")
    parquet(spark, [own("X", "02-01", 4, 9, "nine@example.com")], members, f"{root}/C/members/dt=2026-02-02/part-000.parquet")
    old = f"{CHANGE}, contract_id bigint, member_id bigint, plan_cd string, monthly_fee bigint, start_dt date, end_dt date, family_group_id bigint, status string"
    line = lambda op, when, lsn, i, m, end=None: (op, at(when), lsn, i, m, "STD", 1100, day("02-01"), end, None, "live")
    parquet(spark, [line("I", "02-01", 1, 1, 7), line("U", "02-02", 2, 1, 7), line("D", "02-03", 3, 1, 7), line("I", "02-04", 4, 1, 7), line("I", "02-01", 5, 2, 8), line("I", "02-01", 6, 3, 7, day("03-10"))], old, f"{root}/C/contracts_fy2025/dt=2026-02-01/part-000.parquet")
    new = f"{CHANGE}, contract_id bigint, member_id bigint, plan_id string, price_ex_tax bigint, tax_rate double, effective_from date, effective_to date, payer_member_id bigint, billing_cycle string, status string"
    parquet(spark, [("I", at("03-01"), 7, 4, 7, "P999", 2000, 0.1, day("03-01"), None, 7, "m", "live")], new, f"{root}/C/contracts_fy2026/dt=2026-03-01/part-000.parquet")
    visits = f"{CHANGE}, visit_id bigint, member_id bigint, checked_in_at timestamp, facility_id string"
    parquet(spark, [("I", at("02-15"), 1, 1, 7, at("02-15"), "F1"), ("I", at("03-15"), 2, 2, 7, at("03-15"), "F1"), ("D", at("03-16"), 3, 2, 7, at("03-15"), "F1"), ("I", at("03-15"), 4, 3, 8, at("03-15"), "F1")], visits, f"{root}/C/visits/dt=2026-02-15/part-000.parquet")

    text(f"{root}/D/invoices/dt=2026-02-28/i.csv", [INVOICES, "INV0000001,2026/02/20,佐藤翔太,ｻﾄｳ ｼｮｳﾀ,09012345678,1990/01/02,M1,1000,10%,済", "INV0000002,2026/03/05,高橋①,タカハシ,0311112222,1980/01/02,QK,3000,10%,未"], "cp932")
    text(f"{root}/D/invoices/dt=2026-03-31/i.csv", [INVOICES.replace("請求金額（税抜）", "請求額"), "INV0000003,2026/03/20,a,b,c,1990/01/02,M1,1000,10%,済"], "cp932")
    Path(f"{root}/D/invoices/dt=2026-04-30").mkdir(parents=True)
    Path(f"{root}/D/invoices/dt=2026-04-30/i.csv").write_bytes(b"\x81\x00\xff,x\r\n")
    text(f"{root}/D/refunds/dt=2026-02-28/r.csv", [""], "cp932")
    text(f"{root}/D/refunds/dt=2026-03-31/r.csv", ["返金番号,元請求番号,返金日,返金額（税抜）", "RF000001,INV0000001,2026/03/02,100", "RF000002,INV9999999,2026/03/02,100"], "cp932")
    text(f"{root}/E/accounts/month=2026-02/a.csv", ["会社名,担当者,契約人数,月額料金,ステータス,営業担当", "株式会社 山,Yama,１０,\"1,000\",契約中,Eigyo", "Old Inc,Old,5,500,契約中,Eigyo"], "utf-8-sig")
    text(f"{root}/E/accounts/month=2026-03/a.csv", ["企業名,担当者名,利用人数,月額(円),契約状況,営業担当者", "山(株),Yama,—,1200,契約中,", "Old Inc,Old,5,500,解約,Eigyo"], "utf-8-sig")
    text(f"{root}/E/accounts/month=2026-04/a.csv", ["会社名,担当者,契約人数,月額料金,ステータス,営業担当,備考2", "x,x,1,1,契約中,x,secret"], "utf-8-sig")
    kpis = [("A", "active_users", day("03-01"), 2.0, "d"), ("D", "net_sales", day("03-01"), 2900.0, "d"), ("E", "mrr", day("03-01"), 1200.0, "d"), ("C", "unheard_of", day("03-01"), 1.0, "d")]
    parquet(spark, kpis, "product string, reported_as string, period_month date, value double, definition string", f"{root}/reported_kpis/A/kpis.parquet")


PERIOD = (dt.date(2026, 2, 1), dt.date(2026, 3, 31))
