"""One small fixture for each rule."""

import datetime as dt
import hashlib
import random

import pytest

from millrace.functions import identity, scalars
from millrace.operators import contracts, history, kpis, metrics, quality
from millrace.plans import silver
from millrace.sources import tables


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_normal_forms():
    forms = [
        (identity.email_of, ["  Sky00001+news@Example.COM ", "ＡＢＣ@Example.com", "x@y@z", "no", "@a.b", "a@", "", None], ["sky00001@example.com", "abc@example.com", "x@y@z", None, None, None, None, None]),
        (identity.phone_of, ["+81 90 1234 5678", "０９０１２３４５６７８", "123", "٠٩٠١٢٣٤٥٦٧٨", None], ["09012345678", "09012345678", None, "٠٩٠١٢٣٤٥٦٧٨", None]),
        (identity.kana_of, ["さとうしょうた", "サトウ ショウタ", "ｻﾄｳｼｮｳﾀ", "サトウ　ショウタ", " "], ["サトウショウタ"] * 4 + [None]),
        (identity.company_of, ["株式会社山", "山株式会社", "(株)山", "（株） 山", "有限会社"], ["山"] * 4 + [None]),
    ]
    for f, raw, want in forms:
        assert [f(x) for x in raw] == want


def test_order_of_identities():
    salt = "s"
    key = lambda purpose, value: identity.hmac_hex(salt, purpose, value)
    link = key("phone_kana", "09012345678|サトウ")
    assert identity.identity_of(salt, "A", "1", "a@b.c", "090-1234-5678", "さとう") == (key("email", "a@b.c"), link, "email")
    assert identity.identity_of(salt, "A", "1", "bad", "090-1234-5678", "さとう") == (key("phone", "09012345678"), link, "phone")
    assert identity.identity_of(salt, "D", "1", None, "090-1234-5678", "さとう", by_phone=False) == (link, link, "phone_kana")
    assert identity.identity_of(salt, "D", "1", None, "090-1234-5678", None, by_phone=False) == (key("source_local", "D|1"), None, "source_local")
    own = key("email", "a@b.c")
    assert identity.household_of(salt, "x", " A@b.c") == identity.household_of(salt, own, None) != identity.household_of(salt, "x", "bad")


def test_salt_is_in_no_plan(spark, monkeypatch):
    monkeypatch.delenv("NO_SALT", raising=False)
    with pytest.raises(RuntimeError, match="NO_SALT"):
        identity.salt_from("NO_SALT")
    df = identity.with_keys(spark.createDataFrame([("1", "a@b.c", 5)], "id string, mail string, keys int"), "verysecret", "A", "id", "mail", None, None)
    assert "verysecret" not in df._jdf.queryExecution().toString() and df.columns == ["id", "mail", "keys", "member_key", "link_key", "key_method", "household_key"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_tokyo_time_does_not_depend_on_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("select timestamp_ntz'2026-02-28 08:00:00' as n, date'2026-03-01' as d, timestamp'2026-02-28T15:30:00Z' as i")
        got = df.select(scalars.utc_from_tokyo("n").cast("long"), scalars.utc_from_tokyo("d").cast("long"), scalars.tokyo_date("i"), scalars.month_start(scalars.tokyo_time("i"))).first()
        utc = lambda *x: int(dt.datetime(*x, tzinfo=dt.UTC).timestamp())
        assert tuple(got) == (utc(2026, 2, 27, 23), utc(2026, 2, 28, 15), dt.date(2026, 3, 1), dt.date(2026, 3, 1))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_texts_become_values(spark):
    df = spark.createDataFrame([("2026/02/03", "１,２３４", "10%", "2026-02-03T04:05:06+09:00", ["a", None]), ("2026/02/31", "—", "-", "x", None)], "d string, n string, p string, i string, l array<string>")
    got = [tuple(r) for r in df.select(scalars.date_from_slashes("d"), scalars.whole_number("n"), scalars.percent("p"), scalars.instant("i").cast("long"), scalars.list_to_text("l")).collect()]
    assert got == [(dt.date(2026, 2, 3), 1234, 0.1, int(dt.datetime(2026, 2, 2, 19, 5, 6, tzinfo=dt.UTC).timestamp()), "a"), (None, None, None, None, None)]
    key = spark.createDataFrame([("株式会社　山 ",)], "c string").select(scalars.account_key("c"), scalars.birth_year(scalars.date_from_slashes(scalars.F.lit("1990/01/02")))).first()
    assert tuple(key) == (hashlib.sha256("山".encode()).hexdigest()[:16], 1990)


def test_event_copies(spark):
    copies = [("e1", 2, "b"), ("e1", 1, "z"), ("e2", 1, "y"), ("e2", 1, "a"), ("e3", None, "a"), ("e3", 5, "z")]
    got = history.deduplicated(spark.createDataFrame(copies, "event_id string, recorded_at int, file string"))
    assert rows(got, "event_id", "recorded_at", "file") == {("e1", 1, "z"), ("e2", 1, "a"), ("e3", 5, "z")}


def test_history_keeps_users_columns(spark):
    df = spark.createDataFrame([(1, 1, "a", 9, 8), (1, 2, "b", 7, 6)], "k int, at int, s string, place int, seen int")
    assert rows(history.first_per_key(df, ["k"], [history.F.col("at")]), "place", "seen") == {(9, 8)}
    assert history.scd2(df, ["k"], ["s"], ["at"], "at", carry=["place", "seen"]).columns == ["k", "s", "place", "seen", "valid_from", "valid_to", "is_current"]


def test_reinserted_rows_and_owners_are_versions(spark):
    log = spark.createDataFrame([(1, 1, "I", 7), (1, 2, "U", 7), (1, 3, "D", 7), (1, 4, "I", 7), (2, 1, "I", 7), (2, 2, "U", 8)], "k int, at int, op string, owner int")
    got = sorted(tuple(r) for r in history.scd2(log, ["k"], ["owner"], ["at"], "at", "op").collect())
    assert got == [(1, 7, 1, 3, False, False), (1, 7, 3, 4, False, True), (1, 7, 4, None, True, False), (2, 7, 1, 2, False, False), (2, 8, 2, None, True, False)]


def test_links_and_canonical_keys(spark):
    live = [("A", "1", "K2", "L1", "email"), ("B", "1", "K1", "L1", "email"), ("D", "x", "P1", "L1", "phone_kana"), ("A", "2", "K3", "L2", "email"), ("B", "9", "Z", None, "source_local")]
    df = spark.createDataFrame(live, "source string, source_member_id string, member_key string, link_key string, key_method string")
    links = silver.link_map(df)
    assert rows(links, "link_key", "email_member_key", "n_email_keys") == {("L1", "K1", 2), ("L2", "K3", 1)}
    assert rows(silver.xref_member(df, links), "source_member_key", "member_key", "link_ambiguous") == {("K2", "K1", True), ("K1", "K1", True), ("P1", "K1", True), ("K3", "K3", False), ("Z", "Z", False)}


def test_anomalies(spark):
    days = [dt.date(2026, 1, 1) + dt.timedelta(i) for i in range(80)]
    daily = [(d, 100 + i % 5) for i, d in enumerate(days) if d != dt.date(2026, 3, 10)]
    daily = [(d, 300 if d == dt.date(2026, 2, 20) else n) for d, n in daily]
    found = history.row_count_anomalies(spark.createDataFrame(daily, "day date, n int"), "day", "n")
    assert rows(found, "day", "observed", "kind") == {(dt.date(2026, 2, 20), 300, "unusual_count")}
    calm = [(d, n) for d, n in daily if n < 300]
    assert rows(history.row_count_anomalies(spark.createDataFrame(calm, "day date, n int"), "day", "n"), "day", "kind") == {(dt.date(2026, 3, 10), "missing_day"), (dt.date(2026, 2, 20), "missing_day")}
    flat = spark.createDataFrame([(d, 7) for d in days[:40]] + [(days[41], 900)], "day date, n int")
    assert history.row_count_anomalies(flat, "day", "n").count() == 0
    assert history.row_count_anomalies(spark.createDataFrame(daily[:20], "day date, n int"), "day", "n").count() == 0


def test_checks_hold_from_the_start_of_a_value(spark):
    df = spark.createDataFrame([("T001",), ("xT001",), ("T0011",), ("",), (None,)], "code string")
    found = contracts.violations(df, contracts.Contract(["code"], ["code"], [contracts.matches("code", r"T\d{3}$")]))
    assert rows(found, "column", "check", "n_rows") == {("code", "str_matches", 3)}
    typed = contracts.Contract(["a", "b"], types={"a": "bigint", "b": "timestamp"})
    assert contracts.mistyped({"a": "int", "b": "timestamp_ntz"}, typed) == [("b", "dtype('timestamp')")]
    assert rows(contracts.coerced(spark.createDataFrame([("5",), ("x",)], "a string"), typed), "a") == {(5,), (None,)}


def test_names_and_values_of_personal_data(spark):
    names = {"email": "direct", "e-mail": "direct", "メール": "direct", "tel": "direct", "hotel": "none", "dob": "direct", "postal_code": "direct", "company_name": "none", "full_name": "direct", "氏名": "direct", "injury_notes": "sensitive", "持病": "sensitive", "amount": "none", "ＥＭＡＩＬ": "direct"}
    assert {n: quality.class_of_name(n)[0] for n in names} == names
    file = [("f1", "x", "1"), ("f1", "y", "2"), ("f2", "ａ@b.co", "＋81 90-1234-5678"), ("f2", " c.d@e.org ", "03 1234 5678"), ("f2", None, " "), ("f3", "long words of some patient say much here", "z")]
    df = spark.createDataFrame(file, "file string, a string, b string")
    got = {r.column: (r.level, r.reasons) for r in quality.personal_columns(df, "file").collect()}
    assert got == {"a": ("sensitive", ["e-mail values", "free text"]), "b": ("direct", ["phone values"])}
    assert {r.column: r.level for r in quality.personal_columns(df.drop("file")).collect()} == {"a": "none", "b": "none"}
    assert quality.scan_verdicts({"a": "none"}, {}) == {} and quality.scan_verdicts({"a": "quasi"}, {"a": "direct"}) == {}
    assert quality.scan_verdicts({"a": "direct", "b": "quasi", "c": "none", "d": "quasi"}, {"a": "quasi", "c": "odd", "d": "none"}) == {"a": "weaker", "b": "undeclared", "c": "invalid", "d": "declared none"}


def test_quality_of_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3)], "k int, v int")
    assert rows(quality.not_unique_together(df, ["k", "v"]), "k", "v", "n_rows") == {(1, None, 2)}
    assert rows(quality.nulls(df, ["k", "v"]), "column", "n_rows") == {("v", 2)} and quality.not_true(df, "v > 2").count() == 2
    people, live = spark.createDataFrame([("a",), ("b",)], "member_key string"), spark.createDataFrame([("a",)], "member_key string")
    assert rows(quality.without_live_source(people, live), "member_key") == {("b",)} == rows(quality.left_by_deleted(people, people.subtract(live), ["member_key"]), "member_key")
    now = dt.datetime(2026, 1, 2, tzinfo=dt.UTC)
    for hours, state in ((1, "pass"), (30, "warn"), (100, "error")):
        df = spark.createDataFrame([(now - dt.timedelta(hours=hours),), (now - dt.timedelta(days=300),)], "at timestamp")
        assert quality.freshness(df, "at", now).first().state == state
    assert quality.freshness(df.limit(0), "at", now).first().state == "error"


def test_grid_and_population(spark):
    held = spark.createDataFrame([(1, "D"), (2, "A")], "e int, product string")
    acts = spark.createDataFrame([(1, "A", dt.date(2026, 1, 20)), (2, "B", dt.date(2026, 1, 1))], "e int, source string, day date")
    own = metrics.with_population(acts, "e", held, ["D"])
    got = metrics.active(own, "e", "day", metrics.scope_column("source", {"ALL": "all", "A": "source", "D": "population"}))
    assert rows(got, "month", "scope", "e") == {(dt.date(2026, 1, 1), "ALL", 1), (dt.date(2026, 1, 1), "A", 1), (dt.date(2026, 1, 1), "D", 1)}


def test_sources_and_sinks(spark, tmp_path):
    root = str(tmp_path)
    assert tables.optional_table(spark, f"{root}/none", "a int, b array<string>").schema.simpleString() == "struct<a:int,b:array<string>>"
    tables.append(spark.createDataFrame([(1,)], "a int"), f"{root}/meta/log")
    tables.append(spark.createDataFrame([(2,)], "a int"), f"{root}/meta/log")
    assert rows(spark.read.parquet(f"{root}/meta/log"), "a") == {(1,), (2,)}
    (tmp_path / "plans.csv").write_text("plan,generation\nM1,\nM2,x\n")
    assert rows(tables.seed(spark, f"{root}/plans.csv", "plan string, generation string"), "plan", "generation") == {("M1", None), ("M2", "x")}
    with pytest.raises(FileExistsError, match="meta"):
        tables.cleared(spark, root, ["meta", "A"], overwrite=False)
    tables.cleared(spark, root, ["meta", "A"], overwrite=True)
    assert not (tmp_path / "meta").exists() and (tmp_path / "plans.csv").exists()
    for day, schema in (("2026-01-01", "event_id int"), ("2026-01-02", "event_id int, more string")):
        spark.createDataFrame([(1, "x")[: schema.count(",") + 1]], schema).coalesce(1).write.parquet(f"{root}/e/dt={day}")
    got = tables.events(spark, f"{root}/e")
    assert rows(got, "more", "dt") == {(None, dt.date(2026, 1, 1)), ("x", dt.date(2026, 1, 2))} and got.filter("file like '%dt=2026%parquet'").count() == 2
    assert rows(tables.snapshots(spark, f"{root}/e"), "snapshot_date") == {(dt.date(2026, 1, 1),), (dt.date(2026, 1, 2),)}


def test_text_files_in_any_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("名,値\r\nｻﾄｳ　①,\"1,0\"\r\n".encode("cp932"))
    (tmp_path / "b.csv").write_bytes(b"\x81\x00,x")
    (tmp_path / "c.csv").write_bytes("a,b\n1\n".encode())
    (tmp_path / "d.csv").write_bytes(b"")
    got = {(r.file[-5:], r.place): (r.header, r.cells, r.error) for r in tables.text_files(spark, [str(tmp_path / f"{x}.csv") for x in "abcd"], "cp932").collect()}
    assert got["a.csv", 1] == (["名", "値"], ["ｻﾄｳ　①", "1,0"], None) and got["b.csv", 0][2] == "UnicodeDecodeError" and got["c.csv", 0][2] == "ValueError" and not [k for k in got if k[0] == "d.csv"]  # an empty file gives nothing
    (tmp_path / "e.csv").write_bytes("a\n1\n".encode("utf-8-sig"))
    assert [r.header for r in tables.text_files(spark, str(tmp_path / "e.csv"), "utf-8").collect()] == [["a"], ["a"]]


def test_alive_measures_equal_plain_counts(spark):
    """Intervals that touch, overlap, end on a month's last day, end before they start, start before the spine or never."""
    r, first = random.Random(8), dt.date(2025, 1, 1)
    rows = [(1, dt.date(2025, 1, 31), dt.date(2025, 1, 31), 5), (1, dt.date(2025, 2, 1), dt.date(2025, 2, 27), 7), (2, dt.date(2024, 1, 1), None, 3), (None, dt.date(2025, 1, 1), None, 2), (3, None, dt.date(2025, 5, 5), 9), (4, dt.date(2025, 5, 1), dt.date(2025, 4, 1), 1), (5, dt.date(2026, 1, 1), None, 1), (6, dt.date(2025, 1, 1), None, None)]
    for _ in range(300):
        start = first + dt.timedelta(r.randrange(-90, 400))
        rows.append((r.randrange(7, 40), start, r.choice([None, start + dt.timedelta(r.randrange(-5, 200))]), r.randrange(100)))
    months = [dt.date(2025, m, 1) for m in range(1, 13)]
    spine = spark.createDataFrame([(m,) for m in months], "month date")
    df = spark.createDataFrame(rows, "who int, start date, end date, fee int")
    want = []
    for m in months:
        last = (m + dt.timedelta(31)).replace(day=1) - dt.timedelta(1)
        alive = [x for x in rows if x[1] and x[1] <= last and (x[2] is None or x[2] >= last)]
        want.append((m, float(len({x[0] for x in alive if x[0] is not None})), float(sum(x[3] or 0 for x in alive))))
    distinct, total = kpis.alive_distinct(df, "who", "start", "end", spine), kpis.alive_total(df, "fee", "start", "end", spine)
    assert sorted((a.month, a.value, b.value) for a in distinct.collect() for b in total.collect() if a.month == b.month) == want
    assert "sequence" not in (distinct._jdf.queryExecution().toString() + total._jdf.queryExecution().toString())
    assert {x.value for x in kpis.alive_distinct(df.limit(0), "who", "start", "end", spine).collect()} == {0.0}
