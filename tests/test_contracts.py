import hashlib
import hmac

import pytest

from millrace.functions import identity, scalars
from millrace.operators import contracts, quality


def test_violations_and_whole_files(spark):
    rows = spark.createDataFrame([("a", 1, "T001"), ("a", 2, "T002"), ("b", 3, "x"), ("b", None, "T003"), ("c", 4, "T004"), ("c", 4, "T005")], "file string, n int, code string")
    contract = contracts.Contract(["file", "n", "code"], checks=[contracts.matches("code", r"^T\d{3}$"), contracts.at_least("n", 1)], unique=[["n"]])
    found = {tuple(r) for r in contracts.violations(rows, contract, ["file"]).collect()}
    assert found == {("b", "code", "str_matches", 1), ("b", "n", "not_nullable", 1), ("c", "n", "unique", 2)}
    kept, bad = contracts.split_files(rows, contract, "file")
    assert {r.file for r in kept.collect()} == {"a"}
    assert {(r.file, tuple(r.reasons)) for r in bad.collect()} == {("b", ("not_nullable on n", "str_matches on code")), ("c", ("unique on n",))}
    assert contracts.misfit_columns(rows.drop("n"), contract) == [("n", "column_in_dataframe")]
    assert contracts.violations(rows.limit(0), contract).count() == 0


def test_headers(spark):
    rows = spark.createDataFrame([(1, 2)], "` Ａ` int, b int")
    assert contracts.renamed_headers(rows, {"A": "first", "b": "b"}).columns == ["first", "b"]
    with pytest.raises(ValueError, match="unknown_column_name"):
        contracts.renamed_headers(rows, {"A": "first"})


def test_keys_in_order_of_preference(spark):
    rows = [("1", " X+tag@Ex.com", "+81 90-1234-5678", "やまだ"), ("2", None, "０９０１２３４５６７８", "ヤマ ダ"), ("3", "no", None, "ヤマダ"), ("4", None, None, None)]
    got = identity.with_keys(spark.createDataFrame(rows, "id string, e string, p string, k string"), "salt", "S", "id", "e", "p", "k").orderBy("id").collect()
    assert [r.key_method for r in got] == ["email", "phone", "source_local", "source_local"]
    assert got[0].member_key == hmac.new(b"salt", b"email:x@ex.com", hashlib.sha256).hexdigest()
    assert got[0].link_key == got[1].link_key == hmac.new(b"salt", "phone_kana:09012345678|ヤマダ".encode(), hashlib.sha256).hexdigest()
    assert got[3].link_key is None and len({r.household_key for r in got}) == 4


def test_scalars_and_nulls(spark):
    row = spark.createDataFrame([("a@b.c", "０９０-1234,5678", None)], "e string, p string, n string")
    got = row.select(scalars.email_domain("e"), scalars.phone_last4("p"), scalars.initial("n"), scalars.initial("e"), scalars.pseudonym("n", "D"), scalars.pseudonym("e", "D")).first()
    assert tuple(got) == ("b.c", "5678", None, "a***", None, hashlib.sha256(b"D:a@b.c").hexdigest())
    hashes = spark.createDataFrame([(None, ""), ("", None), ("", "")], "x string, y string").select(scalars.row_hash("x", "y")).distinct().count()
    assert hashes == 3


def test_quality(spark):
    rows = spark.createDataFrame([(1, "a@b.co"), (1, "c@d.co"), (None, None)], "k int, contact string")
    assert [tuple(r) for r in quality.not_unique(rows, ["k"]).collect()] == [(1, 2)]
    assert {r.column: r.level for r in quality.personal_columns(rows).collect()} == {"k": "none", "contact": "direct"}
    assert [tuple(r) for r in quality.without_parent(rows, "k", spark.range(1), "id").collect()] == [(1, 2)]
    versions = spark.createDataFrame([(1, 1, 2), (1, 2, None), (2, 1, 2), (2, 3, None), (3, 1, 2)], "k int, valid_from int, valid_to int")
    assert {r.k for r in quality.history_breaks(versions, ["k"]).collect()} == {2, 3}
    assert quality.scan_verdicts({"a": "direct", "b": "quasi", "c": "none"}, {"a": "quasi", "c": "odd"}) == {"a": "weaker", "b": "undeclared", "c": "invalid"}
