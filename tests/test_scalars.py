"""Boundary tables of the scalar functions and predicates."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from tenderlake.functions import predicates as P
from tenderlake.functions import scalars as S


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in (values or {"_": 1}).items()))
    return row.select(column.alias("out")).first()[0]


@pytest.mark.parametrize("text, value", [("660,9 M", 660_900_000_000), ("1,5 Miliar", 1_500_000_000), ("2 jt", 2_000_000), ("7 Rb", 7_000), ("1.234", 1234), ("Rp. 123.456,00", 12345600), ("", 0), ("None", 0), ("abc", 0), (None, 0)])
def test_hps(spark, text, value):
    assert one(spark, S.parse_hps(F.col("c")), c=text) == value


def test_hps_without_quirk(spark):
    assert one(spark, S.parse_hps(F.col("c"), rp_compat=False), c="Rp. 123.456,00") == 123456


@pytest.mark.parametrize("text, value", [("Rp. 855.800.811,31", 855800811), ("1.234.567", 1234567), ("Rp. abc", None), ("", None)])
def test_money(spark, text, value):
    assert one(spark, S.parse_money(F.col("c")), c=text) == value


@pytest.mark.parametrize("text, value", [("05-03-2026", (2026, 3, 5)), ("2026-3-5", (2026, 3, 5)), ("5/3/2026", (2026, 3, 5)), ("5 Mar 2026", (2026, 3, 5)), ("5 March 2026", (2026, 3, 5)), ("31-02-2026", None), ("5 Maret 2026", None), ("05-03-2026 10:00", None), (None, None)])
def test_dates(spark, text, value):
    assert one(spark, S.parse_tender_date(F.col("c")), c=text) == (datetime.date(*value) if value else None)


@pytest.mark.parametrize("text, value", [("01.234.567.8-901.000", "012345678901000"), ("00*5**7****42**0", None), ("12ABC", None), ("", None), (None, None)])
def test_npwp(spark, text, value):
    assert one(spark, S.normalize_npwp(F.col("c")), c=text) == value


@pytest.mark.parametrize("masked, fits", [("08*3**5****21**0", True), ("09*3**5****21**0", False), ("8*3**5****21**0", True), ("08****************", False), ("0823955182421000", False)])
def test_masked_npwp(spark, masked, fits):
    assert one(spark, S.matches_masked_npwp(F.col("m"), F.col("f")), m=masked, f="0823955182421000") is fits


@pytest.mark.parametrize("text, value", [("PT. KHATULISTIWA NUSANTARA INDONESIA", "khatulistiwa nusantara indonesia"), ("CV. MAJU BERSAMA, TBK", "maju bersama"), ("PT. Telkom Indonesia (Persero)", "telkom indonesia"), ("P.T. Étion", "étion"), (None, "")])
def test_company_name(spark, text, value):
    assert one(spark, S.normalize_company_name(F.col("c")), c=text) == value


@pytest.mark.parametrize("text, value", [("", "(empty)"), ("1234", "****"), ("123456", "12****56")])
def test_mask(spark, text, value):
    assert one(spark, S.mask_identifier(F.col("c")), c=text) == value


@pytest.mark.parametrize("hps, key, short", [(10_000_000_000, "gt10m", "10 M"), (9_999_999_999, "5m_10m", "10.0 M"), (500_000_000, "500j_1m", "500 Jt"), (199_999_999, "lt200j", "200.0 Jt"), (1_500, "lt200j", "2 Rb"), (7, "lt200j", "7")])
def test_hps_ranges(spark, hps, key, short):
    assert one(spark, S.hps_bucket(F.col("h")), h=hps) == key
    assert one(spark, S.format_hps_short(F.col("h").cast("long")), h=hps) == short


@pytest.mark.parametrize("days, value", [(-1, "overdue"), (0, "urgent"), (3, "urgent"), (4, "warning"), (7, "warning"), (8, "")])
def test_urgency(spark, days, value):
    assert one(spark, S.urgency(F.col("d")), d=days) == value


def schedule(spark, *entries):
    return spark.createDataFrame([([dict(zip(("no", "tahap", "mulai", "sampai"), e)) for e in entries],)], "jadwal array<struct<no: string, tahap: string, mulai: string, sampai: string>>")


def test_deadline_tiers(spark):
    rows = schedule(spark, ("1", "Pembuktian Kualifikasi", "", "01-01-2026"), ("2", "Upload Penawaran", "", "05-01-2026"), ("3", "Kirim Penawaran", "", "05-01-2026"), ("4", "Kontrak", "01-03-2026", ""))
    assert rows.select(S.submission_deadline(F.col("jadwal"))).first()[0] == (datetime.date(2026, 1, 5), "Upload Penawaran")
    assert rows.select(S.deadline_first_match(F.col("jadwal"))).first()[0] == datetime.date(2026, 1, 1)
    assert rows.select(S.deadline_latest(F.col("jadwal"))).first()[0] == datetime.date(2026, 3, 1)


def test_deadline_of_nothing(spark):
    assert schedule(spark).select(S.submission_deadline(F.col("jadwal"))["date"]).first()[0] is None


@pytest.mark.parametrize("tahap, good", [("Pengumuman  Prakualifikasi [...]", True), ("Upload Dokumen Penawaran", True), ("Evaluasi Dokumen Kualifikasi", False), ("Tender Batal", False), ("", False), (None, False)])
def test_submittable(spark, tahap, good):
    assert one(spark, P.is_submittable(F.col("t")), t=tahap) is good


@pytest.mark.parametrize("tahap, name", [("Tender Selesai", "aborted"), ("Penetapan Pemenang", "retained"), ("Evaluasi", "eligible"), ("x", "unknown"), (None, "unknown")])
def test_stage_class(spark, tahap, name):
    assert one(spark, P.stage_class(F.col("t")), t=tahap) == name


@pytest.mark.parametrize("kbli, name, want", [("62019", "", (True, 100, ["62019"])), ("", "Pemasangan Fiber Optik Gedung", (True, 80, ["fiber optik"])), ("", "Pembangunan Gedung", (False, 0, ["gedung"])), ("", "Jasa", (False, 0, [])), ("", "SOCial", (False, 0, []))])
def test_it_priority(spark, kbli, name, want):
    found = one(spark, S.it_priority(F.col("k"), F.col("n"), F.array().cast("array<string>")), k=kbli, n=name)
    assert (found.is_it, found.score, found.keywords) == want


@pytest.mark.parametrize("html, code", [("<td>KBLI : 62.01.9</td>", "62019"), ("code 62029 then sbu", "62029"), ("<p>62090</p>", "62090"), ("<p>12345</p>", ""), (None, ""), ("<p>62090</p> bidang KBLI jasa 62019", "62019"), ("<p>62090</p> bidang KBLI jasa dan lain lain yang jauh dari sini 62019", "62090"), ("sbu x sbu 62029", "62029")])
def test_kbli(spark, html, code):
    assert one(spark, S.extract_kbli_code(F.col("h")), h=html) == code


def test_kbli_of_long_pages(spark):
    """Looking back from every character took 33 seconds for this one."""
    pages = spark.range(1).select(F.concat(F.lit("62019 "), F.repeat(F.lit("teks biasa "), 100_000), F.lit("62029 sbu"), F.repeat(F.lit(" x"), 300), F.lit("62090")).alias("h"))
    began = time.monotonic()
    assert pages.select(S.extract_kbli_code(F.col("h"))).first()[0] == "62029"
    assert time.monotonic() - began < 15


def test_tahap_of_page(spark):
    assert one(spark, S.extract_tahap(F.col("h")), h='Tahap Tender Saat Ini: <b> Evaluasi </b>') == "evaluasi"


def test_tokens(spark):
    assert one(spark, S.tokenize(F.col("c")), c="Étion dan KBLI-62 a b, étion") == ["étion", "kbli", "62", "étion"]


@pytest.mark.parametrize("cell, amount", [("Rp 855.800.811,31 (lima)", 855800811), ("1.234", 1234), ("1,5,6", None), (".", None), ("abc 1", None), ("", None), (None, None)])
def test_money_is_the_leading_number(spark, cell, amount):
    assert one(spark, S.parse_money(F.col("h")), h=cell) == amount


GOOD = '{"fit_score": 81.9, "eligibility_status": "eligible", "mandatory_passed": 0, "blockers": ["a", "", null, 3], "summary": null, "criteria": [{"requirement": " SBU ", "category": "sbu", "mandatory": true, "status": "pass", "evidence": "x", "action": null}, {"requirement": ""}, 5]}'


@pytest.mark.parametrize(
    "raw, status, passed, score, blockers, criteria",
    [
        (GOOD, "ELIGIBLE", False, 81, ["a", "3"], [("SBU", "SBU", True, "pass", "x", None)]),
        ("```json\n" + GOOD + "\n```  ", "ELIGIBLE", False, 81, ["a", "3"], [("SBU", "SBU", True, "pass", "x", None)]),
        ("```\n" + GOOD, "ELIGIBLE", False, 81, ["a", "3"], [("SBU", "SBU", True, "pass", "x", None)]),
        ("Hasil: " + GOOD + " demikian", "ELIGIBLE", False, 81, ["a", "3"], [("SBU", "SBU", True, "pass", "x", None)]),
        ('{"fit_score": 170}', "ELIGIBLE", True, 100, [], []),
        ('{"fit_score": -5, "eligibility_status": "unsure"}', "CONDITIONALLY_ELIGIBLE", True, 0, [], []),
        ('{"eligibility_status": "NOT_ELIGIBLE"}', "NOT_ELIGIBLE", False, 0, [], []),
        ('{"fit_score": "many"}', "NOT_READY", False, 0, ["Gagal mem-parse respons AI."], []),
        ("[1, 2]", "NOT_READY", False, 0, ["Gagal mem-parse respons AI."], []),
        ("```", "NOT_READY", False, 0, ["Gagal mem-parse respons AI."], []),
        ("no json", "NOT_READY", False, 0, ["Gagal mem-parse respons AI."], []),
        ("", "NOT_READY", False, 0, ["Gagal mem-parse respons AI."], []),
        (None, "NOT_READY", False, 0, ["Gagal mem-parse respons AI."], []),
    ],
)
def test_match_response(spark, raw, status, passed, score, blockers, criteria):
    r = one(spark, S.validate_match_response(F.col("h")), h=raw)
    assert (r.eligibility_status, r.mandatory_passed, r.fit_score, r.blockers, [tuple(c) for c in r.criteria]) == (status, passed, score, blockers, criteria)


def test_match_response_is_parsed_once(spark):
    """The reply stood in the plan once for each place that needs a part of it, and was parsed over and over."""
    rows = spark.createDataFrame([('{"fit_score": 71, "criteria": [{"requirement": " a ", "mandatory": 1}, {}, [], "{"], "mandatory_passed": 0}',), ('{"fit_score": null}',), ("{}",), ("[]",), ('"{"',), ("x {\"a\": {}} y",), ("```\n{\"fit_score\": -5}",)], "h string")
    found = rows.select(S.validate_match_response(F.col("h")).alias("s"))
    plan = rows.select(S.validate_match_response(F.concat("h", F.lit("<here>"))).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<here>") == 1
    assert [(x.s.eligibility_status, x.s.mandatory_passed, x.s.fit_score, [c.requirement for c in x.s.criteria]) for x in found.collect()] == [
        ("ELIGIBLE", False, 71, ["a"]), ("CONDITIONALLY_ELIGIBLE", True, 0, []), ("CONDITIONALLY_ELIGIBLE", True, 0, []), ("NOT_READY", False, 0, []), ("NOT_READY", False, 0, []), ("CONDITIONALLY_ELIGIBLE", True, 0, []), ("CONDITIONALLY_ELIGIBLE", True, 0, []),
    ]
