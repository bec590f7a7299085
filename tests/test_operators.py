"""Scenario fixtures: resolution, scores, upserts, purge, pages, streams."""

import collections
import datetime
import math
import random
import time

from pyspark.sql import functions as F

from tenderlake.functions import scalars as S
from tenderlake.operators import aggregate as A
from tenderlake.operators import resolve as R
from tenderlake.operators import score as M
from tenderlake.operators import upsert as U
from tenderlake.sources import html as H
from tenderlake.sources import io

COMPANIES = [(1, "PT. Maju Jaya", "9120 0000 1", "01.234.567.8-901.000"), (2, "CV Bersama", "912", "0823955182421000"), (3, "PT Ganda", "", "555555555555555"), (4, "PT Lain", "", "555555555555555")]


def resolved(spark, *rows):
    firms = spark.createDataFrame(COMPANIES, "id long, name string, nib string, npwp string")
    source = spark.createDataFrame(list(rows), "name string, npwp string, nib string")
    return [(r.status, r.company_id, r.candidate_ids) for r in R.resolve_entities(source.coalesce(1), firms).orderBy("name").collect()]


def test_resolution_cascade(spark):
    got = resolved(
        spark, ("a", "", "9120-00001"), ("b", "012345678901000", None), ("c", "555555555555555", ""), ("cv bersama", "08*3**5****21**0", ""), ("d CV Bersama", "08*3**5****21**0", ""),
        ("pt. maju jaya", "999", ""), ("q", "999", None),
    )
    assert got == [
        ("EXACT_OFFICIAL_IDENTIFIER", 1, [1]), ("EXACT_NPWP", 1, [1]), ("IDENTITY_CONFLICT", None, [3, 4]), ("EXACT_MATCH_NAME_MASKED_NPWP", 2, [2]), ("UNRESOLVED", None, []),
        ("CANDIDATE_ONLY", None, [1]), ("UNRESOLVED", None, []),
    ]


def test_weaker_result_keeps_link(spark):
    old = spark.createDataFrame([(1, 7, "EXACT_NPWP"), (2, None, "UNRESOLVED"), (3, 8, "EXACT_NPWP")], "k long, company_id long, status string")
    new = spark.createDataFrame([(1, None, "CANDIDATE_ONLY"), (2, 9, "EXACT_NPWP"), (3, 5, "EXACT_NPWP")], "k long, company_id long, status string")
    assert {r.k: (r.company_id, r.status) for r in R.apply_resolution(old, new, ["k"]).collect()} == {1: (7, "EXACT_NPWP"), 2: (9, "EXACT_NPWP"), 3: (5, "EXACT_NPWP")}


def scored(spark, hps=100, revenue=1000, days=14, fit=80, experience=1, complete=1, tahap="Upload Dokumen Penawaran"):
    end = (datetime.date(2026, 1, 1) + datetime.timedelta(days)).strftime("%d-%m-%Y") if days is not None else ""
    row = [(fit, hps, "62019", tahap, [("1", "Penawaran", "", end)], revenue, ["62019"], experience, complete)]
    df = spark.createDataFrame(row, "fit_score int, hps long, kbli_code string, tahap string, jadwal array<struct<no: string, tahap: string, mulai: string, sampai: string>>, penghasilan long, codes array<string>, experience long, complete long")
    return M.opportunity_score(df, F.lit("2026-01-01").cast("date")).first()


def test_financial_buckets(spark):
    assert [scored(spark, hps=h).financial_score for h in (100, 250, 500, 750, 1000, 1500, 2000)] == [100, 90, 75, 60, 40, 20, 0]


def test_deadline_buckets(spark):
    assert [scored(spark, days=d).deadline_score for d in (14, 7, 4, 2, 1, 0, -1)] == [100, 90, 80, 60, 35, 15, 0]


def test_experience_and_classes(spark):
    assert [scored(spark, experience=e, complete=c).experience_score for e, c in ((0, 0), (1, 0), (2, 1))] == [0, 60, 75]
    assert scored(spark, fit=100).classification == "PRIORITAS_TINGGI"


def test_missing_components_drop_out(spark):
    r = scored(spark, hps=0, days=None)
    assert (r.financial_score, r.deadline_score) == (0, 0)
    assert r.final_score == round((80 * 0.35 + 75 * 0.2 + 85 * 0.1) / 0.65)


def test_not_ready(spark):
    assert scored(spark, tahap="Evaluasi").status == "not_ready" and scored(spark, fit=None).final_score == 0


def matched(spark, codes=("62019",), sbu=True, nib="12345", quals=2, requirement="Memiliki KBLI 62019 dan SBU aktif serta sistem informasi komputer"):
    firm = M.company_words(spark.createDataFrame([(list(codes), sbu, False, nib, "123456789", quals, '{"klasifikasi_usaha": "sistem informasi"}')], "codes array<string>, has_sbu boolean, has_izin boolean, nib string, npwp string, qualifications long, text string"), "text")
    tender = M.tender_words(spark.createDataFrame([("62019", requirement)], "kbli_code string, requirement string"))
    return M.enforce_hard_gates(M.rule_match(tender.crossJoin(firm))).first()


def test_matching_gates(spark):
    assert matched(spark).status == "ELIGIBLE" and matched(spark).fit_score >= 50
    for bad in (matched(spark, codes=("41011",)), matched(spark, sbu=False)):
        assert bad.status == "NOT_ELIGIBLE" and bad.fit_score <= 25 and bad.blockers
    nothing = matched(spark, codes=(), sbu=False, nib="", quals=0)
    assert (nothing.status, nothing.criteria, nothing.summary, nothing.actions) == ("NOT_READY", [], "Profil kualifikasi perusahaan belum diisi.", ["Lengkapi profil kualifikasi perusahaan."])


def test_matching_criteria(spark):
    good = matched(spark, requirement="Memiliki KBLI 62019 dan SBU aktif. Pengalaman sistem informasi komputer. NPWP dan NIB")
    assert [(c.category, c.mandatory, c.status) for c in good.criteria] == [("KBLI", True, "pass"), ("SBU", True, "pass"), ("BUSINESS_LICENSE", True, "pass"), ("FINANCIAL", True, "pass"), ("TECHNICAL", False, "pass")]
    assert good.criteria[4].evidence == "Kesesuaian profil teknis: 2/4 istilah cocok." and good.summary == f"Memenuhi seluruh persyaratan kualifikasi tender (Skor Teknis: {good.fit_score}%)"
    bad = matched(spark, codes=("41011",), sbu=False)
    assert [(c.category, c.status, c.evidence) for c in bad.criteria[:2]] == [("KBLI", "fail", "KBLI perusahaan: 41011"), ("SBU", "fail", "Tidak ada dokumen SBU aktif.")] and bad.summary.startswith("Tidak memenuhi syarat mutlak — 2 kendala fatal: KBLI mismatch")
    other = matched(spark, codes=("41011",), requirement="Pengalaman membangun jembatan gantung panjang")
    assert [(c.category, c.status, c.action) for c in other.criteria] == [("KBLI", "fail", "Tambahkan KBLI 62019 pada profil perusahaan jika bidang usaha sesuai."), ("EXPERIENCE", "needs_action", "Perlu verifikasi dokumen pendukung sebelum penawaran")]


def test_no_history_is_null(spark):
    p = spark.createDataFrame([(1, 10)], "company_id long, tender_id long")
    w = spark.createDataFrame([(2, 11, 5)], "company_id long, tender_id long, winning_value long")
    got = {r.company_id: r for r in A.company_intelligence(p, w).collect()}
    assert got[1].wins is None and got[1].win_rate == 0 and got[2].participations is None and got[2].win_rate is None


def tender_rows(spark, *rows):
    return spark.createDataFrame(list(rows), "kode_instansi string, id_lelang string, nama_paket string, tahap string, lokasi string, scraped_at timestamp")


def test_upsert_is_idempotent(spark):
    at = datetime.datetime(2026, 1, 1)
    batch = tender_rows(spark, ("K", "1", "a", "x", "", at), ("K", "1", "b", "y", "L", at + datetime.timedelta(1)))
    once = U.upsert_tenders(batch.limit(0), batch)
    twice = U.upsert_tenders(once, batch)
    assert once.collect() == twice.collect() and once.count() == 1 and once.first().nama_paket == "b"


def test_upsert_modes(spark):
    at = datetime.datetime(2026, 1, 1)
    old, new = tender_rows(spark, ("K", "1", "a", "x", "L", at)), tender_rows(spark, ("K", "1", "", "y", "", at))
    get = lambda mode: tuple(U.upsert_tenders(old, new, mode).select("nama_paket", "tahap", "lokasi").first())
    assert get("overwrite") == ("", "y", "") and get("fill") == ("a", "y", "L") and get("recrawl") == ("", "y", "L") and get("stage1") == ("", "y", "L")


def test_submissions(spark):
    p = spark.createDataFrame([(1, 5, "PT A", "", "Gugur"), (1, 6, "PT B", "", ""), (1, 7, "PT C", "", "")], "tender_id long, company_id long, name string, npwp string, alasan string")
    w = spark.createDataFrame([(1, 6, "PT. B", "")], "tender_id long, company_id long, company_name string, npwp string")
    had = spark.createDataFrame([(1, 7, "menang"), (1, 5, "menang")], "tender_id long, company_id long, status string")
    assert {r.company_id: r.status for r in U.derive_submissions(p, w, had).collect()} == {5: "gagal", 6: "menang", 7: "menang"}


def test_purge_spares_submissions(spark):
    t = spark.createDataFrame([(1, "Tender Selesai", False), (2, "Selesai", False), (3, "Evaluasi", False)], "id long, tahap string, is_prakualifikasi boolean")
    s = spark.createDataFrame([(1, "menang")], "tender_id long, status string")
    assert {r.id: r.deleted for r in U.purge(t, s, "completed").collect()} == {1: False, 2: True, 3: False}
    assert {r.id: r.deleted for r in U.purge(t, s, "inactive").collect()} == {1: True, 2: True, 3: False}


PAGE = """<table><tr><td>Lokasi Pekerjaan</td><td>Kota A</td></tr><tr><td>Metode Pengadaan</td><td>Seleksi</td></tr><tr><td>Syarat Kualifikasi</td><td>SBU</td></tr></table>
<table><tr><td>1</td><td>Pengumuman</td><td>01-01-2026</td><td>05-01-2026</td><td>-</td></tr></table>
<table><tr><td>1</td><td>PT Maju</td><td>012345678901234</td><td>Tidak memenuhi ambang batas</td><td>80,5</td></tr></table>
<table><tr><td>Meta<table><tr><th>Nama Pemenang</th><th>Alamat</th><th>NPWP</th><th>Penawaran</th><th>Terkoreksi</th><th>Negosiasi</th></tr>
<tr><td>PT Menang</td><td>Jl</td><td>0*1</td><td>Rp 1</td><td>Rp 2</td><td>Rp 3</td></tr></table></td></tr></table>"""


def test_pages(spark):
    got = H.extract_pages(spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>teks</p>")], "page_id long, html string")).orderBy("page_id").collect()
    a = got[0]
    assert (a.lokasi, a.metode, a.jadwal[0].tahap, a.jadwal[0].sampai) == ("Kota A", "Seleksi", "Pengumuman", "05-01-2026")
    assert [(p.name, p.npwp, p.alasan, p.nilai) for p in a.peserta if p.name == "PT Maju"] == [("PT Maju", "012345678901234", "Tidak memenuhi ambang batas", "80,5")]
    assert (a.winner.company_name, a.winner.harga_negosiasi, a.winner.winning_value) == ("PT Menang", 3, 3)
    assert got[1].requirement_text == "" and got[2].requirement_text == "teks" and got[2].tahap == "tidak diketahui"


def test_page_rules():
    """Made-up pages for each rule of the parser."""
    row = lambda *cells, tag="td": "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
    table = lambda *rows: "<table>" + "".join(rows) + "</table>"
    page = H.parse_page(table(row("Lokasi", ""), row("Lokasi", "Kota  B", "Blok C"), row("Metode Pemilihan", "Tender"), row("Tahun Anggaran", "LAINNYA 2026")))
    assert (page["lokasi"], page["metode"], page["tahun"], page["satuan_kerja"]) == ("Kota B Blok C", "Tender", "2026", "")
    assert [x["tahap"] for x in H.parse_page(table(row("a", "Evaluasi", "1", "2"), row("", "", "1", "2"), row("1", "Kontrak", "3", "4", "x")))["jadwal"]] == ["Evaluasi", "Kontrak"]
    bidders = H.parse_page(table(row("1", "PT A", "01", "90", "91.5", "Gugur", "x" * 26), row("1.", "PT B", "02"), row("2", "", "03"), row("3", "PT C", "04", "keterangan lain", "Rp 5")))["peserta"]
    assert [(b["name"], b["alasan"], b["nilai"]) for b in bidders] == [("PT A", "Gugur; " + "x" * 26, "90"), ("PT C", "keterangan lain", "")]
    judged = H.parse_page(table(row("1", "PT A", "08*3**5****21**0", "77,5", "tidak lulus"), row("2", "PT B", "<i class='fa fa-times'></i>"), row("1", "Nama Peserta", "x"), row("3", "PT D", "012.345.678", tag="th")))["evaluasi"]
    assert [(b["name"], b["npwp"], b["alasan"], b["nilai"]) for b in judged] == [("PT A", "08*3**5****21**0", "tidak lulus", "77,5"), ("PT B", "", H.FAILED, ""), ("PT D", "012.345.678", "", "")]
    head = row("Nama Pemenang", "Alamat", "NPWP", "A", "B", "C", tag="th")
    won = lambda *cells: H.parse_page(table("<tr><td>meta" + table(head, row(*cells)) + "</td></tr>"))["winner"]
    assert won("PT A", "Jl", "1", "Rp. 855.800.811,31", "", "")["winning_value"] == 855800811 and won("PT A", "Jl", "1", "Rp 5", "Rp 4", "Rp 0")["winning_value"] == 4
    assert won("", "Jl", "1", "1", "2", "3") is None and won("PT A", "Jl", "1") is None and H.parse_page(table(head))["winner"] is None
    assert H.parse_page("<div><h3>Ketentuan</h3> Memiliki pengalaman sejenis</div>")["requirement_text"] == "Ketentuan Memiliki pengalaman sejenis"
    assert H.parse_page(table(row("nilai kontrak", "besar")))["requirement_text"] == "nilai kontrak | besar"
    assert H.parse_page("<p><b>Tahap Saat Ini</b>: Evaluasi Dokumen\nlain</p>")["tahap"] == "evaluasi dokumen" and H.parse_page(table(row("Tahap", "Kontrak")))["tahap"] == "kontrak"


def test_discovery_and_csv(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"kode_instansi": "K1", "data": [["12", "<b>Paket</b>", "Dinas", "aktif", "1,5 M", "", "", "", "Jasa", "7"], ["", "x", "y"], ["None", "x", "y"], ["9"]]}')
    rows = io.parse_discovery_row(io.read_discovery(spark, str(tmp_path / "a.json"))).collect()
    assert [(r.id_lelang, r.nama_paket, r.hps, r.peserta_count) for r in rows] == [("12", "Paket", 1_500_000_000, 7)]
    out = spark.createDataFrame([("K1", "12", True, datetime.datetime(2026, 1, 2, 3, 4, 5))], "kode_instansi string, id_lelang string, is_it_priority boolean, scraped_at timestamp")
    io.export_csv(out, str(tmp_path / "csv"), by_instansi=True)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["Waktu Ambil"].startswith("2026-01-02")
    io.write_table(out, str(tmp_path / "t"), ["kode_instansi"])
    assert io.read_table(spark, str(tmp_path / "t")).count() == 1


PAIR = "tender_id long, company_id long, hps long, kbli_code string, deadline date, is_it_priority boolean, is_prakualifikasi boolean, peserta_count int, metode string, ai_score int, codes array<string>, has_izin boolean, has_sbu boolean, has_sdm boolean, experience long, recent long, modal long, penghasilan long"


def test_legacy_score(spark):
    """By hand: a firm that has all, one without money or codes, and a tender alone."""
    at = datetime.date(2026, 1, 1)
    after = lambda n: at + datetime.timedelta(n)
    rows = [
        (1, 5, 1000, "62019", after(15), True, True, 5, "Select All", 90, ["62019"], True, True, True, 3, 3, 500, 0),
        (2, 6, 1000, "62019", after(3), False, False, 21, "best value", 41, [], False, False, False, 0, 0, 0, 0),
        (3, None, 0, "", None, False, False, None, None, None, None, None, None, None, None, None, None, None),
        (4, 7, 1000, "41011", after(0), False, False, 0, "Seleksi", 0, ["62019"], True, False, False, 0, 1, 0, 400),
    ]
    got = {r.tender_id: r for r in M.opportunity_score_legacy(spark.createDataFrame(rows, PAIR), F.lit("2026-01-01").cast("date")).collect()}
    parts = lambda i: tuple(got[i][f"{n}_score"] for n in ("qualification", "financial", "experience", "deadline", "strategic", "final"))
    assert parts(1) == (100, 95, 95, 95, 100, 97) and got[1].recommendation == "Sangat Direkomendasikan" and got[1].risks == []
    assert got[1].reason == "Tender ini cocok dengan profil perusahaan. Kualifikasi memadai. Kemampuan keuangan mencukupi. Pengalaman relevan tersedia." and got[1].strengths[0] == "KBLI 62019 sesuai" and "Modal mencukupi (50% dari HPS)" in got[1].strengths
    assert parts(2) == (0, 50, 20, 25, 40, 21) and got[2].risks[0] == "KBLI 62019 tidak sesuai" and got[2].reason.endswith(" Kualifikasi belum memadai.")
    assert parts(3) == (50, 50, 30, 60, 43, 46) and got[3].strengths == ["Belum ada peserta terdaftar"] and got[3].risks == []
    assert parts(4) == (12, 30, 70, 5, 38, 27) and got[4].risks[-1] == "Deadline sudah lewat" and "Penghasilan tidak mencukupi" in got[4].risks


def test_recommended_candidates(spark):
    """Priority first, then value; a company without codes gets qualification stages alone."""
    t = [(i, "Evaluasi Kualifikasi" if i % 2 else "Evaluasi", "62019" if i % 3 == 0 else "41011", i % 5, 100 + i) for i in range(1, 60)] + [(99, "Tender Selesai", "62019", 9, 9)]
    tenders = spark.createDataFrame(t, "tender_id long, tahap string, kbli_code string, priority_score int, hps long")
    firms = spark.createDataFrame([(1, ["62019"]), (2, [])], "company_id long, codes array<string>")
    got = M.recommended_candidates(tenders, firms, matching=4, others=3, without=5).collect()
    best = lambda rows, n: [x[0] for x in sorted(rows, key=lambda x: (-x[3], -x[4], x[0]))][:n]
    live = [x for x in t if x[0] != 99]
    place = lambda c, m: [r.tender_id for r in sorted(got, key=lambda r: r.place) if r.company_id == c and r.kbli_match == m]
    assert place(1, True) == best([x for x in live if x[2] == "62019"], 4) and place(1, False) == best([x for x in live if x[2] != "62019" and x[0] % 2], 3)
    assert place(2, True) == [] and place(2, False) == best([x for x in live if x[0] % 2], 5)


def test_delta_join_equals_all_pairs(spark):
    """Three rounds of random changes: pairs to make and matches to redo are those of the whole tables."""
    r = random.Random(6)
    quals = {c: [str(r.random())] for c in range(12)}
    firms, tenders = {c: r.random() < 0.8 for c in range(12)}, set(range(20))
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)

    def snapshot():
        q = frame(((k * 100 + c, c, n, "active" if n else "expired") for c, ns in quals.items() for k, n in enumerate(ns)), "id long, company_id long, number string, status string")
        f = frame(firms.items(), "company_id long, is_active boolean").join(M.qualification_fingerprint(q, ("number", "status")), "company_id", "left")
        return frame(((t,) for t in tenders), "id long"), f

    def key(f):
        return S.match_cache_key(F.col("tender_id"), F.col("company_id"), F.coalesce(f["fingerprint"], F.lit("")), "v")

    pairs = lambda rows: {(x.tender_id, x.company_id) for x in rows.collect()}
    no_match = frame([], "tender_id long, company_id long, cache_key string, fit_score int")
    t, f = snapshot()
    matches = {(a, b): (k, r.choice((0, 50))) for a, b, k in t.select(F.col("id").alias("tender_id")).crossJoin(f.where("is_active")).select("tender_id", "company_id", key(f)).collect()}
    jobs = set(matches)
    for _ in range(3):
        before = t, f
        tenders -= set(r.sample(sorted(tenders), 3))
        tenders |= {max(tenders) + n for n in range(1, 4)}
        quals[r.randrange(12)].append(str(r.random()))
        quals[r.randrange(12)] = []
        firms[r.randrange(12)] = r.random() < 0.5
        firms[max(firms) + 1] = True
        t, f = snapshot()
        delta = R.pair_delta(before[0], t, before[1], f)
        existing = frame(jobs, "tender_id long, company_id long")
        stored = frame(((a, b, k, n) for (a, b), (k, n) in matches.items()), no_match.schema)
        whole = t.select(F.col("id").alias("tender_id")).crossJoin(f.where("is_active"))
        assert pairs(R.new_candidates(delta, existing)) == pairs(R.candidate_pairs(t, f.withColumnRenamed("company_id", "id"), existing))
        redo = R.stale_delta(delta, t, f, stored, "v")
        assert pairs(redo) == pairs(R.stale_matches(whole.withColumn("cache_key", key(f)), stored)) and redo.count() == redo.distinct().count()
        assert pairs(delta) < pairs(whole)
        jobs |= pairs(R.new_candidates(delta, existing))
        matches |= {(x.tender_id, x.company_id): (x.cache_key, r.choice((0, 50))) for x in redo.collect()}


def test_fingerprint_follows_every_field(spark):
    base = {"id": 1, "company_id": 5, "category": "sbu", "name": "n", "number": "1", "kbli_code": "62019", "kbli_codes": ["62019"], "details": {"b": "1", "a": "2"}, "klasifikasi_usaha": "kecil", "value_amount": 1, "project_name": "p", "client_name": "c", "project_year": 2020, "valid_from": datetime.date(2020, 1, 1), "valid_until": None, "status": "active"}
    schema = "id long, company_id long, category string, name string, number string, kbli_code string, kbli_codes array<string>, details map<string,string>, klasifikasi_usaha string, value_amount long, project_name string, client_name string, project_year int, valid_from date, valid_until date, status string"
    changes = {"category": "sdm", "name": "m", "number": "2", "kbli_code": "x", "kbli_codes": [], "details": {"a": "1"}, "klasifikasi_usaha": "", "value_amount": 2, "project_name": "", "client_name": "", "project_year": 0, "valid_from": None, "valid_until": datetime.date(2027, 1, 1)}
    rows = [base] + [base | {"company_id": 10 + k, c: v} for k, (c, v) in enumerate(changes.items())] + [base | {"company_id": 6, "details": {"a": "2", "b": "1"}}, base | {"company_id": 7, "status": "expired"}]
    quals = spark.createDataFrame([tuple(x[c] for c in base) for x in rows], schema)
    found = {x.company_id: x.fingerprint for x in M.qualification_fingerprint(quals).collect()}
    assert found[5] == found[6] and 7 not in found and len(set(found.values())) == len(found) - 1 == len(changes) + 1
    text = {x.company_id: x.text for x in M.qualification_text(quals).collect()}[5]
    assert '"klasifikasi_usaha":"Kecil"' in text and '"category_raw":"sbu"' in text and '"category":"SBU (Sertifikat Badan Usaha)"' in text
    # a profile that only has staff meets the first category by the key alone
    only = spark.createDataFrame([tuple((base | {"category": "sdm", "name": "", "klasifikasi_usaha": ""})[c] for c in base)], schema)
    tokens = M.qualification_text(only).select(S.tokenize(F.col("text")).alias("t"))
    assert tokens.select(M.category_hits(F.col("t"))[0]).first()[0] > 0


def plain_best(left, right):
    """(left id, right id, cosine) by loops over all pairs."""
    docs = [(0, i, t) for i, t in left if t] + [(1, i, t) for i, t in right if t]
    df = collections.Counter(w for _, _, t in docs for w in set(t))
    vectors = {}
    for side, i, t in docs:
        v = {w: n / len(t) * math.log(len(docs) / df[w]) for w, n in collections.Counter(t).items() if df[w] < len(docs)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[side, i] = {w: x / norm for w, x in v.items()}
    out = {}
    for i, _ in left:
        dots = [(-round(sum(x * vectors[1, j].get(w, 0) for w, x in vectors.get((0, i), {}).items()), 9), j) for j, t in right if (1, j) in vectors]
        best = min(dots, default=(0, None))
        if best[0] < 0:
            out[i] = (best[1], -best[0])
    return out


def test_best_cosine_matches_all_pairs(spark):
    r = random.Random(9)
    word = lambda: f"w{int(r.paretovariate(0.7)) % 60}"
    left, right = ([(k, [word() for _ in range(r.randint(0, 12))] + ["all"]) for k in range(n)] for n in (40, 150))
    right += [(200 + k, right[k][1]) for k in range(20)] + [(300, []), (301, ["lone"])]  # copies: the smaller id counts
    left += [(100, []), (101, ["nowhere"])]
    schema = "id long, tokens array<string>"
    for block in (10_000, 7):
        got = {x.left_id: (x.right_id, x.cosine) for x in M.tfidf_best(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), block).collect()}
        want = plain_best(left, right)
        assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 2e-9 for i in want)
    assert M.tfidf_best(spark.createDataFrame([], schema), spark.createDataFrame(right, schema)).count() == 0


def test_cosines_of_all_pairs_without_a_join_of_words(spark):
    """Words of documents and products of postings were shuffled; equal words with line feeds, in parts of few words and blocks of few documents."""
    r = random.Random(4)
    rows = lambda n: [(k, [r.choice("abcdefgh") + r.choice(["", "\n", "x\ny"]) for _ in range(r.randint(0, 9))]) for k in range(n)]
    left, right, schema = rows(12), rows(60), "id long, tokens array<string>"
    frames = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    docs = [set(t) for _, t in left + right if t]
    df = collections.Counter(w for t in docs for w in t)
    vectors = lambda rows: {i: {w: n / len(t) * math.log(len(docs) / df[w]) for w, n in collections.Counter(t).items()} for i, t in rows}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    a, b = vectors(left), vectors(right)
    want = {(i, j): sum(x * v[w] for w, x in u.items() if w in v) / norm(u) / norm(v) for i, u in a.items() for j, v in b.items() if u.keys() & v.keys()}
    for got in (M.tfidf_cosine(*frames), M._cosines(*frames, block=5, part_words=40)):
        assert {(x.left_id, x.right_id): round(x.cosine, 9) for x in got.collect()} == {k: round(x, 9) for k, x in want.items()}
    assert "Join" not in M.tfidf_cosine(*frames)._jdf.queryExecution().executedPlan().toString()


def test_stored_scores(spark):
    schema = "tender_id long, company_id long, tahap string, fit_score int, hps long, penghasilan long, kbli_code string, codes array<string>, experience long, complete long, deadline date, summary string"
    at = datetime.date(2026, 1, 1)
    rows = [(1, 1, "Pengumuman Prakualifikasi", 95, 100, 400, "62019", ["62019"], 1, 1, at + datetime.timedelta(5), "baik"), (2, 1, "Pengumuman Prakualifikasi", 40, 0, 400, "", [], 0, 0, None, None), (3, 1, "Tender Selesai", 90, 1, 1, "", [], 0, 0, at, ""), (4, 1, "Pengumuman Prakualifikasi", None, 1, 1, "", [], 0, 0, at, ""), (5, 1, "Tender Selesai", 90, 1, 1, "", [], 0, 0, at, "")]
    scored = M.opportunity_score(spark.createDataFrame(rows, schema), F.lit(at)).withColumn("days_left", F.datediff("deadline", F.lit(at)))
    first = M.stored_scores(scored)
    had = first.where("tender_id = 3").withColumn("final_score", F.lit(88)).unionByName(first.where("tender_id = 1").withColumn("final_score", F.lit(1)))
    got = {r.tender_id: r for r in M.stored_scores(scored, had).collect()}
    b = got[1].breakdown
    assert (b.components.financial.score, b.components.financial.available, b.components.deadline.weight_pct, b.kbli_match) == (90, True, 15, True) and got[1].final_score > 1
    assert b.explanation == ["Qualification: 95", "baik", "Financial: 90", "Nilai HPS berada pada kisaran 25% dari penghasilan tahunan perusahaan.", "Experience: 75", "Terdapat 1 pengalaman kerja aktif dengan data proyek yang lengkap.", "Deadline: 80", "Tersisa 5 hari sebelum deadline — mulai siapkan.", "Strategic: 100", "Tender memiliki alignment tinggi dengan qualification perusahaan."]
    b = got[2].breakdown
    assert not b.components.financial.available and not b.deadline_available and b.explanation[2:4] == ["Financial: NOT AVAILABLE", "Data HPS atau penghasilan tahunan tidak tersedia."]
    assert got[3].final_score == 88 and got[4].breakdown.message.startswith("Analisis AI belum") and got[4].classification == got[5].classification == "TIDAK_DIREKOMENDASIKAN" and got[5].breakdown.message.startswith("Tender tidak")


def test_purge_counts_come_with_the_write(spark, tmp_path):
    tenders = spark.createDataFrame([(1, "Tender Selesai", False), (2, "Tender Selesai", False), (3, "Evaluasi", True)], "id long, tahap string, is_prakualifikasi boolean")
    submissions = spark.createDataFrame([(2, 1, "menang")], "tender_id long, company_id long, status string")
    rows, counts = U.purged(tenders, submissions, "completed")
    rows.write.parquet(str(tmp_path / "out"))
    assert counts.get == {"total": 3, "kept": 2, "deleted": 1, "spared": 1}


def test_deep_page_in_linear_time():
    """Elements within elements, each of which holds the headings: their texts aren't put together anew."""
    depth = 900
    page = "<body>" + "<div>" * depth + "<b>Persyaratan</b> tahap saat ini: Evaluasi\n" + "isi " * 500_000 + "</div>" * depth + "</body>"
    began = time.time()
    found = H.parse_page(page)
    assert time.time() - began < 5 and found["tahap"] == "evaluasi" and found["requirement_text"].startswith("Persyaratan tahap saat ini")


def test_pages_are_dealt_by_bytes(spark):
    """A large page among small ones: parts of equal bytes, the small ones not behind it; the rows are the same."""
    rows = [(i, "x" * (200 + i % 300)) for i in range(8000)] + [(9000, "y" * (8 << 20)), (9001, None), (9002, "")]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    dealt = H.balanced(pages, megabytes=1).withColumn("part", F.spark_partition_id())
    sizes = {r.part: (r.n, r.bytes) for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("bytes")).collect()}
    large = max(sizes.values(), key=lambda x: x[1])
    assert large == (1, 8 << 20) and sum(n for n, _ in sizes.values()) == len(rows)
    assert all(size < 3 << 20 for n, size in sizes.values() if n > 1)
    assert H.balanced(pages.limit(0)).count() == 0
    assert sorted(map(tuple, H.balanced(pages, megabytes=1).collect()), key=repr) == sorted(rows, key=repr)


def test_jdbc_ranges_follow_the_keys(spark):
    """Clustered and sparse ids with gaps, negative ones and none: ranges of like size that hold every row once."""
    url = "jdbc:derby:memory:tenders;create=true"
    keys = [*range(1000), *(10**12 + 7 * k for k in range(500)), -5, -(10**9), *(5 * 10**11 + k for k in range(500))]
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(k, f"n{k}") for k in keys] + [(None, "none")], "id long, name string")
    rows.write.jdbc(url, "tenders", properties=options)
    got = io.read_table(spark, url, "tenders", partitions=8, **options)
    assert sorted(r.name for r in got.collect()) == sorted(r.name for r in rows.collect())
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert 8 <= len(sizes) <= 16 and max(sizes) <= 2 * -(-len(keys) // 8)
    spark.createDataFrame([], "id long, name string").write.jdbc(url, "empty_one", properties=options)
    assert io.read_table(spark, url, "empty_one", **options).count() == 0


def scanned(df):
    """Rows that the scan gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_tenant_reads_skip_row_groups(spark, tmp_path):
    rows = spark.range(200_000).select((F.col("id") % 2000 * 3).alias("company_id"), F.col("id").alias("tender_id"), F.sha2(F.col("id").cast("string"), 256).alias("note"), (F.col("id") % 2).cast("string").alias("year"))
    io.write_table(rows, str(tmp_path / "t"), ["year"], "company_id", partitions=4, **{"parquet.block.size": str(1 << 18), "parquet.page.row.count.limit": "2000"})
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.count() == 200_000
    mine = table.where("company_id = 300")
    assert mine.count() == 100 and scanned(table.where("company_id = 300").select("tender_id", "note")) < 40_000
    absent = table.where("company_id = 301").select("tender_id", "note")  # within the range of values, but of no row
    assert absent.count() == 0 and scanned(table.where("company_id = 301").select("tender_id", "note")) < 20_000


def test_bidder_and_winner_pages():
    """Pages as portals show them: rows without a name, cells of either tag, no table, no page, nested tables, prices left out."""
    bids = lambda *rows: "<table><tr><th>No</th><th>Nama</th><th>NPWP</th></tr>" + "".join(f"<tr><td>{n}</td><td>{name or ''}</td><td>{tax}</td></tr>" for n, name, tax in rows) + "</table>"
    named = lambda html: [(b["name"], b["npwp"]) for b in H.parse_page(html)["peserta"]]
    assert named(bids((1, "PT Satu", "111222333444555"), (2, "CV Dua", ""), (3, None, "999"))) == [("PT Satu", "111222333444555"), ("CV Dua", "")]
    for empty in ("<table></table>", "<<< no page", "", None):
        page = H.parse_page(empty)
        assert page["peserta"] == page["evaluasi"] == page["jadwal"] == [] and page["winner"] is None
    row = "<tr><td>{}</td><td>{}</td><th>{}</th><td><i class='fa fa-close'></i></td><th style='text-align:right'>{}</th><td>{}</td></tr>"
    judged = "<table><tr><th>No</th><th>Nama Peserta</th><th>NPWP</th><th>Lulus</th><th>Nilai</th><th>Alasan</th></tr>" + row.format(1, "PT Tiga", "01*2**3****45*6", "61,5", "Tidak lulus unsur pengalaman") + row.format(2, "PT Empat", "09*8**7****65*4", "100,0", "") + "</table>"
    assert [(b["name"], b["npwp"], b["nilai"], b["alasan"]) for b in H.parse_page(judged)["evaluasi"]] == [("PT Tiga", "01*2**3****45*6", "61,5", "Tidak lulus unsur pengalaman"), ("PT Empat", "09*8**7****65*4", "100,0", H.FAILED)]
    head = "<tr>" + "".join(f"<th>{x}</th>" for x in ("Nama Pemenang", "Alamat", "NPWP", "Harga Penawaran", "Harga Terkoreksi", "Harga Negosiasi")) + "</tr>"
    data = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    page = lambda *rows: "<table><tr><th>Pagu</th><td>Rp. 900.000,00</td></tr><tr><td colspan='2'><table>" + head + "".join(rows) + "</table></td></tr></table>"
    won = H.parse_page(page(data("CV Lima", "Jl. A - B", "00*1", "Rp. 855.800.811,31", "Rp. 855.800.811,31", "Rp. 855.301.311,32"), data("PT Enam", "", "", "Rp. 1,00", "", "")))["winner"]
    assert (won["company_name"], won["harga_penawaran"], won["harga_negosiasi"], won["winning_value"]) == ("CV Lima", 855800811, 855301311, 855301311)
    bare = H.parse_page(page(data("CV Lima", "Jl", "1", "", "", "")))["winner"]
    assert bare["company_name"] == "CV Lima" and bare["winning_value"] is None and H.parse_page(page(data("", "", "", "", "", "")))["winner"] is None


def test_captured_pages_get_their_kind(spark, tmp_path):
    urls = ["https://p.example/k/lelang/1/pengumumanlelang", "https://p.example/k/lelang/1/jadwal?x=1", "https://p.example/k/lelang/1/peserta", "https://p.example/k/evaluasi/1/hasil#top", "https://p.example/k/evaluasi/1/pemenang/", "https://p.example/jadwalx", None]
    spark.createDataFrame([(u, "<p/>") for u in urls], "url string, html string").write.parquet(str(tmp_path / "pages"))
    got = {r.url: r.kind for r in io.read_pages(spark, str(tmp_path / "pages")).collect()}
    assert [got[u] for u in urls] == ["pengumuman", "jadwal", "peserta", "hasil", "pemenang", "", ""]


def test_no_pair_of_candidates_is_shuffled(spark):
    """Pairs were dealt by tender and company to be held against jobs. Null and repeated ids are kept as they were."""
    tenders, firms = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "id long"), spark.createDataFrame([(7, True), (8, True), (9, False), (None, True)], "id long, is_active boolean")
    jobs = spark.createDataFrame([(1, 7), (1, 7), (2, 8), (2, None), (None, 8), (5, 8)], "tender_id long, company_id long")
    got = R.candidate_pairs(tenders, firms, jobs)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 8), (1, None), (2, 7), (2, 7), (2, None), (2, None), (3, 7), (3, 8), (3, None), (None, 7), (None, 8), (None, None)], key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = R.candidate_pairs(tenders, firms, jobs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" in plan and not any("Exchange" in line and "company_id" in line.split("hashpartitioning(")[-1].split(")")[0] for line in plan.splitlines())


def test_plain_markup_reads_as_by_the_parser(spark, monkeypatch):
    """Random markup, plain or not, gives the same elements either way, and a page of wanted fields those fields."""
    r = random.Random(6)
    said = ["<tr>", "</tr>", "<TD>", "</td>", "<td class='A b'>", "<th\tid=\"x\" class=\"\" >", "</th >", "<table>", "</table>", "<br>", "<p>", "</P>", "<li>", "<i title='y class=\"z\"' class='fa fa-times'>", "</i>", "1", "PT Satu", " a > b ", "\n", "Nama Pemenang", "Tahap Saat Ini", "77,5", "\u0130"]
    odd = ["&amp;", "<br/>", "<!-- <td> -->", "<script>a < '<td>'</script>", "<title><b>x</title>", "<a href=x>", "< td>", "<", "</>", "<td", "<x-y>", "<b\x0bid='1'>", "<td class='a' class='b'>", "<td hidden>"]
    pages = ["".join(r.choice(said + odd * (k % 2)) for _ in range(r.randint(0, 60))) for k in range(600)]
    state = lambda page: (page.tags, page.classes, page.parent, page.last, [page.bounds(n) for n in range(len(page.tags))], page.whole)
    read = [(state(H._Page(x)), H.parse_page(x)) for x in pages]
    assert sum(H._Page("")._plain(x) for x in pages) >= 300
    assert all(H.parse_page(x, (f,)).items() <= whole.items() and f in H.parse_page(x, (f,)) for x, (_, whole) in zip(pages, read) for f in whole)
    rows = spark.createDataFrame(list(enumerate(pages[:20])), "page_id long, html string")
    assert H.extract_pages(rows, wanted=("jadwal",)).columns == ["page_id", "jadwal"] and "regexp" not in H.extract_pages(rows, wanted=("jadwal",))._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(H._Page, "_plain", lambda self, html: False)
    assert read == [(state(H._Page(x)), H.parse_page(x)) for x in pages]
