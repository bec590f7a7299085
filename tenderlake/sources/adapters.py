"""Domain tables as projections of the given star schema, with the same tables in SQL for comparison.

``VIEWS`` holds, for every table, SQL that DuckDB runs on the same Parquet files; integers and strings are exact in both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STAGES = (
    "Pengumuman Prakualifikasi", "Download Dokumen Pemilihan", "Pemberian Penjelasan [...]", "Upload Dokumen Penawaran", "Evaluasi Administrasi",
    "Pembuktian Kualifikasi", "Masa Sanggah", "Penetapan Pemenang", "Penandatanganan Kontrak", "Tender Selesai", "Tender Batal", "Kirim Persyaratan  Kualifikasi",
)
PACKAGES = (
    "Pengembangan Sistem Informasi Manajemen", "Pembangunan Jalan Raya", "Pengadaan Server dan Cloud", "Jasa Konsultansi Umum", "Pemasangan Fiber Optik Gedung",
    "Pengadaan Kendaraan Dinas", "Sewa Bandwidth Internet", "Pemeliharaan Taman",
)
KINDS = ("Pekerjaan Konstruksi", "Jasa Konsultansi", "Pengadaan Barang", "Jasa Lainnya")
CODES = ("62019", "62090", "41011", "62029", "")
NEEDS = (
    "Peserta memiliki KBLI 62019 dan SBU aktif. Pengalaman sistem informasi komputer minimal satu proyek.",
    "Memiliki NIB dan NPWP yang berlaku. Tenaga ahli jaringan bersertifikat tersedia untuk pekerjaan ini.",
    "Penyedia memiliki izin usaha. Laporan keuangan dan modal kerja mencukupi nilai pekerjaan.",
    "",
)
AS_OF = "1996-07-01"


def pick(values, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _sql_pick(values, n: str) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + f"][CAST({n} % {len(values)} AS INTEGER) + 1]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    on = lambda days: F.date_format(F.date_add(day, days), "dd-MM-yyyy")
    stage = lambda no, name, a, b: F.struct(F.lit(no).alias("no"), F.lit(name).alias("tahap"), on(a).alias("mulai"), on(b).alias("sampai"))
    from tenderlake.functions import scalars
    from tenderlake.functions.predicates import is_prakualifikasi

    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = joined.select(
        k.alias("id"), F.concat(F.lit("K"), F.col("n_nationkey").cast("string")).alias("kode_instansi"), k.cast("string").alias("id_lelang"),
        pick(PACKAGES, k).alias("nama_paket"), F.col("n_name").alias("instansi"), F.col("c_name").alias("satuan_kerja"),
        (F.round(F.col("o_totalprice") * 100).cast("long") * 100).alias("hps"), pick(STAGES, k).alias("tahap"), pick(KINDS, F.floor(k / 3)).alias("jenis"),
        pick(CODES, k).alias("kbli_code"), pick(NEEDS, F.floor(k / 2)).alias("requirement_text"), F.when(k % 6 == 0, F.lit("Syarat umum penyedia barang dan jasa")).otherwise("").alias("syarat"),
        F.concat(F.lit("Kota "), (F.col("o_custkey") % 50).cast("string")).alias("lokasi"), (k % 31).cast("int").alias("peserta_count"), (k % 101).cast("int").alias("ai_score"),
        F.when(k % 4 != 0, F.array(stage("1", "Pengumuman Prakualifikasi", 0, 5), stage("2", "Upload Dokumen Penawaran", 6, 30), stage("3", "Penandatanganan Kontrak", 40, 60))).otherwise(
            F.array(stage("1", "Penjelasan", 0, 5), stage("2", "Pembuktian Kualifikasi", 6, 20), stage("3", "Kontrak", 40, 60))).alias("jadwal"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("scraped_at"),
    )
    codes = F.array(*map(F.lit, CODES[:2] + CODES[3:4]))
    found = scalars.it_priority(F.col("kbli_code"), F.col("nama_paket"), codes)
    return rows.withColumn("is_prakualifikasi", is_prakualifikasi(F.col("tahap"))).withColumn("_it", found).select(*rows.columns, "is_prakualifikasi", F.col("_it.is_it").alias("is_it_priority"), F.col("_it.score").alias("priority_score"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th shares its predecessor's NIB, every 40th its NPWP."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("id"), F.concat(F.lit("PT. "), F.col("s_name")).alias("name"), F.lpad((k - F.when((k > 0) & (k % 50 == 0), 1).otherwise(0)).cast("string"), 13, "0").alias("nib"),
        F.concat(F.lit("0"), F.lpad((k - F.when((k > 0) & (k % 40 == 0), 1).otherwise(0)).cast("string"), 14, "0")).alias("npwp"),
        (F.round(F.col("s_acctbal") * 100).cast("long") * 10_000).alias("modal"), (F.round(F.col("s_acctbal") * 100).cast("long") * 50_000).alias("penghasilan"), (k % 7 != 0).alias("is_active"),
        F.when(k % 3 != 0, F.concat(F.lit("Jl. Raya "), k.cast("string"))).otherwise("").alias("address"), F.when(k % 4 != 0, F.concat(F.lit("021-"), k.cast("string"))).otherwise("").alias("phone"),
        F.when(k % 5 != 0, F.concat(F.lit("info@"), k.cast("string"), F.lit(".test"))).otherwise("").alias("email"), F.when(k % 2 != 0, "Direktur").otherwise("").alias("contact_person"),
    )


CLASSES = ("kecil", "menengah", "besar", "")
CATEGORIES = ("izin_usaha", "sbu", "sdm", "pengalaman_kerja", "keuangan")


def qualifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("n")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n")).where((k + n) % 3 != 0)
    return rows.select(
        (k * 10 + n).alias("id"), k.alias("company_id"), pick(CATEGORIES, n - 1).alias("category"), F.concat(F.lit("Dokumen "), pick(CATEGORIES, n - 1)).alias("name"),
        pick(CODES, k + n).alias("kbli_code"), F.array(pick(CODES, k), pick(CODES, k + 2 * n)).alias("kbli_codes"),
        F.when((k + n) % 4 != 0, "active").when((k + n) % 8 != 0, "needs_renewal").otherwise("expired").alias("status"), F.when(k % 2 == 0, F.concat(F.lit("Proyek "), k.cast("string"))).otherwise("").alias("project_name"),
        F.when(k % 3 != 0, "Klien").otherwise("").alias("client_name"), (F.lit(1990) + k % 7).cast("int").alias("project_year"), (k * 1_000_000).alias("value_amount"),
        F.concat(F.lit("No-"), (k * 10 + n).cast("string")).alias("number"), F.create_map(F.lit("penerbit"), F.concat(F.lit("Lembaga "), (k % 5).cast("string"))).alias("details"), pick(CLASSES, k).alias("klasifikasi_usaha"),
        F.date_add(F.lit("1994-01-01").cast("date"), (k % 700).cast("int")).alias("valid_from"), F.when(k % 4 != 0, F.date_add(F.lit("1996-01-01").cast("date"), (k % 400).cast("int"))).alias("valid_until"),
    )


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier of an order once, under varying spellings and tax numbers."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("n"))
    firms = companies(spark, sf_dir).select(F.col("id").alias("l_suppkey"), "name", F.col("npwp").alias("own"))
    n, k = F.col("n"), F.col("l_suppkey")
    named = F.when(n % 3 == 0, F.col("name")).when(n % 3 == 1, F.lower(F.col("name"))).otherwise(F.concat(F.lit("CV. Lain "), k.cast("string")))
    tax = F.when(n % 4 == 0, F.col("own")).when(n % 4 == 1, F.concat(F.lit("0****"), F.substring(F.col("own"), 6, 10))).when(n % 4 == 2, "").otherwise("ABC")
    return lines.join(firms, "l_suppkey").select(
        F.col("l_orderkey").alias("tender_id"), k.alias("source_id"), named.alias("name"), tax.alias("npwp"), F.when(k % 50 == 49, F.lpad(k.cast("string"), 13, "0")).otherwise("").alias("nib"),
        F.when(n % 5 == 0, "Tidak lulus evaluasi teknis").otherwise("").alias("alasan"),
    )


def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier of an order's cheapest line, for test data only."""
    first = Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_suppkey", "l_linenumber")
    lines = table(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(first)).where("place = 1")
    firms = companies(spark, sf_dir).select(F.col("id").alias("l_suppkey"), "name", "npwp")
    return lines.join(firms, "l_suppkey").select(
        F.col("l_orderkey").alias("tender_id"), F.col("l_suppkey").alias("company_id"), F.col("name").alias("company_name"), "npwp",
        (F.round(F.col("l_extendedprice") * 100).cast("long") * 100).alias("winning_value"), F.col("l_shipdate").cast("timestamp_ntz").alias("created_at"),
    )


STATUSES = {"signup": "belum_diproses", "error": "gagal", "click": "cocok_diproses", "view": "tidak_cocok", "purchase": "sudah_submit"}


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of a company on a tender gives its status."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select((e % 997 * 4 + 1).alias("tender_id"), (F.col("user_id") % 40 + 1).alias("company_id"), "event_type", F.col("ts").cast("timestamp_ntz").alias("updated_at"), "event_id")
    latest = Window.partitionBy("tender_id", "company_id").orderBy(F.desc("updated_at"), F.desc("event_id"))
    status = reduce(lambda c, x: c.when(F.col("event_type") == x[0], x[1]), STATUSES.items(), F.when(F.lit(False), ""))
    return rows.withColumn("place", F.row_number().over(latest)).where("place = 1").select("tender_id", "company_id", status.alias("status"), "updated_at")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every status that a company gave a tender, in time."""
    status = reduce(lambda c, x: c.when(F.col("event_type") == x[0], x[1]), STATUSES.items(), F.when(F.lit(False), ""))
    return table(spark, sf_dir, "events").select((F.col("event_id") % 97 + 1).alias("tender_id"), (F.col("user_id") % 40 + 1).alias("company_id"), status.alias("status"), F.col("ts").cast("timestamp_ntz").alias("updated_at"), "event_id")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("id"), (e % 997 * 4 + 1).alias("tender_id"), (F.col("user_id") % 40 + 1).alias("company_id"), pick(("match", "score"), e).alias("job_type"),
        pick(("pending", "processing", "completed", "failed", "skipped"), e * 7 + F.floor(e / 5)).alias("status"), (e % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), (e % 10).cast("int").alias("priority"),
        F.when(e % 3 != 0, F.col("ts").cast("timestamp_ntz")).alias("scheduled_at"), F.col("ts").cast("timestamp_ntz").alias("started_at"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match of an order with each of its suppliers, its score by the keys."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tender_id"), F.col("l_suppkey").alias("company_id")).distinct()
    return rows.withColumn("fit_score", ((F.col("tender_id") * 7 + F.col("company_id") * 13) % 101).cast("int"))


_K = "o_orderkey"
_DAY = lambda d: f"strftime(CAST(o_orderdate AS DATE) + {d}, '%d-%m-%Y')"


def _stage(no: int, name: str, a: int, b: int) -> str:
    return f"{{'no': '{no}', 'tahap': '{name}', 'mulai': {_DAY(a)}, 'sampai': {_DAY(b)}}}"


_STATUS = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in STATUSES.items()) + " END"
VIEWS = {
    "tenders": f"""
SELECT *, regexp_matches(lower(tahap), 'pengumuman prakualifikasi|pembuktian kualifikasi|kirim persyaratan kualifikasi|prakualifikasi') AS is_prakualifikasi,
  kbli_code IN ('62019', '62090', '62029') OR nama_paket IN ('{PACKAGES[0]}', '{PACKAGES[2]}', '{PACKAGES[4]}', '{PACKAGES[6]}') AS is_it_priority,
  CASE WHEN kbli_code IN ('62019', '62090', '62029') THEN 100 WHEN nama_paket IN ('{PACKAGES[0]}', '{PACKAGES[2]}', '{PACKAGES[4]}', '{PACKAGES[6]}') THEN 80 ELSE 0 END AS priority_score
FROM (SELECT {_K} AS id, 'K' || n_nationkey AS kode_instansi, CAST({_K} AS VARCHAR) AS id_lelang, {_sql_pick(PACKAGES, _K)} AS nama_paket, n_name AS instansi, c_name AS satuan_kerja,
  CAST(round(o_totalprice * 100) AS BIGINT) * 100 AS hps, {_sql_pick(STAGES, _K)} AS tahap, {_sql_pick(KINDS, f"({_K} // 3)")} AS jenis, {_sql_pick(CODES, _K)} AS kbli_code,
  {_sql_pick(NEEDS, f"({_K} // 2)")} AS requirement_text, CASE WHEN {_K} % 6 = 0 THEN 'Syarat umum penyedia barang dan jasa' ELSE '' END AS syarat,
  'Kota ' || (o_custkey % 50) AS lokasi, CAST({_K} % 31 AS INTEGER) AS peserta_count, CAST({_K} % 101 AS INTEGER) AS ai_score,
  CASE WHEN {_K} % 4 <> 0 THEN [{_stage(1, "Pengumuman Prakualifikasi", 0, 5)}, {_stage(2, "Upload Dokumen Penawaran", 6, 30)}, {_stage(3, "Penandatanganan Kontrak", 40, 60)}]
    ELSE [{_stage(1, "Penjelasan", 0, 5)}, {_stage(2, "Pembuktian Kualifikasi", 6, 20)}, {_stage(3, "Kontrak", 40, 60)}] END AS jadwal,
  CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS TIMESTAMP) AS scraped_at
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "companies": """
SELECT s_suppkey AS id, 'PT. ' || s_name AS name, lpad(CAST(s_suppkey - CASE WHEN s_suppkey > 0 AND s_suppkey % 50 = 0 THEN 1 ELSE 0 END AS VARCHAR), 13, '0') AS nib,
  '0' || lpad(CAST(s_suppkey - CASE WHEN s_suppkey > 0 AND s_suppkey % 40 = 0 THEN 1 ELSE 0 END AS VARCHAR), 14, '0') AS npwp,
  CAST(round(s_acctbal * 100) AS BIGINT) * 10000 AS modal, CAST(round(s_acctbal * 100) AS BIGINT) * 50000 AS penghasilan, s_suppkey % 7 <> 0 AS is_active,
  CASE WHEN s_suppkey % 3 <> 0 THEN 'Jl. Raya ' || s_suppkey ELSE '' END AS address, CASE WHEN s_suppkey % 4 <> 0 THEN '021-' || s_suppkey ELSE '' END AS phone,
  CASE WHEN s_suppkey % 5 <> 0 THEN 'info@' || s_suppkey || '.test' ELSE '' END AS email, CASE WHEN s_suppkey % 2 <> 0 THEN 'Direktur' ELSE '' END AS contact_person
FROM supplier""",
    "qualifications": f"""
SELECT s_suppkey * 10 + n AS id, s_suppkey AS company_id, {_sql_pick(CATEGORIES, "(n - 1)")} AS category, 'Dokumen ' || {_sql_pick(CATEGORIES, "(n - 1)")} AS name,
  {_sql_pick(CODES, "(s_suppkey + n)")} AS kbli_code, [{_sql_pick(CODES, "s_suppkey")}, {_sql_pick(CODES, "(s_suppkey + 2 * n)")}] AS kbli_codes,
  CASE WHEN (s_suppkey + n) % 4 <> 0 THEN 'active' WHEN (s_suppkey + n) % 8 <> 0 THEN 'needs_renewal' ELSE 'expired' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN 'Proyek ' || s_suppkey ELSE '' END AS project_name,
  CASE WHEN s_suppkey % 3 <> 0 THEN 'Klien' ELSE '' END AS client_name, CAST(1990 + s_suppkey % 7 AS INTEGER) AS project_year, s_suppkey * 1000000 AS value_amount,
  'No-' || (s_suppkey * 10 + n) AS number, MAP {{'penerbit': 'Lembaga ' || (s_suppkey % 5)}} AS details, {_sql_pick(CLASSES, "s_suppkey")} AS klasifikasi_usaha,
  CAST(DATE '1994-01-01' + CAST(s_suppkey % 700 AS INTEGER) AS DATE) AS valid_from, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(DATE '1996-01-01' + CAST(s_suppkey % 400 AS INTEGER) AS DATE) END AS valid_until
FROM supplier, range(1, 6) t(n) WHERE (s_suppkey + n) % 3 <> 0""",
    "participants": """
SELECT l_orderkey AS tender_id, l_suppkey AS source_id,
  CASE WHEN n % 3 = 0 THEN c.name WHEN n % 3 = 1 THEN lower(c.name) ELSE 'CV. Lain ' || l_suppkey END AS name,
  CASE WHEN n % 4 = 0 THEN c.npwp WHEN n % 4 = 1 THEN '0****' || substr(c.npwp, 6, 10) WHEN n % 4 = 2 THEN '' ELSE 'ABC' END AS npwp,
  CASE WHEN l_suppkey % 50 = 49 THEN lpad(CAST(l_suppkey AS VARCHAR), 13, '0') ELSE '' END AS nib,
  CASE WHEN n % 5 = 0 THEN 'Tidak lulus evaluasi teknis' ELSE '' END AS alasan
FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS n FROM lineitem GROUP BY ALL) JOIN companies c ON c.id = l_suppkey""",
    "winners": """
SELECT l_orderkey AS tender_id, l_suppkey AS company_id, c.name AS company_name, c.npwp, CAST(round(l_extendedprice * 100) AS BIGINT) * 100 AS winning_value, CAST(l_shipdate AS TIMESTAMP) AS created_at
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_suppkey, l_linenumber) AS place FROM lineitem) JOIN companies c ON c.id = l_suppkey WHERE place = 1""",
    "submissions": f"""
SELECT tender_id, company_id, status, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY tender_id, company_id ORDER BY updated_at DESC, event_id DESC) AS place
  FROM (SELECT event_id % 997 * 4 + 1 AS tender_id, user_id % 40 + 1 AS company_id, {_STATUS} AS status, CAST(ts AS TIMESTAMP) AS updated_at, event_id FROM events)) WHERE place = 1""",
    "history": f"SELECT event_id % 97 + 1 AS tender_id, user_id % 40 + 1 AS company_id, {_STATUS} AS status, CAST(ts AS TIMESTAMP) AS updated_at, event_id FROM events",
    "jobs": f"""
SELECT event_id AS id, event_id % 997 * 4 + 1 AS tender_id, user_id % 40 + 1 AS company_id, {_sql_pick(("match", "score"), "event_id")} AS job_type,
  {_sql_pick(("pending", "processing", "completed", "failed", "skipped"), "(event_id * 7 + event_id // 5)")} AS status, CAST(event_id % 4 AS INTEGER) AS attempts, 3 AS max_attempts,
  CAST(event_id % 10 AS INTEGER) AS priority, CASE WHEN event_id % 3 <> 0 THEN CAST(ts AS TIMESTAMP) END AS scheduled_at, CAST(ts AS TIMESTAMP) AS started_at FROM events""",
    "matches": "SELECT *, CAST((tender_id * 7 + company_id * 13) % 101 AS INTEGER) AS fit_score FROM (SELECT DISTINCT l_orderkey AS tender_id, l_suppkey AS company_id FROM lineitem)",
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` after the definitions of the domain tables it uses; companies come first, as others read them."""
    order = [n for n in ("companies", *VIEWS) if n in names or n == "companies" and {"participants", "winners"} & set(names)]
    if not order:
        return sql
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in dict.fromkeys(order)) + "\n" + sql
