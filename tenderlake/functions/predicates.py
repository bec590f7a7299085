"""Predicates on stages and rows. Every purpose has its own list of words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions import keywords as K
from tenderlake.functions.scalars import contains_any, deadline_first_match, deadline_latest, normalize_tahap, text, usable_text


def discovery_keep(status: Column) -> Column:
    return ~contains_any(status, K.DISCOVERY_SKIP)


def stage_class(tahap: Column) -> Column:
    """aborted over retained over eligible over unknown."""
    return F.when(contains_any(tahap, K.ABORTED), "aborted").when(contains_any(tahap, K.AWARDED), "retained").when(contains_any(tahap, K.ACCEPT), "eligible").otherwise("unknown")


def is_prakualifikasi(tahap: Column) -> Column:
    return contains_any(tahap, K.PRAKUALIFIKASI)


def is_submittable(tahap: Column) -> Column:
    stage = normalize_tahap(tahap)
    return ~contains_any(stage, K.NON_SUBMITTABLE) & contains_any(stage, K.SUBMITTABLE)


def is_terminal(tahap: Column) -> Column:
    return contains_any(tahap, K.TERMINAL)


def is_open(tahap: Column) -> Column:
    return ~contains_any(tahap, K.DASHBOARD_CLOSED)


def status_label(tahap: Column, is_prak: Column) -> Column:
    return F.when(is_prak, "prakualifikasi").when(contains_any(tahap, ("selesai", "tender selesai", "pembatalan")), "selesai").when(contains_any(tahap, ("kontrak", "penandatanganan")), "dikontrak").otherwise("aktif")


def stage_group(tahap: Column, group: str) -> Column:
    """One of the overlapping groups of stages; lainnya is none of the others."""
    if group == "lainnya":
        return ~reduce(Column.__or__, (stage_group(tahap, g) for g in K.STAGE_GROUPS))
    return contains_any(tahap, K.STAGE_GROUPS[group])


def filter_stage_groups(df: DataFrame, groups) -> DataFrame:
    return df.where(reduce(Column.__or__, (stage_group(F.col("tahap"), g) for g in groups))) if groups else df


def filter_tab(df: DataFrame, tab: str) -> DataFrame:
    kept = {"aktif": is_open(F.col("tahap")) & ~F.col("is_prakualifikasi"), "prakualifikasi": F.col("is_prakualifikasi"), "it_priority": F.col("is_it_priority")}
    return df.where(kept[tab]) if tab in kept else df


def filter_tenders(df: DataFrame, instansi=None, search=None, hps_range=None, hps_min=None, hps_max=None, jenis=None, location=None, kbli=None, deadline_from=None, deadline_to=None) -> DataFrame:
    """All given conditions; search looks in four columns; deadlines are the dashboard's."""
    if instansi:
        df = df.where(F.col("instansi").isin(*instansi))
    if search:
        df = df.where(reduce(Column.__or__, (F.contains(F.lower(text(c)), F.lit(search.lower())) for c in ("nama_paket", "instansi", "satuan_kerja", "id_lelang"))))
    low, high = K.HPS_RANGES.get(hps_range, (None, None))
    for bound in (low, hps_min):
        df = df.where(F.col("hps") >= bound) if bound is not None else df
    for bound in (high, hps_max):
        df = df.where(F.col("hps") <= bound) if bound is not None else df
    if jenis:
        df = df.where(F.col("jenis").isin(*jenis))
    if location:
        df = df.where(F.contains(F.lower(text("lokasi")), F.lit(location.lower())))
    if kbli:
        df = df.where(F.col("kbli_code").isin(*kbli))
    if deadline_from or deadline_to:
        date = deadline_first_match(F.col("jadwal"))
        df = df.where(date >= F.lit(deadline_from).cast("date")) if deadline_from else df
        df = df.where(date <= F.lit(deadline_to).cast("date")) if deadline_to else df
    return df


def missing_enrichment(mode: str = "delta") -> Column:
    empty = lambda c: F.length(F.trim(text(c))) == 0
    schedule = F.coalesce(F.size("jadwal"), F.lit(0)) <= 0
    if mode == "delta":
        return empty("satuan_kerja") | empty("syarat") | schedule | (F.coalesce("peserta_count", F.lit(0)) <= 0)
    return schedule | empty("lokasi") | empty("syarat")


def eligibility(pairs: DataFrame, as_of: Column) -> DataFrame:
    """Adds eligible, skip_reason and error_reason to (tender, company) pairs; the first rule that applies decides.

    pairs: tender_id, tahap, jadwal, requirement_text, syarat, nama_paket; company_id, is_active, kbli_codes; either id may be null.
    """
    latest = deadline_latest(F.col("jadwal"))
    error = F.when(F.col("company_id").isNull(), "company_missing").when(F.col("tender_id").isNull() & F.col("is_active") & (F.size("kbli_codes") > 0), "tender_missing")
    skip = (
        F.when(~F.col("is_active"), "company_inactive")
        .when(F.coalesce(F.size("kbli_codes"), F.lit(0)) <= 0, "company_without_kbli")
        .when(~is_submittable(F.col("tahap")), "not_submittable")
        .when(is_terminal(F.col("tahap")), "terminal")
        .when(usable_text(F.col("requirement_text"), F.col("syarat"), F.col("nama_paket")).isNull(), "no_text")
        .when(latest < as_of, "expired")
    )
    return pairs.withColumn("error_reason", error).withColumn("skip_reason", F.when(F.col("error_reason").isNull(), skip)).withColumn("eligible", F.col("error_reason").isNull() & F.col("skip_reason").isNull())


def page_blocked(html: Column) -> Column:
    """Pages that deny access or set a challenge instead of showing data."""
    return contains_any(html, (w.lower() for w in K.BLOCKED_PAGE))


def audit_window(df: DataFrame, as_of: Column, days: int = 30, action: str | None = None, company: int | None = None) -> DataFrame:
    df = df.where(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days)))
    df = df.where(F.col("action") == action) if action else df
    return df.where(F.col("company_id") == company) if company is not None else df
