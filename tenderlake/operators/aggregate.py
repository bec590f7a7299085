"""Facets, summaries and per-company aggregates, each in as few passes as its grouping allows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.functions import keywords as K
from tenderlake.functions import predicates as P
from tenderlake.functions import scalars as S


def facet_counts(df: DataFrame, kbli_dim: DataFrame, active: dict[str, Column] | None = None) -> DataFrame:
    """(facet, value, n): every facet counted under all ``active`` filters (by facet name) except its own, in one pass.

    Facets: hps, jenis, status, stage, it, kbli (zero-filled from ``kbli_dim``: code), total.
    """
    active = active or {}
    others = lambda facet: reduce(Column.__and__, (c for f, c in active.items() if f != facet), F.lit(True))
    bucket, label, tahap = S.hps_bucket(F.col("hps")), P.status_label(F.col("tahap"), F.col("is_prakualifikasi")), F.col("tahap")
    cells = [("hps", k, bucket == k) for k in K.HPS_RANGES] + [("jenis", k, F.col("jenis") == k) for k in K.PROCUREMENT_KINDS]
    cells += [("status", k, label == k) for k in ("aktif", "prakualifikasi", "selesai")]
    cells += [("stage", g, P.stage_group(tahap, g)) for g in (*K.STAGE_GROUPS, "lainnya")] + [("it", "it_priority", F.col("is_it_priority")), ("total", "total", F.lit(True))]
    counts = df.agg(*(F.count_if(hit & others(facet)).alias(f"{facet}:{value}") for facet, value, hit in cells))
    flat = counts.select(F.inline(F.array(*(F.struct(F.lit(f).alias("facet"), F.lit(v).alias("value"), F.col(f"`{f}:{v}`").alias("n")) for f, v, _ in cells))))
    codes = df.where(others("kbli")).groupBy(F.col("kbli_code").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return flat.union(kbli_dim.select("code").join(codes, "code", "left").select(F.lit("kbli"), "code", F.coalesce("n", F.lit(0))))


def report_summary(tenders: DataFrame, submissions: DataFrame) -> DataFrame:
    """One row: tenders, potential, submitted, won, their sums of hps, not yet submitted and win_rate (null without submissions)."""
    marks = submissions.groupBy(F.col("tender_id").alias("id")).agg(F.bool_or(F.col("status").isin("sudah_submit", "menang")).alias("_submitted"), F.bool_or(F.col("status") == "menang").alias("_won"), F.bool_or(F.col("status") == "sudah_submit").alias("_sent"))
    no = F.lit(False)
    rows = tenders.join(marks, "id", "left").select("hps", "ai_score", *(F.coalesce(c, no).alias(c) for c in ("_submitted", "_won", "_sent")))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("hps"))), F.lit(0))
    potential = F.col("ai_score") > 60
    out = rows.agg(F.count(F.lit(1)).alias("tenders"), F.count_if(potential).alias("potential"), F.count_if("_submitted").alias("submitted"), F.count_if("_won").alias("won"), total(potential).alias("hps_potential"), total(F.col("_submitted")).alias("hps_submitted"), total(F.col("_won")).alias("hps_won"), F.count_if(~F.col("_sent")).alias("not_submitted"))
    return out.withColumn("win_rate", F.bround(F.try_divide(F.col("won").cast("double"), F.col("submitted")), 4))


def top_counts(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values, ties by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def pipeline_summary(tenders: DataFrame, submissions: DataFrame, companies: DataFrame, as_of: Column) -> DataFrame:
    """Per company: submissions by status, open tenders without one, and how many of those end within 3 and within 7 days."""
    open_ = tenders.where(P.is_open(F.col("tahap"))).select(F.col("id").alias("tender_id"), S.days_left(S.deadline_first_match(F.col("jadwal")), as_of).alias("days"))
    near = lambda c: F.count_if((F.col(c) > 0) & (F.col(c) <= 3)), lambda c: F.count_if((F.col(c) > 3) & (F.col(c) <= 7))
    totals = open_.agg(F.count(F.lit(1)).alias("active"), near[0]("days").alias("all3"), near[1]("days").alias("all7"))
    counts = submissions.groupBy("company_id").pivot("status", list(K.SUBMISSION_STATUSES)).count().na.fill(0)
    done = submissions.select("company_id", "tender_id").distinct()
    processed = done.groupBy("company_id").agg(F.count(F.lit(1)).alias("with_status"))
    soon = done.join(open_, "tender_id").groupBy("company_id").agg(near[0]("days").alias("own3"), near[1]("days").alias("own7"))
    rows = companies.select(F.col("id").alias("company_id")).crossJoin(F.broadcast(totals))  # totals: one row
    for part in (counts, processed, soon):
        rows = rows.join(part, "company_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "company_id", *(zero(s).alias(s) for s in K.SUBMISSION_STATUSES if s != "belum_diproses"), F.greatest(F.lit(0), F.col("active") - zero("with_status")).alias("belum_diproses"),
        (F.col("all3") - zero("own3")).alias("due_3"), (F.col("all7") - zero("own7")).alias("due_7"),
    )


def company_intelligence(participants: DataFrame, winners: DataFrame) -> DataFrame:
    """Per company: participations, wins, total value won, win_rate; null, not 0, where there is no data."""
    p = participants.where("company_id is not null").groupBy("company_id").agg(F.countDistinct("tender_id").alias("participations"))
    w = winners.where("company_id is not null").groupBy("company_id").agg(F.count(F.lit(1)).alias("wins"), F.sum("winning_value").alias("total_value"))
    rate = F.bround(F.try_divide(F.coalesce("wins", F.lit(0)).cast("double"), F.col("participations")), 4)
    return p.join(w, "company_id", "full_outer").withColumn("win_rate", F.when(F.col("participations").isNotNull(), rate))


def frequency_topk(df: DataFrame, column: Column, k: int = 20) -> DataFrame:
    """Per company the k most frequent values; counted before ranking, so big bidders don't skew it."""
    counts = df.groupBy("company_id", column.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("company_id").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def intelligence_status(tenders: DataFrame, matches: DataFrame, scores: DataFrame, companies: DataFrame) -> DataFrame:
    """Per company: open tenders, how many are matched, scored and ready, percentages matched and ready (half-even), a state and a message.

    Where no tender is open all scores count.
    """
    live = tenders.where(~P.is_terminal(F.col("tahap"))).select(F.col("id").alias("tender_id"))
    total = live.agg(F.count(F.lit(1)).alias("tenders"))
    m = matches.join(live, "tender_id", "left_semi").groupBy("company_id").agg(F.count(F.lit(1)).alias("matched"))
    s = scores.join(live.withColumn("live", F.lit(True)), "tender_id", "left").crossJoin(F.broadcast(total)).where("live or tenders = 0")
    s = s.groupBy("company_id").agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("status") == "ready").alias("ready"))
    rows = companies.select(F.col("id").alias("company_id")).crossJoin(F.broadcast(total)).join(m, "company_id", "left").join(s, "company_id", "left").na.fill(0)
    percent = lambda c: F.coalesce(F.bround(F.try_divide(F.col(c) * 100.0, F.col("tenders"))).cast("int"), F.lit(0))
    rows = rows.withColumn("matched_percent", percent("matched")).withColumn("ready_percent", percent("ready"))
    state = F.when((F.col("tenders") == 0) | (F.col("matched") == 0) | (F.col("ready") == 0), "NOT_READY").when((F.col("matched_percent") >= 100) & (F.col("ready_percent") >= 100), "READY").otherwise("PARTIAL")
    # What is said of a state.
    message = (
        F.when(F.col("state") == "READY", F.concat(F.lit("Pipeline siap: "), "ready", F.lit(" peluang layak tersedia untuk "), "tenders", F.lit(" tender aktif.")))
        .when(F.col("state") == "PARTIAL", F.concat(F.lit("Pipeline sebagian siap: "), "ready", F.lit(" peluang siap dari "), "tenders", F.lit(" tender aktif.")))
        .when(F.col("tenders") == 0, "Belum ada tender aktif yang dapat dianalisis.")
        .when(F.col("matched") == 0, "Belum ada analisis AI. Jalankan AI Match untuk tender aktif.")
        .otherwise("Belum ada skor peluang yang siap. Selesaikan Opportunity Score.")
    )
    return rows.withColumn("state", state).withColumn("message", message)


def company_completion(companies: DataFrame, quals: DataFrame) -> DataFrame:
    """Per company a percentage of six weighted categories, truncated, the six, and its qualifications by status."""
    statuses = ("active", "expired", "needs_renewal")
    q = quals.groupBy("company_id").agg(*(F.bool_or((F.col("category") == c) & (F.col("status") == "active")).alias(f"has_{c}") for c in ("izin_usaha", "sbu", "sdm", "pengalaman_kerja")), *(F.count_if(F.col("status") == s).alias(s) for s in statuses))
    rows = companies.join(q.withColumnRenamed("company_id", "id"), "id", "left")
    share = lambda n, *c: reduce(Column.__add__, (F.when(x, n).otherwise(0) for x in c))
    filled = lambda *c: [S.text(x) != "" for x in c]
    flags = lambda *c: [F.coalesce(x, F.lit(False)) for x in c]
    parts = {
        "identitas": share(50, *filled("name", "nib")),
        "legal_kontak": share(20, *filled("npwp", "address", "phone", "email", "contact_person")),
        "keuangan": share(50, F.coalesce("modal", F.lit(0)) > 0, F.coalesce("penghasilan", F.lit(0)) > 0),
        "kualifikasi": share(50, *flags("has_izin_usaha", "has_sbu")),
        "pengalaman": share(100, *flags("has_pengalaman_kerja")),
        "sdm": share(100, *flags("has_sdm")),
    }
    total = reduce(Column.__add__, (parts[name] * weight for name, weight in K.COMPLETION_WEIGHTS.items()))
    return rows.select(F.col("id").alias("company_id"), F.least(total.cast("int"), F.lit(100)).alias("completion"), *(c.alias(n) for n, c in parts.items()), *(F.coalesce(s, F.lit(0)).alias(s) for s in statuses))


def job_status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("company_id").pivot("status", list(K.JOB_STATUSES)).count().na.fill(0)


def daily_usage(executions: DataFrame, limit: int = 100) -> DataFrame:
    """Executions per company and day against the limit."""
    days = executions.groupBy("company_id", F.to_date("started_at").alias("usage_date")).agg(F.count(F.lit(1)).alias("used"))
    return days.withColumn("remaining", F.greatest(F.lit(0), limit - F.col("used")))


def crawl_summary(records: DataFrame) -> DataFrame:
    """Per agency and in total (null): found, saved, skipped, errors and the percentage saved; records: kode_instansi, outcome."""
    rows = records.rollup("kode_instansi").agg(F.count(F.lit(1)).alias("found"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("saved", "skipped", "error")))
    return rows.withColumn("percent", F.bround(F.try_divide(F.col("saved") * 100.0, F.col("found"))).cast("int"))


def recent_n(df: DataFrame, *order: Column, n: int = 10) -> DataFrame:
    w = Window.partitionBy("company_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def result_page(df: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """A page of tenders in dashboard order, numbered on by ``place``; see ``page_total`` for how many there are."""
    order = [F.desc("is_it_priority"), F.desc("priority_score"), F.desc("scraped_at"), F.col("id")]
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)) + (page - 1) * size)  # of a page's rows


def page_total(df: DataFrame, size: int = 20) -> DataFrame:
    """One row: total rows and total_pages, at least one."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return total.withColumn("total_pages", F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("long"))


def budget_gate(jobs: DataFrame, used: DataFrame, limit: int = 100) -> DataFrame:
    """Jobs that a company's remaining executions of the day admit, in claim order; used: company_id, usage_date, used."""
    day = F.to_date("started_at")
    rows = jobs.withColumn("usage_date", day).join(used, ["company_id", "usage_date"], "left")
    order = Window.partitionBy("company_id", "usage_date").orderBy(F.desc("priority"), F.col("scheduled_at").asc_nulls_first(), "id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit - F.coalesce("used", F.lit(0))).select(*jobs.columns)


def claim_jobs(jobs: DataFrame, as_of: Column, n: int = 10) -> DataFrame:
    due = jobs.where((F.col("status") == "pending") & (F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= as_of)))
    return due.orderBy(F.desc("priority"), F.col("scheduled_at").asc_nulls_first(), "id").limit(n)


def enqueue_new(tenders: DataFrame, jobs: DataFrame, cap: int = 500) -> DataFrame:
    fresh = tenders.where(P.is_submittable(F.col("tahap"))).join(jobs.select(F.col("tender_id").alias("id")), "id", "left_anti")
    return fresh.orderBy(F.desc("scraped_at"), F.desc("id")).limit(cap)


def status_changes(history: DataFrame, *order: str) -> DataFrame:
    """(tender_id, company_id, old_value, new_value, updated_at) where the status differs from the one before; the first's is ''."""
    w = Window.partitionBy("tender_id", "company_id").orderBy(*order)
    rows = history.withColumn("old_value", F.coalesce(F.lag("status").over(w), F.lit("")))
    return rows.where(F.col("old_value") != F.col("status")).select("tender_id", "company_id", "old_value", F.col("status").alias("new_value"), "updated_at")


def first_seen(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(column).alias("first_seen"))


def recover_stale(jobs: DataFrame, as_of: Column, minutes: int = 30) -> DataFrame:
    """Jobs in processing for longer than ``minutes`` become pending again, without a start."""
    stale = (F.col("status") == "processing") & (F.col("started_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))
    rows = jobs.withColumn("_stale", F.coalesce(stale, F.lit(False)))
    return rows.withColumn("started_at", F.when(~F.col("_stale"), F.col("started_at"))).withColumn("status", F.when(F.col("_stale"), "pending").otherwise(F.col("status"))).drop("_stale")
