"""Upserts and deletes as joins that give the new snapshot; applying a batch twice is applying it once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tenderlake.functions import keywords as K
from tenderlake.functions import scalars as S
from tenderlake.functions.predicates import stage_class
from tenderlake.operators.resolve import latest_per_key, winner_flag

KEYS = ["kode_instansi", "id_lelang"]
STAGE1 = ("nama_paket", "instansi", "satuan_kerja", "hps", "jenis", "tahap")
RECRAWL = ("requirement_text", "syarat", "lokasi", "satuan_kerja")


def _filled(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    if kind == "string":
        return F.length(F.trim(S.text(c))) > 0
    return F.size(c) > 0 if kind.startswith("array") else F.coalesce(F.col(c) != 0, F.lit(False)) if kind in ("int", "bigint") else F.col(c).isNotNull()


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: Column, mode: str = "overwrite") -> DataFrame:
    """The target after the batch, whose last row of each key by ``order`` counts; which of equals does not depend on the run.

    overwrite: all columns, blanks too. stage1: only the listing's columns. fill: only values that aren't blank. recrawl:
    all, but four columns keep their old value against a blank. first_seen, if there is such a column, keeps the first.
    """
    tie = F.xxhash64(*(c for c, kind in sorted(batch.dtypes) if "map<" not in kind))
    batch = latest_per_key(batch, keys, order, tie)
    columns = [c for c in target.columns if c not in keys]
    new = batch.select(*keys, F.lit(True).alias("_new"), *(F.struct(F.col(c).alias("v"), _filled(batch, c).alias("filled")).alias(f"_{c}") for c in columns if c in batch.columns))
    joined = target.withColumn("_old", F.lit(True)).join(new, keys, "full_outer")

    def value(c: str) -> Column:
        if c not in batch.columns:
            return F.col(c)
        use = {"overwrite": F.lit(True), "stage1": F.lit(c in STAGE1), "fill": F.col(f"_{c}.filled"), "recrawl": F.col(f"_{c}.filled") if c in RECRAWL else F.lit(True)}[mode]
        if c == "first_seen":
            use = F.lit(False)
        return F.when(F.col("_old").isNull() | (F.col("_new").isNotNull() & use), F.col(f"_{c}.v")).otherwise(F.col(c)).alias(c)

    return joined.select(*(c if c in keys else value(c).alias(c) for c in target.columns))


def upsert_tenders(target: DataFrame, batch: DataFrame, mode: str = "overwrite") -> DataFrame:
    return upsert(target, batch, KEYS, F.col("scraped_at"), mode)


def upsert_participants(target: DataFrame, batch: DataFrame, order: Column) -> DataFrame:
    """By tender and trimmed name; rows without a name are skipped and nothing is deleted."""
    batch = batch.withColumn("name", F.trim(S.text("name"))).where("name != ''")
    return upsert(target, batch, ["tender_id", "name"], order)


def upsert_winners(target: DataFrame, batch: DataFrame) -> DataFrame:
    return upsert(target, batch.where(F.length(F.trim(S.text("company_name"))) > 0), ["tender_id"], F.col("created_at"))


def derive_submissions(participants: DataFrame, winners: DataFrame, existing: DataFrame) -> DataFrame:
    """(tender_id, company_id, status) of linked bidders: a failed note is gagal, the winner menang, else sudah_submit.

    A win on record is not taken back by sudah_submit, but by gagal.
    """
    flagged = winner_flag(participants.where("company_id is not null"), winners)
    status = F.when(S.is_failed_note(F.col("alasan")), "gagal").when(F.col("is_winner"), "menang").otherwise("sudah_submit")
    place = F.when(F.col("new") == "gagal", 2).when(F.col("new") == "menang", 1).otherwise(0)
    new = flagged.select("tender_id", "company_id", status.alias("new")).groupBy("tender_id", "company_id").agg(F.max_by("new", place).alias("new"))
    rows = new.join(existing.select("tender_id", "company_id", F.col("status").alias("old")), ["tender_id", "company_id"], "left")
    return rows.select("tender_id", "company_id", F.when((F.col("old") == "menang") & (F.col("new") == "sudah_submit"), "menang").otherwise(F.col("new")).alias("status"))


def auto_watchlist(existing: DataFrame, derived: DataFrame) -> DataFrame:
    keys = ["company_id", "tender_id"]
    return existing.select(*keys).unionByName(derived.select(*keys).distinct().join(existing, keys, "left_anti"))


def purge(tenders: DataFrame, submissions: DataFrame, mode: str) -> DataFrame:
    """Adds deleted and spared to every tender: completed and non_retained spare tenders with a submission that matters."""
    tahap, safe = F.col("tahap"), submissions.where(F.col("status").isin(*K.PROTECTED_SUBMISSIONS)).select(F.col("tender_id").alias("id")).distinct().withColumn("_safe", F.lit(True))
    retained = S.contains_any(tahap, K.AWARDED) | S.contains_any(tahap, K.ACCEPT)
    gone = {"non_prakualifikasi": ~F.col("is_prakualifikasi"), "inactive": S.contains_any(tahap, K.PURGE_INACTIVE), "non_retained": ~retained, "completed": S.contains_any(tahap, K.PURGE_COMPLETED), "all": F.lit(True)}[mode]
    rows = tenders.join(safe, "id", "left")
    spared = F.coalesce("_safe", F.lit(False)) if mode in ("non_retained", "completed") else F.lit(False)
    return rows.withColumn("deleted", gone & ~spared).withColumn("spared", gone & spared).drop("_safe")


def purge_counts(rows: DataFrame) -> list[Column]:
    """Aggregates over ``purge`` rows: total, kept, deleted, spared."""
    n = lambda c: F.count_if(c).cast("long")
    return [F.count(F.lit(1)).alias("total"), n(~rows["deleted"]).alias("kept"), n(rows["deleted"]).alias("deleted"), n(rows["spared"]).alias("spared")]


def purged(tenders: DataFrame, submissions: DataFrame, mode: str, name: str = "purge") -> tuple[DataFrame, Observation]:
    """``purge`` and its counts, which come with the one pass that writes the rows: ``observation.get`` once they are written."""
    rows, counts = purge(tenders, submissions, mode), Observation(name)
    return rows.observe(counts, *purge_counts(rows)), counts


def cascade_delete(children: DataFrame, deleted: DataFrame) -> DataFrame:
    return children.join(deleted.select(F.col("id").alias("tender_id")), "tender_id", "left_anti")


def crawl_gate(df: DataFrame) -> DataFrame:
    """What a crawl keeps: stages that are eligible or retained."""
    return df.where(stage_class(F.col("tahap")).isin("eligible", "retained"))
