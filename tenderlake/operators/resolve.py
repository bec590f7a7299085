"""Joins: entity resolution, merging of sources, pairs and denormalised listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.functions import keywords as K
from tenderlake.functions import scalars as S

AUTO_LINK = ("EXACT_NPWP", "EXACT_OFFICIAL_IDENTIFIER", "EXACT_MATCH_NAME_MASKED_NPWP")


def _by_key(companies: DataFrame, key: Column, name: str) -> DataFrame:
    """One row per key with its companies in order; rows without a key never join."""
    found = companies.select(key.alias(name), "id").where(F.col(name).isNotNull() & (F.col(name) != ""))
    return found.groupBy(name).agg(F.sort_array(F.collect_list("id")).alias(f"{name}_ids"))


def _left_join(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """A left join on a key that most rows may lack: those meet nothing, each under a key of its own, so no task gets them all."""
    own = F.coalesce(F.col(key), F.concat(F.lit("\0"), F.col("_row").cast("string")))
    return rows.withColumn("_key", own).join(found.withColumnRenamed(key, "_key"), "_key", "left").drop("_key")


def resolve_entities(source: DataFrame, companies: DataFrame) -> DataFrame:
    """Adds status, company_id, candidate_ids and reason to rows with name, npwp and nib.

    The cascade: official identifier, tax number, name with masked tax number, exact name. One company links, several are a
    conflict, a name alone is only a candidate. The company side has one row per key, so joins can't fan out.
    """
    rows = source.withColumn("_row", F.monotonically_increasing_id())
    name = F.trim(S.text("name"))
    rows = rows.withColumn("_nib", S.normalize_identifier(F.col("nib"))).withColumn("_npwp", S.normalize_npwp(F.col("npwp"))).withColumn("_exact", F.nullif(F.lower(name), F.lit("")))
    masked = F.col("_npwp").isNull() & S.text("npwp").rlike(r"[*xX#]") & (name != "")
    rows = rows.withColumn("_name", F.when(masked, F.nullif(S.normalize_company_name(name), F.lit(""))))
    by_name = companies.select(S.normalize_company_name(F.col("name")).alias("_name"), "id", F.col("npwp").alias("full")).where("_name != ''")
    by_name = by_name.groupBy("_name").agg(F.sort_array(F.collect_list(F.struct("id", "full"))).alias("_named"))
    for key, value in (("_nib", S.normalize_identifier(F.col("nib"))), ("_npwp", S.normalize_npwp(F.col("npwp"))), ("_exact", F.lower(F.trim(S.text("name"))))):
        rows = _left_join(rows, _by_key(companies, value, key), key)
    rows = _left_join(rows, by_name, "_name")
    fitting = F.transform(F.filter("_named", lambda x: S.matches_masked_npwp(F.col("npwp"), x["full"])), lambda x: x["id"])
    rows = rows.withColumn("_fit", fitting).withColumn("_named_ids", F.transform("_named", lambda x: x["id"]))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    none = F.array().cast("array<bigint>")

    def result(status: str, ids: Column, reason: str) -> Column:
        company = F.get(ids, F.lit(0)) if status in AUTO_LINK else F.lit(None)
        return F.struct(F.lit(status).alias("status"), company.cast("long").alias("company_id"), ids.alias("candidate_ids"), F.lit(reason).alias("reason"))

    found = (
        F.when(n("_nib_ids") == 1, result("EXACT_OFFICIAL_IDENTIFIER", F.col("_nib_ids"), "unique official identifier"))
        .when(n("_nib_ids") > 1, result("IDENTITY_CONFLICT", F.col("_nib_ids"), "several companies share the identifier"))
        .when(n("_npwp_ids") == 1, result("EXACT_NPWP", F.col("_npwp_ids"), "unique tax number"))
        .when(n("_npwp_ids") > 1, result("IDENTITY_CONFLICT", F.col("_npwp_ids"), "several companies share the tax number"))
        .when(F.col("_npwp").isNotNull() & (n("_exact_ids") > 0), result("CANDIDATE_ONLY", F.col("_exact_ids"), "tax number unknown, name only"))
        .when(F.col("_npwp").isNotNull(), result("UNRESOLVED", none, "tax number and name unknown"))
        .when(n("_fit") == 1, result("EXACT_MATCH_NAME_MASKED_NPWP", F.col("_fit"), "name and masked tax number"))
        .when(n("_fit") > 1, result("IDENTITY_CONFLICT", F.col("_fit"), "several companies fit name and masked tax number"))
        .when(n("_named_ids") > 0, result("CANDIDATE_ONLY", F.col("_named_ids"), "masked tax number doesn't fit, name only"))
        .when(n("_exact_ids") > 0, result("CANDIDATE_ONLY", F.col("_exact_ids"), "name only"))
        .when(F.col("_exact").isNotNull(), result("UNRESOLVED", none, "name unknown"))
        .otherwise(result("UNRESOLVED", none, "no identity given"))
    )
    return rows.withColumn("_r", found).select(*source.columns, "_r.*")


def apply_resolution(existing: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """existing and resolved: keys, company_id, status. A link is made on auto-link statuses and never overwritten by a weaker result."""
    new = resolved.select(*keys, F.col("company_id").alias("_id"), F.col("status").alias("_status"))
    links = F.col("_status").isin(*AUTO_LINK)
    kept = F.col("company_id").isNotNull() & ~F.coalesce(links, F.lit(False))
    joined = existing.join(new, keys, "left")
    return joined.select(
        *keys, F.when(F.coalesce(links, F.lit(False)), F.col("_id")).otherwise(F.col("company_id")).alias("company_id"),
        F.when(kept | F.col("_status").isNull(), F.col("status")).otherwise(F.col("_status")).alias("status"),
    )


def merge_participant_sources(peserta: DataFrame, hasil: DataFrame) -> DataFrame:
    """Bidders of both pages by tender and bare name: results override notes and values and fill in tax numbers."""
    key = F.trim(F.regexp_replace(F.lower(S.text("name")), r"(?U)[^\w\s]", ""))
    a = peserta.select("tender_id", key.alias("key"), F.col("name").alias("a_name"), F.col("npwp").alias("a_npwp"), F.col("alasan").alias("a_alasan"), F.col("nilai").alias("a_nilai"))
    b = hasil.select("tender_id", key.alias("key"), F.col("name").alias("b_name"), F.col("npwp").alias("b_npwp"), F.col("alasan").alias("b_alasan"), F.col("nilai").alias("b_nilai"))
    first = lambda *c: F.coalesce(*(S.blank_to_null(F.col(x)) for x in c), F.lit(""))
    return a.join(b, ["tender_id", "key"], "full_outer").select(
        "tender_id", first("a_name", "b_name").alias("name"), first("a_npwp", "b_npwp").alias("npwp"), first("b_alasan", "a_alasan").alias("alasan"), first("b_nilai", "a_nilai").alias("nilai"),
    )


def candidate_pairs(tenders: DataFrame, companies: DataFrame, existing: DataFrame) -> DataFrame:
    """(tender_id, company_id) of every tender with every active company that has no job yet. Filter both sides first.

    A tender's jobs come to it before it meets companies, so no pair is shuffled.
    """
    firms = companies.where("is_active").select(F.col("id").alias("company_id"))
    had = existing.groupBy("tender_id").agg(F.collect_set("company_id").alias("_had"))  # at most the companies of a tender
    open_ = tenders.select(F.col("id").alias("tender_id")).join(had, "tender_id", "left")
    pairs = open_.crossJoin(firms).where(~F.coalesce(F.array_contains("_had", F.col("company_id")), F.lit(False)))
    return pairs.select("tender_id", "company_id")


def pair_delta(tenders_before: DataFrame, tenders_after: DataFrame, firms_before: DataFrame, firms_after: DataFrame) -> DataFrame:
    """(tender_id, company_id, change) of the pairs that differ between two snapshots; no other pair is formed.

    change: ``new`` for a new tender or a company that wasn't active before, ``changed`` for a company whose fingerprint is
    another. tenders: id, filtered as for ``candidate_pairs``; firms: company_id, is_active, fingerprint (null: none).
    Tenders and companies are compared by id first, so what is multiplied is new tenders with companies and changed
    companies with the other tenders.
    """
    ids = tenders_after.select(F.col("id").alias("tender_id"))
    seen = tenders_before.select(F.col("id").alias("tender_id"))
    had = firms_before.where("is_active").select("company_id", F.lit(True).alias("_had"), F.col("fingerprint").alias("_fingerprint"))
    firms = firms_after.where("is_active").join(had, "company_id", "left")
    change = F.when(F.col("_had").isNull(), "new").when(~F.col("fingerprint").eqNullSafe(F.col("_fingerprint")), "changed")
    firms = firms.select("company_id", change.alias("change"))
    fresh = ids.join(seen, "tender_id", "left_anti").crossJoin(firms.select("company_id")).withColumn("change", F.lit("new"))
    return fresh.unionByName(ids.join(seen, "tender_id", "left_semi").crossJoin(firms.where("change is not null")))


def new_candidates(delta: DataFrame, existing: DataFrame) -> DataFrame:
    """``candidate_pairs`` of the snapshot after, given that all pairs of the one before have jobs in ``existing``."""
    return delta.where("change = 'new'").select("tender_id", "company_id").join(existing, ["tender_id", "company_id"], "left_anti")


def stale_delta(delta: DataFrame, tenders: DataFrame, firms: DataFrame, matches: DataFrame, version: str) -> DataFrame:
    """(tender_id, company_id, cache_key): ``stale_matches`` over all pairs of the snapshot after, by its ``pair_delta`` and the matches that failed before.

    matches: tender_id, company_id, cache_key, fit_score of every pair of the snapshot before; firms: as for ``pair_delta``.
    """
    live = firms.where("is_active").select("company_id", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))
    failed = matches.where("fit_score <= 0").select("tender_id", "company_id").join(tenders.select(F.col("id").alias("tender_id")), "tender_id", "left_semi")
    rows = delta.select("tender_id", "company_id").unionByName(failed).distinct().join(live, "company_id")
    key = S.match_cache_key(F.col("tender_id"), F.col("company_id"), F.col("fingerprint"), version)
    return stale_matches(rows.select("tender_id", "company_id", key.alias("cache_key")), matches)


def kbli_matches(tenders: DataFrame, profile: DataFrame) -> DataFrame:
    """(tender_id, company_id) where the tender's code is one of the company's; profile: company_id, codes."""
    codes = profile.select("company_id", F.explode("codes").alias("kbli_code")).where("kbli_code != ''")
    return tenders.select(F.col("id").alias("tender_id"), "kbli_code").join(codes, "kbli_code").select("tender_id", "company_id")


def kbli_match_counts(tenders: DataFrame, profile: DataFrame) -> DataFrame:
    """(company_id, n): how many tenders match, counted by code before companies are joined."""
    of_code = tenders.where("kbli_code != ''").groupBy("kbli_code").agg(F.count(F.lit(1)).alias("n"))
    codes = profile.select("company_id", F.explode("codes").alias("kbli_code"))
    return codes.join(of_code, "kbli_code").groupBy("company_id").agg(F.sum("n").alias("n"))


def matched_tenders(tenders: DataFrame, matches: DataFrame) -> DataFrame:
    return tenders.join(matches.select(F.col("tender_id").alias("id")), "id", "left_semi")


def stale_matches(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """Pairs without a good match under their current cache_key."""
    good = matches.where("fit_score > 0").select("cache_key")
    return pairs.join(good, "cache_key", "left_anti")


def tender_winner(tenders: DataFrame, winners: DataFrame) -> DataFrame:
    """Each tender with all that is stored of its winner, whose name is winner_name, and whether there is one."""
    w = winners.withColumnsRenamed({"tender_id": "id", "company_name": "winner_name"})
    return tenders.select("id").join(w, "id", "left").withColumn("status", F.when(F.col("winner_name").isNull(), "not_available").otherwise("ok"))


def tender_competition(tenders: DataFrame, participants: DataFrame) -> DataFrame:
    """Number of bidders (null if none are known) and their names in order."""
    bids = participants.groupBy("tender_id").agg(F.sort_array(F.collect_list("name")).alias("names"))
    joined = tenders.select("id", "peserta_count").join(bids.withColumnRenamed("tender_id", "id"), "id", "left")
    known = F.col("peserta_count") > 0
    return joined.select("id", F.when(known, F.col("peserta_count")).alias("bidders"), F.when(known, "ok").otherwise("not_available").alias("status"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def listing(rows: DataFrame, tenders: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows with (tender_id, company_id) plus names of the tender, cut to 80 characters, and of the company."""
    t = tenders.select(F.col("id").alias("tender_id"), F.substring("nama_paket", 1, 80).alias("tender_name"))
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    return rows.join(t, "tender_id").join(c, "company_id")


def submission_listing(submissions: DataFrame, tenders: DataFrame, companies: DataFrame) -> DataFrame:
    """Submissions with names, the tender's value, and their status under its title; notes and updated_by if there are any."""
    values = tenders.select(F.col("id").alias("tender_id"), F.coalesce("hps", F.lit(0)).alias("tender_hps"))
    title = reduce(lambda c, x: c.when(F.col("status") == x[0], x[1]), K.SUBMISSION_TITLES.items(), F.when(F.lit(False), "")).otherwise(F.col("status"))
    rows = listing(submissions, tenders, companies).join(values, "tender_id").withColumn("status_display", title)
    extra = [c for c in ("id", "notes", "updated_by") if c in submissions.columns]
    return rows.select(*extra, "tender_id", "tender_name", "tender_hps", "company_id", "company_name", "status", "status_display", "updated_at")


#: What a match of an earlier version lacks; None is an empty list.
MATCH_DEFAULTS = {"eligibility_status": "ELIGIBLE", "mandatory_passed": True, "matcher_version": "v0.2", "blockers": None, "missing_requirements": None, "recommended_actions": None}


def match_listing(matches: DataFrame, tenders: DataFrame, companies: DataFrame) -> DataFrame:
    """Matches with names; what a match lacks has its default."""
    rows = matches
    for name, plain in MATCH_DEFAULTS.items():
        value = F.array().cast("array<string>") if plain is None else F.lit(plain)
        rows = rows.withColumn(name, F.coalesce(name, value) if name in matches.columns else value)
    named = listing(rows, tenders, companies)
    extra = [c for c in ("id", "summary", "criteria", "llm_provider", "llm_model", "created_at") if c in matches.columns]
    return named.select("tender_id", "tender_name", "company_id", "company_name", "fit_score", *MATCH_DEFAULTS, *extra)


def watchlist_listing(watchlist: DataFrame, tenders: DataFrame, companies: DataFrame, as_of: Column) -> DataFrame:
    dates = tenders.select(F.col("id").alias("tender_id"), S.deadline_first_match(F.col("jadwal")).alias("deadline"))
    rows = listing(watchlist, tenders, companies).join(dates, "tender_id", "left").withColumn("days_left", S.days_left(F.col("deadline"), as_of))
    return rows.withColumn("urgency", F.coalesce(S.urgency(F.col("days_left")), F.lit("")))


def winner_flag(participants: DataFrame, winners: DataFrame) -> DataFrame:
    """Adds is_winner: same company, same normalised name, or equal or fitting masked tax number as the tender's winner."""
    w = winners.select("tender_id", F.col("company_id").alias("_id"), S.normalize_company_name(F.col("company_name")).alias("_name"), F.col("npwp").alias("_npwp"))
    own = S.normalize_company_name(F.col("name"))
    same = (F.col("company_id") == F.col("_id")) | ((own == F.col("_name")) & (own != "")) | (S.normalize_npwp(F.col("npwp")) == S.normalize_npwp(F.col("_npwp"))) | S.matches_masked_npwp(F.col("npwp"), F.col("_npwp"))
    return participants.join(w, "tender_id", "left").withColumn("is_winner", F.coalesce(same, F.lit(False))).select(*participants.columns, "is_winner")


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key by ``order``."""
    last = Window.partitionBy(*keys).orderBy(*(c.desc_nulls_last() for c in order))
    return df.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place")
