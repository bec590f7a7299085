"""Column functions: parsing and normalising text cells. All built-in expressions; blanks and nulls count alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderlake.functions import keywords as K


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(F.trim(c)) > 0, c)


def contains_any(c: Column, words) -> Column:
    """Whether the lower-cased text holds one of the words as a part."""
    pattern = "|".join(r"\Q" + w + r"\E" for w in words)
    return F.lower(text(c)).rlike(pattern)


def clean_cell(c: Column, max_len: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(text(c), "<[^>]+>", "")), 1, max_len)


def parse_hps(c: Column, rp_compat: bool = True) -> Column:
    """Rupiah of a listing cell such as '660,9 M'. Values that start with Rp lose their comma if ``rp_compat``."""
    raw = F.trim(text(c))
    number = F.regexp_extract(raw, r"^([\d.,]+)\s*(?i:M|jt|Miliar|Juta|Rb|Ribu)?", 1)
    suffix = F.lower(F.regexp_extract(raw, r"^[\d.,]+\s*((?i)M|jt|Miliar|Juta|Rb|Ribu)?", 1))
    value = F.replace(F.replace(number, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    unit = F.when(suffix.isin("m", "miliar"), 1_000_000_000).when(suffix.isin("jt", "juta"), 1_000_000).when(suffix.isin("rb", "ribu"), 1_000).otherwise(1)
    digits = F.trim(F.regexp_replace(raw, r"Rp|[.,\s]", ""))
    other = F.when(digits.rlike(r"^\d+$"), digits.try_cast("long")) if rp_compat else parse_money(c)
    return F.coalesce(F.when(number != "", (value * unit).try_cast("long")).otherwise(other), F.lit(0).cast("long"))


def parse_money(c: Column) -> Column:
    """855800811 of 'Rp. 855.800.811,31'; of the number it starts with, whatever follows; null if there is none."""
    raw = F.trim(F.regexp_replace(text(c), r"(?i)^rp\.?\s*", ""))
    number = F.replace(F.replace(F.regexp_extract(raw, r"^[\d.,]+", 0), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(number.rlike(r"^(\d+\.?\d*|\.\d+)$"), number.try_cast("double").try_cast("long"))


def parse_harga(c: Column) -> Column:
    digits = F.regexp_replace(text(c), r"[.,\s]|Rp", "")
    return F.coalesce(F.when(digits.rlike(r"^\d+$"), digits.try_cast("long")), F.lit(0).cast("long"))


def parse_tender_date(c: Column) -> Column:
    """The first of five formats that fits; English month names; null otherwise."""
    raw = F.trim(c)
    return F.coalesce(*(F.try_to_timestamp(raw, F.lit(f)) for f in ("d-M-yyyy", "yyyy-M-d", "d/M/yyyy", "d MMM yyyy", "d MMMM yyyy"))).cast("date")


def _dated(jadwal: Column, date) -> Column:
    """Entries of a schedule that have a date, with the negated place, so that a maximum prefers the first."""
    found = F.transform(jadwal, lambda x, i: F.struct(date(x).alias("date"), (-i).alias("place"), x["tahap"].alias("tahap")))
    return F.filter(found, lambda x: x["date"].isNotNull())


def _end(x: Column) -> Column:
    return parse_tender_date(x["sampai"])


def _first_tier(x: Column) -> Column:
    return contains_any(x["tahap"], K.DEADLINE_FIRST)


def _second_tier(x: Column) -> Column:
    return contains_any(x["tahap"], K.DEADLINE_SECOND)


def submission_deadline(jadwal: Column) -> Column:
    """struct(date, tahap): the latest date of the best tier, the first entry of that date."""
    dated = _dated(jadwal, _end)
    best = F.coalesce(F.array_max(F.filter(dated, _first_tier)), F.array_max(F.filter(dated, lambda x: _second_tier(x) & ~_first_tier(x))), F.array_max(dated))
    return F.struct(best["date"].alias("date"), best["tahap"].alias("tahap"))


def deadline_first_match(jadwal: Column) -> Column:
    """The dashboard's: the first entry of either tier in order, else the latest date."""
    dated = _dated(jadwal, _end)
    return F.coalesce(F.get(F.filter(dated, lambda x: _first_tier(x) | _second_tier(x)), F.lit(0))["date"], F.array_max(F.transform(dated, lambda x: x["date"])))


def deadline_latest(jadwal: Column) -> Column:
    """Eligibility's: the latest of all ends, or beginnings where there is no end; numeric formats only."""

    def date(x: Column) -> Column:
        raw = F.coalesce(blank_to_null(x["sampai"]), x["mulai"])
        return F.coalesce(*(F.try_to_timestamp(raw, F.lit(f)) for f in ("d-M-yyyy", "yyyy-M-d", "d/M/yyyy"))).cast("date")

    return F.array_max(F.transform(jadwal, date))


def days_left(deadline: Column, as_of: Column) -> Column:
    return F.datediff(deadline, as_of)


def urgency(days: Column) -> Column:
    return F.when(days < 0, "overdue").when(days <= 3, "urgent").when(days <= 7, "warning").otherwise("")


def hps_bucket(hps: Column) -> Column:
    return reduce(lambda c, x: c.when((hps >= x[1][0]) & (F.lit(x[1][1] is None) | (hps <= F.lit(x[1][1]))), x[0]), K.HPS_RANGES.items(), F.when(F.lit(False), ""))


def format_hps_short(hps: Column) -> Column:
    def scaled(unit: int, name: str) -> Column:
        value = hps / unit
        return F.when(hps % unit == 0, F.concat((hps / unit).cast("long").cast("string"), F.lit(f" {name}"))).otherwise(F.concat(F.replace(F.format_number(F.bround(value, 1), 1), F.lit(","), F.lit(".")), F.lit(f" {name}")))

    return (
        F.when(hps >= 1_000_000_000, scaled(1_000_000_000, "M"))
        .when(hps >= 1_000_000, scaled(1_000_000, "Jt"))
        .when(hps >= 1_000, F.concat(F.replace(F.format_number(F.bround(hps / 1_000), 0), F.lit(","), F.lit(".")), F.lit(" Rb")))
        .otherwise(hps.cast("string"))
    )


def normalize_tahap(c: Column) -> Column:
    lower = F.replace(F.lower(F.trim(text(c))), F.lit("[...]"), F.lit(""))
    return F.trim(F.regexp_replace(lower, r"\s+", " "))


def normalize_npwp(c: Column) -> Column:
    """Digits only; null if there is none, a letter or a mask."""
    raw = F.trim(text(c))
    digits = F.regexp_replace(raw, r"\D", "")
    return F.when(~raw.rlike(r"[\p{L}*xX#]") & (digits != ""), digits)


def normalize_identifier(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(text(c))), r"[\s.\-/]+", ""), F.lit(""))


def normalize_company_name(c: Column) -> Column:
    """Without legal form, listing words, punctuation and double blanks."""
    return F.trim(reduce(lambda s, step: F.regexp_replace(s, *step), K.COMPANY_NAME_STEPS, F.lower(F.trim(text(c)))))


def matches_masked_npwp(masked: Column, full: Column) -> Column:
    """Whether every digit that isn't masked fits, at least three; a 15-digit number also fits its 16 digits with a leading 0."""
    m, f = (F.regexp_replace(F.trim(text(c)), r"[\s.\-/]+", "") for c in (masked, full))
    as_pattern = lambda s: F.translate(s, "*xX#", "____")

    def fits(a: Column, b: Column) -> Column:
        shown = F.regexp_replace(a, r"[*xX#]", "")
        return (F.length(a) == F.length(b)) & F.like(b, as_pattern(a)) & shown.rlike(r"^\d{3,}$")

    later = (F.length(m) == 15) & (F.length(f) == 16) & f.startswith("0") & fits(m, F.substring(f, 2, 15))
    earlier = (F.length(m) == 16) & (F.length(f) == 15) & m.startswith("0") & fits(F.substring(m, 2, 15), f)
    return m.rlike(r"[*xX#]") & (fits(m, f) | later | earlier)


def mask_identifier(c: Column) -> Column:
    raw = text(c)
    n = F.length(raw)
    return F.when(n == 0, "(empty)").when(n <= 4, "****").otherwise(F.concat(F.substring(raw, 1, 2), F.lit("****"), F.substring(raw, -2, 2)))


def extract_kbli_code(html: Column) -> Column:
    """A target code: behind a keyword; near one (100 characters before to 500 behind); anywhere, in order of the list; else ''.

    Of the codes near keywords the first one near the first keyword counts.
    """
    html = text(html)
    known = F.array(*map(F.lit, K.KBLI_TARGETS))
    keyed = F.transform(F.regexp_extract_all(html, F.lit(K.KBLI_BEHIND), F.lit(1)), lambda x: F.regexp_replace(x, r"[.\s]", ""))
    first = lambda codes: F.get(F.filter(codes, lambda x: F.array_contains(known, x)), F.lit(0))
    # What stands before and behind each keyword, none of it used up, so that keywords may be near each other. Looking back takes
    # thousands of steps, so it is done at keywords only, and only in texts that hold a code.
    before = F.regexp_extract_all(html, F.lit(rf"(?is)(?={K.KBLI_NEAR})(?<=(\A.{{0,99}}|.{{100}})){K.KBLI_NEAR}"), F.lit(1))
    behind = F.regexp_extract_all(html, F.lit(rf"(?is){K.KBLI_NEAR}(?=(.{{0,500}}))"), F.lit(1))
    near = F.zip_with(before, behind, lambda a, b: F.regexp_extract_all(F.concat(a, F.lit("|"), b), F.lit(r"(62\d{3})"), F.lit(1)))
    anywhere = F.get(F.filter(known, lambda x: F.contains(html, x)), F.lit(0))
    return F.coalesce(first(keyed), F.when(anywhere.isNotNull(), first(F.flatten(near))), anywhere, F.lit(""))


def kbli_description(code: Column) -> Column:
    return F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*(F.lit(x) for kv in K.KBLI_TARGETS.items() for x in kv)), lambda k, v: k == code)), F.lit(0)), F.lit(""))


def extract_tahap(html: Column) -> Column:
    """The stage in a detail page, lower-cased, by the first of four shapes that gives text; else ''."""
    return F.lower(F.coalesce(*(F.nullif(F.trim(F.replace(F.regexp_extract(text(html), s, 1), F.lit("&nbsp;"), F.lit(" "))), F.lit("")) for s in K.STAGE_SHAPES), F.lit("")))


def extract_budget_year(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text(c), r"(\d{4})", 1), F.lit("")), text(c))


def tender_url(base: Column, kode: Column, id: Column, page: str) -> Column:
    """Address of a tender's page under a portal: announcement, schedule, bidders, results or winner."""
    path = {"pengumuman": "lelang/{}/pengumumanlelang", "jadwal": "lelang/{}/jadwal", "peserta": "lelang/{}/peserta", "hasil": "evaluasi/{}/hasil", "pemenang": "evaluasi/{}/pemenang"}[page]
    before, after = path.split("{}")
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), kode, F.lit(f"/{before}"), id, F.lit(after))


def requirement_text(syarat: Column, requirement: Column, *fields: Column) -> Column:
    """For matching: the conditions, else the requirement if it is over 20 characters, else the tender's own fields."""
    return F.coalesce(blank_to_null(syarat), F.when(F.length(F.trim(requirement)) > 20, requirement), F.concat_ws(" ", *map(blank_to_null, fields)))


def usable_text(requirement: Column, syarat: Column, name: Column) -> Column:
    """For eligibility: the first with at least 10 characters, trimmed; else null."""
    return F.coalesce(*(F.when(F.length(F.trim(text(c))) >= 10, F.trim(c)) for c in (requirement, syarat, name)))


def _phrases(name: Column, words) -> Column:
    pattern = r"(?U)(?:^|\b|\s)(" + "|".join(_escaped(w) for w in words) + r")(?:\b|\s|$)"
    return F.array_distinct(F.transform(F.regexp_extract_all(name, F.lit(pattern), F.lit(1)), lambda x: F.trim(x)))


def _escaped(phrase: str) -> str:
    return r"\s+".join(r"\Q" + w + r"\E" for w in phrase.split(" "))


def it_priority(kbli: Column, name: Column, active_codes: Column) -> Column:
    """struct(is_it, score, keywords, reason): an active code, else IT phrases, else phrases of other trades, else nothing."""
    lower, none = F.lower(F.trim(text(name))), F.array().cast("array<string>")
    codes = F.when(F.size(active_codes) > 0, active_codes).otherwise(F.array(*map(F.lit, K.KBLI_TARGETS)))
    it, out = _phrases(lower, K.IT_PHRASES), _phrases(lower, K.EXCLUSION_PHRASES)
    result = lambda flag, score, words, reason: F.struct(F.lit(flag).alias("is_it"), F.lit(score).alias("score"), words.alias("keywords"), reason.alias("reason"))
    listed = lambda title, words: F.concat(F.lit(title), F.array_join(F.slice(words, 1, 3), ", "))
    return (
        F.when(F.array_contains(codes, text(kbli)), result(True, 100, F.array(text(kbli)), F.concat(F.lit("KBLI "), text(kbli), F.lit(" (IT)"))))
        .when(F.size(it) > 0, result(True, 80, it, listed("IT keywords: ", it)))
        .when(F.size(out) > 0, result(False, 0, out, listed("Exclusion: ", out)))
        .otherwise(result(False, 0, none, F.lit("")))
    )


def tokenize(c: Column, stop_words=K.STOP_WORDS) -> Column:
    """Lower-cased words of two letters or more without stop words, repeats kept."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(c)), r"(?U)[^\w\s]", " "), r"\s+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop_words) if stop_words else F.length(w) > 1)


def validate_match_response(raw: Column) -> Column:
    """A match model's reply as struct(eligibility_status, mandatory_passed, fit_score, blockers, missing_requirements, recommended_actions, summary, criteria).

    The reply is JSON, in a code fence or not, or else what stands between its outermost braces. What it lacks gets
    defaults, scores are held to 0 to 100, unknown words are replaced. A reply without an object or with a score that is no
    number gives the fallback: NOT_READY, 0.
    """
    return _let(F.regexp_replace(text(raw), r"^\s+|\s+$", ""), lambda trimmed: _let(_unfenced(trimmed), _validated_json))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _unfenced(trimmed: Column) -> Column:
    def inner(rows: Column) -> Column:
        closed = F.trim(F.element_at(rows, -1)) == "```"
        return F.array_join(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - F.when(closed, 2).otherwise(1), F.lit(0))), "\n")

    return F.when(trimmed.startswith("```"), _let(F.split(trimmed, "\n"), inner)).otherwise(trimmed)


def _validated_json(cleaned: Column) -> Column:
    string = lambda v, key: F.try_variant_get(v, f"$.{key}", "string")
    is_object = lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    true = lambda shown: ~shown.isin("", "false", "0", "0.0", "[]", "{}")  # noqa: E731  as conditions go in the replies' language

    def criterion(c: Column) -> Column:
        known = string(c, "status")
        return F.struct(
            F.trim(F.coalesce(string(c, "requirement"), F.lit(""))).alias("requirement"), F.upper(F.coalesce(string(c, "category"), F.lit("LEGAL"))).alias("category"),
            F.coalesce(true(string(c, "mandatory")), F.lit(False)).alias("mandatory"), F.when(known.isin("pass", "needs_action", "fail"), known).otherwise("needs_action").alias("status"),
            F.coalesce(string(c, "evidence"), F.lit("")).alias("evidence"), string(c, "action").alias("action"),
        )

    def found(parsed: Column, number: Column) -> Column:
        items = lambda key: F.coalesce(F.try_variant_get(parsed, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))
        listed = lambda key: F.filter(F.transform(items(key), lambda v: F.try_variant_get(v, "$", "string")), lambda x: x.isNotNull() & true(x))
        score = F.greatest(F.lit(0), F.least(F.lit(100), number.try_cast("int")))
        known = lambda given: F.when(given.isin(*K.ELIGIBILITY), given).when(score >= 70, "ELIGIBLE").otherwise("CONDITIONALLY_ELIGIBLE")
        has = lambda v, key: F.try_variant_get(v, f"$.{key}", "variant").isNotNull()
        passed = lambda status: F.when(has(parsed, "mandatory_passed"), F.coalesce(true(string(parsed, "mandatory_passed")), F.lit(False))).otherwise(status != "NOT_ELIGIBLE")
        criteria = F.filter(F.transform(F.filter(items("criteria"), is_object), criterion), lambda c: c["requirement"] != "")
        status = _let(F.upper(F.coalesce(string(parsed, "eligibility_status"), F.lit(""))), known)
        return _let(status, lambda status: F.struct(
            status.alias("eligibility_status"), passed(status).alias("mandatory_passed"), score.alias("fit_score"), listed("blockers").alias("blockers"), listed("missing_requirements").alias("missing_requirements"),
            listed("recommended_actions").alias("recommended_actions"), F.coalesce(string(parsed, "summary"), F.lit("")).alias("summary"), criteria.alias("criteria"),
        ))

    failed, none = "Gagal mem-parse respons AI.", F.array().cast("array<string>")
    kind = "array<struct<requirement:string,category:string,mandatory:boolean,status:string,evidence:string,action:string>>"
    fallback = F.struct(
        F.lit("NOT_READY").alias("eligibility_status"), F.lit(False).alias("mandatory_passed"), F.lit(0).alias("fit_score"), F.array(F.lit(failed)).alias("blockers"), none.alias("missing_requirements"),
        F.array(F.lit("Jalankan analisis ulang.")).alias("recommended_actions"), F.lit(failed).alias("summary"), F.array().cast(kind).alias("criteria"),
    )

    def checked(parsed: Column) -> Column:
        number = F.coalesce(string(parsed, "fit_score"), F.lit("0")).try_cast("double")
        return _let(number, lambda number: F.when(is_object(parsed) & number.isNotNull(), found(parsed, number)).otherwise(fallback))

    return _let(F.coalesce(F.try_parse_json(cleaned), F.try_parse_json(F.regexp_extract(cleaned, r"(?s)\{.*\}", 0))), checked)


def match_cache_key(tender_id: Column, company_id: Column, fingerprint: Column, version: str) -> Column:
    return F.sha2(F.concat_ws(":", tender_id.cast("string"), company_id.cast("string"), fingerprint, F.lit(version)), 256)


def sanitize_error(c: Column) -> Column:
    return F.when(contains_any(c, K.SECRET_MARKS), "provider_error").otherwise(F.substring(text(c), 1, 2000))


def is_failed_note(c: Column) -> Column:
    return contains_any(c, K.FAILED_NOTE)
