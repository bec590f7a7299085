"""Company profiles, matching, opportunity scores, radar and recommendations: over all pairs at once."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.functions import keywords as K
from tenderlake.functions import predicates as P
from tenderlake.functions import scalars as S


def company_profile(companies: DataFrame, quals: DataFrame) -> DataFrame:
    """Per company: codes, has_izin, has_sbu, has_sdm, experience, complete, of its active qualifications."""
    active = quals.where("status = 'active'")
    full = (F.col("category") == "pengalaman_kerja") & (S.text("project_name") != "") & (S.text("client_name") != "") & (F.coalesce("project_year", F.lit(0)) != 0) & (F.coalesce("value_amount", F.lit(0)) != 0)
    found = active.groupBy("company_id").agg(
        F.array_sort(F.filter(F.array_distinct(F.transform(F.flatten(F.collect_list(F.concat("kbli_codes", F.array("kbli_code")))), lambda c: F.trim(c))), lambda c: c != "")).alias("codes"),
        *(F.bool_or(F.col("category") == c).alias(n) for n, c in (("has_izin", "izin_usaha"), ("has_sbu", "sbu"), ("has_sdm", "sdm"))),
        F.count_if(F.col("category") == "pengalaman_kerja").alias("experience"), F.count_if(full).alias("complete"), F.count(F.lit(1)).alias("qualifications"),
    )
    no = F.lit(False)
    return companies.join(found.withColumnRenamed("company_id", "id"), "id", "left").select(
        F.col("id").alias("company_id"), "nib", "npwp", "penghasilan", "modal", "is_active", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"),
        *(F.coalesce(c, no).alias(c) for c in ("has_izin", "has_sbu", "has_sdm")), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("experience", "complete", "qualifications")),
    )


#: What is said of a qualification, besides the id that orders them. The names are keys of the JSON that is matched.
FINGERPRINTED = (
    "category", "name", "number", "kbli_code", "kbli_codes", "details", "klasifikasi_usaha", "value_amount", "project_name", "client_name", "project_year", "valid_from", "valid_until", "status",
)


def _as_json(quals: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(company_id, json): active qualifications in order of id, fields in order of name, map entries in order of key, nulls said."""
    kinds = dict(quals.dtypes)
    in_order = {n: F.map_from_entries(F.array_sort(F.map_entries(c))) if kinds.get(n, "").startswith("map") else c for n, c in fields.items()}
    said = F.to_json(F.struct(*(in_order[n].alias(n) for n in sorted(in_order))), {"ignoreNullFields": "false"})
    listed = quals.where("status = 'active'").groupBy("company_id").agg(F.sort_array(F.collect_list(F.struct("id", said.alias("said")))).alias("items"))
    return listed.select("company_id", F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["said"]), ","), F.lit("]")).alias("json"))


def qualification_fingerprint(quals: DataFrame, fields: tuple[str, ...] = FINGERPRINTED) -> DataFrame:
    """(company_id, fingerprint): a hash of a company's active qualifications, which changes when any of them does."""
    return _as_json(quals, {n: F.col(n) for n in fields}).select("company_id", F.sha2("json", 256).alias("fingerprint"))


def qualification_text(quals: DataFrame) -> DataFrame:
    """(company_id, text): what a company's text is matched by, the JSON of its active qualifications with its keys.

    Categories and classes are under their titles too, as the matcher reads them.
    """
    titled = lambda c, titles: F.coalesce(*(F.when(F.col(c) == k, v) for k, v in titles.items()), S.text(c))
    fields = {n: F.col(n) for n in FINGERPRINTED} | {"category": titled("category", K.CATEGORY_TITLES), "category_raw": F.col("category"), "klasifikasi_usaha": titled("klasifikasi_usaha", K.CLASS_TITLES)}
    return _as_json(quals, fields).select("company_id", F.col("json").alias("text"))


def required_gates(req: Column) -> Column:
    """struct(kbli or null, sbu, license, npwp): what a requirement text asks for."""
    lower = F.lower(S.text(req))
    code = F.coalesce(F.nullif(F.regexp_extract(lower, r"kbli[:\s]+([0-9]{5})", 1), F.lit("")), F.nullif(F.regexp_extract(S.text(req), r"(?U)\b((?:62|63|61|58|41|42|43)[0-9]{3})\b", 1), F.lit("")))
    asks = lambda words: lower.rlike(rf"(?U)\b({words})\b")
    return F.struct(code.alias("kbli"), asks("sbu|sertifikat badan usaha").alias("sbu"), asks("nib|nomor induk berusaha|izin usaha|siup|iujk").alias("license"), asks("npwp|nomor pokok wajib pajak|pajak").alias("npwp"))


def category_hits(tokens: Column) -> Column:
    """How many words of each of the five categories an array of tokens holds, in whole or in part of a token."""
    return F.array(*(reduce(Column.__add__, (F.coalesce(_holds(tokens, w), F.lit(False)).cast("int") for w in words)) for words in K.CATEGORY_WORDS.values()))


def keyword_category_score(req: Column, qual: Column) -> Column:
    """Mean over the five categories of the ratio of two ``category_hits``, of a requirement and a profile."""
    ratios = F.zip_with(req, qual, lambda r, q: F.when((r > 0) & (q > 0), F.least(r, q) / F.greatest(r, q)).otherwise(0.0))
    return F.aggregate(ratios, F.lit(0.0), lambda a, b: a + b) / len(K.CATEGORY_WORDS)


def _holds(tokens: Column, word: str) -> Column:
    return F.exists(tokens, lambda t: F.contains(t, F.lit(word)))


_DOCS = ["side", "id", "joined", "tokens"]


def _group_words(docs: pa.Table, words: pa.Array | None = None) -> tuple:
    """Of rows (side, id, joined, tokens): documents (ids, sides), texts (document, length), the texts' words as text * words + word with their numbers; last the words if none are given.

    Rows of one id are one document, and such rows of one length are one text.
    """
    tokens = pc.coalesce(pc.split_pattern(docs["joined"].combine_chunks(), "\n"), docs["tokens"].combine_chunks().cast(pa.list_(pa.string())))
    ids = docs["id"].combine_chunks().dictionary_encode(null_encoding="encode")
    lengths = tokens.value_lengths().to_numpy().astype(np.int64)
    if words is None:
        coded = tokens.flatten().dictionary_encode()
        words, code = coded.dictionary, coded.indices.fill_null(-1).to_numpy().astype(np.int64)
    else:
        code = pc.index_in(tokens.flatten(), value_set=words).fill_null(-1).to_numpy().astype(np.int64)
    document, row = np.unique(ids.indices.to_numpy() * 2 + docs["side"].to_numpy(), return_inverse=True)
    longest = lengths.max(initial=0) + 1
    texts, row = np.unique(row * longest + lengths, return_inverse=True)
    found, n = np.unique((np.repeat(row, lengths) * len(words) + code)[code >= 0], return_counts=True)
    return (ids.dictionary.take(pa.array(document // 2)), document % 2), (texts // longest, texts % longest), found, n, words


def _group_cosines(docs: pa.Table, words: pa.Table, near: float | None) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """left_id, right_id, cosine within one part: docs as of ``_group_words``, words (word, idf) in order. Sums are in order of words.

    With ``near`` only pairs that come so near to the best of their left document.
    """
    idf, document, texts, found, n = words["idf"].to_numpy(), *_group_words(docs, words["word"].combine_chunks())[:4]
    text, code = found // max(len(words), 1), found % max(len(words), 1)
    at, weight = texts[0][text], n / texts[1][text] * idf[code]
    weight /= np.sqrt(np.bincount(at, weight**2, len(document[1])))[at]
    ids, side = document
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    left, right = (np.flatnonzero((side == k) & known) for k in (0, 1))
    place = np.zeros(len(ids), np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    mine = np.flatnonzero(np.isin(at, left))
    mine = mine[np.argsort(code[mine], kind="stable")]
    first = np.searchsorted(code[mine], np.arange(len(words) + 1))
    other = np.flatnonzero(np.isin(at, right))
    other = other[np.argsort(at[other], kind="stable")]
    many = (first[1:] - first[:-1])[code[other]]
    other, many = other[many > 0], many[many > 0]
    costs = np.cumsum(np.bincount(place[at[other]], many, len(right)) + len(left)) // 4_000_000
    out, best, piece = [], np.zeros(len(left)), costs[place[at[other]]]
    for k in np.unique(piece):  # documents of some millions of products and sums
        begin, end = np.searchsorted(piece, [k, k + 1])
        own, times = other[begin:end], many[begin:end]
        ends = np.cumsum(times)
        met = mine[np.repeat(first[code[own]] - (ends - times), times) + np.arange(ends[-1])]
        base = place[at[own[0]]]
        sums = np.bincount((np.repeat(place[at[own]], times) - base) * len(left) + place[at[met]], np.repeat(weight[own], times) * weight[met])
        pairs = np.flatnonzero(sums)
        one, two, cosine = pairs % len(left), pairs // len(left) + base, sums[pairs]
        if near is not None:
            np.maximum.at(best, one, cosine)
            keep = cosine >= best[one] - near
            one, two, cosine = one[keep], two[keep], cosine[keep]
        out.append((one, two, cosine))
    one, two, cosine = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    if near is not None:
        keep = cosine >= best[one] - near
        one, two, cosine = one[keep], two[keep], cosine[keep]
    return ids.take(pa.array(left[one])), ids.take(pa.array(right[two])), cosine


def _cosines(left: DataFrame, right: DataFrame, near: float | None = None, block: int = 10_000, part_words: int = 1_000_000) -> DataFrame:
    """(left_id, right_id, cosine) of all pairs of (id, tokens) rows with a common word of idf above 0, or of those ``near`` the best of their part.

    Right documents are dealt to parts of about ``part_words`` words, and each part gets the idf of its own words and the left
    documents, ``block`` of them at a time. So a document's weights and products are made where it is: neither
    words of documents nor products of posting lists go through a shuffle. In Python, as Spark has no sparse vectors.
    """
    joined = F.array_join("tokens", "\n")
    whole = F.length(joined) - F.length(F.replace(joined, F.lit("\n"), F.lit(""))) == F.size("tokens") - 1

    def rows(df: DataFrame, side: int) -> DataFrame:
        """Words as one text, which takes a third of an array's bytes, unless a line feed or null is among them."""
        found = df.where(F.size("tokens") > 0).withColumn("joined", F.when(whole, joined))
        return found.select(F.lit(side).alias("side"), "id", "joined", F.when(F.col("joined").isNull(), F.col("tokens")).alias("tokens"), F.size("tokens").alias("length"))

    right, left = rows(right, 1), rows(left, 0)
    kind = dict(right.union(left).dtypes)["id"]
    total, lefts, words = right.union(left).agg(F.count(F.lit(1)), F.count_if(F.col("side") == 0), F.coalesce(F.sum("length"), F.lit(0))).first()  # one row
    parts, blocks = max(1, -(-words // part_words)), max(1, -(-lefts // block))
    right, left = (df.withColumn("id", F.col("id").cast(kind)).drop("length") for df in (right, left))
    dealt = right.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).repartition("part")

    def counted(df: DataFrame) -> DataFrame:
        """In how many documents of a part its words are: a row for each part and ``bucket`` of words, as Spark takes its time with each row."""

        def run(docs: pa.Table) -> pa.Table:
            *_, found, _, words = _group_words(docs)
            n = np.bincount(found % max(len(words), 1), minlength=len(words))
            bucket = (hash_array(words.to_numpy(zero_copy_only=False), categorize=False) % parts).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            kept, first = np.unique(bucket[order], return_index=True)
            bounds = pa.array([*first, len(words)], pa.int32())
            lists = (pa.ListArray.from_arrays(bounds, x.take(pa.array(order))) for x in (words, pa.array(n)))
            return pa.table(dict(zip(("bucket", "part", "words", "n"), (pa.array(kept, pa.int32()), pa.repeat(docs["part"][0], len(kept)), *lists))))

        return df.groupBy("part").applyInArrow(run, "bucket int, part int, words array<string>, n array<long>")

    everywhere, met_here = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), -(2**31)
    home = left.withColumn("part", -1 - F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))

    def known_of(rows: pa.Table) -> pa.Table:
        """Of a bucket's counts the idf of its words, for each part that has them; those of the left documents that meet for all."""
        part, lists = rows["part"].to_numpy(), rows["words"].combine_chunks()
        coded = lists.flatten().dictionary_encode()
        code, from_, words = coded.indices.to_numpy(), np.repeat(part, lists.value_lengths().to_numpy()), coded.dictionary
        of = np.bincount(code, np.where(from_ == met_here, 0, rows["n"].combine_chunks().flatten().to_numpy()), len(words))
        idf = np.log(total / of)
        of_all = code[from_ == met_here]
        chosen = {p: x[idf[x] > 0] for p in range(parts) if len(x := np.union1d(code[from_ == p], of_all))}
        bounds = pa.array(np.cumsum([0, *map(len, chosen.values())]), pa.int32())
        at = np.concatenate([*chosen.values(), np.zeros(0, np.int64)]).astype(np.int64)
        lists = (pa.ListArray.from_arrays(bounds, x.take(pa.array(at))) for x in (words, pa.array(idf)))
        return pa.table(dict(zip(("part", "words", "idf"), (pa.array(list(chosen), pa.int32()), *lists))))

    def met(i: int) -> DataFrame:
        own = left.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)) == i)
        counts = counted(dealt).union(counted(home)).union(counted(own.withColumn("part", F.lit(met_here))))
        known = counts.groupBy("bucket").applyInArrow(known_of, "part int, words array<string>, idf array<double>")
        known = known.unionByName(own.select(everywhere, *_DOCS), allowMissingColumns=True)

        def run(docs: pa.Table, known: pa.Table) -> pa.Table:
            said = known["words"].is_valid()
            docs = pa.concat_tables([docs.select(_DOCS), known.filter(pc.invert(said)).select(_DOCS)])
            words = pa.table({"word": pc.list_flatten(known.filter(said)["words"]), "idf": pc.list_flatten(known.filter(said)["idf"])})
            return pa.table(dict(zip(("left_id", "right_id", "cosine"), _group_cosines(docs, words.sort_by("word"), near))))

        return dealt.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(run, f"left_id {kind}, right_id {kind}, cosine double")

    return reduce(DataFrame.union, map(met, range(blocks)))


def tfidf_cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, cosine) over a common corpus of (id, tokens) rows: tf = n / length, idf = ln(documents / df).

    Only pairs with a common word of idf above 0 come out. Pair-wise, with two documents as the corpus, the idf of a
    shared word is 0 and so is the cosine: that case needs no job.
    """
    return _cosines(left, right)


def tfidf_best(left: DataFrame, right: DataFrame, block: int = 10_000, digits: int = 9) -> DataFrame:
    """(left_id, right_id, cosine): for each left document the most similar right one, as of ``tfidf_cosine``; the smallest id among those equal in ``digits``.

    Of a part's pairs only those that could be equal to its best leave it.
    """
    scored = _cosines(left, right, 2 * 10.0**-digits, block).withColumn("cosine", F.round("cosine", digits))
    best = F.max_by(F.struct("right_id", "cosine"), F.struct("cosine", -F.col("right_id")))
    return scored.groupBy("left_id").agg(best.alias("b")).select("left_id", "b.*")


def tender_words(tenders: DataFrame, requirement: str = "requirement") -> DataFrame:
    """Adds what matching needs of a tender, once for all its pairs: gates, req_hits and sentences (first five that count)."""
    req = S.text(requirement)
    sentences = F.slice(F.filter(F.transform(F.split(req, r"[.\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 15), 1, 5)
    free = F.filter(sentences, lambda s: ~S.contains_any(s, K.GATE_WORDS))
    worded = F.transform(free, lambda s: F.struct(s.alias("sentence"), F.array_distinct(S.tokenize(s)).alias("words")))
    return tenders.withColumn("gates", required_gates(req)).withColumn("req_hits", category_hits(S.tokenize(req))).withColumn("sentences", worded)


def company_words(profiles: DataFrame, text: str) -> DataFrame:
    """Adds what matching needs of a company: its distinct tokens and qual_hits."""
    rows = profiles.withColumn("tokens", F.array_distinct(S.tokenize(F.col(text))))
    return rows.withColumn("qual_hits", category_hits(F.col("tokens"))).drop(text)


def requirement_flags(quals: DataFrame) -> DataFrame:
    """(company_id, says_sbu, says_izin, gate_sbu, gate_izin): what active qualifications say by category or name, for the matcher and for the hard gates."""
    category, name = F.lower(S.text("category")), F.lower(S.text("name"))
    holds = lambda *words: reduce(Column.__or__, (F.contains(c, F.lit(w)) for c in (category, name) for w in words))
    named = lambda *words: reduce(Column.__or__, (F.contains(name, F.lit(w)) for w in words))
    flags = {"says_sbu": holds("sbu", "badan usaha"), "says_izin": holds("izin", "nib", "siup"), "gate_sbu": (category == "sbu") | named("sbu", "sertifikat badan usaha"), "gate_izin": (category == "izin_usaha") | named("izin", "nib")}
    return quals.where("status = 'active'").groupBy("company_id").agg(*(F.bool_or(c).alias(n) for n, c in flags.items()))


CRITERION = "struct<requirement:string,category:string,mandatory:boolean,status:string,evidence:string,action:string>"


def _criterion(requirement, category, mandatory: bool, status, evidence, action) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = zip(("requirement", "category", "mandatory", "status", "evidence", "action"), (requirement, category, mandatory, status, evidence, action))
    return F.struct(*(as_column(v).alias(n) for n, v in values)).cast(CRITERION)


def _own_codes() -> Column:
    return F.coalesce(F.nullif(F.array_join(F.sort_array("codes"), ", "), F.lit("")), F.lit("tidak ada"))


def rule_match(pairs: DataFrame) -> DataFrame:
    """Adds status, fit_score, blockers, missing, actions, criteria and summary to pairs of ``tender_words`` and ``company_words`` rows.

    pairs also need codes, has_sbu, has_izin, nib, npwp, qualifications. The cosine of a pair is 0 (see ``tfidf_cosine``), so
    the soft score is 0.4 of the category score. The texts are fixed values.
    """
    gates, nib, npwp = F.col("gates"), F.trim(S.text("nib")), F.trim(S.text("npwp"))
    soft = F.lit(0.4) * keyword_category_score(F.col("req_hits"), F.col("qual_hits"))
    say = lambda *x: F.concat(*(y if isinstance(y, Column) else F.lit(y) for y in x))
    # asked, missing, criterion, category, evidence if there, evidence if missing, what to do, blocker, action
    checks = [
        (gates["kbli"].isNotNull(), ~F.array_contains("codes", gates["kbli"]), say("Kesesuaian KBLI (", gates["kbli"], ")"), "KBLI", say("KBLI ", gates["kbli"], " aktif terdaftar pada profil perusahaan."), say("Perusahaan memiliki KBLI: ", _own_codes(), "."),
         say("Tambahkan KBLI ", gates["kbli"], " pada profil perusahaan jika bidang usaha sesuai."), say("KBLI mismatch: Tender membutuhkan KBLI ", gates["kbli"], ", perusahaan tidak memilikinya."), say("Lengkapi KBLI ", gates["kbli"], " di profil perusahaan.")),
        (gates["sbu"], ~F.col("has_sbu"), "Kepemilikan SBU (Sertifikat Badan Usaha) aktif", "SBU", "Dokumen SBU aktif terdaftar pada profil kualifikasi.", "Tidak ada dokumen SBU tercatat pada profil perusahaan.",
         "Unggah dan verifikasi SBU yang sesuai dengan subklasifikasi tender.", F.lit("SBU tidak ditemukan pada profil perusahaan."), F.lit("Unggah dokumen SBU yang masih berlaku.")),
        (gates["license"], ~((F.length(nib) >= 5) | F.col("has_izin")), "Izin Usaha / NIB (Nomor Induk Berusaha) aktif", "BUSINESS_LICENSE", say("NIB ", nib, " / Izin Usaha aktif tercatat."), "NIB / Izin usaha tidak ditemukan pada profil perusahaan.",
         "Lengkapi NIB atau Izin Usaha perusahaan.", F.lit("NIB / Izin Usaha tidak ditemukan."), F.lit("Lengkapi data NIB dan Izin Usaha.")),
        (gates["npwp"], F.length(npwp) < 8, "Nomor Pokok Wajib Pajak (NPWP)", "FINANCIAL", say("NPWP ", npwp, " valid."), "NPWP perusahaan belum diisi atau tidak valid.",
         "Lengkapi nomor NPWP perusahaan di profil.", F.lit("NPWP perusahaan tidak tersedia."), F.lit("Lengkapi NPWP perusahaan.")),
    ]
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    hard = [F.when(asked, _criterion(title, kind, True, F.when(fails, "fail").otherwise("pass"), F.when(fails, as_column(bad)).otherwise(as_column(good)), F.when(fails, as_column(todo)))) for asked, fails, title, kind, good, bad, todo, _, _ in checks]
    blockers = F.array_compact(F.array(*(F.when(asked & fails, blocker) for asked, fails, *_, blocker, _ in checks)))
    actions = F.array_compact(F.array(*(F.when(asked & fails, action) for asked, fails, *_, action in checks)))
    shared = F.transform("sentences", lambda s: F.struct(s["sentence"].alias("sentence"), F.size(F.array_intersect(s["words"], F.col("tokens"))).alias("hits"), F.greatest(F.size(s["words"]), F.lit(1)).alias("of")))
    technical = lambda s: S.contains_any(s["sentence"], ("teknis", "sistem", "software", "alat", "metode"))
    met = lambda s, share: s["hits"] / s["of"] > share
    todo = lambda s: F.when(met(s, 0.1), "Periksa kesiapan dokumen teknis pendukung").otherwise("Perlu verifikasi dokumen pendukung sebelum penawaran")
    evidence = lambda s: F.when(s["hits"] > 0, say("Kesesuaian profil teknis: ", s["hits"].cast("string"), "/", s["of"].cast("string"), " istilah cocok.")).otherwise("Belum ditemukan bukti eksplisit.")
    rows = pairs.withColumn("_soft", soft).withColumn("_shared", shared)
    easy = F.transform("_shared", lambda s: _criterion(F.substring(s["sentence"], 1, 120), F.when(technical(s), "TECHNICAL").otherwise("EXPERIENCE"), False, F.when(met(s, 0.3), "pass").otherwise("needs_action"), evidence(s), F.when(~met(s, 0.3), todo(s))))
    missing = F.transform(F.filter("_shared", lambda s: ~met(s, 0.3)), lambda s: F.substring(s["sentence"], 1, 80))
    empty, none = (F.col("qualifications") == 0) & (F.length(nib) < 5), F.array().cast("array<string>")
    rows = rows.withColumn("blockers", F.when(empty, F.array(F.lit("Tidak ada data kualifikasi perusahaan."))).otherwise(blockers))
    rows = rows.withColumn("criteria", F.when(empty, F.array().cast(f"array<{CRITERION}>")).otherwise(F.concat(F.array_compact(F.array(*hard)), easy)))
    blocked = F.size("blockers") > 0
    score = F.when(empty, 0).when(blocked, F.least(F.lit(25), (F.col("_soft") * 25).cast("int"))).otherwise((50 + 50 * F.least(F.lit(1.0), F.col("_soft") * 2)).cast("int"))
    rows = rows.withColumn("status", F.when(empty, "NOT_READY").when(blocked, "NOT_ELIGIBLE").otherwise("ELIGIBLE")).withColumn("fit_score", score.cast("int"))
    default = F.when(F.col("status") == "ELIGIBLE", F.array(F.lit("Siapkan berkas penawaran."))).otherwise(F.array(F.lit("Penuhi kendala kualifikasi mutlak.")))
    actions = F.when(empty, F.array(F.lit("Lengkapi profil kualifikasi perusahaan."))).when(F.size(actions) > 0, actions).otherwise(default)
    summary = (
        F.when(empty, "Profil kualifikasi perusahaan belum diisi.")
        .when(blocked, say("Tidak memenuhi syarat mutlak (", F.size("blockers").cast("string"), " kendala fatal: ", F.array_join(F.slice("blockers", 1, 2), "; "), ")"))
        .otherwise(say("Memenuhi seluruh persyaratan kualifikasi tender (Skor Teknis: ", F.col("fit_score").cast("string"), "%)"))
    )
    return rows.withColumn("missing", F.when(empty, none).otherwise(missing)).withColumn("actions", actions).withColumn("summary", summary).drop("_soft", "_shared")


def _set_criterion(criteria: Column, category: str, new: Column, at: int) -> Column:
    """The first criterion of the category, or that names it, gets what ``new`` says but its own title; else ``new`` is put at a place."""
    found = F.array_position(F.transform(criteria, lambda c: (c["category"] == category) | F.contains(F.lower(c["requirement"]), F.lit(category.lower()))), True)
    replaced = F.transform(criteria, lambda c, i: F.when(i + 1 == found, F.struct(c["requirement"].alias("requirement"), c["category"].alias("category"), new["mandatory"].alias("mandatory"), new["status"].alias("status"), new["evidence"].alias("evidence"), new["action"].alias("action")).cast(CRITERION)).otherwise(c))
    put = F.concat(F.slice(criteria, 1, at), F.array(new), F.slice(criteria, at + 1, F.greatest(F.size(criteria) - at, F.lit(0))))
    return F.when(found > 0, replaced).otherwise(put)


def enforce_hard_gates(rows: DataFrame) -> DataFrame:
    """Holds any match against the gates anew: kbli_code, codes, has_sbu, has_izin, nib, qualifications, blockers, criteria, summary, fit_score.

    Also needs ``gates``, or else ``requirement`` to find them in. The company's flags are ``gate_sbu`` and ``gate_izin`` if
    there, else has_sbu and has_izin. The texts are fixed values.
    """
    gates = F.col("gates") if "gates" in rows.columns else required_gates(F.col("requirement"))
    sbu, izin = (F.col(f"gate_{n}") if f"gate_{n}" in rows.columns else F.col(f"has_{n}") for n in ("sbu", "izin"))
    has_nib = F.length(F.trim(S.text("nib"))) >= 5
    known = lambda word: F.exists("blockers", lambda b: F.contains(F.lower(b), F.lit(word)))
    say = lambda *x: F.concat(*(y if isinstance(y, Column) else F.lit(y) for y in x))
    code = F.trim(S.text("kbli_code"))
    no_code, no_sbu = (code != "") & ~F.array_contains("codes", code), gates["sbu"] & ~sbu
    added = F.array_compact(F.array(
        F.when(no_code & ~known("kbli mismatch"), say("KBLI mismatch: Tender mensyaratkan KBLI ", code, ", perusahaan tidak memilikinya.")),
        F.when(no_sbu & ~known("sbu"), "SBU tidak ditemukan pada profil perusahaan."), F.when(~has_nib & ~izin & ~known("izin") & ~known("nib"), "NIB / Izin Usaha tidak ditemukan pada profil perusahaan."),
    ))
    unready = (F.col("qualifications") == 0) & ~has_nib
    rows = rows.withColumn("_b", F.when(unready, F.array(F.lit("Tidak ada data kualifikasi perusahaan."))).otherwise(F.concat("blockers", added)))
    kbli = _criterion(say("Kesesuaian KBLI (", code, ")"), "KBLI", True, "fail", say("KBLI perusahaan: ", _own_codes()), say("Tambahkan KBLI ", code, " pada profil perusahaan jika bidang usaha sesuai."))
    paper = _criterion("Kepemilikan SBU (Sertifikat Badan Usaha) aktif", "SBU", True, "fail", "Tidak ada dokumen SBU aktif.", "Unggah dokumen SBU yang sesuai.")
    rows = rows.withColumn("criteria", F.when(no_code, _set_criterion(F.col("criteria"), "KBLI", kbli, 0)).otherwise(F.col("criteria")))
    rows = rows.withColumn("criteria", F.when(no_sbu, _set_criterion(F.col("criteria"), "SBU", paper, 1)).otherwise(F.col("criteria")))
    rows = rows.withColumn("criteria", F.when(unready, F.array().cast(f"array<{CRITERION}>")).otherwise(F.col("criteria")))
    blocked, open_ = F.size("_b") > 0, F.exists("criteria", lambda c: c["mandatory"] & (c["status"] == "needs_action"))
    status = F.when(unready, "NOT_READY").when(blocked, "NOT_ELIGIBLE").when(open_, "CONDITIONALLY_ELIGIBLE").otherwise("ELIGIBLE")
    score = F.when(unready, 0).when(blocked, F.least(F.lit(25), F.col("fit_score"))).otherwise(F.col("fit_score"))
    summary = F.when(unready, "Profil kualifikasi perusahaan belum diisi.").when(blocked, say("Tidak memenuhi syarat mutlak — ", F.size("_b").cast("string"), " kendala fatal: ", F.array_join(F.slice("_b", 1, 2), "; "))).otherwise(F.col("summary"))
    passed = ~(unready | blocked)
    return rows.withColumns({"status": status, "fit_score": score.cast("int"), "mandatory_passed": passed, "summary": summary, "blockers": F.col("_b")}).drop("_b")


def match_pairs(pairs: DataFrame, tenders: DataFrame, firms: DataFrame) -> DataFrame:
    """``rule_match`` and ``enforce_hard_gates`` for pairs (tender_id, company_id) of tenders (tender_id, kbli_code, requirement).

    firms: ``company_words`` rows. Words are compared once for each requirement text and company, however many tenders
    share the text.
    """
    keyed = tenders.select("tender_id", "kbli_code", "requirement", F.xxhash64("requirement").alias("key"))
    rows = pairs.join(keyed.drop("requirement"), "tender_id")
    texts = tender_words(keyed.select("key", "requirement").dropDuplicates(["key"])).drop("requirement")
    matched = rule_match(rows.select("key", "company_id").distinct().join(texts, "key").join(firms, "company_id"))
    kept = ["key", "company_id", "gates", "codes", "has_sbu", "has_izin", "nib", "qualifications", "status", "fit_score", "blockers", "missing", "actions", "criteria", "summary"]
    matched = matched.select(*kept, *(c for c in ("gate_sbu", "gate_izin") if c in matched.columns))
    return enforce_hard_gates(rows.join(matched, ["key", "company_id"])).drop("key")


def with_deadline(tenders: DataFrame) -> DataFrame:
    """Adds ``deadline``, once for all pairs of a tender, and drops the schedule."""
    return tenders.withColumn("deadline", S.submission_deadline(F.col("jadwal"))["date"]).drop("jadwal")


def _days_left(rows: DataFrame, as_of: Column) -> Column:
    return F.datediff(F.col("deadline") if "deadline" in rows.columns else S.submission_deadline(F.col("jadwal"))["date"], as_of)


def _steps(value: Column, steps, below: bool) -> Column:
    return reduce(lambda c, s: c.when(value <= s[0] if below else value >= s[0], s[1]), steps, F.when(F.lit(False), 0)).otherwise(0)


def classification(score: Column) -> Column:
    return reduce(lambda c, s: c.when(score >= s[0], s[1]), K.CLASSES, F.when(F.lit(False), "")).otherwise(K.CLASSES[-1][1])


def opportunity_score(pairs: DataFrame, as_of: Column) -> DataFrame:
    """Adds status, five component scores, final_score and classification.

    pairs: fit_score (null: no match), hps, kbli_code, tahap, deadline (or jadwal); penghasilan, codes, experience, complete. Components
    without data drop out and the weights of the others grow; they count 0 in their own column.
    """
    ready = P.is_submittable(F.col("tahap")) & F.col("fit_score").isNotNull()
    rows = pairs.withColumn("_days", _days_left(pairs, as_of)).withColumn("_ratio", F.when((F.col("hps") > 0) & (F.col("penghasilan") > 0), F.col("hps") / F.col("penghasilan")))
    fit = F.col("fit_score")
    match = (S.text("kbli_code") != "") & F.array_contains("codes", F.trim(S.text("kbli_code")))
    parts = {
        "qualification": fit,
        "financial": F.when(F.col("_ratio").isNotNull(), _steps(F.col("_ratio"), K.FINANCIAL_STEPS, True)),
        "experience": F.when(F.col("experience") == 0, 0).when(F.col("complete") > 0, 75).otherwise(60),
        "deadline": F.when(F.col("_days").isNotNull(), _steps(F.col("_days"), K.DEADLINE_STEPS, False)),
        "strategic": F.when(match & (fit >= 90), 100).when(fit >= 80, 85).when(fit >= 70, 70).when(fit >= 50, 50).otherwise(25),
    }
    for name, value in parts.items():
        rows = rows.withColumn(f"_{name}", value.cast("int"))
    weight = reduce(Column.__add__, (F.when(F.col(f"_{n}").isNotNull(), w).otherwise(0.0) for n, w in K.WEIGHTS.items()))
    rows = rows.withColumn("_weight", weight)
    total = reduce(Column.__add__, (F.when(F.col(f"_{n}").isNotNull(), F.col(f"_{n}") * (F.lit(w) / F.col("_weight"))).otherwise(0.0) for n, w in K.WEIGHTS.items()))
    rows = rows.withColumn("status", F.when(ready, "ready").otherwise("not_ready"))
    rows = rows.withColumn("final_score", F.when(ready, F.greatest(F.lit(0), F.least(F.lit(100), F.bround(total).cast("int")))).otherwise(0))
    rows = rows.withColumn("classification", F.when(ready, classification(F.col("final_score"))).otherwise(""))
    scores = [F.when(ready, F.coalesce(f"_{n}", F.lit(0))).otherwise(0).alias(f"{n}_score") for n in parts]
    return rows.select(*pairs.columns, "status", *scores, "final_score", "classification")


def stored_scores(scored: DataFrame, existing: DataFrame | None = None, version: str = "v0.1") -> DataFrame:
    """Rows of the score table after ``opportunity_score``: with their class, breakdown and version.

    A pair whose tender takes no submissions keeps the row that it has in ``existing``. scored also needs summary of the
    match, and days_left (null without a deadline). The texts are fixed values.
    """
    say = lambda *x: F.concat(*(y if isinstance(y, Column) else F.lit(y) for y in x))
    ready, days = F.col("status") == "ready", F.col("days_left")
    money, dated = (F.col("hps") > 0) & (F.col("penghasilan") > 0), days.isNotNull()
    kbli = (F.trim(S.text("kbli_code")) != "") & F.array_contains("codes", F.trim(S.text("kbli_code")))
    percent = F.bround(F.try_divide(F.col("hps").cast("double"), F.col("penghasilan").cast("double")) * 100, 0).cast("long").cast("string")
    left = say("Tersisa ", days.cast("string"), " hari sebelum deadline")
    fit = F.col("fit_score")
    alignment = lambda word: F.lit(f"Tender memiliki alignment {word} dengan qualification perusahaan.")
    why = {
        "qualification": F.when(S.text("summary") != "", F.col("summary")).otherwise("Berdasarkan analisis AI."),
        "financial": F.when(money, say("Nilai HPS berada pada kisaran ", percent, "% dari penghasilan tahunan perusahaan.")).otherwise("Data HPS atau penghasilan tahunan tidak tersedia."),
        "experience": F.when(F.col("experience") == 0, "Tidak ada pengalaman kerja tercatat.").when(F.col("complete") > 0, say("Terdapat ", F.col("complete").cast("string"), " pengalaman kerja aktif dengan data proyek yang lengkap.")).otherwise(say("Terdapat ", F.col("experience").cast("string"), " pengalaman kerja aktif.")),
        "deadline": F.when(~dated, "Info deadline tidak tersedia.").when(days >= 7, say(left, ".")).when(days >= 4, say(left, " — mulai siapkan.")).when(days >= 2, say(left, " — mendesak.")).when(days >= 1, say(left, " — sangat mendesak.")).when(days == 0, "Deadline hari ini.").otherwise("Deadline sudah lewat."),
        "strategic": F.when(kbli & (fit >= 90), alignment("tinggi")).when(fit >= 80, alignment("baik")).when(fit >= 70, alignment("cukup")).when(fit >= 50, alignment("moderat")).otherwise(alignment("rendah")),
    }
    source = {"qualification": "AIMatchResult.fit_score", "financial": "HPS / penghasilan_tahunan", "experience": "CompanyQualification.pengalaman_kerja", "deadline": "TenderResult.jadwal_json", "strategic": "fit_score + KBLI match"}
    there = {"financial": money, "deadline": dated}
    part = lambda n: F.struct(F.when(there.get(n, F.lit(True)), F.col(f"{n}_score")).alias("score"), F.lit(round(100 * K.WEIGHTS[n])).alias("weight_pct"), F.lit(source[n]).alias("source"), there.get(n, F.lit(True)).alias("available"))
    title = lambda n: say(f"{n.capitalize()}: ", F.when(there.get(n, F.lit(True)), F.col(f"{n}_score").cast("string")).otherwise("NOT AVAILABLE"))
    lines = F.array(*(line for n in why for line in (title(n), why[n])))
    message = F.when(~P.is_submittable(F.col("tahap")), "Tender tidak dalam status submittable (Pengumuman Prakualifikasi).").when(~ready, "Analisis AI belum tersedia. Jalankan AI Match terlebih dahulu.")
    breakdown = F.struct(
        message.alias("message"), F.when(ready, F.struct(*(part(n).alias(n) for n in why))).alias("components"), F.when(ready, lines).alias("explanation"), F.when(ready, S.text("summary")).alias("ai_match_summary"),
        F.when(ready, kbli).alias("kbli_match"), F.when(ready, money).alias("financial_available"), F.when(ready, dated).alias("deadline_available"),
    )
    numbers = [f"{n}_score" for n in why] + ["final_score"]
    columns = ["tender_id", "company_id", "status", *numbers, "classification", "breakdown", "calculation_version"]
    rows = scored.withColumns({"classification": F.when(ready, F.col("classification")).otherwise(K.CLASSES[-1][1]), "breakdown": breakdown, "calculation_version": F.lit(version)})
    if existing is None:
        return rows.select(*columns)
    had = existing.select("tender_id", "company_id", F.struct(*columns[2:]).alias("_had"))
    kept = ~P.is_submittable(F.col("tahap")) & F.col("_had").isNotNull()
    return rows.join(had, ["tender_id", "company_id"], "left").select("tender_id", "company_id", *(F.when(kept, F.col("_had")[c]).otherwise(F.col(c)).alias(c) for c in columns[2:]))


def recent_experience(quals: DataFrame, as_of: Column, years: int = 3) -> DataFrame:
    """(company_id, recent): projects since that many years ago, whatever the status of the qualification."""
    return quals.where((F.col("category") == "pengalaman_kerja") & (F.col("project_year") >= F.year(as_of) - years)).groupBy("company_id").agg(F.count(F.lit(1)).alias("recent"))


def opportunity_score_legacy(pairs: DataFrame, as_of: Column) -> DataFrame:
    """Adds the older score: five components weighted .40 .20 .15 .10 .15, truncated; recommendation, reason, strengths, risks.

    pairs: company_id (null: the tender alone is scored), hps, kbli_code, deadline (or jadwal), is_it_priority,
    is_prakualifikasi, peserta_count, metode, ai_score; codes, has_izin, has_sbu, has_sdm, experience, recent, modal, penghasilan.
    """
    firm, has = F.col("company_id").isNotNull(), F.coalesce(F.col("experience") > 0, F.lit(False))
    izin, sbu, sdm = (F.coalesce(c, F.lit(False)) for c in ("has_izin", "has_sbu", "has_sdm"))
    hps, modal, income, recent = (F.coalesce(c, F.lit(0)) for c in ("hps", "modal", "penghasilan", "recent"))
    code = F.trim(S.text("kbli_code"))
    hit, any_code = firm & (code != "") & F.coalesce(F.array_contains("codes", code), F.lit(False)), F.coalesce(F.size("codes") > 0, F.lit(False))
    points = lambda c, n: F.when(c, n).otherwise(0)
    qualification = F.when(~firm, 50).otherwise(F.when(hit, 50).when(code == "", 25).otherwise(0) + points(izin, 12) + points(sbu, 12) + points(has, 13) + points(sdm, 13))
    by_capital, by_income = firm & (hps > 0) & (modal > 0), firm & (hps > 0) & (modal <= 0) & (income > 0)
    capital, earned = F.try_divide(modal, hps), F.try_divide(income, hps)
    money = F.when(by_capital, F.when(capital >= 0.5, 95).when(capital >= 0.25, 75).when(capital >= 0.1, 50).otherwise(20)).when(by_income, F.when(earned >= 1, 80).when(earned >= 0.5, 60).otherwise(30)).otherwise(50)
    money = F.when(firm & ~has & (money > 50), F.greatest(money - 10, F.lit(20))).otherwise(money)
    experience = F.when(~firm, 30).when(recent >= 3, 95).when(recent >= 1, 70).otherwise(20)
    days = _days_left(pairs, as_of)
    deadline = F.when(days.isNull(), 60).when(days > 14, 95).when(days > 7, 75).when(days > 3, 50).when(days > 0, 25).otherwise(5)
    bidders, method, ai = F.coalesce("peserta_count", F.lit(0)), F.lower(S.text("metode")), F.coalesce("ai_score", F.lit(0))
    all_, best = F.contains(method, F.lit("selectall")) | F.contains(method, F.lit("select all")), F.contains(method, F.lit("best"))
    it, early = F.coalesce("is_it_priority", F.lit(False)), F.coalesce("is_prakualifikasi", F.lit(False))
    in_field = firm & any_code & hit
    strategic = (
        F.lit(40) + points(it, 20) + points(early, 8) + F.when(in_field, 12).when(firm & any_code & (code != ""), -5).otherwise(0) + F.when(bidders > 20, -8).when(bidders > 0, 5).when(bidders == 0, 3).otherwise(0)
        + F.when(all_, 5).when(best, 3).otherwise(0) + F.when(ai > 70, 10).when(ai > 40, 5).otherwise(0)
    )
    rows, clamp = pairs, lambda c: F.greatest(F.lit(0), F.least(F.lit(100), c)).cast("int")
    for name, value in (("qualification", qualification), ("financial", money), ("experience", experience), ("deadline", deadline), ("strategic", strategic)):
        rows = rows.withColumn(f"{name}_score", clamp(value))
    score = F.col
    final = score("qualification_score") * 0.40 + score("financial_score") * 0.20 + score("experience_score") * 0.15 + score("deadline_score") * 0.10 + score("strategic_score") * 0.15
    rows = rows.withColumn("final_score", clamp(final.cast("int")))
    percent = lambda c: F.concat(F.bround(c * 100).cast("long").cast("string"), F.lit("%"))
    say = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    # What the score says for and against a tender.
    strengths = [
        (hit, say("KBLI ", code, " sesuai")), (firm & izin, say("Izin Usaha aktif")), (firm & sbu, say("SBU aktif")), (firm & has, say("Pengalaman Kerja tercatat")), (firm & sdm, say("SDM/Manajerial tercatat")),
        (by_capital & (capital >= 0.5), say("Modal mencukupi (", percent(capital), " dari HPS)")), (by_capital & (capital >= 0.25) & (capital < 0.5), say("Modal cukup (", percent(capital), " dari HPS)")),
        (by_income & (earned >= 1), say("Penghasilan mencukupi (", percent(earned), " dari HPS)")), (firm & (recent >= 3), say(recent, " proyek pengalaman (3 tahun terakhir)")), (firm & (recent >= 1) & (recent < 3), say(recent, " proyek pengalaman")),
        (days > 7, say("Sisa waktu ", days, " hari")), (it, say("Tender IT Priority")), (early, say("Pra-Kualifikasi")), (in_field, say("KBLI sesuai bidang usaha")), ((bidders > 0) & (bidders <= 20), say(bidders, " peserta terdaftar")),
        (bidders == 0, say("Belum ada peserta terdaftar")), (all_, say("Metode Select All — kualifikasi semua")), (best & ~all_, say("Metode Best Value")), (ai > 70, say("Kesesuaian Kualifikasi AI ", ai, "%")),
    ]
    risks = [
        (firm & (code != "") & ~hit, say("KBLI ", code, " tidak sesuai")), (firm & ~izin, say("Izin Usaha belum ada")), (firm & ~sbu, say("SBU belum ada")), (firm & ~has, say("Belum ada pengalaman kerja")), (firm & ~sdm, say("SDM/Manajerial belum ada")),
        (by_capital & (capital < 0.1), say("Modal tidak mencukupi (", percent(capital), " dari HPS)")), (by_income & (earned < 0.5), say("Penghasilan tidak mencukupi")), (firm & (recent < 1), say("Tidak ada pengalaman tercatat (3 tahun terakhir)")),
        ((days > 0) & (days <= 3), say("Sisa waktu ", days, " hari — mendesak")), (days <= 0, say("Deadline sudah lewat")),
    ]
    rows = rows.withColumns({name: F.array_compact(F.array(*(F.when(c, x) for c, x in found))) for name, found in (("strengths", strengths), ("risks", risks))})
    total, fine = F.col("final_score"), lambda name, x: F.when(F.col(f"{name}_score") >= 70, x).otherwise("")
    reason = (
        F.when(total >= 70, say("Tender ini cocok dengan profil perusahaan.", fine("qualification", " Kualifikasi memadai."), fine("financial", " Kemampuan keuangan mencukupi."), fine("experience", " Pengalaman relevan tersedia.")))
        .when(total >= 50, say("Tender ini perlu ditinjau lebih lanjut.", F.when(F.size("risks") > 0, say(" Perhatikan: ", F.get("risks", F.lit(0)), ".")).otherwise("")))
        .otherwise(say("Tender ini kurang sesuai dengan profil perusahaan saat ini.", F.when(F.col("qualification_score") < 40, " Kualifikasi belum memadai.").otherwise("")))
    )
    label = F.when(total >= 85, "Sangat Direkomendasikan").when(total >= 70, "Direkomendasikan").when(total >= 50, "Perlu Ditinjau").otherwise("Tidak Direkomendasikan")
    return rows.withColumn("recommendation", label).withColumn("reason", reason)


def radar(scored: DataFrame, limit: int | None = None, offset: int = 0, only_ready: bool = True) -> DataFrame:
    """Ranks every company's open scored tenders: class, score, days left (unknown last), id.

    scored: company_id, tender_id, tahap, status, final_score, classification, days_left.
    """
    rows = scored.where(P.is_submittable(F.col("tahap")) & ~P.is_terminal(F.col("tahap")))
    rows = rows.where("status = 'ready'") if only_ready else rows
    place = reduce(lambda c, x: c.when(F.col("classification") == x[1][1], x[0]), enumerate(K.CLASSES), F.when(F.lit(False), 0)).otherwise(len(K.CLASSES))
    order = Window.partitionBy("company_id").orderBy(place, F.desc("final_score"), F.col("days_left").asc_nulls_last(), "tender_id")
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit)) if limit is not None else rows


def filter_radar(scored: DataFrame, classification: str = "", min_score: int = 0, search: str = "", kbli: str = "", location: str = "", it_only: bool = False, deadline_after: Column | None = None, deadline_before: Column | None = None, hps_min: int = 0, hps_max: int = 0) -> DataFrame:
    """The rows that meet every filter that is given, before they are ranked.

    scored: nama_paket, instansi, id_lelang, kbli_code, lokasi, is_it_priority, hps, deadline; status, classification and
    final_score. Class and score are known of ready rows only; rows without a deadline meet no bound on it.
    """
    ready = F.col("status") == "ready"
    holds = lambda c, words: F.contains(F.lower(S.text(c)), F.lit(words.lower()))
    wanted = [
        (search.strip(), reduce(Column.__or__, (holds(c, search.strip()) for c in ("nama_paket", "instansi", "id_lelang")))),
        (kbli.strip(), S.text("kbli_code") == kbli.strip()), (location.strip(), holds("lokasi", location.strip())), (it_only, F.col("is_it_priority")),
        (hps_min, F.col("hps") >= hps_min), (hps_max, F.col("hps") <= hps_max), (classification.strip(), ready & (F.col("classification") == classification.strip())), (min_score, ready & (F.col("final_score") >= min_score)),
        (deadline_after is not None, F.col("deadline") >= deadline_after), (deadline_before is not None, F.col("deadline") <= deadline_before),
    ]
    for given, condition in wanted:
        scored = scored.where(condition) if given else scored
    return scored


def recommended_candidates(tenders: DataFrame, profiles: DataFrame, matching: int = 20, others: int = 10, without: int = 50) -> DataFrame:
    """(company_id, tender_id, kbli_match, place): per company the open tenders to be scored, by priority and value.

    The first ``matching`` of those with one of its codes, and the first ``others`` of the rest in a qualification stage, or
    ``without`` of them for a company without codes. tenders: tender_id, tahap, kbli_code, priority_score, hps; profiles:
    company_id, codes. Tenders are ranked within their code first, so no company meets more than the first of each code.
    """
    best = [F.desc("priority_score"), F.desc("hps"), "tender_id"]
    columns = ["tender_id", "kbli_code", "priority_score", "hps"]
    live = tenders.where(P.is_open(F.col("tahap"))).withColumn("kbli_code", S.text("kbli_code"))
    of_code = lambda rows, most: rows.withColumn("_p", F.row_number().over(Window.partitionBy("kbli_code").orderBy(*best))).where(F.col("_p") <= most).select(*columns)
    own = profiles.select("company_id", F.explode("codes").alias("kbli_code")).join(of_code(live.where("kbli_code != ''"), matching), "kbli_code")
    placed = Window.partitionBy("company_id").orderBy(*best)
    hits = own.withColumn("place", F.row_number().over(placed)).where(F.col("place") <= matching)
    # The first of the rest are among the first few overall, as each of a company's codes has at most ``without`` above them.
    # So one array, of at most ``without`` tenders a code, goes to all companies, and each reads no more than its beginning.
    rest = of_code(live.where(F.contains(F.lower("tahap"), F.lit("kualifikasi"))), without)
    entry = F.struct((-F.col("priority_score")).alias("priority"), (-F.col("hps")).alias("value"), "tender_id", "kbli_code")
    heads = rest.agg(F.sort_array(F.collect_list(entry)).alias("heads"))
    firms = profiles.select("company_id", "codes", F.when(F.size("codes") > 0, others).otherwise(without).alias("_most"))
    begin = F.slice("heads", F.lit(1), F.col("_most") + F.size("codes") * without)
    chosen = F.slice(F.filter(begin, lambda x: ~F.array_contains("codes", x["kbli_code"])), F.lit(1), F.col("_most"))
    far = firms.crossJoin(F.broadcast(heads)).select("company_id", F.posexplode(chosen).alias("at", "x"))  # heads: one row
    far = far.select("company_id", "x.tender_id", (F.col("at") + 1).alias("place"))
    kept = "company_id", "tender_id", "place"
    return hits.select(*kept, F.lit(True).alias("kbli_match")).unionByName(far.select(*kept, F.lit(False).alias("kbli_match")))


def recommended(scored: DataFrame, top: int = 20) -> DataFrame:
    """Per company the best of its ``recommended_candidates`` by ``opportunity_score``; ties in their order."""
    best = Window.partitionBy("company_id").orderBy(F.desc("final_score"), F.desc("kbli_match"), "place")
    rows = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    label = reduce(lambda c, x: c.when(F.col("classification") == x[0], x[1]), K.RECOMMENDATIONS.items(), F.when(F.lit(False), "")).otherwise("Tidak Direkomendasikan")
    return rows.select("company_id", "tender_id", "final_score", "rank", "kbli_match", label.alias("recommendation"))


def next_job_state(jobs: DataFrame, as_of: Column, retry_minutes: int = 15) -> DataFrame:
    """Adds next_status, next_attempts and next_scheduled_at after an ``outcome``: success, rate_limited, permanent, transient or skip."""
    o, tried = F.col("outcome"), F.col("attempts") + 1
    status = F.when(o == "success", "completed").when(o == "rate_limited", "pending").when(o == "permanent", "failed").when(o == "skip", "skipped").when(tried >= F.col("max_attempts"), "failed").otherwise("pending")
    later = as_of + F.make_dt_interval(F.lit(0), F.lit(0), (F.lit(retry_minutes) * tried).cast("int"))
    return jobs.withColumn("next_status", status).withColumn("next_attempts", F.when(o.isin("rate_limited", "skip"), F.col("attempts")).otherwise(tried)).withColumn("next_scheduled_at", F.when((o == "transient") & (F.col("next_status") == "pending"), later).when(o == "rate_limited", as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(retry_minutes))).otherwise(F.col("scheduled_at")))


def cascade_to_scores(jobs: DataFrame) -> DataFrame:
    """(tender_id, company_id, id, next_status) of score jobs after the match jobs' ``outcome``.

    jobs: id, tender_id, company_id, job_type (match or score), status, outcome. After a success the pair's score job is
    pending again if it had failed or was skipped, and made (id null) if there was none; after a skip it is skipped unless
    it is completed. A success outweighs a skip. Others keep their status.
    """
    pair = ["tender_id", "company_id"]
    matched = jobs.where("job_type = 'match'").groupBy(*pair).agg(F.coalesce(F.bool_or(F.col("outcome") == "success"), F.lit(False)).alias("done"), F.coalesce(F.bool_or(F.col("outcome") == "skip"), F.lit(False)).alias("left_out"))
    scores = jobs.where("job_type = 'score'").select(*pair, "id", "status")
    status = F.when(F.col("done"), F.when(F.col("status").isNull() | F.col("status").isin("failed", "skipped"), "pending").otherwise(F.col("status"))).when(F.col("left_out") & (F.col("status") != "completed"), "skipped").otherwise(F.col("status"))
    rows = matched.join(scores, pair, "full").withColumn("next_status", status)
    return rows.where("next_status is not null").select(*pair, "id", "next_status")
