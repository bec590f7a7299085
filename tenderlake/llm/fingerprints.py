"""Document fingerprints by winnowing: rolling hashes of k words, the smallest of each window kept with its place.

DataFrame functions only. Hashes roll by rotating and xor-ing (a cyclic polynomial), and both the hashes and the window
minima are built by doubling, so neither costs k or w steps a word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderlake.llm import shared

#: Ranges of ids at most, and documents in each until then.
MOST_RANGES, RANGE_ROWS = 1 << 15, 1000


def _joined(size: int):
    """Of a run's hash and that of the ``size`` words behind it: the hash of both."""
    by = size % 64
    return lambda a, b: (F.shiftleft(a, by).bitwiseOR(F.shiftrightunsigned(a, 64 - by)) if by else a).bitwiseXOR(b)


def _smaller(step: int):
    """Of a window's minimum and that of the window ``step`` places on: the minimum of both, places counted from the first."""
    return lambda a, b: F.least(a, b - step)


def _from(c: str, start: int) -> Column:
    """The array without its first ``start`` items."""
    return F.slice(c, start + 1, F.size(c))


def with_fingerprint(df: DataFrame, text: str, name: str, k: int = 5, window: int = 8) -> DataFrame:
    """Adds ``name`` (the fingerprint as text: hash@place, ...) and ``{name}_hashes`` (its distinct hashes).

    Words are split by white space and lower-cased; places count words from 0. Any run of window + k - 1 words that two
    texts share leaves a common hash. Of equal hashes in a window the rightmost is kept. ``window`` is a power of two. A
    text of fewer than k words has one hash, of all of them; a text of none, or null, has none and the fingerprint "".
    """
    words, h, grams, least, places = (f"_{name}_{x}" for x in ("words", "h", "grams", "least", "places"))
    keep = df.columns
    df = df.withColumn(words, F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(shared.SPACED_WORD), F.lit(0)))
    df = df.withColumn(h, F.transform(words, lambda w: F.xxhash64(w)))
    size, of, whole = 1, {1: h}, 0
    while size * 2 <= k:  # hashes of 2, 4, ... words
        of[size * 2] = f"{h}{size * 2}"
        df = df.withColumn(of[size * 2], F.zip_with(of[size], _from(of[size], size), _joined(size)))
        size *= 2
    run = None
    for size in sorted(of, reverse=True):
        if k & size:
            if run is None:
                run, whole = of[size], size
            else:
                df = df.withColumn(f"{h}_{whole + size}", F.zip_with(run, _from(of[size], whole), _joined(size)))
                run, whole = f"{h}_{whole + size}", whole + size
    steps = window.bit_length() - 1
    packed = F.transform(F.slice(run, 1, F.greatest(F.size(words) - (k - 1), F.lit(0))), lambda x: F.shiftleft(F.shiftrightunsigned(x, steps + 1), steps).bitwiseOR(F.lit(window - 1)))
    alone = F.array(F.shiftleft(F.shiftrightunsigned(F.xxhash64(words), steps + 1), steps).bitwiseOR(F.lit(window - 1)))
    df = df.withColumn(grams, F.when(F.size(words) >= k, packed).when(F.size(words) > 0, alone).otherwise(F.array().cast("array<bigint>")))
    # the low bits hold window - 1 - (place in the window): so the smallest is the rightmost of the smallest hash
    df = df.withColumn(f"{least}0", F.col(grams))
    for step in range(steps):
        df = df.withColumn(f"{least}{step + 1}", F.zip_with(f"{least}{step}", _from(f"{least}{step}", 1 << step), _smaller(1 << step)))
    windows = F.slice(f"{least}{steps}", 1, F.greatest(F.size(grams) - (window - 1), F.least(F.size(grams), F.lit(1))))
    df = df.withColumn(places, F.array_distinct(F.transform(windows, lambda x, i: i + (F.lit(window - 1) - x.bitwiseAND(window - 1)).cast("int"))))
    df = df.withColumn(f"{name}_all", F.transform(places, lambda p: F.shiftright(F.get(grams, p), steps)))
    df = df.withColumn(name, F.array_join(F.zip_with(f"{name}_all", places, lambda x, p: F.concat(F.lower(F.hex(x)), F.lit("@"), p.cast("string"))), " "))
    return df.select(*keep, name, F.array_distinct(f"{name}_all").alias(f"{name}_hashes"))


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two arrays of hashes; 1 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)).cast("double"))


def with_next(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with the range each document is in, each range's rows in descending doc_id and then its successor's.

    Ids are cut into ranges of near equal counts; a range gets a copy (``guest``) of the next range's first document,
    and the last one of the very first document. So each text moves once, and no order over all documents is needed.
    """
    ids = documents.select("doc_id")
    n = ids.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * MOST_RANGES)).first()[0] if ranges > 1 else []  # at most MOST_RANGES
    cuts = sorted(set(cuts or []))
    halves = [1 << i for i in reversed(range(len(cuts).bit_length()))]

    def in_range(of: str = "doc_id") -> Column:  # binary search for the number of cuts up to the id
        if not cuts:
            return F.lit(0)
        bounds = F.lit(cuts)
        found = F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), lambda at, half: at + F.when(F.coalesce(F.get(bounds, at + half - 1) <= F.col(of), F.lit(False)), half).otherwise(0))
        return F.when(F.col(of).isNull(), -1).otherwise(found)

    heads = ids.select("doc_id", in_range().alias("range")).groupBy("range").agg(F.max("doc_id").alias("head"))
    down = Window.orderBy(F.desc("range"))  # one row a range
    heads = heads.select("head", F.coalesce(F.lag("range").over(down), F.min("range").over(Window.partitionBy())).alias("also"))
    found = documents.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")), "left")  # at most MOST_RANGES + 1 rows
    own, guest = F.struct(in_range().alias("range"), F.lit(False).alias("guest")), F.struct(F.col("also").alias("range"), F.lit(True).alias("guest"))
    return found.select("doc_id", "text", F.inline(F.when(F.col("also").isNull(), F.array(own)).otherwise(F.array(own, guest))))


def edited_fingerprints(documents: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, window: int = 8) -> DataFrame:
    """Returns a row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by as many of the next document's first ones,
    or all if it has fewer; next is by descending doc_id (null last, equal ids by hash of text), and the first after the
    last. Null texts count as empty. A lone document is its own next. The likenesses are Jaccard's, on distinct hashes.
    """
    source = shared.only(documents, doc_id=id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    order = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    rows = with_next(source).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("next", F.lead("text").over(order))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    rows = rows.withColumn("edited", edited).drop("next")
    rows = reduce(lambda df, x: with_fingerprint(df, *x, k, window), (("text", "fingerprint"), ("edited", "edited_fingerprint")), rows)
    rows = rows.withColumn("next_hashes", F.lead("fingerprint_hashes").over(order)).where("not guest")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint_hashes", "edited_fingerprint_hashes").alias("near_edited"), likeness("fingerprint_hashes", "next_hashes").alias("near_next"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(shared.documents(spark, sf_dir))
