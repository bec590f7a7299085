"""Mixing sources to target weights.

Documents get hash-random keys; within each source they are taken in key order until the source's budget of words is
used up exactly, over several epochs where the budget exceeds the source. So a source is cut at one key. It is found by
running totals of sums of hash ranges, and then within one range, so no source is ever sorted in one task; a row for
each source then tells every document what is taken of it, without a shuffle of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderlake.llm import shared

#: Bits of a hash-random key.
KEY_BITS = 60


def hash_key(c):
    """60 bits of the MD5 of the id's text: random, and the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, epochs: int = 3) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row per source.

    Sources by code point (null last) weigh ``weights`` in turn and share ``share`` of all sizes. A target stops at
    ``epochs`` times its source; what is over is shared by weight among the rest, until none is above. With sources in
    order of the level at which they fill up, the level that the rest share is the largest of (what is left of the
    total) / (what is left of the weights).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy("fills_at", "place")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return (
        totals.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place") % len(weights) + 1).cast("double"))
        .withColumn("cap", F.col("source_size").cast("double") * epochs)
        .withColumn("fills_at", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double") * share)
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("shared", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.max(F.col("left") / F.col("shared")).over(everything))
        .select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))
    )


#: What documents of a source are taken in order of.
ORDER = ("key", "doc_id", "size", "text_hash")


def _sized(documents: DataFrame) -> DataFrame:
    """Adds size (words), key and text_hash to rows with doc_id and text."""
    words = F.coalesce(F.regexp_count("text", F.lit(shared.SPACED_WORD)), F.lit(0)).cast("long")
    return documents.withColumns({"size": words, "key": hash_key(F.col("doc_id")), "text_hash": F.xxhash64("text")})


def source_cuts(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, epochs: int = 3, range_rows: int = 4096) -> DataFrame:
    """A row per source: source, source_size, target, whole (epochs taken in full), cut (the ORDER columns) and at_cut.

    sized: a stored table of source and the ORDER columns. In the last epoch rows before ``cut`` are taken whole, and of
    those equal to it ``at_cut`` words each. Rows of one source and key range (about ``range_rows``) meet in a task, and
    the sums of a source's ranges.
    """
    bits = max(0, (sized.count() // range_rows).bit_length())
    dealt = sized.withColumn("range", F.shiftright("key", KEY_BITS - bits))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.try_divide(F.floor("target"), F.col("source_size")))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.floor("target").cast("long") - F.col("whole") * F.col("source_size"))
    targets = shared.written(targets, "targets")
    so_far = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = dealt.groupBy("source", "range").agg(F.sum("size").alias("words")).withColumn("ahead", so_far(Window.partitionBy("source").orderBy("range")))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    cut = ranges.alias("r").join(shared.small(targets).alias("t"), same("r", "t")).where("ahead <= rest and rest < ahead + words").select("r.source", "range", "ahead", "rest")
    cut = shared.small(shared.written(cut, "ranges"))
    own = dealt.alias("d").join(cut.alias("c"), same("d", "c") & (F.col("d.range") == F.col("c.range")), "left_semi").groupBy("source", *ORDER).agg(F.count(F.lit(1)).alias("rows"))
    own = own.withColumn("words", F.col("rows") * F.col("size")).withColumn("start", so_far(Window.partitionBy("source").orderBy(*ORDER)))
    own = own.alias("o").join(cut.alias("c"), same("o", "c")).withColumn("left", F.col("rest") - F.col("ahead") - F.col("start")).where("left >= 0 and left < words")
    own = own.select("o.source", F.struct(*ORDER).alias("cut"), F.floor(F.col("left") / F.col("rows")).cast("long").alias("at_cut"))
    return targets.alias("t").join(own.alias("o"), same("t", "o"), "left").select("t.source", "source_size", "target", "whole", "cut", "at_cut")


def _taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds source_size, target and taken to rows with source and the ORDER columns."""
    place = F.struct(*(F.col(f"d.{c}").alias(c) for c in ORDER))
    last = F.when(F.col("cut").isNull(), 0).when(place.eqNullSafe(F.col("cut")), F.col("at_cut")).when(place < F.col("cut"), F.col("size")).otherwise(0)
    found = rows.alias("d").join(shared.small(cuts).alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")))
    return found.select("d.*", "source_size", "target", (F.col("whole") * F.col("size") + last).alias("taken"))


def mix(documents: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """Returns a row per document: doc_id, source, size (words), source_size, target and taken (words, repeats counted).

    options: see ``source_targets`` and ``source_cuts``. A document is taken at most ``epochs`` times; the last one of a
    source only so far as the budget goes, so a source takes floor(target) words. Rows of a source with equal ids and
    texts share alike what is left when their turn comes. Null and empty texts have size 0 and are never taken; a null
    source is a source.
    """
    sized = shared.written(_sized(shared.only(documents, doc_id=id, text=text, source=source)).select("source", *ORDER), "sizes")
    cuts = shared.written(source_cuts(sized, **options), "cuts")
    return _taken(sized, cuts).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixture(documents: DataFrame, **options) -> DataFrame:
    """The documents (all columns) of the mix, each as often as it is taken; the last copy of a source's last one is cut to the words taken.

    n_chars is counted anew where a text is cut. Texts are only read: for their sizes, and again as they are taken.
    """
    own = shared.only(documents, doc_id="doc_id", text="text", source="source")
    sized = shared.written(_sized(own).select("source", *ORDER), "sizes")
    cuts = shared.written(source_cuts(sized, **options), "cuts")
    shared.drop(sized)
    found = _taken(_sized(documents.select(F.struct(*documents.columns).alias("row"), "doc_id", "text", "source")), cuts).where("taken > 0")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).withColumn("words", F.least("size", F.col("taken") - (F.col("copy") - 1) * F.col("size")))
    parts = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")  # a word and the white space behind it; any before the first is a part too
    cut = F.array_join(F.slice(parts, 1, (F.col("words") + F.col("text").rlike(r"^[\x20\x09-\x0D]").cast("int")).cast("int")), "")
    found = found.withColumn("is_cut", F.col("words") < F.col("size")).withColumn("text", F.when(F.col("is_cut"), cut).otherwise(F.col("text")))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("is_cut"), F.char_length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*(new.get(c, F.col("row")[c]).alias(c) for c in documents.columns))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(shared.documents(spark, sf_dir)).drop("source")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(place % 3) + 1]::DOUBLE AS weight, source_size::DOUBLE * 3 AS cap
      FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s)),
l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0) AS rest,
             sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS shared
      FROM w WINDOW b AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, (max(rest / shared) OVER ()) * weight) AS target FROM l),
p AS (SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(whole * size + greatest(0, least(size, budget - whole * source_size - start)) AS BIGINT) AS taken
FROM q
"""
