"""Substring deduplication: lines or paragraphs by hash, the earliest occurrence of each kept, the rest cut out of the texts.

A unit is cut if it has an earlier occurrence and stands in a run of such units that has enough words in all. So passages
of many short lines go whole, and a short line that merely recurs stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderlake.llm import shared
from tenderlake.llm.textbytes import pieces

#: What ends a unit.
BREAKS = {"line": "\n", "paragraph": r"\n[^\S\n]*\n\s*"}
SPANS = "array<struct<unit:int,start:bigint,end:bigint,kept_doc_id:bigint,kept_start:bigint>>"


def spans(text: str, breaks: re.Pattern) -> Iterator[tuple[int, int]]:
    """Start and end of every unit, between breaks."""
    start = 0
    for m in breaks.finditer(text):
        yield start, m.start()
        start = m.end()
    yield start, len(text)


def units(documents: DataFrame, unit: str = "line") -> DataFrame:
    """(doc_id, text_hash, unit, place, start, end, words, d1, d2) of (doc_id, text): each unit that has a word.

    unit counts all units of the text from 0, place those with a word. start and end are code points; the digest (128
    bits) is of the unit in lower case, white space runs as one blank.
    """
    breaks = re.compile(BREAKS[unit])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = []
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                place = 0
                for k, (start, end) in enumerate(spans(text or "", breaks)):
                    own = text[start:end].lower().split() if text else []
                    if own:
                        digest = blake2b(" ".join(own).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                        rows.append((doc, key, k, place, start, end, len(own), int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
                        place += 1
            columns = list(zip(*rows)) or [()] * 9
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "text_hash", "unit", "place", "start", "end", "words", "d1", "d2"])

    return documents.mapInArrow(run, "doc_id long, text_hash long, unit int, place int, start long, end long, words int, d1 long, d2 long")


def repeated_units(documents: DataFrame, id: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = 30) -> DataFrame:
    """Returns the units to remove: doc_id, text_hash, unit (from 0), start, end, kept_doc_id, kept_start.

    Of units with equal digests the first by (doc_id, start) stays, null ids first. The others are removed where a run of
    units next to each other that all have an earlier occurrence has ``min_words`` words or more; units without a word
    do not end a run. Null and empty texts have no units. Rows with equal ids and texts count once, and lose the same.
    """
    source = shared.only(documents, doc_id=id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = shared.written(units(source, unit), "units")
    first = F.struct("doc_id", "start", "text_hash")
    kept = found.groupBy("d1", "d2").agg(F.min(first).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = shared.joined_to_groups(found, shared.written(kept, "kept"), ["d1", "d2"]).where(~first.eqNullSafe(F.col("kept")))
    later = later.select("doc_id", "text_hash", "unit", "place", "start", "end", "words", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start")).dropDuplicates(["doc_id", "text_hash", "place"])
    own = Window.partitionBy("doc_id", "text_hash")
    run = later.withColumn("run", F.col("place") - F.row_number().over(own.orderBy("place")))
    long = run.withColumn("all", F.sum("words").over(Window.partitionBy("doc_id", "text_hash", "run"))).where(F.col("all") >= min_words)
    return long.select("doc_id", "text_hash", "unit", "start", "end", "kept_doc_id", "kept_start")


def without_repeats(documents: DataFrame, id: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = 30) -> DataFrame:
    """Returns (doc_id, text, removed): each document's text without its repeated units, and what was cut out.

    removed is an array of (unit, start, end, kept_doc_id, kept_start): places in the original text and those of the
    occurrence that stays; see ``repeated_units``. A removed unit goes with the break after it. Documents that lose all
    their words are left out; those without any stay as they are.
    """
    source = shared.only(documents, doc_id=id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    gone = repeated_units(source, unit=unit, min_words=min_words).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("unit", "start", "end", "kept_doc_id", "kept_start"))).alias("removed"))
    gone = shared.written(gone, "gone").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "removed")
    joined = source.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash")), "left").select("doc_id", "text", F.coalesce("removed", F.array().cast(SPANS)).alias("removed"))
    breaks = re.compile(BREAKS[unit])

    def left(text: str, removed: set[int]) -> str | None:
        parts = list(spans(text, breaks))
        kept = [k for k in range(len(parts)) if k not in removed]
        if not any(text[slice(*parts[k])].split() for k in kept):
            return None
        ends = [parts[k + 1][0] if k + 1 < len(parts) else parts[k][1] for k in kept]
        return "".join(text[parts[k][0] : end] for k, end in zip(kept[:-1], ends)) + text[slice(*parts[kept[-1]])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            cut = batch.column(2).value_lengths().to_numpy() > 0
            yield batch.filter(pa.array(~cut))
            some = batch.filter(pa.array(cut))
            texts = [left(t, {x["unit"] for x in r}) for t, r in zip(some.column(1).to_pylist(), some.column(2).to_pylist())]
            some = some.set_column(1, "text", pa.array(texts, some.schema.field(1).type))
            yield some.filter(some.column(1).is_valid())

    return joined.mapInArrow(run, f"doc_id long, text string, removed {SPANS}")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document, and the removed spans as text: start-end>kept document:start, in order."""
    shown = F.array_join(F.transform("removed", lambda x: F.concat(x["start"], F.lit("-"), x["end"], F.lit(">"), x["kept_doc_id"], F.lit(":"), x["kept_start"])), ",")
    return without_repeats(shared.documents(spark, sf_dir)).select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), shown.alias("removed"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) - 1 AS unit, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
placed AS (
  SELECT doc_id, unit, line, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS digest,
         sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY unit) - length(line) - 1 AS start, length(line) AS size
  FROM lines),
ranked AS (
  SELECT *, len(string_split(digest, ' ')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS place,
         row_number() OVER w AS nth, first_value(doc_id) OVER w AS kept_doc_id, first_value(start) OVER w AS kept_start
  FROM placed WHERE digest <> ''
  WINDOW w AS (PARTITION BY digest ORDER BY doc_id, start)),
later AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM ranked WHERE nth > 1),
gone AS (SELECT * FROM (SELECT *, sum(words) OVER (PARTITION BY doc_id, run) AS words_of_run FROM later) WHERE words_of_run >= 30),
marked AS (
  SELECT p.doc_id, p.unit, p.line, p.digest, g.unit IS NOT NULL AS is_gone, CAST(p.start AS BIGINT) AS start, CAST(p.start + p.size AS BIGINT) AS "end", g.kept_doc_id, CAST(g.kept_start AS BIGINT) AS kept_start
  FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.unit = g.unit),
left_over AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY unit) FILTER (NOT is_gone) AS text, count(*) FILTER (is_gone) AS n_removed,
         coalesce(string_agg(start || '-' || "end" || '>' || kept_doc_id || ':' || kept_start, ',' ORDER BY unit) FILTER (is_gone), '') AS removed,
         bool_or(digest <> '' AND NOT is_gone) AS has_words
  FROM marked GROUP BY doc_id)
SELECT doc_id, text, n_removed, removed FROM left_over WHERE has_words OR n_removed = 0
UNION ALL SELECT doc_id, text, 0, '' FROM documents WHERE text IS NULL
"""
