"""Phrase collocations by the stripes pattern.

A stripe is a prefix and an associative counter of the words that follow it. Tasks count stripes of a chunk of text at a
time; those of one prefix are merged elementwise. Phrases grow by a word a pass: a phrase is only counted where its first
and its last words (all but one) are frequent themselves, which a bitmap of fixed size tells without false negatives;
what it lets through besides is counted and dropped. So the counts are exact at any size.

From the merged stripes come a phrase's extensions, the totals of its prefixes and suffixes, and the largest count of a
phrase that has one word more, which is all that subsumption needs: a phrase's count is no larger than that of a part.

Stripes of prefixes that have a thousandth of all words or more, at most a thousand of them a pass, and of the empty
prefix are split by the hash of the next word.

Rows: a null text is empty, a null lang is ``und`` (and goes with rows that say ``und``), ids are not used, repeated rows
count as often as they stand there, and other columns don't matter. No rows, or no frequent phrase, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderlake.llm import shared, textbytes

NO_LANG = "und"
LONGEST, LEAST = 5, 100
#: Segments of a stripe that is split, and the share of all words from which on one is.
SEGMENTS, HOT_SHARE = 256, 1000
#: Bits of the bitmap of frequent phrases (8 MB), whatever the input.
BITS = 1 << 26
#: Bytes of text that a task counts at a time.
CHUNK = 5 << 20
IS_BREAK = np.zeros(256, bool)
IS_BREAK[list(b".,;:!?") + list(range(10, 14))] = True
IS_WORD = ~IS_BREAK
IS_WORD[[32, 9]] = False


def _hash(strings: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(strings, object), categorize=False) if strings else np.zeros(0, np.uint64)


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase (by lang) and one word more."""
    return textbytes.mixed(h * textbytes.BASE + word)


class _Chunk:
    """Words of a chunk's texts: local ids, whether consecutive ones are of one piece, and hashes."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        text = batch.column(0).fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = textbytes.LOWER[np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
        offsets = offsets - offsets[0]
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = IS_WORD[data]
        new = np.zeros(len(data) + 1, bool)
        new[offsets] = True  # a text's first byte begins a word of its own
        start = np.flatnonzero((inside[1:] == 1) & ((inside[:-1] == 0) | new))
        end = np.flatnonzero((inside[:-1] == 1) & ((inside[1:] == 0) | new))
        size = end - start
        kept = data[inside[1:-1].astype(bool)]
        ends = np.concatenate([[0], np.cumsum(size)])
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(kept)).dictionary_encode()
        self.dictionary = words.dictionary
        self.word = np.asarray(words.indices).astype(np.int64)
        self.n_words = max(len(words.dictionary), 1)
        of_text = np.searchsorted(offsets, start, "right") - 1
        breaks = np.cumsum(IS_BREAK[data], dtype=np.int32)[start] if len(start) else np.zeros(0, np.int32)
        self.run = np.cumsum(np.concatenate([[0], (np.diff(of_text) != 0) | (np.diff(breaks) != 0)])[: len(start)])
        langs = batch.column(1).fill_null(NO_LANG).dictionary_encode()
        self.langs = langs.dictionary
        self.lang = np.asarray(langs.indices).astype(np.int64)[of_text]
        self.word_hash = _hash(self.dictionary.to_pylist())
        self.lang_hash = _hash(self.langs.to_pylist())

    def hashes(self, size: int) -> np.ndarray:
        """Of the phrase of ``size`` words at each word, pieces aside."""
        h, words = self.lang_hash[self.lang], self.word_hash[self.word]
        for k in range(size):
            h = _longer(h[: max(len(words) - k, 0)], words[k:])
        return h


#: Words and counts are joined by spaces, which no word has: an array would pad each to eight bytes.
STRIPES = "lang string, prefix string, segment int, words string, counts string"


def _stripes(size: int, frequent, hot: frozenset[int]):
    """A function for ``mapInArrow``: stripes of each chunk's phrases of ``size`` words. frequent: broadcast bitmap of those of one less."""

    def of_chunk(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        is_hot = np.array(sorted(hot), np.uint64)
        c = _Chunk(batch)
        n = len(c.word) - size + 1
        if n <= 0:
            return None
        before = c.hashes(size - 1)
        whole = c.run[:n] == c.run[size - 1 :]
        if size > 1:
            known = _has(frequent.value, before)
            whole &= known[:n] & known[1 : n + 1]
        at = np.flatnonzero(whole)
        if not len(at):
            return None
        prefix = c.lang[at]
        for k in range(size - 1):
            prefix = np.unique(prefix * c.n_words + c.word[at + k], return_inverse=True)[1]
        _, first, counts = np.unique(prefix * c.n_words + c.word[at + size - 1], return_index=True, return_counts=True)
        at, prefix = at[first], prefix[first]
        last = c.word[at + size - 1]
        split = np.ones(len(at), bool) if size == 1 else np.isin(before[at], is_hot)
        segment = np.where(split, (c.word_hash[last] >> np.uint64(7)) % np.uint64(SEGMENTS), np.uint64(0)).astype(np.int64)
        order = np.argsort(prefix * SEGMENTS + segment, kind="stable")
        at, last, counts, segment, key = at[order], last[order], counts[order], segment[order], (prefix * SEGMENTS + segment)[order]
        opens = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        bounds = pa.array(np.append(opens, len(at)).astype(np.int32))
        words = [c.dictionary.take(pa.array(c.word[at[opens] + k])) for k in range(size - 1)]
        return pa.RecordBatch.from_arrays(
            [
                c.langs.take(pa.array(c.lang[at[opens]])).cast(pa.string()),
                (pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if words else pa.array([""] * len(opens))).cast(pa.string()),
                pa.array(segment[opens].astype(np.int32)),
                pc.binary_join(pa.ListArray.from_arrays(bounds, c.dictionary.take(pa.array(last)).cast(pa.string())), " "),
                pc.binary_join(pa.ListArray.from_arrays(bounds, pa.array(counts.astype(np.int64)).cast(pa.string())), " "),
            ],
            names=["lang", "prefix", "segment", "words", "counts"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textbytes.pieces(batches, "text", CHUNK):
            found = of_chunk(batch)  # whose arrays are gone before the next one's are made
            if found is not None:
                yield found

    return count


def _merged(stripes: DataFrame) -> DataFrame:
    """lang, prefix, word, f: stripes of one prefix (and segment) are dealt once and added up by element."""
    words, counts = F.split("words", " "), F.split("counts", " ").cast("array<bigint>")
    entries = stripes.repartition("lang", "prefix", "segment").select("lang", "prefix", "segment", F.explode(F.arrays_zip(words.alias("words"), counts.alias("counts"))).alias("e"))
    return entries.groupBy("lang", "prefix", "segment", F.col("e.words").alias("word")).agg(F.sum("e.counts").alias("f")).drop("segment")


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h % np.uint64(BITS)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _phrase_hashes(table: pa.RecordBatch) -> np.ndarray:
    """By columns lang and phrase, whose phrases have the same number of words."""
    h = _hash(table.column("lang").to_pylist())
    words = [p.split(" ") for p in table.column("phrase").to_pylist()]
    for k in range(len(words[0]) if words else 0):
        h = _longer(h, _hash([w[k] for w in words]))
    return h


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot = _phrase_hashes(batch) % np.uint64(BITS)
        word, group = np.unique((slot >> np.uint64(6)).astype(np.int64), return_inverse=True)
        bits = np.zeros(len(word), np.uint64)
        np.bitwise_or.at(bits, group, np.uint64(1) << (slot & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["at", "bits"])


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """Of a table with lang and phrase: at most BITS / 64 numbers come to the driver."""
    found = phrases.select("lang", "phrase").mapInArrow(_slots, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def phrase_counts(documents: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each lang (lang, n), and stored tables by number of words: lang, phrase, f, firsts, rests.

    Phrases have ``least`` occurrences or more. firsts and rests are the counts of a phrase's first k words and of the
    others, k from 1.
    """
    spark = documents.sparkSession
    own = shared.only(documents, text=text, lang=lang)
    words = shared.written(_merged(own.mapInArrow(_stripes(1, None, frozenset()), STRIPES)), "words")
    totals = shared.written(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    none = F.array().cast("array<bigint>")
    levels = [shared.written(words.where(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), "f", none.alias("firsts"), none.alias("rests")), "phrases_1")]
    n = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared.drop(words)
    for size in range(2, longest + 1):
        shorter = levels[-1]
        hot = shorter.where(F.col("f") >= max(-(-n // HOT_SHARE), least)).select("lang", "phrase").toArrow()  # at most HOT_SHARE rows
        hot = frozenset(h for b in hot.to_batches() for h in _phrase_hashes(b).tolist())
        frequent = spark.sparkContext.broadcast(_bitmap(shorter))
        merged = _merged(own.mapInArrow(_stripes(size, frequent, hot), STRIPES)).where(F.col("f") >= least)
        phrase = F.concat_ws(" ", "prefix", "word")
        found = shared.written(merged.select("lang", phrase.alias("phrase"), "prefix", F.substr(phrase, F.instr(phrase, " ") + 1).alias("suffix"), "f"), f"found_{size}")
        frequent.destroy()
        firsts = shorter.select("lang", F.col("phrase").alias("prefix"), F.concat("firsts", F.array("f")).alias("firsts"), F.col("f").alias("l"))
        rests = shorter.select("lang", F.col("phrase").alias("suffix"), F.concat(F.array("f"), "rests").alias("rests"), F.col("f").alias("r"))
        found = shared.joined_to_groups(found, firsts, ["lang", "prefix"], "l")
        found = shared.joined_to_groups(found, rests, ["lang", "suffix"], "r")
        levels.append(shared.written(found.select("lang", "phrase", "f", "firsts", "rests"), f"phrases_{size}"))
    return totals, levels


def _longer_counts(longer: DataFrame) -> DataFrame:
    """lang, phrase, most: the largest count of a phrase that has one word more, before or behind."""
    cut = F.instr("phrase", " ")
    prefix = F.regexp_replace("phrase", " [^ ]*$", "")
    parts = longer.select("lang", "f", F.explode(F.array(prefix, F.substr("phrase", cut + 1))).alias("phrase"))
    return parts.groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(documents: DataFrame, top: int = 2000, percent: int = 100, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's first ``top`` phrases of two words or more. Options as of ``phrase_counts``.

    score is floor(1000 * a * n / (l * r)) of the lowest-scoring cut, of the first one among equals. A phrase goes if
    ``percent`` in a hundred of its occurrences lie within one longer phrase. Products are decimals of 38 digits.
    """
    totals, levels = phrase_counts(documents, **options)
    found = None
    for shorter, longer in zip(levels[1:], [*levels[2:], None], strict=True):
        if longer is not None:
            most = _longer_counts(longer)
            shorter = shorter.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("f"))).drop("most")
        found = shorter if found is None else found.unionByName(shorter)
    found = shared.joined_to_groups(found, totals, ["lang"], "n")
    wide = lambda c: c.cast("decimal(38,0)")
    found = found.withColumn("wide", F.lit(1000).cast("decimal(4,0)") * F.col("f").cast("decimal(17,0)") * F.col("n").cast("decimal(17,0)"))
    cut = F.transform(F.arrays_zip("firsts", "rests"), lambda c, k: F.struct(F.call_function("div", wide(F.col("wide")), c["firsts"].cast("decimal(19,0)") * c["rests"].cast("decimal(19,0)")).alias("score"), k.alias("k"), c["firsts"].alias("l"), c["rests"].alias("r")))
    found = found.withColumn("cut", F.array_min(cut)).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(shared.documents(spark, sf_dir))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, range(1, 6) AS s(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
parts AS (
  SELECT lang, a, array_to_string(w[i:j], ' ') AS phrase
  FROM candidates, range(1, 5) AS s(i), range(2, 6) AS e(j) WHERE i < j AND j <= k AND j - i + 1 < k),
longer AS (SELECT lang, phrase, max(a) AS most FROM parts GROUP BY lang, phrase),
cuts AS (
  SELECT c.lang, c.phrase, c.a, g AS cut, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.a * n::HUGEINT) // (l.f::HUGEINT * r.f) AS score
  FROM candidates c, range(1, 5) AS s(g) JOIN totals t ON t.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.k = g AND l.phrase = array_to_string(c.w[1:g], ' ')
  JOIN f r ON r.lang = c.lang AND r.k = c.k - g AND r.phrase = array_to_string(c.w[g + 1:], ' ')
  WHERE g < c.k),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (
  SELECT o.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, o.phrase) AS rank
  FROM lowest o LEFT JOIN longer g USING (lang, phrase) WHERE g.most IS NULL OR 100 * g.most < 100 * a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""
