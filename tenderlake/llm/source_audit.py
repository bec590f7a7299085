"""Source divergence audit by sorting pointers to words.

A task takes a chunk of texts as one Arrow buffer and builds a pointer to each word's first byte. Pointers, never words,
are sorted: a multikey quicksort whose characters are slices of eight bytes orders pointers within runs of equal slices
and goes on to the next slice only where a run is longer than one and its words are longer than the slice. Runs that are
equal to the end are the terms; their lengths by text, lang and source are the shard's document frequencies and counts.
Shards add up by term, and terms in enough documents of a lang are kept with their count in each source.

Divergence of a source from another, and of a term from its lang, is the term of chi-squared of probabilities in parts of
10**9: all of it integers.

Rows: null text, lang and source are '', ids are not used (a repeated row is a document of its own), other columns don't
matter. A group without terms has probabilities too. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderlake.llm import shared, textbytes

#: Parts of a probability.
PARTS = 1_000_000_000
#: Bytes of text in a shard, and terms times sources of a block of the comparison.
CHUNK, CELLS = 8 << 20, 1 << 20
IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(97, 123), *range(128, 256)]] = True
#: How many bytes of the last slice count, as a mask.
MASK = np.array([(0xFFFFFFFFFFFFFFFF << (64 - 8 * k)) & 0xFFFFFFFFFFFFFFFF for k in range(9)], np.uint64)


def sorted_runs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in the order of their words' bytes, and where in that order a new word begins.

    Words don't hold zero bytes, so a slice that is filled up with zeros is that of no other word.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def slices(p: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(size[p] - depth, 0, 8)
        at = np.minimum(start[p] + depth, len(data))
        return np.ascontiguousarray(view[at]).view(">u8").ravel().astype(np.uint64) & MASK[left]

    order = np.arange(len(start))
    key = slices(order, 0)
    order = np.argsort(key, kind="quicksort")
    opens = np.ones(len(order), bool)
    opens[1:] = np.diff(key[order]) != 0
    depth = 8
    run = np.cumsum(opens) - 1
    open_runs = (np.bincount(run) > 1)[run] if len(run) else opens
    places = np.flatnonzero(open_runs & (size[order] > 8))  # a run's words of eight bytes and fewer are equal: they go on as nothing
    if len(places):
        places = np.flatnonzero(open_runs & np.isin(run, run[places]))
    while len(places):
        p, group = order[places], run[places]
        key = slices(p, depth)
        turn = np.lexsort((key, group))
        order[places] = p[turn]
        key, group = key[turn], group[turn]
        new = np.ones(len(places), bool)
        new[1:] = (np.diff(key) != 0) | (np.diff(group) != 0)
        opens[places] |= new
        sub = np.cumsum(new) - 1
        depth += 8
        longest = np.zeros(sub[-1] + 1, np.int64)
        np.maximum.at(longest, sub, size[order[places]])
        goes_on = ((np.bincount(sub) > 1) & (longest > depth))[sub]
        run[places] = sub
        places = places[goes_on]
        if 0 < len(places) < 64:  # a few long words: compared as they are
            for r in np.unique(run[places]):
                own = places[run[places] == r]
                words = sorted((data[start[p] : start[p] + size[p]].tobytes(), p) for p in order[own])
                order[own] = [p for _, p in words]
                opens[own] |= np.array([True] + [a[0] != b[0] for a, b in zip(words, words[1:], strict=False)])
            break
    return order, opens


COUNTS = "lang string, term string, sources array<string>, counts array<bigint>, n_docs bigint"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard's terms: by lang and term the counts in its sources, and the number of documents."""
    for batch in textbytes.pieces(batches, "text", CHUNK):
        text = batch.column(0).fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = textbytes.LOWER[np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
        offsets = offsets - offsets[0]
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = IS_TERM[data]
        new = np.zeros(len(data) + 1, bool)
        new[offsets] = True
        start = np.flatnonzero((inside[1:] == 1) & ((inside[:-1] == 0) | new))
        if not len(start):
            continue
        size = np.flatnonzero((inside[:-1] == 1) & ((inside[1:] == 0) | new)) - start
        order, opens = sorted_runs(data, start, size)
        of_text = np.searchsorted(offsets, start, "right") - 1
        langs, sources = (batch.column(k).fill_null("").dictionary_encode() for k in (1, 2))
        lang, source = (np.asarray(x.indices).astype(np.int64) for x in (langs, sources))
        term = np.cumsum(opens) - 1
        doc, n = np.unique(term * len(text) + of_text[order], return_counts=True)  # each term's documents
        term, doc = doc // len(text), doc % len(text)
        group = (term * len(langs.dictionary) + lang[doc]) * len(sources.dictionary) + source[doc]
        turn = np.argsort(group, kind="stable")
        cell, first = np.unique(group[turn], return_index=True)
        counts = np.add.reduceat(n[turn], first)
        of_lang, begin, of = np.unique(cell // len(sources.dictionary), return_index=True, return_inverse=True)
        docs = np.zeros(len(of_lang), np.int64)
        np.add.at(docs, of, np.diff(np.append(first, len(turn))))
        head = order[opens][of_lang // len(langs.dictionary)]
        ends = np.concatenate([[0], np.cumsum(size[head])])
        where = np.repeat(start[head] - ends[:-1], size[head]) + np.arange(ends[-1])
        terms = pa.LargeStringArray.from_buffers(len(head), pa.py_buffer(ends), pa.py_buffer(data[where]))
        bounds = pa.array(np.append(begin, len(cell)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                langs.dictionary.take(pa.array(of_lang % len(langs.dictionary))).cast(pa.string()), terms.cast(pa.string()),
                pa.ListArray.from_arrays(bounds, sources.dictionary.take(pa.array(cell % len(sources.dictionary))).cast(pa.string())),
                pa.ListArray.from_arrays(bounds, pa.array(counts.astype(np.int64))), pa.array(docs),
            ],
            names=["lang", "term", "sources", "counts", "n_docs"],
        )


def kept_terms(documents: DataFrame, least_docs: int = 3, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, term, sources (array of source and count): terms in ``least_docs`` documents of their lang or more, counts over all documents."""
    shards = shared.only(documents, text=text, lang=lang, source=source).mapInArrow(_shards, COUNTS)
    # dealt once by term; a document is in one shard, so its number there comes with one of the sources
    entries = shards.repartition("lang", "term").select("lang", "term", "n_docs", F.posexplode(F.arrays_zip("sources", "counts")).alias("at", "e"))
    by_source = entries.groupBy("lang", "term", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("count"), F.sum(F.when(F.col("at") == 0, F.col("n_docs"))).alias("n_docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.collect_list(F.struct("source", "count")).alias("sources"))  # a row for each source at most
    return by_term.where(F.col("n_docs") >= least_docs).select("lang", "term", "sources")


def _parts(count: Column, size: Column) -> Column:
    """1 + floor(PARTS * (count + 1) / size)."""
    return 1 + F.call_function("div", F.lit(PARTS).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)"), size.cast("decimal(19,0)"))


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pair_sums(groups: dict[str, tuple[list[str], list[int]]]):
    """A function for ``mapInArrow`` over kept terms: a task's sums for each pair of sources of a lang. groups: names and sizes by lang."""

    def parts(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """As ``_parts``, three digits at a time, so that no product passes 64 bits."""
        out, left = np.zeros_like(counts), counts + 1
        whole, left = left // sizes, left % sizes
        out = whole
        for _ in range(3):
            left = left * 1000
            out, left = out * 1000 + left // sizes, left % sizes
        return out + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        places = {lang: {s: k for k, s in enumerate(names)} for lang, (names, _) in groups.items()}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            code, lists = np.asarray(langs.indices), batch.column(1)
            bounds = np.asarray(lists.offsets).astype(np.int64)
            base, flat = bounds[0], lists.flatten()
            sources, counts = flat.field(0).dictionary_encode(), np.asarray(flat.field(1)).astype(np.int64)
            for c, lang in enumerate(langs.dictionary.to_pylist()):
                names, sizes = groups[lang]
                total = sums.setdefault(lang, np.zeros((len(names), len(names)), np.int64))
                sizes, rows = np.array(sizes, np.int64), np.flatnonzero(code == c)
                place = np.array([places[lang].get(s, -1) for s in sources.dictionary.to_pylist()], np.int64)
                step = max(1, CELLS // len(names))
                for k in range(0, len(rows), step):
                    own = rows[k : k + step]
                    n = bounds[own + 1] - bounds[own]
                    cells = np.repeat(bounds[own] - base - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    table = np.zeros((len(own), len(names)), np.int64)
                    table[np.repeat(np.arange(len(own)), n), place[np.asarray(sources.indices)[cells]]] = counts[cells]
                    p = parts(table, sizes)
                    for s in range(len(names)):
                        d = p[:, s : s + 1] - p
                        total[s] += (d * d // p).sum(0)
        for lang, total in sums.items():
            names = groups[lang][0]
            at, other = np.nonzero(~np.eye(len(names), dtype=bool))
            take = lambda k: pa.array([names[i] for i in k], pa.string())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), take(at), take(other), pa.array(total[at, other])], names=["lang", "source", "item", "value"])

    return add


def divergences(documents: DataFrame, top: int = 200, least_docs: int = 3, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank.

    part ``pair``: each other source of the lang, by the sum of divergences over all kept terms; part ``term``: the
    ``top`` terms that are more probable in the source than in its lang. Rank by value, largest first, then item.

    The sizes of all groups come to the driver and go to all tasks. Their number is bounded by the result, which has a
    row for each pair of sources of a lang.
    """
    spark = documents.sparkSession
    kept = shared.written(kept_terms(documents, least_docs, text, lang, source), "terms")
    own = documents.select(F.coalesce(documents[lang], F.lit("")).alias("lang"), F.coalesce(documents[source], F.lit("")).alias("source"))
    terms = kept.select("lang", "term", F.explode("sources").alias("s")).select("lang", "term", "s.*")
    counted = own.distinct().join(terms.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left")
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = counted.join(vocabulary, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = shared.written(groups, "groups")
    sizes: dict[str, tuple[list[str], list[int]]] = {}
    for r in groups.orderBy("lang", "source").collect():
        names, size = sizes.setdefault(r.lang, ([], []))
        names.append(r.source)
        size.append(r.n + r.v)
    sums = kept.select("lang", "sources").mapInArrow(_pair_sums(sizes), "lang string, source string, item string, value bigint")
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("source <> item")  # the rows of the result
    pairs = pairs.join(sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))

    whole = kept.select("lang", "term", F.aggregate("sources", F.lit(0).cast("long"), lambda n, s: n + s["count"]).alias("of_lang"), F.explode("sources").alias("s"))
    of_lang = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    size = shared.small(shared.written(groups.join(of_lang, "lang").select("lang", "source", (F.col("n") + F.col("v")).alias("size"), (F.col("lang_n") + F.col("v")).alias("lang_size")), "sizes"))
    found = whole.select("lang", "term", "of_lang", "s.*").join(size, ["lang", "source"])
    found = found.withColumns({"p": _parts(F.col("count"), F.col("size")), "q": _parts(F.col("of_lang"), F.col("lang_size"))}).where("p > q")
    found = found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _divergence(F.col("p"), F.col("q")).alias("value"))
    found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.unionByName(found)


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(shared.documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
size AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n, any_value(coalesce(v.v, 0)) AS v
  FROM groups g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source LEFT JOIN v ON v.lang = g.lang GROUP BY g.lang, g.source),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // CAST(s.n + s.v AS HUGEINT) AS p
  FROM size s JOIN kept k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
lang_size AS (SELECT lang, sum(n) + any_value(v) AS size FROM size GROUP BY lang),
q AS (
  SELECT c.lang, c.term, 1 + CAST(1000000000 AS HUGEINT) * (sum(c.n) + 1) // CAST(any_value(l.size) AS HUGEINT) AS q
  FROM c JOIN lang_size l ON l.lang = c.lang GROUP BY c.lang, c.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // q.q FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
