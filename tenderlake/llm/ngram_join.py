"""N-gram Jaccard join: groups of documents whose sets of word shingles are nearly equal.

Sets that link share a token among the first few of each under any common order, and several among a few more. Shingles
whose documents are few come first and are keys by themselves; where a set has too few of those, its prefix is extended
and pairs of its frequent shingles are keys. Candidates are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm import shared
from tenderlake.llm.components import grouped
from tenderlake.llm.textbytes import BASE, IS_SPACED, mixed, pieces, ragged, runs, words

#: Share of the hash range whose shingles may be rare ones; those above count as frequent.
ZONE = 0.2


def _shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text in order of (text, hash), and each text's bounds in them."""
    found = words(column, IS_SPACED)
    hashes, n = found.hashes(), len(column)
    values, text = runs(hashes, found.text, size)
    bounds = found.bounds()
    counts = np.diff(bounds)
    for few in range(1, size):  # fewer words than a shingle: the whole sequence
        short = np.flatnonzero(counts == few)
        whole = np.full(len(short), few, np.uint64)
        for k in range(few):
            whole = mixed(whole * BASE + hashes[bounds[short] + k])
        values, text = np.concatenate([values, whole]), np.concatenate([text, short])
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[first], np.searchsorted(text[first], np.arange(n + 1))


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


def _needed(n: np.ndarray) -> np.ndarray:
    """Rare shingles in the prefixes that two sets must share, of which the larger has ``n``; see NEEDED."""
    return 2 + n // 32


#: The same as SQL. A pair of frequent shingles counts as all that are needed.
NEEDED, ALL = "2 + greatest({a}, {b}) div 32", 1 << 40


def _spread(size_class: int, percent: int) -> int:
    """Groups that frequent shingles of a size class are dealt to; a class holds the sizes of so many binary digits."""
    return max(1, int(_prefix(np.int64(1 << size_class - 1), percent)) // 2)


def _longest(n: np.ndarray, percent: int) -> np.ndarray:
    """How far a prefix may be extended."""
    up = n * 100 // percent + 1
    return _prefix(n, percent) + _prefix(up, percent) // 2 + 1 + _needed(up)


def shingle_sets(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, s1, s2, low): the set's size, 128 bits that identify it, and its first shingles by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = np.uint64(int(ZONE * 2**64))
        for batch in pieces(batches, "text"):
            values, bounds = _shingles(batch.column(1), size)
            n = np.diff(bounds)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (values, mixed(values ^ np.uint64(0x5851F42D4C957F2D)))]
            zone = np.concatenate([[0], np.cumsum(values < limit)])
            keep = np.minimum(n, np.maximum(zone[bounds[1:]] - zone[bounds[:-1]], _longest(n, percent)))
            held = np.arange(len(values)) - np.repeat(bounds[:-1], n) < np.repeat(keep, n)
            low = ragged(values[held].view(np.int64), np.concatenate([[0], np.cumsum(keep)]))
            s1, s2 = (pa.array((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64)) for s in sums)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int32)), s1, s2, low], ["doc_id", "n", "s1", "s2", "low"])

    return documents.mapInArrow(run, "doc_id long, n int, s1 long, s2 long, low array<long>")


def _signatures(nodes: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """(key, id, size, weight): what a set is found by.

    Let p be the prefix that shares a shingle at least with any linked set's, rare shingles first. Extended by k - 1 they
    share k. If either has so many rare ones, k keys are shared. Otherwise, extended further by the number of groups, they
    share k rare ones, or more frequent ones than there are groups, so two in one group: a key of weight ALL.
    """
    limit = np.uint64(int(ZONE * 2**64))
    frequent = np.append(frequent, np.uint64(2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            low = batch.column(2)
            values = low.flatten().to_numpy().view(np.uint64)
            counts = low.value_lengths().to_numpy().astype(np.int64)
            text = np.repeat(np.arange(len(ids)), counts)
            rare = (values < limit) & (frequent[np.searchsorted(frequent, values)] != values)
            so_far = np.concatenate([[0], np.cumsum(rare)])
            bounds = np.concatenate([[0], np.cumsum(counts)])
            rank = so_far[:-1] - so_far[bounds[text]]
            up = n * 100 // percent + 1
            reach = _prefix(n, percent) + _needed(up) - 1
            use = rare & (rank < reach[text])
            keys, of = [values[use]], [text[use]]
            singles = int(use.sum())
            rares = so_far[bounds[1:]] - so_far[bounds[:-1]]
            for d in np.flatnonzero(rares < reach):
                own = slice(bounds[d], bounds[d + 1])
                others = values[own][~rare[own]]
                for size_class in {int(n[d]).bit_length(), int(up[d]).bit_length()}:
                    spread = _spread(size_class, percent)
                    chosen = others[: reach[d] + spread - rares[d]]
                    group = chosen % np.uint64(spread)
                    order = np.argsort(group, kind="stable")
                    chosen, sizes = chosen[order], np.bincount(group.astype(np.int64), minlength=spread)
                    for at, m in zip(np.cumsum(sizes) - sizes, sizes):
                        if m > 1:
                            i, j = np.triu_indices(m, 1)
                            keys.append(mixed(mixed(chosen[at + i] * BASE + chosen[at + j]) ^ np.uint64(size_class)))
                            of.append(np.full(len(i), d))
            keys, of = np.concatenate(keys), np.concatenate(of)
            weight = np.ones(len(keys), np.int64)
            weight[singles:] = ALL
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[of]), pa.array(n[of].astype(np.int32)), pa.array(weight)], ["key", "id", "size", "weight"])

    return nodes.select("doc_id", "n", "low").mapInArrow(run, "key long, id long, size int, weight long")


def near_groups(documents: DataFrame, id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90, few: int = 5, most_frequent: int = 1 << 21) -> DataFrame:
    """Returns a row per document: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    A document's set is its distinct ``size``-word shingles, A-Z lower-cased; with fewer words, all of them as one. Two
    link when intersection / union >= ``percent`` / 100, exactly. Null and empty texts have no set and no link. Rows
    with equal ids are one document; rows without an id keep their place, and belong to the component of an equal set.
    A shingle is frequent from ``few`` sets on, or from so many that at most ``most_frequent`` are: that list is
    sent to all tasks.
    """
    source = shared.only(documents, doc_id=id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    sets = shared.written(shingle_sets(source, size, percent), "sets")
    plain = shared.written(sets.select("doc_id", "n", "s1", "s2"), "plain")
    classes = shared.written(plain.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("m")), "classes")
    least = percent / (100 - percent) if percent < 100 else float("inf")  # smaller sets link with equal ones only
    firsts = shared.written(classes.where((F.col("n") >= least) & F.col("node").isNotNull()).select(F.col("node").alias("doc_id")), "firsts")
    nodes = sets.join(shared.small(firsts), "doc_id", "left_semi")
    seen = F.slice("low", 1, F.expr(f"cast((n - ceil(n * {percent} / 100D) + 1) * 1.5 + 4 as int)"))
    total = nodes.agg(F.coalesce(F.sum(F.size(seen)), F.lit(0))).first()[0]  # one row
    counts = nodes.select(F.explode(seen).alias("token")).groupBy("token").count().where(F.col("count") >= max(few, total // most_frequent))
    frequent = np.sort(counts.select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64))  # at most ``most_frequent`` rows

    entries = shared.with_partners(_signatures(nodes, frequent, percent), "held")
    strong = entries.groupBy("id").agg(F.sum("weight").alias("w"), F.max("size").alias("n")).where("w >= " + NEEDED.format(a="n", b="n"))
    ids = shared.written(strong.select(F.col("id").alias("doc_id")), "ids")
    shared.drop(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            values, bounds = _shingles(batch.column(1), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), ragged(values.view(np.int64), bounds)], ["id", "tokens"])

    whole = source.join(shared.small(ids), "doc_id", "left_semi").mapInArrow(run, "id long, tokens array<long>")
    whole = shared.written(whole, "whole")
    if whole.count() > ids.count():  # rows with equal ids
        whole, double = shared.written(whole.dropDuplicates(["id"]), "whole"), whole
        shared.drop(double)
    # Shingles that no other of these sets has are in no intersection, which few sets outlive. Those that do are joined by
    # the rarest of their shingles among themselves.
    alone = whole.select("id", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1")
    alone = shared.small(shared.written(alone.groupBy("id").agg(F.count(F.lit(1)).alias("u")), "alone"))
    left = whole.join(alone, "id", "left").where(f"100 * (size(tokens) - coalesce(u, 0)) >= {percent} * size(tokens)").select("id", "tokens")
    left = shared.written(left, "left")
    shared.drop(whole)
    tokens = left.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    counts = shared.written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counts")
    ordered = tokens.join(counts, "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("o")).withColumn("u", F.expr("n - size(o)"))
    first = F.slice("o", 1, F.expr(f"greatest(0, cast(n - ceil(n * {percent} / 100D) + 1 as int) - u)"))
    ranked = ordered.select("id", "n", "u", F.transform(first, lambda x: x["token"]).alias("keys")).where("size(keys) > 0")
    found_by = ranked.select(F.posexplode("keys").alias("at", "key"), "id", "n", "u").select("key", "id", "n", (F.col("u") + F.col("at")).alias("at"))
    found_by = shared.written(found_by, "found_by")
    shared.drop(counts)
    # At the first key that a pair shares, no more than what stands behind it in either set can be shared.
    possible = f"least(n - at, n_ - at_) * {100 + percent} >= {percent} * (n + n_)"

    def check(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
        return both.where(F.col("shared") * 100 >= percent * (F.size("x") + F.size("y") - F.col("shared"))).select("a", "b")

    found = shared.written(grouped(found_by, possible, lambda ids: left, check), "found")
    shared.drop(left, found_by)
    components = shared.written(classes.join(found, "node", "left").select("n", "s1", "s2", F.coalesce("component", "node").alias("component"), F.col("m")), "components")
    some = shared.joined_to_groups(plain.where("n > 0"), components, ["n", "s1", "s2"], size="m")
    return some.unionByName(plain.where("n = 0"), allowMissingColumns=True).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """The documents (all columns) that are the first of their group of near equal ones; of rows with equal ids one stays."""
    groups = shared.written(near_groups(documents, **options).select("doc_id", "component_id").where("doc_id is not null"), "groups")
    if not groups.groupBy("doc_id").count().where("count > 1").isEmpty():
        documents = documents.where("doc_id is null").unionByName(documents.where("doc_id is not null").dropDuplicates(["doc_id"]))
    gone = shared.written(groups.where("doc_id != component_id").select("doc_id").distinct(), "gone")
    return documents.join(shared.small(gone), "doc_id", "left_anti").select(*documents.columns)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(shared.documents(spark, sf_dir))
