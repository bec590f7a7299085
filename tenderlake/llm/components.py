"""Connected groups of a graph that is given as blocks of candidates and an exact test of pairs.

All of it is joins and aggregates with partial sums: no block, component or node's links ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm import shared


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b) that isn't its component's smallest, which is its ``component``.

    Alternates large-star and small-star steps until nothing changes: each node is hung under the smallest of its
    neighbourhood, first its larger neighbours, then its smaller ones. Links may repeat and go either way.
    """
    down = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    stars = shared.written(links.select(*down).where("a != b").distinct(), "links")
    before = None
    while True:
        now = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()  # one row
        if now == before or not now[0]:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
        both = stars.union(stars.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = large.where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b"), F.col("m"))).where("a != b").distinct()
        older, stars = stars, shared.written(small, "links")
        shared.drop(older)


def grouped(entries: DataFrame, possible: str, texts: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame, DataFrame], DataFrame], finer: Column | None = None, bound: str = "true", linked: str = "", prepare: Callable[[DataFrame], DataFrame] = lambda texts: texts, small: int = 16, spare: int = 64, share: int = 1024, parts: int = 1) -> DataFrame:
    """(node, component) of the graph whose links are the pairs that share a key and pass ``check``.

    entries: (key, id, size, ...). ``possible`` is SQL over a pair's columns, the second's with a ``_`` behind, that every
    link meets. texts: (id, ...) of ids, what check needs. check: of distinct pairs (a, b) and these texts, those that link.

    All pairs of a block of up to ``small`` ids are tested. In a larger block each id is held against the block's first,
    so a block of copies takes a test each, not all pairs.

    Without ``finer`` ids are then held against one id of their block after the other, chosen by hash, as long as that merges
    components and what is still apart within blocks is more than ``spare`` pairs for each row (before ``possible``). Then
    all pairs across components are tested, so no link of any block is lost.

    With ``finer``, large blocks are first also dealt to smaller ones by these keys, and of those the small ones tested in full, the
    others against their first. Then ids are held against one id of their block after the other while that lowers what is apart by
    a tenth at least, and then too all pairs across components are tested: by ``linked``, SQL over a pair's columns and its texts'
    that says what ``check`` does, where the block is, so no pair is written or shuffled. A pair is tested once, in the least block that both
    are in, and only if it meets ``bound``, SQL over the same that every link meets. ``prepare`` adds what only these two need to the texts. Blocks are spread over tasks, ``share`` ids each.
    Entries are dealt in ``parts``, by key, one after the other; they are computed once for each, and no more once texts is called.
    """
    columns = [c for c in entries.columns if c != "key"]
    second = [F.col(c).alias(f"{c}_") for c in columns]
    label_ = F.col("label").alias("label_")

    def candidates(rows: DataFrame) -> DataFrame:
        return rows.where("id != id_").select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).distinct()

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        """Rows of blocks of two ids or more, with the number that the block has ("held")."""
        return shared.written(shared.with_partners(rows, "held"), name)

    def part_of(rows: DataFrame, i: int) -> DataFrame:
        return rows.where(F.pmod(F.xxhash64("key", F.lit(0)), F.lit(parts)) == i) if parts > 1 else rows

    def all_pairs(rows: DataFrame, apart: str = "true") -> DataFrame:
        return rows.join(rows.select("key", *(F.col(c).alias(f"{c}_") for c in rows.columns if c not in ("key", "held"))), "key").where(f"id < id_ and {possible} and {apart}")

    def against_one(rows: DataFrame, chosen: Column, apart: str = "true") -> DataFrame:
        ones = rows.groupBy("key").agg(chosen.alias("one")).select("key", "one.*")
        return rows.join(ones, "key").where(f"id != id_ and {possible} and {apart}")

    def apart(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, float, int]:
        """Rows of blocks that hold more than one component, which is the label; pairs across components; rows."""
        now = rows.drop("label", "_top", "_rows").join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
        parts = now.groupBy("key", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
        mixed = parts.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"), F.max_by("label", "n").alias("_top")).where("labels > 1")
        mixed = shared.written(mixed, "mixed")
        pairs, held = mixed.agg(F.coalesce(F.sum(F.col("n") * F.col("n") - F.col("within")) / 2, F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()  # one row
        return (shared.written(now.join(mixed.select("key", "_top", F.col("n").alias("_rows")), "key"), "apart") if pairs else now), pairs, held

    def links_across(rows: DataFrame, known: DataFrame, pairs: float) -> DataFrame:
        """Links of all ``pairs`` of a block's ids of different components, each pair tested in the least block that it shares.

        A block's largest component meets the others, and these each other, so its own pairs are not even formed.
        """
        keys = rows.groupBy("id").agg(F.collect_list("key").alias("keys"))
        own = shared.written(prepare(known).join(keys, "id"), "own")
        found = shared.in_parts(parts, lambda i: links_of(part_of(rows, i).join(own, "id"), pairs / parts), "linked")
        shared.drop(own)
        return found

    def links_of(full: DataFrame, pairs: float) -> DataFrame:
        parts = F.ceil(F.col("_rows") / share).cast("long")
        tasks = max(int(full.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs // 500_000))
        others = full.where("label != _top").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_top", "_rows")
        others = others.select("key", "part", *(F.col(c).alias(f"{c}_") for c in others.columns if c not in ("key", "part")))
        dealt = full.withColumn("part", F.pmod(F.xxhash64("id"), parts)).repartition(tasks, "key", "part").join(others.repartition(tasks, "key", "part"), ["key", "part"])
        cheap = f"label != label_ and (label = _top or id < id_) and {possible} and {bound}"
        return dealt.where(f"case when {cheap} then case when key = array_min(array_intersect(keys, keys_)) then {linked} else false end else false end").select(F.col("id").alias("a"), F.col("id_").alias("b"))

    def pairs_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs to test of dealt rows, and the rows of large blocks."""
        few, many = rows.where(F.col("held") <= small), rows.where(F.col("held") > small).drop("held")
        return candidates(all_pairs(few)).union(candidates(against_one(many, F.min_by(F.struct(*second), "id")))), many

    def dealt_in_parts(rows: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
        """Pairs to test of rows, and the rows of large blocks, as stored tables: a part of the keys after the other."""
        pairs, large = [], []
        for i in range(parts):
            part = dealt(part_of(rows, i), "members")
            tested, many = pairs_of(part)
            pairs.append(shared.written(tested, "pairs"))
            large.append(shared.written(many, "many"))
            shared.drop(part)
        return pairs, large

    if finer is not None:
        pairs, large = dealt_in_parts(entries)
        many = reduce(DataFrame.union, large)
        more, large = dealt_in_parts(many.withColumn("part", F.explode(finer)).select(F.xxhash64("key", "part").alias("key"), *columns))
        tested = shared.written(reduce(DataFrame.union, pairs + more).distinct(), "pairs")
        shared.drop(*pairs, *more, *large)
        known = texts(tested.select(F.explode(F.array("a", "b")).alias("id")).union(many.select("id")).distinct())
        links = shared.written(check(tested, known), "linked")
        shared.drop(tested)
        found, turn, before = components(links), 0, float("inf")
        rest, across, held = apart(many, found)
        shared.drop(many)
        while across > spare * held and across < 0.9 * before:
            turn, before = turn + 1, across
            one = F.min_by(F.struct("id", *(c for c in columns if c != "id"), "label"), F.xxhash64("id", F.lit(turn)))
            ones = rest.groupBy("key").agg(one.alias("one")).select("key", *(F.col(f"one.{c}").alias(f"{c}_") for c in (*columns, "label")))
            pairs = shared.written(candidates(rest.join(ones, "key").where(f"label != label_ and {possible}")), "pairs")
            links = links.union(shared.written(check(pairs, known), "linked"))
            shared.drop(pairs)
            found, older = components(links), rest
            rest, across, held = apart(rest, found)
            shared.drop(older)
        if across:
            links = links.union(links_across(rest, known, across))
            shared.drop(rest)
            found = components(links)
        shared.drop(known)
        return found
    members = dealt(entries, "members")
    tested, many = pairs_of(members)
    tested = shared.written(tested.distinct(), "pairs")
    known = texts(tested.select(F.explode(F.array("a", "b")).alias("id")).union(many.select("id")).distinct())
    links, found = shared.written(check(tested, known), "linked"), None

    def also(pairs: DataFrame) -> bool:
        """Tests more pairs; whether that has linked any."""
        nonlocal tested, links
        pairs = shared.written(candidates(pairs).join(tested, ["a", "b"], "left_anti"), "pairs")
        ids = shared.written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        new = shared.written(check(pairs, known.join(shared.small(ids), "id", "left_semi")), "linked")
        tested, links = tested.union(pairs), links.union(new)
        return not new.isEmpty()

    found = components(links)
    rest, across, held = apart(many, found)
    turn, merges = 0, True
    while across > spare * held and merges:
        turn += 1
        merges = also(against_one(rest, F.min_by(F.struct(*second, label_), F.xxhash64("id", F.lit(turn))), "label != label_"))
        if merges:
            found = components(links)
            rest, across, held = apart(rest, found)
    if across and also(all_pairs(rest, "label != label_")):
        found = components(links)
    return found
