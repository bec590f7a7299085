"""License scans: exact and fuzzy search for short notices.

A notice within k edits holds one of k + 1 pieces of it unchanged. The pieces' places are the only ones that are looked at
with the regex library's bounded-error matching, which verifies the edits and gives the span.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm import shared
from tenderlake.llm.textbytes import pieces

#: Phrases that count wherever their words stand consecutively, and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notices, searched with errors like the long ones of BASE.
NOTICES = {
    "licensed under the apache license": "apache",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "all-rights-reserved",
    "permission is hereby granted free of charge": "mit-text",
    "permission to use copy modify and or distribute": "isc",
    "this software is provided as is without any express or implied warranty": "zlib",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "boost software license version": "boost",
    "eclipse public license": "epl",
    "released into the public domain": "public-domain",
    "spdx license identifier": "spdx",
}
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MATCHES = "array<struct<label: string, base: boolean, first_word: bigint, words: int, edits: int>>"


def edits(phrase: str) -> int:
    """Errors that are allowed: one in every ten characters, none in short phrases."""
    return len(phrase) // 10 if len(phrase) >= 16 else 0


@lru_cache(maxsize=4)
def _fuzzy(notices: tuple[tuple[str, str], ...]) -> list[tuple[str, int, list[tuple[bytes, int]], regex.Pattern]]:
    """(label, edits, [(piece, place in the phrase)], pattern) of each phrase that errors are allowed in."""
    out = []
    for phrase, label in notices:
        if k := edits(phrase):
            cuts = [len(phrase) * i // (k + 1) for i in range(k + 2)]
            seeds = [(phrase[a:b].encode(), a) for a, b in zip(cuts, cuts[1:])]
            out.append((label, k, seeds, regex.compile(rf"(?e)(?<= )(?:{regex.escape(phrase)}){{e<={k}}}(?= )")))
    return out


@lru_cache(maxsize=65_536)
def _search(pattern: regex.Pattern, window: str) -> tuple[int, int, int] | None:
    """(first byte, words, edits) of the pattern in a window; a text full of a notice has the same few windows."""
    m = pattern.search(window)
    return m and (len(window[: m.start()].encode()), m[0].count(" ") + 1, sum(m.fuzzy_counts))


def matches(text: str | None, base: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]) -> tuple[int, list[tuple]]:
    """The number of words, and (label, base, first_word, words, edits) of every place; fuzzy ones leave out exact base places."""
    words = WORD.findall((text or "").encode().lower())
    line, out, exact = b" " + b" ".join(words) + b" ", [], set()
    starts = list(accumulate((len(w) + 1 for w in words), initial=1))
    for phrase, label in base:
        sought, at = b" " + phrase.encode() + b" ", -1
        while (at := line.find(sought, at + 1)) >= 0:
            out.append((label, True, bisect_left(starts, at + 1), phrase.count(" ") + 1, 0))
            exact.add((at + 1, label))
    for label, k, seeds, pattern in _fuzzy(notices):
        whole, done = b"".join(s for s, _ in seeds), set()
        size, n_words = len(whole.decode()), whole.count(b" ") + 1
        for seed, place in seeds:
            at = -1
            while (at := line.find(seed, at + 1)) >= 0:
                begin = at - len(whole.decode()[:place].encode())
                if begin > 0 and line.startswith(b" " + whole + b" ", begin - 1):  # without an error: nothing to search for
                    found, n, wrong = begin, n_words, 0
                else:
                    # Errors are counted in characters, of four bytes at most: cut in bytes first, then in characters.
                    left, right = place + k + 1, size - place + k + 1
                    before = line[max(0, at - 4 * left) : at].decode(errors="ignore")[-left:]
                    start, window = at - len(before.encode()), before + line[at : at + 4 * right].decode(errors="ignore")[:right]
                    if not (m := _search(pattern, window)):
                        continue
                    found, n, wrong = start + m[0], m[1], m[2]
                if found not in done:
                    done.add(found)
                    if (found, label) not in exact:
                        out.append((label, False, bisect_left(starts, found), n, wrong))
    return len(words), out


def scan(documents: DataFrame, id: str = "doc_id", text: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Returns a row per document: doc_id, n_words, matches (label, base, first_word from 0, words, edits).

    A-Z count as small letters; words are runs of digits, letters and other than ASCII characters, so what stands between
    the words of a notice doesn't matter. ``base`` is matched word for word. ``notices`` and the longer phrases of ``base`` are
    matched with as many ``edits`` as their length allows, between word bounds. Null and empty texts have no words.
    """
    exact, fuzzy = tuple(base.items()), tuple((base | notices).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("words", pa.int32()), ("edits", pa.int32())])
        for batch in pieces(batches, "text"):
            found = [matches(t, exact, fuzzy) for t in batch.column(1).to_pylist()]
            columns = list(zip(*(m for _, own in found for m in own))) or [[]] * len(kind)
            structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))
            rows = pa.ListArray.from_arrays(pa.array(list(accumulate((len(own) for _, own in found), initial=0)), pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), rows], ["doc_id", "n_words", "matches"])

    source = shared.only(documents, doc_id=id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return source.mapInArrow(run, f"doc_id long, n_words long, matches {MATCHES}")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.create_map(*(x for phrase, label in (BASE | NOTICES).items() for x in (F.lit(label), F.lit(len(phrase)))))
    base = F.filter("matches", lambda m: m["base"])
    names = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    likeness = F.transform("matches", lambda m: F.when(m["base"], 1.0).otherwise(1 - m["edits"] / F.get(F.map_values(F.map_filter(sizes, lambda k, v: k == m["label"])), F.lit(0))))
    return scan(shared.documents(spark, sf_dir)).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["first_word"])).alias("first_word"), F.array_max(F.transform(base, lambda m: m["first_word"])).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("matches")).alias("labels"), F.coalesce(F.array_max(likeness), F.lit(0.0)).alias("score"),
    )
