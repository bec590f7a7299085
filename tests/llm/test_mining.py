"""Collocations and the source audit against plain loops, and on odd rows."""

import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from tenderlake.llm import collocations, source_audit
from tests.llm.helpers import LOWER, ODD, SCHEMA, docs


def table(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    return spark.createDataFrame([(i, t, lang, source, None, 0, "k", 1) for i, t, lang, source in rows], SCHEMA)


def plain_collocations(rows, top, least, percent, longest=5):
    """(lang, rank, phrase, a, l, r, n, score) by loops; a phrase within any longer one, however much longer."""
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    parts = lambda w: {w[i:j] for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w)}
    gone = {(lang, p) for (lang, w), a in candidates.items() for p in parts(w) if 100 * a >= percent * f[lang, p]}
    found = collections.defaultdict(list)
    for (lang, w), a in candidates.items():
        if (lang, w) not in gone:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            found[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, own in found.items() for r, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)}


def prose_of(n, seed, vocabulary=14):
    r = random.Random(seed)
    pool = ["a", "of", "The", "été", "x\x0by", "日本", "end.", "stop!"] + [f"w{i}" for i in range(vocabulary)]
    return [(i, " ".join(r.choice(pool) for _ in range(r.randint(0, 40))) + r.choice(["", " fixed turn of phrase here now", "\tone  two\nthree"]), r.choice(["en", "en", "de", None, "und"]), r.choice("abc")) for i in range(n)]


def test_collocations_match_plain_loops(spark):
    rows = prose_of(300, 1)
    for options in ({"least": 5, "top": 30, "percent": 100}, {"least": 12, "top": 2000, "percent": 60}):
        got = {tuple(r) for r in collocations.collocations(table(spark, rows), **options).collect()}
        assert got == plain_collocations(rows, **options) and len(got) > 10
    repeated = [(1, "ha ha ha ha ha ha " * 40, "en", "s")] * 3  # a hot phrase that overlaps itself
    assert {tuple(r) for r in collocations.collocations(table(spark, repeated), least=2).collect()} == plain_collocations(repeated, 2000, 2, 100)


def test_a_chunk_is_gone_before_the_next(monkeypatch):
    """Counting four chunks takes no more memory at a time than counting one."""
    monkeypatch.setattr(collocations, "CHUNK", 1 << 20)
    r = random.Random(2)
    text = " ".join(f"w{r.randrange(2000)}" for _ in range(170_000))
    assert len(text) < collocations.CHUNK < 1.5 * len(text)

    def peak(n):
        batch = pa.RecordBatch.from_arrays([pa.array([text] * n), pa.array(["en"] * n)], names=["text", "lang"])
        tracemalloc.start()
        assert sum(1 for _ in collocations._stripes(1, None, frozenset())(iter([batch]))) == n
        return tracemalloc.get_traced_memory()[1], tracemalloc.stop()

    peak(1)
    assert peak(4)[0] < 1.1 * peak(1)[0]


def test_collocations_on_odd_rows(spark):
    rows = [(i, t, None, None) for i, t in ODD] + [(20, "x" * 3_000_000 + " y", "en", None), (21, "b c " * 1_200_000, "en", None), (22, "...,,;", "", None)]
    got = {tuple(r) for r in collocations.collocations(table(spark, rows)).collect()}
    assert got == plain_collocations(rows, 2000, 100, 100)
    for none in ([], [(1, None, None, None)], [(1, "too few", "en", "a")]):
        assert collocations.collocations(table(spark, none)).count() == 0


def test_split_stripes_add_up(spark):
    """Words that most phrases begin with have stripes in segments; counts are those of plain loops all the same."""
    r = random.Random(7)
    rows = [(i, " ".join(f"the w{r.randrange(30)}" for _ in range(30)), "en", "s") for i in range(120)]
    assert {tuple(x) for x in collocations.collocations(table(spark, rows), least=4).collect()} == plain_collocations(rows, 2000, 4, 100)


def test_large_products(spark):
    """Beyond 64 bits: counts as large as a real corpus would have."""
    totals = spark.createDataFrame([("en", 9 * 10**14)], "lang string, n long")
    one = spark.createDataFrame([("en", "a b", 8 * 10**13 + 1, [3 * 10**14 + 7], [10**14 + 9])], "lang string, phrase string, f long, firsts array<long>, rests array<long>")
    none, kept = one.where("false"), collocations.phrase_counts
    try:
        collocations.phrase_counts = lambda *_, **__: (totals, [none, one, none, none, none])
        got = collocations.collocations(one).first()
    finally:
        collocations.phrase_counts = kept
    assert got.score == 1000 * (8 * 10**13 + 1) * 9 * 10**14 // ((3 * 10**14 + 7) * (10**14 + 9))


def plain_audit(rows, top=200, least_docs=3):
    docs_of, count, groups = collections.Counter(), collections.Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups.add((lang, source))
        docs_of.update((lang, x) for x in set(w))
        count.update((lang, source, x) for x in w)
    out = set()
    for lang, source in groups:
        terms = [x for (k, x), n in docs_of.items() if k == lang and n >= least_docs]
        others = sorted(s for k, s in groups if k == lang)

        def p(own, terms=terms, lang=lang):
            c = {x: sum(count[lang, s, x] for s in own) for x in terms}
            size = sum(c.values()) + len(terms)
            return {x: 1 + 10**9 * (c[x] + 1) // size for x in terms}

        mine, whole = p([source]), p(others)
        value = lambda q, x, mine=mine: (mine[x] - q[x]) ** 2 // q[x]
        pairs = [(-sum(value(q, x) for x in terms), s.encode()) for s in others if s != source for q in [p([s])]]
        found = [(-value(whole, x), x.encode()) for x in terms if count[lang, source, x] and mine[x] > whole[x]]
        for part, own, most in (("pair", pairs, None), ("term", found, top)):
            out |= {(lang, source, part, item.decode(), -v, r) for r, (v, item) in enumerate(sorted(own)[:most], 1)}
    return out


def test_audit_matches_plain_loops(spark):
    r = random.Random(3)
    rows = [(i, t + " antidisestablishmentarianism" * r.randrange(3) + " antidisestablishmentarian" * r.randrange(2), lang, source if r.random() < 0.9 else None) for i, t, lang, source in prose_of(250, 2, 60)]
    rows += [(500 + i, f"only{i} here", "fr", "a") for i in range(3)] + [(600, "1 2 3", "xx", "q"), (601, None, "xx", "r")]
    for top in (200, 3):
        got = {tuple(x) for x in source_audit.divergences(table(spark, rows), top=top).collect()}
        assert got == plain_audit(rows, top)
    assert any(x[:2] == ("xx", "q") and x[4] == 0 for x in got)  # a lang without kept terms has its pairs


def test_audit_on_odd_rows(spark):
    rows = [(i, t, None, "s" if k % 2 else None) for k, (i, t) in enumerate(ODD * 2)] + [(30, "y" * 3_000_000, "en", "a"), (31, "b c " * 700_000, "en", "b")] + [(32, "b", "en", "a")] * 3
    assert {tuple(x) for x in source_audit.divergences(table(spark, rows)).collect()} == plain_audit(rows)
    assert source_audit.divergences(docs(spark, [])).count() == 0


def test_sorted_runs():
    """Pointers against Python's sort of bytes: shared beginnings of every length around the slices."""
    r = random.Random(5)
    words = [("ab" * 20)[: r.randint(1, 33)] + r.choice(["", "", "x", "é", "zz" * 9]) for _ in range(3000)] + ["q" * 5000] * 3 + ["q" * 5001]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    size = np.array([len(w.encode()) for w in words])
    start = np.cumsum(size + 1) - size - 1
    order, opens = source_audit.sorted_runs(data, start, size)
    got = [words[k].encode() for k in order]
    assert got == sorted(got) and sorted(order) == list(range(len(words))) and opens.tolist() == [True] + [a != b for a, b in zip(got, got[1:], strict=False)]
    assert len(source_audit.sorted_runs(data, start[:0], size[:0])[0]) == 0


def test_parts_of_large_counts():
    """Three digits at a time as in one division, where the product would pass 64 bits."""
    own = source_audit._pair_sums({"en": (["a", "b"], [9 * 10**15 // 1000, 7 * 10**12])})
    counts = [[6 * 10**11 + 5, 3], [10**12, 6 * 10**11]]
    structs = pa.array([[{"source": "a", "count": a}, {"source": "b", "count": b}] for a, b in counts], pa.list_(pa.struct([("source", pa.string()), ("count", pa.int64())])))
    (got,) = own(iter([pa.RecordBatch.from_arrays([pa.array(["en", "en"]), structs], names=["lang", "sources"])]))
    p = [[1 + 10**9 * (n + 1) // size for n, size in zip(row, (9 * 10**12, 7 * 10**12), strict=True)] for row in counts]
    assert got.column("value").to_pylist() == [sum((a - b) ** 2 // b for a, b in p), sum((b - a) ** 2 // a for a, b in p)]
