"""Every operator against a plain version, and on odd rows: nulls, empty and long texts, ties, repeated rows, no rows at all."""

import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tenderlake.llm import components, fingerprints, license_scan, line_dedup, mixing, ngram_join, packing, quality, shared, substring_dedup, topk_search, toxicity
from tests.llm.helpers import LOWER, ODD, PLAIN, SPACED, bm25, docs, groups, prose, shingles


# Substring dedup


def test_units_keep_the_first(spark):
    line = "one two three four five six seven eight nine ten"
    rows = [(3, f"x\n{line.upper()}\ny"), (1, f"{line}\nshort"), (2, f"{line}  \n{line}"), (2, None), (4, "short")]
    got = substring_dedup.repeated_units(docs(spark, rows), min_words=10)
    assert sorted((r.doc_id, r.unit, r.start, r.end, r.kept_doc_id, r.kept_start) for r in got.collect()) == [(2, 0, 0, 50, 1, 0), (2, 1, 51, 99, 1, 0), (3, 1, 2, 50, 1, 0)]
    left = {r.doc_id: (r.text, len(r.removed)) for r in substring_dedup.without_repeats(docs(spark, rows).where("text is not null"), min_words=10).collect()}
    assert left == {1: (rows[1][1], 0), 3: ("x\ny", 1), 4: ("short", 0)}  # nothing is left of document 2


def plain_dedup(rows, min_words):
    """Text left of each document, by a loop over lines in order of (doc_id, start)."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        words = [x.lower().split() for x in lines]
        later = [bool(w) and tuple(w) in seen or tuple(w) in map(tuple, words[:k]) for k, w in enumerate(words)]
        seen |= {tuple(w) for w in words if w}
        gone, run = set(), []
        for k in range(len(lines) + 1):
            if k < len(lines) and (later[k] and words[k]):
                run.append(k)
            elif k == len(lines) or words[k]:
                if sum(len(words[j]) for j in run) >= min_words:
                    gone |= set(run)
                run = []
        kept = [k for k in range(len(lines)) if k not in gone]
        if not gone or any(words[k] for k in kept):
            out[i] = "\n".join(lines[k] for k in kept)
    return out


def test_runs_of_units_match_a_plain_loop(spark):
    r = random.Random(4)
    pool = [" ".join(r.choice("abcde") for _ in range(r.randint(0, 6))) for _ in range(25)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 6)))) for i in range(80)]
    got = {x.doc_id: x.text for x in substring_dedup.without_repeats(docs(spark, rows), min_words=8).collect()}
    assert got == plain_dedup(rows, 8) and len(got) < 80 and got != dict(rows)


def test_units_of_paragraphs(spark):
    a = "a b c d e f g h i j\nk"
    table = docs(spark, [(1, a + "\n\nrest"), (2, "new\n \n" + a + "\n\n\nend")])
    got = substring_dedup.without_repeats(table, unit="paragraph", min_words=10).collect()
    assert {r.doc_id: (r.text, [(x.start, x.end, x.kept_doc_id) for x in r.removed]) for r in got} == {1: (a + "\n\nrest", []), 2: ("new\n \nend", [(6, 6 + len(a), 1)])}


def test_units_odd(spark):
    rows = ODD + [(12, "word " * 3000), (13, "w " * 2_500_000)]
    got = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs(spark, rows), min_words=1).collect()}
    assert set(got) == {None, 1, 2, 3, 4, 6, 7, 8, 13} and got[1] is None and got[2] == ""  # 5 repeats 4, and 9 repeats 8
    assert substring_dedup.without_repeats(docs(spark, [])).count() == 0


# Fingerprints


def test_edited_texts(spark):
    rows = [(i, t) for i, t in prose(40, words=60)] + [(100, ""), (101, None), (102, "é" * 7)]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs(spark, rows)).collect()}
    order = sorted(rows, reverse=True, key=lambda x: x[0])
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[100].fingerprint == "" and got[101].near_edited == 1


def test_shared_run_is_found(spark):
    run = " ".join(f"w{i}" for i in range(12))  # window + k - 1 words
    rows = spark.createDataFrame([(1, f"a b c {run} d e"), (2, f"p q r s t u v {run.upper()} x"), (3, "other words alone in here " * 3)], "id long, text string")
    got = {r.id: set(r.fp_hashes) for r in fingerprints.with_fingerprint(rows, "text", "fp").collect()}
    assert got[1] & got[2] and not got[1] & got[3]


def plain_winnowing(text, k=5, window=8):
    """(hash, place) of every window's smallest hash, the rightmost of ties, by loops."""
    signed = 2**64 - 1
    turn = lambda x, n: (x << n | x >> 64 - n) & signed if n else x
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in SPACED.findall(text.lower())]
    grams = []
    for i in range(len(h) - k + 1):
        g = 0
        for j in range(k):
            g ^= turn(h[i + j], k - 1 - j)
        grams.append(g >> 4)
    out = []
    for at in range(max(len(grams) - window + 1, min(len(grams), 1))):
        own = grams[at : at + window]
        place = at + max(j for j, g in enumerate(own) if g == min(own))
        if place not in [p for _, p in out]:
            out.append((grams[place], place))
    return out


def test_winnowing_matches_a_plain_loop(spark):
    rows = [(i, t) for i, t in prose(60, seed=2, words=50) if len(t.split()) >= 5] + [(500, "a b a b a b a b a b a b a b a b a b a b"), (501, "One two three four five")]
    want = {i: plain_winnowing(t) for i, t in rows}
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs(spark, rows)).collect()}
    order = sorted(want, reverse=True)
    for k, i in enumerate(order):
        assert got[i].fingerprint == " ".join(f"{h:x}@{p}" for h, p in want[i])
        a, b = ({h for h, _ in want[j]} for j in (i, order[(k + 1) % len(order)]))
        assert got[i].near_next == pytest.approx(len(a & b) / len(a | b))


def test_fingerprints_odd(spark):
    got = fingerprints.edited_fingerprints(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and len({r.fingerprint for r in got if r.doc_id in (4, 5)}) == 1
    assert fingerprints.edited_fingerprints(docs(spark, [])).count() == 0
    assert fingerprints.edited_fingerprints(docs(spark, [(1, "alone")])).first().near_next == 1


def test_fingerprints_are_native(spark):
    plan = fingerprints.edited_fingerprints(docs(spark, ODD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Classifiers


def labelled_docs(spark, n=600):
    r = np.random.default_rng(0)
    bad = ["vile", "scum", "rot"]
    rows, marks = [], []
    for i in range(n):
        text = [f"w{x}" for x in r.integers(0, 60, 40)]
        toxic = int(r.random() < 0.3)
        if toxic:
            text[int(r.integers(0, 40))] = bad[int(r.integers(0, 3))] + "ness"
        good = int(r.random() < 0.5)
        rows.append((i, " ".join(text) if good else " ".join(x + "!!" for x in text).upper()))
        marks.append((i, good, toxic))
    return docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("f, label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_classifier(spark, f, label):
    table, marks = labelled_docs(spark)
    got = f(table, marks).join(marks, "doc_id").collect()
    assert len(got) == 600 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r[label] for r in held]) > 0.97


@pytest.mark.parametrize("f, label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_classifier_ignores_held_out_labels(spark, f, label):
    table, marks = labelled_docs(spark, 200)
    turned = marks.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col(label)).otherwise(F.col(label)))
    a, b = ({r.doc_id: r.score for r in f(table, m).collect()} for m in (marks, turned))
    assert a == b


@pytest.mark.parametrize("f", [toxicity.toxicity, quality.quality])
def test_classifier_odd(spark, f):
    none = spark.createDataFrame([(4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = f(docs(spark, ODD), none).collect()
    assert len(got) == len(ODD) and all(r.score == 0.5 for r in got)
    table, marks = labelled_docs(spark, 100)
    assert len(f(docs(spark, ODD), marks.union(none)).collect()) == len(ODD) and f(docs(spark, []), marks).count() == 0


def test_pairs_of_terms_are_learned():
    """Two terms that mean something only together: no additive weights can tell."""
    r = np.random.default_rng(1)
    x = r.integers(0, 2, (800, 2))
    y = (x[:, 0] ^ x[:, 1]).astype(float)
    rows = [np.flatnonzero(a) for a in x]
    bounds = np.concatenate([[0], np.cumsum([len(a) for a in rows])])
    model = toxicity.fit(np.array([0, 1]), np.concatenate(rows), bounds, y, epochs=200, favour=1.0)
    assert np.mean((model.scores(np.concatenate(rows), bounds) > 0.5) == y) == 1


def test_machine_matches_pairs_by_loops():
    """The score of each row is the bias, its terms' weights and every pair of their vectors."""
    r = np.random.default_rng(5)
    model = toxicity.FactorizationMachine(np.arange(20), 0.3, r.normal(size=20), r.normal(size=(20, 4)))
    rows = [r.choice(20, n, replace=False) for n in (0, 1, 2, 7, 20)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    got = model.raw(np.concatenate(rows).astype(int), bounds)[0]
    for row, score in zip(rows, got):
        want = 0.3 + sum(model.weights[i] for i in row) + sum(model.vectors[i] @ model.vectors[j] for a, i in enumerate(row) for j in row[:a])
        assert score == pytest.approx(want)


def test_trees_match_a_plain_walk():
    r = np.random.default_rng(6)
    x, y = r.normal(size=(300, 5)), r.integers(0, 2, 300).astype(float)
    model = quality.fit(x, y, trees=7, depth=3)
    for row, score in zip(x[:50], model.raw(x[:50])):
        want = model.start
        for feature, cut, value in zip(model.feature, model.cut, model.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            want += value[node - len(feature)]
        assert score == pytest.approx(want)


def test_training_rows_stay_bounded(spark):
    """Repeated ids of documents don't add to the sample."""
    from tenderlake.llm.labelled import training_rows

    table = docs(spark, [(i % 10, f"t{i}") for i in range(100)])
    marks = spark.createDataFrame([(i, 1, 1) for i in range(10)], "doc_id long, quality int, toxic int")
    got = training_rows(table, marks, "toxic", 4).collect()
    assert len(got) == 4 and all(r.text == min(f"t{j}" for j in range(r.doc_id, 100, 10)) for r in got)


def test_trees_in_arrays():
    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, trees=40)
    assert np.mean((model.scores(x) > 0.5) == y) > 0.98


# Packing


def test_histogram_is_packed_whole():
    r = np.random.default_rng(3)
    for n in (0, 1, 50, 3000):
        lengths = np.minimum(64, r.integers(1, 90, n))
        histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
        got, bins = {}, 0
        for number, held in packing.pack_histogram(histogram, 64, rounds=40):
            assert sum(a * k for a, k in held) <= 64
            bins += number
            for a, k in held:
                got[a] = got.get(a, 0) + number * k
        assert got == histogram and bins <= 1.05 * -(-int(lengths.sum()) // 64) + 30


def test_encoder_is_the_tokenizer():
    """Ids of made-up texts, capitals beside the marks of special tokens among them."""
    path = packing.public_tokenizers.path("word_bpe_49k.json")
    encode, encoder, r = packing._tokenizer(path).encode, packing._Encoder(path), random.Random(12)
    parts = ["Hello", "WORLD", "<|", "|>", "<|endoftext|>", "don't", "É", "été", "Σας", "İx", "ﬁne", "日本", ",", ".", "?!", "(", "3.14", "x_y", "’", "\u0301", "\u200b", "\x00", "\x1c", "\x85", "\xa0"]
    texts = ["Hello, World. a <| b"] + ["".join(r.choice(parts) + r.choice(("", "", " ", "\n", "\t ")) for _ in range(r.randint(1, 9))) for _ in range(4000)]
    for text, ids in zip(texts, encoder.batch(texts), strict=True):
        assert list(ids) == encode(text, add_special_tokens=False).ids, text


def test_encoder_takes_slices_and_nulls():
    """Part of an Arrow column, with nulls, empty texts, outer white space and characters of which a byte looks like white space."""
    path = packing.public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", "one", " Two\n", "three", None, "", "\u00c5\u0105\u0160 \u2028x<|Y", "FOUR"] * 3
    encode, got = packing._tokenizer(path).encode, packing._Encoder(path).batch(packing.pa.array(texts).slice(2, 20))
    assert [list(x) for x in got] == [encode(t or "", add_special_tokens=False).ids for t in texts[2:22]]


def test_packing_is_near_an_exact_optimum():
    """On small histograms: against the fewest sequences by a search over all packings."""
    from functools import lru_cache

    @lru_cache(maxsize=None)
    def fewest(left: tuple[tuple[int, int], ...], room: int) -> int:
        best = None
        for k, (n, c) in enumerate(left):
            if n <= room:
                rest = (*left[:k], *([(n, c - 1)] if c > 1 else []), *left[k + 1 :])
                found = fewest(rest, room - n)
                best = found if best is None else min(best, found)
        return best if best is not None else 1 + fewest(left, 20) if left else 0

    r = random.Random(13)
    for _ in range(12):
        histogram = {n: r.randint(1, 2) for n in r.sample(range(2, 19), 4)}
        assert sum(n for n, _ in packing.pack_histogram(histogram, 20)) <= 1 + fewest(tuple(sorted(histogram.items())), 0)


def test_packing_round_trip(spark):
    rows = prose(60) + [(1000, "word " * 5000), (1001, None), (1002, ""), (1003, "don't <|endoftext|> ÉTÉ ﬁ Σας İ  ok...")]
    encode = packing._tokenizer(packing.public_tokenizers.path("word_bpe_49k.json")).encode
    got = packing.pack_documents(docs(spark, rows)).toPandas()
    for i, text in rows:
        ids = np.array(encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert list(own.length) == [len(ids[a : a + 2048]) for a in range(0, len(ids), 2048)]
        assert list(own.ids_crc32) == [zlib.crc32(ids[a : a + 2048].tobytes()) for a in range(0, len(ids), 2048)]
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all() and got.groupby("sequence_id").length.sum().max() <= 2048


def test_packing_odd(spark):
    got = packing.pack_documents(docs(spark, ODD)).toPandas()
    assert (got.piece == 0).sum() == len(ODD) and not got.duplicated(["sequence_id", "offset"]).any()
    assert packing.pack_documents(docs(spark, [])).count() == 0


# License scans


def test_license_places(spark):
    rows = [(1, "Released UNDER the MIT-License. Again: under the mit license"), (2, "under the mit licence"), (3, "cc by-nc 4.0; Apache License, Version 2.0"), (4, "sunder the mit license"), (5, None), (6, "GNU Generall Public Licnse")]
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, rows)).collect()}
    show = lambda i: sorted((m.label, m.base, m.first_word, m.edits) for m in got[i].matches)
    assert show(1) == [("mit", True, 1, 0), ("mit", True, 6, 0)] and show(2) == [("mit", False, 0, 1)]
    assert show(3) == [("apache-2", True, 5, 0), ("cc-by-nc", True, 0, 0)] and got[5].n_words == 0 and show(5) == []
    assert not any(m.base for m in got[4].matches) and show(6)[0][0] == "gpl"


def test_license_beside_other_characters():
    """What is found in windows is what the pattern finds in the whole line."""
    notices = tuple((license_scan.BASE | license_scan.NOTICES).items())
    for phrase in dict(notices):
        for a, b in (("“", "”"), ("“", ""), ("", "”"), ("—", ""), ("𝄞", "𝄞"), ("é", ""), ("x", "y")):
            for text in (f"the {a}{phrase}{b} é日本語", f"日本語日本語 {a}{phrase.replace('e', '日', 1)}{b}", f"{a}{phrase}{b}"):
                line = f" {' '.join(PLAIN.findall(text))} "
                want = {label for label, _, _, pattern in license_scan._fuzzy(notices) if pattern.search(line)}
                assert {label for label, exact, *_ in license_scan.matches(text, (), notices)[1]} == want, text


def test_license_text_full_of_matches():
    """A megabyte of a notice, exact and with an error: every place once, in time that follows the length."""
    notices = tuple((license_scan.BASE | license_scan.NOTICES).items())
    for phrase, errors in (("under the mit license", 0), ("under the mot license", 1)):
        began = time.time()
        n, found = license_scan.matches(f"{phrase} now " * 40_000, tuple(license_scan.BASE.items()), notices)
        assert time.time() - began < 4 and n == 200_000
        assert sorted(at for label, _, at, _, e in found if label == "mit" and e == errors) == list(range(0, 200_000, 5))
        assert len(found) == 40_000


def test_license_short_notices(spark):
    rows = [(1, "// SPDX-License-Identifier: Apache-2.0"), (2, "Permission is hereby granted, free of charge, to any"), (3, "This is free and unencumbered softwre released into the public domain."), (4, "Boost Software License - Version 1.0")]
    got = {r.doc_id: {m.label for m in r.matches} for r in license_scan.scan(docs(spark, rows)).collect()}
    assert got == {1: {"spdx"}, 2: {"mit-text"}, 3: {"unlicense", "public-domain"}, 4: {"boost"}}


def test_license_odd(spark):
    got = license_scan.scan(docs(spark, ODD)).collect()
    assert sorted(r.n_words for r in got) == sorted(len(PLAIN.findall((t or "").translate(LOWER))) for _, t in ODD)
    assert license_scan.scan(docs(spark, [])).count() == 0


# Line dedup


def line_groups(spark, rows):
    """What edit similarity by words or by characters links, over all pairs: the first id of each group."""
    found = spark.createDataFrame(rows, "i long, line string").select("i", line_dedup.normalised("line").alias("x")).where("x != ''")
    forms, words = {r.i: r.x for r in found.collect()}, {}
    coded = {i: "".join(chr(0x4E00 + words.setdefault(w, len(words))) for w in x.split(" ")) for i, x in forms.items()}
    one = spark.createDataFrame([(i, x, coded[i]) for i, x in forms.items()], "i long, x string, c string")
    near = "levenshtein({a}, {b}) <= floor(0.200000001 * greatest(char_length({a}), char_length({b})))"
    links = {(r.i, r.j) for r in one.join(one.toDF("j", "y", "d"), F.expr("i < j and (" + near.format(a="x", b="y") + " or " + near.format(a="c", b="d") + ")")).select("i", "j").collect()}
    return {i: g for i, g in groups(list(forms), lambda a, b: (a, b) in links).items() if i != g}


def test_lines(spark):
    line = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"{line}\nkeep me"), (2, f"{line.upper()}!\nmine"), (3, f"{line.replace('word7 ', 'wort7 ')}"), (4, "other " + line[::-1]), (5, None), (6, "---\n---")]
    got = sorted(map(tuple, line_dedup.repeated_lines(docs(spark, rows)).collect()))
    assert got == [(2, 0, 1, 0), (3, 0, 1, 0)]
    left = line_dedup.without_lines(docs(spark, rows), line_dedup.repeated_lines(docs(spark, rows)))
    kept = {r.doc_id: (r.text, r.n_chars) for r in left.collect()}
    assert kept[2] == ("mine", 4) and kept[1][0] == rows[0][1] and kept[5] == (None, None) and kept[6][0] == "---\n---"


def test_simhash_is_the_vote_of_all_words(spark):
    """Of lines of any length, against plain counts."""
    r = random.Random(3)
    rows = [[r.getrandbits(64) - 2**63 for _ in range(n)] for n in (1, 2, 3, 17, 254, 255, 256, 600, 70_000)]
    got = line_dedup.with_simhash(spark.createDataFrame([(i, h) for i, h in enumerate(rows)], "i int, h array<long>"))
    for i, sim in got.select("i", "sim").collect():
        h = np.array(rows[i], np.int64).view(np.uint64)
        want = sum(1 << b for b in range(line_dedup.BITS) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
        assert sim == want


def made_up_line(r, size):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 10))) for _ in range(size)]


def with_errors(r, text, kind):
    """A word in ten replaced, one at least, or a letter in ten."""
    if kind == "words":
        text = list(text)
        for at in r.sample(range(len(text)), max(1, len(text) // 10)):
            text[at] = made_up_line(r, 1)[0]
        return " ".join(text)
    letters = list(" ".join(text))
    for at in r.sample([i for i, c in enumerate(letters) if c != " "], max(1, len(letters) // 10)):
        letters[at] = r.choice("abcdefghijklmnop")
    return "".join(letters)


@pytest.mark.parametrize("kind", ["words", "letters"])
def test_lines_with_errors(spark, kind):
    """Of lines with a word in ten replaced at least nine in ten are found at any length; with a letter in ten, seven in ten over all, half at any length."""
    r, shares = random.Random(4), {}
    for size in (8, 12, 20, 40, 80):
        rows = []
        for i in range(100):
            text = made_up_line(r, size)
            rows += [(2 * i, " ".join(text)), (2 * i + 1, with_errors(r, text, kind))]
        want = line_groups(spark, rows)
        got = {x.doc_id: x.kept_doc_id for x in line_dedup.repeated_lines(docs(spark, rows)).collect()}
        assert len(want) >= 90 and set(got.items()) <= set(want.items())
        shares[size] = len(set(got.items()) & set(want.items())) / len(want)
    print(kind, shares)
    assert min(shares.values()) >= (0.9 if kind == "words" else 0.5) and sum(shares.values()) >= (0.9 if kind == "words" else 0.7) * len(shares), shares


def test_lines_with_errors_among_many(spark):
    """The same beside 100,000 other lines; each pair is of its own, so every find is right."""
    r, rows, pairs = random.Random(12), [], {}
    for size in (8, 12, 20, 40, 80):
        for kind in ("words", "letters"):
            for _ in range(60):
                text, i = made_up_line(r, size), len(rows)
                rows += [(i, " ".join(text)), (i + 1, with_errors(r, text, kind))]
                pairs[i + 1] = (i, size, kind)
    others = docs(spark, [(10_000 + i, "\n".join(" ".join(made_up_line(r, r.randint(8, 16))) for _ in range(100))) for i in range(1000)])
    got = {(x.doc_id, x.kept_doc_id) for x in line_dedup.repeated_lines(docs(spark, rows).union(others)).collect()}
    found = {(size, kind): sum((j, i) in got for j, (i, s, k) in pairs.items() if (s, k) == (size, kind)) for _, size, kind in pairs.values()}
    print(found)
    assert all(n >= (0.9 if kind == "words" else 0.5) * 60 for (_, kind), n in found.items()), found
    assert {j for j, _ in got} <= set(pairs)


def test_lines_match_brute_force_by_default(spark):
    """The default finds what edit similarity alone links: words replaced in longer lines, typing errors in short ones."""
    r, rows = random.Random(6), [(i, t) for i, t in prose(100, seed=6, words=40) if len(t) > 12]
    for i in range(60):
        text = list(r.choice(rows)[1][: r.randint(5, 32)].strip() if i % 2 else r.choice(rows[-i // 2 :])[1][:32].strip())
        for _ in range(len(text) // 5):
            at = r.randrange(len(text))
            text[at : at + 1] = r.choice(("", "x", "ab", " "))
        rows.append((1000 + i, "".join(text)))
    want = line_groups(spark, rows)
    got = {x.doc_id: x.kept_doc_id for x in line_dedup.repeated_lines(docs(spark, rows)).collect()}
    assert got == want and len(want) > 40


def test_a_frequent_run_links_no_others(spark):
    """A hundred lines share a run of words; those alike are found, within the block and out of it, and no others."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(5, 10)))
    rows = [(i, " ".join([word() for _ in range(9)] + ["always", "repeated", "passage"] + [word() for _ in range(9)])) for i in range(100)]
    rows += [(1000 + i, text.replace(text.split()[3], "changed")) for i, text in rows[:20]]
    want = line_groups(spark, rows)
    assert {x.doc_id: x.kept_doc_id for x in line_dedup.repeated_lines(docs(spark, rows)).collect()} == want and len(want) == 20


def test_lines_that_only_meet_in_large_blocks(spark):
    """Lines whose runs and SimHash many others have too, so that every block that a pair meets in is large, however it is dealt."""
    r = random.Random(15)
    own = lambda: ["".join(r.choice("bcdfghklmnop") for _ in range(10)) for _ in range(4)]
    rows = [own() for _ in range(60)]
    rows += [[w[:k] + "z" + w[k + 1 :] for k, w in enumerate(line, 3)] for line in rows[20:30]]
    rows = [(i, " ".join(["always"] * 6 + line)) for i, line in enumerate(rows)]
    want = line_groups(spark, rows)
    assert {x.doc_id: x.kept_doc_id for x in line_dedup.repeated_lines(docs(spark, rows)).collect()} == want and len(want) == 10
    left = corpus_pipeline.drop_repeated_lines(spark, docs(spark, rows), "")
    assert {x.doc_id for x in left.where("text = ''").collect()} == set(want) and left.count() == len(rows)


def test_letter_counts_bound_edits(spark):
    """Texts within k edits of each other differ in 2 k bits of their letter counts at most, so no similar line is left out; unlike ones are told apart."""
    r, rows = random.Random(5), []
    for n in (3, 20, 90, 400):
        for k in (1, 2, n // 5 + 1, n):
            text = "".join(r.choice("eeeeaatxz 0129\u00e9\u6587") for _ in range(n))
            rows += [(text, edited(r, text, k), k), (text, "".join(r.choice("qwb") for _ in range(n)), n)]
    table = spark.createDataFrame(rows, "norm string, other string, k int")
    table = table.withColumns({f"count{i}": c for i, c in enumerate(line_dedup.letter_counts("norm"))})
    table = table.withColumns({f"count{i}_": c for i, c in enumerate(line_dedup.letter_counts("other"))})
    apart = sum((F.bit_count(F.col(f"count{i}").bitwiseXOR(F.col(f"count{i}_"))) for i in range(4)), F.lit(0))
    got = table.select("k", F.levenshtein("norm", "other").alias("distance"), apart.alias("bits")).collect()
    assert all(x.bits <= 2 * x.distance for x in got) and any(x.bits > 2 * (x.k // 5) for x in got)


def edited(r, text, k):
    for _ in range(k):
        at, way = r.randrange(len(text) + 1), r.randrange(3)
        text = text[:at] + ("" if way == 0 else r.choice("abe7\u00e9")) + text[at + (way != 1) :]
    return text


def test_bags_bound_edits(spark):
    """Of words of which some recur: k edits leave all but k of the longer line in both bags, and lines of other words share less."""
    r, rows = random.Random(9), []
    for n in (40, 60, 300):
        for k in (0, 3, n // 5):
            text = [r.choice(("those", "of", *made_up_line(r, 3))) for _ in range(n)]
            other = list(text)
            for at in r.sample(range(n), k):
                other[at] = "zzz"
            rows.append((text, other[: n - k // 2] + other[n - k // 2 :][::-1], ["those"] * n))
    table = spark.createDataFrame(rows, "x array<string>, y array<string>, z array<string>")
    of = lambda c: line_dedup.with_bags(line_dedup.with_codes(table.select(F.monotonically_increasing_id().alias("id"), F.lit(0).alias("h1"), F.col(c).alias("words")))).select("id", F.col("code").alias(f"code_{c}"), F.col("bag").alias(f"bag_{c}"))
    got = of("x").join(of("y"), "id").join(of("z"), "id")
    shared_ = lambda c: F.size(F.array_intersect("bag_x", f"bag_{c}"))
    got = got.select(shared_("y").alias("y"), shared_("z").alias("z"), F.char_length("code_x").alias("n"), F.levenshtein("code_x", "code_y").alias("d"), F.levenshtein("code_x", "code_z").alias("e"), F.size("bag_x").alias("size")).collect()
    assert len(got) == 9 and all(x.size == x.n and x.y >= x.n - x.d and x.z == x.n - x.e < x.n // 2 for x in got)


def test_lines_similar_by_words_are_all_found(spark):
    """One word in five is replaced by a longer one, so characters say little, and runs and SimHashes differ in much; lines of any length."""
    r, rows = random.Random(21), []
    for i, size in enumerate((5, 6, 9, 10, 15, 25, 40, 70) * 8):
        text = ["".join(r.choice("bcdfghklmnop") for _ in range(3)) for _ in range(size)]
        other = list(text)
        for at in r.sample(range(size), size // 5):
            other[at] = "".join(r.choice("bcdfghklmnop") for _ in range(14))
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
    want = line_groups(spark, rows)
    assert {x.doc_id: x.kept_doc_id for x in line_dedup.repeated_lines(docs(spark, rows)).collect()} == want and len(want) == 64


def test_lines_of_rows_with_equal_ids(spark, monkeypatch):
    """Lines that stand at one place of different rows with one id are told apart; the same in several parts."""
    r = random.Random(22)
    texts = [" ".join(made_up_line(r, 12)) for _ in range(20)]
    rows = [(7, t) for t in texts] + [(100 + i, t.replace(t.split()[5], "changed")) for i, t in enumerate(texts)]
    monkeypatch.setattr(line_dedup, "PART_LINES", 10)
    got = [tuple(x) for x in line_dedup.repeated_lines(docs(spark, rows)).collect()]
    assert sorted(got) == [(100 + i, 0, 7, 0) for i in range(20)]


@pytest.mark.parametrize("links, spare", [({(20, 21)}, 64), ({(20, 21), (21, 70), (5, 70)}, 64), ({(a, a + 1) for a in range(0, 98, 2)}, 64), (set(), 64), ({(20, 21), *((a, b) for a in range(30, 100) for b in range(30, a))}, 1)])
def test_large_blocks_lose_no_link(spark, links, spare):
    """A block that finer keys don't divide: whatever links within it is found, and nothing else."""
    entries = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(100)], "key long, id long")
    linked = spark.createDataFrame([(min(p), max(p)) for p in links] + [(-1, -1)], "a long, b long")
    test = "concat(least(id, id_), ' ', greatest(id, id_)) in (" + ", ".join(f"'{min(p)} {max(p)}'" for p in [*links, (-1, -1)]) + ")"
    got = components.grouped(entries, "true", lambda ids: shared.written(ids, "texts"), lambda pairs, _: pairs.join(linked, ["a", "b"]), finer=F.array(F.lit(0).cast("long")), linked=test, spare=spare, share=7)
    links |= {(b, a) for a, b in links}
    want = groups(range(100), lambda a, b: (a, b) in links)
    assert {x.node: x.component for x in got.collect()} == {i: g for i, g in want.items() if i != g}


def test_a_pair_of_several_large_blocks_is_tested_once(spark):
    """In the least block that both are in; the test of a pair fails anywhere else."""
    entries = spark.createDataFrame([(k, i) for k in (1, 2, 3) for i in range(100)], "key long, id long")
    linked = spark.createDataFrame([(-1, -1)], "a long, b long")
    test = "if(key = array_min(array_intersect(keys, keys_)), id + id_ = 75 and abs(id - id_) = 65, raise_error('tested twice'))"
    got = components.grouped(entries, "true", lambda ids: shared.written(ids, "texts"), lambda pairs, _: pairs.join(linked, ["a", "b"]), finer=F.array(F.lit(0).cast("long")), linked=test, share=7)
    assert {(x.node, x.component) for x in got.collect()} == {(70, 5)}


def test_large_blocks_in_parts(spark):
    """The same in three parts of the keys."""
    entries = spark.createDataFrame([(k, i) for k in range(6) for i in range(100) if k < 5 or i < 3], "key long, id long")
    linked = spark.createDataFrame([(20, 21), (5, 70)], "a long, b long")
    test = "concat(least(id, id_), ' ', greatest(id, id_)) in ('20 21', '5 70')"
    got = components.grouped(entries, "true", lambda ids: shared.written(ids, "texts"), lambda pairs, _: pairs.join(linked, ["a", "b"]), finer=F.array(F.lit(0).cast("long")), linked=test, share=7, parts=3)
    assert {(x.node, x.component) for x in got.collect()} == {(21, 20), (70, 5)}


def test_lines_are_native(spark):
    plan = line_dedup.repeated_lines(docs(spark, ODD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lines_odd(spark):
    got = line_dedup.repeated_lines(docs(spark, ODD)).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in got} == {(5, 4), (9, 8)}
    assert line_dedup.repeated_lines(docs(spark, [])).count() == 0
    assert line_dedup.without_lines(docs(spark, ODD), line_dedup.repeated_lines(docs(spark, ODD))).count() == len(ODD)


# Mixing


def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > epochs * sizes[s] + 1e-9}
        if not full:
            return target | {s: weight[s] * level for s in free}
        for s in full:
            target[s] = epochs * sizes[s]
            rest -= target[s]
        free -= full
    return target


def test_mixture(spark):
    rows = prose(300, seed=7)
    source = lambda i: [None, "a", "b", "é", "B", "tiny"][0 if i % 10 == 9 else 5 if i == 3 else i % 4 + 1]
    got = mixing.mix(docs(spark, rows, source), range_rows=16).toPandas()
    sizes = {i: len(SPACED.findall(t)) for i, t in rows}
    by = {}
    for i, n in sizes.items():
        by[source(i)] = by.get(source(i), 0) + n
    want = plain_targets(by)
    for s, own in got.groupby(got.source.fillna("(null)")):
        s = None if s == "(null)" else s
        assert own.target.iloc[0] == pytest.approx(want[s]) and own.taken.sum() == int(own.target.iloc[0] + 1e-9)
        assert (own.taken <= 3 * own["size"]).all() and own.source_size.iloc[0] == by[s]
    again = mixing.mix(docs(spark, rows[::-1], source), range_rows=64).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))


def test_mixture_texts(spark):
    rows = [(i, f"  w{i} x\ty {i}\nz ") for i in range(40)]
    table = docs(spark, rows, lambda i: "ab"[i % 2])
    taken = {r.doc_id: r.taken for r in mixing.mix(table).collect()}
    words = {}
    for r in mixing.mixture(table).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(SPACED.findall(r.text))
        assert dict(rows)[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert words == {i: n for i, n in taken.items() if n}


def test_mixture_keeps_to_its_targets_with_ties(spark):
    """Rows without ids and repeated rows: the stage takes as many words as the query, and neither exceeds the target."""
    rows = [(None if i % 3 == 0 else i % 7, f"a b {i % 2} d") for i in range(60)]
    table = docs(spark, rows, lambda i: "s" if i is None else "t")
    taken = mixing.mix(table, range_rows=8).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("target")).collect()
    words = {}
    for r in mixing.mixture(table, range_rows=8).collect():
        words[r.source] = words.get(r.source, 0) + len(SPACED.findall(r.text))
    assert words == {r.source: r.n for r in taken} and all(r.target - 30 < r.n <= r.target for r in taken)


def test_mixture_odd(spark):
    got = mixing.mix(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and sum(r.taken for r in got) == sum(r["size"] for r in got)
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [(1, None)])).first().taken == 0


# N-gram join


@pytest.mark.parametrize("seed, few", [(1, 5), (2, 2), (3, 1)])
def test_near_groups(spark, seed, few):
    rows = prose(250, seed=seed)
    sets = {i: shingles(t) for i, t in rows}
    want = groups(list(sets), lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]))
    got = {r.doc_id: r for r in ngram_join.near_groups(docs(spark, rows), few=few).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}


def test_near_groups_odd(spark):
    got = ngram_join.near_groups(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and {(r.doc_id, r.component_id) for r in got} >= {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (8, 8), (9, 8), (None, None)}
    assert ngram_join.near_groups(docs(spark, [])).count() == 0
    assert sorted(r.doc_id or 0 for r in ngram_join.one_of_each(docs(spark, ODD)).collect()) == [0, 1, 2, 3, 4, 6, 7, 8]


# Search


def test_long_texts(spark):
    """A text of five megabytes in one line beside short ones, through every operator."""
    table = docs(spark, [(1, "lorem ipsum dolor " * 280_000), (2, "a b c"), (3, "a b c")])
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in substring_dedup.without_repeats(table, min_words=1).collect()} == {1, 2}
    assert fingerprints.edited_fingerprints(table).count() == 3 and toxicity.toxicity(table, marks).count() == 3 and quality.quality(table, marks).count() == 3
    assert packing.pack_documents(table).groupBy("doc_id").agg(F.sum("length")).count() == 3 and license_scan.scan(table).count() == 3
    assert [tuple(r) for r in line_dedup.repeated_lines(table).collect()] == [(3, 0, 2, 0)]
    assert mixing.mix(table).agg(F.sum("taken")).first()[0] == 840_006
    assert {r.doc_id: r.component_id for r in ngram_join.near_groups(table).collect()} == {1: 1, 2: 2, 3: 2}
    assert {r.query_id for r in topk_search.search(table, table).collect()} == {1, 2, 3}


def test_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD", 50)
    rows = prose(300, seed=9) + [(1000, None), (1001, "")]
    table = docs(spark, rows).repartition(3)
    got = {}
    for r in topk_search.search(table, table.where("doc_id % 25 = 0"), k=7, block=5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    texts = dict(rows)
    assert got == {q: bm25(texts, q, 7) for q in texts if q % 25 == 0 and texts[q]}


def test_search_odd(spark):
    table = docs(spark, ODD)
    got = topk_search.search(table, table).collect()
    assert {r.query_id for r in got} == {4, 5, 6, 7, 8, 9} and all(r.doc_id is not None for r in got)
    assert topk_search.search(table, docs(spark, [])).count() == 0 and topk_search.search(docs(spark, []), table).count() == 0


def test_search_keeps_ties_and_forms_few_scores(spark, monkeypatch):
    """Copies in several shards have equal scores and come by id; of single precision sums only what may be among the best is scored exactly."""
    monkeypatch.setattr(topk_search, "SHARD", 64)
    texts = dict(prose(400, seed=3))
    rows = list(texts.items()) + [(1000 + i, texts[i % 3]) for i in range(90)]
    scored, exact = [], topk_search.Shard._exact
    monkeypatch.setattr(topk_search.Shard, "_exact", lambda self, docs, dense: (scored.append(len(docs)), exact(self, docs, dense))[1])
    texts = dict(rows)
    ids = np.array([i for i, _ in rows])
    hashes, counts, bounds, lengths = topk_search.term_counts(pa.array([t for _, t in rows]))
    vocabulary, terms = np.unique(hashes, return_inverse=True)
    df = np.bincount(terms)
    impacts = counts * (topk_search.K1 + 1) / (counts + np.repeat(topk_search.K1 * (1 - topk_search.B + topk_search.B * lengths / lengths.mean()), np.diff(bounds)))
    weights = np.log1p((len(ids) - df + 0.5) / (df + 0.5))[terms] * counts
    queries = topk_search.Queries(ids, bounds, terms, weights, vocabulary, lengths.mean())
    found = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
    for at in range(0, len(ids), 64):
        own = slice(bounds[at], bounds[min(at + 64, len(ids))])
        shard = topk_search.Shard(ids[at : at + 64], bounds[at : at + 65] - bounds[at], terms[own], impacts[own])
        shard.best(queries, 7, np.zeros(len(vocabulary)), found)
    assert all(list(x) == bm25(texts, i, 7) for i, (x, _) in zip(ids, found))
    assert list(found[0][0]) == [0, *range(1000, 1018, 3)] and len(set(found[0][1])) == 1
    assert sum(scored) < len(ids) ** 2 / 4


def test_written_tables_are_shared(spark):
    table = shared.written(spark.range(5), "t")
    assert shared.shared_folder(spark) in table.inputFiles()[0] and shared.small(table).count() == 5
