"""The registered queries on the smallest tables: against SQL where there is some, else their shape; and the pipeline's stages."""

import hashlib
import math
import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tenderlake.llm import catalog, license_scan, line_dedup, mixing, ngram_join, packing, shared, toxicity
from tests.llm.helpers import LOWER, ODD, PLAIN, SPACED, docs, groups, prose, shingles
from tests.llm.test_operators import line_groups, plain_targets

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.sql(catalog.SQL[name])
    names = sorted(want.columns)
    expected = sorted(con.sql("SELECT " + ", ".join(f'"{n}"' for n in names) + f" FROM ({catalog.SQL[name]})").fetchall(), key=repr)
    assert sorted(map(tuple, catalog.QUERIES[name](spark, DATA).select(*names).collect()), key=repr) == expected


@pytest.mark.parametrize("name", ["op2_fingerprints", "op3_toxicity", "op4_packing", "op5_license_scan", "op7_quality", "op9_ngram_join"])
def test_all_documents(spark, name):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert catalog.QUERIES[name](spark, DATA).select("doc_id").distinct().count() == n


def test_license_columns_match_plain_search(spark):
    """Every column of the license query, over whole texts: words by loops, fuzzy labels by the pattern on the whole line."""
    base, notices = license_scan.BASE, license_scan.BASE | license_scan.NOTICES
    texts = {r.doc_id: r.text for r in shared.documents(spark, DATA).select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in catalog.QUERIES["op5_license_scan"](spark, DATA).collect()}
    for i, text in texts.items():
        found = PLAIN.findall((text or "").translate(LOWER))
        places = [(at, label) for phrase, label in base.items() for at in range(len(found)) if found[at : at + len(w := phrase.split())] == w]
        line = f" {' '.join(found)} "
        labels = {label for _, label in places} | {label for label, _, _, pattern in license_scan._fuzzy(tuple(notices.items())) if pattern.search(line)}
        r, at = got[i], [a for a, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(found), len(places), min(at, default=None), max(at, default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted({x for _, x in places})), ",".join(sorted(labels))) and 0 <= r.score <= 1
    assert any(r.n_base for r in got.values())


def test_stages_match_plain_code(spark):
    """Each stage's rows against loops over all documents or pairs."""
    rows = [(i, t.replace(" ", "\n", 1) if i % 4 == 0 else t) for i, t in prose(90, seed=21, words=60)]
    bad = {i for i, _ in rows if i % 5 == 0}
    rows = [(i, t + " vileness and scumness" * 3 if i in bad else t) for i, t in rows]
    table = docs(spark, rows, lambda i: "ab"[i % 2])
    marks = spark.createDataFrame([(i, 1, int(i in bad)) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(table, marks)
    kept = []
    for i, text in rows:
        own = [int(np.flatnonzero(model.terms == t)[0]) for t in toxicity.terms(pa.array([text]))[0] if t in model.terms]
        raw = model.bias + sum(model.weights[a] for a in own) + sum(model.vectors[a] @ model.vectors[b] for k, a in enumerate(own) for b in own[:k])
        kept += [(i, text)] if 1 / (1 + math.exp(-raw)) < 0.7 else []
    assert sorted((r.doc_id, r.text) for r in toxicity.without_toxic(table, marks).collect()) == kept and len(kept) < len(rows)

    table = docs(spark, kept, lambda i: "ab"[i % 2])
    parts = [(i, k, x) for i, t in kept for k, x in enumerate(t.split("\n"))]
    gone = line_groups(spark, [(n, x) for n, (_, _, x) in enumerate(parts)])
    want = {i: "\n".join(x for n, (j, _, x) in enumerate(parts) if j == i and n not in gone) for i, _ in kept}
    lines = shared.written(corpus_pipeline.drop_repeated_lines(spark, table, DATA), "lines")
    assert {r.doc_id: r.text for r in lines.collect()} == want and gone

    mixed = corpus_pipeline.mix_sources(spark, lines, DATA).collect()
    sizes = {i: len(SPACED.findall(t)) for i, t in want.items()}
    by = {s: sum(n for i, n in sizes.items() if "ab"[i % 2] == s) for s in "ab"}
    took = {}
    for s, target in plain_targets(by).items():
        left, own = int(target + 1e-9), sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i) for i in sizes if "ab"[i % 2] == s)
        while left > 0:
            for _, i in own:
                took[i] = took.get(i, 0) + min(left, sizes[i])
                left -= min(left, sizes[i])
    words = {}
    for r in mixed:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(SPACED.findall(r.text))
    assert words == {i: n for i, n in took.items() if n}

    encode = packing._tokenizer(packing.public_tokenizers.path("word_bpe_49k.json")).encode
    packed = corpus_pipeline.pack_sequences(spark, lines, DATA).collect()
    assert {i: sum(r.length for r in packed if r.doc_id == i) for i in want} == {i: len(encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}


def test_pipeline(spark):
    """Each stage keeps what the operator by itself says of the same input."""
    table = shared.documents(spark, DATA)
    marks = shared.labels(spark, DATA)
    clean = shared.written(corpus_pipeline.drop_toxic(spark, table, DATA), "a")
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(table, marks).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, p in scores.items() if not p}
    lines = shared.written(corpus_pipeline.drop_repeated_lines(spark, clean, DATA), "b")
    gone = {(r.doc_id, r.line_no) for r in line_dedup.repeated_lines(clean).collect()}
    before = {r.doc_id: r.text for r in clean.collect()}
    assert {r.doc_id: r.text for r in lines.collect()} == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in before.items()}
    apart = shared.written(corpus_pipeline.drop_near_copies(spark, lines, DATA), "c")
    assert {r.doc_id for r in apart.collect()} == {r.component_id for r in ngram_join.near_groups(lines).collect()}
    mixed = shared.written(corpus_pipeline.mix_sources(spark, apart, DATA), "d")
    taken = {r.doc_id: r.taken for r in mixing.mix(apart).collect() if r.taken}
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(SPACED.findall(r.text))
    assert words == taken and mixed.columns == table.columns
    packed = corpus_pipeline.pack_sequences(spark, mixed, DATA)
    assert packed.where("piece = 0").count() == mixed.count() and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_near_copies_are_of_five_words(spark):
    """The stage keeps one of those whose sets of five-word shingles are alike by 0.8, by brute force."""
    rows = prose(150, seed=11)
    alike = lambda size, percent: groups(list(sets := {i: shingles(t, size) for i, t in rows}), lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]))
    want = set(alike(5, 80).values())
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs(spark, rows), DATA).collect()} == want != set(alike(3, 90).values())


def test_stages_on_odd_rows(spark):
    for rows in (ODD, []):
        table = docs(spark, rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = shared.written(stage(spark, table, DATA), "odd")
            assert after.columns == table.columns and after.count() <= 3 * len(rows), name
            table = after
        corpus_pipeline.STAGES[-1][1](spark, table, DATA).count()
