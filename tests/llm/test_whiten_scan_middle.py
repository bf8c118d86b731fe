"""Whitening, license scans and fill-in-middle against brute force and their SQL."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

from textloom.llm import fill_in_middle, license_rules, license_scan, queries, whitening
from textloom.llm.fill_in_middle import chunk_function, code_points, compose

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same_as_sql(spark, name, sf=SF):
    made = queries.QUERIES[name](spark, sf)
    with duckdb.connect() as db:
        for t in ("documents", "embeddings"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = db.sql(f"SELECT {', '.join(made.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    key = lambda row: tuple((v is not None, v) for v in row)
    assert sorted(map(tuple, made.collect()), key=key) == sorted(want, key=key)


# whitening


def plain_whitening(vectors, components=8):
    x = np.array([[math.floor(float(c) * 1024) + 100_000 for c in v] for v in vectors], dtype=object)
    n = len(x)
    centred = n * x - x.sum(axis=0)
    deviation = (centred * centred).sum(axis=1)
    rows = (centred / n).astype(float)
    e, v = np.linalg.eigh(rows.T @ rows / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return n, [int(d) for d in deviation], rows @ v / np.sqrt(e), e / (rows**2).sum() * n


def rows_by_vector(made):
    out = {}
    for r in made.collect():
        out.setdefault(r["vec_id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["component"]) for k, v in out.items()}


def test_whitening_equals_a_plain_eigendecomposition(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(500, 12)) * np.linspace(3, 0.2, 12) + 5).tolist()
    rows = [(i, v, "x", 1.0) for i, v in enumerate(vectors)]
    bad = [(900, None, "x", 1.0), (901, [1.0] * 11 + [None], "x", 1.0), (902, [1.0] * 11 + [float("nan")], "x", 1.0), (903, [float("inf")] * 12, "x", 1.0), (904, [1.0], "x", 1.0), (905, [], "x", 1.0)]
    schema = "vec_id long, embedding array<double>, whitened string, deviation double"
    got = rows_by_vector(whitening.components_of_rows(spark.createDataFrame(rows + bad, schema).repartition(17)))
    n, deviation, whitened, explained = plain_whitening(vectors)
    assert set(got) == set(range(500)) and n == 500
    made = np.array([[r["whitened"] for r in got[i]] for i in range(500)])
    signs = np.sign((made * whitened).sum(axis=0))
    assert np.abs(made * signs - whitened).max() < 1e-9
    for i in range(500):
        assert [r["component"] for r in got[i]] == list(range(1, 9))
        assert {(r["n"], r["deviation"]) for r in got[i]} == {(500, deviation[i])}
        assert np.allclose([r["explained"] for r in got[i]], explained, rtol=1e-9)
        assert got[i][0]["identity_error"] < 1e-9


def test_whitening_keeps_exact_deviations_beyond_64_bits(spark):
    vectors = [[1e12, 0.0], [-1e12, 2.0], [3e11, 1.0], [1e300, 5.0], [5.0, -1e300]]
    made, fitted = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"))
    clamp = lambda v: max(-whitening.MOST, min(whitening.MOST, v))
    x = np.array([[clamp(clamp(math.floor(c * 1024)) + 100_000) for c in v] for v in vectors], dtype=object)
    want = ((5 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert [None if r["deviation"] is None else int(r["deviation"]) for r in made.orderBy("vec_id").collect()] == [int(w) if w < 10**38 else None for w in want]
    assert fitted.n == 5 and len(fitted.varies) == 2


def test_whitening_of_constant_repeated_single_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    constant = [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [3.0, 2.0, 3.0])]
    got = whitening.components_of_rows(spark.createDataFrame(constant, schema)).collect()
    assert len(got) == 9 and {r["n"] for r in got} == {3}
    first = [r["whitened"] for r in got if r["component"] == 1]
    assert np.allclose(sorted(np.abs(first)), [math.sqrt(0.5), math.sqrt(0.5), math.sqrt(2)])
    assert {(r["whitened"], r["explained"]) for r in got if r["component"] > 1} == {(None, 0.0)}
    single = whitening.components_of_rows(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect()
    assert [(r["whitened"], r["deviation"], r["explained"], r["identity_error"]) for r in single] == [(None, 0, None, None)] * 2
    assert whitening.components_of_rows(spark.createDataFrame([], schema)).collect() == []
    assert whitening.components_of_rows(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []


def test_tree_merges_more_factors_than_one_task_takes(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 4)).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(70)
    fitted = whitening.fit(df)
    assert np.allclose(fitted.variances / fitted.total, plain_whitening(vectors, 4)[3])


# license scans


def plain_base(text):
    w, out = WORD.findall((text or "").translate(LOWER)), []
    for phrase, label in license_rules.BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in out]
    return len(w), len(out), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in out}))


def plain_detections(text):
    """All matches of all rules, suppressed as the docstring says."""
    spaced = " " + "  ".join(WORD.findall((text or "").translate(LOWER))) + " "
    spans = []
    for r in license_rules.rules():
        for m in re.finditer(r.regex, spaced):
            spans.append((spaced[: m.start()].count(" ") // 2, -(spaced[: m.end()].count(" ") // 2), r.order, r.label))
    kept = []
    for x in sorted(spans):
        if not kept or x[0] >= -kept[-1][1]:
            kept.append(x)
        elif x[1] >= kept[-1][1]:
            continue
        elif x[2] < kept[-1][2]:
            kept[-1] = x
    return [(start, -behind, label) for start, behind, _, label in kept]


def license_texts():
    rng = random.Random(5)
    parts = [
        "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "CC BY-NC-SA 4.0", "cc-by-nc", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU Lesser General Public License v2.1",
        "All rights reserved.", "Permission is hereby granted, free of charge, to any person obtaining a copy", "Creative Commons Attribution-NonCommercial 4.0 International License", "Mit der Zeit", "the gpl, version 2 or later",
        "under the MIT licence", "word", "Été ß", "BSD 3-Clause License", "under the\nmit\tlicense", "UNDER THE MIT LICENSE", "version 3 of the licence", "\x00", "!!", "in the public domain", "dedicated to the public domain",
    ]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(120)]
    return [*texts, "", None, "!!!", "under the mit license", "cc by nc cc by nc", "x" * 50_000 + " cc by nc " + "y " * 20_000 + "under the mit license", "word " * 30_000, "MIT LİCENSE under the mit licenſe"]


def test_scans_equal_brute_force(spark):
    rows = [(i, t, 7, "x") for i, t in enumerate(license_texts())] + [(None, "CC BY NC", 7, "x"), (3, license_texts()[3], 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, row string")
    scanned = license_scan.scan(docs)
    assert scanned.columns == ["doc_id", "text", "row", "n_words", "places", "detections", "score"]
    for r in scanned.collect():
        assert [(d["start"], d["stop"], d["label"]) for d in r["detections"]] == plain_detections(r["text"])
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["detections"])
    texts = dict(enumerate(license_texts())) | {None: "CC BY NC"}
    made = license_scan.licenses(docs).collect()
    assert len(made) == len(rows)
    for r in made:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert license_scan.licenses(docs.limit(0)).collect() == []


def test_gates_hold_for_all_rules():
    made = license_rules.rules()
    assert len(made) > 500 and [r.order for r in made] == list(range(len(made)))
    for r in made:
        assert any(stem in r.gate for stem in license_rules.STEMS)
        # the gate stands in a text made from the rule's pattern with each optional word left out
        shortest = re.sub(r"\(\?:([^()|]*)\|[^()]*\)", r"\1", re.sub(r"\(\?: (?:\(\?:[^()]*\)|[^()]*) \)\?", "", r.regex)).replace("[cs]", "c").replace("v?", "")
        assert re.fullmatch(r.regex, shortest) and r.gate in shortest


def test_license_query_equals_its_sql(spark):
    same_as_sql(spark, "op12_license_scan")


# fill-in-middle


def plain_middle(doc_id, text):
    text, sha = text or "", lambda x: hashlib.sha256(x.encode()).hexdigest()
    units = UNIT.findall(text)
    h = fill_in_middle.draws("" if doc_id is None else str(doc_id), 42)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return doc_id, len(units), form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def middle_texts():
    rng = random.Random(7)
    make = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [make(" \n\tab<PSM>é😀　", rng.randint(0, 60)) for _ in range(300)]
    texts += [make(["word", " ", "  ", "\n", "ü", "<", "<P", "S>"], 4000) for _ in range(6)] + [" " * 5000, "a" * 5000, "<" * 3000 + "P>", "x" * 999 + "<P>" + "y" * 999, "x" * 998 + "<M>" + "y " * 999]
    return [*texts, "", None, " ", "a", "<P>", "   b"]


@pytest.mark.parametrize(("long", "broadcast"), [(1, 1 << 16), (7, 1 << 16), (1000, 0), (32_768, 1 << 16)])
def test_middles_equal_brute_force(spark, monkeypatch, long, broadcast):
    monkeypatch.setattr(fill_in_middle, "BROADCAST_CHUNKS", broadcast)
    rows = [(i, t, "f", 1) for i, t in enumerate(middle_texts())] + [(None, "no id at all here", "f", 1), (5, "again", "f", 1)] + [(6, middle_texts()[300], "f", 1)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, scan int").repartition(3)
    got = fill_in_middle.digests(docs, long=long).collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted((plain_middle(i, t) for i, t, _, _ in rows), key=key)


def test_transformed_documents_keep_their_columns_and_rebuild_their_texts(spark):
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in enumerate(middle_texts())], "doc_id long, text string, form string, key int")
    made = fill_in_middle.transform(docs, fim_percent=100)
    assert made.columns == ["doc_id", "text", "key", "n", "form", "prefix_chars", "middle_chars", "output"]
    for r in made.collect():
        assert fill_in_middle.restore(r["output"], r["form"]) == (r["text"] or "")
    assert {r["form"] for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(docs.limit(0)).collect() == []


def test_chunk_functions_compose_associatively():
    rng = random.Random(11)
    for _ in range(300):
        text = "".join(rng.choice(" a<PSM>\n") for _ in range(rng.randint(0, 30)))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(2))
        a, b, c = (chunk_function(code_points(t)) for t in (text[: cuts[0]], text[cuts[0] : cuts[1]], text[cuts[1] :]))
        whole = chunk_function(code_points(text))
        assert compose(compose(a, b), c) == compose(a, compose(b, c)) == whole
        assert (whole[1][0] + 1 if text else 0) == len(UNIT.findall(text))
        assert (whole[2][0] > 0) == any(m in text for m in ("<P>", "<S>", "<M>"))


def test_middle_query_equals_its_sql(spark):
    same_as_sql(spark, "op13_fill_in_middle")
