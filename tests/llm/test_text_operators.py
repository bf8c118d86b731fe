"""Near-dedup, line dedup and decontamination against brute force, with nulls, empty texts, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from textloom.llm import decontaminate, line_dedup, near_dedup
from textloom.llm.common import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, node string, w long, n_lines string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "naïve", "ß"]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = []
    for _ in range(12):
        base = make(rng.randint(3, 90)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    lines = [make(rng.randint(1, 6)) for _ in range(10)]
    for _ in range(25):
        texts.append("\n".join(rng.choice([*lines, "", "  ", make(4)]) for _ in range(rng.randint(1, 14))))
    texts += ["", None, "!!!", "!!!", "one", "One!", "a\n\n\nb", None, make(3000), "\n".join(lines * 3)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(5, texts[5]), (None, texts[3]), (None, "alone and without an id at all, my friend"), (7, "another text under seven")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "n", 1, "x") for i, t in rows], SCHEMA).repartition(3)


def similarity(a, b):
    shingles = lambda w: Counter(tuple(w[i : i + min(5, len(w))]) for i in range(max(len(w) - 4, 1))) if w else Counter()
    x, y = shingles(words(a)), shingles(words(b))
    both = sum((x & y).values())
    return both / max(sum(x.values()) + sum(y.values()) - both, 1)


def test_near_dedup_classes_equal_brute_force(spark, rows, docs):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a is not None and b is not None and (a == b or similarity(a, b) >= 0.8):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[root(i)] += [doc] if doc is not None else []
    expected = Counter((doc, min(least[root(i)], default=None)) for i, (doc, _) in enumerate(rows))
    found = Counter((r.doc_id, r.class_id) for r in near_dedup.classes(docs).collect())
    assert found == expected


def test_near_dedup_keeps_one_of_each_class(spark, docs):
    kept = near_dedup.deduplicate(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"))
    assert kept.columns == docs.columns
    again = near_dedup.classes(kept.where("doc_id <> 7"))
    assert again.where("doc_id <> class_id").count() == 0
    assert kept.where("doc_id = 5").count() <= 1


def test_near_dedup_keeps_unlike_texts_of_one_id(spark):
    rng = random.Random(9)
    a, b, c, d = (" ".join(f"v{rng.randrange(500)}" for _ in range(40)) for _ in range(4))
    # 7: two texts near nothing, one of them twice; 9: a copy of 1 and a text of its own; 5: two near texts
    given = [(1, a), (9, a), (9, b), (7, c), (7, d), (7, c), (9, None), (5, c + " x y"), (5, c + " x z"), (3, None), (None, a)]
    given = [(i, t, "n") for i, t in given]
    kept = near_dedup.deduplicate(spark.createDataFrame(given, "doc_id long, text string, key string").repartition(3))
    assert kept.columns == ["doc_id", "text", "key"]
    found = Counter((r.doc_id, r.text) for r in kept.collect())
    of_five = [k for k in found if k[0] == 5]
    assert len(of_five) == 1 and found.pop(of_five[0]) == 1
    assert found == Counter([(1, a), (9, b), (7, d), (9, None), (3, None), (None, a)])


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    elements = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    a, b = rng.integers(0, 9, 400), rng.integers(0, 9, 400)
    rows = [(np.full((x > 0).sum(), k), elements[x > 0], x[x > 0]) for k, x in enumerate((a, b))]
    owners, found, counts = (np.concatenate(x) for x in zip(*rows))
    signatures = near_dedup.bag_minhash(owners, found, counts, 2, registers=4096)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((signatures[0] == signatures[1]).mean() - true) < 0.03


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in near_dedup.components(links, Scratch(spark, "test")).collect()}
    assert {roots[i] for i in range(41)} == {0} and roots[101] == 100


def brute_lines(rows, least):
    """Later copies of runs of at least ``least`` words, as they are defined."""
    order = sorted({(i if i is not None else (1 << 63) - 1, t) for i, t in rows if t is not None}, key=lambda r: r[0])
    lines = {r: [x for x in r[1].split("\n") if x.strip(" ")] for r in order}
    first, later, gone = {}, [], defaultdict(set)
    for r in order:
        own = lines[r]
        for p in range(len(own)):
            n, q = 0, p
            while q < len(own) and n < least:
                n += len(re.split(" +", own[q].strip(" ")))
                q += 1
            if n >= least:
                run = tuple(own[p:q])
                later += [(r, p, first[run])] if run in first else []
                first.setdefault(run, (r, p))
    for r, p, (s, q) in later:
        k = 0
        while p + k < len(lines[r]) and q + k < len(lines[s]) and lines[r][p + k] == lines[s][q + k]:
            gone[r].add(p + k)
            k += 1
    return lines, gone


def test_line_dedup_equals_brute_force(spark, rows, docs):
    # equal ids with different texts have no order of their own, so one of each id is taken
    unique = list({i: (i, t) for i, t in rows}.values())
    given = spark.createDataFrame([(i, t, "n", 1, "x") for i, t in unique] + [(3, unique[3][1], "n", 1, "x")], SCHEMA).repartition(3)
    lines, gone = brute_lines(unique, line_dedup.MIN_WORDS)
    assert gone
    expected = Counter()
    for i, t in [*unique, (3, unique[3][1])]:
        r = (i if i is not None else (1 << 63) - 1, t)
        out, k = [], 0
        for x in (t or "").split("\n"):
            if x.strip(" "):
                out += [x] if k not in gone[r] else []
                k += 1
            else:
                out.append(x)
        text = t if not gone[r] else "\n".join(out) if len(gone[r]) < len(lines[r]) else ""
        expected[i, text, len(gone[r])] += 1
    made = line_dedup.deduplicate(given)
    assert made.columns == ["doc_id", "text", "node", "w", "n_lines", "n_deleted"]
    assert Counter((r.doc_id, r.text, r.n_deleted) for r in made.collect()) == expected


def test_line_dedup_of_repeated_rows_and_clashing_columns(spark):
    text = "\n".join(f"this is line {i} of a text that many rows repeat as it is" for i in range(40))
    rows = [(1, text)] + [(2, text)] * 50 + [(3, "one line of its own that stands nowhere else at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("__cuts", "cuts", "row", "doc", "key", "may", "word"):
        docs = docs.withColumn(name, F.lit(name))
    made = line_dedup.deduplicate(docs)
    assert made.columns == [*docs.columns, "n_lines", "n_deleted"]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_deleted, r["__cuts"]) for r in made.collect()) == Counter({(1, text, 40, 0, "__cuts"): 1, (2, "", 40, 40, "__cuts"): 50, (3, rows[-1][1], 1, 0, "__cuts"): 1})
    with Scratch(spark, "test") as scratch:
        assert line_dedup.copied_runs(docs, line_dedup.MIN_WORDS, scratch).count() == 1


def test_overlapping_repeated_and_nested_cuts(spark):
    runs = [(1, 7, 2, 3), (1, 7, 2, 3), (1, 7, 4, 4), (1, 7, 5, 1), (1, 7, 12, 1), (2, 7, 0, 2)]
    cuts = line_dedup._cuts(spark.createDataFrame(runs, "doc long, key long, pos int, lines int"))
    text = "\n".join(f" {i}" if i % 4 else f"\n{i}" for i in range(15))
    shaped = cuts.withColumn("text", F.lit(text)).select("doc", *line_dedup._without(F.col("text"), F.col("cuts")))
    made = {r[0]: (r[1], r[2]) for r in shaped.collect()}
    for doc, gone in ((1, {2, 3, 4, 5, 6, 7, 12}), (2, {0, 1})):
        filled, left = -1, []
        for line in text.split("\n"):
            filled += bool(line.strip(" "))
            if not line.strip(" ") or filled not in gone:
                left.append(line)
        assert made[doc] == ("\n".join(left), len(gone))


def test_line_dedup_with_hot_runs_equals_brute_force(spark):
    # hundreds of documents repeat one passage, so its runs and their source are dealt into salts
    passage = "\n".join(f"passage line {i} with words enough to be a run of its own" for i in range(3))
    rows = [(i, f"own words {i} before the passage in this very document\n{passage}\nown words {i} after the passage in this very document") for i in range(300)]
    lines, gone = brute_lines(rows, line_dedup.MIN_WORDS)
    made = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_deleted for r in made.collect()} == {i: len(gone[i, t]) for i, t in rows}


def brute_contamination(rows, items):
    windows, lengths = defaultdict(set), set()
    for i, t in items:
        w = words(t)
        if w and i is not None:
            n = min(10, len(w))
            lengths.add(n)
            for s in range(len(w) - n + 1):
                windows[tuple(w[s : s + n])].add(i)
    out = Counter()
    for doc, t in rows:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if own := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[doc, len(w), len(hit), len(found), digest, bool(hit)] += 1
    return out


@pytest.mark.parametrize("most", [decontaminate.SET_SHINGLES, 0])
def test_decontamination_equals_brute_force(spark, rows, docs, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "SET_SHINGLES", most)
    texts = [t for _, t in rows if t]
    items = [(1, " ".join(texts[0].split()[:14])), (2, "one"), (3, None), (4, ""), (10, texts[4]), (11, "w1 w2"), (12, texts[4]), (None, texts[8]), (13, "never seen words stand here in a row of more than ten words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    fields = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    found = Counter(tuple(r[f] for f in fields) for r in decontaminate.contamination(docs, bench).collect())
    assert found == brute_contamination(rows, items)


def test_empty_tables(spark, docs):
    nothing = docs.limit(0)
    assert near_dedup.classes(nothing).count() == 0
    assert line_dedup.deduplicate(nothing).count() == 0
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("most", [decontaminate.SET_SHINGLES, 0])
def test_items_that_share_a_passage_are_all_found(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "SET_SHINGLES", most)
    shared, other = " ".join(f"s{i}" for i in range(14)), " ".join(f"o{i}" for i in range(12))
    items = [(f"i{k}", shared if k % 3 else f"{shared} {other} end{k}") for k in range(120)] + [("short", "o3 o4")]
    docs = [(k, f"a{k} {shared} b" if k % 2 else f"{shared} {other}") for k in range(60)] + [(100, f"x {other} y"), (101, "nothing here"), (102, None), (1, f"a1 {shared} b")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), bench).collect()
    fields = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert Counter(tuple(r[f] for f in fields) for r in found) == Counter(brute_contamination(docs, items))
