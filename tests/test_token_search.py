"""Added tokens found by the join, against the search one text at a time."""

import random

import pytest

from textloom.functions import normalizers as N
from textloom.functions.aligned import Aligned
from textloom.operators import token_search
from textloom.operators.added_tokens import AddedToken, AddedVocabulary, cut
from textloom.operators.models import WordLevel

TOKENS = "id long, content string, single_word boolean, lstrip boolean, rstrip boolean, normalized boolean, special boolean"


def added(n, seed, normalized=False):
    rng = random.Random(seed)
    made = []
    for _ in range(n):
        content = "".join(rng.choice(["a", "b", "ab", " ", "é", "😀", "_", "B"]) for _ in range(rng.randint(1, 7)))
        made.append(AddedToken(content, *(rng.random() < 0.3 for _ in range(3)), normalized=normalized and rng.random() < 0.5))
    return AddedVocabulary().add(made, WordLevel({}))


def texts(seed):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice(["a", "b", "ab", " ", "  ", "é", "😀", "_", "B", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    return [*rows, (200, ""), (201, None), (202, "ab " * 3000), (7, rows[7][1]), (None, "ab ab_a  b")]


def one_by_one(vocabulary, text):
    at, out = 0, []
    for piece, i in cut(Aligned(text), vocabulary._finder(False, None)):
        if i is not None:
            out.append((at, at + len(piece.text), i))
        at += len(piece.text)
    return out


@pytest.mark.parametrize("broadcast", [4_000_000, 0])
def test_places_equal_the_search_text_by_text(spark, monkeypatch, broadcast):
    monkeypatch.setattr(token_search, "BROADCAST_CHARS", broadcast)
    for n in (3, 60):
        vocabulary = added(n, n)
        rows = texts(n)
        df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, content string").repartition(4)
        found = token_search.found_tokens(df, vocabulary.table(spark), ["doc_id"]).collect()
        expected = {(i, *place) for i, t in rows if t for place in one_by_one(vocabulary, t)}
        assert sorted((r.doc_id is None, r.doc_id or 0, r.start, r.stop, r.id) for r in found) == sorted((i is None, i or 0, *rest) for i, *rest in expected)
        assert len(expected) > 40
        assert token_search.found_tokens(df.limit(0), vocabulary.table(spark), ["doc_id"]).count() == 0
    assert token_search.found_tokens(df, spark.createDataFrame([(1, "")], "id long, content string"), ["doc_id"]).count() == 0


def test_both_passes_equal_the_search_text_by_text(spark):
    vocabulary, normalizer = added(40, 9, normalized=True), N.Lowercase()
    rows = [(i, t) for i, t in texts(4)[:150]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = token_search.added_token_places(df, vocabulary.table(spark), ["doc_id"], normalize=normalizer.column).collect()
    raw, normalized = vocabulary.finders(normalizer)
    expected = []
    for i, t in rows:
        at = 0
        for piece, token in cut(Aligned(t), raw):
            if token is not None:
                expected.append((i, False, 0, at, at + len(piece.text), token))
            else:
                inner = 0
                for part, token in cut(normalizer.align(piece), normalized):
                    if token is not None:
                        expected.append((i, True, at, inner, inner + len(part.text), token))
                    inner += len(part.text)
            at += len(piece.text)
    assert sorted((r.doc_id, r.normalized, r.piece, r.start, r.stop, r.id) for r in found) == sorted(expected)
    assert {r.normalized for r in found} == {True, False}


def test_places_of_a_small_table_are_not_shuffled(spark, capsys):
    df = spark.createDataFrame([(1, "ab ab"), (2, "b a")], "doc_id long, text string")
    found = token_search.found_tokens(df, added(5, 3).table(spark), ["doc_id"])
    found.explain()
    assert "Exchange" not in capsys.readouterr().out
