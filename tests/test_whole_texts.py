"""Tokens of whole texts as columns, against one text and word at a time."""

import random

import pyarrow as pa
import pytest

from textloom.functions import normalizers as N
from textloom.functions import splitters as S
from textloom.functions.aligned import Aligned
from textloom.operators.added_tokens import AddedToken
from textloom.operators.models import WordLevel, WordPiece
from textloom.plans.pipeline import TextPipeline, _Made

_QU = AddedToken("qu", lstrip=True, rstrip=True, normalized=False)
_LEVEL = WordLevel({"<unk>": 0, "qa": 1, "é": 2})
_PIECE = WordPiece({"[UNK]": 0, "q": 1, "##a": 2, "é": 3, "##é": 4, "a": 5})


@pytest.mark.parametrize("normalizer", [None, N.Lowercase(), N.UnicodeForm("NFKD")])
@pytest.mark.parametrize("splitter", [None, S.WhitespaceSplit(), S.Whitespace(), S.Metaspace()])
@pytest.mark.parametrize("model", [_LEVEL, _PIECE])
def test_columns_equal_text_by_text(model, splitter, normalizer):
    rng = random.Random(3)
    texts = ["", " ", "qu", None, *("".join(rng.choice("qua QUAé \nﬁ😀!") for _ in range(rng.randint(1, 40))) for _ in range(60))]
    pipe = TextPipeline(model, normalizer, splitter).with_added_tokens([_QU, AddedToken("A"), AddedToken("ua", single_word=True)])
    made, kernel, finders = _Made(), pipe._kernel(), pipe.added.finders(pipe.normalizer)
    for t in texts:
        if t is not None:
            pipe._add_tokens(t, made, kernel, finders)
        made.end_row()
    rows = made.array(pa.array([t is None for t in texts])).to_pylist()
    for t, row in zip(texts, rows):
        assert (row is None) == (t is None)
        if t is not None:
            assert list(zip(row["ids"], row["tokens"], row["word_ids"], row["starts"], row["ends"])) == pipe.tokens_of(t)


def test_words_of_unchanged_texts_need_no_objects(spark, monkeypatch):
    pipe = TextPipeline(_LEVEL, N.Lowercase(), S.WhitespaceSplit()).with_added_tokens([_QU])
    made, objects, plain = _Made(), [], Aligned.__init__
    monkeypatch.setattr(Aligned, "__init__", lambda self, *a, **b: objects.append(1) or plain(self, *a, **b))
    pipe._add_tokens("qa x " * 500 + "qu", made, pipe._kernel(), pipe.added.finders(pipe.normalizer))
    assert len(made.ids) == 1001 and len(objects) < 10


def test_an_unknown_word_without_an_unknown_token_is_an_error():
    pipe = TextPipeline(WordLevel({"a": 0}), None, S.WhitespaceSplit())
    with pytest.raises(ValueError):
        pipe._add_tokens("a b", _Made(), pipe._kernel(), pipe.added.finders(None))


@pytest.mark.parametrize("normalizer", [None, N.Lowercase(), N.UnicodeForm("NFKD"), N.Strip()])
@pytest.mark.parametrize("splitter", [None, S.WhitespaceSplit()])
@pytest.mark.parametrize("size", [1, 7, 64])
def test_batches_at_once_equal_text_by_text(splitter, normalizer, size):
    rng = random.Random(5)
    texts = ["", " ", "qu", None, "quququ", "AA", "\u2003\u3001\u3000", *("".join(rng.choice("qua QUAé \n\u2003ﬁ😀!ΣİA") for _ in range(rng.randint(0, 40))) for _ in range(80)), None]
    pipe = TextPipeline(_LEVEL, normalizer, splitter).with_added_tokens([_QU, AddedToken("A"), AddedToken("ua", single_word=True)])
    kernel, finders = pipe._kernel(), pipe.added.finders(pipe.normalizer)
    rows = [r for a in range(0, len(texts), size) for r in pipe._of_texts(pa.array(texts[a : a + size], pa.string()), kernel, finders).to_pylist()]
    assert len(rows) == len(texts)
    for t, row in zip(texts, rows):
        assert (row is None) == (t is None)
        if t is not None:
            assert list(zip(row["ids"], row["tokens"], row["word_ids"], row["starts"], row["ends"])) == pipe.tokens_of(t)


def test_a_batch_looks_each_of_its_words_up_once(monkeypatch):
    pipe = TextPipeline(_LEVEL, N.Lowercase(), S.WhitespaceSplit()).with_added_tokens([AddedToken("THE")])
    asked, plain = [], WordLevel.of_whole_words
    monkeypatch.setattr(WordLevel, "of_whole_words", lambda self, words: asked.extend(words) or plain(self, words))
    made = pipe._of_texts(pa.array(["QA x the Σ " * 500] * 3), pipe._kernel(), pipe.added.finders(pipe.normalizer))
    assert sum(len(r["ids"]) for r in made.to_pylist()) == 6000 and sorted(asked) == ["qa", "x", "σ"]
