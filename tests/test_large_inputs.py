"""What keeps time and memory in proportion to the input: single evaluation, no needless joins and windows, bounded slices."""

import pyarrow as pa
from pyspark.sql import functions as F

from textloom import queries
from textloom.functions import normalizers as N
from textloom.functions import splitters as S
from textloom.functions.aligned import Aligned
from textloom.functions.batches import SLICE, slices
from textloom.functions.chars import byte_alphabet
from textloom.operators import encodings as E
from textloom.operators.decoders import ByteLevelDecoder
from textloom.operators.models import Bpe, Unigram
from textloom.operators.token_search import found_tokens
from textloom.operators.spans import pieces_with_spans
from textloom.plans import presets

SMALL = "/root/testdata/sf0.001"


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def _lengths(spark):
    words = S.WhitespaceSplit().column(F.col("text"))
    tokens = F.transform(words, lambda w: F.struct(F.length(w).cast("long").alias("id"), w.alias("value"), F.lit(0).alias("start"), F.length(w).alias("end")))
    return spark.createDataFrame([("a bc " * 5000,), ("",), (" x",)], "text string"), E.from_tokens(tokens)


def test_a_text_is_split_once_however_often_its_encoding_is_used(spark):
    texts, e = _lengths(spark)
    assert _plan(texts.select(e.alias("e")), "analyzed").count("split(") == 1
    assert _plan(texts.select(E.merge([e]).alias("m")), "analyzed").count("split(") == 1
    rows = texts.select(E.merge([e, e]).alias("m"), E.char_to_token(e, 0).alias("t"), E.word_to_tokens(e, 0).alias("w")).collect()
    assert [len(r.m.ids) for r in rows] == [20_000, 0, 2] and rows[0].m.offsets[-1].end == 4 and [r.t for r in rows] == [0, None, 0]


def test_tokens_are_added_up_without_a_join(spark):
    for name in ("bpe_encode", "wordpiece_encode", "unigram_encode", "bpe_unknown"):
        assert "Join" not in _plan(queries.QUERIES[name](spark, SMALL)), name


def test_slices_of_aligned_texts_hold_no_spans():
    whole = Aligned("ab cdé e")
    part = whole.slice(3, 6)
    assert part.spans is None and part.to_original(1, 3) == (4, 6) and part.all_spans() == [(3, 4), (4, 5), (5, 6)]
    assert part.slice(1, 2).to_original(0, 1) == (4, 5) and [p.to_original(0, len(p.text)) for p in S.WhitespaceSplit().align([whole])] == [(0, 2), (3, 6), (7, 8)]
    made = N.NormalizerSequence((N.UnicodeForm("NFD"), N.StripAccents(), N.Lowercase())).align(part)
    assert made.text == "cde" and made.to_original(2, 3) == (5, 6)


def test_batches_are_cut_by_bytes_and_rows():
    texts = pa.array(["x" * SLICE, "y" * (2 * SLICE), None, *["z"] * 1001])
    parts = list(slices(texts, [texts]))
    assert pa.concat_arrays(parts).equals(texts) and max(map(len, parts)) <= 500 and [len(p) for p in parts[:2]] == [1, 1]
    words = pa.array([["a" * SLICE], ["b", None], None, ["c" * SLICE, "d"]])
    assert [len(p) for p in slices(words, [words])] == [1, 2, 1] and list(slices(texts[:0], [texts[:0]])) == []


def test_ids_with_added_tokens_equal_those_of_single_texts(spark):
    pipe = presets.byte_level_bpe(Bpe({c: i for i, c in enumerate(byte_alphabet())}, ())).with_special_tokens(["the"])
    texts = ["the été, then \U0001f600 the", "", None, "x" * 3000]
    rows = pipe.encode_ids(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert "ArrowEvalPython" in _plan(rows, "executedPlan")
    assert [r.ids for r in rows.collect()] == [None if t is None else [x[0] for x in pipe.tokens_of(t)] for t in texts]
    names = pipe._names(False) | {300: "☃"}
    lists = pa.array([[0, 300, 999, -1, None, 65], [], None, [195, 169, 195]])
    one = ByteLevelDecoder().of_ids(names)
    assert ByteLevelDecoder().of_lists(names)(lists) == [None if r is None else one(r) for r in lists.to_pylist()]


def test_pieces_are_placed_without_sorting_rows(spark):
    rows = pieces_with_spans(spark.createDataFrame([(1, "ab  éc"), (2, ""), (3, None), (4, "x")], "k long, text string"), ["k"], "text", r" +|[^ ]+")
    assert "Window" not in _plan(rows)
    assert sorted(map(tuple, rows.collect())) == [(1, 0, "ab", 0, 2), (1, 1, "  ", 2, 4), (1, 2, "éc", 4, 6), (4, 0, "x", 0, 1)]


def test_lattices_of_repeated_words_are_built_once():
    model = Unigram((("<unk>", 0.0), ("a", -1.0), ("b", -1.5), ("ab", -1.2)), 0, alpha=0.5)
    assert model._weighted("abab", 0.5) is model._weighted("abab", 0.5)


def test_ids_alone_equal_those_of_tokens():
    letters = {c: i for i, c in enumerate("abcdeth")} | {"<unk>": 9, "th": 10, "the": 11}
    words = ["", "the", "thaé", "éé", "tthhe", "x"]
    for model in (Bpe(letters, ()), Bpe(letters, (("t", "h"), ("th", "e")), unk_token="<unk>", fuse_unk=True), Bpe(letters, (), ignore_merges=True, unk_token="<unk>")):
        assert [model.ids_of(w) for w in words] == [[t.id for t in model.tokenize(w)] for w in words]


def test_places_of_tokens_are_dealt_once(spark):
    texts = spark.createDataFrame([(1, "abcd efgh abcd")], "k long, text string")
    found = found_tokens(texts, spark.createDataFrame([(0, "abcd"), (1, "efgh")], "id long, content string"), ["k"])
    assert [(r.start, r.stop, r.id) for r in found.orderBy("start").collect()] == [(0, 4, 0), (5, 9, 1), (10, 14, 0)]
    plan = [line for line in _plan(found, "executedPlan").split("Initial Plan")[-1].splitlines() if "Exchange hashpartitioning(k" in line]
    assert len(plan) == 1
