"""Encodings, trainers, joins and streams on tables."""

import random
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from textloom.functions import normalizers as N
from textloom.functions import splitters as S
from textloom.functions.chars import byte_alphabet
from textloom.functions.patterns import Pattern
from textloom.operators import encodings as E
from textloom.operators.models import Bpe, Unigram, WordLevel, WordPiece, tokens_of_words
from textloom.operators.pair_table import certain_merges
from textloom.operators.processors import BertProcessor, ByteLevelProcessor, ProcessorSequence, RobertaProcessor, TemplateProcessor, processor_from_json, processor_to_json
from textloom.operators.trainers import BpeTrainer, UnigramTrainer, WordLevelTrainer, WordPieceTrainer, word_counts
from textloom.plans import presets
from textloom.plans.pipeline import Padding, TextPipeline, Truncation
from textloom.plans.training import train, train_from_files
from textloom.sources.tables import text_lines
from textloom.streaming.decode_stream import decode_steps, decode_streams

TEXTS = ["so far, so good?  Yes: it is!", "Café — déjà-vu 123½ ２", "", "ΟΔΥΣΣΕΎΣ 我今天", "a\tb\nc  d", " lead and trail ", "don't they're x's", "ﬁ ½ é", None]


@pytest.mark.parametrize("splitter", [S.Whitespace(), S.WhitespaceSplit(), S.BertSplitter(), *(S.Punctuation(b) for b in ("removed", "isolated", "merged_with_previous", "merged_with_next", "contiguous")), S.Digits(), S.Digits(True), S.FixedLength(3), S.Metaspace(), S.Metaspace(split=False), S.ByteLevel(), S.ByteLevel(False), S.CharDelimiterSplit(" "), S.Split(Pattern(r"\w+", True), "isolated"), S.Split(Pattern(r"\w+", True), "removed", invert=True), S.Split(Pattern(" "), "merged_with_next"), S.SplitterSequence((S.WhitespaceSplit(), S.Punctuation())), S.UnicodeScripts()], ids=str)
def test_columns_split_like_aligned_texts(spark, splitter):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    found = [r[0] for r in df.select(splitter.column(F.col("t"))).collect()]
    for text, pieces in zip(TEXTS, found):
        assert (pieces or []) == ([p for p, _ in splitter.pre_tokenize_str(text)] if text is not None else [])


@pytest.mark.parametrize("normalizer", [N.Lowercase(), N.Strip(), N.Strip(strip_right=False), N.StripAccents(), N.Nmt(), N.Prepend("_"), N.ByteChars(), N.BertNormalizer(), N.BertNormalizer(lowercase=False), N.Replace(Pattern(r"\s+", True), "$1\\"), N.Replace(Pattern("e"), "3"), *(N.UnicodeForm(f) for f in ("NFC", "NFD", "NFKC", "NFKD")), N.CustomNormalizer(lambda t: t.upper())], ids=str)
def test_columns_normalize_like_aligned_texts(spark, normalizer):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    found = [r[0] for r in df.select(normalizer.column(F.col("t"))).collect()]
    assert found == [None if t is None else normalizer.normalize_str(t) for t in TEXTS]


def windows_by_hand(n, most, stride, direction):
    spans, at = [], 0
    while True:
        stop = min(at + most, n)
        spans.append((at, stop))
        if stop == n:
            break
        at += most - stride
    return spans if direction == "right" else [(n - b, n - a) for a, b in spans]


def test_truncation_windows(spark):
    rows = [(n,) for n in range(0, 23)]
    df = spark.createDataFrame(rows, "n int")
    for most, stride, direction in product((1, 3, 5), (0, 1, 2), ("right", "left")):
        if stride < most:
            for r in df.select("n", E.windows(F.col("n"), most, stride, direction).alias("w")).collect():
                found = [(w.start, w.start + w.length) for w in r.w]
                assert found == (windows_by_hand(r.n, most, stride, direction) if r.n else [(0, 0)])
    with pytest.raises(ValueError):
        E.windows(F.col("n"), 2, 2)


def test_pair_lengths(spark):
    df = spark.createDataFrame(list(product((0, 2, 4, 8), repeat=2)), "a int, b int")
    x, y = E.pair_lengths(F.col("a"), F.col("b"), 7)
    assert [tuple(r) for r in df.select(x, y).collect()] == [(0, 0), (0, 2), (0, 4), (0, 7), (2, 0), (2, 2), (2, 4), (2, 5), (4, 0), (4, 2), (3, 4), (3, 4), (7, 0), (5, 2), (4, 3), (3, 4)]
    x, y = E.pair_lengths(F.col("a"), F.col("b"), 7, "only_first")
    assert df.where("a = 8 AND b = 2").select(x, y).first() == (5, 2)
    with pytest.raises(Exception, match="too short"):
        df.where("a = 2 AND b = 8").select(x).collect()


def encoding_of(df):
    return df.select("*", E.from_tokens(F.transform("t", lambda x, i: F.struct(i.cast("long").alias("id"), x.alias("value"), i.alias("start"), (i + 1).alias("end")))).alias("e"))


def test_padding_templates_and_lookups(spark):
    df = encoding_of(spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, ["x"])], "k int, t array<string>"))
    left = E.pad(F.col("e"), F.lit(5), pad_id=9, direction="left")
    r = df.where("k = 1").select(left.alias("p")).first().p
    assert r.ids == [9, 9, 0, 1, 2] and r.attention_mask == [0, 0, 1, 1, 1] and r.special_tokens_mask == [1, 1, 0, 0, 0] and r.word_ids == [None] * 5
    assert [r[0] for r in E.pad_table(df.withColumn("e", E.with_overflow(F.col("e"))), "e", multiple_of=8).select(F.size("e.ids")).collect()] == [8, 8, 8]
    pair = E.bert_template().apply(F.col("e"), F.col("e"))
    r = df.where("k = 3").select(pair.alias("p")).first().p
    assert r.ids == [101, 0, 102, 0, 102] and r.type_ids == [0, 0, 0, 1, 1] and r.special_tokens_mask == [1, 0, 1, 0, 1] and r.sequence_ids == [None, 0, None, 1, None]
    assert df.where("k = 3").select(E.n_sequences(pair).alias("n")).first().n == 2
    assert df.where("k = 3").select(E.roberta_template().apply(F.col("e"), F.col("e")).alias("p")).first().p.ids == [0, 0, 2, 2, 0, 2]
    merged = df.where("k = 1").select(E.merge([F.col("e"), F.col("e")]).alias("m")).first().m
    assert [tuple(o) for o in merged.offsets][2:4] == [(2, 3), (3, 4)]
    found = df.where("k = 1").select(E.char_to_token(F.col("e"), 1).alias("t"), E.char_to_token(F.col("e"), 7).alias("n"), E.token_to_chars(F.col("e"), 2).alias("c"), E.token_to_sequence(F.col("e"), 3).alias("s")).first()
    assert found.t == 1 and found.n is None and tuple(found.c) == (2, 3) and found.s is None
    cut = df.where("k = 1").select(E.truncate(F.col("e"), 0).alias("z")).first().z
    assert cut.ids == [] and cut.overflowing[0].ids == [0, 1, 2]


def test_trimmed_offsets(spark):
    tokens = ["Ġgreen", "Ġleave", "ĠĠ", "x"]
    spans = [(0, 6), (6, 12), (12, 14), (14, 15)]
    rows = [([{"id": 0, "value": t, "start": a, "end": b} for t, (a, b) in zip(tokens, spans)],)]
    df = spark.createDataFrame(rows, "t array<struct<id:long,value:string,start:int,end:int>>")
    found = lambda add: [tuple(o) for o in df.select(E.trim_offsets(E.from_tokens(F.col("t")), add).alias("e")).first().e.offsets]
    assert found(False) == [(1, 6), (7, 12), (14, 14), (14, 15)] and found(True)[:2] == [(0, 6), (7, 12)]


def test_encode_pairs_words_and_offsets(spark):
    vocab = {t: i for i, t in enumerate("[PAD] [UNK] [CLS] [SEP] some words how are you , ? so ##me the".split())}
    pipe = presets.bert_word_piece(WordPiece(vocab))
    df = spark.createDataFrame([(1, "Söme wörds, how?", None), (2, None, None), (3, "the words", "how are you"), (4, "", "")], "id int, text string, pair string")
    cut = pipe.with_(truncation=Truncation(6, 1), padding=Padding(8))
    rows = {r.id: r.encoding for r in cut.encode(df, "text", "pair").collect()}
    assert rows[2] is None and all(len(e.ids) == 8 for e in rows.values() if e)
    assert rows[1].tokens == ["[CLS]", "some", "words", ",", "how", "[SEP]", "[PAD]", "[PAD]"] and tuple(rows[1].offsets[2]) == (5, 10)
    assert [w.tokens[1:3] for w in rows[1].overflowing] == [["how", "?"]]
    assert rows[3].ids[:6] == [2, vocab["the"], 3, vocab["how"], vocab["are"], 3] and len(rows[3].overflowing) > 0
    plain = pipe.encode(df.where("id = 1"), offset_type="byte").first().encoding
    assert [tuple(o) for o in plain.offsets][1:3] == [(0, 5), (6, 12)]
    assert set(pipe.encode(df.where("id = 1"), offset_type="none").first().encoding.tokens) == {"[CLS]", "", "[SEP]"}
    words = spark.createDataFrame([(["Some", "you"],)], "text array<string>")
    e = pipe.encode(words).first().encoding
    assert e.word_ids == [None, 0, 1, None] and [tuple(o) for o in e.offsets][1:3] == [(0, 4), (0, 3)]
    ids = pipe.encode_ids(df).collect()
    assert ids[0].ids == [4, 5, 9, 6, 10] and ids[1].ids is None and ids[3].ids == []
    assert pipe.decode(pipe.encode_ids(df), "ids", "back").first().back == "some words, how?"


def test_processors_round_trip_as_json():
    parts = (TemplateProcessor(E.bert_template()), BertProcessor(), RobertaProcessor(), ByteLevelProcessor())
    for p in (*parts, ProcessorSequence(parts)):
        assert processor_from_json(processor_to_json(p)) == p
    assert BertProcessor().added_tokens(True) == 3 and RobertaProcessor().added_tokens(True) == 4 and ProcessorSequence(parts[:2]).added_tokens(False) == 4


COUNTS = {"stone": 1, "ten": 3, "net": 1, "tents": 2, "on": 2, "OK": 1, "no-go": 1}


def test_word_level_training_is_a_top_k(spark):
    counts = spark.createDataFrame(list(COUNTS.items()), "word string, count long")
    assert WordLevelTrainer(5, 0, ("<unk>",)).train(counts).vocab == {"<unk>": 0, "ten": 1, "on": 2, "tents": 3, "OK": 4}
    assert set(WordLevelTrainer(min_frequency=2).train(counts).vocab) == {"ten", "on", "tents"}


def merges_one_by_one(counts, steps):
    words = {w: list(w) for w in counts}
    vocab = {c: i for i, c in enumerate(sorted({c for w in counts for c in w}))}
    out = []
    for _ in range(steps):
        pairs = {}
        for w, s in words.items():
            for p in zip(s, s[1:]):
                pairs[p] = pairs.get(p, 0) + counts[w]
        if not pairs:
            break
        a, b = min(pairs, key=lambda p: (-pairs[p], vocab[p[0]], vocab[p[1]]))
        vocab.setdefault(a + b, len(vocab))
        out.append((a, b))
        for s in words.values():
            i = 0
            while i + 1 < len(s):
                if (s[i], s[i + 1]) == (a, b):
                    s[i : i + 2] = [a + b]
                i += 1
    return out


def test_merges_in_rounds_equal_merges_one_by_one(spark):
    counts = spark.createDataFrame(list(COUNTS.items()), "word string, count long")
    model = BpeTrainer(min_frequency=2).train(counts)
    assert list(model.merges[:3]) == merges_one_by_one(COUNTS, 3) == [("e", "n"), ("t", "en"), ("o", "n")]
    rng = random.Random(5)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))): rng.randint(1, 60) for _ in range(80)}
    model = BpeTrainer(30).train(spark.createDataFrame(list(words.items()), "word string, count long"))
    assert list(model.merges) == merges_one_by_one(words, 25)


def test_word_piece_and_limits(spark):
    counts = spark.createDataFrame(list(COUNTS.items()), "word string, count long")
    pieces = WordPieceTrainer(60, special_tokens=("[UNK]",)).train(counts)
    assert pieces.vocab["[UNK]"] == 0 and "##ne" in pieces.vocab and "stone" in pieces.vocab and len(pieces.vocab) <= 60
    assert [t.value for t in pieces.tokenize("stone")] == ["stone"]
    few = BpeTrainer(10, limit_alphabet=3, initial_alphabet=("z",)).alphabet(counts)
    assert few == sorted(few) and "z" in few and len(few) == 3
    assert max(map(len, BpeTrainer(100, max_token_length=2).train(counts).vocab)) <= 2


def test_many_merges_with_repeats_and_overlaps_equal_merges_one_by_one(spark):
    rng = random.Random(8)
    for alphabet, n, longest, merges in (("ab", 60, 14, 40), ("abcdefgh", 300, 10, 80), ("aé😀", 80, 12, 40)):
        words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))): rng.randint(1, 10_000) for _ in range(n)}
        expected = merges_one_by_one(words, merges)
        made = len({c for w in words for c in w} | {a + b for a, b in expected})
        model = BpeTrainer(made).train(spark.createDataFrame(list(words.items()), "word string, count long").repartition(3))
        assert list(model.merges)[: len(expected)] == expected[: len(model.merges)] and len(model.vocab) == made


def test_merges_of_documents_equal_merges_one_by_one(spark):
    counts = word_counts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "text", S.WhitespaceSplit())
    model = BpeTrainer(500).train(counts)
    words = {r["word"]: r["count"] for r in counts.collect()}
    symbols, ids, merges = {w: list(w) for w in words}, {c: i for i, c in enumerate(sorted({c for w in words for c in w}))}, []
    pairs, holders = Counter(), defaultdict(set)
    for w, s in symbols.items():
        for p in zip(s, s[1:]):
            pairs[p] += words[w]
            holders[p].add(w)
    while len(ids) < 500:
        a, b = min(pairs, key=lambda p: (-pairs[p], ids[p[0]], ids[p[1]]))
        ids.setdefault(a + b, len(ids))
        merges.append((a, b))
        for w in holders.pop((a, b)):
            s, out = symbols[w], []
            for p in zip(s, s[1:]):
                pairs[p] -= words[w]
            while s:
                k = 2 if s[:2] == [a, b] else 1
                out.append("".join(s[:k]))
                s = s[k:]
            symbols[w] = out
            for p in zip(out, out[1:]):
                pairs[p] += words[w]
                holders[p].add(w)
        pairs = +pairs
    assert list(model.merges) == merges and model.vocab == ids


def test_certain_merges_stop_where_the_order_is_open():
    new = lambda a, b: ((a, b), None)
    pairs, few = [(0, 1, 100), (1, 2, 90), (3, 4, 80), (5, 6, 70)], np.array([10, 10, 10, 10])
    # (1, 2) loses 15 of its places to (0, 1), and is 75 then
    assert certain_merges(pairs, 0, few, {(0, 1): 15}, new) == [0, 2, 1, 3]
    # what arises from the first may be as frequent as 75
    assert certain_merges(pairs, 0, np.array([75, 10, 10, 10]), {(0, 1): 15}, new) == [0, 2]
    assert certain_merges(pairs, 70, few, {}, new) == [0, 1, 2]
    # of runs of 0, (0, 2) may lose nothing or all of 3
    assert certain_merges([(0, 0, 9), (0, 2, 8), (3, 4, 7)], 0, np.array([1, 1, 1]), {(0, 1): 3}, new) == [0]
    # the first makes token 6, whose pair (5, 6) may gain 10, or 15: then it may be as frequent as (3, 4), or more so
    assert certain_merges(pairs, 0, few, {}, lambda a, b: ("t", 6) if a == 0 else ((a, b), None)) == [0, 1, 2]
    assert certain_merges(pairs, 0, np.array([15, 5, 5, 5]), {}, lambda a, b: ("t", 6) if a == 0 else ((a, b), None)) == [0, 1]


def test_long_pairs_do_not_crowd_out_admissible_ones(spark):
    # more pairs that merges gave rise to than a round looks at are too long, and more frequent than the one that may be merged
    made = [(chr(0x4000 + i) + "ab", 100) for i in range(1500)] + [("xy", 5)]
    counts = spark.createDataFrame(made, "word string, count long")
    chars = {c for w, _ in made for c in w}
    assert set(BpeTrainer(100_000, max_token_length=3).train(counts).vocab) == chars | {"ab", "xy"}
    # pairs of first symbols always count, longer ones below the limit
    counts = spark.createDataFrame([("abc", 9), ("ab", 4)], "word string, count long")
    for most, made in ((1, {"ab"}), (3, {"ab"}), (4, {"ab", "abc"})):
        assert set(BpeTrainer(100, max_token_length=most).train(counts).vocab) == {*"abc"} | made


def test_unigram_seeds_and_training(spark):
    counts = spark.createDataFrame([("papa", 2), ("paxpy", 1), ("みずうみ", 1)], "word string, count long")
    seeds = {r.piece: r.score for r in UnigramTrainer().seeds(counts).collect()}
    # "pa" stands before p, at an end and before x, once in each distinct word
    assert seeds["pa"] == 6 and seeds["p"] == 6 and {k for k in seeds if len(k) > 1} == {"pa"}
    text = "the cat and the dog and the bird sat on the mat with the other cat " * 4
    df = spark.createDataFrame([(text,)], "text string")
    words = word_counts(df, "text", S.Metaspace())
    model = UnigramTrainer(40, special_tokens=("<s>",), unk_token="<unk>").train(words)
    assert model.pieces[0][0] == "<unk>" and len(model.pieces) <= 40 and model.unk_id == 0
    assert "".join(t.value for t in model.tokenize(chr(0x2581) + "cat")) == chr(0x2581) + "cat"


def test_training_checks_the_model_and_reads_files(spark, tmp_path):
    with pytest.raises(ValueError, match="can only train"):
        train(TextPipeline(WordLevel({})), BpeTrainer(), spark.createDataFrame([("a",)], "text string"))
    (tmp_path / "a.txt").write_text("one two\r\ntwo\n\nlast")
    assert [r.text for r in text_lines(spark, f"file://{tmp_path}/a.txt").collect()] == ["one two\r\n", "two\n", "\n", "last"]
    pipe = train_from_files(spark, TextPipeline(WordLevel({}), splitter=S.WhitespaceSplit()), WordLevelTrainer(special_tokens=("<unk>",)), f"file://{tmp_path}/a.txt")
    assert pipe.model.vocab["two"] == 1 and pipe.added.special_ids == {0}
    batches = spark.createDataFrame([(["x y", "y"],)], "text array<string>")
    assert train(TextPipeline(WordLevel({}), splitter=S.WhitespaceSplit()), WordLevelTrainer(), batches).model.vocab == {"y": 0, "x": 1}


def test_distinct_words_reach_the_model_once(spark):
    words = spark.createDataFrame([("ab",), ("ab",), ("c",), (None,)], "word string")
    rows = tokens_of_words(words, Unigram((("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -1.0)), 0)).collect()
    assert sorted((r.word, r.pos, r.token) for r in rows) == [("ab", 0, "ab"), ("c", 0, "c")]


def test_decode_streams_in_micro_batches(spark, tmp_path):
    pipe = presets.byte_level_bpe(Bpe({c: i for i, c in enumerate(byte_alphabet())}, ()))
    texts = {1: "héllo", 2: "中文 ok"}
    rows = [(k, p, b) for k, t in texts.items() for p, b in enumerate(t.encode())]
    df = spark.createDataFrame(rows, "stream_id long, pos long, id long")
    join = lambda rows: {k: "".join(r.text or "" for r in sorted((x for x in rows if x.stream_id == k), key=lambda r: r.pos)) for k in texts}
    assert join(decode_steps(df, pipe).collect()) == texts
    for k, (low, high) in enumerate(((0, 2), (2, 4), (4, 99))):
        df.where((F.col("pos") >= low) & (F.col("pos") < high)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        assert k < 3
    stream = decode_streams(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"), pipe)
    query = stream.writeStream.format("memory").queryName("decoded").option("checkpointLocation", f"file://{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert join(spark.table("decoded").collect()) == texts


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) > 60 and set(sql) <= set(queries)


@pytest.mark.parametrize("name", ["wordlevel_encode", "pretok_bert", "norm_bert", "wordpiece_encode", "unigram_seeds", "truncate_right", "truncate_pair", "pad_batch_longest", "template_pair_bert", "encoding_char_to_token", "decode_wordpiece", "decode_byte_fallback", "added_tokens_single_word", "token_statistics"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    found = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
    wanted = con.execute(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(wanted.columns)
    order = lambda d: d[columns].astype(str).sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(found), order(wanted))


def test_metaspace_of_odd_texts_equals_its_sql(spark, tmp_path):
    from textloom import queries

    texts = ["", "▁", "▁a b", "▁▁", " ", " a", "  a", "a", "a  b ", "\n a", "　a", "😀 ▁b", None]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = queries.QUERIES["pretok_metaspace"](spark, str(tmp_path)).collect()
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = db.sql(f"SELECT piece, n FROM ({queries.ORACLE_SQL['pretok_metaspace']})").fetchall()
    assert sorted(map(tuple, made)) == sorted(want)


@pytest.mark.parametrize("symbols", [1 << 20, 8])
def test_merges_take_few_rounds(spark, monkeypatch, symbols):
    from textloom.operators import trainers

    rounds, merge_round = [], trainers.merge_round
    monkeypatch.setattr(trainers, "SYMBOLS", symbols, raising=False)
    monkeypatch.setattr(trainers, "merge_round", lambda words, merges: rounds.append(len(merges)) or merge_round(words, merges))
    rng = random.Random(5)
    words = Counter("".join(rng.choice("aab" if k % 3 else "abcde") for _ in range(rng.randint(1, 12))) for k in range(400)) + Counter({"a" * 21: 3, "ab" * 9: 2})
    size = 150 if symbols > 8 else 12
    model = BpeTrainer(size).train(spark.createDataFrame(list(words.items()), "word string, count long").repartition(3))
    parts, ids, merges = {w: list(w) for w in words}, {c: i for i, c in enumerate("abcde")}, []
    while len(ids) < size:
        pairs = Counter()
        for w, s in parts.items():
            for p in zip(s, s[1:]):
                pairs[p] += words[w]
        a, b = min(pairs, key=lambda p: (-pairs[p], ids[p[0]], ids[p[1]]))
        ids.setdefault(a + b, len(ids))
        merges.append((a, b))
        for w, s in parts.items():
            out, i = [], 0
            while i < len(s):
                k = 2 if s[i : i + 2] == [a, b] else 1
                out.append("".join(s[i : i + k]))
                i += k
            parts[w] = out
    assert list(model.merges) == merges and model.vocab == ids
    if symbols > 8:
        documents = word_counts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "text", S.WhitespaceSplit())
        rounds.clear()
        BpeTrainer(1000).train(documents)
        assert sum(rounds) >= 850 and len(rounds) <= 8
