"""Known results of each kind of component, and what must hold for any text."""

import json
import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.functions import normalizers as N
from textloom.functions import splitters as S
from textloom.functions.aligned import BEHAVIORS, Aligned
from textloom.functions.chars import byte_alphabet, byte_of, to_byte_chars
from textloom.functions.patterns import Pattern
from textloom.operators import decoders as D
from textloom.operators.added_tokens import AddedToken, AddedVocabulary, special_token
from textloom.operators.encodings import Piece, parse_piece, template
from textloom.operators.models import Bpe, Unigram, WordLevel, WordPiece, wordpiece_from_bpe
from textloom.plans import presets
from textloom.plans.pipeline import Padding, TextPipeline, Truncation
from textloom.plans.visualize import Annotation, to_html
from textloom.sources import model_files
from textloom.streaming.decode_stream import DecodeStream

UNDERSCORE = chr(0x2581)


@pytest.mark.parametrize(
    "splitter, text, expected",
    [
        (S.Whitespace(), "two cats, one", [("two", 0, 3), ("cats", 4, 8), (",", 8, 9), ("one", 10, 13)]),
        (S.Whitespace(), " \t ", []),
        (S.WhitespaceSplit(), "no, wait", [("no,", 0, 3), ("wait", 4, 8)]),
        (S.BertSplitter(), "so?!  yes", [("so", 0, 2), ("?", 2, 3), ("!", 3, 4), ("yes", 6, 9)]),
        (S.Punctuation(), "red; blue", [("red", 0, 3), (";", 3, 4), (" blue", 4, 9)]),
        (S.Digits(), "row 27b", [("row ", 0, 4), ("27", 4, 6), ("b", 6, 7)]),
        (S.Digits(True), "a12", [("a", 0, 1), ("1", 1, 2), ("2", 2, 3)]),
        (S.FixedLength(4), "snowfall 7", [("snow", 0, 4), ("fall", 4, 8), (" 7", 8, 10)]),
        (S.Metaspace(), "my tea", [(UNDERSCORE + "my", 0, 2), (UNDERSCORE + "tea", 2, 6)]),
        (S.ByteLevel(False), "see é\nit", [("see", 0, 3), ("ĠÃ©", 3, 5), ("Ċ", 5, 6), ("it", 6, 8)]),
        (S.UnicodeScripts(), "  ok ひと 人 да", [("ok ", 2, 5), ("ひと 人 ", 5, 10), ("да", 10, 12)]),
        (S.UnicodeScripts(), " ", []),
        (S.SplitterSequence((S.Whitespace(), S.Digits(True))), "Dial 42.", [("Dial", 0, 4), ("4", 5, 6), ("2", 6, 7), (".", 7, 8)]),
        (S.CharDelimiterSplit("-"), "a--b", [("a", 0, 1), ("b", 3, 4)]),
    ],
)
def test_splitters(splitter, text, expected):
    assert [(p, *o) for p, o in splitter.pre_tokenize_str(text)] == expected
    assert S.splitter_from_json(json.loads(json.dumps(S.splitter_to_json(splitter)))) == splitter


@pytest.mark.parametrize(
    "behavior, expected",
    [
        ("removed", ["ant", "bee", "cow"]),
        ("isolated", ["ant", "+", "+", "bee", "+", "cow", "+"]),
        ("merged_with_previous", ["ant+", "+", "bee+", "cow+"]),
        ("merged_with_next", ["ant", "+", "+bee", "+cow", "+"]),
        ("contiguous", ["ant", "++", "bee", "+", "cow", "+"]),
    ],
)
def test_behaviors(behavior, expected):
    assert [p for p, _ in S.Split(Pattern("+"), behavior).pre_tokenize_str("ant++bee+cow+")] == expected


@pytest.mark.parametrize(
    "normalizer, text, expected",
    [
        (N.NormalizerSequence((N.UnicodeForm("NFD"), N.StripAccents())), "Çà et là, ñandú", "Ca et la, nandu"),
        (N.UnicodeForm("NFKC"), "ﬁ", "fi"),
        (N.Prepend(UNDERSCORE), "tea", UNDERSCORE + "tea"),
        (N.Prepend(UNDERSCORE), "", ""),
        (N.Replace(Pattern("--"), "-"), "one--two---three", "one-two--three"),
        (N.Replace(Pattern(r"[0-9]+", True), "#"), "7 of 365 days", "# of # days"),
        (N.ByteChars(), "où va", "oÃ¹Ġva"),
        (N.Lowercase(), "ΟΔΥΣΣΕΎΣ", "οδυσσεύσ"),
        (N.Strip(), "  a b \n", "a b"),
        (N.BertNormalizer(), "H\u0000éllo\t我", "hello  我 "),
        (N.Nmt(), "a\u0001b​c", "ab c"),
    ],
)
def test_normalizers(normalizer, text, expected):
    assert normalizer.normalize_str(text) == expected
    assert N.normalizer_from_json(json.loads(json.dumps(N.normalizer_to_json(normalizer)))) == normalizer


def test_alignment():
    fi = N.UnicodeForm("NFKC").align(Aligned("aﬁb"))
    assert fi.text == "afib" and fi.spans == [(0, 1), (1, 2), (1, 2), (2, 3)]
    assert N.Prepend("__").align(Aligned("ab")).spans == [(0, 1), (0, 1), (0, 1), (1, 2)]
    composed = N.UnicodeForm("NFC").align(Aligned("éx"))
    assert composed.text == "éx" and composed.spans == [(0, 1), (2, 3)]
    assert composed.to_original(1, 2) == (2, 3) and composed.to_normalized(2, 3) == (1, 2)
    assert Aligned("ab").append("!").spans == [(0, 1), (1, 2), (1, 2)] and Aligned("ab").clear().text == ""
    with pytest.raises(ValueError):
        N.normalizer_from_name("nfx")
    assert N.normalizer_from_name("nfd") == N.UnicodeForm("NFD")


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60), st.sampled_from([b for b in BEHAVIORS if b != "removed"]))
def test_pieces_tile_the_text(text, behavior):
    pieces = S.Punctuation(behavior).pre_tokenize_str(text)
    assert "".join(p for p, _ in pieces) == text
    assert [o[0] for _, o in pieces] == sorted(o[0] for _, o in pieces)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_offsets_lie_within_the_text(text):
    aligned = N.BertNormalizer().align(Aligned(text))
    assert all(0 <= a <= b <= len(text) for a, b in aligned.all_spans())
    data = bytes(byte_of()[c] for c in to_byte_chars(text))
    assert data.decode() == text and len(byte_alphabet()) == 256


def test_bpe():
    vocab = {t: i for i, t in enumerate(["s", "t", "a", "r", "st", "sta", "star", "start"])}
    model = Bpe(vocab, (("s", "t"), ("st", "a"), ("sta", "r"), ("star", "t")))
    assert [t.id for t in model.tokenize("start")] == [7]
    assert [t.id for t in Bpe(vocab, ()).tokenize("start")] == [0, 1, 2, 3, 1]
    assert [t.id for t in Bpe(vocab, model.merges, dropout=1.0).tokenize("start")] == [0, 1, 2, 3, 1]
    assert [t.id for t in Bpe(vocab, (), ignore_merges=True).tokenize("start")] == [7]
    small = {"<unk>": 0, "a": 1, "b": 2}
    assert [(t.id, t.start, t.end) for t in Bpe(small, (), unk_token="<unk>").tokenize("accb")] == [(1, 0, 1), (0, 1, 2), (0, 2, 3), (2, 3, 4)]
    assert [(t.id, t.start, t.end) for t in Bpe(small, (), unk_token="<unk>", fuse_unk=True).tokenize("accb")] == [(1, 0, 1), (0, 1, 3), (2, 3, 4)]
    assert [t.id for t in Bpe(small, ()).tokenize("acb")] == [1, 2]
    fallback = Bpe({"<unk>": 0, "<0xC3>": 1, "<0xA9>": 2}, (), unk_token="<unk>", byte_fallback=True)
    assert [t.id for t in fallback.tokenize("é")] == [1, 2] and [t.id for t in fallback.tokenize("x")] == [0]
    assert wordpiece_from_bpe(Bpe(small, (), unk_token="<unk>")).unk_token == "<unk>"
    with pytest.raises(ValueError):
        Bpe(small, (("a", "b"),))
    with pytest.raises(ValueError):
        Bpe(small, (), dropout=2.0)


def test_word_models():
    pieces = WordPiece({t: i for i, t in enumerate(["[UNK]", "un", "##aff", "##able"])})
    assert [t.value for t in pieces.tokenize("unaffable")] == ["un", "##aff", "##able"]
    assert [t.value for t in pieces.tokenize("unaffably")] == ["[UNK]"] and [t.id for t in pieces.tokenize("u" * 101)] == [0]
    assert [t.id for t in WordLevel({"<unk>": 0, "a": 1}).tokenize("b")] == [0]
    with pytest.raises(ValueError):
        WordLevel({"a": 1}).tokenize("b")


UNIGRAM = Unigram((("<unk>", 0.0), ("a", 0.0), ("b", 0.0), ("c", 0.0), ("d", 0.0), ("cd", 1.0), ("ab", 2.0), ("abc", 5.0), ("abcd", 10.0)), 0)


def test_unigram():
    assert [t.value for t in UNIGRAM.tokenize("abcdacdxx")] == ["abcd", "a", "cd", "xx"]
    best = UNIGRAM.nbest("abcd", 3)
    assert [s for s, _ in best] == [10.0, 5.0, 3.0]
    counts, likelihood = UNIGRAM.marginals("ab")
    assert math.isclose(likelihood, math.log(math.exp(2) + 1)) and math.isclose(counts[6], math.exp(2) / (math.exp(2) + 1))
    rng = random.Random(1)
    seen = Counter(len(UNIGRAM.sample("ab", 1.0, rng)) for _ in range(4000))
    assert abs(seen[1] / 4000 - math.exp(2) / (math.exp(2) + 1)) < 0.03
    fallback = Unigram((("<unk>", 0.0), ("<0xC3>", 0.0), ("<0xA9>", 0.0)), 0, byte_fallback=True)
    assert [t.value for t in fallback.tokenize("é")] == ["<0xC3>", "<0xA9>"]


@pytest.mark.parametrize(
    "decoder, tokens, expected",
    [
        (D.WordPieceDecoder(cleanup=False), ["##bar", "Wind", "##müh", "##le", "am", "##rum"], "##bar Windmühle amrum"),
        (D.CtcDecoder(), "<pad> b b e <pad> e t t <pad> <pad> | o o".split(), "beet o"),
        (D.BpeDecoder(), ["win", "ter</w>", "sun</w>"], "winter sun"),
        (D.MetaspaceDecoder(), [UNDERSCORE + "one", UNDERSCORE + "cup"], "one cup"),
        (D.ByteFallbackDecoder(), ["a", "<0xC3>", "<0xA9>", "<0xFF>", "b"], "a" + chr(0xFFFD) * 3 + "b"),
        (D.ByteFallbackDecoder(), ["<0xC3>", "<0xA9>"], "é"),
        (D.ReplaceDecoder(Pattern("_"), " "), ["tick", "_tock"], "tick tock"),
        (D.StripDecoder("x", 1, 0), ["xab", "xxc"], "abxc"),
        (D.StripDecoder("x", 0, 2), ["abxxx", "x"], "abx"),
        (D.DecoderSequence((D.Fuse(), D.StripDecoder(" ", 1, 0))), [" a", " b"], "a b"),
        (D.ByteLevelDecoder(), ["nÃ", "©", "Ġ中"], "né" + "Ġ中"),
    ],
)
def test_decoders(spark, decoder, tokens, expected):
    assert "".join(decoder.chain_local(tokens)) == expected
    df = spark.createDataFrame([(tokens,), ([],), (None,)], "t array<string>")
    found = [r[0] for r in df.select(decoder.decode(df["t"])).collect()]
    assert found[0] == expected and not found[1]
    assert D.decoder_from_json(json.loads(json.dumps(D.decoder_to_json(decoder)))) == decoder


def test_added_tokens():
    model = WordLevel({"red": 0, "fox": 1})
    known = AddedVocabulary().add([AddedToken("fox"), AddedToken("red"), special_token("<a>"), special_token("<b>"), ""], model)
    assert known.ids == {"fox": 1, "red": 0, "<a>": 2, "<b>": 3} and known.special_ids == {2, 3}
    pipe = TextPipeline(WordLevel({"<unk>": 9, "red": 0}), N.Lowercase(), S.WhitespaceSplit()).with_added_tokens([AddedToken("<x>", single_word=True, lstrip=True, normalized=False, special=True)])
    mark = pipe.token_to_id("<x>")
    found = pipe.tokens_of("<x> Red dog <x> R<x> y")
    assert [i for i, *_ in found] == [mark, 0, 9, mark, 9, 9]
    assert found[3][3:] == (11, 15)  # with the space before it


def test_merges_with_dropout_follow_their_chances():
    vocab = {"a": 0, "b": 1, "ab": 2, "abab": 3}
    model, plain = Bpe(vocab, (("a", "b"), ("ab", "ab")), dropout=0.5), Bpe(vocab, (("a", "b"), ("ab", "ab")))
    assert [t.id for t in plain.tokenize("abab")] == [3]
    # the one pair of "ab" is merged half of the time
    seen = Counter(len(model.tokenize("ab")) for _ in range(4000))
    assert abs(seen[1] / 4000 - 0.5) < 0.04
    assert {"".join(t.value for t in model.tokenize("abab")) for _ in range(50)} == {"abab"}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=14), st.permutations([("a", "b"), ("b", "c"), ("ab", "c"), ("c", "a"), ("a", "bc"), ("abc", "abc"), ("ca", "b")]))
def test_rounds_of_merges_equal_one_merge_at_a_time(word, merges):
    tokens = ["a", "b", "c", *dict.fromkeys(x + y for x, y in merges)]
    model = Bpe({t: i for i, t in enumerate(tokens)}, tuple(merges))
    parts = list(word)
    while pairs := [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]:
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert [t.value for t in model.tokenize(word)] == parts


def test_template_parts():
    assert parse_piece("$") == Piece("A", 0) and parse_piece("$B:2") == Piece("B", 2) and parse_piece("$1") == Piece("A", 1) and parse_piece("[CLS]:0") == Piece("[CLS]", 0, True)
    for bad in ("$C:1", "$A:"):
        with pytest.raises(ValueError):
            parse_piece(bad)
    with pytest.raises(ValueError):
        template("[CLS] $A")
    assert template("[CLS] $A [SEP]", "[CLS] $A [SEP] $B:1 [SEP]:1", {"[CLS]": 1, "[SEP]": 0}).added(True) == 3


def test_pipeline_json_and_files(tmp_path):
    vocab = {t: i for i, t in enumerate("[PAD] [UNK] [CLS] [SEP] a b".split())}
    pipes = [
        presets.bert_word_piece(WordPiece(vocab)).with_(truncation=Truncation(8), padding=Padding(12)),
        presets.byte_level_bpe(Bpe({"a": 0, "b": 1, "ab": 2}, (("a", "b"),))),
        presets.char_bpe(), presets.sentencepiece_bpe(), presets.sentencepiece_unigram(UNIGRAM),
    ]
    for k, pipe in enumerate(pipes):
        model_files.save_pipeline(pipe, str(tmp_path / f"{k}.json"))
        again = model_files.load_pipeline(str(tmp_path / f"{k}.json"))
        assert again.to_json() == pipe.to_json()
    with pytest.raises(ValueError):
        TextPipeline.from_json('{"version": "2.0"}')
    files = model_files.save_model(pipes[1].model, str(tmp_path), "x")
    assert model_files.read_bpe(*files).merges == (("a", "b"),)
    assert model_files.read_wordpiece(model_files.save_model(WordPiece(vocab), str(tmp_path))[0]).vocab == vocab
    assert model_files.read_unigram(model_files.save_model(UNIGRAM, str(tmp_path))[0]).pieces == UNIGRAM.pieces
    (tmp_path / "org" / "name").mkdir(parents=True)
    model_files.save_pipeline(pipes[1], str(tmp_path / "org" / "name" / "tokenizer.json"))
    assert model_files.load_named("org/name", str(tmp_path)).model.vocab == pipes[1].model.vocab
    for bad in ("../x", "a/b/c", "a b"):
        with pytest.raises(ValueError):
            model_files.load_named(bad, str(tmp_path))
    with pytest.warns(UserWarning):
        list(model_files.ordered_vocab({"a": 0, "b": 2}))


def test_decode_stream():
    model = WordLevel({"<0x41>": 0, "<0xE2>": 1, "<0x82>": 2, "<0xAC>": 3, " due": 4})
    stream = DecodeStream(TextPipeline(model, decoder=D.ByteFallbackDecoder()))
    assert [stream.step(i) for i in (0, 1, 2, 3, 4)] == ["A", None, None, "€", " due"]
    stream = DecodeStream(TextPipeline(WordLevel({UNDERSCORE + "go": 0}), decoder=D.MetaspaceDecoder()))
    assert [stream.step(0), stream.step(0)] == ["go", " go"]


def test_html():
    pipe = TextPipeline(WordLevel({"<unk>": 0, "a": 1}), splitter=S.WhitespaceSplit())
    page = to_html(pipe, "a <b>", [Annotation(0, 1, "first")])
    assert "&lt;b&gt;" in page and 'title="first"' in page and "unknown" in page
