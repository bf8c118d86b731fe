"""Pipelines of the usual kinds, from a model or before training."""

from __future__ import annotations

from textloom.functions.normalizers import BertNormalizer, Lowercase, Normalizer, NormalizerSequence, Nmt, Replace, UnicodeForm
from textloom.functions.patterns import Pattern
from textloom.functions.splitters import BertSplitter, ByteLevel, Metaspace, SplitterSequence, WhitespaceSplit
from textloom.operators.decoders import BpeDecoder, ByteLevelDecoder, MetaspaceDecoder, WordPieceDecoder
from textloom.operators.models import Bpe, Unigram, WordPiece
from textloom.operators.processors import BertProcessor, ByteLevelProcessor
from textloom.plans.pipeline import TextPipeline


def _sequence(parts: list[Normalizer]) -> Normalizer | None:
    return None if not parts else parts[0] if len(parts) == 1 else NormalizerSequence(tuple(parts))


def bert_word_piece(model: WordPiece | None = None, lowercase: bool = True, strip_accents: bool | None = None, clean_text: bool = True, handle_chinese_chars: bool = True, cls: str = "[CLS]", sep: str = "[SEP]", prefix: str = "##") -> TextPipeline:
    model = model or WordPiece({"[UNK]": 0})
    pipe = TextPipeline(model, BertNormalizer(clean_text, handle_chinese_chars, strip_accents, lowercase), BertSplitter(), None, WordPieceDecoder(prefix))
    known = [t for t in (model.unk_token, sep, cls, "[PAD]", "[MASK]") if t in model.vocab]
    pipe = pipe.with_special_tokens(known)
    if cls in model.vocab and sep in model.vocab:
        pipe = pipe.with_(processor=BertProcessor((sep, model.vocab[sep]), (cls, model.vocab[cls])))
    return pipe


def byte_level_bpe(model: Bpe | None = None, add_prefix_space: bool = False, lowercase: bool = False, unicode_normalizer: str | None = None, trim_offsets: bool = False) -> TextPipeline:
    parts = ([UnicodeForm(unicode_normalizer.upper())] if unicode_normalizer else []) + ([Lowercase()] if lowercase else [])
    return TextPipeline(model or Bpe({}, ()), _sequence(parts), ByteLevel(add_prefix_space), ByteLevelProcessor(trim_offsets), ByteLevelDecoder())


def char_bpe(model: Bpe | None = None, lowercase: bool = False, unicode_normalizer: str | None = None, bert_normalizer: bool = True, split_on_whitespace_only: bool = False, suffix: str = "</w>") -> TextPipeline:
    parts = ([UnicodeForm(unicode_normalizer.upper())] if unicode_normalizer else []) + ([BertNormalizer(lowercase=False)] if bert_normalizer else []) + ([Lowercase()] if lowercase else [])
    return TextPipeline(model or Bpe({}, (), end_of_word_suffix=suffix), _sequence(parts), WhitespaceSplit() if split_on_whitespace_only else BertSplitter(), None, BpeDecoder(suffix))


def sentencepiece_bpe(model: Bpe | None = None, replacement: str = chr(0x2581), add_prefix_space: bool = True) -> TextPipeline:
    scheme = "always" if add_prefix_space else "never"
    return TextPipeline(model or Bpe({}, (), fuse_unk=True), UnicodeForm("NFKC"), Metaspace(replacement, scheme), None, MetaspaceDecoder(replacement, scheme))


def sentencepiece_unigram(model: Unigram | None = None, replacement: str = chr(0x2581), add_prefix_space: bool = True) -> TextPipeline:
    scheme = "always" if add_prefix_space else "never"
    normalizer = NormalizerSequence((Nmt(), UnicodeForm("NFKC"), Replace(Pattern(" {2,}", True), " ")))
    return TextPipeline(model or Unigram(()), normalizer, SplitterSequence((Metaspace(replacement, scheme),)), None, MetaspaceDecoder(replacement, scheme))
