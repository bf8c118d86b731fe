"""Vocabulary and pipeline files.  They are small, of the size of a vocabulary, and are read and written by the driver."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Iterator
from pathlib import Path

from textloom.operators.models import Bpe, Unigram, WordLevel, WordPiece
from textloom.plans.pipeline import TextPipeline, model_to_json


def load_pipeline(path: str) -> TextPipeline:
    return TextPipeline.from_json(Path(path).read_text())


def save_pipeline(pipeline: TextPipeline, path: str, pretty: bool = True) -> None:
    Path(path).write_text(pipeline.to_json(pretty))


def load_named(name: str, folder: str, revision: str = "main") -> TextPipeline:
    """A pipeline kept in a local folder by name, as ``<folder>/<name>/tokenizer.json``; other revisions lie below it."""
    if not re.fullmatch(r"[\w.-]+(?:/[\w.-]+)?", name) or not re.fullmatch(r"[\w./-]+", revision) or ".." in f"{name}/{revision}".split("/"):
        raise ValueError("a name or revision holds letters, digits, '-', '_', '.' and at most one '/'")
    at = Path(folder) / name
    return load_pipeline(str((at if revision == "main" else at / revision) / "tokenizer.json"))


def ordered_vocab(vocab: dict[str, int]) -> Iterator[tuple[str, int]]:
    """Tokens by id; a gap between ids gives a warning."""
    last = -1
    for token, i in sorted(vocab.items(), key=lambda x: x[1]):
        if i != last + 1:
            warnings.warn(f"the vocabulary has a hole between ids {last} and {i}", stacklevel=2)
        last = i
        yield token, i


def read_bpe(vocab_file: str, merges_file: str, **options) -> Bpe:
    """``vocab.json``, and ``merges.txt`` with two parts a line below an optional version line."""
    merges = []
    for k, line in enumerate(Path(merges_file).read_text().split("\n"), 1):
        if line.startswith("#version") or not line.strip():
            continue
        parts = line.split(" ")
        if len(parts) != 2:
            raise ValueError(f"line {k} of the merges does not have two parts")
        merges.append(tuple(parts))
    return Bpe(json.loads(Path(vocab_file).read_text()), tuple(merges), **options)


def read_wordpiece(vocab_file: str, **options) -> WordPiece:
    """One token a line; the line's number is the id."""
    lines = Path(vocab_file).read_text().split("\n")
    return WordPiece({t.rstrip(): i for i, t in enumerate(lines[:-1] if not lines[-1] else lines)}, **options)


def read_word_level(vocab_file: str, unk_token: str = "<unk>") -> WordLevel:
    return WordLevel(json.loads(Path(vocab_file).read_text()), unk_token)


def read_unigram(file: str) -> Unigram:
    j = json.loads(Path(file).read_text())
    return Unigram(tuple((p, s) for p, s in j["vocab"]), j.get("unk_id"), j.get("byte_fallback", False))


def save_model(model: Bpe | WordPiece | WordLevel | Unigram, folder: str, prefix: str | None = None) -> list[str]:
    """Writes a model's files and returns their paths."""
    at = lambda name: Path(folder) / (f"{prefix}-{name}" if prefix else name)
    dump = lambda j: json.dumps(j, ensure_ascii=False)
    match model:
        case Bpe():
            files = {at("vocab.json"): dump(dict(ordered_vocab(model.vocab))), at("merges.txt"): "#version: 0.2\n" + "".join(f"{a} {b}\n" for a, b in model.merges)}
        case WordPiece():
            files = {at("vocab.txt"): "".join(f"{t}\n" for t, _ in ordered_vocab(model.vocab))}
        case WordLevel():
            files = {at("vocab.json"): dump(dict(ordered_vocab(model.vocab)))}
        case Unigram():
            files = {at("unigram.json"): dump(model_to_json(model))}
    for path, text in files.items():
        path.write_text(text)
    return [str(p) for p in files]


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 0x7F) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        size = {1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            value, at = _varint(data, at)
            yield key >> 3, value
            continue
        if size is None:
            size, at = _varint(data, at)
        yield key >> 3, data[at : at + size]
        at += size


def read_sentencepiece(path: str) -> Unigram:
    """The unigram model of a SentencePiece file: pieces with scores, and the unknown piece."""
    import struct

    pieces, unk, kind = [], None, 1
    for number, value in _fields(Path(path).read_bytes()):
        if number == 1:
            parts = dict(_fields(value))
            if parts.get(3) == 2:
                unk = len(pieces)
            pieces.append((parts[1].decode(), struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0))
        elif number == 2:
            kind = dict(_fields(value)).get(3, 1)
    if kind != 1:
        raise ValueError("the file does not hold a unigram model")
    return Unigram(tuple(pieces), unk)
