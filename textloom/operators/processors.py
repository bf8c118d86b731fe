"""Post-processors: what is done to the encodings of one sequence or a pair before they become one."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column

from textloom.operators import encodings as E
from textloom.operators.encodings import Piece, Template


class Processor:
    def prepare(self, encoding: Column) -> Column:
        return encoding

    def combine(self, first: Column, second: Column | None, add_special_tokens: bool) -> Column:
        """One after the other; the second's type is 1."""
        return E.sequence(first, 0, 0) if second is None else E.concat([E.sequence(first, 0, 0), E.sequence(second, 1, 1)])

    def added_tokens(self, is_pair: bool) -> int:
        return 0

    def apply(self, first: Column, second: Column | None = None, add_special_tokens: bool = True) -> Column:
        return self.combine(self.prepare(first), None if second is None else self.prepare(second), add_special_tokens)


@dataclass(frozen=True)
class TemplateProcessor(Processor):
    template: Template

    def combine(self, first: Column, second: Column | None, add_special_tokens: bool) -> Column:
        return self.template.apply(first, second, add_special_tokens)

    def added_tokens(self, is_pair: bool) -> int:
        return self.template.added(is_pair)


@dataclass(frozen=True)
class BertProcessor(Processor):
    sep: tuple[str, int] = ("[SEP]", 102)
    cls: tuple[str, int] = ("[CLS]", 101)

    def combine(self, first: Column, second: Column | None, add_special_tokens: bool) -> Column:
        return E.bert_template(self.sep, self.cls).apply(first, second, add_special_tokens)

    def added_tokens(self, is_pair: bool) -> int:
        return 3 if is_pair else 2


@dataclass(frozen=True)
class RobertaProcessor(Processor):
    sep: tuple[str, int] = ("</s>", 2)
    cls: tuple[str, int] = ("<s>", 0)
    trim_offsets: bool = True
    add_prefix_space: bool = True

    def prepare(self, encoding: Column) -> Column:
        return E.trim_offsets(encoding, self.add_prefix_space) if self.trim_offsets else encoding

    def combine(self, first: Column, second: Column | None, add_special_tokens: bool) -> Column:
        return E.roberta_template(self.sep, self.cls).apply(first, second, add_special_tokens)

    def added_tokens(self, is_pair: bool) -> int:
        return 4 if is_pair else 2


@dataclass(frozen=True)
class ByteLevelProcessor(Processor):
    trim_offsets: bool = True
    add_prefix_space: bool = True
    use_regex: bool = True

    def prepare(self, encoding: Column) -> Column:
        return E.trim_offsets(encoding, self.add_prefix_space) if self.trim_offsets else encoding


@dataclass(frozen=True)
class ProcessorSequence(Processor):
    """Each in turn prepares; the last that adds tokens combines."""

    processors: tuple[Processor, ...]

    def prepare(self, encoding: Column) -> Column:
        return reduce(lambda e, p: p.prepare(e), self.processors, encoding)

    def combine(self, first: Column, second: Column | None, add_special_tokens: bool) -> Column:
        adding = [p for p in self.processors if p.added_tokens(False)] or [Processor()]
        return adding[-1].combine(first, second, add_special_tokens)

    def added_tokens(self, is_pair: bool) -> int:
        return sum(p.added_tokens(is_pair) for p in self.processors)


def _piece_to_json(p: Piece) -> dict:
    return {"SpecialToken" if p.special else "Sequence": {"id": p.what, "type_id": p.type_id}}


def _piece_from_json(j: dict) -> Piece:
    (kind, rest), = j.items()
    return Piece(rest["id"], rest["type_id"], kind == "SpecialToken")


def processor_to_json(p: Processor | None) -> dict | None:
    match p:
        case None:
            return None
        case TemplateProcessor(t):
            specials = {name: {"id": name, "ids": list(ids), "tokens": list(tokens)} for name, ids, tokens in t.special_tokens}
            return {"type": "TemplateProcessing", "single": [*map(_piece_to_json, t.single)], "pair": [*map(_piece_to_json, t.pair)], "special_tokens": specials}
        case BertProcessor(sep, cls):
            return {"type": "BertProcessing", "sep": list(sep), "cls": list(cls)}
        case RobertaProcessor():
            return {"type": "RobertaProcessing", "sep": list(p.sep), "cls": list(p.cls), "trim_offsets": p.trim_offsets, "add_prefix_space": p.add_prefix_space}
        case ByteLevelProcessor():
            return {"type": "ByteLevel", **vars(p)}
        case ProcessorSequence(parts):
            return {"type": "Sequence", "processors": [*map(processor_to_json, parts)]}
    raise ValueError("a custom post-processor cannot be saved")


def processor_from_json(j: dict | None) -> Processor | None:
    if j is None:
        return None
    match j["type"]:
        case "TemplateProcessing":
            specials = tuple((name, tuple(s["ids"]), tuple(s["tokens"])) for name, s in j["special_tokens"].items())
            return TemplateProcessor(Template(tuple(map(_piece_from_json, j["single"])), tuple(map(_piece_from_json, j["pair"])), specials))
        case "BertProcessing":
            return BertProcessor(tuple(j["sep"]), tuple(j["cls"]))
        case "RobertaProcessing":
            return RobertaProcessor(tuple(j["sep"]), tuple(j["cls"]), j.get("trim_offsets", True), j.get("add_prefix_space", True))
        case "ByteLevel":
            return ByteLevelProcessor(j.get("trim_offsets", True), j.get("add_prefix_space", True), j.get("use_regex", True))
        case "Sequence":
            return ProcessorSequence(tuple(map(processor_from_json, j["processors"])))
    raise ValueError(f"unknown post-processor {j['type']}")
