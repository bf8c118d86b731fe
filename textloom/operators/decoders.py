"""Decoders: an array of tokens to text.  Each is a function on columns; a chain applies them in order.

Decoders that work on bytes run batch by batch in Python, the others in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.chars import byte_of, quoted
from textloom.functions.patterns import Pattern, pattern_from_json
from textloom.operators.encodings import bound

#: What clean-up replaces, in order (fixed values).
CLEANUP = ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" do not", " don't"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"))


def cleaned(text: Column) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), CLEANUP, text)


class Decoder:
    def chain(self, tokens: Column) -> Column:
        """The tokens as texts to be joined."""
        one = self.chain_local

        @F.pandas_udf("array<string>")
        def decoded(batch: pd.Series) -> pd.Series:
            return batch.map(lambda t: None if t is None else one(list(t)))

        return decoded(tokens)

    def chain_local(self, tokens: list[str]) -> list[str]:
        raise NotImplementedError

    def decode(self, tokens: Column) -> Column:
        return F.array_join(self.chain(tokens), "")

    def of_ids(self, names: dict[int, str]) -> Callable[[list[int]], str]:
        """Ids to text in one step; ids without a name are left out."""
        return lambda ids: "".join(self.chain_local([names[i] for i in ids if i in names]))

    def of_lists(self, names: dict[int, str]) -> Callable[[pa.ListArray], list[str | None]]:
        """Arrays of ids to texts."""
        one = self.of_ids(names)
        return lambda rows: [None if r is None else one(r) for r in rows.to_pylist()]


@dataclass(frozen=True)
class BpeDecoder(Decoder):
    suffix: str = "</w>"

    def chain(self, tokens: Column) -> Column:
        spaced = lambda all_tokens: F.transform(all_tokens, lambda t, i: F.replace(t, F.lit(self.suffix), F.when(i == F.size(all_tokens) - 1, "").otherwise(" ")))
        return bound(tokens, spaced)

    def chain_local(self, tokens: list[str]) -> list[str]:
        return [t.replace(self.suffix, " " if i < len(tokens) - 1 else "") for i, t in enumerate(tokens)]


def _token_bytes(token: str) -> bytes:
    """The bytes that printable characters stand for; a token with any other character stands for itself."""
    table = byte_of()
    return bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()


#: How many times as many ids as names a table by id may have.
DENSE = 16


@dataclass(frozen=True)
class ByteLevelDecoder(Decoder):
    """Printable characters back to bytes; what is no UTF-8 becomes U+FFFD."""

    def chain_local(self, tokens: list[str]) -> list[str]:
        return [b"".join(map(_token_bytes, tokens)).decode(errors="replace")]

    def of_ids(self, names: dict[int, str]) -> Callable[[list[int]], str]:
        known = {i: _token_bytes(t) for i, t in names.items()}
        return lambda ids: b"".join([known[i] for i in ids if i in known]).decode(errors="replace")

    def of_lists(self, names: dict[int, str]) -> Callable[[pa.ListArray], list[str | None]]:
        if not names or min(names) < 0 or max(names) > DENSE * len(names):
            return super().of_lists(names)
        top = max(names) + 1
        # ids without a name have no bytes
        parts = [_token_bytes(names[i]) if i in names else b"" for i in range(top + 1)]
        sizes = np.array([len(p) for p in parts])
        begins, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(parts), np.uint8)

        def texts(rows: pa.ListArray) -> list[str | None]:
            ids = pc.fill_null(rows.flatten(), -1).to_numpy(zero_copy_only=False)
            ids = np.where((ids >= 0) & (ids < top), ids, top)
            n = sizes[ids]
            ends = np.r_[0, np.cumsum(n)]
            whole = data[np.arange(ends[-1]) + np.repeat(begins[ids] - ends[:-1], n)].tobytes()
            cuts = ends[np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))]].tolist()
            return [whole[a:b].decode(errors="replace") if there else None for a, b, there in zip(cuts, cuts[1:], rows.is_valid().to_pylist())]

        return texts


@dataclass(frozen=True)
class WordPieceDecoder(Decoder):
    prefix: str = "##"
    cleanup: bool = True

    def chain(self, tokens: Column) -> Column:
        p = self.prefix
        spaced = F.transform(tokens, lambda t, i: F.when(i == 0, t).when(t.startswith(p), F.substring(t, len(p) + 1, 1 << 30)).otherwise(F.concat(F.lit(" "), t)))
        return F.transform(spaced, cleaned) if self.cleanup else spaced

    def chain_local(self, tokens: list[str]) -> list[str]:
        out = [t if not i else t[len(self.prefix) :] if t.startswith(self.prefix) else " " + t for i, t in enumerate(tokens)]
        return [_cleaned(t) for t in out] if self.cleanup else out


def _cleaned(text: str) -> str:
    return reduce(lambda t, pair: t.replace(*pair), CLEANUP, text)


@dataclass(frozen=True)
class MetaspaceDecoder(Decoder):
    replacement: str = chr(0x2581)
    prepend_scheme: str = "always"
    split: bool = True

    def chain(self, tokens: Column) -> Column:
        first = " " if self.prepend_scheme == "never" else ""
        return F.transform(tokens, lambda t, i: F.replace(t, F.lit(self.replacement), F.when(i == 0, first).otherwise(" ")))

    def chain_local(self, tokens: list[str]) -> list[str]:
        first = " " if self.prepend_scheme == "never" else ""
        return [t.replace(self.replacement, " " if i else first) for i, t in enumerate(tokens)]


@dataclass(frozen=True)
class CtcDecoder(Decoder):
    pad_token: str = "<pad>"
    word_delimiter_token: str = "|"
    cleanup: bool = True

    def chain(self, tokens: Column) -> Column:
        kept = bound(tokens, lambda all_tokens: F.filter(all_tokens, lambda t, i: (i == 0) | (t != F.get(all_tokens, i - 1))))
        bare = F.transform(kept, lambda t: F.replace(t, F.lit(self.pad_token), F.lit("")))
        if self.cleanup:
            bare = F.transform(bare, lambda t: F.replace(cleaned(t), F.lit(self.word_delimiter_token), F.lit(" ")))
        return F.filter(bare, lambda t: t != "")

    def chain_local(self, tokens: list[str]) -> list[str]:
        out = [t.replace(self.pad_token, "") for i, t in enumerate(tokens) if not i or t != tokens[i - 1]]
        return [t for t in ((_cleaned(t).replace(self.word_delimiter_token, " ") if self.cleanup else t) for t in out) if t]


_BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


@dataclass(frozen=True)
class ByteFallbackDecoder(Decoder):
    """Runs of byte tokens become text, or one U+FFFD per byte if they are no UTF-8."""

    def chain_local(self, tokens: list[str]) -> list[str]:
        out, run = [], bytearray()

        def flush() -> None:
            if run:
                try:
                    out.append(run.decode())
                except UnicodeDecodeError:
                    out.extend([chr(0xFFFD)] * len(run))
                run.clear()

        for t in tokens:
            if found := _BYTE.fullmatch(t):
                run.append(int(found[1], 16))
            else:
                flush()
                out.append(t)
        flush()
        return out


@dataclass(frozen=True)
class Fuse(Decoder):
    def chain(self, tokens: Column) -> Column:
        return F.array(F.array_join(tokens, ""))

    def chain_local(self, tokens: list[str]) -> list[str]:
        return ["".join(tokens)]


@dataclass(frozen=True)
class StripDecoder(Decoder):
    """Up to ``start`` and ``stop`` copies of a character off each token's ends."""

    content: str = " "
    start: int = 0
    stop: int = 0

    def chain(self, tokens: Column) -> Column:
        c = quoted(self.content)
        return F.transform(tokens, lambda t: F.regexp_replace(F.regexp_replace(t, rf"^(?:{c}){{0,{self.start}}}", ""), rf"(?:{c}){{1,{self.stop}}}\z" if self.stop else r"(?!)", ""))

    def chain_local(self, tokens: list[str]) -> list[str]:
        out = []
        for t in tokens:
            left = next((i for i in range(self.start) if t[i : i + 1] != self.content), self.start)
            t = t[left:]
            right = next((i for i in range(self.stop) if t[len(t) - 1 - i : len(t) - i] != self.content), self.stop)
            out.append(t[: len(t) - right])
        return out


@dataclass(frozen=True)
class ReplaceDecoder(Decoder):
    pattern: Pattern
    content: str

    def chain(self, tokens: Column) -> Column:
        content = self.content.replace("\\", "\\\\").replace("$", "\\$")
        return F.transform(tokens, lambda t: F.regexp_replace(t, self.pattern.java, content))

    def chain_local(self, tokens: list[str]) -> list[str]:
        return [self.pattern.python.sub(lambda m: self.content, t) for t in tokens]


@dataclass(frozen=True)
class DecoderSequence(Decoder):
    decoders: tuple[Decoder, ...]

    def chain(self, tokens: Column) -> Column:
        return reduce(lambda t, d: d.chain(t), self.decoders, tokens)

    def chain_local(self, tokens: list[str]) -> list[str]:
        return reduce(lambda t, d: d.chain_local(t), self.decoders, tokens)


@dataclass(frozen=True)
class CustomDecoder(Decoder):
    function: Callable[[list[str]], list[str]] = field(compare=False)

    def chain_local(self, tokens: list[str]) -> list[str]:
        return self.function(tokens)


_JSON = {
    "BPEDecoder": BpeDecoder, "ByteLevel": ByteLevelDecoder, "WordPiece": WordPieceDecoder, "Metaspace": MetaspaceDecoder, "CTC": CtcDecoder,
    "ByteFallback": ByteFallbackDecoder, "Fuse": Fuse, "Strip": StripDecoder, "Replace": ReplaceDecoder,
}


def decoder_to_json(d: Decoder | None) -> dict | None:
    match d:
        case None:
            return None
        case DecoderSequence(parts):
            return {"type": "Sequence", "decoders": [decoder_to_json(p) for p in parts]}
        case CustomDecoder():
            raise ValueError("a custom decoder cannot be saved")
    out = {"type": next(k for k, v in _JSON.items() if v is type(d)), **{k: getattr(d, k) for k in d.__dataclass_fields__}}
    if "pattern" in out:
        out["pattern"] = out["pattern"].to_json()
    return out


def decoder_from_json(j: dict | None) -> Decoder | None:
    if j is None:
        return None
    if j["type"] == "Sequence":
        return DecoderSequence(tuple(decoder_from_json(p) for p in j["decoders"]))
    if j["type"] not in _JSON:
        raise ValueError(f"unknown decoder {j['type']}")
    cls = _JSON[j["type"]]
    rest = {k: v for k, v in j.items() if k in cls.__dataclass_fields__}
    if "pattern" in rest:
        rest["pattern"] = pattern_from_json(rest["pattern"])
    return cls(**rest)
