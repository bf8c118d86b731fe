"""One encoded text as HTML, for looking at tokens and annotations."""

from __future__ import annotations

import html
from dataclasses import dataclass

from textloom.plans.pipeline import TextPipeline


@dataclass(frozen=True)
class Annotation:
    start: int
    end: int
    label: str


_STYLE = ".token{border-radius:3px;margin:1px}.even{background:#dbe9f6}.odd{background:#f6e8db}.annotation{border-bottom:2px solid #456}.unknown{background:#eaa}"


def to_html(pipeline: TextPipeline, text: str, annotations: list[Annotation] | None = None) -> str:
    """Tokens in alternating colours, with ids as titles; annotated parts are underlined and named."""
    token_at: dict[int, int] = {}
    tokens = pipeline.tokens_of(text)
    for k, (_, _, _, start, end) in enumerate(tokens):
        token_at |= dict.fromkeys(range(start, end), k)
    label_at = {i: a.label for a in annotations or [] for i in range(a.start, a.end)}
    unk = getattr(pipeline.model, "unk_token", None)
    spans, at = [], 0
    while at < len(text):
        key, stop = (token_at.get(at), label_at.get(at)), at
        while stop < len(text) and (token_at.get(stop), label_at.get(stop)) == key:
            stop += 1
        part = html.escape(text[at:stop])
        if key[0] is not None:
            i, token, *_ = tokens[key[0]]
            kind = "unknown" if token == unk else "odd" if key[0] % 2 else "even"
            part = f'<span class="token {kind}" title="{html.escape(token)} {i}">{part}</span>'
        if key[1] is not None:
            part = f'<span class="annotation" title="{html.escape(key[1])}">{part}</span>'
        spans.append(part)
        at = stop
    return f"<html><head><style>{_STYLE}</style></head><body><pre>{''.join(spans)}</pre></body></html>"
