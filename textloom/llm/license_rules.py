"""Ordered signature rules of licenses.

A pattern is written as words: ``x?`` is a word that may be missing, ``x|y``
are alternatives, and a word may be a regular expression.  A license has names
and versions; each version makes a rule for its identifier, and with each name
one for each form in which it is named (grant, reference, bare name).  Rules for
sentences of license texts stand beside those.  The order of forms, then of
licenses, is the priority.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

LICENSE = "licen[cs]e"

# Words of licenses' names, their versions and the sentences of their texts, as published.
#: (label, names, versions); a version is (label's end, pattern after the name).
MAJOR = {n: f"version|v? v?{n} 0?" for n in "1234"}
MINOR = {f"{a}.{b}": f"version|v? v?{a} {b}" for a, b in ("11", "12", "13", "20", "21", "25", "30", "31", "40")}


def _versions(*which: str) -> tuple[tuple[str, str], ...]:
    return (*[(f"-{v}", (MAJOR | MINOR)[v]) for v in which], ("", ""))


def _later(*which: str) -> tuple[tuple[str, str], ...]:
    """Versions that may be extended to all later ones."""
    later = "or at? your? option? any? later version?"
    return (*[(f"-{v}-or-later", f"{(MAJOR | MINOR)[v]} {later}") for v in which], *[(f"-{v}", f"{(MAJOR | MINOR)[v]} only?") for v in which], ("", ""))


_CC_PARTS = {
    "by": ("attribution",),
    "by-sa": ("attribution share alike", "attribution sharealike"),
    "by-nd": ("attribution no derivatives|derivs|derivative", "attribution noderivatives|noderivs"),
    "by-nc": ("attribution non commercial", "attribution noncommercial"),
    "by-nc-sa": ("attribution non commercial share alike", "attribution noncommercial sharealike"),
    "by-nc-nd": ("attribution non commercial no derivatives|derivs|derivative", "attribution noncommercial noderivatives|noderivs"),
}
_CC_VERSIONS = tuple((f"-{v}", f"version|v? {p} international|unported|generic? public? {LICENSE}?") for v, p in (("1", "1 0"), ("2", "2 0"), ("2.5", "2 5"), ("3", "3 0"), ("4", "4 0"))) + (("", f"{LICENSE}?"),)
FAMILIES: tuple[tuple[str, tuple[str, ...], tuple[tuple[str, str], ...]], ...] = (
    ("mit", (f"mit x11? {LICENSE}", "expat licen[cs]e"), (("", ""),)),
    ("apache", (f"apache software? {LICENSE}", f"apache software? foundation {LICENSE}", f"asf {LICENSE}"), _versions("1.1", "1", "2")),
    ("lgpl", (f"gnu? lesser general public {LICENSE}", f"gnu? library general public {LICENSE}", "gnu? lgpl"), _later("2.1", "2", "3")),
    ("agpl", (f"gnu? affero general public {LICENSE}", "gnu? agpl"), _later("1", "3")),
    ("gpl", (f"gnu? general public {LICENSE}", "gnu gpl", "gpl"), _later("1", "2", "3")),
    ("gfdl", (f"gnu? free documentation {LICENSE}", "gnu? gfdl"), _later("1.1", "1.2", "1.3")),
    ("bsd-2-clause", ("bsd 2 clause", "two|2 clause bsd", "simplified bsd", "freebsd licen[cs]e"), (("", f"{LICENSE}?"),)),
    ("bsd-3-clause", ("bsd 3 clause", "three|3 clause bsd", "new bsd licen[cs]e", "modified bsd licen[cs]e", "revised bsd licen[cs]e"), (("", f"{LICENSE}?"),)),
    ("bsd-4-clause", ("bsd 4 clause", "four|4 clause bsd", "original bsd licen[cs]e"), (("", f"{LICENSE}?"),)),
    ("bsd", (f"bsd style? {LICENSE}",), (("", ""),)),
    ("mpl", (f"mozilla public {LICENSE}",), _versions("1.1", "1", "2")),
    ("epl", (f"eclipse public {LICENSE}",), _versions("1", "2")),
    ("cddl", (f"common development and distribution {LICENSE}",), _versions("1.1", "1")),
    ("cpl", (f"common public {LICENSE}",), _versions("1")),
    ("eupl", (f"european union public {LICENSE}",), _versions("1.1", "1.2")),
    ("artistic", (f"artistic {LICENSE}",), _versions("1", "2")),
    ("afl", (f"academic free {LICENSE}",), _versions("2.1", "3")),
    ("osl", (f"open software {LICENSE}",), _versions("2.1", "3")),
    ("ofl", (f"sil open font {LICENSE}", f"open font {LICENSE}"), _versions("1.1", "1")),
    ("boost", (f"boost software {LICENSE}",), _versions("1")),
    ("zlib", (f"zlib libpng? {LICENSE}",), (("", ""),)),
    ("isc", (f"isc {LICENSE}",), (("", ""),)),
    ("psf", (f"python software foundation {LICENSE}",), _versions("2")),
    ("php", (f"php {LICENSE}",), _versions("3.1", "3.0")),
    ("w3c", (f"w3c software {LICENSE}", f"w3c software notice and {LICENSE}"), (("", ""),)),
    ("odbl", (f"open database {LICENSE}", f"odc open database {LICENSE}"), _versions("1")),
    ("odc-by", (f"open data commons attribution {LICENSE}",), _versions("1")),
    ("pddl", (f"public domain dedication and {LICENSE}",), _versions("1")),
    ("cc0", ("cc0", "creative commons zero"), (("-1", "version|v? 1 0 universal?"), ("", ""))),
    *((f"cc-{kind}", (f"cc {kind.replace('-', ' ')}", *(f"creative commons {n}" for n in names)), _CC_VERSIONS) for kind, names in _CC_PARTS.items()),
    ("cc", (f"creative commons {LICENSE}",), (("", ""),)),
    ("unlicense", ("the unlicense",), (("", ""),)),
    ("wtfpl", (f"do what the fuck you want to public {LICENSE}",), _versions("2")),
    ("beerware", (f"beer ware {LICENSE}", f"beerware {LICENSE}"), (("", ""),)),
    ("busl", (f"business source {LICENSE}",), _versions("1.1")),
    ("sspl", (f"server side public {LICENSE}",), _versions("1")),
    ("llama", (f"llama 2|3|4? community {LICENSE}",), (("", ""),)),
    ("openrail", (f"openrail m? {LICENSE}", f"bigscience openrail m? {LICENSE}?"), (("", ""),)),
)
#: (label, sentence of a license's text or notice, weight)
SENTENCES: tuple[tuple[str, str, float], ...] = (
    *((f"{label}-{n}-or-later", f"gnu? {name} general public {LICENSE} as published by the free software foundation either? version {n} of the {LICENSE} or at your option any later version".replace("  ", " "), 0.95) for label, name, which in (("gpl", "", "23"), ("lgpl", "lesser", "23"), ("agpl", "affero", "3")) for n in which),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 0.9),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    ("isc", "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted", 0.9),
    ("apache", "you may not use this file except in compliance with the licen[cs]e", 0.6),
    ("unlicense", "this is free and unencumbered software released into the public domain", 0.95),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.8),
    ("public-domain", "released|dedicated|placed in|into|to the public domain", 0.8),
    ("public-domain", "public domain licen[cs]e|dedication", 0.6),
    ("all-rights-reserved", "all rights reserved", 0.4),
    ("all-rights-reserved", "no part of this publication may be reproduced", 0.6),
    ("proprietary", "proprietary and confidential", 0.6),
    ("proprietary", "end user licen[cs]e agreement", 0.6),
    ("non-commercial", "for non commercial use|purposes only", 0.5),
    ("non-commercial", "for noncommercial use|purposes only", 0.5),
)
#: Words before an identifier (the label itself) in a file's head, and their weight.
IDENTIFIER = ("spdx licen[cs]e identifier", 0.99)
#: Forms in which a name stands: (words before it, weight).
FORMS: tuple[tuple[str, float], ...] = (
    ("licen[cs]ed|released|distributed|redistributed|available|published|provided|offered|covered under|by the? terms? and? conditions? of? the? a?", 0.95),
    ("under|by the? terms? of? the?", 0.8),
    ("", 0.5),
)
#: Phrases whose places are always reported, with their labels.
BASE: tuple[tuple[str, str], ...] = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: One of these stands in every gate, hence in every text that a rule can match.
STEMS = ("licen", "gpl", "gfdl", "apache", "cc  by", "cc0", "creative  commons", "bsd", "public  domain", "free  software  foundation", "permission  is", "without  fee", "redistribution  and", "implied  warranty", "rights  reserved", "no  part  of", "proprietary  and", "non  commercial", "noncommercial", "openrail")


@dataclass(frozen=True)
class Rule:
    """``order`` is its priority (smaller first), ``gate`` a text that stands in all it matches."""

    order: int
    label: str
    weight: float
    gate: str
    regex: str


def regex_of(pattern: str) -> str:
    """A regular expression for words that stand each between two spaces."""
    out = []
    for word in pattern.split():
        bare = word.removesuffix("?")
        one = f" (?:{bare}) " if "|" in bare else f" {bare} "
        out.append(f"(?:{one})?" if word != bare else one)
    return "".join(out)


def gate_of(pattern: str) -> str:
    """The longest text that stands in all matches of the pattern."""
    runs, run = [], ""
    for word in pattern.split():
        literal = "" if word.endswith("?") or "|" in word else re.match("[a-z0-9]*", word)[0]
        runs.append(f"{run}  {literal}" if run and literal else literal or run)
        run = runs[-1] if literal == word else ""
    return max(runs, key=len)


def rules() -> list[Rule]:
    """All rules, in the order of their priority."""
    before, weight = IDENTIFIER
    made = [(f"{label}{end}", gate_of(before), f"{before} {label.replace('-', ' ')} {version}", weight) for label, _, versions in FAMILIES for end, version in versions]
    for before, weight in FORMS:
        if not before:
            made += [(label, gate_of(sentence), sentence, w) for label, sentence, w in SENTENCES]
        made += [(f"{label}{end}", gate_of(name), f"{before} {name} {version}", weight) for label, names, versions in FAMILIES for end, version in versions for name in names]
    return [Rule(k, label, weight, gate, regex_of(p)) for k, (label, gate, p, weight) in enumerate(made)]
