"""License scans by ordered signature rules.

A text becomes its words (A-Z lower-cased), each between two spaces, so that a
rule's regular expression matches whole words and neighbouring matches share
nothing.  Most texts hold none of a few stems and are done.  In the others the
gates are looked for, texts of which each rule has one; only rules whose gate
occurs run.  All matches of all rules are detections, as spans of words.

Detections are read from left to right, longer ones first.  One that lies
within a detection before it is suppressed (of two with the same span the one
whose rule comes first stays); of two that overlap in part, the one whose
rule comes first stays.  ``score`` is the chance that any detection kept is right,
if each is with its rule's weight.

Beside the rules, the places of the base phrases are reported always, whether or
not their detection is suppressed.

Everything happens within a row, in expressions; nothing is shuffled, so no key
can be hot.  Texts are read whole, however long; sorting and suppressing take
time with the number of detections of one text alone.  Null and empty texts
have no words.  Rows that repeat get the same result each, null ids are kept.
Columns of the names of new ones are replaced, others may have any name.  An
empty table gives an empty result.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import BETWEEN_WORDS, lowered, packed
from textloom.llm.license_rules import BASE, STEMS, Rule, regex_of, rules

_RULE = "array<struct<order:int,label:string,weight:double,gate:string,regex:string>>"
_SPAN = "struct<start:bigint,behind:bigint,order:int,label:string,weight:double>"


def spaced(text: Column) -> Column:
    """The words of a text, each between two spaces; two spaces if there is none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered(F.coalesce(text, F.lit(""))), BETWEEN_WORDS, "  ")), F.lit(" "))


def words_in(part: Column) -> Column:
    """How many words stand in a part of a spaced text that holds whole ones."""
    return ((F.octet_length(part) - F.octet_length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("long")


def _constants(made: list[Rule]) -> Column:
    return F.from_json(F.lit(json.dumps([asdict(r) for r in made])), _RULE)


def _spans(text: Column, rule: Column) -> Column:
    """Where a rule matches: start, minus the word behind, and what the rule says."""
    gaps, found = F.split(text, rule["regex"], -1), F.regexp_extract_all(text, rule["regex"], F.lit(0))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + words_in(pair["gap"])
        stop = start + words_in(pair["hit"])
        span = F.struct(start.alias("start"), (-stop).alias("behind"), rule["order"].alias("order"), rule["label"].alias("label"), rule["weight"].alias("weight"))
        return F.struct(stop.alias("at"), F.array_append(state["spans"], span).alias("spans"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    return F.aggregate(pairs, zero, step, lambda s: s["spans"])


def _kept(sorted_spans: Column) -> Column:
    """The detections that no other suppresses, from left to right."""

    def step(kept: Column, x: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        beside = (F.size(kept) == 0) | (x["start"] >= -last["behind"])
        return F.when(beside, F.array_append(kept, x)).when(x["behind"] >= last["behind"], kept).when(x["order"] < last["order"], F.array_append(F.slice(kept, F.lit(1), F.size(kept) - 1), x)).otherwise(kept)

    return F.aggregate(sorted_spans, F.array().cast(f"array<{_SPAN}>"), step)


def _detected(text: Column, made: list[Rule]) -> Column:
    gates = sorted({r.gate for r in made})
    present = F.filter(F.array(*[F.lit(g) for g in gates]), lambda g: F.contains(text, g))
    found = lambda gates: F.transform(F.filter(_constants(made), lambda r: F.array_contains(gates, r["gate"])), lambda r: _spans(text, r))
    return F.flatten(F.flatten(F.transform(F.array(present), found)))


def scan(docs: DataFrame, text_col: str = "text", signature_rules: list[Rule] | None = None) -> DataFrame:
    """Adds to each document n_words, places (of base phrases: start, stop, label), detections (kept: start, stop, label, weight) and score."""
    made = rules() if signature_rules is None else signature_rules
    kept = docs.drop("n_words", "places", "detections", "score")
    rows = packed(kept).withColumn("spaced", spaced(F.col(f"row.`{text_col}`")))
    text, nothing = F.col("spaced"), F.array().cast(f"array<{_SPAN}>")
    stems = STEMS if signature_rules is None else tuple(sorted({r.gate for r in made}))
    gated = F.lit(False)
    for stem in stems:
        gated = gated | F.contains(text, F.lit(stem))
    base = [Rule(k, label, 1.0, "", regex_of(phrase)) for k, (phrase, label) in enumerate(BASE)]
    rows = rows.withColumn("gated", gated)
    rows = rows.withColumn("base", F.when(F.col("gated"), F.array_sort(F.flatten(F.transform(_constants(base), lambda r: _spans(text, r))))).otherwise(nothing))
    rows = rows.withColumn("found", F.when(F.col("gated"), _kept(F.array_sort(_detected(text, made)))).otherwise(nothing))
    span = lambda x, *more: F.struct(x["start"].alias("start"), (-x["behind"]).alias("stop"), *[x[c].alias(c) for c in more])
    return rows.select(
        *[F.col(f"row.`{c}`") for c in kept.columns],
        F.when(text == "  ", F.lit(0).cast("long")).otherwise(words_in(text)).alias("n_words"),
        F.transform("base", lambda x: span(x, "label")).alias("places"),
        F.transform("found", lambda x: span(x, "label", "weight")).alias("detections"),
        (1 - F.aggregate("found", F.lit(1.0), lambda s, x: s * (1 - x["weight"]))).alias("score"),
    )


def licenses(docs: DataFrame) -> DataFrame:
    """One row per document: words, places of base phrases, and the labels of the base and of all rules."""
    made = scan(docs.select("doc_id", "text"))
    base = F.transform("places", lambda x: x["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return made.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda x: x["start"])).alias("first_word"), F.array_max(F.transform("places", lambda x: x["start"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("detections", lambda x: x["label"]))).alias("labels"),
        "score", F.size("detections").cast("long").alias("n_detections"),
    )
