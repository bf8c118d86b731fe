"""Toxicity by a weighted finite-state pattern grammar.

A text is read as clauses of words.  The lexicon tags words as insult (with a
weight), threat, target, negation or speech verb; quotation marks and clause
ends are tags too.  Weighted transducers rewrite the tags.  One reads a clause
from its end and aims insults and threats at a target that follows them.  The
others read from the start: negation weakens what follows it closely, reported
speech weakens the rest of the clause, or of the quotation that the speech
verb opens, and a target aims what follows it.  They are composed into one
machine.  A threat that is aimed at nobody is no match.  What the machines emit
for a clause is its score, and a document's score is a logistic function of
its clauses' scores.

Insults are learnt: a word, or a beginning of words, is one if toxic documents
hold it significantly more often than others.  Lexicon and logistic weights
are fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``).

Null and empty texts have no clauses and score what the logistic function
gives for none.  Null labels are not learnt from; without labels every score
is 0.  A document that is labelled twice is toxic if one label says so, and a
text that rows repeat is learnt from once.  Texts are read whole, however
long.  ``score`` replaces a column of the name it adds; any others may occur.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Scratch
from textloom.llm.language_id import fold, hash_limit

#: Most labelled rows that are learnt from, about.
SAMPLE_ROWS = 24_000
PREFIXES = range(3, 9)
LEAST_DOCS, LEAST_GAIN = 4, 9.0
INSULT, THREAT, TARGET, NEGATION, SPEECH, OTHER, QUOTE, STOP, AIMED_INSULT, AIMED_THREAT = TAGS = range(10)
#: Weight of an aimed threat, and what an insult gains by being aimed.
THREAT_WEIGHT, AIM = 2.0, 1.5
#: Fixed seed words of the grammar in English, French, German and Spanish.
SEEDS = {
    THREAT: "kill hurt destroy beat smash tuer frapper töten schlagen zerstören matar golpear destruir".split(),
    TARGET: "you your they them he she vous tu toi du dich ihr sie usted tú ustedes ellos".split(),
    NEGATION: "not no never don't isn't aren't pas jamais aucun nicht kein keine nie nunca jamás ningún".split(),
    SPEECH: "said says wrote claimed quoted dit écrit affirmé sagte schrieb behauptete dijo escribió afirmó".split(),
}
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n\"“”„«»]")
_MARKS = dict.fromkeys(".!?;\n", STOP) | dict.fromkeys("\"“”„«»", QUOTE)


@dataclass(frozen=True)
class Transducer:
    """Reads a tag, moves to a state and emits a tag with a factor; states are numbered from 0, the start."""

    states: int
    step: Callable[[int, int], tuple[int, int, float]]

    def then(self, after: Transducer) -> Transducer:
        """The composition: ``after`` reads what this one emits."""
        table = {}
        for a, b, tag in product(range(self.states), range(after.states), TAGS):
            to_a, emitted, w = self.step(a, tag)
            to_b, out, v = after.step(b, emitted)
            table[a * after.states + b, tag] = (to_a * after.states + to_b, out, w * v)
        return Transducer(self.states * after.states, lambda state, tag: table[state, tag])

    def run(self, tags: list[int], state: int = 0) -> tuple[list[tuple[int, float]], int]:
        """What is emitted for a sequence, and the state at its end."""
        out = []
        for tag in tags:
            state, emitted, w = self.step(state, tag)
            out.append((emitted, w))
        return out, state


_HARM = (INSULT, THREAT, AIMED_INSULT, AIMED_THREAT)


def negated(reach: int = 3, factor: float = 0.5) -> Transducer:
    """What stands within ``reach`` words after a negation counts ``factor``."""

    def step(state: int, tag: int) -> tuple[int, int, float]:
        if tag == STOP:
            return 0, tag, 1.0
        return (reach if tag == NEGATION else max(0, state - 1)), tag, factor if state and tag in _HARM else 1.0

    return Transducer(reach + 1, step)


def reported(factor: float = 0.7) -> Transducer:
    """After a speech verb the rest of the clause counts ``factor``, and so does a quotation that opens there, to its end."""
    said, quoting = 1, 2

    def step(state: int, tag: int) -> tuple[int, int, float]:
        w = factor if state and tag in _HARM else 1.0
        if tag == QUOTE:
            return {0: 0, said: quoting, quoting: 0}[state], tag, w
        if tag == STOP:
            return state if state == quoting else 0, tag, w
        return said if tag == SPEECH and state != quoting else state, tag, w

    return Transducer(3, step)


def aimed(reach: int = 4) -> Transducer:
    """Insults and threats within ``reach`` words after a target are aimed."""

    def step(state: int, tag: int) -> tuple[int, int, float]:
        if tag == STOP:
            return 0, tag, 1.0
        out = {INSULT: AIMED_INSULT, THREAT: AIMED_THREAT}.get(tag, tag) if state else tag
        return (reach if tag == TARGET else max(0, state - 1)), out, 1.0

    return Transducer(reach + 1, step)


def weighed() -> Transducer:
    """Aimed insults count more; threats at nobody are dropped."""

    def step(state: int, tag: int) -> tuple[int, int, float]:
        return 0, OTHER if tag == THREAT else tag, AIM if tag == AIMED_INSULT else 1.0

    return Transducer(1, step)


def grammar() -> tuple[Transducer, Transducer]:
    """The machine that reads clauses from the end, and the one that then reads from the start."""
    return aimed(), negated().then(reported()).then(aimed()).then(weighed())


#: A clause of these tags alone emits nothing and leaves the start state as it is.
_IDLE = frozenset((TARGET, NEGATION, OTHER, QUOTE, STOP))


@dataclass
class ToxicityModel:
    words: dict[str, float]
    prefixes: dict[str, float]
    weights: np.ndarray
    tags: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        self.tags = {w: tag for tag, seeds in SEEDS.items() for w in seeds}
        self.backward, self.forward = grammar()

    def __getstate__(self) -> dict:
        return {"words": self.words, "prefixes": self.prefixes, "weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def insult(self, word: str) -> float:
        """The weight of a word: the largest of its entries in the lexicon."""
        most = self.words.get(word, 0.0)
        for n in PREFIXES:
            if len(word) <= n:
                break
            most = max(most, self.prefixes.get(word[:n], 0.0))
        return most

    def clauses(self, text: str | None) -> tuple[list[float], int]:
        """Scores of the clauses that match, and the number of words."""
        scores, state, n, known = [], 0, 0, {}
        tags, weights = [], []
        for word in [*_TOKEN.findall((text or "").lower()), "."]:
            if word not in known:
                weight, tag = 0.0, _MARKS.get(word, self.tags.get(word, OTHER))
                if tag == OTHER and (weight := self.insult(word)):
                    tag = INSULT
                known[word] = weight, tag
            weight, tag = known[word]
            tags.append(tag)
            weights.append(weight)
            n += word not in _MARKS
            if tag == STOP:
                if state or not _IDLE.issuperset(tags):
                    score, state = self._clause(tags, weights, state)
                    if score > 0:
                        scores.append(score)
                tags, weights = [], []
        return scores, n

    def _clause(self, tags: list[int], weights: list[float], state: int) -> tuple[float, int]:
        aimed_back = [tag for tag, _ in self.backward.run(tags[::-1])[0]][::-1]
        out, state = self.forward.run(aimed_back, state)
        return sum((THREAT_WEIGHT if tag == AIMED_THREAT else weight) * w for (tag, w), weight in zip(out, weights) if tag in _HARM), state

    def features(self, text: str | None) -> list[float]:
        scores, n = self.clauses(text)
        total, most = sum(scores), max(scores, default=0.0)
        return [1.0, min(most, 20.0), np.log1p(total), np.log1p(len(scores)), min(100 * total / max(n, 20), 50.0), np.log1p(n)]

    def score(self, text: str | None) -> float:
        if not len(self.weights):
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights, self.features(text)), -30, 30))))


def _entries(text: str) -> set[str]:
    """Words, and beginnings of words marked with a star."""
    words = {w for w in _TOKEN.findall(text.lower()) if w not in _MARKS}
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def learn_lexicon(labelled: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings that toxic rows (text, label) hold significantly more often, with their log odds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[label].update(_entries(text or ""))
                seen[label][""] += 1
        entries = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict({"entry": pa.array(entries, pa.string()), "clean": pa.array([seen[0][e] for e in entries], pa.int64()), "toxic": pa.array([seen[1][e] for e in entries], pa.int64())})

    counts = labelled.mapInArrow(count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rows = counts.where((F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") * 3 > F.col("clean")) | (F.col("entry") == "")).toPandas()
    totals = rows[rows.entry == ""]
    rows = rows[rows.entry != ""]
    if not len(totals) or not len(rows):
        return {}, {}
    n0, n1 = max(float(totals.clean.iloc[0]), 1.0), max(float(totals.toxic.iloc[0]), 1.0)
    a, b = rows.toxic + 0.5, rows.clean + 0.5
    odds = np.log(a / (n1 + 1)) - np.log(b / (n0 + 1))
    # gain in log likelihood of a rate of its own over the common one
    share, base = a / (a + b), n1 / (n0 + n1)
    gain = rows.toxic * np.log(share / base) + rows.clean * np.log(np.maximum((1 - share) / (1 - base), 1e-9))
    rows = rows.assign(odds=odds, gain=gain)[(gain > LEAST_GAIN) & (odds > np.log(4))]
    whole = rows[~rows.entry.str.endswith("*")]
    begun = rows[rows.entry.str.endswith("*")]
    return dict(zip(whole.entry, whole.odds)), dict(zip(begun.entry.str[:-1], begun.odds))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Ridge-penalised logistic weights by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(sample: DataFrame) -> ToxicityModel:
    """Learns from a sample of rows (text, label 0 or 1): the lexicon from two thirds, the weights from the others."""
    third = F.pmod(F.xxhash64("text"), F.lit(3))
    words, prefixes = learn_lexicon(sample.where(third != 0).select("text", "label"))
    found = ToxicityModel(words, prefixes, np.zeros(0))

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([found.features(t) for t in texts])

    rows = sample.where(third == 0).select(features("text").alias("x"), "label").toPandas()
    if not len(rows):
        return found
    return ToxicityModel(words, prefixes, fit_logistic(np.stack(rows["x"]), rows["label"].to_numpy(float)))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds the score of every whole text.  The model comes from a bounded sample and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype=float)

    return docs.withColumn(score_col, judge(F.col(text_col)))


def training_sample(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Distinct (text, label) of labelled documents whose fold of five is not 0, about ``sample_rows`` of them at most.

    Labels are drawn before they meet the texts, so the side that is broadcast is as bounded as the sample."""
    known = labels.where(F.col("toxic").cast("int").isin(0, 1) & (fold(F.col("doc_id"), 5) > 0)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    total = known.count()
    drawn = known.where(F.xxhash64("doc_id") <= hash_limit(sample_rows / max(total, 1)))
    met = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("text").agg(F.max("label").alias("label"))
    texts = scratch.table(met)
    # an id may have many texts, so the bound is applied to these once more
    return texts.where(F.xxhash64("text", F.lit(1)) <= hash_limit(sample_rows / max(texts.count(), 1)))


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: its score, and whether it is held out of training."""
    with Scratch(docs.sparkSession, "toxicity") as scratch:
        model = fit(training_sample(docs, labels, scratch))
    rows = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return score(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
