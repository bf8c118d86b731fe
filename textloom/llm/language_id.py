"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from every training row, and so do the weights: all
labelled rows are dealt by a hash into shards of about ``SAMPLE_ROWS``.  Each
shard is fitted in a task, with follow-the-regularised-leader updates and
elastic-net penalties, which leave most weights at zero, and the shards' weights
are averaged (parameter mixing).  Every shard has rows of every language: those
of a rare one are in several.  A fifth of the texts stays out of the fit and
sets the temperature that calibrates the probabilities, a mean over shards too.

A text that is null or has no letter gets ``und`` and score 0, and so does
every text if there is no labelled row.  Null labels are not learnt from.
Any number of languages may occur: beyond 512 n-grams share weights, so that
all weights together keep within ``MOST_WEIGHTS``.
Texts are read whole, however long.  A text that many rows repeat enters a
shard once, and rows that repeat get the same result.  ``predict`` replaces
columns named lang_pred and score; any other names may occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import free_name

UNDETERMINED = "und"
FEATURES = 1 << 15
MOST_CHARS = 3
#: Labelled rows that are fitted together in a task, about; all are fitted.
SAMPLE_ROWS = 8192
#: Most weights of all languages together that are kept and broadcast (128 MB).
MOST_WEIGHTS = 512 * FEATURES
#: Texts of so many n-grams at least are rejected if their n-grams are rarer, by this factor, than in almost all learned texts.
JUDGED_GRAMS, RARER = 40, 1.33
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1e-4
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of one to three characters with their counts; None if there is no letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    units = np.frombuffer((" " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    hashes, gram = [], np.zeros(len(units), np.uint64)
    for n in range(MOST_CHARS):
        if len(units) <= n:
            break
        gram = gram[: len(units) - n] * np.uint64(0x100000001B3) + units[n:] + np.uint64(n + 1)
        hashes.append((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15))
    counts = np.bincount(np.concatenate(hashes).astype(np.int64), minlength=FEATURES)
    found = np.flatnonzero(counts)
    return found, counts[found]


def weighted(grams: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, counts = grams
    # the square root damps frequent n-grams and, unlike a logarithm, gives a repeated text the same direction
    x = np.sqrt(counts) * idf[found]
    return found, x / max(float(np.linalg.norm(x)), 1e-12)


def width_for(languages: int) -> int:
    """Weights of one language: one for each feature, or as many as keep within the bound, but one at least."""
    return min(FEATURES, 1 << max((MOST_WEIGHTS // max(languages, 1)).bit_length() - 1, 0))


def shared_weights(found: np.ndarray, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Features that share a weight add up."""
    if width == FEATURES:
        return found, x
    slots, at = np.unique(found // (FEATURES // width), return_inverse=True)
    return slots, np.bincount(at, x)


def rarity(grams: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> float:
    """Mean inverse document frequency of a text's n-grams."""
    found, counts = grams
    return float((counts * idf[found]).sum() / counts.sum())


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    rarity_limit: float = float("inf")

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the n-grams are so rare in the corpus that the text is in no learned language."""
        grams = ngram_counts(text)
        if grams is None or not self.languages:
            return UNDETERMINED, 0.0, False
        found, x = shared_weights(*weighted(grams, self.idf), self.weights.shape[1])
        p = _softmax(self.weights[:, found] @ x / self.temperature)
        k = int(p.argmax())
        foreign = int(grams[1].sum()) >= JUDGED_GRAMS and rarity(grams, self.idf) > self.rarity_limit
        return self.languages[k], float(p[k]), foreign

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=0))
    return e / e.sum(axis=0)


class Sample(Sequence):
    """Rows to fit, (features, weights, class); only features and counts are held, six bytes each, weights are made when asked for."""

    def __init__(self, idf: np.ndarray, width: int):
        self.idf, self.width, self.rows = idf, width, []

    def add(self, grams: tuple[np.ndarray, np.ndarray], label: int) -> None:
        self.rows.append((grams[0].astype(np.uint16), grams[1].astype(np.uint32), label))

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        found, counts, label = self.rows[k]
        return *shared_weights(*weighted((found.astype(np.int64), counts.astype(np.int64)), self.idf), self.width), label


def fit_ftrl(rows: Sequence[tuple[np.ndarray, np.ndarray, int]], classes: int, seed: int = 7, width: int = FEATURES) -> np.ndarray:
    """Weights by follow-the-regularised-leader with elastic-net penalties."""
    z, n = np.zeros((classes, width)), np.zeros((classes, width))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            found, x, label = rows[k]
            zk, nk = z[:, found], n[:, found]
            w = weights(zk, nk)
            p = _softmax(w @ x)
            p[label] -= 1
            g = p[:, None] * x
            more = nk + g * g
            z[:, found] = zk + g - (np.sqrt(more) - np.sqrt(nk)) / ALPHA * w
            n[:, found] = more
    return weights(z, n)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits.T / np.exp(t))
        return float(-np.log(np.maximum(p[labels, np.arange(len(labels))], 1e-12)).mean() + 1e-4 * t * t)

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(texts: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """How many texts hold each feature, and the number of texts with letters; the result has a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if grams := ngram_counts(text.as_py()):
                    seen[grams[0]] += 1
                    docs += 1
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"feature": np.append(found, -1).astype(np.int32), "docs": np.append(seen[found], docs)})

    rows = texts.select(text_col).mapInArrow(count, "feature int, docs long").groupBy("feature").agg(F.sum("docs").alias("docs")).toPandas()
    total = int(rows.loc[rows.feature < 0, "docs"].sum())
    rows = rows[rows.feature >= 0]
    frequencies = np.zeros(FEATURES, np.int64)
    frequencies[rows.feature] = rows.docs
    return frequencies, total


def hash_limit(rate: float) -> int:
    """The signed 64-bit value up to which hashes are drawn at ``rate``; it does not come down to none for small rates."""
    return min(int(-(1 << 63) + min(rate, 1.0) * (1 << 64)), (1 << 63) - 1)


def parts_of(sizes: dict[str, int], rows: int) -> tuple[int, dict[str, int]]:
    """The number of shards of about ``rows``, and into how many parts each language's rows are dealt among them.

    A shard has some rows of each language, so one too rare for as many parts as shards gives each part to several;
    that adds a quarter of all rows at most."""
    shards, least = ceil(sum(sizes.values()) / rows), max(1, rows // (8 * len(sizes)))
    return shards, {label: min(shards, max(1, n // least)) for label, n in sizes.items()}


def fit(train: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fits a model on all labelled rows, about ``sample_rows`` in each shard."""
    labelled = train.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"), F.col(id_col).alias("id")).where(F.col("label").isNotNull() & F.col("text").isNotNull())
    # one row for each language
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    languages = tuple(sorted(sizes))
    number, width = {label: k for k, label in enumerate(languages)}, width_for(len(languages))
    frequencies, total = document_frequencies(labelled, "text")
    idf = np.log((1 + total) / (1 + frequencies)) + 1
    if not languages:
        return LanguageModel((), idf, np.zeros((0, FEATURES)), 1.0)
    shards, parts_by = parts_of(sizes, sample_rows)
    parts = train.sparkSession.createDataFrame(list(parts_by.items()), "label string, parts int")
    # rows are dealt by text and id, so copies of a text are spread; a language of fewer parts than shards gives each part to several
    part = F.pmod(F.xxhash64("text", "id"), F.col("parts")).cast("int")
    dealt = labelled.join(F.broadcast(parts), "label").select("label", "text", F.xxhash64("text").alias("dealt"), F.explode(F.sequence(part, F.lit(shards - 1), F.col("parts"))).alias("shard"))
    ordered = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "dealt", "text", "label")

    def fitted_shard(rows: Sample, is_held: list[bool], rare: list[float]) -> pa.RecordBatch:
        """Sums over shards make the means: weights times rows; at -1 the rows, held ones, these times log temperature, judged ones, these times their limit."""
        held = Sample(idf, width)
        # a language whose few texts would all be held back is fitted on them
        fitted = {r[2] for r, h in zip(rows.rows, is_held) if not h}
        held.rows = [r for r, h in zip(rows.rows, is_held) if h]
        rows.rows = [r for r, h in zip(rows.rows, is_held) if not h or r[2] not in fitted]
        w = fit_ftrl(rows, len(languages), width=width)
        logits = np.array([w[:, found] @ x for found, x, _ in held])
        t = fit_temperature(logits, np.array([label for *_, label in held.rows], np.int64))
        most = float(np.quantile(rare, 0.999)) * RARER if rare else 0.0
        k, f = np.nonzero(w)
        facts = [len(rows), len(held), len(held) * np.log(t), len(rare), len(rare) * most]
        return pa.RecordBatch.from_pydict({"k": np.r_[np.full(5, -1), k].astype(np.int32), "f": np.r_[np.arange(5), f].astype(np.int32), "w": np.r_[facts, len(rows) * w[k, f]]})

    def train_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = None, None
        rows, is_held, rare = Sample(idf, width), [], []
        for batch in batches:
            # one text at a time is a Python string, for the worker stays and keeps the memory it once had
            for text, *row in zip(*(batch.column(c) for c in ("text", "shard", "dealt", "label"))):
                text, (at, dealt, label) = text.as_py(), (x.as_py() for x in row)
                if at != shard:
                    if len(rows):
                        yield fitted_shard(rows, is_held, rare)
                    shard, last = at, None
                    rows, is_held, rare = Sample(idf, width), [], []
                if last == (dealt, text, label):
                    continue
                last = dealt, text, label
                if grams := ngram_counts(text):
                    rows.add(grams, number[label])
                    is_held.append(dealt % 5 == 0)
                    if int(grams[1].sum()) >= JUDGED_GRAMS:
                        rare.append(rarity(grams, idf))
        if len(rows):
            yield fitted_shard(rows, is_held, rare)

    made = ordered.mapInArrow(train_shards, "k int, f int, w double").groupBy("k", "f").agg(F.sum("w").alias("w")).toPandas()
    weights = np.zeros((len(languages), width))
    if not len(made):
        return LanguageModel(languages, idf, weights, 1.0)
    rows, held, heat, judged, limit = made[made.k < 0].sort_values("f").w
    made = made[made.k >= 0]
    weights[made.k, made.f] = made.w / rows
    return LanguageModel(languages, idf, weights, float(np.exp(heat / held)) if held else 1.0, float(limit / judged) if judged else float("inf"))


def predict(docs: DataFrame, model: LanguageModel, text: Column) -> DataFrame:
    """Adds ``lang_pred`` and ``score``.  The model has a fixed size and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string, score:double>")
    def classify(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    made = docs.withColumn(free_name(docs, "language"), classify(text))
    language = made.columns[-1]
    return made.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")], f"{language}.lang_pred", f"{language}.score")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)), F.lit(-1))


def identify(docs: DataFrame) -> DataFrame:
    """Predictions for every document, learnt from those whose fold of four is not 2 (or null)."""
    of = fold(F.col("doc_id"), 4)
    model = fit(docs.where((of != 2) & (of >= 0)))
    rows = docs.select("doc_id", "text", (of == 2).alias("held_out"))
    return predict(rows, model, F.col("text")).select("doc_id", "held_out", "lang_pred", "score")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents in one of the learned languages; the columns stay.

    A document goes if its text is null or has no letter, or if its n-grams are much rarer in the corpus than those
    of the learned texts, which says that it is in another language, however many are learned."""
    of = fold(F.col("doc_id"), 4)
    model = fit(docs.where((of != 2) & (of >= 0)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def keeps(texts: pd.Series) -> pd.Series:
        judged = map(shared.value.judge, texts)
        return pd.Series([lang != UNDETERMINED and not foreign for lang, _, foreign in judged], dtype=bool)

    return docs.where(keeps(F.col("text")))
