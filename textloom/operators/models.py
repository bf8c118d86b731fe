"""Models: a word to its tokens.

The functions here work on one word.  On tables they run over distinct words
(``tokens_of_words``) or, where documents are encoded, once per word and
Python worker, whose results are remembered.  Word-level lookups are joins.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Token(NamedTuple):
    id: int
    value: str
    start: int
    end: int


class Draws:
    """Random numbers by counting: the n-th of a key is always the same, whatever was drawn elsewhere."""

    def __init__(self, seed: int, *key: object):
        self.at = int.from_bytes(hashlib.blake2b(repr((seed, *key)).encode(), digest_size=8).digest(), "little")

    def random(self) -> float:
        """The next step of a counter, mixed (splitmix64)."""
        self.at = (self.at + 0x9E3779B97F4A7C15) & _64
        z = ((self.at ^ (self.at >> 30)) * 0xBF58476D1CE4E5B9) & _64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _64
        return ((z ^ (z >> 31)) >> 11) / (1 << 53)

    def choices(self, population: list, weights: list[float] | None = None, *, cum_weights: list[float] | None = None) -> list:
        """One of the population by its weight, as ``random.choices`` takes it."""
        cum_weights = cum_weights or list(accumulate(weights))
        return [population[bisect(cum_weights, self.random() * (cum_weights[-1] + 0.0), 0, len(population) - 1)]]


_64 = (1 << 64) - 1


class Model:
    vocab: dict[str, int]

    def tokenize(self, word: str, rng: random.Random | None = None) -> list[Token]:
        """The word's tokens; a random model draws from ``rng``."""
        raise NotImplementedError

    def ids_of(self, word: str) -> list[int]:
        """The ids of the word's tokens alone."""
        return [t.id for t in self.tokenize(word)]

    def of_whole_words(self, words: list[str]) -> tuple[list[int], list[str]] | None:
        """Ids and tokens, of a model that makes one token of any whole word; else None."""
        return None

    @property
    def is_random(self) -> bool:
        return False

    @cached_property
    def _by_id(self) -> dict[int, str]:
        return {i: t for t, i in self.vocab.items()}

    def token_to_id(self, token: str) -> int | None:
        return self.vocab.get(token)

    def id_to_token(self, i: int) -> str | None:
        return self._by_id.get(i)

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        """The vocabulary as rows (token, id)."""
        return spark.createDataFrame(pa.table({"token": pa.array(list(self.vocab), pa.string()), "id": pa.array(list(self.vocab.values()), pa.int64())}))


def _byte_token(byte: int) -> str:
    return f"<0x{byte:02X}>"


@dataclass(frozen=True)
class WordLevel(Model):
    vocab: dict[str, int]
    unk_token: str = "<unk>"

    def tokenize(self, word: str, rng: random.Random | None = None) -> list[Token]:
        if word in self.vocab:
            return [Token(self.vocab[word], word, 0, len(word))]
        if self.unk_token not in self.vocab:
            raise ValueError("the unknown token is not in the vocabulary")
        return [Token(self.vocab[self.unk_token], self.unk_token, 0, len(word))]

    def of_whole_words(self, words: list[str]) -> tuple[list[int], list[str]]:
        vocab, unknown = self.vocab, self.vocab.get(self.unk_token)
        tokens = [w if w in vocab else self.unk_token for w in words]
        ids = [vocab.get(w, unknown) for w in words]
        if unknown is None and None in ids:
            raise ValueError("the unknown token is not in the vocabulary")
        return ids, tokens


@dataclass(frozen=True)
class WordPiece(Model):
    vocab: dict[str, int]
    unk_token: str = "[UNK]"
    continuing_subword_prefix: str = "##"
    max_input_chars_per_word: int = 100

    @cached_property
    def _longest(self) -> int:
        return max(map(len, self.vocab), default=0)

    def tokenize(self, word: str, rng: random.Random | None = None) -> list[Token]:
        out, start = [], 0
        while len(word) <= self.max_input_chars_per_word and start < len(word):
            prefix = self.continuing_subword_prefix if start else ""
            for stop in range(min(len(word), start + self._longest), start, -1):
                piece = prefix + word[start:stop]
                if piece in self.vocab:
                    out.append(Token(self.vocab[piece], piece, start, stop))
                    start = stop
                    break
            else:
                break
        if start == len(word) and word:
            return out
        if self.unk_token not in self.vocab:
            raise ValueError("the unknown token is not in the vocabulary")
        return [Token(self.vocab[self.unk_token], self.unk_token, 0, len(word))] if word else []


@dataclass(frozen=True)
class Bpe(Model):
    """Byte-pair encoding: symbols are merged, lowest rank first, leftmost among equals."""

    vocab: dict[str, int]
    merges: tuple[tuple[str, str], ...]
    dropout: float | None = None
    unk_token: str | None = None
    continuing_subword_prefix: str | None = None
    end_of_word_suffix: str | None = None
    fuse_unk: bool = False
    byte_fallback: bool = False
    ignore_merges: bool = False

    def __post_init__(self) -> None:
        if self.dropout is not None and not 0 <= self.dropout <= 1:
            raise ValueError("dropout must be between 0 and 1")
        if self.unk_token is not None and self.vocab and self.unk_token not in self.vocab:
            raise ValueError(f"the unknown token {self.unk_token} is not in the vocabulary")
        skip = len(self.continuing_subword_prefix or "")
        for a, b in self.merges:
            for token in (a, b, a + b[skip:]):
                if token not in self.vocab:
                    raise ValueError(f"the merge of {a} and {b} needs {token}, which is not in the vocabulary")

    @property
    def is_random(self) -> bool:
        return bool(self.dropout)

    @cached_property
    def _ranks(self) -> dict[tuple[int, int], tuple[int, int]]:
        skip = len(self.continuing_subword_prefix or "")
        v = self.vocab
        return {(v[a], v[b]): (rank, v[a + b[skip:]]) for rank, (a, b) in reversed(list(enumerate(self.merges)))}

    def _symbols(self, word: str) -> list[list[int]]:
        """[id, length] for each first symbol; an unknown character may be dropped, made bytes, or fused."""
        out: list[list[int]] = []
        unk: list[int] | None = None
        for i, c in enumerate(word):
            token = (self.continuing_subword_prefix or "") * (i > 0) + c + (self.end_of_word_suffix or "") * (i == len(word) - 1)
            if token in self.vocab:
                if unk:
                    out.append(unk)
                    unk = None
                out.append([self.vocab[token], 1])
                continue
            if self.byte_fallback:
                parts = [self.vocab.get(_byte_token(b)) for b in token.encode()]
                if None not in parts:
                    out += [[p, int(k == 0)] for k, p in enumerate(parts)]
                    continue
            if self.unk_token is not None:
                if unk and self.fuse_unk:
                    unk[1] += 1
                else:
                    if unk:
                        out.append(unk)
                    unk = [self.vocab[self.unk_token], 1]
        return out + [unk] if unk else out

    def _merged(self, symbols: list[list[int]], rng: random.Random | None = None) -> list[list[int]]:
        if self.dropout:
            return self._merged_at_random(symbols, rng or random)
        if not self.merges:
            return symbols
        # a symbol is known by where it starts; stop says where it ends, begin where the one before it starts
        n, ids, sizes = len(symbols), [s[0] for s in symbols], [s[1] for s in symbols]
        stop, begin = list(range(1, n + 1)), list(range(-1, n))
        waiting: dict[int, list[int]] = {}  # starts of pairs by their rank

        def rank_at(i: int) -> int | None:
            found = self._ranks.get((ids[i], ids[stop[i]])) if i >= 0 and stop[i] < n else None
            return found and found[0]

        def offer(i: int) -> int:
            rank = rank_at(i)
            if rank is None:
                return len(self.merges)
            waiting.setdefault(rank, []).append(i)
            return rank

        for i in range(n):
            offer(i)
        while waiting:
            # a round merges the lowest rank from the left, until a merge makes a pair that ranks lower still
            rank = min(waiting)
            starts = sorted(waiting.pop(rank))
            for k, i in enumerate(starts):
                if ids[i] < 0 or rank_at(i) != rank:
                    continue
                j = stop[i]
                ids[i], sizes[i], stop[i] = self._ranks[ids[i], ids[j]][1], sizes[i] + sizes[j], stop[j]
                ids[j], begin[stop[i]] = -1, i
                if min(offer(i), offer(begin[i])) < rank:
                    waiting.setdefault(rank, []).extend(starts[k + 1 :])
                    break
        return [[ids[i], sizes[i]] for i in range(n) if ids[i] >= 0]

    def _merged_at_random(self, symbols: list[list[int]], rng) -> list[list[int]]:
        """One merge after the other: of the pairs seen so far, the first by rank and place that is not dropped is taken.

        A pair that an earlier merge has broken is taken as well, to no effect; if all are dropped, that is the end."""
        parts = [(i, *s) for i, s in enumerate(symbols)]  # start, id, size

        def pair_at(k: int) -> list[tuple[int, int, int]]:
            found = self._ranks.get((parts[k][1], parts[k + 1][1])) if 0 <= k < len(parts) - 1 else None
            return [(found[0], parts[k][0], found[1])] if found else []

        seen = [p for k in range(len(parts)) for p in pair_at(k)]
        while seen:
            seen.sort()
            chosen = next((p for p in seen if rng.random() >= self.dropout), None)
            if chosen is None:
                break
            seen.remove(chosen)
            k = next((k for k, part in enumerate(parts) if part[0] == chosen[1]), -1)
            if (now := pair_at(k)) and now[0][2] == chosen[2]:
                parts[k : k + 2] = [(chosen[1], chosen[2], parts[k][2] + parts[k + 1][2])]
                seen += pair_at(k) + pair_at(k - 1)
        return [[i, size] for _, i, size in parts]

    def ids_of(self, word: str) -> list[int]:
        if self.dropout or self.ignore_merges and word in self.vocab or self.continuing_subword_prefix or self.end_of_word_suffix:
            return super().ids_of(word)
        ids = [self.vocab.get(c) for c in word]
        if None in ids:
            return [i for i, _ in self._merged(self._symbols(word))]
        return [i for i, _ in self._merged([[i, 1] for i in ids])] if self.merges else ids

    def tokenize(self, word: str, rng: random.Random | None = None) -> list[Token]:
        if not word:
            return []
        if self.ignore_merges and word in self.vocab:
            return [Token(self.vocab[word], word, 0, len(word))]
        out, at = [], 0
        for i, size in self._merged(self._symbols(word), rng):
            # a byte that is not its character's first lies on that character
            out.append(Token(i, self._by_id[i], at if size else max(at - 1, 0), at + size))
            at += size
        return out


UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Unigram(Model):
    """Unigram language model: the most likely segmentation into pieces with log probabilities."""

    pieces: tuple[tuple[str, float], ...]
    unk_id: int | None = None
    byte_fallback: bool = False
    alpha: float | None = None
    nbest_size: int | None = None
    fuse_unk: bool = True

    def __post_init__(self) -> None:
        if self.unk_id is not None and self.unk_id >= len(self.pieces):
            raise ValueError("the unknown id lies outside the vocabulary")

    @property
    def is_random(self) -> bool:
        return self.alpha is not None

    @cached_property
    def vocab(self) -> dict[str, int]:
        return {p: i for i, (p, _) in enumerate(self.pieces)}

    @cached_property
    def _longest(self) -> int:
        return max((len(p) for p, _ in self.pieces), default=0)

    @cached_property
    def _unknown_score(self) -> float:
        return min((s for _, s in self.pieces), default=0.0) - UNKNOWN_PENALTY

    def edges(self, text: str) -> list[list[tuple[int, int | None, float]]]:
        """For each start: (stop, id, score) of the pieces there; an unknown piece where no single character is one."""
        out = []
        for start in range(len(text)):
            here = [(stop, i, self.pieces[i][1]) for stop in range(start + 1, min(len(text), start + self._longest) + 1) if (i := self.vocab.get(text[start:stop])) is not None]
            if not any(stop == start + 1 for stop, _, _ in here):
                here.append((start + 1, self.unk_id, self._unknown_score))
            out.append(here)
        return out

    def best(self, text: str) -> list[tuple[int, int, int | None]]:
        """(start, stop, id) of the best segmentation."""
        score, back = [0.0] + [-math.inf] * len(text), [(0, None)] * (len(text) + 1)
        for start, here in enumerate(self.edges(text)):
            for stop, i, s in here:
                if score[start] + s > score[stop]:
                    score[stop], back[stop] = score[start] + s, (start, i)
        out, at = [], len(text)
        while at:
            start, i = back[at]
            out.append((start, at, i))
            at = start
        return out[::-1]

    def nbest(self, text: str, n: int) -> list[tuple[float, list[tuple[int, int, int | None]]]]:
        """The n best segmentations with their scores, best first."""
        paths: list[list] = [[(0.0, [])]] + [[] for _ in text]
        for start, here in enumerate(self.edges(text)):
            paths[start] = heapq.nlargest(n, paths[start], key=lambda p: p[0])
            for stop, i, s in here:
                paths[stop] += [(score + s, [*path, (start, stop, i)]) for score, path in paths[start]]
        return heapq.nlargest(n, paths[-1], key=lambda p: p[0])

    def best_pieces(self, text: str, n: int) -> list[tuple[float, list[str]]]:
        """The n best segmentations as texts: by score, then by their pieces; each place keeps its n best beginnings."""
        paths: list[list[tuple[float, list[str]]]] = [[(0.0, [])]] + [[] for _ in text]
        for start, here in enumerate(self.edges(text)):
            paths[start] = heapq.nsmallest(n, paths[start], key=lambda p: (-p[0], p[1]))
            for stop, _, s in here:
                paths[stop] += [(score + s, [*path, text[start:stop]]) for score, path in paths[start]]
        return heapq.nsmallest(n, paths[-1], key=lambda p: (-p[0], p[1]))

    def _forward(self, edges: list[list[tuple[int, int | None, float]]], theta: float = 1.0) -> list[float]:
        alpha = [0.0] + [-math.inf] * len(edges)
        for start, here in enumerate(edges):
            for stop, _, s in here:
                alpha[stop] = _log_add(alpha[stop], alpha[start] + theta * s)
        return alpha

    def marginals(self, text: str) -> tuple[dict[int, float], float]:
        """Expected count of each piece, and the log likelihood of the text."""
        edges = self.edges(text)
        alpha, beta = self._forward(edges), [-math.inf] * len(text) + [0.0]
        for start in range(len(text) - 1, -1, -1):
            for stop, _, s in edges[start]:
                beta[start] = _log_add(beta[start], s + beta[stop])
        out: dict[int, float] = {}
        for start, here in enumerate(edges):
            for stop, i, s in here:
                if i is not None:
                    out[i] = out.get(i, 0.0) + math.exp(alpha[start] + s + beta[stop] - alpha[-1])
        return out, alpha[-1]

    def sample(self, text: str, theta: float, rng: random.Random | None = None) -> list[tuple[int, int, int | None]]:
        """A segmentation drawn with probability in proportion to its likelihood to the power theta."""
        rng, incoming = rng or random, self._weighted(text, theta)
        out, at = [], len(text)
        while at:
            start, i = rng.choices(incoming[at][0], cum_weights=incoming[at][1])[0]
            out.append((start, at, i))
            at = start
        return out[::-1]

    @cached_property
    def _lattices(self) -> dict[tuple[str, float], list]:
        """What ``_weighted`` gave for frequent words."""
        return {}

    def _weighted(self, text: str, theta: float) -> list[tuple[list[tuple[int, int | None]], list[float]]]:
        """For each place the pieces (start, id) that end there, and the sums of their weights."""
        found = self._lattices.get((text, theta))
        if found is not None:
            return found
        edges = self.edges(text)
        alpha, pieces, weights = self._forward(edges, theta), [[] for _ in range(len(text) + 1)], [[] for _ in range(len(text) + 1)]
        for start, here in enumerate(edges):
            for stop, i, s in here:
                pieces[stop].append((start, i))
                weights[stop].append(math.exp(alpha[start] + theta * s - alpha[stop]) if alpha[stop] > -math.inf else 0.0)
        found = [(p, list(accumulate(w))) for p, w in zip(pieces, weights)]
        if len(text) <= CACHE_CHARS:
            if len(self._lattices) >= CACHE_WORDS:
                self._lattices.clear()
            self._lattices[text, theta] = found
        return found

    def _segments(self, word: str, rng: random.Random | None = None) -> list[tuple[int, int, int | None]]:
        if self.alpha is None:
            return self.best(word)
        if self.nbest_size and self.nbest_size > 1:
            found = self.nbest(word, self.nbest_size)
            top = found[0][0]
            return (rng or random).choices([p for _, p in found], [math.exp(self.alpha * (s - top)) for s, _ in found])[0]
        return self.sample(word, self.alpha, rng)

    def tokenize(self, word: str, rng: random.Random | None = None) -> list[Token]:
        fused: list[tuple[int, int, int | None]] = []
        for start, stop, i in self._segments(word, rng):
            unknown = i is None or i == self.unk_id
            if fused and unknown and self.fuse_unk and (fused[-1][2] is None or fused[-1][2] == self.unk_id):
                fused[-1] = (fused[-1][0], stop, i)
            else:
                fused.append((start, stop, i))
        out = []
        for start, stop, i in fused:
            text = word[start:stop]
            if text in self.vocab:
                out.append(Token(self.vocab[text], text, start, stop))
                continue
            parts = [self.vocab.get(_byte_token(b)) for b in text.encode()] if self.byte_fallback else [None]
            if None not in parts:
                out += [Token(p, _byte_token(b), start, stop) for p, b in zip(parts, text.encode())]
            elif self.unk_id is None:
                raise ValueError("an unknown piece, and the model has no unknown id")
            else:
                out.append(Token(self.unk_id, text, start, stop))
        return out


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def wordpiece_from_bpe(model: Bpe) -> WordPiece:
    return WordPiece(model.vocab, model.unk_token or "[UNK]", model.continuing_subword_prefix or "##")


def tokens_of_words(words: DataFrame, model: Model, word_col: str = "word") -> DataFrame:
    """A row for each token of each distinct word: word, pos, id, token, start, end.

    Only distinct words reach Python; join the result back on the word."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = shared.value.tokenize
        for batch in batches:
            rows = [(w, k, *t) for w in batch.column(0).to_pylist() for k, t in enumerate(tokenize(w))]
            columns = list(zip(*rows)) or [()] * 6
            types = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["word", "pos", "id", "token", "start", "end"])

    distinct = words.select(F.col(word_col).alias("word")).where(F.col("word").isNotNull()).distinct()
    return distinct.mapInArrow(each, "word string, pos int, id long, token string, start int, end int")


def token_totals(counts: DataFrame, model: Model) -> DataFrame:
    """Rows (id, token, n): how often each token occurs in all words of rows (word, count).

    Tokens are added up where their words are, so neither words nor tokens meet in a join."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = shared.value.tokenize
        for batch in batches:
            n: dict[tuple[int, str], int] = {}
            for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for t in tokenize(word):
                    n[t.id, t.value] = n.get((t.id, t.value), 0) + count
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in n], pa.int64()), pa.array([t for _, t in n], pa.string()), pa.array(n.values(), pa.int64())], names=["id", "token", "n"])

    words = counts.select("word", F.col("count").cast("long").alias("count")).where("word IS NOT NULL")
    return words.mapInArrow(each, "id long, token string, n long").groupBy("id", "token").agg(F.sum("n").alias("n"))


def sampled_tokens(rows: DataFrame, model: Model, key: list[str], words_col: str, seed: int = 0) -> DataFrame:
    """A row for each token of each word of each row: key, word, pos, id, token, drawn anew for each place.

    What is drawn depends on the seed, the row's key and the word's place alone: other partitions, batches or retries
    give the same.  Rows of one key share their draws.  Null words have no tokens."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    given = rows.select(*key, F.col(words_col).alias("__words"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*key).schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                keys = list(zip(*[batch.column(c).to_pylist() for c in key]))
                made = [(i, at, pos, t.id, t.value) for i, words in enumerate(batch.column("__words").to_pylist()) for at, w in enumerate(words or []) if w for pos, t in enumerate(shared.value.tokenize(w, Draws(seed, *keys[i], at)))]
                of, *columns = list(zip(*made)) or [()] * 5
                types = (pa.int32(), pa.int32(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(of, pa.int64())) for c in key], *[pa.array(c, t) for c, t in zip(columns, types)]], names=[*key, "word", "pos", "id", "token"])

    return given.mapInArrow(each, f"{schema}, word int, pos int, id long, token string")


def nbest_rows(model: Unigram, n: int):
    """A table function: (word) -> rows (rank, score, pieces) of its n best segmentations; equal scores go by the pieces."""

    class NBest:
        def eval(self, word: str):
            if word:
                for rank, (score, pieces) in enumerate(model.best_pieces(word, n), 1):
                    yield rank, score, pieces

    return F.udtf(NBest, returnType="rank int, score double, pieces array<string>")


def word_level_ids(words: DataFrame, vocab: DataFrame, unk_id: int, word_col: str = "word") -> DataFrame:
    """Adds ``id`` by a join with the vocabulary (token, id), which Catalyst broadcasts where it is small enough."""
    v = vocab.select(F.col("token").alias("__token"), F.col("id").alias("__id"))
    return words.join(v, words[word_col] == v["__token"], "left").withColumn("id", F.coalesce("__id", F.lit(unk_id))).drop("__token", "__id")


def bpe_by_replacement(words: DataFrame, merges: list[tuple[str, str]], word_col: str = "word") -> DataFrame:
    """Adds ``symbols``: the words merged by a chain of replacements in the JVM.

    For merge lists in training order and words without spaces; short lists, as each merge is an expression."""
    symbols = F.concat(F.lit(" "), F.array_join(F.split(F.col(word_col), ""), "  "), F.lit(" "))
    for a, b in merges:
        symbols = F.replace(symbols, F.lit(f" {a}  {b} "), F.lit(f" {a}{b} "))
    return words.withColumn("symbols", F.split(F.trim(symbols), "  "))


#: Words that a worker remembers, and the longest that it does.
CACHE_WORDS, CACHE_CHARS = 50_000, 256


@dataclass
class Remembering:
    """A model with the results of frequent words kept; random models keep none."""

    model: Model
    capacity: int = CACHE_WORDS
    kept: dict[str, list[Token]] = field(default_factory=dict)
    kept_ids: dict[str, list[int]] = field(default_factory=dict)

    def tokenize(self, word: str, rng: random.Random | None = None) -> list[Token]:
        found = self.kept.get(word)
        if found is None:
            found = self.model.tokenize(word)
            if self.capacity and len(word) <= CACHE_CHARS and not self.model.is_random:
                if len(self.kept) >= self.capacity:
                    self.clear()
                self.kept[word] = found
        return found

    def ids(self, word: str) -> list[int]:
        found = self.kept_ids.get(word)
        if found is None:
            found = self.model.ids_of(word)
            if self.capacity and len(word) <= CACHE_CHARS and not self.model.is_random:
                if len(self.kept_ids) >= self.capacity:
                    self.kept_ids.clear()
                self.kept_ids[word] = found
        return found

    def clear(self) -> None:
        self.kept.clear()
        self.kept_ids.clear()

    def resize(self, capacity: int) -> None:
        """Another capacity; what is kept beyond it goes."""
        self.capacity = capacity
        while len(self.kept) > capacity:
            self.kept.popitem()


def ids_of_lists(lists: pa.ListArray, kernel: Remembering) -> pa.ListArray:
    """Token ids of arrays of words; each distinct word of a batch is tokenized once, unless the model is random."""
    words, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    if kernel.model.is_random:
        distinct, codes = words.to_pylist(), np.arange(len(words))
    else:
        coded = words.dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
    made = [kernel.ids(w) if w else [] for w in [*distinct, None]]
    lengths = np.array([len(m) for m in made])
    flat, starts, lengths_of = np.array([i for m in made for i in m], np.int64), np.cumsum(lengths) - lengths, lengths[codes]
    ends = np.cumsum(lengths_of)
    ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[codes] - ends + lengths_of, lengths_of)]
    offsets = np.r_[0, ends][np.r_[0, np.cumsum(sizes)]].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int64()), mask=lists.is_null())
