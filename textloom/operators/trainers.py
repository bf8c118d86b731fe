"""Trainers: vocabularies from a column of words, as Spark jobs.

Words are counted once by partial and final aggregation.  Word-level
vocabularies are one top-k.  Byte-pair merges are found in rounds, each of as
many merges as the segments between rare pairs tell (see ``pair_table``).  Unigram pieces are
estimated by expectation maximisation, each E-step one job over the distinct
words; only tables of the size of the vocabulary reach the driver.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.batches import gathered
from textloom.functions.chars import byte_alphabet
from textloom.functions.splitters import Splitter
from textloom.operators.lattices import PieceTrie, best_paths, by_length, expected_counts
from textloom.operators.models import Bpe, Unigram, WordLevel, WordPiece
from textloom.operators.pair_table import FIRST_JOINTS, MOST_JOINTS, SYMBOLS, WORD_COLUMNS, Words, first_pairs, merge_round, merges_in_order, pair_sums, segments
from textloom.operators.suffixes import repeated_substrings
from textloom.sources.tables import Checkpoints, tasks

log = logging.getLogger(__name__)

#: Words or pieces whose lattices are made together.
TOGETHER = 1 << 16


def _code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The word and the code point of each character."""
    texts = words.to_pylist()
    return np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)


def _characters(codes: np.ndarray) -> pa.Array:
    return pa.array([chr(c) for c in codes.tolist()], pa.string())


def number_of_words(counts: DataFrame) -> int:
    """How many distinct words a trainer is given."""
    return counts.count()


def word_counts(texts: DataFrame, text_col: str, splitter: Splitter | None = None, normalize: Column | None = None) -> DataFrame:
    """Rows (word, count) of a text column."""
    text = F.col(text_col) if normalize is None else normalize
    words = splitter.column(text) if splitter else F.array(text)
    return texts.select(F.explode(words).alias("word")).where(F.col("word") != "").groupBy("word").count()


def _numbered(tokens: DataFrame, order: list[Column], first: int) -> DataFrame:
    """Rows (token, id) numbered in order: sorted by ranges, numbered within each, and moved by what is before the range."""
    marked = Checkpoints(tokens.sparkSession).table(tokens.orderBy(*order).select("token", F.monotonically_increasing_id().alias("mark")))
    # a mark is the range's number and, in its last 33 bits, the place there
    ranges = sorted((r["range"], r["n"]) for r in marked.groupBy(F.shiftright("mark", 33).alias("range")).agg(F.count("*").alias("n")).collect())
    before = list(accumulate((n for _, n in ranges), initial=first))
    starts = tokens.sparkSession.createDataFrame([(r, b) for (r, _), b in zip(ranges, before)], "range long, start long")
    met = marked.withColumn("range", F.shiftright("mark", 33)).join(F.broadcast(starts), "range")
    return met.select("token", (F.col("start") + F.expr("mark & 8589934591")).alias("id"))


@dataclass(frozen=True)
class WordLevelTrainer:
    """The most frequent words; ``vocab_size`` None keeps all of them."""

    vocab_size: int | None = 30_000
    min_frequency: int = 0
    special_tokens: tuple[str, ...] = ()

    def vocab_table(self, counts: DataFrame) -> DataFrame:
        """Rows (token, id): special tokens, then words by falling count and rising text."""
        spark = counts.sparkSession
        top = counts.where(F.col("count") >= self.min_frequency)
        first = len(self.special_tokens)
        if self.vocab_size is None:
            numbered = _numbered(top.select(F.col("word").alias("token"), "count"), [F.desc("count"), F.col("token")], first)
        else:
            top = top.orderBy(F.desc("count"), "word").limit(max(0, self.vocab_size - first))
            # a window over the kept rows alone, whose number is the vocabulary's size
            numbered = top.select(F.col("word").alias("token"), (F.row_number().over(Window.orderBy(F.desc("count"), "word")) - 1 + first).cast("long").alias("id"))
        specials = spark.createDataFrame([(t, i) for i, t in enumerate(self.special_tokens)], "token string, id long")
        return specials.unionByName(numbered)

    def train(self, counts: DataFrame, unk_token: str = "<unk>") -> WordLevel:
        rows = sorted(self.vocab_table(counts).collect(), key=lambda r: r["id"])
        return WordLevel({r["token"]: r["id"] for r in rows}, unk_token)


@dataclass(frozen=True)
class BpeTrainer:
    vocab_size: int = 30_000
    min_frequency: int = 0
    special_tokens: tuple[str, ...] = ()
    limit_alphabet: int | None = None
    initial_alphabet: tuple[str, ...] = ()
    continuing_subword_prefix: str = ""
    end_of_word_suffix: str = ""
    max_token_length: int | None = None

    def character_counts(self, counts: DataFrame) -> DataFrame:
        """Rows (char, n): how often each character occurs in all words."""
        chars = counts.select(F.explode(F.split("word", "")).alias("char"), "count").where("char != ''")
        return chars.groupBy("char").agg(F.sum("count").alias("n"))

    def alphabet(self, counts: DataFrame) -> list[str]:
        """The kept characters in order of code points."""
        weights = self.character_counts(counts)
        if self.limit_alphabet is not None:
            forced = list(self.initial_alphabet)
            weights = weights.where(~F.col("char").isin(forced)) if forced else weights
            weights = weights.orderBy(F.desc("n"), "char").limit(max(0, self.limit_alphabet - len(forced)))
        return sorted({r["char"] for r in weights.collect()} | set(self.initial_alphabet))

    def character_pairs(self, counts: DataFrame) -> DataFrame:
        """Rows (a, b, n): how often each pair of characters occurs in all words."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                word, codes = _code_points(batch.column("word"))
                n = batch.column("count").to_numpy()
                pair, total = pair_sums(Words(n, codes.astype(np.int32), np.bincount(word, minlength=len(n))))
                yield pa.RecordBatch.from_pydict({"pair": pair, "n": total})

        pairs = counts.select("word", "count").mapInArrow(each, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pair = batch.column("pair").to_numpy()
                yield pa.RecordBatch.from_arrays([_characters(pair >> 32), _characters(pair & 0xFFFFFFFF), batch.column("n")], names=["a", "b", "n"])

        return pairs.mapInArrow(named, "a string, b string, n long")

    def _first_symbols(self, counts: DataFrame, alphabet: list[str], vocab: dict[str, int]) -> DataFrame:
        """Words as ids of their characters, marked by prefix and suffix; forms that are new get the next ids."""
        known = np.asarray([ord(c) for c in alphabet], np.int64)  # by code points
        prefix, suffix = self.continuing_subword_prefix, self.end_of_word_suffix

        def placed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            """The word of each character that is kept, and its form: four times its number, 1 if others are before it, 2 if none is behind."""
            word, codes = _code_points(batch.column("word"))
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            kept = known[at] == codes
            word, at = word[kept], at[kept]
            later, last = np.r_[False, word[1:] == word[:-1]], np.r_[word[1:] != word[:-1], True]
            return word, 4 * at + later[: len(at)] + 2 * last[: len(at)]

        def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"form": np.unique(placed(batch)[1]).astype(np.int64)})

        spoken = lambda form: (prefix if form & 1 else "") + alphabet[form >> 2] + (suffix if form & 2 else "")
        if prefix or suffix:
            found = counts.select("word").mapInArrow(forms, "form long").distinct().collect()
            for token in sorted({spoken(r["form"]) for r in found}):
                vocab.setdefault(token, len(vocab))
        ids = np.asarray([vocab.get(spoken(f), -1) for f in range(4 * len(alphabet))], np.int32)

        def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                word, form = placed(batch)
                n = batch.column("count").to_numpy()
                made = Words(n, ids[form], np.bincount(word, minlength=len(n)))
                yield made.some(made.lengths > 0).table()

        return counts.select("word", "count").mapInArrow(symbols, WORD_COLUMNS)

    def train(self, counts: DataFrame) -> Bpe:
        cuts = Checkpoints(counts.sparkSession)
        counts = cuts.table(counts.select("word", "count"))
        alphabet = self.alphabet(counts)
        vocab: dict[str, int] = {}
        for token in [*self.special_tokens, *alphabet]:
            vocab.setdefault(token, len(vocab))
        merges: list[tuple[str, str]] = []
        least = max(self.min_frequency, 1)
        if alphabet:
            words = cuts.table(self._first_symbols(counts, alphabet, vocab))
            # the special tokens and the characters are first symbols; a token's size is how many of them it is made of
            tokens, sizes = list(vocab), dict.fromkeys(vocab.values(), 1)
            pairs, wanted = cuts.table(first_pairs(words)), FIRST_JOINTS

        def admissible(a: int, b: int) -> bool:
            return self.max_token_length is None or sizes[a] + sizes[b] == 2 or sizes[a] + sizes[b] < self.max_token_length

        def made(a: int, b: int) -> tuple[int, bool] | None:
            if len(vocab) >= self.vocab_size:
                return None
            token = self._joined(tokens[a], tokens[b])
            # a token that exists already takes no new id, but its merge counts
            known = token in vocab
            if not known:
                vocab[token] = len(vocab)
                tokens.append(token)
            sizes[vocab[token]] = sizes[a] + sizes[b]
            merges.append((tokens[a], tokens[b]))
            return vocab[token], known

        while alphabet and len(vocab) < self.vocab_size:
            top = self._admissible(pairs.where(F.col("n") >= least), sizes).orderBy(F.desc("n"), "pair").limit(wanted).collect()
            if not top:
                break
            held = words
            while True:
                held = cuts.table(segments(held, [r["pair"] for r in top]))
                size = (held.agg(F.sum(F.octet_length("symbols"))).first()[0] or 0) // 4
                if size <= SYMBOLS or len(top) == 1:
                    break
                top = top[: max(1, len(top) // 2)]
            # beyond the last joint come pairs that are rarer, or as frequent with greater ids
            last = (-top[-1]["n"], top[-1]["pair"])
            chosen = merges_in_order(Words.of(held.toArrow()), last, admissible, made)
            wanted = min(MOST_JOINTS, len(top) * 2) if size <= SYMBOLS // 4 else len(top)
            round_ = cuts.table(merge_round(words, chosen))
            words = round_.where("symbols IS NOT NULL").select("count", "symbols")
            pairs = round_.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n"))
            log.info("%d of %d tokens, %d joints, %d symbols, %d merges", len(vocab), self.vocab_size, len(top), size, len(chosen))
        cuts.drop()
        return Bpe(vocab, tuple(merges), continuing_subword_prefix=self.continuing_subword_prefix or None, end_of_word_suffix=self.end_of_word_suffix or None)

    def _joined(self, a: str, b: str) -> str:
        return a + b[len(self.continuing_subword_prefix) :]

    def _admissible(self, pairs: DataFrame, sizes: dict[int, int]) -> DataFrame:
        """Pairs that may be merged: of first symbols always, of those that merges give rise to only the shorter ones."""
        if self.max_token_length is None:
            return pairs
        table = pairs.sparkSession.createDataFrame(pa.table({"id": pa.array(list(sizes), pa.int64()), "size": pa.array(list(sizes.values()), pa.int64())}))
        side = lambda name, key: (F.broadcast(table.select(F.col("id").alias(f"id_{name}"), F.col("size").alias(name))), key == F.col(f"id_{name}"))
        sized = pairs.join(*side("first", F.shiftright("pair", 32))).join(*side("second", F.expr("pair & 4294967295")))
        length = F.col("first") + F.col("second")
        return sized.where((length == 2) | (length < self.max_token_length)).select("pair", "n")


@dataclass(frozen=True)
class WordPieceTrainer:
    """A byte-pair trainer with marked continuations; the merges are dropped."""

    vocab_size: int = 30_000
    min_frequency: int = 0
    special_tokens: tuple[str, ...] = ()
    limit_alphabet: int | None = None
    initial_alphabet: tuple[str, ...] = ()
    continuing_subword_prefix: str = "##"
    end_of_word_suffix: str = ""
    max_token_length: int | None = None

    def train(self, counts: DataFrame, unk_token: str = "[UNK]") -> WordPiece:
        found = BpeTrainer(**vars(self)).train(counts)
        return WordPiece(found.vocab, unk_token, self.continuing_subword_prefix)


def _digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence to large arguments, then the asymptotic series."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    while (small := x < 7).any():
        out -= np.where(small, 1 / x, 0.0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def _by_falling(values: np.ndarray, names: list[str]) -> np.ndarray:
    """Places by falling value, ties by name in order of code points."""
    return pc.sort_indices(pa.table({"value": pa.array(values, pa.float64()), "name": pa.array(names, pa.string())}), sort_keys=[("value", "descending"), ("name", "ascending")]).to_numpy()


@dataclass(frozen=True)
class UnigramTrainer:
    vocab_size: int = 8000
    n_sub_iterations: int = 2
    shrinking_factor: float = 0.75
    special_tokens: tuple[str, ...] = ()
    initial_alphabet: tuple[str, ...] = ()
    unk_token: str | None = None
    max_piece_length: int = 16
    seed_size: int = 1_000_000

    def seeds(self, counts: DataFrame) -> DataFrame:
        """Rows (piece, score): every character by its weighted count, and repeated substrings by count times length.

        A substring counts where it has at least two different right neighbours."""
        chars = counts.select(F.explode(F.split("word", "")).alias("piece"), "count").where("piece != ''").groupBy("piece").agg(F.sum("count").cast("double").alias("score"))
        repeated = repeated_substrings(counts, self.max_piece_length)
        top = repeated.select("piece", (F.col("n") * F.length("piece")).cast("double").alias("score")).orderBy(F.desc("score"), F.desc("piece"))
        return chars.unionByName(top.limit(self.seed_size))

    def train(self, counts: DataFrame) -> Unigram:
        cuts = Checkpoints(counts.sparkSession)
        counts = cuts.spread(counts.select("word", "count").where("word != ''"), "word")
        seeds = self.seeds(counts).toArrow()  # at most seed_size and the alphabet
        names, score = seeds.column("piece").to_pylist(), seeds.column("score").to_numpy()
        required = sorted({p for p in names if len(p) == 1} | set(self.initial_alphabet))
        logs = np.log(score) - np.log(score.sum() or 1.0)
        order = _by_falling(logs, names)
        pieces, scores = ["<UNK>", *(names[i] for i in order.tolist())], np.r_[np.nan, logs[order]]
        goal = max(int(self.vocab_size * 1.1), 1)
        while True:
            for _ in range(self.n_sub_iterations):
                kept, scores = self._maximised(self._expected(counts, self._trie(pieces, scores)))
                pieces = [pieces[i] for i in kept]
            log.info("%d pieces, %d wanted", len(pieces), goal)
            if len(pieces) <= goal:
                break
            kept = self._kept(counts, pieces, scores, goal)
            if len(kept) >= len(pieces):
                break
            pieces, scores = [pieces[i] for i in kept], scores[kept]
        cuts.drop()
        return self._finalised(list(zip(pieces, scores.tolist())), required)

    @staticmethod
    def _trie(pieces: list[str], scores: np.ndarray) -> PieceTrie:
        least = scores[1:].min(initial=0.0) if len(scores) > 1 else 0.0
        return PieceTrie.of(pieces, np.r_[least - 10, scores[1:]])

    def _summed(self, counts: DataFrame, trie: PieceTrie, of: Callable[[PieceTrie, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """A number for each piece: summed over groups of words in a task, then over tasks."""
        shared = counts.sparkSession.sparkContext.broadcast(trie)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(shared.value.scores))
            for batch in gathered(batches, TOGETHER):
                n = batch.column("count").to_numpy()
                for places, codes in by_length(batch.column("word").to_pylist()):
                    sums += of(shared.value, codes, n[places])
            ids = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"id": ids, "n": sums[ids]})

        rows = counts.select("word", "count").mapInArrow(each, "id long, n double").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(len(trie.scores))
        out[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
        shared.destroy()
        return out

    def _expected(self, counts: DataFrame, trie: PieceTrie) -> np.ndarray:
        return self._summed(counts, trie, expected_counts)

    @staticmethod
    def _maximised(expected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pieces stay, and their new scores; the first stays always, without one."""
        kept = np.flatnonzero(expected >= 0.5)
        kept = kept[kept > 0]
        scores = _digamma(expected[kept]) - _digamma(np.asarray(expected[kept].sum() or 1.0))
        return np.r_[0, kept], np.r_[np.nan, scores]

    def _kept(self, counts: DataFrame, pieces: list[str], scores: np.ndarray, goal: int) -> np.ndarray:
        """Which pieces stay when those go whose absence costs the least likelihood."""
        trie = self._trie(pieces, scores)

        def used(trie: PieceTrie, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
            _, words, found = best_paths(trie, codes)
            return np.bincount(found, n[words], minlength=len(trie.scores))

        uses = self._summed(counts, trie, used)
        shared = counts.sparkSession.sparkContext.broadcast((trie, uses))

        def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """What the likelihood loses without a piece; infinite for one of a character, none for one that is not its own best segmentation or unused."""
            trie, uses = shared.value
            total = uses.sum() or 1.0
            for batch in gathered(batches, TOGETHER):
                ids, loss = batch.column("id").to_numpy(), np.full(batch.num_rows, np.nan)
                for places, codes in by_length(batch.column("piece").to_pylist()):
                    own = trie.scores[ids[places]]
                    if codes.shape[1] == 1:
                        loss[places] = np.inf
                        continue
                    score, words, parts = best_paths(trie, codes, whole=False)
                    n = uses[ids[places]]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        new_total = np.log(total + n * (np.bincount(words, minlength=len(places)) - 1))
                        instead = np.bincount(words, np.log(uses[parts] + n[words]) - new_total[words], minlength=len(places))
                        lost = n / total * (np.log(n) - np.log(total) - instead)
                    loss[places] = np.where((own >= score) & (n > 0), lost, np.nan)
                yield pa.RecordBatch.from_pydict({"id": ids, "loss": loss})

        given = counts.sparkSession.createDataFrame(pa.table({"id": pa.array(range(1, len(pieces)), pa.int64()), "piece": pa.array(pieces[1:], pa.string())}))
        rows = given.repartition(tasks(given.sparkSession), "id").mapInArrow(losses, "id long, loss double").where(~F.isnan("loss")).toArrow()
        shared.destroy()
        ids, loss = rows.column("id").to_numpy(), rows.column("loss").to_numpy()
        always, ids, loss = np.sort(ids[np.isinf(loss)]), ids[~np.isinf(loss)], loss[~np.isinf(loss)]
        others = _by_falling(loss, [pieces[i] for i in ids.tolist()])
        size = max(goal, int(self.shrinking_factor * len(pieces)))
        return np.r_[0, always, ids[others[: max(0, size - len(always) - 1)]]].astype(np.int64)

    def _finalised(self, pieces: list[tuple[str, float]], required: list[str]) -> Unigram:
        scores, least = dict(pieces[1:]), min((s for _, s in pieces[1:]), default=0.0)
        chosen = {c: scores.get(c, least - 0.0001 * k) for k, c in enumerate(required, 1)}
        specials = list(self.special_tokens)
        front = [self.unk_token] if self.unk_token and self.unk_token not in specials else []
        front += specials
        room = self.vocab_size - len(front)
        for piece, score in sorted(pieces[1:], key=lambda x: (-x[1], x[0])):
            if len(chosen) >= room:
                break
            chosen.setdefault(piece, score)
        rest = sorted(((p, s) for p, s in chosen.items() if p not in front), key=lambda x: (-x[1], x[0]))
        unk = front.index(self.unk_token) if self.unk_token else None
        return Unigram(tuple([(p, 0.0) for p in front] + rest), unk)


def byte_level_alphabet() -> tuple[str, ...]:
    """The printable characters of all bytes, to force into a byte-level vocabulary."""
    return tuple(sorted(byte_alphabet()))

