"""Lattices of many words at once: pieces of words of equal length in arrays.

The pieces are a trie of sorted transitions (state, character) -> state, which
is looked up for all words and starts of a batch together.  Scores are summed
along the words in the same order as ``Unigram`` does, word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textloom.operators.models import UNKNOWN_PENALTY

_BITS = 21  # of a code point


@dataclass(frozen=True)
class PieceTrie:
    """Sorted keys (state << 21 | character) with the states they lead to; the piece (or -1) at each state; scores."""

    keys: np.ndarray
    targets: np.ndarray
    pieces: np.ndarray
    scores: np.ndarray
    unknown_score: float
    longest: int

    @staticmethod
    def of(pieces: list[str], scores: np.ndarray) -> PieceTrie:
        """Piece 0 stands for what is unknown: it is never found, and its score counts for the least one alone."""
        ids = np.asarray([i for i, p in enumerate(pieces) if i and p], np.int64)
        # UTF-8 sorts like code points
        ids = ids[pc.sort_indices(pa.array([pieces[i] for i in ids.tolist()], pa.string())).to_numpy()]
        texts = [pieces[i] for i in ids.tolist()]
        lengths = np.asarray([len(t) for t in texts], np.int64)
        longest = int(lengths.max(initial=0))
        codes = np.zeros((len(ids), longest), np.int64)
        codes[np.arange(longest) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64) + 1  # 0: behind the end
        state, states = np.zeros(len(ids), np.int64), 1
        keys, targets, at_state = [], [], [np.full(1, -1, np.int64)]
        differs = np.zeros(len(ids), bool)
        if len(ids):
            differs[0] = True
        for level in range(longest):
            differs[1:] |= codes[1:, level] != codes[:-1, level]
            inside = lengths > level
            new = differs & inside
            here = states - 1 + np.cumsum(new)
            keys.append((state[new] << _BITS) | (codes[new, level] - 1))
            targets.append(here[new])
            state = np.where(inside, here, state)
            ends = np.full(int(new.sum()), -1, np.int64)
            last = lengths == level + 1
            ends[state[last] - states] = ids[last]
            at_state.append(ends)
            states += int(new.sum())
        keys, targets = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, targets))
        sort = np.argsort(keys)
        return PieceTrie(keys[sort], targets[sort], np.concatenate(at_state), np.asarray(scores, float), float(np.min(scores)) - UNKNOWN_PENALTY, longest)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next states, or -1."""
        if not len(self.keys):
            return np.full(len(state), -1, np.int64)
        key = (state << _BITS) | code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], -1)

    def edges(self, codes: np.ndarray, start: int, whole: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, words, pieces, scores) of all pieces that begin at a place; an unknown one (-1) where no single character is a piece.

        Without ``whole`` the piece that is the whole word is left out."""
        n = codes.shape[1]
        words, state = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        single = np.zeros(len(codes), bool)
        for length in range(1, min(self.longest, n - start) + 1):
            state = self.step(state, codes[:, start + length - 1][words])
            going = state >= 0
            words, state = words[going], state[going]
            if not len(words):
                break
            piece = self.pieces[state]
            found = piece >= 0
            if length == 1:
                single[words[found]] = True
            if found.any() and (whole or length < n):
                yield length, words[found], piece[found], self.scores[piece[found]]
        if not single.all():
            rest = np.flatnonzero(~single)
            yield 1, rest, np.full(len(rest), -1), np.full(len(rest), self.unknown_score)


def by_length(words: list[str], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of words of one length, of at most ``most`` characters or one word: places in the list, and code points."""
    lengths = np.asarray([len(w) for w in words])
    for n in np.unique(lengths):
        if not n:
            continue
        places = np.flatnonzero(lengths == n)
        size = max(1, most // int(n))
        for first in range(0, len(places), size):
            some = places[first : first + size]
            yield some, np.frombuffer("".join(words[i] for i in some).encode("utf-32-le"), np.uint32).reshape(len(some), n).astype(np.int64)


def expected_counts(trie: PieceTrie, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, over all their segmentations."""
    m, n = codes.shape
    codes = np.asfortranarray(codes)  # a place of all words at once
    alpha, beta = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
    alpha[0] = beta[n] = 0.0
    held = []
    for start in range(n):
        held.append(list(trie.edges(codes, start)))
        for length, words, _, score in held[-1]:
            there = alpha[start + length]
            there[words] = np.logaddexp(there[words], alpha[start][words] + score)
    # summed once for all places: the sums are as long as the vocabulary
    pieces, shares = [np.zeros(0, np.int64)], [np.zeros(0)]
    for start in range(n - 1, -1, -1):
        here = beta[start]
        for length, words, piece, score in held[start]:
            behind = score + beta[start + length][words]
            here[words] = np.logaddexp(here[words], behind)
            if piece[0] >= 0:
                pieces.append(piece)
                shares.append(np.exp(alpha[start][words] + behind - alpha[n][words]) * counts[words])
        held[start] = None
    return np.bincount(np.concatenate(pieces), np.concatenate(shares), minlength=len(trie.scores))


def best_paths(trie: PieceTrie, codes: np.ndarray, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best segmentations: scores, and rows (word, piece) in no order; an unknown piece is 0."""
    m, n = codes.shape
    codes = np.asfortranarray(codes)
    score = np.full((n + 1, m), -np.inf)
    score[0] = 0.0
    length_of, piece_of = np.zeros((n + 1, m), np.int64), np.zeros((n + 1, m), np.int64)
    for start in range(n):
        for length, words, piece, s in trie.edges(codes, start, whole):
            made = score[start][words] + s
            better = made > score[start + length][words]
            w = words[better]
            score[start + length][w] = made[better]
            length_of[start + length][w], piece_of[start + length][w] = length, np.maximum(piece[better], 0)
    at, words, pieces = np.full(m, n), [], []
    going = np.arange(m)
    while len(going):
        words.append(going)
        pieces.append(piece_of[at[going], going])
        at[going] -= length_of[at[going], going]
        going = going[at[going] > 0]
    return score[n], np.concatenate(words), np.concatenate(pieces)
