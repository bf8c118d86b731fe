"""Lattices in arrays and suffixes in ranges, against one word at a time."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from textloom.functions.batches import gathered
from textloom.operators.lattices import PieceTrie, best_paths, by_length, expected_counts
from textloom.operators.models import Unigram
from textloom.operators.suffixes import repeated_substrings
from textloom.operators.trainers import UnigramTrainer, _digamma


def vocabulary(seed):
    rng = random.Random(seed)
    pieces = {"".join(rng.choice("abcé😀") for _ in range(rng.randint(1, 5))) for _ in range(40)} - {"c"}
    return ["<UNK>", *sorted(pieces)], np.r_[0.0, [-rng.random() * 5 - 1 for _ in pieces]]


def words(seed, n=200):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcé😀") for _ in range(rng.randint(1, 14))) for _ in range(n)]


def plain_model(pieces, scores):
    return Unigram(((pieces[0], float(scores[1:].min()) - 10), *zip(pieces[1:], scores[1:].tolist())), 0)


def test_expected_counts_and_best_paths_equal_word_by_word():
    for seed in range(5):
        pieces, scores = vocabulary(seed)
        trie, model = UnigramTrainer._trie(pieces, scores), plain_model(pieces, scores)
        texts, counts = words(seed), np.arange(1, 201)
        made, wanted = np.zeros(len(pieces)), np.zeros(len(pieces))
        for places, codes in by_length(texts, 64):
            made += expected_counts(trie, codes, counts[places])
            score, at, found = best_paths(trie, codes)
            for k, i in enumerate(places):
                best = model.best(texts[i])
                assert sorted(found[at == k].tolist()) == sorted(p or 0 for _, _, p in best)
        for text, n in zip(texts, counts):
            for i, e in model.marginals(text)[0].items():
                wanted[i] += n * e if i else 0
        assert np.allclose(made[1:], wanted[1:], rtol=1e-9, atol=1e-9)


def test_the_whole_word_can_be_left_out():
    pieces, scores = ["<UNK>", "a", "ab", "abc", "b", "c"], np.array([0, -2.0, -3.0, -1.0, -2.0, -2.5])
    trie = PieceTrie.of(pieces, scores)
    codes = np.array([[ord(c) for c in "abc"]])
    assert best_paths(trie, codes)[0][0] == -1.0 and best_paths(trie, codes, whole=False)[0][0] == -5.5
    assert sorted(best_paths(trie, codes, whole=False)[2].tolist()) == [2, 5]


def test_digamma():
    assert abs(float(_digamma(np.asarray(1.0))) + 0.5772156649015329) < 1e-8
    assert np.allclose(_digamma(np.array([0.5, 10.0])), [-1.9635100260214235, 2.251752589066721])


def plain_substrings(texts, longest):
    nexts, n = defaultdict(set), Counter()
    for w in texts:
        for at in range(len(w)):
            for k in range(2, min(longest, len(w) - at) + 1):
                nexts[w[at : at + k]].add(w[at + k : at + k + 1])
                n[w[at : at + k]] += 1
    return {p: n[p] for p in n if len(nexts[p]) > 1}


@pytest.mark.parametrize("stretches", [1, 2, 7, 40])
def test_repeated_substrings_equal_brute_force(spark, stretches):
    for longest in (3, 16):
        texts = sorted({*words(3, 150), "a" * 40, "ab" * 20, "x"})
        df = spark.createDataFrame([(w,) for w in texts], "word string")
        found = repeated_substrings(df, longest, stretches).collect()
        assert len(found) == len({r.piece for r in found})
        assert {r.piece: r.n for r in found} == plain_substrings(texts, longest)
    assert repeated_substrings(df.limit(0), 16).count() == 0


def plain_training(counts, trainer):
    """The same training, one word and piece at a time."""
    chars = Counter()
    for w, n in counts.items():
        for c in w:
            chars[c] += n
    seeds = [(c, float(n)) for c, n in chars.items()] + [(p, float(n * len(p))) for p, n in plain_substrings(counts, trainer.max_piece_length).items()]
    total = sum(s for _, s in seeds)
    pieces = [("<UNK>", math.nan)] + sorted(((p, math.log(s) - math.log(total)) for p, s in seeds), key=lambda x: (-x[1], x[0]))
    goal = int(trainer.vocab_size * 1.1)
    digamma = lambda x: float(_digamma(np.asarray(x)))
    model_of = lambda pieces: Unigram((("<UNK>", min(s for _, s in pieces[1:]) - 10), *pieces[1:]), 0)
    while True:
        for _ in range(trainer.n_sub_iterations):
            model, expected = model_of(pieces), Counter()
            for w, n in counts.items():
                for i, e in model.marginals(w)[0].items():
                    expected[i] += n * e
            kept = [(p, expected[i]) for i, (p, _) in enumerate(pieces) if i and expected[i] >= 0.5]
            whole = digamma(sum(e for _, e in kept))
            pieces = [pieces[0], *((p, digamma(e) - whole) for p, e in kept)]
        if len(pieces) <= goal:
            break
        model, uses = model_of(pieces), Counter()
        for w, n in counts.items():
            for _, _, i in model.best(w):
                uses[i] += n
        total = sum(uses.values())
        always, losses = [], []
        for i, (piece, score) in enumerate(pieces[1:], 1):
            if len(piece) == 1:
                always.append((piece, score))
                continue
            found = model.nbest(piece, 2)
            if found[0][1] != [(0, len(piece), i)] or not uses[i]:
                continue
            parts, n = [j for _, _, j in found[1][1]], uses[i]
            new = math.log(total + n * (len(parts) - 1))
            losses.append((n / total * (math.log(n) - math.log(total) - sum(math.log(uses[j] + n) - new for j in parts)), piece, score))
        losses.sort(key=lambda x: (-x[0], x[1]))
        size = max(goal, int(trainer.shrinking_factor * len(pieces)))
        kept = [pieces[0], *always, *((p, s) for _, p, s in losses[: max(0, size - len(always) - 1)])]
        if len(kept) >= len(pieces):
            break
        pieces = kept
    return trainer._finalised(pieces, sorted(chars))


def test_unigram_training_equals_one_word_at_a_time(spark):
    rng = random.Random(2)
    stems = ["run", "walk", "jump", "über", "play", "talk"]
    counts = Counter(chr(0x2581) + rng.choice(["", "re", "un"]) + rng.choice(stems) + rng.choice(["", "s", "ed", "ing", "er"]) for _ in range(3000))
    trainer = UnigramTrainer(45, special_tokens=("<s>",), unk_token="<unk>")
    made = trainer.train(spark.createDataFrame(list(counts.items()), "word string, count long").repartition(3))
    wanted = plain_training(dict(counts), trainer)
    assert [p for p, _ in made.pieces] == [p for p, _ in wanted.pieces] and len(made.pieces) == 45
    assert np.allclose([s for _, s in made.pieces], [s for _, s in wanted.pieces])


def test_sums_over_a_group_are_made_once(monkeypatch):
    """They are as long as the vocabulary, so making them for each place cost more than the lattices did."""
    pieces, scores = vocabulary(1)
    trie, calls, plain = UnigramTrainer._trie(pieces, scores), [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **b: calls.append(1) or plain(*a, **b))
    expected_counts(trie, np.array([[ord(c) for c in "abcabcabc"]] * 3), np.ones(3))
    assert len(calls) == 1


def test_batches_are_gathered():
    batches = [pa.RecordBatch.from_pydict({"x": [3 * i, 3 * i + 1, 3 * i + 2]}) for i in range(5)]
    made = list(gathered(iter(batches), 6))
    assert [b.num_rows for b in made] == [6, 6, 3] and [x for b in made for x in b.column("x").to_pylist()] == list(range(15))
