"""Folding against the enumeration of all structures of short sequences."""

import random
from functools import cache
from itertools import product

import numpy as np
import pytest

from aptaflow.functions import folding
from aptaflow.operators import structure


@cache
def structures(i, j):
    if j < i:
        return [()]
    out = list(structures(i + 1, j))
    for k in range(i + folding.MIN_HAIRPIN + 1, j + 1):
        out += [((i, k), *a, *b) for a in structures(i + 1, k - 1) for b in structures(k + 1, j)]
    return out


def energy(e, pairs, n):
    def inside(i, j):
        within = [p for p in pairs if i < p[0] and p[1] < j]
        return [p for p in within if not any(q[0] < p[0] and p[1] < q[1] for q in within)]

    total = sum(e.outer(*p) for p in inside(-1, n))
    for i, j in pairs:
        own = inside(i, j)
        total += e.hairpin(i, j) if not own else e.interior(i, j, *own[0]) if len(own) == 1 else e.closing(i, j) + sum(e.branch(*p) for p in own)
    return float(total)


def dangling(e, pairs, n):
    """The energy with dangles 1: over all ways in which free bases dangle on one branch each."""

    def loop(branches, closing):
        held = {x for p in pairs for x in p}
        best = [(0.0, frozenset())]
        ends = [(p, e.branch if closing else e.outer, p[0] - 1, p[1] + 1) for p in branches] + ([(closing, e.closing, closing[1] - 1, closing[0] + 1)] if closing else [])
        for p, cost, a, b in ends:
            now = []
            for total, used in best:
                for x, y in product((False, True), repeat=2):
                    more = ({a} if x else set()) | ({b} if y else set())
                    if any(z < 0 or z >= n or z in held or z in used for z in more) or len(more) < x + y:
                        continue
                    now.append((total + float(cost(*p, x, y)), used | more))
            best = now
        return min(best)[0]

    def inside(i, j):
        within = [p for p in pairs if i < p[0] and p[1] < j]
        return [p for p in within if not any(q[0] < p[0] and p[1] < q[1] for q in within)]

    total = loop(inside(-1, n), None)
    for i, j in pairs:
        own = inside(i, j)
        total += float(e.hairpin(i, j)) if not own else float(e.interior(i, j, *own[0])) if len(own) == 1 else loop(own, (i, j))
    return total


@pytest.mark.parametrize("n", [8, 13, 16])
def test_single_dangles_against_enumeration(n):
    rng = random.Random(n)
    sequences = ["".join(rng.choice("GGCCAU") for _ in range(n)) for _ in range(6)]
    if n == 16:
        sequences += ["GGGAAACCGAAAGCCC"[:n], "GAGAAACAGAAACUUC"]
    for s, (text, kcal) in zip(sequences, folding.mfe(sequences, 1), strict=True):
        e = folding.Energies(folding.coded([s])[:, 0], 1)
        every = [x for x in structures(0, n - 1) if all(e.type(i, j) >= 0 for i, j in x)]
        least = min(dangling(e, x, n) for x in every)
        assert kcal * 100 == pytest.approx(least, abs=1e-3)
        assert dangling(e, pairs_of(text), n) == pytest.approx(least)


def test_multiple_loops_against_enumeration(monkeypatch):
    """Cheap multiple loops, so that they carry weight."""
    monkeypatch.setattr(folding, "CLOSING", -900)
    for dangles in (0, 1, 2):
        for s in ("GGAAACGAAACC", "GGCAAAGGCAAAGCAC", "GCGAAACAGAAACAGC"):
            n = len(s)
            e = folding.Energies(folding.coded([s])[:, 0], dangles)
            every = [x for x in structures(0, n - 1) if all(e.type(i, j) >= 0 for i, j in x)]
            cost = dangling if dangles == 1 else energy
            energies = np.array([cost(e, x, n) for x in every])
            text, kcal = folding.mfe([s], dangles)[0]
            assert kcal * 100 == pytest.approx(energies.min(), abs=1e-3) and cost(e, pairs_of(text), n) == pytest.approx(energies.min())
            if dangles != 1:
                weight = np.exp(-energies / folding.KT)
                pairs, profile = folding.probabilities([s], dangles)
                want = np.zeros((n, n))
                for x, w in zip(every, weight, strict=True):
                    for i, j in x:
                        want[i, j] += w / weight.sum()
                assert np.allclose(want, pairs[0], atol=1e-9)
                assert np.allclose(profile[0].sum(axis=0) + pairs[0].sum(axis=0) + pairs[0].sum(axis=1), 1)


def test_small_loops():
    """1 x 1 loops read the same from both ends; some published energies."""
    t = folding._SMALL
    assert all((t[i, j] == t[j, i].T).all() for i in range(6) for j in range(6))
    assert t[0, 1].tolist() == [[40, -40, 40, 40], [30, 50, 40, 50], [-10, 40, -170, 40], [40, 0, 40, -30]]
    assert t[0, 0, 2, 2] == -140 and t[0, 4, 2, 2] == -100 and t[2, 3, 2, 2] == -40 and t[4, 5, 3, 3] == 150 and t[5, 3, 0, 1] == 170


def test_long_sequences_do_not_overflow(monkeypatch):
    monkeypatch.setattr(folding, "LONG", 10)
    s = "GGGAGACAAGAAUAAACGCUCAACAAACAACAG"
    (wide, _), (plain, _) = folding.probabilities([s]), (monkeypatch.undo(), folding.probabilities([s]))[1]
    assert np.allclose(wide, plain)


def pairs_of(text):
    out, held = [], []
    for i, c in enumerate(text):
        if c == "(":
            held.append(i)
        elif c == ")":
            out.append((held.pop(), i))
    assert not held
    return out


@pytest.mark.parametrize(("n", "dangles"), [(5, 2), (12, 2), (14, 0), (15, 2)])
def test_against_enumeration(n, dangles):
    rng = random.Random(n)
    sequences = ["".join(rng.choice("GGCCAU") for _ in range(n)) for _ in range(8)]
    best, (pairs, profile) = folding.mfe(sequences, dangles), folding.probabilities(sequences, dangles)
    for b, s in enumerate(sequences):
        e = folding.Energies(folding.coded([s])[:, 0], dangles)
        every = [x for x in structures(0, n - 1) if all(e.type(i, j) >= 0 for i, j in x)]
        energies = np.array([energy(e, x, n) for x in every])
        assert best[b][1] * 100 == pytest.approx(energies.min(), abs=1e-3)
        assert energy(e, pairs_of(best[b][0]), n) == pytest.approx(energies.min())
        weight = np.exp(-energies / folding.KT)
        want = np.zeros((n, n))
        for x, w in zip(every, weight, strict=True):
            for i, j in x:
                want[i, j] += w / weight.sum()
        assert np.allclose(want, pairs[b], atol=1e-9)
        assert np.allclose(profile[b].sum(axis=0) + pairs[b].sum(axis=0) + pairs[b].sum(axis=1), 1)


def test_longer_sequences_are_sound():
    s = "GGGAGACAAGAATAAACGCTCAACAAACAACAGTACGTAGCATGCATGC"
    (text, energy_), (pairs, profile) = folding.mfe([s])[0], folding.probabilities([s])
    assert energy_ <= 0 and len(text) == len(s) and pairs_of(text)
    assert (pairs.sum(axis=1) + pairs.sum(axis=2)).max() <= 1 + 1e-9 and profile.min() >= 0


def test_operators(spark):
    df = spark.createDataFrame([("GGGAAAUCCC",), ("GGGAAAUCCC",), ("AAAA",), ("ACGTN",), (None,)], "s string")
    rows = {r.sequence: r for r in structure.mfe(df, "s").collect()}
    assert set(rows) == {"GGGAAAUCCC", "AAAA"} and rows["GGGAAAUCCC"].structure == "(((....)))" and rows["AAAA"].mfe == 0.0
    assert {r.sequence: len(r.bppm) for r in structure.bppm(df, "s").collect()} == {"GGGAAAUCCC": 45, "AAAA": 6}
    assert {r.sequence: len(r.profile) for r in structure.profiles(df, "s").collect()} == {"GGGAAAUCCC": 50, "AAAA": 20}
