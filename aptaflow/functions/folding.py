"""RNA secondary structure of many sequences of one length at once.

One recursion serves two algebras: least energy (minimum, plus) and partition function (plus, times). Every cell (i, j) holds
an array over the batch of sequences, so that the loops over places are shared by all of them. From the partition function and
its outside counterpart come pair probabilities and, for each place, the chance to be unpaired in a hairpin, bulge, interior or
multiple loop or outside all pairs.

Energies are in 0.01 kcal/mol at 37 degrees (nearest-neighbour parameters of 1999). dangles: 0 none; 2 on both sides of every
branch; 1 a base dangles on one branch at most, and only where that pays (least energy alone: the partition function takes 2
instead). Interior loops of 1 x 1 bases have the published energies; those of 1 x 2 and 2 x 2 bases take the general formula,
as their tables are not at hand: an approximation. Partition functions of long sequences are kept in extended precision, whose
range of exponents a few ten thousand bases do not leave.
"""

from __future__ import annotations

import math

import numpy as np

# Fixed values, in the order CG, GC, GU, UG, AU, UA and A, C, G, U.
PAIRS = ["CG", "GC", "GU", "UG", "AU", "UA"]
STACK = "-240 -330 -210 -140 -210 -210  -330 -340 -250 -150 -220 -240  -210 -250 130 -50 -140 -130  -140 -150 -50 30 -60 -100  -210 -220 -140 -60 -110 -90  -210 -240 -130 -100 -90 -130"
HAIRPIN = "0 0 0 570 560 560 540 590 560 640 650 660 670 678 686 694 701 707 713 719 725 730 735 740 744 749 753 757 761 765 769"
BULGE = "0 380 280 320 360 400 440 459 470 480 490 500 510 519 527 534 541 548 554 560 565 571 576 580 585 589 594 598 602 605 609"
INTERIOR = "0 0 410 510 170 180 200 220 230 240 250 260 270 278 286 294 301 307 313 319 325 330 335 340 345 349 353 357 361 365 369"
MISMATCH_HAIRPIN = [
    "-150 -150 -140 -180  -100 -90 -290 -80  -220 -200 -160 -110  -170 -140 -180 -200",
    "-110 -150 -130 -210  -110 -70 -240 -50  -240 -290 -140 -120  -190 -100 -220 -150",
    "20 -50 -30 -30  -10 -20 -150 -20  -90 -110 -30 0  -30 -30 -40 -110",
    "-50 -30 -60 -50  -20 -10 -170 0  -80 -120 -30 -70  -60 -10 -60 -80",
    "-30 -50 -30 -30  -10 -20 -150 -20  -110 -120 -20 20  -30 -30 -60 -110",
    "-50 -30 -60 -50  -20 -10 -120 0  -140 -120 -70 -20  -30 -10 -50 -80",
]
DANGLE_5 = "-50 -30 -20 -10  -20 -30 0 0  -30 -30 -40 -20  -30 -10 -20 -20  -30 -30 -40 -20  -30 -10 -20 -20"
DANGLE_3 = "-110 -40 -130 -60  -170 -80 -170 -120  -70 -10 -70 -10  -80 -50 -80 -60  -70 -10 -70 -10  -80 -50 -80 -60"
TETRALOOPS = "GGGGAC GGUGAC CGAAAG GGAGAC CGCAAG GGAAAC CGGAAG CUUCGG CGUGAG CGAAGG CUACGG GGCAAC CGCGAG UGAGAG CGAGAG AGAAAU CGUAAG CUAACG UGAAAG GGAAGC GGGAAC UGAAAA AGCAAU AGUAAU CGGGAG AGUGAU GGCGAC GGGAGC GUGAAC UGGAAA"
TETRALOOP_BONUS = [-300] * 9 + [-250] * 5 + [-200] * 5 + [-150] * 11
TERMINAL, CLOSING, BRANCH, LONGEST, MIN_HAIRPIN, NINIO, MAX_NINIO, EXTRAPOLATION, KT = 50, 340, 40, 30, 3, 50, 300, 107.856, 310.15 * 1.98717 / 10
#: Interior loops of 1 x 1 bases by the number of pairs that end in A-U or G-U; with G opposite G.
SMALL_LOOP, SMALL_LOOP_GG = (40, 110, 170), (-140, -100, -40)
# Those that depart from it, (pair, reversed other pair, base, opposite base): energy.
SMALL_LOOP_CG_GC = [40, -40, 40, 40, 30, 50, 40, 50, -10, 40, -170, 40, 40, 0, 40, -30]
SMALL_LOOP_OTHERS = {("CG", "CG", "A", "A"): 110, ("GC", "GC", "A", "A"): 80, ("GC", "GC", "G", "G"): -210, ("GC", "GC", "U", "U"): -70, ("GC", "AU", "U", "U"): 100, ("AU", "AU", "U", "U"): 120, ("AU", "UA", "U", "U"): 150, ("UA", "UA", "U", "U"): 180}
#: Sequences from this length on are summed in extended precision.
LONG = 600


def _numbers(text: str, *shape: int) -> np.ndarray:
    return np.array(text.split(), np.float64).reshape(*shape)


_STACK = _numbers(STACK, 6, 6)
_HAIRPIN, _BULGE, _INTERIOR = _numbers(HAIRPIN, -1), _numbers(BULGE, -1), _numbers(INTERIOR, -1)
_MISMATCH_H = np.stack([_numbers(x, 4, 4) for x in MISMATCH_HAIRPIN])
_D5, _D3 = _numbers(DANGLE_5, 6, 4), _numbers(DANGLE_3, 6, 4)
_END = np.array([0, 0, TERMINAL, TERMINAL, TERMINAL, TERMINAL], np.float64)
# GA and AG mismatches gain 110, UU 70; pairs other than CG and GC lose 70
_MISMATCH_I = np.where(np.arange(6) < 2, 0.0, 70.0)[:, None, None] + np.zeros((6, 4, 4))
_MISMATCH_I[:, 0, 2] -= 110
_MISMATCH_I[:, 2, 0] -= 110
_MISMATCH_I[:, 3, 3] -= 70
_REVERSED = np.array([1, 0, 3, 2, 5, 4])
_TYPE = np.full((4, 4), -1)
for _t, _p in enumerate(PAIRS):
    _TYPE["ACGU".index(_p[0]), "ACGU".index(_p[1])] = _t


def _small_loops() -> np.ndarray:
    weak = (np.arange(6) > 1).astype(int)
    kinds = weak[:, None] + weak[None]
    out = np.array(SMALL_LOOP, np.float64)[kinds][:, :, None, None] + np.zeros((6, 6, 4, 4))
    out[:, :, 2, 2] = np.array(SMALL_LOOP_GG)[kinds]
    out[0, 1] = np.array(SMALL_LOOP_CG_GC).reshape(4, 4)
    for (one, two, x, y), e in SMALL_LOOP_OTHERS.items():
        out[PAIRS.index(one), PAIRS.index(two), "ACGU".index(x), "ACGU".index(y)] = e
    # the loop read from its other end is the same loop
    for i in range(6):
        for j in range(i):
            out[i, j] = out[j, i].T
    return out


_SMALL = _small_loops()


def coded(sequences: list[str]) -> np.ndarray:
    """Places by batch, A C G U (T) as 0 to 3; other letters raise."""
    table = {c: i for i, c in enumerate("ACGU")} | {"T": 3}
    return np.array([[table[c] for c in s.upper()] for s in sequences], np.int64).reshape(len(sequences), -1).T


def _long(table: np.ndarray, n: int) -> float:
    return float(table[n]) if n <= LONGEST else float(table[LONGEST]) + EXTRAPOLATION * math.log(n / LONGEST)


class Energies:
    """Loop energies of a batch (places by batch), or of one sequence (places)."""

    def __init__(self, codes: np.ndarray, dangles: int = 2):
        self.c, self.n, self.dangles = codes, len(codes), dangles
        self.bonus = {tuple(coded([x])[:, 0].tolist()): e for x, e in zip(TETRALOOPS.split(), TETRALOOP_BONUS, strict=True)}

    def type(self, i: int, j: int):
        return _TYPE[self.c[i], self.c[j]]

    def hairpin(self, i: int, j: int):
        t, n = self.type(i, j), j - i - 1
        e = _long(_HAIRPIN, n)
        if n == 3:
            return e + _END[t]
        e = e + _MISMATCH_H[t, self.c[i + 1], self.c[j - 1]]
        if n == 4:
            loop = self.c[i : j + 1]
            for key, extra in self.bonus.items():
                e = e + extra * (loop == np.array(key).reshape(-1, *[1] * (loop.ndim - 1))).all(axis=0)
        return e

    def interior(self, i: int, j: int, p: int, q: int):
        t, back = self.type(i, j), _REVERSED[self.type(p, q)]
        a, b = p - i - 1, j - q - 1
        if not a and not b:
            return _STACK[t, back]
        if not a or not b:
            n = a + b
            return _long(_BULGE, n) + (_STACK[t, back] if n == 1 else _END[t] + _END[back])
        x, y = self.c[i + 1], self.c[j - 1]
        if a == b == 1:
            return _SMALL[t, back, x, y]
        return _long(_INTERIOR, a + b) + min(MAX_NINIO, NINIO * abs(a - b)) + _MISMATCH_I[t, x, y] + _MISMATCH_I[back, self.c[q + 1], self.c[p - 1]]

    def _stem(self, t, left: int | None, right: int | None):
        e = _END[t]
        if left is not None:
            e = e + _D5[t, self.c[left]]
        if right is not None:
            e = e + _D3[t, self.c[right]]
        return e

    def _sides(self, i: int, j: int) -> tuple[int | None, int | None]:
        return (i - 1 if i and self.dangles == 2 else None, j + 1 if j + 1 < self.n and self.dangles == 2 else None)

    def outer(self, i: int, j: int, left: bool = False, right: bool = False):
        """A branch outside; left, right: the base beside it dangles though dangles is not 2."""
        sides = self._sides(i, j)
        return self._stem(self.type(i, j), i - 1 if left else sides[0], j + 1 if right else sides[1])

    def branch(self, i: int, j: int, left: bool = False, right: bool = False):
        return BRANCH + self.outer(i, j, left, right)

    def closing(self, i: int, j: int, left: bool = False, right: bool = False):
        """The pair that closes a multiple loop; left: the base before j dangles, right: the base after i."""
        both = self.dangles == 2
        return CLOSING + BRANCH + self._stem(_REVERSED[self.type(i, j)], j - 1 if both or left else None, i + 1 if both or right else None)


#: Which of the bases beside a branch dangle, where they may: (left, right).
WAYS = {0: [(0, 0)], 1: [(0, 0), (1, 0), (0, 1), (1, 1)], 2: [(0, 0)]}


def _inner(i: int, j: int):
    """The pairs (p, q) that close an interior loop with (i, j)."""
    for p in range(i + 1, min(i + LONGEST + 2, j - MIN_HAIRPIN - 1)):
        for q in range(j - 1, max(p + MIN_HAIRPIN, j - 2 - LONGEST + (p - i - 1)), -1):
            yield p, q


class Tables:
    """The inside recursion in one algebra."""

    def __init__(self, codes: np.ndarray, least: bool, dangles: int = 2):
        self.dangles = dangles = dangles if least or dangles != 1 else 2
        e = self.e = Energies(codes, dangles)
        n, size = e.n, codes.shape[1]
        self.n, self.least = n, least
        kind = np.longdouble if not least and n >= LONG else np.float64
        add, mul = (np.minimum, np.add) if least else (np.add, np.multiply)
        none, one = (np.full(size, np.inf), np.zeros(size)) if least else (np.zeros(size, kind), np.ones(size, kind))
        self.weight = w = (lambda x: x) if least else (lambda x: np.exp(-np.asarray(x, kind) / KT))
        can = lambda i, j: e.type(i, j) >= 0
        ways = WAYS[dangles]
        self.pair = pair = [[none] * (n + 1) for _ in range(n + 1)]
        self.one = first = [[none] * (n + 1) for _ in range(n + 1)]  # one branch that starts at i, its dangling bases with it
        self.some = some = [[none] * (n + 1) for _ in range(n + 2)]  # one or more

        def stems(i: int, j: int, energy):
            """Branches that take all of i to j."""
            x = none
            for left, right in ways:
                p, q = i + left, j - right
                if q - p > MIN_HAIRPIN and (ok := can(p, q)).any():
                    x = add(x, np.where(ok, mul(w(energy(p, q, bool(left), bool(right))), pair[p][q]), none))
            return x

        self.stems = stems
        for d in range(MIN_HAIRPIN + 1, n):
            for i in range(n - d):
                j = i + d
                ok = can(i, j)
                if ok.any():
                    x = w(e.hairpin(i, j))
                    for p, q in _inner(i, j):
                        if can(p, q).any():
                            x = add(x, mul(w(e.interior(i, j, p, q)), pair[p][q]))
                    if d > 2 * MIN_HAIRPIN + 4:
                        for right, left in ways:  # the bases inside that dangle on the closing pair
                            split = none
                            for m in range(i + right + MIN_HAIRPIN + 3, j - left - MIN_HAIRPIN - 1):
                                split = add(split, mul(some[i + 1 + right][m - 1], first[m][j - 1 - left]))
                            x = add(x, mul(w(e.closing(i, j, bool(left), bool(right))), split))
                    pair[i][j] = np.where(ok, x, none)
                first[i][j] = add(first[i][j - 1], stems(i, j, e.branch))
                x = none
                for m in range(i, j - MIN_HAIRPIN):
                    x = add(x, mul(add(one, some[i][m - 1] if m > i else none), first[m][j]))
                some[i][j] = x
        self.before = before = [one] * (n + 1)  # the first j places
        for j in range(n):
            x = before[j]
            for i in range(j - MIN_HAIRPIN):
                x = add(x, mul(before[i], stems(i, j, e.outer)))
            before[j + 1] = x
        if least:
            return
        self.after = after = [one] * (n + 2)  # the places from i on
        for i in range(n - 1, -1, -1):
            x = after[i + 1]
            for j in range(i + MIN_HAIRPIN + 1, n):
                x = add(x, mul(stems(i, j, e.outer), after[j + 1]))
            after[i] = x


def mfe(sequences: list[str], dangles: int = 1) -> list[tuple[str, float]]:
    """(dot-bracket, kcal/mol) of sequences of one length; up to three bases have no pairs."""
    n = len(sequences[0]) if sequences else 0
    if n <= MIN_HAIRPIN + 1:
        return [("." * n, 0.0) for _ in sequences]
    codes = coded(sequences)
    t = Tables(codes, True, dangles)
    return [(_trace(t, codes[:, b], b, dangles), float(np.float32(t.before[n][b]) / np.float32(100))) for b in range(codes.shape[1])]


def _trace(t: Tables, codes: np.ndarray, b: int, dangles: int) -> str:
    """A structure of least energy: unpaired ends first, then the furthest left partner, hairpin, interior and multiple loop."""
    e, n = Energies(codes, dangles), t.n
    out = ["."] * n
    same = lambda x, y: abs(float(x) - float(y)) < 1e-6
    ways = WAYS[dangles]

    def stem(i: int, j: int, goal: float, energy) -> tuple[int, int] | None:
        """The pair of a branch that takes all of i to j with an energy of goal."""
        for left, right in ways:
            p, q = i + left, j - right
            if q - p > MIN_HAIRPIN and e.type(p, q) >= 0 and same(goal, energy(p, q, bool(left), bool(right)) + t.pair[p][q][b]):
                return p, q
        return None

    todo = [("outer", 0, n - 1)]
    while todo:
        kind, i, j = todo.pop()
        if kind == "outer":
            while j >= 0 and same(t.before[j + 1][b], t.before[j][b]):
                j -= 1
            if j < 0:
                continue
            for k in range(j - MIN_HAIRPIN):
                if np.isfinite(t.before[k][b]) and (found := stem(k, j, t.before[j + 1][b] - t.before[k][b], e.outer)):
                    todo += [("outer", 0, k - 1), ("pair", *found)]
                    break
        elif kind == "some":
            goal = t.some[i][j][b]
            for m in range(i, j - MIN_HAIRPIN):
                if same(goal, t.one[m][j][b]):
                    todo.append(("one", m, j))
                    break
                if m > i and same(goal, t.some[i][m - 1][b] + t.one[m][j][b]):
                    todo += [("some", i, m - 1), ("one", m, j)]
                    break
        elif kind == "one":
            while same(t.one[i][j][b], t.one[i][j - 1][b]):
                j -= 1
            todo.append(("pair", *stem(i, j, t.one[i][j][b], e.branch)))
        else:
            out[i], out[j] = "(", ")"
            goal = t.pair[i][j][b]
            if same(goal, e.hairpin(i, j)):
                continue
            inner = next(((p, q) for p, q in _inner(i, j) if e.type(p, q) >= 0 and same(goal, e.interior(i, j, p, q) + t.pair[p][q][b])), None)
            if inner:
                todo.append(("pair", *inner))
                continue
            splits = ((m, left, right) for right, left in ways for m in range(i + right + MIN_HAIRPIN + 3, j - left - MIN_HAIRPIN - 1))
            m, left, right = next((m, left, right) for m, left, right in splits if same(goal, e.closing(i, j, bool(left), bool(right)) + t.some[i + 1 + right][m - 1][b] + t.one[m][j - 1 - left][b]))
            todo += [("some", i + 1 + right, m - 1), ("one", m, j - 1 - left)]
    return "".join(out)


def probabilities(sequences: list[str], dangles: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(pair probabilities: batch, n, n, upper triangle; profile: batch, 5, n) of sequences of one length.

    The profile gives the chance of a place to be unpaired in a hairpin, bulge, interior or multiple loop or outside all pairs.
    """
    size, n = len(sequences), len(sequences[0]) if sequences else 0
    pairs, profile = np.zeros((size, n, n)), np.zeros((size, 5, n))
    if not size or n <= MIN_HAIRPIN + 1:
        profile[:, 4] = 1.0
        return pairs, profile
    t = Tables(coded(sequences), False, dangles)
    e, z = t.e, t.before[n]
    ratio = lambda a, b: np.divide(a, b, out=np.zeros(size, np.result_type(a, b)), where=b > 0)
    some = np.array([[x for x in row] for row in t.some[: n + 1]])  # place, place, batch
    shut = np.zeros((n, n, size), some.dtype)  # what a closed multiple loop gives to its branches
    # of the loops that (i, j) closes for all j beyond m: with branches between m and j, without
    after = np.zeros((2, n, n, size), some.dtype)
    for d in range(n - 1, MIN_HAIRPIN, -1):
        for k in range(n - d):
            m = k + d
            after[0, k, m] = (shut[k, m + 1 :] * some[m + 1, m : n - 1]).sum(axis=0)
            after[1, k, m] = shut[k, m + 1 :].sum(axis=0)
            if not t.pair[k][m].any():
                continue
            total = t.before[k] * t.weight(e.outer(k, m)) * t.after[m + 1] * t.pair[k][m] / z + pairs[:, k, m]
            if k:
                # a branch of a multiple loop closed by (i, j): with branches to its left, to its right or both
                left = some[np.arange(1, k + 1), k - 1]
                rest = (left * after[1, :k, m] + (1 + left) * after[0, :k, m]).sum(axis=0)
                total = total + rest * t.weight(e.branch(k, m)) * t.pair[k][m]
            pairs[:, k, m] = total
            scale = ratio(total, t.pair[k][m])
            shut[k, m] = scale * t.weight(e.closing(k, m))
            profile[:, 0, k + 1 : m] += (scale * t.weight(e.hairpin(k, m)))[:, None]
            for p, q in _inner(k, m):
                if t.pair[p][q].any():
                    x = scale * t.weight(e.interior(k, m, p, q)) * t.pair[p][q]
                    pairs[:, p, q] += x
                    if p - k > 1 or m - q > 1:
                        c = 1 if p - k == 1 or m - q == 1 else 2
                        profile[:, c, k + 1 : p] += x[:, None]
                        profile[:, c, q + 1 : m] += x[:, None]
    for x in range(n):
        profile[:, 4, x] = t.before[x] * t.after[x + 1] / z
    taken = pairs.sum(axis=1) + pairs.sum(axis=2)
    profile[:, 3] = np.clip(1 - taken - profile.sum(axis=1), 0.0, 1.0)
    return pairs, profile
