"""Sequence functions as Column expressions; everything here stays in the JVM, but for hamming_search()."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from . import matching

CONTEXTS = ["h", "b", "i", "m", "d"]


def is_acgt(s: Column) -> Column:
    """All characters are A, C, G or T; false for null, true for the empty string."""
    return F.coalesce(s.rlike("^[ACGT]*$"), F.lit(False))


def complement(s: Column) -> Column:
    return F.translate(s, "ACGT", "TGCA")


def reverse_complement(s: Column) -> Column:
    return complement(F.reverse(s))


def find_left(text: Column, pattern: str | Column) -> Column:
    """0-based place of the first hit, -1 if there is none or the pattern is empty."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.when(F.length(pattern) > 0, F.instr(text, pattern) - 1).otherwise(-1)


def find_right(text: Column, pattern: str | Column) -> Column:
    """0-based place of the last hit, -1 if there is none or the pattern is empty."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    back = F.instr(F.reverse(text), F.reverse(pattern))
    return F.when((F.length(pattern) > 0) & (back > 0), F.length(text) - F.length(pattern) - back + 1).otherwise(-1)


def hamming_at(text: Column, pattern: Column, at: Column) -> Column:
    """Mismatches of pattern laid at a 0-based place of text; what lies outside the text is a mismatch."""
    n = F.length(pattern)
    ok = lambda i: F.substring(text, at + i, F.lit(1)) == F.substring(pattern, i, F.lit(1))
    inside = lambda i: (at + i >= 1) & (at + i <= F.length(text))
    return F.when(n == 0, F.lit(0)).otherwise(n - F.size(F.filter(F.sequence(F.lit(1), n), lambda i: inside(i) & ok(i))))


def hamming_search(text: Column, pattern: Column, tolerance: int, low: Column | None = None, high: Column | None = None) -> Column:
    """(index, errors) of the place in [low, high - length] with the fewest mismatches, the first of these; null beyond the tolerance.

    An Arrow function, as lambdas of built-in functions take some 100 ns for each pair of characters.
    """
    ship(SparkSession.active())

    @F.arrow_udf("index int, errors int")
    def search(texts: pa.Array, patterns: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        return matching.hamming_searches(texts, patterns, low, high, tolerance)

    return search(text, pattern, F.lit(0) if low is None else low, F.length(text) if high is None else high)


def overlapped(start1: Column, length1: Column, start2: Column, length2: Column) -> Column:
    """The primer overlap predicate, with inclusive ends; it is not symmetric."""
    end1, end2 = start1 + length1 - 1, start2 + length2 - 1
    return ((end1 >= start2) & (end1 >= end2)) | ((start1 <= end2) & (start1 >= start2))


def phred(q: Column) -> Column:
    """Quality of the first character."""
    return F.ascii(q) - 33


def kmers(s: Column, k: int) -> Column:
    """The k-mers of a sequence in order."""
    n = F.length(s) - k + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_id(kmer: Column, digits: str = "AGTC") -> Column:
    """The k-mer as a number in base 4 with the digits A, G, T (U), C."""
    code = F.translate(F.translate(kmer, "U", "T"), digits, "0123")
    return F.conv(code, 4, 10).cast("long")


def self_overlaps(s: Column) -> Column:
    """Proper prefixes that are suffixes too, by length."""
    n = F.length(s)
    sizes = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (F.substring(s, F.lit(1), i) == F.substring(s, n - i + 1, i)) & (n > 1))
    return F.transform(sizes, lambda i: F.substring(s, F.lit(1), i))


def string_probability(s: Column, ratios: Column) -> Column:
    """Product of the base ratios (a map); a base without a ratio counts 0, the empty string 1."""
    letters = F.filter(F.split(s, "", -1), lambda c: c != "")
    return F.aggregate(letters, F.lit(1.0), lambda acc, c: acc * F.coalesce(F.try_element_at(ratios, c), F.lit(0.0)))


def inclusion_probabilities(s: Column, ratios: Column, length: int) -> Column:
    """P(s occurs in the first i bases) for i = 1 .. length, by the recurrence with self-overlap correction."""
    n = F.length(s)
    p = string_probability(s, ratios)
    terms = F.transform(self_overlaps(s), lambda o: F.struct(F.length(o).alias("n"), string_probability(o, ratios).alias("p")))

    def more(state: Column, i: Column) -> Column:
        acc, overlaps, whole = state["acc"], state["overlaps"], state["p"]
        at = lambda j: F.get(acc, j)
        step = at(i - 1) + whole * (1 - at(i - n))
        lost = F.aggregate(
            overlaps,
            F.lit(0.0),
            lambda a, o: a + F.when((o["p"] > 0) & (i - n + o["n"] > 0), F.try_divide(whole, o["p"]) * (at(i - n + o["n"]) - at(i - n + o["n"] - 1))).otherwise(0.0),
        )
        now = F.when(i < n - 1, F.lit(0.0)).when(i == n - 1, whole).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), step - lost)))
        return F.struct(F.concat(acc, F.array(now)).alias("acc"), overlaps.alias("overlaps"), whole.alias("p"))

    start = F.struct(F.array().cast("array<double>").alias("acc"), terms.alias("overlaps"), p.alias("p"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(length - 1)), start, more, lambda state: state["acc"])


def relative_entropy(p: Column, q: Column) -> Column:
    """Sum of p ln(p / q) over the contexts where both are positive, the paired rest included."""
    both = F.zip_with(p, q, lambda x, y: F.when((x > 0) & (y > 0), x * F.log(F.try_divide(x, y))).otherwise(0.0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    rest_p, rest_q = 1 - total(p), 1 - total(q)
    return total(both) + F.when((rest_p > 0) & (rest_q > 0), rest_p * F.log(F.try_divide(rest_p, rest_q))).otherwise(0.0)


def tail_p_value(z: Column) -> Column:
    """1 / (z sqrt(2 pi) exp(z^2 / 2)) for positive z, else 1; it can exceed 1."""
    return F.when(z > 0, 1 / (z * math.sqrt(2 * math.pi) * F.exp(z * z / 2))).otherwise(1.0)


def paired_probability(profile: Column, length: Column) -> Column:
    """1 - (h + b + i + m + d) by position, of a flat context-major profile of 5 * length values."""
    return F.transform(F.sequence(F.lit(1), length), lambda p: 1 - F.aggregate(F.sequence(F.lit(0), F.lit(4)), F.lit(0.0), lambda a, c: a + F.get(profile, c * length + p - 1)))


def triangle_index(i: Column, j: Column, n: Column) -> Column:
    """Place of (i, j), i < j, in the upper triangle without diagonal, row by row."""
    return (i * (2 * n - i - 1) / 2).cast("long") + j - i - 1


def triangle_row(index: Column, n: Column) -> Column:
    """The row i of a place of the upper triangle: the last one whose first place is not beyond it."""
    # rounding may be one off where a row begins
    guess = F.floor(((2 * n - 1) - F.sqrt(((2 * n - 1) * (2 * n - 1) - 8 * index).cast("double"))) / 2).cast("int")
    low = F.greatest(guess - 1, F.lit(0))
    return F.when(triangle_index(low + 2, low + 3, n) <= index, low + 2).when(triangle_index(low + 1, low + 2, n) <= index, low + 1).otherwise(low)


def triangle_column(index: Column, n: Column) -> Column:
    """The column j of a place of the upper triangle."""
    i = triangle_row(index, n)
    return (index - triangle_index(i, i + 1, n) + i + 1).cast("int")


def project(region: Column, places: list[int]) -> Column:
    """The characters at some 0-based places: a locality-sensitive key."""
    return F.concat(*[F.substring(region, p + 1, 1) for p in places])


def kmer_distance(a: Column, b: Column, k: int, include_last: bool = False) -> Column:
    """Squared Euclidean distance of k-mer frequencies of two sequences of one length.

    As is usual for this measure here, the last k-mer is left out but counted in the divisor; with one k-mer or none the
    distance is 2.
    """
    every = lambda s: kmers(s, k) if include_last else F.slice(kmers(s, k), F.lit(1), F.greatest(F.length(s) - k, F.lit(0)))
    x, y = every(a), every(b)
    names = F.array_distinct(F.concat(x, y))
    count = lambda arr, m: F.size(F.filter(arr, lambda v: v == m))
    total = F.aggregate(names, F.lit(0.0), lambda acc, m: acc + F.pow(count(x, m) / (F.length(a) - k + 1) - count(y, m) / (F.length(b) - k + 1), F.lit(2)))
    return F.when(F.size(names) <= 1, F.lit(2.0)).otherwise(total)
