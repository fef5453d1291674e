"""Goldens of the sequence functions and the fuzzy matcher."""

import random
import time

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aptaflow.functions import matching, seq
from aptaflow.operators import lsh, motif


@pytest.mark.parametrize(
    ("args", "want"),
    [
        (("TTACGTTTACGTTT", "ACGT", 1, 0, 14), (8, 0)),
        (("TTACCTTT", "ACGT", 1, 0, 8), (2, 1)),
        (("TTAGTTTT", "ACGT", 1, 0, 8), (2, 1)),
        (("TTTTTTTT", "ACGT", 1, 0, 8), None),
        (("GGACGT", "ACGT", 0, 0, 2), (2, 0)),
    ],
)
def test_bitap(args, want):
    assert matching.bitap(*args) == want


@settings(max_examples=200, deadline=None)
@given(st.text("ACGT", max_size=30), st.text("ACGT", min_size=1, max_size=6))
def test_bitap_without_errors_is_the_last_hit(text, pattern):
    hit = matching.bitap(text, pattern, 0)
    assert (hit[0] if hit else -1) == text.rfind(pattern)


@given(st.text("ACGT"))
def test_reverse_complement_is_an_involution(s):
    assert matching.reverse_complement(matching.reverse_complement(s)) == s


def test_columns(spark):
    row = spark.createDataFrame([("AACGT", "TTACGTTTACGTTT")], "s string, t string").select(
        seq.reverse_complement(F.col("s")).alias("rc"),
        seq.find_left(F.col("t"), "ACGT").alias("left"),
        seq.find_right(F.col("t"), "ACGT").alias("right"),
        seq.find_right(F.col("t"), "CCC").alias("none"),
        seq.kmer_id(F.lit("TTGGAA")).alias("id"),
        seq.is_acgt(F.lit(None).cast("string")).alias("null"),
    ).first()
    assert (row.rc, row.left, row.right, row.none, row.null) == ("ACGTT", 2, 8, -1, False)
    assert row.id == int("221100", 4)


def test_overlap_predicate(spark):
    rows = spark.createDataFrame([(0, 5, 3, 5), (3, 5, 0, 5), (0, 5, 10, 5), (0, 10, 3, 5)], "a int, b int, c int, d int")
    got = [r.o for r in rows.select(seq.overlapped(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("o")).collect()]
    assert got == [False, True, False, True]


@pytest.mark.parametrize(("a", "b", "want"), [("ACGTACGT", "ACGTTCGT", 1 / 6), ("ACGTACGT", "ACGTACGA", 0.0), ("AAAAAAAA", "AAAAAAAA", 2.0)])
def test_kmer_distance(spark, a, b, want):
    assert lsh.distances(*lsh.kmer_frequencies([a, b], 3)) == pytest.approx(want)
    row = spark.createDataFrame([(a, b)], "a string, b string").select(seq.kmer_distance(F.col("a"), F.col("b"), 3).alias("d")).first()
    assert row.d == pytest.approx(want)


def test_inclusion_probabilities(spark):
    ratios = F.create_map(*[F.lit(x) for b in "ACGT" for x in (b, 0.25)])
    rows = spark.createDataFrame([("ACA",), ("ACG",)], "s string").select(seq.inclusion_probabilities(F.col("s"), ratios, 6).alias("p")).collect()
    assert rows[0].p == pytest.approx([0, 0, 0.015625, 0.03125, 0.0458984375, 0.060302734375])
    assert rows[1].p == pytest.approx([0, 0, 0.015625, 0.03125, 0.046875, 0.062255859375])


def test_tail_p_value(spark):
    row = spark.range(1).select(*[seq.tail_p_value(F.lit(z)).alias(n) for z, n in ((1.0, "a"), (2.5, "b"), (-1.0, "c"))]).first()
    assert (row.a, row.b, row.c) == pytest.approx((0.2419707245, 0.0070113202, 1.0))


def test_no_hash_for_some_sizes():
    for size in (2, 3, 4, 6):
        with pytest.raises(ValueError):
            lsh.places(lsh.Config(region_size=size, dimension=2))


def test_merge_pair():
    rng = random.Random(3)
    whole = "".join(rng.choice("ACGT") for _ in range(60))
    merged = matching.merge_pair(whole[:40], "I" * 40, matching.reverse_complement(whole[20:]), "I" * 40)
    assert merged[0] == whole and len(merged[1]) == 60
    assert matching.merge_pair(whole[:20], "I" * 20, matching.reverse_complement(whole[45:]), "I" * 15) is None


def test_motif_alignment():
    assert motif.good_overlap("ACGTAC", "ACGTAG") and not motif.good_overlap("AAAAAA", "CCCCCC")
    assert motif.align(["ACGTAC", "CGTACC", "AACGTA"]) == ["-ACGTAC-", "--CGTACC", "AACGTA--"]


def test_hamming_searches_against_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(matching, "PORTION", 50)
    rng = random.Random(3)
    rows = [("".join(rng.choices("ACGTé😀", k=rng.randrange(12))), "".join(rng.choices("ACé", k=rng.randrange(1, 5)))) for _ in range(300)]
    rows += [(None, "A"), ("A", None), ("", "A"), ("", ""), ("AC", ""), ("ACGT" * 20, "TTTT" * 10)]
    want = [None if t is None or p is None else matching.hamming_search(t, p, 2) for t, p in rows]
    texts, patterns, low = pa.array([t for t, _ in rows], pa.string()), pa.array([p for _, p in rows], pa.string()), pa.array([0] * len(rows), pa.int32())
    got = matching.hamming_searches(texts, patterns, low, pc.utf8_length(texts), 2).to_pylist()
    assert [g and (g["index"], g["errors"]) for g in got] == want
    # bounds; what lies outside is a mismatch
    df = spark.createDataFrame([("ACGTACGT", "ACGT", 1, 8), ("ACGT", "TAC", 1, 9), ("ACGT", "XA", -1, 3), ("ACGT", "ACG", 2, 4), ("ACGT", "AC", None, 4)], "t string, p string, low int, high int")
    hit = seq.hamming_search(F.col("t"), F.col("p"), 2, F.col("low"), F.col("high"))
    assert [r.h and tuple(r.h) for r in df.select(hit.alias("h")).collect()] == [(4, 0), (3, 2), (-1, 1), None, None]


def test_hamming_search_of_many_rows(spark):
    """Lambdas took 29 s for half of the rows on four cores."""
    df = spark.range(200_000).select(F.repeat(F.md5(F.col("id").cast("string")), 2).alias("t"))
    began = time.time()
    assert df.select(seq.hamming_search(F.col("t"), F.lit("0123456789abcdef0123456789abcdef012"), 35).alias("h")).filter("h is null").count() == 0
    assert time.time() - began < 20
