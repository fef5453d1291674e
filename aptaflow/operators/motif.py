"""Structure-aware motif discovery.

For each k-mer the mean structure context of its occurrences is followed over the selection rounds, for abundant aptamers
and for rare ones apart; k-mers whose context shifts more than that of rare aptamers are significant. Scans over occurrences
are DataFrames; what is collected has at most 4^k rows (the k-mers), of which the greedy clustering, inherently sequential,
takes the significant ones on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq
from ..store import cut

#: Sets of motifs up to which they are looked through on the driver.
MAX_SETS = 100_000
LEAST, STRONG, THETA, LOW_SCORE, TRIM, COVERED = 100, 0.01, 10, 1e-6, 1.70, 0.67
_CTX = range(5)


@dataclass(frozen=True)
class Config:
    k: int = 6
    alpha: int = 10
    filter_clusters: bool = True


def windows(regions: DataFrame, k: int) -> DataFrame:
    """regions (region, profile of 5 * length values) with a row for each k-mer place: kmer, position, ctx.

    The context of a window is the sum over its last k - 1 places divided by k, for each of five contexts.
    """
    n = F.length("region")
    ok = F.assert_true(F.size("profile") == 5 * n, F.lit("a profile needs five values for each place"))
    rows = regions.filter(n >= k).filter(ok.isNull()).withColumn("position", F.explode(F.sequence(F.lit(0), n - k)))
    # plain sums of k - 1 values, which are compiled; functions over arrays are not
    value = lambda c: sum((F.get("profile", n * c + F.col("position") + j) for j in range(1, k)), F.lit(0.0)) / k
    return rows.select("region", "position", F.substring("region", F.col("position") + 1, F.lit(k)).alias("kmer"), F.array(*[value(c) for c in _CTX]).alias("ctx"))


def round_totals(counts: DataFrame, k: int) -> DataFrame:
    """(kmer, round, total): reads with a k-mer, each aptamer once."""
    rows = counts.filter(F.length("region") >= k).select("round", "count", F.explode(F.array_distinct(seq.kmers(F.col("region"), k))).alias("kmer"))
    return rows.groupBy("kmer", "round").agg(F.sum("count").alias("total"))


def context_sums(counts: DataFrame, regions: DataFrame, config: Config) -> DataFrame:
    """(kmer, round, n_nonsingleton, n_singleton, ctx, ctx_singleton): weighted sums over every occurrence.

    Counts above alpha are abundant; with alpha of 0 or less all are rare. Counts meet the windows by region and are added up
    by it first, for the two kinds apart.
    """
    rare = F.lit(True) if config.alpha <= 0 else F.col("count") <= config.alpha
    by_region = counts.groupBy("region", "round").agg(F.sum(F.when(~rare, F.col("count")).otherwise(0)).alias("many"), F.sum(F.when(rare, F.col("count")).otherwise(0)).alias("few"))
    rows = windows(regions, config.k).join(by_region, "region")
    total = lambda weight: F.array(*[F.sum(F.col("ctx")[c] * F.col(weight)) for c in _CTX])
    return rows.groupBy("kmer", "round").agg(F.sum("many").alias("n_nonsingleton"), F.sum("few").alias("n_singleton"), total("many").alias("ctx"), total("few").alias("ctx_singleton"))


def round_reads(counts: DataFrame) -> DataFrame:
    return counts.groupBy("round").agg(F.sum("count").alias("reads"))


def _over(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(float("nan")))


def traces(counts: DataFrame, regions: DataFrame, config: Config, rounds: list[int]) -> DataFrame:
    """One row per k-mer: arrays by round of totals, counts and mean contexts, made as scores() needs them."""
    sums = context_sums(counts, regions, config).join(round_totals(counts, config.k), ["kmer", "round"])
    figures = F.struct("total", "n_nonsingleton", "n_singleton", "ctx", "ctx_singleton")
    wide = sums.groupBy("kmer").agg(F.map_from_entries(F.collect_list(F.struct("round", figures.alias("v")))).alias("m"))
    zeros = F.array(*[F.lit(0.0)] * 5)
    at = lambda c, none: F.transform(F.array(*[F.lit(r) for r in rounds]), lambda r: F.coalesce(F.try_element_at("m", r)[c], none))
    none = F.lit(0).cast("long")
    wide = wide.select("kmer", at("total", none).alias("total"), at("n_nonsingleton", none).alias("n"), at("n_singleton", none).alias("s"), at("ctx", zeros).alias("x"), at("ctx_singleton", zeros).alias("y"))
    every = F.sequence(F.lit(0), F.lit(len(rounds) - 1))
    merged = lambda i: ((F.get("n", i) < LEAST) | (i == 0)) & (F.get("n", i) + F.get("s", i) >= LEAST)
    size = lambda i: F.when(merged(i), F.get("n", i) + F.get("s", i)).otherwise(F.get("n", i))
    mean = lambda i: F.zip_with(F.get("x", i), F.get("y", i), lambda a, b: _over(F.when(merged(i), a + b).otherwise(a), size(i)))
    means = {"size": F.transform(every, size), "p": F.transform(every, mean), "q": F.transform(every, lambda i: F.transform(F.get("y", i), lambda v: _over(v, F.get("s", i))))}
    # written, as scores() reads each mean many times; there are 4^k rows at most
    return cut(cut(wide).withColumns(means).select("kmer", "total", F.col("size").alias("n"), "s", "p", "q"))


def _divergence(p: str, n: str, rounds: int) -> Column:
    """Mean relative entropy of later rounds from earlier ones; 0 unless every pair of rounds counts."""
    if rounds < 2:
        return F.lit(float("nan"))
    pairs = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(k).alias("k")) for k in range(1, rounds) for j in range(k)])
    rate = lambda i: F.get(F.get(p, i), F.lit(0))
    ok = F.forall(pairs, lambda x: (rate(x["j"]) <= 1.0) & (rate(x["k"]) <= 1.0) & (F.get(n, x["j"]) >= LEAST) & (F.get(n, x["k"]) >= LEAST))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + seq.relative_entropy(F.get(p, x["k"]), F.get(p, x["j"])))
    return F.when(ok, total / (rounds * (rounds - 1) / 2)).otherwise(0.0)


def selection_context(p: str, rounds: int) -> Column:
    """The context (5: paired) whose probability grows most over all pairs of rounds, the first of these."""
    every = F.sequence(F.lit(0), F.lit(rounds - 1))
    paired = lambda i: 1 - F.aggregate(F.get(p, i), F.lit(0.0), lambda a, x: a + x)
    of = lambda c, i: F.when(c < 5, F.get(F.get(p, i), c)).otherwise(paired(i))
    # round i is added in i pairs and taken off in rounds - 1 - i
    total = lambda c: F.aggregate(every, F.lit(0.0), lambda a, i: a + (2 * i - rounds + 1) * of(c, i))
    sums = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda c: F.struct(total(c).alias("v"), (-c).alias("c")))
    return F.coalesce(-F.array_max(F.filter(sums, lambda x: ~F.isnan(x["v"])))["c"], F.lit(-1))


def scores(traced: DataFrame, rounds: int, last_reads: int) -> DataFrame:
    """kmer, proportion, strong, kl, kl_singleton, selection_context of the k-mers with enough occurrences in every round."""
    enough = traced.filter(F.forall("total", lambda x: x >= LEAST))
    share = F.col("total")[rounds - 1] / F.lit(float(last_reads))
    # written, so that filters on the scores do not compute them again
    return cut(enough.select("kmer", share.alias("proportion"), (F.col("total")[rounds - 1] >= STRONG * last_reads).alias("strong"), _divergence("p", "n", rounds).alias("kl"), _divergence("q", "s", rounds).alias("kl_singleton"), selection_context("p", rounds).cast("int").alias("selection_context")))


def background(scored: DataFrame) -> DataFrame:
    """One row over the k-mers with scores of both kinds: mean and sample deviation (0 for one) of the log of rare aptamers'
    scores, their number, and the cuts of log scores and proportions below which the lowest 90 % lie."""
    rows = scored.filter((F.col("kl") >= LOW_SCORE) & (F.col("kl_singleton") >= LOW_SCORE)).select(F.log("kl").alias("log"), F.log("kl_singleton").alias("rare"), "proportion")
    # there are 4^k rows at most
    figures = rows.agg(F.avg("rare").alias("mean"), F.coalesce(F.stddev_samp("rare"), F.lit(0.0)).alias("sd"), F.count("*").alias("n"), F.sort_array(F.collect_list("log")).alias("logs"), F.sort_array(F.collect_list("proportion")).alias("shares"))
    at = F.greatest(F.lit(0), F.least(F.floor(F.lit((100.0 - THETA) / 100.0) * F.col("n")), F.col("n") - 1)).cast("int")
    return figures.select("mean", "sd", "n", F.get("logs", at).alias("top_score"), F.get("shares", at).alias("top_proportion"))


def with_p_values(scored: DataFrame) -> DataFrame:
    """scored with log and p_value, and the cuts of background()."""
    rows = scored.crossJoin(F.broadcast(background(scored)).filter("n > 0"))  # one row
    log = F.when(F.col("kl") > 0, F.log("kl")).otherwise(float("-inf"))
    above = F.col("log") - F.col("mean")
    # without a deviation whatever lies above the mean is beyond all chance
    z = F.when(F.col("sd") > 0, above / F.col("sd")).otherwise(F.when(above > 0, float("inf")).otherwise(0.0))
    return rows.withColumn("log", log).withColumn("z", z).withColumn("p_value", F.when(F.col("z") > 38, 0.0).otherwise(seq.tail_p_value(F.col("z")))).drop("z", "mean", "sd", "n")


def significant(scored: DataFrame) -> list[dict]:
    """The significant k-mers with their p-values by rising proportion, then k-mer."""
    rows = with_p_values(scored)
    strict = rows.filter((F.col("p_value") <= 0.01) & (F.col("log") >= F.col("top_score"))).isEmpty()
    level = 0.05 if strict else 0.01
    often = (F.col("proportion") >= F.col("top_proportion")) & (F.col("log") >= -3.0) & F.col("strong")
    keep = rows.filter((F.col("p_value") <= level) & ((F.col("log") >= F.col("top_score")) | often))
    return [r.asDict() for r in keep.orderBy("proportion", "kmer").collect()]


def _shifts(a: str, b: str, most: int | None = None):
    """(shift, inserted places, replacements, longest common run, a padded, b padded) of b laid against a, -2 to 2."""
    for shift in range(-2, 3):
        pad = "-" * abs(shift)
        x, y = (pad + a, b + pad) if shift < 0 else (a + pad, pad + b)
        run = best = wrong = 0
        for p, q in zip(x, y, strict=True):
            same = p == q != "-"
            run = run + 1 if same else 0
            best = max(best, run)
            wrong += p != q and "-" not in (p, q)
        gaps = 2 * abs(shift)
        if most is None or gaps <= most:
            yield gaps, wrong, best, x, y


def good_overlap(a: str, b: str) -> bool:
    """Whether two k-mers belong together: one replacement without shift, else a long common run at the best shift."""
    # of equal scores the last shift holds
    gaps, wrong, run, _, _ = min(reversed(list(_shifts(a, b))), key=lambda s: s[0] + s[1])
    return wrong == 1 if gaps == 0 else run >= (4 if len(a) <= 6 else 5)


def align(kmers: list[str]) -> list[str]:
    """All k-mers laid against the first, padded with - to one length."""
    pairs = [("", "")] + [min(reversed(list(_shifts(kmers[0], b, 4))), key=lambda s: s[0] + s[1])[3:] for b in kmers[1:]]
    left = [len(x) - len(x.lstrip("-")) for x, _ in pairs]
    right = [len(x) - len(x.rstrip("-")) for x, _ in pairs]
    rows = [kmers[0]] + [y for _, y in pairs[1:]]
    return ["-" * (max(left) - a) + row + "-" * (max(right) - b) for row, a, b in zip(rows, left, right, strict=True)]


def group(keep: list[dict]) -> list[dict]:
    """Clusters of significant k-mers, from the highest proportion down: seed, kmers, alignments and the seed's figures."""
    left, out = list(reversed(keep)), []
    while left:
        seed = next((r for r in left if r["strong"]), None)
        if seed is None:
            break
        later = left[left.index(seed) + 1 :]
        mine = [seed] + [r for r in later if r["selection_context"] == seed["selection_context"] and good_overlap(seed["kmer"], r["kmer"])]
        kmers = [r["kmer"] for r in mine]
        out.append({"motif": len(out), "seed": seed["kmer"], "kmers": kmers, "alignments": dict(zip(kmers, align(kmers), strict=True)), "p_value": seed["p_value"], "proportion": seed["proportion"], "selection_context": seed["selection_context"]})
        left = [r for r in left if r not in mine]
    return out


def filled(alignment: Column, whole: Column, place: Column) -> Column:
    """An aligned k-mer at a 0-based place of whole, its blanks filled from whole; beyond its ends they stay."""
    lead = F.length(alignment) - F.length(F.ltrim(F.translate(alignment, "-", " ")))
    at = lambda i: place - lead + i - 1
    from_whole = lambda i: F.when((at(i) >= 0) & (at(i) < F.length(whole)), F.substring(whole, at(i) + 1, F.lit(1))).otherwise("-")
    return F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length(alignment)), lambda i: F.when(F.substring(alignment, i, F.lit(1)) != "-", F.substring(alignment, i, F.lit(1))).otherwise(from_whole(i))))


def pwm(hits: DataFrame) -> DataFrame:
    """(motif, rare, position, base, weight) of hits (motif, rare, filled, count); other signs than A, G, T and U count as C."""
    letters = F.filter(F.split("filled", "", -1), lambda c: c != "")
    base = F.when(F.col("c").isin("A", "G", "T"), F.col("c")).when(F.col("c") == "U", "T").otherwise("C")
    rows = hits.select("motif", "rare", "count", F.posexplode(letters).alias("position", "c")).withColumn("base", base)
    return rows.groupBy("motif", "rare", "position", "base").agg(F.sum("count").alias("weight"))


def consensus(rows: np.ndarray) -> str:
    """The base of the highest weight in each row, of equal ones the first of A, C, G, T."""
    return "".join("ACGT"[int(r.argmax())] for r in rows)


def trimmed(rows: np.ndarray) -> np.ndarray:
    """The rows without those of 1.70 bits or more at either end; one is left."""
    def bits(r: np.ndarray) -> float:
        r = r[r > 1e-6]
        return float(-(r * np.log2(r)).sum())

    first, last = 0, len(rows) - 1
    while first < len(rows) - 1 and bits(rows[first]) >= TRIM:
        first += 1
    while last > first and bits(rows[last]) >= TRIM:
        last -= 1
    return rows[first : last + 1]


def motifs(counts: DataFrame, regions: DataFrame, config: Config = Config()) -> DataFrame:
    """The motifs. counts: sequence, start_index, region, round, count; regions: region, profile.

    Control and counter rounds are taken in as other rounds; leave them out beforehand if they should not count.
    """
    spark = counts.sparkSession
    reads = {r["round"]: r["reads"] for r in round_reads(counts).collect()}
    rounds = sorted(reads)
    schema = "seed string, consensus string, seed_p_value double, seed_proportion double, motif_proportion double, selection_context int, kmers array<string>, kmer_alignment map<string,string>, n_aptamers long, pwm array<array<double>>, context_trace array<array<double>>"
    if not rounds:
        return spark.createDataFrame([], schema)
    last = rounds[-1]
    clusters = group(significant(scores(traces(counts, regions, config, rounds), len(rounds), reads[last])))
    if not clusters:
        return spark.createDataFrame([], schema)
    table = F.broadcast(spark.createDataFrame([(c["motif"], x, a) for c in clusters for x, a in c["alignments"].items()], "motif int, kmer string, alignment string"))
    hits = windows(regions, config.k).join(table, "kmer").join(counts.select("region", "sequence", "start_index", "round", "count"), "region")
    hits = cut(hits)  # read by each step below
    rare = F.col("count") <= config.alpha
    now = hits.filter(F.col("round") == last).withColumn("rare", rare).withColumn("filled", filled(F.col("alignment"), F.col("sequence"), F.col("start_index") + F.col("position")))
    weights: dict[tuple[int, bool], dict[tuple[int, str], float]] = {}
    for r in pwm(now).collect():
        weights.setdefault((r["motif"], r["rare"]), {})[r["position"], r["base"]] = float(r["weight"])
    total = {(r["motif"], r["round"]): r["t"] for r in hits.select("motif", "sequence", "round", "count").distinct().groupBy("motif", "round").agg(F.sum("count").alias("t")).collect()}
    many = (F.col("count") > config.alpha) | (F.col("round") == rounds[0])
    sums = [F.sum(F.when(c, F.col("ctx")[i] * F.col("count")).otherwise(0.0)).alias(f"{n}{i}") for n, c in (("m", many), ("f", rare)) for i in _CTX]
    ctx = {(r["motif"], r["round"]): r for r in hits.groupBy("motif", "round").agg(F.sum(F.when(many, F.col("count")).otherwise(0)).alias("m"), F.sum(F.when(rare, F.col("count")).otherwise(0)).alias("f"), *sums).collect()}
    own = cut(now.filter(~rare).select("motif", "sequence", "count").distinct())
    dropped = _covered(own, len(clusters)) if config.filter_clusters else set()
    n_own = {r["motif"]: r["n"] for r in own.groupBy("motif").agg(F.count("*").alias("n")).collect()}
    out = []
    for c in clusters:
        m = c["motif"]
        if m in dropped:
            continue
        width = len(next(iter(c["alignments"].values())))
        trace, swap = [], False
        for r in rounds:
            row = ctx.get((m, r))
            n, s = (row["m"], row["f"]) if row else (0, 0)
            x = np.array([row[f"m{i}"] for i in _CTX]) if row else np.zeros(5)
            if n < LEAST and n + s >= LEAST:
                n, x, swap = n + s, x + np.array([row[f"f{i}"] for i in _CTX]), r == last
            mean = x / n if n else np.full(5, math.nan)
            trace.append([*mean.tolist(), float(1 - mean.sum())])
        rows = np.zeros((width, 4))
        for flag in (False, True) if swap else (False,):
            for (p, b), w in weights.get((m, flag), {}).items():
                rows[p, "ACGT".index(b)] += w
        rows = np.divide(rows, rows.sum(axis=1, keepdims=True), out=rows, where=rows.sum(axis=1, keepdims=True) > 0)
        rows = trimmed(rows)
        out.append((c["seed"], consensus(rows), c["p_value"], c["proportion"], total.get((m, last), 0) / reads[last], c["selection_context"], c["kmers"], c["alignments"], n_own.get(m, 0), rows.tolist(), trace))
    return spark.createDataFrame(out, schema)


def _covered(own: DataFrame, n: int) -> set[int]:
    """Motifs of whose reads more than 67 % belong to aptamers of earlier kept motifs; those without reads too.

    own: motif, sequence, count. What counts depends on the motifs kept before, so the decisions are taken one by one, but over
    the sets of motifs that aptamers hold, with the reads of each set added up. If there are very many such sets, each
    motif is an aggregation of its own instead.
    """
    sets = own.groupBy("sequence").agg(F.sort_array(F.collect_set("motif")).alias("motifs"), F.max("count").alias("count"))
    sets = cut(sets.groupBy("motifs").agg(F.sum("count").alias("count")))
    dropped: set[int] = set()
    if sets.count() <= MAX_SETS:
        rows = [(set(r["motifs"]), r["count"]) for r in sets.collect()]
        shares = ((sum(c for s, c in rows if m in s), sum(c for s, c in rows if m in s and s & kept)) for m in range(n) for kept in [set(range(m)) - dropped])
    else:
        old = lambda m: F.size(F.array_intersect("motifs", F.array(*[F.lit(i) for i in range(m) if i not in dropped]).cast("array<int>"))) > 0
        shares = (sets.filter(F.array_contains("motifs", m)).agg(F.sum("count"), F.sum(F.when(old(m), F.col("count")).otherwise(0))).first() for m in range(n))
    for m, (total, old_reads) in enumerate(shares):
        if not total or old_reads / total > COVERED:
            dropped.add(m)
    return dropped


def members(hits: DataFrame, last_reads: int) -> DataFrame:
    """(motif, place, sequence, last_round_count, last_round_proportion), each aptamer of the last round once for a motif; place
    counts from 1 by falling count, then sequence."""
    rows = hits.select("motif", "sequence", "count").distinct()
    place = F.row_number().over(Window.partitionBy("motif").orderBy(F.desc("count"), "sequence"))
    return rows.select("motif", place.alias("place"), "sequence", F.col("count").alias("last_round_count"), (F.col("count") / F.lit(float(last_reads))).alias("last_round_proportion"))


def overlaps(own: DataFrame) -> DataFrame:
    """(motif, earlier, share): the share of a motif's reads that belong to aptamers of an earlier motif. own: motif, sequence,
    count. Motifs without common aptamers have no row."""
    totals = own.groupBy("motif").agg(F.sum("count").alias("total"))
    both = own.join(own.select("sequence", F.col("motif").alias("earlier")), "sequence").filter("earlier < motif")
    return both.groupBy("motif", "earlier").agg(F.sum("count").alias("held")).join(totals, "motif").select("motif", "earlier", (F.col("held") / F.col("total")).alias("share"))


def with_profiles(regions: DataFrame, structures: DataFrame) -> DataFrame:
    """regions (region, ...) with their profile; a region without one, or with one of another size, is an error."""
    rows = regions.join(structures.select("region", "profile"), "region", "left")
    good = F.coalesce(F.size("profile") == 5 * F.length("region"), F.lit(False))
    return rows.filter(F.assert_true(good, F.lit("a region needs a profile of five values for each place")).isNull())
