"""The queries over the derived experiment and their SQL twins.

Sums of doubles are rounded to six places on both sides, as their last digits depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import seq
from ..operators import catalog, fsbc, importer, lsh, metadata, motif, pool, structure
from . import experiment as X

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# --- import -----------------------------------------------------------------------------------------------------------

_OUTCOME = """
CASE WHEN fwd SIMILAR TO '.*[^ACGT].*' THEN 'INVALID_ALPHABET'
     WHEN instr(fwd, 'GATACGCATT') = 0 THEN 'FIVE_PRIME_ERROR'
     WHEN instr(fwd, 'CTTGACCAGT') = 0 THEN 'THREE_PRIME_ERROR'
     WHEN e1 >= p3 AND e1 >= e2 OR p5 <= e2 AND p5 >= p3 THEN 'TOTAL_PRIMER_OVERLAPS'
     WHEN p3 - p5 - 10 = 20 THEN 'ACCEPTED_READS' ELSE 'SIZE_MISMATCH' END"""


def _located(column: str = "fwd") -> str:
    return f"""located AS (SELECT *, p5 + 9 AS e1, p3 + 9 AS e2 FROM (SELECT * EXCLUDE (fwd), {column} AS fwd, instr({column}, 'GATACGCATT') - 1 AS p5,
      length({column}) - instr(reverse({column}), reverse('CTTGACCAGT')) + 1 - 10 AS p3 FROM reads))"""


@query(X.twin(f"SELECT {_OUTCOME} AS outcome, count(*) AS n FROM located GROUP BY 1", _located()))
def parse_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Reads by outcome with exact primers."""
    return X.parsed(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


_RC = "translate(reverse(fwd), 'ACGT', 'TGCA')"


@query(
    X.twin(
        "SELECT CASE WHEN a IN ('FIVE_PRIME_ERROR', 'THREE_PRIME_ERROR', 'TOTAL_PRIMER_OVERLAPS') AND b <> 'SIZE_MISMATCH' THEN b ELSE a END AS outcome, count(*) AS n FROM o GROUP BY 1",
        f"both_ways AS (SELECT row_number() OVER () AS i, fwd, {_RC} AS rc FROM reads)",
        f"""tries AS (SELECT i, k, fwd, p5, p3, p5 + 9 AS e1, p3 + 9 AS e2 FROM (SELECT i, k, fwd, instr(fwd, 'GATACGCATT') - 1 AS p5, length(fwd) - instr(reverse(fwd), reverse('CTTGACCAGT')) + 1 - 10 AS p3
             FROM (SELECT i, 1 AS k, fwd FROM both_ways UNION ALL SELECT i, 2, rc FROM both_ways)))""",
        f"o AS (SELECT i, max(outcome) FILTER (WHERE k = 1) AS a, max(outcome) FILTER (WHERE k = 2) AS b FROM (SELECT i, k, {_OUTCOME} AS outcome FROM tries) GROUP BY i)",
    )
)
def parse_outcome_rc(spark: SparkSession, d: str) -> DataFrame:
    """Reads by outcome if the reverse complement is tried after an error."""
    config = importer.Config(X.P5, X.P3, X.SIZE, primer_tolerance=0, retry_reverse_complement=True)
    return X.parsed(spark, d, config).groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    X.twin(
        """SELECT stat, value FROM (SELECT count(*) FILTER (WHERE o <> 'INVALID_ALPHABET') AS "PROCESSED_READS", count(*) FILTER (WHERE o = 'ACCEPTED_READS') AS "ACCEPTED_READS",
           0::BIGINT AS "CONTIG_ASSEMBLY_FAILS", count(*) FILTER (WHERE o = 'INVALID_ALPHABET') AS "INVALID_ALPHABET", count(*) FILTER (WHERE o = 'FIVE_PRIME_ERROR') AS "FIVE_PRIME_ERROR",
           count(*) FILTER (WHERE o = 'THREE_PRIME_ERROR') AS "THREE_PRIME_ERROR", 0::BIGINT AS "INVALID_CYCLE", count(*) FILTER (WHERE o = 'TOTAL_PRIMER_OVERLAPS') AS "TOTAL_PRIMER_OVERLAPS" FROM outcomes)
           UNPIVOT (value FOR stat IN ("PROCESSED_READS", "ACCEPTED_READS", "CONTIG_ASSEMBLY_FAILS", "INVALID_ALPHABET", "FIVE_PRIME_ERROR", "THREE_PRIME_ERROR", "INVALID_CYCLE", "TOTAL_PRIMER_OVERLAPS"))""",
        _located(),
        f"outcomes AS (SELECT {_OUTCOME} AS o FROM located)",
    )
)
def parser_stats(spark: SparkSession, d: str) -> DataFrame:
    """The eight parser counters."""
    return importer.counters(X.parsed(spark, d))


@query(X.twin("SELECT outcome, s AS start_index, e AS end_index, count(*) AS n, count(DISTINCT seq) AS n_sequences FROM (SELECT CASE WHEN fwd SIMILAR TO '.*[^ACGT].*' THEN 'INVALID_ALPHABET' ELSE 'ACCEPTED_READS' END AS outcome, CASE WHEN fwd SIMILAR TO '[ACGT]*' THEN 10 END AS s, CASE WHEN fwd SIMILAR TO '[ACGT]*' THEN 10 + length(fwd) END AS e, CASE WHEN fwd SIMILAR TO '[ACGT]*' THEN 'GATACGCATT' || fwd || 'CTTGACCAGT' END AS seq FROM reads) GROUP BY ALL"))
def region_only_mode(spark: SparkSession, d: str) -> DataFrame:
    """Contigs taken as regions, primers put around them."""
    config = importer.Config(X.P5, X.P3, X.SIZE, mode="region_only")
    return X.parsed(spark, d, config).groupBy("outcome", "start_index", "end_index").agg(F.count("*").alias("n"), F.countDistinct("sequence").alias("n_sequences"))


@query(X.twin("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN fwd SIMILAR TO '.*[^ACGT].*' THEN 'INVALID_ALPHABET' WHEN length(fwd) <> 40 THEN 'CONTIG_ASSEMBLY_FAILS' ELSE 'ACCEPTED_READS' END AS outcome FROM reads) GROUP BY 1"))
def batch_mode(spark: SparkSession, d: str) -> DataFrame:
    """Contigs that are regions of an exact size."""
    return X.parsed(spark, d, importer.Config(exact_size=40, mode="batch")).groupBy("outcome").agg(F.count("*").alias("n"))


@query(X.twin("SELECT translate(reverse(sequence), 'ACGT', 'TGCA') AS sequence, 10 AS start_index, 30 AS end_index, count(*) AS n FROM accepted GROUP BY ALL"))
def store_revcomp(spark: SparkSession, d: str) -> DataFrame:
    """Accepted sequences stored as reverse complements with their bounds."""
    config = importer.Config(X.P5, X.P3, X.SIZE, primer_tolerance=0, store_reverse_complement=True)
    return X.parsed(spark, d, config).filter("outcome = 'ACCEPTED_READS'").groupBy("sequence", "start_index", "end_index").agg(F.count("*").alias("n"))


_CODES = ["ACACAC", "CAGTCA", "GTTGAC", "TGACTG", "AACCGG"]


@query(
    X.twin(
        f"""SELECT CASE WHEN NOT fwd SIMILAR TO '[ACGT]*' THEN 'INVALID_ALPHABET' WHEN p5 < 0 THEN 'FIVE_PRIME_ERROR' WHEN p3 < 0 THEN 'THREE_PRIME_ERROR' WHEN barcode IS NULL THEN 'INVALID_CYCLE' WHEN p3 - p5 - 10 = 20 THEN 'ACCEPTED_READS' ELSE 'SIZE_MISMATCH' END AS outcome,
           barcode, count(*) AS n FROM (SELECT *, list_min([k - 1 FOR k IN range(1, 6) IF p5 > 0 AND instr(substr(fwd, 1, p5), ({_CODES})[k]) > 0])::INT AS barcode FROM coded) GROUP BY ALL""",
        "written AS (SELECT CASE round WHEN 0 THEN 'ACACAC' WHEN 1 THEN 'CAGTCA' WHEN 2 THEN 'GTTGAC' WHEN 3 THEN 'TGACTG' WHEN 4 THEN 'AACCGG' ELSE 'TTTTTT' END || fwd AS fwd FROM reads)",
        "coded AS (SELECT fwd, instr(fwd, 'GATACGCATT') - 1 AS p5, CASE WHEN instr(fwd, 'CTTGACCAGT') > 0 THEN length(fwd) - instr(reverse(fwd), reverse('CTTGACCAGT')) + 1 - 10 ELSE -1 END AS p3 FROM written)",
    )
)
def barcode_cycle_exact(spark: SparkSession, d: str) -> DataFrame:
    """Reads with a barcode before the 5' primer, dealt to rounds by it."""
    code = F.coalesce(F.get(F.array(*[F.lit(c) for c in _CODES]), F.col("round")), F.lit("TTTTTT"))
    reads = X.reads(spark, d).withColumn("fwd", F.concat(code, F.col("fwd")))
    config = importer.Config(X.P5, X.P3, X.SIZE, primer_tolerance=0, barcode_tolerance=0, barcodes5=tuple(_CODES))
    return importer.parse_exact(reads, config).groupBy("outcome", "barcode").agg(F.count("*").alias("n"))


_LONG = "ACGTTGGAACCACGTACGATTGGAACCTTGACCAGT"


@query(
    X.twin(
        "SELECT p_partkey, (h // 1000)::INT AS errors, (h % 1000)::INT AS index FROM best WHERE h // 1000 <= 26",
        f"probe AS (SELECT p_partkey, s || s AS t FROM (SELECT p_partkey, translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM part))",
        f"best AS (SELECT p_partkey, min(hamming(substr(t, k + 1, {len(_LONG)}), '{_LONG}') * 1000 + k) AS h FROM probe, range(0, 64 - {len(_LONG)} + 1) r(k) GROUP BY 1)",
    )
)
def hamming_primer_search(spark: SparkSession, d: str) -> DataFrame:
    """A pattern of more than 32 bases: the first place of the fewest mismatches."""
    s = X.sequence_of(F.col("p_partkey"))
    # dealt out, as a small file of keys is read by few tasks
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey").repartition("p_partkey").select("p_partkey", F.concat(s, s).alias("t"))
    hit = seq.hamming_search(F.col("t"), F.lit(_LONG), 26)
    return rows.withColumn("hit", hit).filter("hit is not null").select("p_partkey", F.col("hit.errors").cast("int").alias("errors"), F.col("hit.index").cast("int").alias("index"))


@query(X.twin("SELECT l_orderkey % 10 AS kind, bool_and(fwd = translate(reverse(translate(reverse(fwd), 'ACGT', 'TGCA')), 'ACGT', 'TGCA')) AS involution, min(translate(reverse(fwd), 'ACGT', 'TGCA')) AS least FROM reads GROUP BY 1"))
def reverse_complements(spark: SparkSession, d: str) -> DataFrame:
    rows = X.reads(spark, d)
    back = seq.reverse_complement(seq.reverse_complement(F.col("fwd")))
    return rows.groupBy((F.col("l_orderkey") % 10).alias("kind")).agg(F.bool_and(F.col("fwd") == back).alias("involution"), F.min(seq.reverse_complement(F.col("fwd"))).alias("least"))


# --- pool -------------------------------------------------------------------------------------------------------------


@query(X.twin("SELECT * FROM aptamers"))
def aptamer_pool(spark: SparkSession, d: str) -> DataFrame:
    return X.aptamers(spark, d)


@query(X.twin("SELECT cycle_name, round, aptamer_id, count FROM counts JOIN aptamers USING (sequence)"))
def cycle_counts(spark: SparkSession, d: str) -> DataFrame:
    return pool.cycle_counts(X.accepted(spark, d), X.aptamers(spark, d))


@query(X.twin("SELECT cycle_name, round, sum(count)::BIGINT AS total_size, count(*) AS unique_size FROM counts GROUP BY ALL"))
def cycle_sizes(spark: SparkSession, d: str) -> DataFrame:
    return pool.sizes(X.counts(spark, d))


@query(X.twin("SELECT sequence, total, row_number() OVER (ORDER BY total DESC, sequence)::INT AS abundance_rank FROM (SELECT sequence, sum(count)::BIGINT AS total FROM counts GROUP BY 1)"))
def abundance_rank(spark: SparkSession, d: str) -> DataFrame:
    return pool.abundance_rank(X.counts(spark, d))


@query(X.twin("SELECT sequence, coalesce(count, 0)::BIGINT AS count FROM (SELECT DISTINCT sequence FROM accepted) LEFT JOIN (SELECT sequence, count FROM counts WHERE round = 3) USING (sequence)"))
def aptamer_cardinality_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    c = X.counts(spark, d)
    return pool.cardinality(c.select("sequence").distinct(), c, "1998")


@query(X.twin("SELECT sequence FROM (SELECT DISTINCT sequence FROM accepted) WHERE sequence IN (SELECT sequence FROM counts WHERE round = 6)"))
def cycle_membership_semi(spark: SparkSession, d: str) -> DataFrame:
    c = X.counts(spark, d)
    return pool.members(c.select("sequence").distinct(), c, "2001")


@query(X.twin("SELECT region AS sequence, coalesce(aptamer_id, -1) AS aptamer_id FROM (SELECT DISTINCT CASE WHEN l_partkey % 2 = 0 THEN region ELSE sequence END AS region FROM accepted) q LEFT JOIN aptamers a ON a.sequence = q.region"))
def sequence_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = X.accepted(spark, d).select(F.when(F.col("l_partkey") % 2 == 0, F.col("region")).otherwise(F.col("sequence")).alias("sequence")).distinct()
    return pool.lookup(rows, X.aptamers(spark, d))


@query(X.twin("SELECT round, lead(round) OVER (ORDER BY round) AS next_round, lag(round) OVER (ORDER BY round) AS previous_round FROM (SELECT DISTINCT round FROM counts)"))
def neighbour_rounds(spark: SparkSession, d: str) -> DataFrame:
    return pool.neighbours(X.counts(spark, d).select("round").distinct())


@query(
    X.twin(
        "SELECT c.cycle_name, c.round, c.sequence, c.count, round(c.p, 6) AS proportion, round(c.p / o.p, 6) AS fold_change FROM shares c LEFT JOIN shares o ON o.sequence = c.sequence AND o.round = c.round - 1",
        "shares AS (SELECT *, count / sum(count) OVER (PARTITION BY round) AS p FROM counts)",
    )
)
def round_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return pool.enrichment(X.counts(spark, d)).select("cycle_name", "round", "sequence", "count", r6("proportion", "proportion"), r6("fold_change", "fold_change"))


@query(X.twin("SELECT sequence, list(struct_pack(round := round, count := count) ORDER BY round) AS observed FROM counts GROUP BY 1"))
def observed_rounds(spark: SparkSession, d: str) -> DataFrame:
    return pool.observed_rounds(X.counts(spark, d))


# --- metadata ---------------------------------------------------------------------------------------------------------


@query(X.twin("SELECT cycle_name, (i - 1)::INT AS position, round(avg(q), 6) AS mean, round(var_samp(q), 6) AS variance, round(stddev_samp(q), 6) AS stddev, count(*) AS count FROM (SELECT cycle_name, i, ascii(substr(fwd_qual, i::INT, 1)) - 33 AS q FROM accepted, range(1, 41) r(i)) GROUP BY ALL"))
def quality_by_position(spark: SparkSession, d: str) -> DataFrame:
    return metadata.quality(X.accepted(spark, d)).select("cycle_name", "position", r6("mean", "mean"), r6("variance", "variance"), r6("stddev", "stddev"), "count")


@query(X.twin("SELECT cycle_name, (i - 1)::INT AS position, substr(fwd, i::INT, 1) AS base, count(*) AS count FROM accepted, range(1, 41) r(i) GROUP BY ALL"))
def base_dist_forward(spark: SparkSession, d: str) -> DataFrame:
    return metadata.bases(X.accepted(spark, d))


@query(X.twin("SELECT cycle_name, 20 AS region_size, (i - 1)::INT AS position, substr(region, i::INT, 1) AS base, sum(count)::BIGINT AS count FROM counts, range(1, 21) r(i) GROUP BY ALL"))
def accepted_base_dist(spark: SparkSession, d: str) -> DataFrame:
    return metadata.region_bases(X.counts(spark, d))


@query(X.twin("SELECT length(fwd)::INT AS length, count(*) AS count FROM reads GROUP BY 1"))
def length_distribution(spark: SparkSession, d: str) -> DataFrame:
    return metadata.lengths(X.reads(spark, d).withColumn("count", F.lit(1).cast("long")), "fwd")


@query(X.twin("SELECT base, round(sum(n) / sum(sum(n)) OVER (), 6) AS ratio FROM (SELECT substr(region, i::INT, 1) AS base, sum(count) AS n FROM counts, range(1, 21) r(i) WHERE round = 6 GROUP BY ALL) GROUP BY base"))
def base_ratios(spark: SparkSession, d: str) -> DataFrame:
    return metadata.base_ratios(X.counts(spark, d).filter("round = 6")).select("base", r6("ratio", "ratio"))


# --- frequency-based clustering ---------------------------------------------------------------------------------------

_LAST = "lastround AS (SELECT region, sum(count)::BIGINT AS count FROM counts WHERE round = 6 GROUP BY 1)"


def _support_sql(k: int) -> str:
    return f"support AS (SELECT subsequence, sum(count)::BIGINT AS observed_count FROM (SELECT DISTINCT region, count, substr(region, i::INT, {k}) AS subsequence FROM lastround, range(1, {X.SIZE - k + 2}) r(i)) GROUP BY 1)"


def _last_round(spark: SparkSession, d: str) -> DataFrame:
    return X.counts(spark, d).filter("round = 6")


@query(X.twin("SELECT * FROM support", _LAST, _support_sql(5)))
def kmer_support(spark: SparkSession, d: str) -> DataFrame:
    return fsbc.support(_last_round(spark, d), 5)


_STRINGS = "letters(c) AS (VALUES ('A'), ('T'), ('C'), ('G')), strings AS (SELECT a.c || b.c || x.c || e.c || f.c AS subsequence FROM letters a, letters b, letters x, letters e, letters f)"
_RATIOS = "ratios AS (SELECT base, sum(n) / sum(sum(n)) OVER () AS ratio FROM (SELECT substr(region, i::INT, 1) AS base, sum(count) AS n FROM lastround, range(1, 21) r(i) GROUP BY ALL) GROUP BY base)"


@query(X.twin("SELECT subsequence, [left(subsequence, i) FOR i IN range(1, 5) IF left(subsequence, i) = right(subsequence, i)] AS overlaps FROM strings", _STRINGS))
def self_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return fsbc.every_string(spark, fsbc.DNA, 5).select("subsequence", seq.self_overlaps(F.col("subsequence")).alias("overlaps"))


@query(X.twin("SELECT subsequence, round(product(ratio), 6) AS probability FROM (SELECT subsequence, ratio FROM strings, range(1, 6) r(i), ratios WHERE base = substr(subsequence, i::INT, 1)) GROUP BY 1", _LAST, _STRINGS, _RATIOS))
def string_probability(spark: SparkSession, d: str) -> DataFrame:
    ratios, _, _ = fsbc.inputs(_last_round(spark, d))
    return fsbc.every_string(spark, fsbc.DNA, 5).select("subsequence", r6(seq.string_probability(F.col("subsequence"), ratios), "probability"))


_INCLUSION = """
chance AS (SELECT subsequence AS s, product(ratio) AS p FROM (SELECT subsequence, ratio FROM strings, range(1, 6) r(i), ratios WHERE base = substr(subsequence, i::INT, 1)) GROUP BY 1),
borders AS (SELECT s, n, product(ratio) AS q FROM (SELECT s, n::INT AS n, ratio FROM chance, range(1, 5) r(n), range(1, 5) j(i), ratios WHERE left(s, n::INT) = right(s, n::INT) AND i <= n AND base = substr(s, i::INT, 1)) GROUP BY ALL),
laps AS (SELECT s, p, list(struct_pack(n := n, q := q)) FILTER (WHERE n IS NOT NULL) AS o FROM chance LEFT JOIN borders USING (s) GROUP BY ALL),
steps AS (
  SELECT s, p, o, 4 AS i, [0.0, 0.0, 0.0, 0.0, p]::DOUBLE[] AS acc FROM laps
  UNION ALL
  SELECT s, p, o, i + 1, list_append(acc, greatest(0.0, least(1.0, acc[i + 1] + p * (1 - acc[i + 2 - 5])
    - coalesce(list_sum([CASE WHEN i + 1 - 5 + x.n > 0 THEN p / x.q * (acc[i + 2 - 5 + x.n] - acc[i + 1 - 5 + x.n]) ELSE 0 END FOR x IN o]), 0)))) FROM steps WHERE i < 19)"""


@query(X.twin("SELECT s AS subsequence, round(acc[20], 6) AS probability FROM steps WHERE i = 19", _LAST, _STRINGS, _RATIOS, _INCLUSION, recursive=True))
def inclusion_probability(spark: SparkSession, d: str) -> DataFrame:
    """The probability that a region of 20 bases holds each string of five."""
    ratios, _, _ = fsbc.inputs(_last_round(spark, d))
    p = seq.inclusion_probabilities(F.col("subsequence"), ratios, X.SIZE)
    return fsbc.every_string(spark, fsbc.DNA, 5).select("subsequence", r6(F.get(p, F.lit(X.SIZE - 1)), "probability"))


_LEVEL = """
total AS (SELECT sum(count) AS n FROM lastround),
scored AS (SELECT s AS subsequence, coalesce(observed_count, 0)::BIGINT AS observed_count, acc[20] AS e, (coalesce(observed_count, 0) - n * acc[20]) / sqrt(n * acc[20] * (1 - acc[20])) AS z
  FROM steps LEFT JOIN support ON s = subsequence, total WHERE i = 19),
level AS (SELECT *, (z - avg(z) OVER ()) / stddev_pop(z) OVER () AS nz FROM scored WHERE z > 0)"""


@query(X.twin("SELECT subsequence, 5 AS length, observed_count, round(e, 6) AS expected_fraction, round(z, 6) AS z_score, round(nz, 6) AS normalized_z_score FROM level", _LAST, _STRINGS, _RATIOS, _INCLUSION, _support_sql(5), _LEVEL, recursive=True))
def fsbc_level_scores(spark: SparkSession, d: str) -> DataFrame:
    """The positive scores of the first level."""
    c = _last_round(spark, d)
    out = fsbc.scored(fsbc.every_string(spark, fsbc.DNA, 5), fsbc.support(c, 5), *fsbc.inputs(c)).filter("z_score > 0")
    return fsbc.standardised(out).select("subsequence", "length", "observed_count", r6("expected_fraction", "expected_fraction"), r6("z_score", "z_score"), r6("normalized_z_score", "normalized_z_score"))



# --- hashing ----------------------------------------------------------------------------------------------------------

_PLACES = lsh.sampled_places(X.SIZE, 7, 3, 7)
_PLACES2 = lsh.sampled_places(X.SIZE, 5, 1, 3)
_KEY = " || ".join(f"substr(region, {p + 1}, 1)" for p in _PLACES)
_KEY2 = " || ".join(f"substr(region, {p + 1}, 1)" for p in _PLACES2)


@query(X.twin(f"SELECT {_KEY} AS bucket, count(DISTINCT sequence) AS n_sequences, sum(count)::BIGINT AS total FROM counts GROUP BY 1"))
def lsh_buckets(spark: SparkSession, d: str) -> DataFrame:
    return lsh.buckets(X.counts(spark, d), _PLACES).groupBy("bucket").agg(F.countDistinct("sequence").alias("n_sequences"), F.sum("count").alias("total"))


_DISTANCE = """
pairs AS (SELECT DISTINCT sequence AS a, 'GATACGCATT' || substr(region, 1, 8) || 'TTGGAACC' || substr(region, 17, 4) || 'CTTGACCAGT' AS b FROM counts WHERE round = 6),
grams AS (SELECT a, b, substr(a, i::INT, 3) AS g, 1 AS x, 0 AS y FROM pairs, range(1, 38) r(i) UNION ALL SELECT a, b, substr(b, i::INT, 3), 0, 1 FROM pairs, range(1, 38) r(i)),
sums AS (SELECT a, b, g, sum(x) / 38 - sum(y) / 38 AS v FROM grams GROUP BY ALL)"""


@query(X.twin("SELECT a, b, round(CASE WHEN count(*) <= 1 THEN 2.0 ELSE sum(v * v) END, 6) AS distance FROM sums GROUP BY ALL", _DISTANCE))
def kmer_distance_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The distance of each sequence of the last round to a mutant of it."""
    b = F.concat(F.lit(X.P5), F.substring("region", 1, 8), F.lit(X.MOTIF), F.substring("region", 17, 4), F.lit(X.P3))
    rows = _last_round(spark, d).select(F.col("sequence").alias("a"), b.alias("b")).distinct()
    return rows.select("a", "b", r6(seq.kmer_distance(F.col("a"), F.col("b"), 3), "distance"))


def _start(spark: SparkSession, d: str) -> DataFrame:
    """Clusters to begin with: the first places of the region, numbered by their least rank."""
    c = X.counts(spark, d)
    ranked = pool.abundance_rank(c).join(c.select("sequence", "region").distinct(), "sequence")
    return ranked.withColumn("cluster_id", F.min("abundance_rank").over(Window.partitionBy(F.substring("region", 1, 4))).cast("long")).select("sequence", "region", "abundance_rank", "cluster_id")


_START = "ranked AS (SELECT sequence, any_value(region) AS region, row_number() OVER (ORDER BY sum(count) DESC, sequence) AS rank FROM counts GROUP BY sequence), start AS (SELECT *, min(rank) OVER (PARTITION BY substr(region, 1, 4)) AS cid FROM ranked)"
_HEADS = f"heads AS (SELECT *, {_KEY2} AS bucket, first_value(sequence) OVER w AS hs, first_value(cid) OVER w AS hc FROM start WINDOW w AS (PARTITION BY {_KEY2} ORDER BY rank))"
_NEAR = """
hgrams AS (SELECT sequence, hs, substr(hs, i::INT, 3) AS g, 1 AS x, 0 AS y FROM heads, range(1, 38) r(i) UNION ALL SELECT sequence, hs, substr(sequence, i::INT, 3), 0, 1 FROM heads, range(1, 38) r(i)),
near AS (SELECT sequence, CASE WHEN count(*) <= 1 THEN 2.0 ELSE sum(v * v) END AS dist FROM (SELECT sequence, g, (sum(x) - sum(y)) / 38 AS v FROM hgrams GROUP BY ALL) GROUP BY 1)"""


@query(X.twin("SELECT sequence, (CASE WHEN cid <> hc AND dist <= 0.0150 THEN hc ELSE cid END)::BIGINT AS cluster_id FROM heads JOIN near USING (sequence)", _START, _HEADS, _NEAR))
def lsh_reassign_step(spark: SparkSession, d: str) -> DataFrame:
    """A later round of hashing: members near the first of their bucket go over to its cluster."""
    return lsh.reassigned(_start(spark, d), _PLACES2, 0.0150, 3).select("sequence", "cluster_id")


@query(X.twin("SELECT sequence, (dense_rank() OVER (ORDER BY cid) - 1)::INT AS cluster_id FROM start", _START))
def cluster_renumber(spark: SparkSession, d: str) -> DataFrame:
    return lsh.renumbered(_start(spark, d)).select("sequence", F.col("cluster_id").cast("int").alias("cluster_id"))


# --- motifs -----------------------------------------------------------------------------------------------------------

_CTX = "hbimd"
_PROFILE = "profiles AS (SELECT region, c, p::INT AS p, (instr('0123456789abcdef', substr(md5(region || c), p::INT, 1)) - 1) / 100.0::DOUBLE AS v FROM (SELECT DISTINCT region FROM counts), range(1, 21) r(p), (VALUES ('h'), ('b'), ('i'), ('m'), ('d')) x(c))"
_K, _ALPHA = 3, 2


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return X.regions(spark, d)


@query(X.twin("SELECT kmer, round, sum(count)::BIGINT AS total FROM (SELECT DISTINCT sequence, round, count, substr(region, i::INT, 6) AS kmer FROM counts, range(1, 16) r(i)) GROUP BY ALL"))
def kmer_round_totals(spark: SparkSession, d: str) -> DataFrame:
    return motif.round_totals(X.counts(spark, d), 6)


_WINDOWS = f"windows AS (SELECT w.region, s::INT - 1 AS position, substr(w.region, s::INT, {_K}) AS kmer, c, sum(v) / {_K} AS a FROM profiles w, range(1, {22 - _K}) r(s) WHERE p > s AND p < s + {_K} GROUP BY ALL)"


@query(X.twin("SELECT region, position, kmer, round(max(a) FILTER (WHERE c = 'h'), 6) AS h, round(max(a) FILTER (WHERE c = 'b'), 6) AS b, round(max(a) FILTER (WHERE c = 'i'), 6) AS i, round(max(a) FILTER (WHERE c = 'm'), 6) AS m, round(max(a) FILTER (WHERE c = 'd'), 6) AS d FROM windows GROUP BY ALL", _PROFILE, _WINDOWS))
def context_window_avg(spark: SparkSession, d: str) -> DataFrame:
    """Mean contexts of k-mer windows."""
    return motif.windows(_regions(spark, d), _K).select("region", "position", "kmer", *[r6(F.col("ctx")[i], c) for i, c in enumerate(_CTX)])


_SUMS = f"sums AS (SELECT kmer, round, c, sum(CASE WHEN count > {_ALPHA} THEN count ELSE 0 END) AS n, sum(CASE WHEN count <= {_ALPHA} THEN count ELSE 0 END) AS s, sum(CASE WHEN count > {_ALPHA} THEN a * count ELSE 0 END) AS x, sum(CASE WHEN count <= {_ALPHA} THEN a * count ELSE 0 END) AS y FROM windows JOIN counts USING (region) GROUP BY ALL)"


@query(X.twin("SELECT kmer, round, max(n)::BIGINT AS n_nonsingleton, max(s)::BIGINT AS n_singleton, " + ", ".join(f"round(max(x) FILTER (WHERE c = '{c}'), 6) AS {c}, round(max(y) FILTER (WHERE c = '{c}'), 6) AS {c}_singleton" for c in _CTX) + " FROM sums GROUP BY ALL", _PROFILE, _WINDOWS, _SUMS))
def kmer_context_sums(spark: SparkSession, d: str) -> DataFrame:
    out = motif.context_sums(X.counts(spark, d), _regions(spark, d), motif.Config(_K, _ALPHA))
    return out.select("kmer", "round", "n_nonsingleton", "n_singleton", *[r6(F.col(n)[i], c + end) for n, end in (("ctx", ""), ("ctx_singleton", "_singleton")) for i, c in enumerate(_CTX)])


@query(X.twin("SELECT round, sum(count)::BIGINT AS reads FROM counts GROUP BY 1"))
def round_read_counts(spark: SparkSession, d: str) -> DataFrame:
    return motif.round_reads(X.counts(spark, d))


_KL = """
totals AS (SELECT kmer, round, sum(count) AS total FROM (SELECT DISTINCT sequence, round, count, substr(region, i::INT, 3) AS kmer FROM counts, range(1, 19) r(i)) GROUP BY ALL),
enough AS (SELECT kmer FROM totals GROUP BY 1 HAVING count(*) = 7 AND min(total) >= 100),
merged AS (SELECT kmer, round, c, s, CASE WHEN (n < 100 OR round = 0) AND n + s >= 100 THEN n + s ELSE n END AS n2, CASE WHEN (n < 100 OR round = 0) AND n + s >= 100 THEN x + y ELSE x END AS x2, y FROM sums SEMI JOIN enough USING (kmer)),
means AS (SELECT kmer, round, c, n2, s, CASE WHEN n2 = 0 THEN 'nan'::DOUBLE ELSE x2 / n2 END AS p, CASE WHEN s = 0 THEN 'nan'::DOUBLE ELSE y / s END AS q FROM merged),
rests AS (SELECT kmer, round, max(n2) AS n2, max(s) AS s, 1 - sum(p) AS p, 1 - sum(q) AS q, bool_and(c <> 'h' OR p <= 1) AS okp, bool_and(c <> 'h' OR q <= 1) AS okq FROM means GROUP BY ALL),
parts AS (
  SELECT a.kmer, a.round AS k, b.round AS j, sum(CASE WHEN a.p > 0 AND b.p > 0 THEN a.p * ln(a.p / b.p) ELSE 0 END) AS e, sum(CASE WHEN a.q > 0 AND b.q > 0 THEN a.q * ln(a.q / b.q) ELSE 0 END) AS f
  FROM means a JOIN means b ON a.kmer = b.kmer AND a.c = b.c AND b.round < a.round GROUP BY ALL),
kl AS (
  SELECT z.kmer, CASE WHEN bool_and(a.n2 >= 100 AND b.n2 >= 100 AND a.okp AND b.okp) THEN avg(e + CASE WHEN a.p > 0 AND b.p > 0 THEN a.p * ln(a.p / b.p) ELSE 0 END) ELSE 0 END AS kl,
         CASE WHEN bool_and(a.s >= 100 AND b.s >= 100 AND a.okq AND b.okq) THEN avg(f + CASE WHEN a.q > 0 AND b.q > 0 THEN a.q * ln(a.q / b.q) ELSE 0 END) ELSE 0 END AS kls
  FROM parts z JOIN rests a ON a.kmer = z.kmer AND a.round = z.k JOIN rests b ON b.kmer = z.kmer AND b.round = z.j GROUP BY 1)"""


def _traced(spark: SparkSession, d: str) -> tuple[DataFrame, int, int]:
    c = X.counts(spark, d)
    reads = {r["round"]: r["reads"] for r in motif.round_reads(c).collect()}
    rounds = sorted(reads)
    return motif.scores(motif.traces(c, _regions(spark, d), motif.Config(_K, _ALPHA), rounds), len(rounds), reads[rounds[-1]]), len(rounds), reads[rounds[-1]]


@query(X.twin("SELECT kmer, round(kl, 6) AS kl, round(kls, 6) AS kl_singleton, round(total / (SELECT sum(count) FROM counts WHERE round = 6), 6) AS proportion FROM kl JOIN totals USING (kmer) WHERE round = 6", _PROFILE, _WINDOWS, _SUMS, _KL))
def kl_scores(spark: SparkSession, d: str) -> DataFrame:
    """The shift of contexts of k-mers over the rounds."""
    return _traced(spark, d)[0].select("kmer", r6("kl", "kl"), r6("kl_singleton", "kl_singleton"), r6("proportion", "proportion"))


@query(X.twin("SELECT kmer, (arg_max(c, v) - 1)::INT AS selection_context FROM (SELECT kmer, instr('hbimd', c)::INT AS c, round(sum((2 * round - 6) * p), 9) AS v FROM means GROUP BY ALL UNION ALL SELECT kmer, 6, round(sum((2 * round - 6) * p), 9) FROM rests GROUP BY ALL) GROUP BY 1", _PROFILE, _WINDOWS, _SUMS, _KL))
def selection_context(spark: SparkSession, d: str) -> DataFrame:
    return _traced(spark, d)[0].select("kmer", "selection_context")


@query(X.twin("SELECT round(max(lkl) FILTER (WHERE a = least(floor(0.9 * n), n - 1) + 1), 6) AS top_score, round(max(proportion) FILTER (WHERE b = least(floor(0.9 * n), n - 1) + 1), 6) AS top_proportion, max(n) AS n FROM (SELECT ln(kl) AS lkl, total / (SELECT sum(count) FROM counts WHERE round = 6) AS proportion, row_number() OVER (ORDER BY kl) AS a, row_number() OVER (ORDER BY total) AS b, count(*) OVER () AS n FROM kl JOIN totals USING (kmer) WHERE round = 6 AND kl >= 1e-6 AND kls >= 1e-6)", _PROFILE, _WINDOWS, _SUMS, _KL))
def theta_cut(spark: SparkSession, d: str) -> DataFrame:
    """The 90 % cuts of log scores and proportions."""
    rows = _traced(spark, d)[0].filter("kl >= 1e-6 and kl_singleton >= 1e-6")
    both = rows.select(F.log("kl").alias("s"), "proportion", F.row_number().over(Window.orderBy("kl")).alias("a"), F.row_number().over(Window.orderBy("proportion")).alias("b"), F.count("*").over(Window.partitionBy()).alias("n"))
    at = F.least(F.floor(0.9 * F.col("n")), F.col("n") - 1) + 1
    return both.agg(r6(F.max(F.when(F.col("a") == at, F.col("s"))), "top_score"), r6(F.max(F.when(F.col("b") == at, F.col("proportion"))), "top_proportion"), F.max("n").alias("n"))


_HIT = f"hits AS (SELECT 0 AS motif, sequence, count, count <= {_ALPHA} AS rare, substr(sequence, 10 + s::INT - 1, 8) AS filled FROM counts, range(1, 16) r(s) WHERE round = 6 AND substr(region, s::INT, 6) = 'TTGGAA')"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Places of TTGGAA in the last round, laid out with a blank on either side."""
    c = _last_round(spark, d)
    rows = c.select("sequence", "region", "count", F.posexplode(seq.kmers(F.col("region"), 6)).alias("position", "kmer")).filter("kmer = 'TTGGAA'")
    return rows.select(F.lit(0).alias("motif"), "sequence", "count", (F.col("count") <= _ALPHA).alias("rare"), motif.filled(F.lit("-TTGGAA-"), F.col("sequence"), F.col("position") + 10).alias("filled"))


@query(X.twin("SELECT motif, rare, (i - 1)::INT AS position, substr(filled, i::INT, 1) AS base, sum(count)::BIGINT AS weight FROM hits, range(1, 9) r(i) GROUP BY ALL", _HIT))
def pwm(spark: SparkSession, d: str) -> DataFrame:
    return motif.pwm(_hits(spark, d))


@query(X.twin("SELECT motif, count(DISTINCT sequence) AS n_aptamers, sum(count)::BIGINT AS total FROM (SELECT DISTINCT motif, sequence, count FROM hits WHERE NOT rare) GROUP BY 1", _HIT))
def motif_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).filter("not rare").select("motif", "sequence", "count").distinct().groupBy("motif").agg(F.countDistinct("sequence").alias("n_aptamers"), F.sum("count").alias("total"))


@query(X.twin("SELECT motif, row_number() OVER (PARTITION BY motif ORDER BY count DESC, sequence)::INT AS place, sequence, count AS last_round_count, round(count / (SELECT sum(count) FROM counts WHERE round = 6), 6) AS last_round_proportion FROM (SELECT DISTINCT motif, sequence, count FROM hits)", _HIT))
def motif_members(spark: SparkSession, d: str) -> DataFrame:
    last = _last_round(spark, d).agg(F.sum("count")).first()[0]
    return motif.members(_hits(spark, d), last).select("motif", "place", "sequence", "last_round_count", r6("last_round_proportion", "last_round_proportion"))


@query()
def motifs_full(spark: SparkSession, d: str) -> DataFrame:
    return motif.motifs(X.counts(spark, d), _regions(spark, d), motif.Config(4, _ALPHA))


# --- structure and catalog --------------------------------------------------------------------------------------------


@query(X.twin("SELECT region, p - 1 AS position, round(1 - sum(v), 6) AS paired FROM profiles GROUP BY ALL", _PROFILE))
def paired_probability(spark: SparkSession, d: str) -> DataFrame:
    return _regions(spark, d).select("region", F.posexplode(seq.paired_probability(F.col("profile"), F.length("region"))).alias("position", "p")).select("region", "position", r6("p", "paired"))


def _distinct_regions(spark: SparkSession, d: str) -> DataFrame:
    return X.counts(spark, d).select("region").distinct()


@query()
def mfe(spark: SparkSession, d: str) -> DataFrame:
    """The structure of least energy of each region."""
    return structure.mfe(_distinct_regions(spark, d), "region")


@query()
def bppm(spark: SparkSession, d: str) -> DataFrame:
    """The pair probabilities of each region that are not negligible: sequence, i, j, p."""
    out = structure.bppm(_distinct_regions(spark, d), "region").select("sequence", F.posexplode("bppm").alias("at", "p"))
    places = F.broadcast(triu_index(spark, d).filter(f"j < {X.SIZE}").select("i", "j", seq.triangle_index(F.col("i"), F.col("j"), F.lit(X.SIZE)).alias("at")))
    return out.filter("p > 0.0001").join(places, "at").select("sequence", "i", "j", r6("p", "p"))


@query()
def context_profile(spark: SparkSession, d: str) -> DataFrame:
    """The context profile of each region: hairpin, bulge, interior, multiple loop, outside."""
    return structure.profiles(_distinct_regions(spark, d), "region").select("sequence", F.transform("profile", lambda x: F.round(x, 6)).alias("profile"))


@query("SELECT i::INT AS i, j::INT AS j, (row_number() OVER (ORDER BY i, j) - 1)::BIGINT AS index FROM range(0, 40) a(i), range(0, 40) b(j) WHERE i < j")
def triu_index(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.range(40 * 40).select((F.col("id") / 40).cast("int").alias("i"), (F.col("id") % 40).cast("int").alias("j")).filter("i < j")
    return rows.select("i", "j", seq.triangle_index(F.col("i"), F.col("j"), F.lit(40)).alias("index"))


@query(
    """
WITH users AS (SELECT c_custkey AS user_id, c_custkey % 400 = 7 AS is_admin FROM customer),
exps AS (SELECT s_suppkey AS experiment_id, s_nationkey AS project_id FROM supplier),
proj AS (SELECT c_custkey AS user_id, c_nationkey AS project_id, CASE WHEN c_custkey % 3 = 0 THEN 'EDITOR' ELSE 'VIEWER' END AS access_level FROM customer),
grants AS (SELECT DISTINCT o_custkey AS user_id, o_orderkey % 100 + 1 AS experiment_id, 'GRANTED' AS access_level FROM orders),
bp AS (SELECT user_id, experiment_id, access_level AS pl FROM proj JOIN exps USING (project_id)),
al AS (SELECT user_id, experiment_id, coalesce(pl, access_level) AS access_level FROM bp FULL JOIN grants USING (user_id, experiment_id))
SELECT al.* FROM al JOIN users USING (user_id) WHERE NOT is_admin
UNION ALL SELECT user_id, experiment_id, 'MANAGER' FROM users, exps WHERE is_admin"""
)
def visible_experiments(spark: SparkSession, d: str) -> DataFrame:
    """What each user sees, over users, projects and grants made of customers, nations and orders."""
    customer = spark.read.parquet(f"{d}/customer.parquet")
    users = customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 400 == 7).alias("is_admin"))
    exps = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("experiment_id"), F.col("s_nationkey").alias("project_id"))
    proj = customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("project_id"), F.when(F.col("c_custkey") % 3 == 0, "EDITOR").otherwise("VIEWER").alias("access_level"))
    grants = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 100 + 1).alias("experiment_id"), F.lit("GRANTED").alias("access_level")).distinct()
    return catalog.visible(users, exps, proj, grants)


from . import analyses  # noqa: E402, F401  its queries join these
