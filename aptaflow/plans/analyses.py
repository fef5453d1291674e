"""Whole analyses with default parameters, sources, and the steps that other queries do not reach, with their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matching, seq
from ..functions.register import register_functions
from ..operators import fsbc, importer, lsh, metadata, motif
from ..ship import ship
from ..sources import experiments, fastq
from ..store import cut, shared_dir
from ..streaming import counts as streaming
from . import experiment as X
from . import queries as Q
from .queries import query, r6


def _mapped(df: DataFrame, f: Callable[..., tuple], schema: str) -> DataFrame:
    """f of each row, in Arrow batches."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [f(*x) for x in zip(*[c.to_pylist() for c in b.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in schema.split(", ")]
    return df.mapInArrow(run, schema)


# --- fuzzy matching ---------------------------------------------------------------------------------------------------

# Approximate places in SQL: the least edit distance of the pattern (p, of m bases) from what begins at a place of t, by place.
def _errors(m: int, tolerance: int, last: str = "length(t)") -> str:
    lengths = ", ".join(f"levenshtein(substr(t, i + 1, {n}), p)" for n in range(max(1, m - tolerance), m + tolerance + 1))
    return f"[least({lengths}) * 1000 - i FOR i IN range(0, {last})]"


def _hits(name: str, source: str, m: int = 10, tolerance: int = 3) -> str:
    """Of rows (.., t, p) the right-most place of the fewest errors: idx, err; null beyond the tolerance."""
    return f"""{name} AS (SELECT * EXCLUDE (h), CASE WHEN h <= {tolerance} * 1000 THEN ((h + 999) // 1000)::INT END AS err, CASE WHEN h <= {tolerance} * 1000 THEN (((h + 999) // 1000) * 1000 - h)::INT END AS idx
      FROM (SELECT *, list_min({_errors(m, tolerance)}) AS h FROM {source}))"""


def _wrong(shift: int, m: int = 10) -> str:
    return f"list_sum([CASE WHEN idx - {shift} + q < 0 OR substr(t, (idx - {shift} + q + 1)::INT, 1) <> substr(p, (q + 1)::INT, 1) THEN 1 ELSE 0 END FOR q IN range(0, {m})])"


def _settled(name: str, source: str) -> str:
    """The primer match made of a hit: place, errors (null if there is none)."""
    return f"""{name} AS (SELECT * EXCLUDE (w), CASE WHEN err IS NULL THEN NULL WHEN err = 0 OR w[1] = err THEN idx WHEN list_min(w) <= 3 THEN idx - (list_position(w, list_min(w))::INT - 1) END AS place,
      CASE WHEN err IS NULL THEN NULL WHEN err = 0 OR w[1] = err THEN err WHEN list_min(w) <= 3 THEN list_min(w)::INT END AS errors
      FROM (SELECT *, CASE WHEN err IS NOT NULL THEN [{_wrong(0)}, {_wrong(1)}, {_wrong(2)}]::INT[] END AS w FROM {source}))"""


_TWICE = "probe AS (SELECT p_partkey, s || s AS t, 'TTGGAACCAC' AS p FROM (SELECT p_partkey, translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM part))"


def _probe(spark: SparkSession, d: str) -> DataFrame:
    s = X.sequence_of(F.col("p_partkey"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(s, s).alias("t"))


@query(f"WITH {_TWICE}, {_hits('hit', 'probe')} SELECT p_partkey, idx AS index, err AS errors FROM hit")
def bitap_hits(spark: SparkSession, d: str) -> DataFrame:
    """The right-most place with the fewest errors, three at most, of a pattern in each part's sequence written twice."""
    return _mapped(_probe(spark, d), lambda k, t: (k, *(matching.bitap(t, "TTGGAACCAC", 3) or (None, None))), "p_partkey long, index int, errors int")


@query(f"WITH {_TWICE}, {_hits('hit', 'probe')}, {_settled('done', 'hit')} SELECT p_partkey, place AS index, errors FROM done")
def primer_matches(spark: SparkSession, d: str) -> DataFrame:
    """The same hits settled by mismatches at their place or just before."""
    return _mapped(_probe(spark, d), lambda k, t: (k, *(matching.match_primer(t, "TTGGAACCAC", 3) or (None, None))), "p_partkey long, index int, errors int")


_FUZZY = [
    "whole AS (SELECT fwd, count(*) AS n FROM reads GROUP BY 1)",
    f"tries AS (SELECT fwd, 1 AS k, fwd AS c FROM whole WHERE fwd SIMILAR TO '[ACGT]*' UNION ALL SELECT fwd, 2, {Q._RC} FROM whole WHERE fwd SIMILAR TO '[ACGT]*')",
    "sides AS (SELECT fwd, k, c, 5 AS side, reverse(c) AS t, reverse('GATACGCATT') AS p FROM tries UNION ALL SELECT fwd, k, c, 3, c, 'CTTGACCAGT' FROM tries)",
    _hits("hit", "sides"),
    _settled("done", "hit"),
    "ends AS (SELECT fwd, k, length(c) AS n, max(length(c) - place - 10) FILTER (WHERE side = 5) AS five, max(place) FILTER (WHERE side = 3) AS three FROM done GROUP BY ALL)",
    """found AS (SELECT fwd, k, three - five - 10 AS size, CASE WHEN five IS NULL THEN 'FIVE_PRIME_ERROR' WHEN three IS NULL THEN 'THREE_PRIME_ERROR'
      WHEN (five + 9 >= three AND five + 9 >= three + 9) OR (five <= three + 9 AND five >= three) THEN 'TOTAL_PRIMER_OVERLAPS'
      WHEN five >= 0 AND five + 10 < three AND three <= n AND three - five - 10 BETWEEN 15 AND 25 THEN 'ACCEPTED_READS'
      WHEN five < 0 THEN 'FIVE_PRIME_ERROR' WHEN three + 10 > n THEN 'THREE_PRIME_ERROR' ELSE 'SIZE_MISMATCH' END AS outcome FROM ends)""",
    """picked AS (SELECT a.fwd, CASE WHEN a.outcome NOT IN ('ACCEPTED_READS', 'SIZE_MISMATCH') AND b.outcome <> 'SIZE_MISMATCH' THEN b.outcome ELSE a.outcome END AS outcome,
      CASE WHEN a.outcome NOT IN ('ACCEPTED_READS', 'SIZE_MISMATCH') AND b.outcome <> 'SIZE_MISMATCH' THEN b.size ELSE a.size END AS size FROM found a JOIN found b ON a.fwd = b.fwd AND a.k = 1 AND b.k = 2)""",
]


@query(
    X.twin(
        """SELECT coalesce(outcome, 'INVALID_ALPHABET') AS outcome, CASE WHEN outcome = 'ACCEPTED_READS' THEN 10 END AS start_index, CASE WHEN outcome = 'ACCEPTED_READS' THEN 10 + size END AS end_index, sum(n)::BIGINT AS n
           FROM whole LEFT JOIN picked USING (fwd) GROUP BY ALL""",
        *_FUZZY,
    )
)
def fuzzy_import(spark: SparkSession, d: str) -> DataFrame:
    """Reads by outcome with three errors allowed in each primer and a retry on the reverse complement."""
    config = importer.Config(X.P5, X.P3, lower=15, upper=25, primer_tolerance=3, retry_reverse_complement=True)
    return importer.parse_fuzzy(X.reads(spark, d), config).groupBy("outcome", "start_index", "end_index").agg(F.count("*").alias("n"))


_NEAR_CODES = ["ACACAC", "CAGTCA", "GTTGAC", "TGACTG", "AACCGG"]
#: What stands before the reads of each round: the first with an error, the last with two.
_WRITTEN = ["ACACAC", "CACTCA", "GTGAC", "TTGACTG", "AACCGG", "TTCCTT", "CCAGTCA"]


@query(
    X.twin(
        """SELECT CASE WHEN NOT fwd SIMILAR TO '[ACGT]*' THEN 'INVALID_ALPHABET' WHEN p5 < 0 THEN 'FIVE_PRIME_ERROR' WHEN p3 < 0 THEN 'THREE_PRIME_ERROR' WHEN code IS NULL THEN 'INVALID_CYCLE' WHEN p3 - p5 - 10 = 20 THEN 'ACCEPTED_READS' ELSE 'SIZE_MISMATCH' END AS outcome,
           CASE WHEN fwd SIMILAR TO '[ACGT]*' AND p5 >= 0 AND p3 - p5 - 10 = 20 THEN code END AS barcode, sum(n)::BIGINT AS n FROM coded GROUP BY ALL""",
        f"placed AS (SELECT fwd, count(*) AS n, instr(fwd, 'GATACGCATT') - 1 AS p5, CASE WHEN instr(fwd, 'CTTGACCAGT') > 0 THEN length(fwd) - instr(reverse(fwd), reverse('CTTGACCAGT')) + 1 - 10 ELSE -1 END AS p3 FROM (SELECT {_WRITTEN}[round + 1] || fwd AS fwd FROM reads) GROUP BY 1)",
        f"parts AS (SELECT *, generate_subscripts({_NEAR_CODES}, 1) - 1 AS k, unnest({_NEAR_CODES}) AS p, substr(fwd, 1, greatest(p5, 0) + 6) AS t FROM placed)",
        f"near AS (SELECT fwd, k, list_min({_errors(6, 1)}) AS h FROM parts WHERE p5 >= 0)",
        "best AS (SELECT fwd, arg_min(k, ((h + 999) // 1000) * 100 + k)::INT AS code FROM near WHERE h <= 1000 GROUP BY 1)",
        "coded AS (SELECT placed.*, code FROM placed LEFT JOIN best USING (fwd))",
    )
)
def barcode_cycle_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Reads dealt to rounds by a barcode with one error at most before the 5' primer."""
    code = F.get(F.array(*[F.lit(c) for c in _WRITTEN]), F.col("round"))
    config = importer.Config(X.P5, X.P3, X.SIZE, primer_tolerance=0, barcode_tolerance=1, barcodes5=tuple(_NEAR_CODES))
    return importer.parse_fuzzy(X.reads(spark, d).withColumn("fwd", F.concat(code, F.col("fwd"))), config).groupBy("outcome", "barcode").agg(F.count("*").alias("n"))


@query(
    X.twin(
        f"SELECT CASE WHEN fwd IS NULL THEN 'INVALID_ALPHABET' ELSE ({Q._OUTCOME}) END AS outcome, fwd = whole AS same, sum(n)::BIGINT AS n FROM located GROUP BY ALL",
        "halves AS (SELECT row_number() OVER () AS id, fwd AS whole, substr(fwd, 1, 30) AS f, substr(fwd, 11, 30) AS g, substr(fwd_qual, 1, 30) AS fq, substr(fwd_qual, 11, 30) AS gq, count(*) AS n FROM reads GROUP BY fwd, fwd_qual)",
        "laps AS (SELECT id, m, hamming(substr(f, (length(f) - m + 1)::INT, m::INT), substr(g, 1, m::INT)) AS wrong FROM halves, range(15, 31) r(m) WHERE m <= least(length(f), length(g)))",
        "best AS (SELECT id, max((m - wrong) * 100 + m) % 100 AS m FROM laps WHERE m - wrong >= 0.6666666666666667::DOUBLE * m GROUP BY 1)",
        """merged AS (SELECT whole, n, CASE WHEN m IS NOT NULL THEN substr(f, 1, (length(f) - m)::INT) || array_to_string([CASE WHEN ascii(substr(fq, (length(f) - m + i)::INT, 1)) >= ascii(substr(gq, i::INT, 1)) THEN substr(f, (length(f) - m + i)::INT, 1)
             ELSE substr(g, i::INT, 1) END FOR i IN range(1, m + 1)], '') || substr(g, (m + 1)::INT) END AS contig FROM halves LEFT JOIN best USING (id))""",
        "located AS (SELECT whole, n, contig AS fwd, p5, p3, p5 + 9 AS e1, p3 + 9 AS e2 FROM (SELECT *, instr(contig, 'GATACGCATT') - 1 AS p5, length(contig) - instr(reverse(contig), reverse('CTTGACCAGT')) + 1 - 10 AS p3 FROM merged))",
    )
)
def paired_merge(spark: SparkSession, d: str) -> DataFrame:
    """Reads cut into overlapping pairs, merged again, by outcome."""
    back = seq.reverse_complement(F.substring("fwd", 11, 30))
    rows = X.reads(spark, d).select(F.col("fwd").alias("whole"), F.substring("fwd", 1, 30).alias("fwd"), F.substring("fwd_qual", 1, 30).alias("fwd_qual"), back.alias("rev"), F.reverse(F.substring("fwd_qual", 11, 30)).alias("rev_qual"))
    return importer.parse_exact(importer.merge_pairs(rows), X.CONFIG, "contig").groupBy("outcome", (F.col("contig") == F.col("whole")).alias("same")).agg(F.count("*").alias("n"))


# --- sources ----------------------------------------------------------------------------------------------------------


def _loaded(spark: SparkSession, df: DataFrame, header: str, qualities: str | None, *, more: DataFrame | None = None) -> DataFrame:
    """df (header, bases, qualities) written as text files and read by the sources."""
    fastq.register(spark)
    paths = []
    for part in [df] + ([more] if more is not None else []):
        path = f"{shared_dir(spark)}/reads-{uuid.uuid4().hex}"
        fastq.export(part, path, header, "bases", qualities)
        paths.append(",".join(fastq.files(path)))
    reader = spark.read.format("fastq" if qualities else "fasta")
    return (reader.option("reverse", paths[1]) if more is not None else reader).load(paths[0])


@query(X.twin("SELECT fwd, fwd_qual, count(*) AS n, min(l_orderkey)::VARCHAR AS first FROM reads GROUP BY ALL"))
def fastq_scan(spark: SparkSession, d: str) -> DataFrame:
    """Reads written as FASTQ files and read again."""
    rows = X.reads(spark, d).select(F.col("l_orderkey").cast("string").alias("header"), F.col("fwd").alias("bases"), "fwd_qual")
    return _loaded(spark, rows, "header", "fwd_qual").groupBy("fwd", "fwd_qual").agg(F.count("*").alias("n"), F.min(F.col("header").cast("long")).cast("string").alias("first"))


@query(X.twin("SELECT region AS fwd, count(*) AS n FROM reads GROUP BY 1"))
def fasta_scan(spark: SparkSession, d: str) -> DataFrame:
    """Regions written as FASTA files and read again."""
    rows = X.reads(spark, d).select(F.col("l_orderkey").cast("string").alias("header"), F.col("region").alias("bases"))
    return _loaded(spark, rows, "header", None).groupBy("fwd").agg(F.count("*").alias("n"))


@query(X.twin(f"SELECT sequence AS fwd, translate(reverse(sequence), 'ACGT', 'TGCA') AS rev, 'a' || aptamer_id AS header FROM aptamers WHERE aptamer_id <= (SELECT count(*) FROM aptamers) - 3"))
def paired_scan(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of files in lock-step up to the end of the shorter one."""
    rows = X.aptamers(spark, d)
    last = rows.count()
    # one file each, as pairs go by their place
    ordered = rows.coalesce(1).sortWithinPartitions("aptamer_id").withColumns({"header": F.concat(F.lit("a"), F.col("aptamer_id")), "quals": F.repeat(F.lit("I"), F.length("sequence"))})
    one = ordered.withColumn("bases", F.col("sequence"))
    two = ordered.filter(F.col("aptamer_id") <= last - 3).withColumn("bases", seq.reverse_complement(F.col("sequence")))
    return _loaded(spark, one, "header", "quals", more=two).select("fwd", "rev", "header")


@query(X.twin("SELECT 7 AS experiment_id, aptamer_id, sequence, start_index, end_index FROM aptamers"))
def experiment_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The pool of one experiment stored beside another's and read again."""
    base = f"{shared_dir(spark)}/experiments-{uuid.uuid4().hex}"
    for i in (7, 8):
        experiments.write(X.aptamers(spark, d), base, "aptamers", i)
    return experiments.read(spark, base, "aptamers", 7).select(F.col("experiment_id").cast("int").alias("experiment_id"), "aptamer_id", "sequence", "start_index", "end_index")


@query(X.twin("SELECT CASE WHEN round < 6 THEN cycle_name END AS cycle_name, CASE WHEN round < 6 THEN round END AS round, count(*) AS n FROM reads GROUP BY ALL"))
def cycle_tagging(spark: SparkSession, d: str) -> DataFrame:
    """Reads of one file for each round, tagged with the rounds of six files."""
    rows = X.reads(spark, d).select(F.col("round").alias("file_index"))
    cycles = X.reads(spark, d).select(F.col("round").alias("file_index"), "cycle_name", "round").distinct().filter("round < 6")
    return importer.tag_cycles(rows, cycles).groupBy("cycle_name", "round").agg(F.count("*").alias("n"))


@query(X.twin("SELECT cycle_name, sequence, count(*) AS count FROM accepted GROUP BY ALL"))
def running_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts kept while files of reads arrive, as they stand after the last one."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = X.reads(spark, d).select("cycle_name", "fwd")
    rows.repartition(4).write.parquet(f"{base}/in")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    counted = streaming.running_counts(arriving, X.CONFIG).writeStream.outputMode("complete").trigger(availableNow=True)
    counted = counted.option("checkpointLocation", f"{base}/state").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out"))
    counted.start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


# --- reverse reads ----------------------------------------------------------------------------------------------------

_REVERSE = "back AS (SELECT cycle_name, substr(fwd, 6, 30) AS rev, reverse(substr(fwd_qual, 1, 30)) AS rev_qual FROM accepted)"


def _reverse(spark: SparkSession, d: str) -> DataFrame:
    rows = X.accepted(spark, d).select("cycle_name", seq.reverse_complement(F.substring("fwd", 6, 30)).alias("rev"), F.substring("fwd_qual", 1, 30).alias("rev_qual"))
    return metadata.transcribed(rows)


@query(X.twin("SELECT cycle_name, rev, rev_qual, count(*) AS n FROM back GROUP BY ALL", _REVERSE))
def transcribed_reverse(spark: SparkSession, d: str) -> DataFrame:
    """Reverse reads as they stand on the forward strand."""
    return _reverse(spark, d).groupBy("cycle_name", "rev", "rev_qual").agg(F.count("*").alias("n"))


@query(X.twin("SELECT cycle_name, (i - 1)::INT AS position, round(avg(q), 6) AS mean, round(var_samp(q), 6) AS variance, round(stddev_samp(q), 6) AS stddev, count(*) AS count FROM (SELECT cycle_name, i, ascii(substr(rev_qual, i::INT, 1)) - 33 AS q FROM back, range(1, 31) r(i)) GROUP BY ALL", _REVERSE))
def quality_by_position_reverse(spark: SparkSession, d: str) -> DataFrame:
    return metadata.quality(_reverse(spark, d), "rev_qual").select("cycle_name", "position", r6("mean", "mean"), r6("variance", "variance"), r6("stddev", "stddev"), "count")


@query(X.twin("SELECT cycle_name, (i - 1)::INT AS position, b AS base, count(*) FILTER (WHERE substr(rev, i::INT, 1) = b) AS count FROM back, range(1, 31) r(i), (VALUES ('A'), ('C'), ('G'), ('T'), ('N')) x(b) GROUP BY ALL", _REVERSE))
def base_dist_reverse(spark: SparkSession, d: str) -> DataFrame:
    """Bases of reverse reads by position, those that do not occur with 0."""
    return metadata.bases(_reverse(spark, d), "rev", seeded=True)


# --- frequency-based clustering ---------------------------------------------------------------------------------------


@query("SELECT s AS kmer, list_sum([(instr('AGTC', substr(s, i::INT, 1)) - 1) * 4 ** (5 - i) FOR i IN range(1, 6)])::BIGINT AS id FROM (SELECT a.c || b.c || x.c || e.c || f.c AS s FROM (VALUES ('A'), ('T'), ('C'), ('G')) a(c), (VALUES ('A'), ('T'), ('C'), ('G')) b(c), (VALUES ('A'), ('T'), ('C'), ('G')) x(c), (VALUES ('A'), ('T'), ('C'), ('G')) e(c), (VALUES ('A'), ('T'), ('C'), ('G')) f(c))")
def kmer_ids(spark: SparkSession, d: str) -> DataFrame:
    return fsbc.every_string(spark, fsbc.DNA, 5).select(F.col("subsequence").alias("kmer"), seq.kmer_id(F.col("subsequence")).alias("id"))


_SPOILT = "CASE round WHEN 0 THEN lower(region) WHEN 1 THEN replace(region, 'T', 'u') WHEN 2 THEN 'N' || region WHEN 3 THEN '' WHEN 4 THEN NULL ELSE region END"


@query(X.twin(f"SELECT replace(upper(r), 'U', 'T') AS region, sum(count)::BIGINT AS count FROM (SELECT {_SPOILT} AS r, count - (round = 5)::INT * 1000000 AS count FROM counts) WHERE count > 0 AND upper(r) SIMILAR TO '[ACGTU]+' GROUP BY 1"))
def fsbc_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Regions in lower case, with U, with other letters, empty, null, and without reads, as the search takes them in."""
    rows = X.counts(spark, d).select(F.expr(_SPOILT).alias("region"), F.when(F.col("round") == 5, F.col("count") - 1000000).otherwise(F.col("count")).alias("count"))
    return fsbc.normalised(rows).groupBy("region").agg(F.sum("count").alias("count"))


@query(X.twin("SELECT subsequence, observed_count FROM support WHERE subsequence LIKE 'TT%'", Q._LAST, Q._support_sql(6)))
def candidate_support(spark: SparkSession, d: str) -> DataFrame:
    """Support of some candidates alone."""
    some = fsbc.every_string(spark, fsbc.DNA, 6).filter("subsequence like 'TT%'")
    return fsbc.support(Q._last_round(spark, d), 6, some)


def _level_sql(k: int) -> list[str]:
    """One level of the search: the candidates of k bases, their scores, and those that go on."""
    if k == 5:
        candidates = f"cand_5 AS MATERIALIZED (SELECT subsequence AS s, NULL::DOUBLE AS parent FROM strings)"
    else:
        candidates = f"cand_{k} AS MATERIALIZED (SELECT subsequence || c AS s, z AS parent FROM level_{k - 1}, letters)"
    return [
        candidates,
        f"support_{k} AS MATERIALIZED (SELECT subsequence, sum(count)::BIGINT AS observed_count FROM (SELECT DISTINCT region, count, substr(region, i::INT, {k}) AS subsequence FROM lastround, range(1, {X.SIZE - k + 2}) r(i)) GROUP BY 1)",
        f"chance_{k} AS MATERIALIZED (SELECT s, product(ratio) AS p FROM cand_{k}, range(1, {k + 1}) r(i), ratios WHERE base = substr(s, i::INT, 1) GROUP BY 1)",
        f"borders_{k} AS MATERIALIZED (SELECT s, n, product(ratio) AS q FROM (SELECT s, n::INT AS n, ratio FROM chance_{k}, range(1, {k}) r(n), range(1, {k}) j(i), ratios WHERE left(s, n::INT) = right(s, n::INT) AND i <= n AND base = substr(s, i::INT, 1)) GROUP BY ALL)",
        f"laps_{k} AS MATERIALIZED (SELECT s, p, list(struct_pack(n := n, q := q)) FILTER (WHERE n IS NOT NULL) AS o FROM chance_{k} LEFT JOIN borders_{k} USING (s) GROUP BY ALL)",
        f"""steps_{k} AS (
          SELECT s, p, o, {k - 1} AS i, list_append([0.0 FOR z IN range(0, {k - 1})], p)::DOUBLE[] AS acc FROM laps_{k}
          UNION ALL
          SELECT s, p, o, i + 1, list_append(acc, greatest(0.0, least(1.0, acc[i + 1] + p * (1 - acc[i + 2 - {k}])
            - coalesce(list_sum([CASE WHEN i + 1 - {k} + x.n > 0 THEN p / x.q * (acc[i + 2 - {k} + x.n] - acc[i + 1 - {k} + x.n]) ELSE 0 END FOR x IN o]), 0)))) FROM steps_{k} WHERE i < {X.SIZE - 1})""",
        f"scored_{k} AS MATERIALIZED (SELECT c.s AS subsequence, coalesce(observed_count, 0)::BIGINT AS observed_count, acc[{X.SIZE}] AS e, (coalesce(observed_count, 0) - n * acc[{X.SIZE}]) / sqrt(n * acc[{X.SIZE}] * (1 - acc[{X.SIZE}])) AS z, parent FROM cand_{k} c JOIN steps_{k} t ON t.s = c.s AND t.i = {X.SIZE - 1} LEFT JOIN support_{k} ON c.s = subsequence, total)",
        f"level_{k} AS MATERIALIZED (SELECT *, {k} AS length, CASE WHEN stddev_pop(z) OVER () = 0 THEN 0 ELSE (z - avg(z) OVER ()) / stddev_pop(z) OVER () END AS nz FROM scored_{k} WHERE z > 0 AND (parent IS NULL OR z > parent))",
    ]


_ALL_LEVELS = " UNION ALL ".join(f"SELECT subsequence, length, observed_count, e, z, nz FROM level_{k}" for k in range(5, 11))


@query(
    X.twin(
        "SELECT row_number() OVER (ORDER BY round(nz, 9) DESC, round(z, 9) DESC, observed_count DESC, subsequence)::INT AS rank, subsequence, length, observed_count, round(e, 6) AS expected_fraction, round(z, 6) AS z_score, round(nz, 6) AS normalized_z_score FROM every",
        Q._LAST,
        Q._STRINGS,
        Q._RATIOS,
        "total AS (SELECT sum(count) AS n FROM lastround)",
        *[x for k in range(5, 11) for x in _level_sql(k)],
        f"every AS ({_ALL_LEVELS})",
        recursive=True,
    )
)
def fsbc_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The whole search over lengths 5 to 10."""
    return fsbc.search(Q._last_round(spark, d)).select("rank", "subsequence", "length", "observed_count", r6("expected_fraction", "expected_fraction"), r6("z_score", "z_score"), r6("normalized_z_score", "normalized_z_score"))


_CANDIDATES = [
    Q._LAST,
    Q._STRINGS,
    Q._RATIOS,
    "total AS (SELECT sum(count) AS n FROM lastround)",
    *[x for k in range(5, 11) for x in _level_sql(k)],
    f"cand AS MATERIALIZED (SELECT subsequence, row_number() OVER (ORDER BY round(nz, 9) DESC, round(z, 9) DESC, observed_count DESC, subsequence)::INT AS rank FROM ({_ALL_LEVELS}))",
    "held AS MATERIALIZED (SELECT sequence, count, min(rank) AS m FROM counts, cand WHERE round = 6 AND instr(region, subsequence) > 0 GROUP BY ALL)",
]


def _clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = Q._last_round(spark, d)
    return fsbc.clusters(c, cut(fsbc.search(c)))


@query(X.twin("SELECT (row_number() OVER (ORDER BY m) - 1)::INT AS cluster_id, subsequence AS seed_string, member_count, total_count FROM (SELECT m, count(*) AS member_count, sum(count)::BIGINT AS total_count FROM held GROUP BY 1) JOIN cand ON rank = m", *_CANDIDATES, recursive=True))
def fsbc_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the last round around the strings found: seeds with their members and reads."""
    return _clusters(spark, d)[1]


@query(X.twin("SELECT sequence, (dense_rank() OVER (ORDER BY m) - 1)::INT AS cluster_id FROM held", *_CANDIDATES, recursive=True))
def fsbc_assignments(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d)[0]


# --- hashing ----------------------------------------------------------------------------------------------------------


@query("SELECT m::INT AS size, a::INT AS step FROM range(5, 61) x(m), range(2, 60) y(a) WHERE a < m - 1 AND gcd(a, m) = 1 UNION ALL SELECT 1, 1")
def coprime_steps(spark: SparkSession, d: str) -> DataFrame:
    """The steps of hashes by the size of regions; sizes without any are missing."""
    return spark.createDataFrame([(m, a) for m in range(1, 61) for a in lsh.steps(m)], "size int, step int")


_LSH = lsh.Config(region_size=X.SIZE, dimension=7, cutoff_parents=2000)


def _mutants_sql(config: lsh.Config) -> list[str]:
    number = "('0x' || substr({}, {}, {}))::UBIGINT"
    out = [
        f"pool AS (SELECT sequence, row_number() OVER (ORDER BY sequence) AS n FROM (SELECT DISTINCT sequence FROM counts WHERE length(region) = {config.region_size}))",
        f"drawn AS (SELECT x, {number.format(f"md5('{config.seed}:' || x)", 1, 8)} % (SELECT count(*) FROM pool) + 1 AS n FROM range(0, {config.cutoff_parents}) r(x))",
        f"mutant_0 AS (SELECT x, y, sequence AS parent, sequence AS s FROM drawn JOIN pool USING (n), range(0, {config.cutoff_mutants}) r(y))",
    ]
    for z in range(config.edit_distance):
        h = f"md5('{config.seed}:' || x || ':' || y || ':{z}')"
        at = f"({number.format(h, 1, 8)} % length(parent))::INT"
        out.append(f"mutant_{z + 1} AS (SELECT x, y, parent, left(s, {at}) || substr('ACGT', ({number.format(h, 9, 1)} % 4 + 1)::INT, 1) || substr(s, {at} + 2) AS s FROM mutant_{z})")
    n, k = X.SIZE + 20, config.kmer
    out += [
        f"mutated AS (SELECT parent, s, count(*) AS times FROM mutant_{config.edit_distance} GROUP BY ALL)",
        f"mgrams AS (SELECT parent, s, times, substr(parent, i::INT, {k}) AS g, 1 AS v FROM mutated, range(1, {n - k + 1}) r(i) UNION ALL SELECT parent, s, times, substr(s, i::INT, {k}), -1 FROM mutated, range(1, {n - k + 1}) r(i))",
        f"apart AS (SELECT parent, s, times, CASE WHEN count(*) <= 1 THEN 2.0 ELSE sum(v * v) / {(n - k + 1) ** 2}.0 END AS d FROM (SELECT parent, s, times, g, sum(v) AS v FROM mgrams GROUP BY ALL) GROUP BY ALL)",
        "cutoff AS (SELECT sum(d * times) / sum(times) AS c FROM apart)",
    ]
    return out


@query(X.twin("SELECT round(c, 9) AS cutoff FROM cutoff", *_mutants_sql(_LSH)))
def lsh_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """The mean distance of mutants from their parents."""
    return spark.createDataFrame([(round(lsh.cutoff(X.counts(spark, d), _LSH), 9),)], "cutoff double")


def _cluster_sql() -> list[str]:
    key = lambda at: " || ".join(f"substr(region, {p + 1}, 1)" for p in at)
    grams = lambda name, rows, a, b: (
        f"{name} AS MATERIALIZED (SELECT id, CASE WHEN count(*) <= 1 THEN 2.0 ELSE sum(v * v) / 1444.0 END AS d FROM (SELECT id, g, sum(v) AS v FROM (SELECT id, substr({a}, i::INT, 3) AS g, 1 AS v FROM {rows}, range(1, 38) r(i) UNION ALL SELECT id, substr({b}, i::INT, 3), -1 FROM {rows}, range(1, 38) r(i)) GROUP BY ALL) GROUP BY 1)"
    )
    first, *later = lsh.places(_LSH)
    out = [
        f"ranked AS MATERIALIZED (SELECT sequence, any_value(region) AS region, row_number() OVER (ORDER BY sum(count) DESC, sequence) AS rank FROM counts GROUP BY sequence)",
        f"dealt AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY rank) AS pos FROM (SELECT *, {key(first)} AS bucket FROM ranked))",
        "twos AS MATERIALIZED (SELECT row_number() OVER () AS id, a.sequence AS sa, b.sequence AS sb, a.rank AS ra, b.rank AS rb FROM dealt a JOIN dealt b ON a.bucket = b.bucket AND a.rank < b.rank)",
        grams("two_d", "twos", "sa", "sb"),
        "close AS MATERIALIZED (SELECT rb AS rank, list(ra ORDER BY ra) AS before FROM twos JOIN two_d USING (id), cutoff WHERE d <= c GROUP BY 1)",
        "queue AS MATERIALIZED (SELECT dealt.*, coalesce(before, []) AS before FROM dealt LEFT JOIN close USING (rank))",
        """walk AS (
          SELECT bucket, 1::BIGINT AS pos, [rank] AS founders, rank, rank AS cid FROM queue WHERE pos = 1
          UNION ALL
          SELECT q.bucket, q.pos, CASE WHEN list_has_any(w.founders, q.before) THEN w.founders ELSE list_append(w.founders, q.rank) END, q.rank,
            CASE WHEN list_has_any(w.founders, q.before) THEN list_min(list_intersect(w.founders, q.before)) ELSE q.rank END
          FROM walk w JOIN queue q ON q.bucket = w.bucket AND q.pos = w.pos + 1)""",
        "round_0 AS MATERIALIZED (SELECT r.sequence, r.region, r.rank, w.cid FROM walk w JOIN ranked r USING (rank))",
    ]
    for i, at in enumerate(later, 1):
        out += [
            f"heads_{i} AS MATERIALIZED (SELECT *, rank AS id, first_value(sequence) OVER w AS hs, first_value(cid) OVER w AS hc FROM round_{i - 1} WINDOW w AS (PARTITION BY {key(at)} ORDER BY rank))",
            grams(f"near_{i}", f"heads_{i}", "hs", "sequence"),
            f"round_{i} AS MATERIALIZED (SELECT sequence, region, rank, CASE WHEN cid <> hc AND d <= c THEN hc ELSE cid END AS cid FROM heads_{i} JOIN near_{i} USING (id), cutoff)",
        ]
    return out


@query(X.twin(f"SELECT sequence, (dense_rank() OVER (ORDER BY cid) - 1)::INT AS cluster_id FROM round_{_LSH.iterations - 1}", *_mutants_sql(_LSH), *_cluster_sql(), recursive=True))
def lsh_cluster_full(spark: SparkSession, d: str) -> DataFrame:
    """Clustering with the estimated cutoff, five rounds."""
    return lsh.cluster(X.counts(spark, d), _LSH).select("sequence", F.col("cluster_id").cast("int").alias("cluster_id"))


@query(X.twin("SELECT count(DISTINCT cid) AS n_clusters, max(n) AS largest FROM (SELECT cid, count(*) OVER (PARTITION BY cid) AS n FROM start)", Q._START))
def cluster_count(spark: SparkSession, d: str) -> DataFrame:
    """The number of clusters to begin with and the size of the largest."""
    return lsh.sizes(Q._start(spark, d)).agg(F.count("*").alias("n_clusters"), F.max("n_sequences").alias("largest"))


# --- motifs -----------------------------------------------------------------------------------------------------------

_SHARES = "shares AS (SELECT kmer, kl, kls, total / (SELECT sum(count) FROM counts WHERE round = 6) AS proportion, total >= 0.01 * (SELECT sum(count) FROM counts WHERE round = 6) AS strong FROM kl JOIN totals USING (kmer) WHERE round = 6)"
_BACKGROUND = """
nulls AS (SELECT ln(kl) AS lkl, ln(kls) AS lks, proportion, row_number() OVER (ORDER BY kl) AS a, row_number() OVER (ORDER BY proportion) AS b, count(*) OVER () AS n FROM shares WHERE kl >= 1e-6 AND kls >= 1e-6),
ground AS (SELECT avg(lks) AS mean, coalesce(stddev_samp(lks), 0) AS sd, count(*) AS n, max(lkl) FILTER (WHERE a = least(floor(0.9 * n), n - 1) + 1) AS top_score, max(proportion) FILTER (WHERE b = least(floor(0.9 * n), n - 1) + 1) AS top_proportion FROM nulls)"""


@query(X.twin("SELECT round(mean, 6) AS mean, round(sd, 6) AS sd, n, round(top_score, 6) AS top_score, round(top_proportion, 6) AS top_proportion FROM ground", Q._PROFILE, Q._WINDOWS, Q._SUMS, Q._KL, _SHARES, _BACKGROUND))
def kl_background(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of the log scores of rare aptamers, and the cuts."""
    return motif.background(Q._traced(spark, d)[0]).select(r6("mean", "mean"), r6("sd", "sd"), "n", r6("top_score", "top_score"), r6("top_proportion", "top_proportion"))


_P = """
tested AS (SELECT s.*, CASE WHEN kl > 0 THEN ln(kl) ELSE '-inf'::DOUBLE END AS lg, g.* FROM shares s, ground g),
valued AS (SELECT *, CASE WHEN z > 38 THEN 0.0 WHEN z > 0 THEN 1 / (z * sqrt(2 * pi()) * exp(z * z / 2)) ELSE 1.0 END AS p FROM (SELECT *, (lg - mean) / sd AS z FROM tested)),
level AS (SELECT CASE WHEN bool_or(p <= 0.01 AND lg >= top_score) THEN 0.01 ELSE 0.05 END AS l FROM valued),
kept AS (SELECT * FROM valued, level WHERE p <= l AND (lg >= top_score OR (proportion >= top_proportion AND lg >= -3 AND strong))),
contexts AS (SELECT kmer, (arg_max(c, v) - 1)::INT AS selection_context FROM (SELECT kmer, instr('hbimd', c)::INT AS c, round(sum((2 * round - 6) * p), 9) AS v FROM means GROUP BY ALL UNION ALL SELECT kmer, 6, round(sum((2 * round - 6) * p), 9) FROM rests GROUP BY ALL) GROUP BY 1)"""


@query(X.twin("SELECT (row_number() OVER (ORDER BY round(proportion, 9), kmer))::INT AS place, kmer, round(proportion, 6) AS proportion, round(p, 6) AS p_value, selection_context FROM kept JOIN contexts USING (kmer)", Q._PROFILE, Q._WINDOWS, Q._SUMS, Q._KL, _SHARES, _BACKGROUND, _P))
def significant_kmers(spark: SparkSession, d: str) -> DataFrame:
    """The significant k-mers by rising proportion."""
    rows = motif.significant(Q._traced(spark, d)[0])
    return spark.createDataFrame([(i, r["kmer"], round(r["proportion"], 6), round(r["p_value"], 6), r["selection_context"]) for i, r in enumerate(rows, 1)], "place int, kmer string, proportion double, p_value double, selection_context int")


@query("SELECT p_partkey, round(CASE WHEN z > 0 THEN 1 / (z * sqrt(2 * pi()) * exp(z * z / 2)) ELSE 1.0 END, 6) AS p_value FROM (SELECT p_partkey, (p_retailprice - 1300) / 300 AS z FROM part)")
def tail_p_values(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", r6(seq.tail_p_value((F.col("p_retailprice") - 1300) / 300), "p_value"))


_OVERLAP = """
WITH l(c) AS (VALUES ('A'), ('T'), ('C'), ('G')),
pairs AS (SELECT 'TTGGAA' AS a, p.c || q.c || r.c || s.c || t.c || u.c AS b FROM l p, l q, l r, l s, l t, l u),
laid AS (SELECT a, b, shift, 2 * abs(shift) AS gaps, CASE WHEN shift < 0 THEN repeat('-', -shift::INT) || a ELSE a || repeat('-', shift::INT) END AS x, CASE WHEN shift < 0 THEN b || repeat('-', -shift::INT) ELSE repeat('-', shift::INT) || b END AS y FROM pairs, range(-2, 3) r(shift)),
signs AS (SELECT *, array_to_string([CASE WHEN substr(x, i::INT, 1) = '-' OR substr(y, i::INT, 1) = '-' THEN '-' WHEN substr(x, i::INT, 1) = substr(y, i::INT, 1) THEN '=' ELSE 'x' END FOR i IN range(1, length(x) + 1)], '') AS m FROM laid),
figures AS (SELECT a, b, shift, gaps, length(m) - length(replace(m, 'x', '')) AS wrong, list_max([length(z) FOR z IN string_split(replace(m, '-', 'x'), 'x')]) AS run FROM signs),
best AS (SELECT a, b, arg_min(struct_pack(gaps := gaps, wrong := wrong, run := run), (gaps + wrong) * 100 - shift) AS f FROM figures GROUP BY ALL)
SELECT a, b, CASE WHEN f.gaps = 0 THEN f.wrong = 1 ELSE f.run >= 4 END AS together FROM best"""


@query(_OVERLAP)
def good_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Which 6-mers belong together with TTGGAA."""
    rows = fsbc.every_string(spark, fsbc.DNA, 6).select(F.lit("TTGGAA").alias("a"), F.col("subsequence").alias("b"))
    return _mapped(rows, lambda a, b: (a, b, motif.good_overlap(a, b)), "a string, b string, together boolean")


_TRIM = """
weights AS (SELECT i, b, coalesce(sum(count) FILTER (WHERE substr(filled, i::INT, 1) = b), 0) AS w FROM hits, range(1, 9) r(i), (VALUES ('A'), ('C'), ('G'), ('T')) x(b) GROUP BY ALL),
rates AS (SELECT i, b, w / sum(w) OVER (PARTITION BY i) AS p FROM weights),
bits AS (SELECT i, -sum(CASE WHEN p > 1e-6 THEN p * log2(p) ELSE 0 END) AS h FROM rates GROUP BY 1),
ends AS (SELECT coalesce(min(i) FILTER (WHERE h < 1.70), max(i)) AS lo, coalesce(max(i) FILTER (WHERE h < 1.70), max(i)) AS hi FROM bits)"""


def _matrix(spark: SparkSession, d: str):
    import numpy as np

    rows = np.zeros((8, 4))
    for r in motif.pwm(Q._hits(spark, d)).collect():  # eight places of four bases
        rows[r["position"], "ACGT".index(r["base"])] += r["weight"]
    return rows / rows.sum(axis=1, keepdims=True)


@query(X.twin("SELECT (i - lo)::INT AS position, round(max(p) FILTER (WHERE b = 'A'), 6) AS a, round(max(p) FILTER (WHERE b = 'C'), 6) AS c, round(max(p) FILTER (WHERE b = 'G'), 6) AS g, round(max(p) FILTER (WHERE b = 'T'), 6) AS t FROM rates, ends WHERE i BETWEEN lo AND hi GROUP BY ALL", Q._HIT, _TRIM))
def pwm_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """The planted motif's matrix without the ends that say little."""
    rows = motif.trimmed(_matrix(spark, d)).round(6).tolist()
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position int, a double, c double, g double, t double")


@query(X.twin("SELECT string_agg(base, '' ORDER BY i) AS consensus FROM (SELECT i, arg_max(b, w * 10 - instr('ACGT', b)) AS base FROM weights GROUP BY 1)", Q._HIT, _TRIM))
def consensus(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent bases around the planted motif."""
    return spark.createDataFrame([(motif.consensus(_matrix(spark, d)),)], "consensus string")


_TWO = "own AS (SELECT DISTINCT CASE WHEN instr(region, 'TTGGAA') > 0 AND k = 0 THEN 0 WHEN instr(region, 'GGAACC') > 0 AND k = 1 THEN 1 WHEN instr(region, 'ACG') > 0 AND k = 2 THEN 2 END AS motif, sequence, count FROM counts, range(0, 3) r(k) WHERE round = 6)"


def _own(spark: SparkSession, d: str) -> DataFrame:
    """Aptamers of the last round that hold one of three strings, by windows joined with the strings."""
    c = Q._last_round(spark, d)
    out = None
    for k, text in enumerate(("TTGGAA", "GGAACC", "ACG")):
        table = F.broadcast(spark.createDataFrame([(k, text)], "motif int, kmer string"))
        rows = motif.windows(X.regions(spark, d), len(text)).join(table, "kmer").join(c.select("region", "sequence", "count"), "region").select("motif", "sequence", "count").distinct()
        out = rows if out is None else out.unionByName(rows)
    return cut(out)


@query(X.twin("SELECT motif, count(*) AS n, sum(count)::BIGINT AS reads FROM own WHERE motif IS NOT NULL GROUP BY 1", _TWO))
def kmer_motif_join(spark: SparkSession, d: str) -> DataFrame:
    """K-mer places joined with the k-mers of motifs."""
    return _own(spark, d).groupBy("motif").agg(F.count("*").alias("n"), F.sum("count").alias("reads"))


@query(X.twin("SELECT a.motif, b.motif AS earlier, round(sum(a.count) / (SELECT sum(count) FROM own c WHERE c.motif = a.motif), 6) AS share FROM own a JOIN own b ON a.sequence = b.sequence AND b.motif < a.motif GROUP BY a.motif, b.motif", _TWO))
def motif_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The share of a motif's reads that an earlier motif holds."""
    return motif.overlaps(_own(spark, d)).select("motif", "earlier", r6("share", "share"))


@query(X.twin("SELECT region, count(*) AS n_values, round(sum(v), 6) AS total FROM profiles GROUP BY 1", Q._PROFILE))
def structure_join(spark: SparkSession, d: str) -> DataFrame:
    """Regions with their profiles."""
    rows = motif.with_profiles(X.counts(spark, d).select("region").distinct(), X.regions(spark, d))
    return rows.select("region", F.size("profile").cast("long").alias("n_values"), r6(F.aggregate("profile", F.lit(0.0), lambda a, x: a + x), "total"))


@query(X.twin("SELECT 'both' AS part, count(*) AS n FROM (SELECT sequence FROM counts WHERE round = 0 INTERSECT SELECT sequence FROM counts WHERE round = 6) UNION ALL SELECT 'lost', count(*) FROM (SELECT sequence FROM counts WHERE round = 0 EXCEPT SELECT sequence FROM counts WHERE round = 6)"))
def round_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of the first round that the last one holds, and those that it has lost."""
    c = X.counts(spark, d)
    first, last = (c.filter(F.col("round") == r).select("sequence") for r in (0, 6))
    return first.intersect(last).agg(F.lit("both").alias("part"), F.count("*").alias("n")).unionByName(first.subtract(last).agg(F.lit("lost").alias("part"), F.count("*").alias("n")))


@query("SELECT i::INT AS i, j::INT AS j, (row_number() OVER (ORDER BY i, j) - 1)::BIGINT AS index FROM range(0, 30) a(i), range(0, 30) b(j) WHERE i < j")
def triangle_inverse(spark: SparkSession, d: str) -> DataFrame:
    """Row and column of each place of the upper triangle of 30 by 30."""
    rows = spark.range(30 * 29 // 2).withColumnRenamed("id", "index")
    i = seq.triangle_row(F.col("index"), F.lit(30))
    return rows.select(i.alias("i"), seq.triangle_column(F.col("index"), F.lit(30)).alias("j"), "index")


@query(
    X.twin(
        """SELECT fwd, translate(reverse(fwd), 'ACGT', 'TGCA') AS rc, NOT contains(fwd, 'N') AS plain, instr(fwd, 'GATACGCATT') - 1 AS five, CASE WHEN instr(fwd, 'CTTGACCAGT') > 0 THEN length(fwd) - instr(reverse(fwd), reverse('CTTGACCAGT')) + 1 - 10 ELSE -1 END AS three,
           ascii(min(fwd_qual)) - 33 AS q, list_sum([(instr('AGTC', substr(region, i::INT, 1)) - 1) * 4 ** (5 - i) FOR i IN range(1, 6)])::BIGINT AS id FROM reads GROUP BY fwd, region"""
    )
)
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The functions by name in SQL."""
    register_functions(spark)
    X.reads(spark, d).createOrReplaceTempView("aptaflow_reads")
    return spark.sql(
        f"""SELECT fwd, reverse_complement(fwd) AS rc, is_acgt(fwd) AS plain, find_left(fwd, '{X.P5}') AS five, find_right(fwd, '{X.P3}') AS three, phred(min(fwd_qual)) AS q, kmer_id(left(region, 5)) AS id
            FROM aptaflow_reads GROUP BY fwd, region"""
    )


@query(
    X.twin(
        "SELECT outcome, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN NOT fwd SIMILAR TO '[ACGT]*' THEN 'INVALID_ALPHABET' WHEN five IS NULL THEN 'FIVE_PRIME_ERROR' WHEN three IS NULL THEN 'THREE_PRIME_ERROR' WHEN (five + 9 >= three AND five + 9 >= three + 9) OR (five <= three + 9 AND five >= three) THEN 'TOTAL_PRIMER_OVERLAPS' WHEN five + 10 < three AND three - five - 10 = 20 THEN 'ACCEPTED_READS' ELSE 'SIZE_MISMATCH' END AS outcome FROM ends) GROUP BY 1",
        "whole AS (SELECT fwd, length(fwd) AS m, count(*) AS n FROM reads GROUP BY 1)",
        "places AS (SELECT fwd, i::INT AS i, hamming(substr(fwd, i::INT + 1, 10), 'GATACGCATT') AS a, hamming(substr(fwd, i::INT + 1, 10), 'CTTGACCAGT') AS b FROM whole, range(0, 31) r(i) WHERE i + 10 <= m)",
        # the 5' primer is searched from the right end of the reversed read, so of equal places the last one in the read
        "best AS (SELECT fwd, min(a * 1000 - i) AS a, min(b * 1000 + i) AS b FROM places GROUP BY 1)",
        "ends AS (SELECT whole.fwd, n, CASE WHEN a <= 2000 THEN ((a + 999) // 1000) * 1000 - a END AS five, CASE WHEN b < 3000 THEN b % 1000 END AS three FROM whole LEFT JOIN best USING (fwd))",
    )
)
def hamming_import(spark: SparkSession, d: str) -> DataFrame:
    """Reads by outcome with two mismatches, no insertions or deletions, allowed in each primer."""
    config = importer.Config(X.P5, X.P3, X.SIZE, primer_tolerance=2, distance="hamming")
    return importer.parse_fuzzy(X.reads(spark, d), config).groupBy("outcome").agg(F.count("*").alias("n"))
