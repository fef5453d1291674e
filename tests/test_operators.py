"""Operators on small tables, and the queries against their SQL."""

import gzip

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from aptaflow.operators import catalog, fsbc, importer, lsh
from aptaflow.plans import queries
from aptaflow.sources import experiments, fastq

DATA = "/root/testdata/sf0.001"
CONFIG = importer.Config("AAC", "GGT", 4, primer_tolerance=0)


def _plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", ["parse_outcome", "parse_outcome_rc", "cycle_counts", "round_enrichment", "kmer_support", "abundance_rank", "lsh_buckets", "visible_experiments", "quality_by_position", "fuzzy_import", "barcode_cycle_fuzzy", "paired_merge", "primer_matches", "fastq_scan", "paired_scan", "fsbc_ranked", "lsh_cluster_full", "kl_background", "significant_kmers", "good_overlaps", "motif_overlap", "sql_functions"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "customer", "supplier", "orders", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(_plain(x) for x in r)) for r in df.select(*columns).collect())
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert got == sorted(repr(tuple(_plain(x) for x in r)) for r in want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


READS = [("AACACGTGGT", "ACCEPTED_READS"), ("AACACGGGT", "SIZE_MISMATCH"), ("ACACGTGGT", "FIVE_PRIME_ERROR"), ("AACACGT", "THREE_PRIME_ERROR"), ("AACNCGTGGT", "INVALID_ALPHABET"), (None, "INVALID_ALPHABET")]


def test_exact_and_fuzzy_agree(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(READS)], "i int, fwd string")
    for parse in (importer.parse_exact, importer.parse_fuzzy):
        rows = parse(df, CONFIG).orderBy("i").collect()
        assert [r.outcome for r in rows] == [o for _, o in READS]
        assert (rows[0].sequence, rows[0].start_index, rows[0].end_index) == ("AACACGTGGT", 3, 7)
    stats = {r.stat: r.value for r in importer.counters(importer.parse_exact(df, CONFIG)).collect()}
    assert stats["PROCESSED_READS"] == 4 and stats["ACCEPTED_READS"] == 1 and len(stats) == 8


def test_retry_and_storage(spark):
    df = spark.createDataFrame([("ACCACGTGTT",)], "fwd string")
    config = importer.Config("AAC", "GGT", 4, primer_tolerance=0, retry_reverse_complement=True, store_reverse_complement=True)
    for parse in (importer.parse_exact, importer.parse_fuzzy):
        r = parse(df, config).first()
        assert (r.outcome, r.sequence, r.start_index, r.end_index) == ("ACCEPTED_READS", "ACCACGTGTT", 3, 7)


def test_fuzzy_primer(spark):
    df = spark.createDataFrame([("GATACGCTTTACGTACGTCTTGACCAGT",)], "fwd string")
    config = importer.Config("GATACGCATT", "CTTGACCAGT", 8, primer_tolerance=2)
    assert importer.parse_fuzzy(df, config).first().outcome == "ACCEPTED_READS"
    assert importer.parse_exact(df, config).first().outcome == "FIVE_PRIME_ERROR"


@pytest.mark.parametrize("bad", [{"mode": "x"}, {"five_prime": "A"}, {"exact_size": 3, "lower": 1}, {"exact_size": 3, "lower": 4, "upper": 4}])
def test_bad_configs(bad):
    with pytest.raises(ValueError):
        importer.Config(**bad)


def test_greedy_clustering_equals_the_joins(spark):
    import random

    rng = random.Random(5)
    regions = sorted({"".join(rng.choice("ACGT") for _ in range(8)) for _ in range(60)})
    ranked = [(i + 1, x) for i, x in enumerate(sorted({"".join(rng.choice("ACGT") for _ in range(rng.randint(2, 4))) for _ in range(25)}, key=lambda x: rng.random()))]
    want, left, kept = {}, set(regions), []
    for _, s in ranked:
        if any(k in s for k in kept):
            continue
        kept.append(s)
        mine = {r for r in left if s in r}
        if mine:
            want |= {r: len(set(want.values())) for r in mine}
        left -= mine
    counts = spark.createDataFrame([(r, r, 1) for r in regions], "sequence string, region string, count long")
    given, _ = fsbc.clusters(counts, spark.createDataFrame(ranked, "rank int, subsequence string"))
    assert {r.sequence: r.cluster_id for r in given.collect()} == want


def test_search_finds_a_planted_string(spark):
    import random

    rng = random.Random(1)
    rows = [("".join(rng.choice("ACGT") for _ in range(7)) + ("GATTC" if i % 3 == 0 else "".join(rng.choice("ACGT") for _ in range(5))) + "".join(rng.choice("ACGT") for _ in range(rng.randint(3, 7))), 1) for i in range(200)]
    counts = spark.createDataFrame(rows, "region string, count long")
    assert "GATTC" in fsbc.search(counts, 5, 6).orderBy("rank").first().subsequence
    assert fsbc.search(counts.limit(0), 5, 6).count() == 0


def test_hash_clustering_is_total(spark):
    rows = [("AACC" + r + "GG", r, 1 + i % 4, "c", 0) for i, r in enumerate(["ACGTACGTAC", "ACGTACGTAG", "TTTTGGGGCC", "TTTTGGGGCA", "CACACACACA"])]
    counts = spark.createDataFrame(rows, "sequence string, region string, count long, cycle_name string, round int")
    out = {r.sequence: r.cluster_id for r in lsh.cluster(counts, lsh.Config(10, 4, iterations=3, cutoff=0.3)).collect()}
    assert len(out) == 5 and set(out.values()) == set(range(len(set(out.values()))))


def test_fastq_source(spark, tmp_path):
    one, two = tmp_path / "a.fq", tmp_path / "b.fq.gz"
    one.write_text("@r1\nACGT\n+\nIIII\n@r2\nGGGG\n+\n@III\n@r3\nCC\n+\nII\n")
    with gzip.open(two, "wt") as f:
        f.write("@r1\nTTTT\n+\nIIII\n@r2\nAAAA\n+\nIIII\n")
    fastq.register(spark)
    rows = spark.read.format("fastq").option("reverse", str(two)).load(str(one)).orderBy("read_id").collect()
    assert [(r.header, r.fwd, r.rev) for r in rows] == [("r1", "ACGT", "TTTT"), ("r2", "GGGG", "AAAA")]
    alone = spark.read.format("fastq").load(str(one))
    assert alone.count() == 3
    fastq.export(alone, str(tmp_path / "out"), "header", "fwd", "fwd_qual")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == one.read_text()


def test_experiment_store(spark, tmp_path):
    base = str(tmp_path / "store")
    for i in (1, 2):
        experiments.write(spark.createDataFrame([(i, "A")], "aptamer_id int, sequence string"), base, "aptamers", i)
    assert experiments.read(spark, base, "aptamers").count() == 2
    assert experiments.read(spark, base, "aptamers", 2).first().aptamer_id == 2


def test_running_counts(spark, tmp_path):
    from aptaflow.streaming.counts import running_counts

    spark.createDataFrame([("c", "AACACGTGGT"), ("c", "AACACGTGGT"), ("c", "AAC")], "cycle_name string, fwd string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cycle_name string, fwd string").parquet(str(tmp_path / "in"))
    q = running_counts(stream, CONFIG).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("running").first()["count"] == 2


def test_numbered(spark):
    from aptaflow.store import numbered

    df = spark.range(1000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("k"))
    rows = numbered(df, "k", "n").orderBy("k").collect()
    assert [r.n for r in rows] == list(range(1, 1001))


def test_plain_fastq_files_are_split(tmp_path):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(300):
        n = rng.randint(1, 60)
        rows.append((f"r{i} @x", "".join(rng.choice("ACGT") for _ in range(n)), "".join(rng.choice("@+ABC!I") for _ in range(n))))
    path = tmp_path / "r.fq"
    path.write_text("".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in rows))
    assert list(fastq.records(str(path))) == rows
    for split in (7, 50, 333, 10**6):
        reader = fastq.FastqReader({"path": f"file://{path}", "split_bytes": str(split)}, False)
        got = [r for p in reader.partitions() for b in reader.read(p) for r in zip(*[b.column(c).to_pylist() for c in ("header", "fwd", "fwd_qual", "read_id")], strict=True)]
        assert [r[:3] for r in got] == rows and [r[3] for r in got] == sorted({r[3] for r in got})
    path.write_text("@a\nACGT\n+\nIIII\n@b\nAC\n")
    with pytest.raises(ValueError, match="breaks off"):
        list(fastq.records(str(path)))
    with pytest.raises(FileNotFoundError):
        fastq.FastqReader({"path": str(tmp_path / "none")}, False)


def test_cutoff_draws_of_one_size(spark):
    counts = spark.createDataFrame([("AAACGTACGTACGT", "ACGTACGTAC"), ("AAACGTTTGTACGG", "ACGTTTGTAC"), ("CC", "CC")], "sequence string, region string")
    config = lsh.Config(10, 4, cutoff_parents=50, cutoff_mutants=7, edit_distance=2)
    rows = lsh.mutants(counts.filter(F.length("region") == 10), config).collect()
    assert len(rows) == 350 and {r.parent for r in rows} == {"AAACGTACGTACGT", "AAACGTTTGTACGG"}
    assert all(sum(a != b for a, b in zip(*r, strict=True)) <= 2 for r in rows) and 0 < lsh.cutoff(counts, config) < 0.2
    assert lsh.cutoff(counts.limit(0), config) == 0.0 and lsh.cutoff(counts, lsh.Config(10, 4, cutoff=0.5)) == 0.5


def test_regions_need_profiles(spark):
    from aptaflow.operators import motif

    regions = spark.createDataFrame([("ACG",), ("TTT",)], "region string")
    good = spark.createDataFrame([("ACG", [0.0] * 15), ("TTT", [0.0] * 15)], "region string, profile array<double>")
    assert motif.with_profiles(regions, good).count() == 2
    for bad in (good.limit(1), good.withColumn("profile", F.slice("profile", 1, 14))):
        with pytest.raises(Exception, match="profile of five values"):
            motif.with_profiles(regions, bad).collect()


def test_tables_are_made_once(spark):
    from aptaflow.store import memo

    calls = []
    for _ in range(2):
        rows = memo(spark, ("test", 1), lambda: calls.append(1) or spark.range(3))
        assert rows.count() == 3
    assert calls == [1]


def test_visible_against_one_by_one(spark):
    users = [(1, False), (2, False), (3, True), (4, False), (5, None), (None, False)]
    exps = [(10, 100), (11, 100), (12, 101), (13, None), (14, 102)]
    projects = [(1, 100, "EDITOR"), (2, 100, None), (2, 101, "VIEWER"), (3, 100, "VIEWER"), (4, None, "VIEWER"), (5, 100, "VIEWER"), (9, 100, "EDITOR"), (1, 103, "EDITOR")]
    grants = [(1, 10, "GRANTED"), (1, 12, "GRANTED"), (2, 11, "OWNER"), (2, 13, None), (3, 12, "GRANTED"), (4, 13, "GRANTED"), (4, 99, "GRANTED"), (5, 14, "GRANTED"), (None, 10, "GRANTED"), (1, None, "GRANTED")]
    level = {(u, e): x for u, p, x in projects for e, q in exps if p is not None and p == q}
    held = {(u, e): x for u, e, x in grants}
    want = [(u, e, level.get((u, e)) or held.get((u, e))) for u, e in level.keys() | held.keys() if u in (1, 2, 4)] + [(3, e, "MANAGER") for e, _ in exps]
    frames = [spark.createDataFrame(x, s) for x, s in ((users, "user_id int, is_admin boolean"), (exps, "experiment_id int, project_id int"), (projects, "user_id int, project_id int, access_level string"), (grants, "user_id int, experiment_id int, access_level string"))]
    out = catalog.visible(*frames)
    assert out.columns == ["user_id", "experiment_id", "access_level"]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))
    # the experiments of members, the most rows by far, meet in no full join
    assert "FullOuter" not in out._jdf.queryExecution().executedPlan().toString()
