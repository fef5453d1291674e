"""From reads to regions: primers, barcodes, extraction, and the outcome of each read.

Reads are rows (fwd, and what the caller keeps beside it). parse_exact() uses Column expressions only; parse_fuzzy() matches
with tolerance in an Arrow function. Either adds outcome, sequence (stored contig), start_index and end_index of the region.
Outcomes beyond the reference's counters: SIZE_MISMATCH, which is not counted there (see counters()).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import matching, seq
from ..ship import ship

ACCEPTED, ALPHABET, FIVE, THREE, CYCLE, OVERLAP, SIZE, CONTIG = "ACCEPTED_READS", "INVALID_ALPHABET", "FIVE_PRIME_ERROR", "THREE_PRIME_ERROR", "INVALID_CYCLE", "TOTAL_PRIMER_OVERLAPS", "SIZE_MISMATCH", "CONTIG_ASSEMBLY_FAILS"
COUNTERS = ["PROCESSED_READS", ACCEPTED, CONTIG, ALPHABET, FIVE, THREE, CYCLE, OVERLAP]


@dataclass(frozen=True)
class Config:
    """How reads are parsed. mode: full, batch (the contig is the region) or region_only (primers are put around it); distance:
    edit or hamming, how parse_fuzzy() looks for primers."""

    five_prime: str = ""
    three_prime: str = ""
    exact_size: int | None = None
    lower: int | None = None
    upper: int | None = None
    primer_tolerance: int = 3
    barcode_tolerance: int = 1
    retry_reverse_complement: bool = False
    store_reverse_complement: bool = False
    mode: str = "full"
    distance: str = "edit"
    barcodes5: tuple[str, ...] = ()
    barcodes3: tuple[str, ...] = ()
    cycles: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.mode not in ("full", "batch", "region_only"):
            raise ValueError(f"unknown mode {self.mode}")
        if self.distance not in ("edit", "hamming"):
            raise ValueError(f"unknown distance {self.distance}")
        if self.mode == "full" and not self.three_prime and self.exact_size is None:
            raise ValueError("a 3' primer or an exact region size is needed")
        if (self.lower is None) != (self.upper is None) or (self.lower is not None and self.lower >= self.upper):
            raise ValueError("bounds need both ends, the lower below the upper")
        if self.barcodes5 and self.barcodes3 and len(self.barcodes5) != len(self.barcodes3):
            raise ValueError("barcodes at both ends must be as many")


def _sized(config: Config, n: Column) -> Column:
    ok = F.lit(True)
    if config.exact_size is not None:
        ok = ok & (n == config.exact_size)
    if config.lower is not None:
        ok = ok & (n >= config.lower) & (n <= config.upper)
    return ok


def _barcode(part: Column, barcodes: tuple[str, ...]) -> Column:
    """Index of the first barcode that part holds."""
    out = F.lit(None).cast("int")
    for k in range(len(barcodes) - 1, -1, -1):
        out = F.when(F.instr(part, barcodes[k]) > 0, F.lit(k)).otherwise(out)
    return out


def _attempt(reads: DataFrame, contig: Column, config: Config, into: str) -> DataFrame:
    """reads with (outcome, sequence, start_index, end_index, barcode) of one contig with exact primers.

    The places of the primers become columns first, so that they are computed once.
    """
    n5, n3 = len(config.five_prime), len(config.three_prime)
    reads = reads.withColumns({"_contig": contig, "_five": seq.find_left(contig, config.five_prime), "_three": seq.find_right(contig, config.three_prime) if n3 else F.lit(-1)})
    contig, five, three = F.col("_contig"), F.col("_five"), F.col("_three")
    size = F.length(contig)
    start = five + n5
    end = three if n3 else start + config.exact_size
    code = F.lit(None).cast("int")
    bad_cycle = F.lit(False)
    if config.barcodes5 or config.barcodes3:
        left = _barcode(F.substring(contig, F.lit(1), five), config.barcodes5) if config.barcodes5 else None
        right = _barcode(F.substring(contig, end + n3 + 1, size), config.barcodes3) if config.barcodes3 and n3 else None
        if left is not None and right is not None:
            code = F.when(left == right, left)
        else:
            code = left if left is not None else right if right is not None else code
        bad_cycle = code.isNull()
    clash = seq.overlapped(five, F.lit(n5), three, F.lit(n3)) if n3 else F.lit(False)
    good = (start < end) & (end <= size) & _sized(config, end - start)
    outcome = (
        F.when(~seq.is_acgt(contig), F.lit(ALPHABET))
        .when(five < 0, F.lit(FIVE))
        .when(F.lit(bool(n3)) & (three < 0), F.lit(THREE))
        .when(bad_cycle, F.lit(CYCLE))
        .when(clash, F.lit(OVERLAP))
        .when(~good & (end + n3 > size), F.lit(THREE))
        .when(~good, F.lit(SIZE))
        .otherwise(F.lit(ACCEPTED))
    )
    kept = F.substring(contig, five + 1, end + n3 - five)
    found = F.struct(outcome.alias("outcome"), kept.alias("sequence"), F.lit(n5).alias("start_index"), (end - start + n5).alias("end_index"), code.alias("barcode"))
    return reads.withColumn(into, found).drop("_contig", "_five", "_three")


def _stored(config: Config, found: Column) -> dict[str, Column]:
    """The columns of an attempt, reverse-complemented if the config says so; null unless the read is accepted."""
    ok = found["outcome"] == ACCEPTED
    sequence, start, end = found["sequence"], found["start_index"], found["end_index"]
    if config.store_reverse_complement:
        n = F.length(sequence)
        sequence, start, end = seq.reverse_complement(sequence), n - end, n - start
    return {"outcome": found["outcome"], "sequence": F.when(ok, sequence), "start_index": F.when(ok, start).cast("int"), "end_index": F.when(ok, end).cast("int")}


def parse_exact(reads: DataFrame, config: Config, contig: str = "fwd") -> DataFrame:
    """reads with outcome, sequence, start_index, end_index (and barcode, if barcodes are given)."""
    c = F.col(contig)
    if config.mode == "batch":
        n = F.length(c)
        outcome = F.when(~seq.is_acgt(c), F.lit(ALPHABET)).when(~_sized(config, n), F.lit(CONTIG)).otherwise(F.lit(ACCEPTED))
        found = F.struct(outcome.alias("outcome"), c.alias("sequence"), F.lit(0).alias("start_index"), n.alias("end_index"), F.lit(None).cast("int").alias("barcode"))
    elif config.mode == "region_only":
        outcome = F.when(~seq.is_acgt(c), F.lit(ALPHABET)).otherwise(F.lit(ACCEPTED))
        n5 = len(config.five_prime)
        found = F.struct(outcome.alias("outcome"), F.concat(F.lit(config.five_prime), c, F.lit(config.three_prime)).alias("sequence"), F.lit(n5).alias("start_index"), (F.length(c) + n5).alias("end_index"), F.lit(None).cast("int").alias("barcode"))
    else:
        found = None
    out = _attempt(reads, c, config, "_found") if found is None else reads.withColumn("_found", found)
    if config.retry_reverse_complement and config.mode == "full":
        # a second error replaces the first; a second attempt that is silently dropped does not
        counted = F.col("_found.outcome").isin(FIVE, THREE, CYCLE, OVERLAP)
        out = _attempt(out, F.when(counted, seq.reverse_complement(c)), config, "_again")
        out = out.withColumn("_found", F.when(counted & (F.col("_again.outcome") != SIZE), F.col("_again")).otherwise(F.col("_found"))).drop("_again")
    more = {"barcode": F.col("_found.barcode")} if config.barcodes5 or config.barcodes3 else {}
    return out.withColumns(_stored(config, F.col("_found")) | more).drop("_found")


def parse_fuzzy(reads: DataFrame, config: Config, contig: str = "fwd") -> DataFrame:
    """parse_exact() with the tolerances of the config, in an Arrow function over batches."""
    ship(reads.sparkSession)
    fields = [f for f in reads.schema.fields if f.name not in ("outcome", "sequence", "start_index", "end_index", "barcode")]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[str | None, tuple] = {}
            rows = []
            for c in b.column(contig).to_pylist():
                if c not in known:
                    known[c] = matching.parse(c, config)
                rows.append(known[c])
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            more = [pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *more], names=[*names, "outcome", "sequence", "start_index", "end_index", "barcode"])

    schema = T.StructType([*fields]).add("outcome", "string").add("sequence", "string").add("start_index", "integer").add("end_index", "integer").add("barcode", "integer")
    return reads.select(*names).mapInArrow(run, schema)


def merge_pairs(reads: DataFrame, least: int = 15, identity: float = 1 - 5 / 15) -> DataFrame:
    """reads (fwd, fwd_qual, rev, rev_qual) with contig and contig_qual, null where a pair does not overlap.

    A null contig then counts as an invalid alphabet, as in the reference. Reads without a reverse read keep the forward one.
    """
    ship(reads.sparkSession)
    fields = [f for f in reads.schema.fields if f.name not in ("contig", "contig_qual")]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, p) if r is None else matching.merge_pair(f, p, r, q, least, identity) or (None, None) for f, p, r, q in zip(*[b.column(c).to_pylist() for c in ("fwd", "fwd_qual", "rev", "rev_qual")], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *[pa.array([x[i] for x in rows], pa.string()) for i in (0, 1)]], names=[*names, "contig", "contig_qual"])

    return reads.select(*names).mapInArrow(run, T.StructType([*fields]).add("contig", "string").add("contig_qual", "string"))


def counters(parsed: DataFrame) -> DataFrame:
    """(stat, value): the eight counters, 0 where nothing was counted. Reads of an invalid alphabet are not processed."""
    sums = {x: F.count(F.when(F.col("outcome") == x, 1)) for x in COUNTERS[1:]} | {COUNTERS[0]: F.count(F.when(F.col("outcome") != ALPHABET, 1))}
    wide = parsed.agg(*[sums[x].alias(x) for x in COUNTERS])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(x).alias("stat"), F.col(x).alias("value")) for x in COUNTERS])).alias("s")).select("s.*")


def tag_cycles(reads: DataFrame, cycles: DataFrame) -> DataFrame:
    """reads (file_index) with the cycle_name and round of cycles (file_index): one row for each input file."""
    return reads.join(F.broadcast(cycles.select("file_index", "cycle_name", "round")), "file_index", "left")
