"""FASTQ and FASTA files as a Spark data source, and their export.

    spark.dataSource.register(FastqDataSource)
    spark.read.format("fastq").option("reverse", "r2.fq.gz").load("r1.fq.gz")

Paths may be lists joined by commas, local or in any store that Arrow reads (s3://, gs://, hdfs://); forward and reverse files
go in pairs, one partition for each pair, read in lock-step up to the end of the shorter one. Files are gzip or plain text, told
apart by their first bytes. A record that breaks off raises. Plain FASTQ files without reverse reads are split into ranges of
``split_bytes``, each read by a task of its own; compressed files and pairs are one stream each.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "read_id long, file_index int, fwd string, fwd_qual string, rev string, rev_qual string, header string, src_fwd string, src_rev string"
BATCH = 8192


#: Bytes of a plain file that one task reads.
SPLIT = 128 << 20


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))


def _opened(path: str) -> tuple[bool, io.IOBase]:
    """(whether the file is compressed, its bytes as stored)."""
    files, name = _place(path)
    raw = files.open_input_file(name)
    packed = raw.read(2) == b"\x1f\x8b"
    raw.seek(0)
    return packed, raw


def records(path: str, fasta: bool = False) -> Iterator[tuple[str, str, str]]:
    """(header, bases, qualities) of a file."""
    packed, raw = _opened(path)
    with raw, io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw), encoding="utf-8") as lines:
        if fasta:
            head, parts = None, []
            for line in lines:
                if line.startswith(">"):
                    if head is not None:
                        yield head, "".join(parts), ""
                    head, parts = line[1:].rstrip("\r\n"), []
                else:
                    parts.append(line.strip())
            if head is not None:
                yield head, "".join(parts), ""
            return
        while head := lines.readline():
            if not head.strip():
                continue
            rest = [line.rstrip("\r\n") for line in islice(lines, 3)]
            if len(rest) < 3:
                raise ValueError(f"{path}: the last record breaks off")
            yield head.rstrip("\r\n").removeprefix("@"), rest[0], rest[2]


def _first_record(lines: io.BufferedReader, at: int) -> int:
    """The place of the first record that begins at or after ``at``, which may lie anywhere in a line.

    A header is a line with @ whose next but one begins with + and whose next has the length of the third after it; quality
    lines may begin with @ too, but what follows them does not look like that.
    """
    if not at:
        return 0
    lines.seek(at - 1)
    lines.readline()
    at, held = lines.tell(), []
    while True:
        while len(held) < 4 and (line := lines.readline()):
            held.append(line)
        if not held:
            return at
        shape = [x.rstrip(b"\r\n") for x in held]
        if len(held) < 4 or (shape[0][:1] == b"@" and shape[2][:1] == b"+" and len(shape[1]) == len(shape[3])):
            return at if len(held) == 4 else at + sum(map(len, held))
        at += len(held.pop(0))


def ranged(path: str, start: int, stop: int) -> Iterator[tuple[int, tuple[str, str, str]]]:
    """(place, (header, bases, qualities)) of the records of a plain FASTQ file that begin in [start, stop)."""
    _, raw = _opened(path)
    with raw, io.BufferedReader(raw, 1 << 20) as lines:
        at = _first_record(lines, start)
        lines.seek(at)
        while at < stop and (head := lines.readline()):
            begin, at = at, at + len(head)
            if not head.strip():
                continue
            rest = [lines.readline() for _ in range(3)]
            if not rest[2]:
                raise ValueError(f"{path}: the last record breaks off")
            at += sum(map(len, rest))
            text = [x.rstrip(b"\r\n").decode() for x in (head, rest[0], rest[2])]
            yield begin, (text[0].removeprefix("@"), text[1], text[2])


class Pair(InputPartition):
    def __init__(self, index: int, forward: str, reverse: str | None, start: int | None = None, stop: int | None = None):
        self.index, self.forward, self.reverse, self.start, self.stop = index, forward, reverse, start, stop


class FastqReader(DataSourceReader):
    def __init__(self, options: dict, fasta: bool):
        forward = [p for p in options.get("path", "").split(",") if p]
        reverse = [p for p in options.get("reverse", "").split(",") if p]
        if not forward:
            raise ValueError("no forward files")
        if reverse and len(reverse) != len(forward):
            raise ValueError("forward and reverse files must be as many")
        split = int(options.get("split_bytes", SPLIT))
        self.fasta, self.pairs = fasta, []
        for i, path in enumerate(forward):
            size = self._size(path)
            if reverse:
                self._size(reverse[i])
            if reverse or fasta or size <= split or self._packed(path):
                self.pairs.append(Pair(i, path, reverse[i] if reverse else None))
            else:
                self.pairs += [Pair(i, path, None, at, min(size, at + split)) for at in range(0, size, split)]

    @staticmethod
    def _size(path: str) -> int:
        files, name = _place(path)
        info = files.get_file_info(name)
        if info.type != pyarrow.fs.FileType.File:
            raise FileNotFoundError(path)
        return info.size

    @staticmethod
    def _packed(path: str) -> bool:
        packed, raw = _opened(path)
        raw.close()
        return packed

    def partitions(self) -> list[Pair]:
        return self.pairs

    def read(self, part: Pair) -> Iterator[pa.RecordBatch]:
        none = (None, None, None)
        if part.start is not None:  # numbered by their place in the file
            both = ((n, f, none) for n, f in ranged(part.forward, part.start, part.stop))
        elif part.reverse:
            both = ((n, f, r) for n, (f, r) in enumerate(zip(records(part.forward, self.fasta), records(part.reverse, self.fasta), strict=False)))
        else:
            both = ((n, f, none) for n, f in enumerate(records(part.forward, self.fasta)))
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int32(), *[pa.string()] * 7]
        while rows := list(islice(both, BATCH)):
            columns = [
                [(part.index << 44) + n for n, _, _ in rows],
                [part.index] * len(rows),
                [f[1] for _, f, _ in rows],
                [f[2] for _, f, _ in rows],
                [r[1] for _, _, r in rows],
                [r[2] for _, _, r in rows],
                [f[0] for _, f, _ in rows],
                [part.forward] * len(rows),
                [part.reverse] * len(rows),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


class FastqDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options, False)


class FastaDataSource(FastqDataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options, True)


def register(spark) -> None:
    """Make the formats fastq and fasta known, with this package on the executors."""
    from ..ship import ship

    ship(spark)
    spark.dataSource.register(FastqDataSource)
    spark.dataSource.register(FastaDataSource)


def as_fastq(header: Column, bases: Column, qualities: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("@"), header), bases, F.lit("+"), qualities)


def as_fasta(header: Column, bases: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit(">"), header), bases)


def export(df: DataFrame, path: str, header: str, bases: str, qualities: str | None = None) -> None:
    """Write rows as FASTQ, or as FASTA if no qualities are given."""
    text = as_fastq(F.col(header), F.col(bases), F.col(qualities)) if qualities else as_fasta(F.col(header), F.col(bases))
    df.select(text.alias("value")).write.text(path)


def files(path: str) -> list[str]:
    """The data files in a folder, in order of their names."""
    store, name = _place(path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    found = store.get_file_info(pyarrow.fs.FileSelector(name))
    return sorted(scheme + x.path for x in found if x.type == pyarrow.fs.FileType.File and not x.base_name.startswith(("_", ".")) and x.size)
