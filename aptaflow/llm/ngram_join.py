"""Word n-gram Jaccard join by signature trees.

1. Each text becomes its set of word n-grams (64-bit hashes). Documents with equal sets form a class; from here on classes
   are joined, a class being held by its smallest document.
2. Keys deal classes into blocks, so that linked classes share a block. For thresholds from EXACT_FROM on the keys lose
   nothing: sets of sizes in one band are cut into parts by hash ranges; two sets that reach the threshold differ in at
   most D tokens, so of D + 1 + E parts E + 1 are equal, and if at most E parts of a set hold fewer than LEAST tokens, one
   of the fuller ones is (a set with more such parts gives keys for all its parts). Below EXACT_FROM parts would hold too
   few tokens; the keys are there bands of minima under hash functions, of which a pair at the threshold shares none with a
   probability of at most MISS. Keys travel packed, combined within each batch of rows: of the classes with one key a batch
   passes on the first, and draws edges from it to the others. Blocks are the connected components over the edges.
3. Large blocks are cut into tiles of bounded size by set size and hash; only pairs of tiles whose sizes can reach the
   threshold are made, each a task of its own. At first each tile is compared with itself and with the first tiles of its and
   the neighbouring sizes. What that connects in a block is mostly one component, within which nothing is left to find; so of
   the other pairs of tiles only the rows outside it, the strays, are compared with all others. A block of a great many copies
   of one text then costs as many tasks as it has tiles, not pairs of tiles.
4. A task builds a signature tree for each tile: nodes hold the OR of their members' token bitmaps, the range of set sizes
   and the least number of set bits. Both trees are walked together; a pair of nodes goes if the largest overlap that
   bitmaps and sizes leave possible is too small. Pairs of sets that remain and are not connected yet are compared exactly.
5. Links that connect classes lead to components, these to documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import components
from ._store import buckets, cut, map_arrow, partitions
from ._text import mix, shingle_sets

EXACT_FROM, RATIO, SLACK, LEAST = Fraction(7, 8), 1.5, 0.15, 3
MISS, ROWS = 1e-9, 4
#: Bounds of a tile.
TILE_ROWS, TILE_TOKENS = 768, 1_000_000
FANOUT = 8
#: Pairs of nodes of which the children are made at once.
PARENTS = 1 << 13
#: 64-bit words of bitmaps that are compared at once.
PAIR_WORDS = 1 << 19
#: Rows up to which document ids are broadcast to pick texts; more go through a shuffle.
BROADCAST_ROWS = 500_000


class PartKeys:
    """Keys by parts of which one is equal in any two sets that reach the threshold."""

    def __init__(self, threshold: Fraction):
        self.t = threshold
        self.tops: list[int] = []
        low = 1
        while low < 1 << 40:
            self.tops.append(max(low, int(low * RATIO)))
            low = self.tops[-1] + 1
        self.edges: dict[int, tuple[int, np.ndarray]] = {}

    def parts(self, band: int) -> tuple[int, np.ndarray]:
        """Parts that may be sparse, and the bounds of the parts, of a band."""
        if band not in self.edges:
            differ = int(2 * self.tops[band] * (1 - self.t) / (1 + self.t))
            spare = int(SLACK * differ) + 1
            n = differ + 1 + spare
            self.edges[band] = spare, np.array([(i << 64) // n for i in range(1, n)], np.uint64)
        return self.edges[band]

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        band = next(i for i, top in enumerate(self.tops) if n <= top)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens + np.uint64(12345)))])
        out = []
        # partners may be larger by 1 / t, and then of the next band, never beyond it
        for b in [band] + [band + 1] * (int(n / self.t) > self.tops[band]):
            spare, edges = self.parts(b)
            at = np.concatenate([[0], np.searchsorted(tokens, edges), [n]])
            full = np.diff(at) >= LEAST
            if np.count_nonzero(~full) > spare:
                full[:] = True
            part = np.flatnonzero(full).astype(np.uint64)
            out.append(mix((sums[at[1:]] - sums[at[:-1]])[full] + part * np.uint64(1_000_003) + np.uint64(b * 7919)))
        return np.concatenate(out)


class MinKeys:
    """Keys by bands of minima."""

    def __init__(self, threshold: Fraction):
        self.bands = math.ceil(math.log(MISS) / math.log(1 - float(threshold) ** ROWS))
        self.factors = (mix(np.arange(1, self.bands * ROWS + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
        self.place = np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        x = (tokens >> np.uint64(32)).astype(np.uint32)
        y = tokens.astype(np.uint32)
        low = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 4096):  # stays in the cache
            for j, f in enumerate(self.factors):
                low[j] = min(low[j], int(((x[i : i + 4096] * f) ^ y[i : i + 4096]).min()))
        rows = low.reshape(self.bands, ROWS).astype(np.uint64)
        key = self.place.copy()
        for r in range(ROWS):
            key = mix(key + rows[:, r])
        return key


def keys_for(threshold: Fraction):
    return PartKeys(threshold) if threshold >= EXACT_FROM else MinKeys(threshold)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _stars(keys: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, its smallest class) for each key, and edges (class, smallest class) where a key has several."""
    order = np.lexsort((classes, keys))
    keys, classes = keys[order], classes[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    head = classes[first][np.cumsum(first) - 1]
    more = head != classes
    pairs = np.unique(np.stack([classes[more], head[more]], axis=1), axis=0)
    return keys[first], classes[first], pairs[:, 0], pairs[:, 1]


def prints(docs: DataFrame, text: str, k: int, threshold: Fraction, buckets: int) -> DataFrame:
    """Rows of documents (doc_id, n, class, check), of packed keys (bucket, keys) and of packed edges (bucket -1)."""
    rows = docs.select("doc_id", F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = keys_for(threshold)
        for b in batches:
            size, cls, check, keys, owner = [], [], [], [], []
            for tokens in shingle_sets(b.column(1), k):
                n = len(tokens)
                size.append(n)
                total, spread = (int(tokens.sum()), int(np.bitwise_xor.reduce(mix(tokens)))) if n else (0, 0)
                c = int(mix(np.array([total ^ (n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)], np.uint64))[0])
                cls.append(_signed(c))
                check.append(_signed(spread))
                if n:
                    keys.append(make(tokens))
                    owner.append(np.full(len(keys[-1]), c, np.uint64))
            none = pa.nulls(len(size))
            names = ["doc_id", "n", "class", "check", "bucket", "keys"]
            kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(cls, pa.int64()), pa.array(check, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
            if not keys:
                continue
            key, head, a, z = _stars(np.concatenate(keys), np.concatenate(owner))
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            packed = [(i, np.stack([key[order[s:e]], head[order[s:e]]]).tobytes()) for i, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if e > s]
            if len(a):
                packed.append((-1, np.stack([a, z]).tobytes()))
            none = pa.nulls(len(packed))
            yield pa.RecordBatch.from_arrays([none.cast(kinds[0]), *[none.cast(pa.int64())] * 3, pa.array([x[0] for x in packed], pa.int32()), pa.array([x[1] for x in packed], pa.binary())], names=names)

    return map_arrow(rows, run, f"doc_id {kind}, n long, class long, check long, bucket int, keys binary")


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in blobs]
    return np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both])


def _edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.uint64).view(np.int64)), pa.array(b.astype(np.uint64).view(np.int64))], names=["a", "b"])


def candidate_edges(packed: DataFrame, n: int) -> DataFrame:
    """Edges (a, b) between classes that share a key; keys are in n buckets, of which one is in memory at once."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def ended():
            _, _, a, b = _stars(*_unpacked(held))
            return _edge_batch(a, b)

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and bucket != now:
                    yield ended()
                    held = []
                now = bucket
                held.append(blob)
        if held:
            yield ended()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                yield _edge_batch(*_unpacked([blob]))

    across = map_arrow(packed.filter("bucket >= 0").select("bucket", "keys").repartition(n, "bucket").sortWithinPartitions("bucket"), meet, "a long, b long")
    return across.unionByName(map_arrow(packed.filter("bucket = -1").select("bucket", "keys"), unpack, "a long, b long"))


class Tree:
    """A signature tree over sets; level 0 holds the sets themselves, each level above the OR of FANOUT nodes."""

    def __init__(self, sets: list[np.ndarray], bits: int, depth: int):
        size = np.array([len(x) for x in sets], np.int64)
        # near sets next to one another: by size, then by the smallest token
        self.order = np.lexsort(([int(x[0]) for x in sets], size))
        flags = np.zeros((len(sets), bits), bool)
        for row, i in enumerate(self.order.tolist()):
            flags[row, (sets[i] & np.uint64(bits - 1)).astype(np.int64)] = True
        maps = np.packbits(flags, axis=1).view(np.uint64)
        size = size[self.order]
        self.levels = [(maps, size, size, np.bitwise_count(maps).sum(axis=1, dtype=np.int64))]
        for _ in range(depth):
            maps, low, high, pop = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(pop, at)))


def depth_for(n: int) -> int:
    return max(1, math.ceil(math.log(max(2, n), FANOUT)))


def _may_link(one: tuple, two: tuple, i: np.ndarray, j: np.ndarray, t: Fraction) -> np.ndarray:
    """Which node pairs may hold linked sets, by the largest overlap that sizes and bitmaps allow."""
    out = np.zeros(len(i), bool)
    step = max(1, PAIR_WORDS // one[0].shape[1])
    for s in range(0, len(i), step):
        a, b = i[s : s + step], j[s : s + step]
        low1, high1, low2, high2 = one[1][a], one[2][a], two[1][b], two[2][b]
        ok = (high1 * t.denominator >= low2 * t.numerator) & (high2 * t.denominator >= low1 * t.numerator)
        a, b = a[ok], b[ok]
        common = np.bitwise_count(one[0][a] & two[0][b]).sum(axis=1, dtype=np.int64)
        # every set bit that the other side lacks is a token that it lacks
        most = np.minimum(one[2][a] - np.maximum(0, one[3][a] - common), two[2][b] - np.maximum(0, two[3][b] - common))
        least = one[1][a] + two[1][b]
        ok[ok] = most * (t.numerator + t.denominator) >= least * t.numerator
        out[s : s + step] = ok
    return out


def _walk(one: Tree, two: Tree, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of level 0 that may be linked; for one tree with itself i < j."""
    same = one is two
    top = len(one.levels) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(one.levels[top][0])), np.arange(len(two.levels[top][0])), indexing="ij"))
    ways = np.arange(FANOUT)
    for level in range(top, -1, -1):
        if level == top:
            keep = _may_link(one.levels[top], two.levels[top], i, j, t)
            i, j = i[keep], j[keep]
        if same:
            keep = i <= j if level else i < j
            i, j = i[keep], j[keep]
        if not level or not len(i):
            return i, j
        # the children's sizes rule out most pairs; some parents at a time keep this small
        n, m, found = len(one.levels[level - 1][0]), len(two.levels[level - 1][0]), []
        for s in range(0, len(i), PARENTS):
            x = np.repeat(i[s : s + PARENTS, None] * FANOUT + ways, FANOUT, axis=1).ravel()
            y = np.tile(j[s : s + PARENTS, None] * FANOUT + ways, (1, FANOUT)).ravel()
            keep = (x < n) & (y < m)
            if same:
                keep &= x <= y
            x, y = x[keep], y[keep]
            keep = _may_link(one.levels[level - 1], two.levels[level - 1], x, y, t)
            found.append((x[keep].astype(np.int32), y[keep].astype(np.int32)))
        i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    return i, j


def links(left: list[np.ndarray], right: list[np.ndarray] | None, t: Fraction) -> list[tuple[int, int]]:
    """Links that connect what is connected at threshold t: pairs of places in left + right.

    right None: pairs within left. Only pairs that earlier links have not connected are compared, so not all links come out,
    but enough for the same components.
    """
    every = left + (right or [])
    if len(every) < 2 or not left:
        return []
    longest = max(map(len, every))
    bits = min(8192, max(512, 1 << (4 * longest - 1).bit_length()))
    while bits > 512 and bits * len(every) > 1 << 26:
        bits //= 2
    depth = depth_for(max(len(left), len(right or [])))
    one = Tree(left, bits, depth)
    two = one if right is None else Tree(right, bits, depth)
    i, j = _walk(one, two, t)
    if not len(i):
        return []
    a = one.order[i]
    b = two.order[j] + (0 if right is None else len(left))
    group = np.arange(len(every))
    out = []
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])).tolist()
    for s, e in zip(starts, [*starts[1:], len(a)], strict=True):
        x = int(a[s])
        todo = b[s:e]
        todo = todo[group[todo] != group[x]]
        while len(todo):
            now, todo = todo[:256], todo[256:]
            mine, sizes = every[x], np.array([len(every[y]) for y in now])
            theirs = np.concatenate([every[y] for y in now])
            at = np.searchsorted(mine, theirs)
            at[at == len(mine)] = 0
            both = np.add.reduceat((mine[at] == theirs).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            linked = both * t.denominator >= (len(mine) + sizes - both) * t.numerator
            for y in now[linked].tolist():
                if group[y] != group[x]:
                    out.append((x, y))
                    group[group == group[y]] = group[x]
            todo = todo[group[todo] != group[x]]
    return out


def _tiles(members: DataFrame, t: Fraction) -> DataFrame:
    """members (doc_id, n, block) with the tasks (block, low, i, high, j) that they take part in, and their side in these."""
    shift = math.log(1 / t)
    total = members.groupBy("block").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    level = F.when((F.col("c") <= TILE_ROWS) & (F.col("s") <= TILE_TOKENS), F.lit(0)).otherwise(F.floor(F.log(F.col("n")) / F.lit(shift) + 1e-9).cast("int"))
    members = members.join(total, "block").withColumn("level", level).drop("c", "s")
    cells = cut(members.groupBy("block", "level").agg(F.greatest(F.ceil(F.count("*") / F.lit(TILE_ROWS)), F.ceil(F.sum("n") / F.lit(TILE_TOKENS)), F.lit(1)).cast("int").alias("k")))
    out = members.join(cells, ["block", "level"])
    for name, by in (("up", -1), ("down", 1)):  # sizes that reach the threshold are of the same or of neighbouring levels
        out = out.join(cells.select("block", (F.col("level") + by).alias("level"), F.col("k").alias(name)), ["block", "level"], "left")
    out = out.withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int"))
    task = lambda low, i, high, j, side: F.struct(low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"), F.lit(side).alias("side"))
    lv, i = F.col("level"), F.col("i")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    none = F.array().cast("array<struct<low:int,i:int,high:int,j:int,side:int>>")
    tasks = F.concat(
        F.transform(upto(F.col("k")), lambda j: F.when(i <= j, task(lv, i, lv, j, 0)).otherwise(task(lv, j, lv, i, 1))),
        F.when(F.col("up").isNull(), none).otherwise(F.transform(upto(F.coalesce("up", F.lit(1))), lambda j: task(lv, i, lv + 1, j, 0))),
        F.when(F.col("down").isNull(), none).otherwise(F.transform(upto(F.coalesce("down", F.lit(1))), lambda j: task(lv - 1, j, lv, i, 1))),
    )
    return out.select("doc_id", "block", F.explode(tasks).alias("task")).select("doc_id", "block", "task.*")


TASK = ["block", "low", "i", "high", "j"]


def _strays(later: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of tasks that are left to do: later (TASK, side, doc_id) with ``part``, as two tasks for a pair of tiles.

    In part 0 the strays of one tile meet all rows of the other, in part 1 the others of the one meet the strays of the other.
    """
    blocks = later.select("block").distinct()
    groups = components(edges).withColumnRenamed("node", "doc_id")
    labelled = cut(members.join(blocks, "block", "left_semi").join(groups, "doc_id", "left").select("doc_id", "block", F.coalesce("component", "doc_id").alias("label")))
    sizes = labelled.groupBy("block", "label").agg(F.count("*").alias("c"))
    main = sizes.groupBy("block").agg(F.max(F.struct("c", "label"))["label"].alias("main"))
    strays = labelled.join(main, "block").filter("label <> main").select("doc_id", F.lit(True).alias("stray"))
    rows = cut(later.join(strays, "doc_id", "left").withColumn("stray", F.coalesce("stray", F.lit(False))))
    held = rows.groupBy(*TASK).agg(F.count_if(F.col("stray") & (F.col("side") == 0)).alias("s0"), F.count_if(F.col("stray") & (F.col("side") == 1)).alias("s1"))
    rows = rows.join(held.filter("s0 + s1 > 0"), TASK)
    one = rows.filter("s0 > 0 and (side = 1 or stray)").withColumn("part", F.lit(0))
    two = rows.filter("s1 > 0 and stray = (side = 1)").withColumn("part", F.lit(1))
    return one.unionByName(two).select(*TASK, "part", "side", "doc_id")


def _compare(tasks: DataFrame, k: int, t: Fraction) -> DataFrame:
    """Edges between documents from rows (block, low, i, high, j, part, side, doc_id, text)."""
    names = [*TASK, "part"]
    kind = tasks.schema["doc_id"].dataType.simpleString()
    tasks = tasks.select(*names, "side", "doc_id", "text").repartition(4 * partitions(tasks.sparkSession), *names).sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ({}, {})

        def ended():
            low, i, high, j = now[1:5]
            left = held[0]
            right = None if (low, i) == (high, j) else held[1]
            ids = [*left, *(right or {})]
            found = links([*left.values()], None if right is None else [*right.values()], t) if right is None or right else []
            return pa.RecordBatch.from_arrays([pa.array([ids[x[n]] for x in found], batch.schema.field("doc_id").type) for n in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in names]
            for key, side, doc, tokens in zip(zip(*columns, strict=True), batch.column("side").to_pylist(), batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), k), strict=True):
                if now is not None and key != now:
                    yield ended()
                    held = ({}, {})
                now = key
                held[side][doc] = tokens
        if now is not None:
            yield ended()

    return map_arrow(tasks, run, f"a {kind}, b {kind}")


def join(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(4, 5), text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles (distinct word k-grams) and component_id.

    Documents are linked if the intersection of their sets is at least ``threshold`` of the union; component_id is the
    smallest doc_id that links lead to, the document itself included. Words are runs without white space, A-Z as a-z. A text
    of fewer than k words is one shingle; null texts, empty ones and those of white space have none and stand alone. Rows
    with equal texts are linked, repeated rows come out repeatedly, rows with a null doc_id get the component of their text
    or null. An empty table gives none. Other columns are not read, whatever their names. Rows that share a doc_id but not the
    text are compared by one of their texts each. Links themselves are not counted, as pairs that are connected already are not
    compared: the operator yields components. Texts are read whole; a long one is one set in memory.
    """
    n = 2 * buckets(docs.select("doc_id", text))
    printed = cut(prints(docs, text, k, threshold, n))
    rows = printed.filter("bucket is null").select("doc_id", "n", "class", "check")
    classes = cut(rows.filter("n > 0 and doc_id is not null").groupBy("n", "class", "check").agg(F.min("doc_id").alias("first")))
    blocks = components(candidate_edges(printed.filter("bucket is not null"), n))
    members = cut(classes.join(blocks.select(F.col("node").alias("class"), F.col("component").alias("block")), "class").select(F.col("first").alias("doc_id"), "n", "block"))
    tasks = cut(_tiles(members, threshold))
    ids = members.select("doc_id").distinct()
    if members.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = docs.select("doc_id", F.col(text).alias("text")).filter("doc_id is not null").join(ids, "doc_id", "left_semi")
    near = "i = 0 or j = 0 or (low = high and i = j)"
    edges = cut(_compare(tasks.filter(near).withColumn("part", F.lit(0)).join(texts, "doc_id"), k, threshold))
    later = tasks.filter(f"not ({near})")
    if not later.isEmpty():
        edges = edges.unionByName(cut(_compare(_strays(later, members, edges).join(texts, "doc_id"), k, threshold)))
    groups = components(edges).select(F.col("node").alias("first"), "component")
    lead = cut(classes.join(groups, "first", "left").select("n", "class", "check", F.coalesce("component", "first").alias("component")))
    return rows.join(lead, ["n", "class", "check"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, Fraction(9, 10))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near copies (five-word shingles, similarity 0.8): of each group the smallest doc_id stays.

    Rows that repeat a doc_id stay or go together. Each row with a null doc_id is a document of its own, after all others:
    it goes if it is a near copy of a document with an id or of an earlier one without, else it stays.
    """
    kind = docs.schema["doc_id"].dataType
    top = docs.agg(F.max("doc_id").cast("long").alias("top"), F.count_if(F.col("doc_id").isNull()).alias("bare")).first()
    after = max(0, 0 if top.top is None else top.top + 1)
    every = docs
    if top.bare:
        every = docs.filter("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
        every = every.unionByName(cut(docs.filter("doc_id is null").withColumn("doc_id", F.lit(after).cast("long") + F.monotonically_increasing_id())))
    keep = join(every).filter("doc_id = component_id").select("doc_id").distinct()
    out = every.join(keep, "doc_id", "left_semi")
    if top.bare:
        out = out.withColumn("doc_id", F.when(F.col("doc_id") < after, F.col("doc_id")).cast(kind))
    return out.select(*docs.columns)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM w),
t AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
c(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(c.b) AS component_id FROM s JOIN c ON c.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
