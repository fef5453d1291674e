"""Near-duplicate vectors by int8 tile products with exact error bounds.

Vectors are scaled to length 1 and quantised to int8 with a scale of their own. With q the quantised and x the exact vector,
x.y differs from q_x.q_y by at most |x - q_x| |y| + |q_x| |y - q_y|; the lengths of the residuals are kept with each vector.
Tiles of vectors are multiplied as int8 values held in float32, where the products of up to 1024 components are exact integers.
Pairs whose bound lies on one side of the threshold are settled by it; the others are recomputed in double precision.

Equal vectors form a class first. Tiles hold vectors near a common pivot, so that many pairs of tiles are ruled out by the
angle between their centres and their radii (the triangle inequality of angles). Tiles travel in blocks, and a block goes once
to each other block that is not ruled out, so that what is shuffled grows with the number of blocks of many tiles, not of
tiles. What a pair of tiles returns is linear in its rows: numbers of links, and links that connect its components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._components import components
from ._model import bounded_sample
from ._store import cut, map_arrow, partitions

#: Bounds of a tile and of a block: vectors, bytes.
TILE, TILE_BYTES, BLOCK_BYTES = 8192, 4 << 20, 16 << 20
#: Pivots are a sample of about so many vectors at most; groups of one pivot beyond a tile are parted by hash.
PIVOTS = 4096
#: Bytes of blocks' centres up to which these are sent to all executors, to rule out pairs.
CENTRES_BYTES = 64 << 20
#: Components of which products of int8 values are summed exactly in float32.
SPAN = 1024
#: Rounding of double precision in lengths and products of vectors of some thousand components, generously.
SLACK = 1e-9
STRIP = 512
BROADCAST_ROWS = 500_000


def _unit(x: np.ndarray) -> np.ndarray:
    # of large components the square would overflow
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scales, lengths of the residuals) of unit vectors."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1)) + SLACK


def _raw(data: bytes, wide: bool, n: int) -> np.ndarray:
    return np.frombuffer(data, np.float64 if wide else np.float32).reshape(n, -1).astype(np.float64)


class Tile:
    def __init__(self, row: dict):
        self.ids, self.weight = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["weights"], np.int64)
        self.raw = _unit(_raw(row["vectors"], row["wide"], len(self.ids)))
        self.centre, self.radius = np.array(row["centre"]), row["radius"]
        self.q, self.scale, self.rest = quantised(self.raw)
        self.length = 1 + self.rest

    def products(self, rows: np.ndarray, other: Tile) -> np.ndarray:
        """The products of the int8 values of some rows with all of other."""
        dot = None
        for s in range(0, self.q.shape[1], SPAN):
            part = self.q[rows, s : s + SPAN].astype(np.float32) @ other.q[:, s : s + SPAN].astype(np.float32).T
            dot = part if dot is None else dot.astype(np.float64) + part
        return dot

    def bounds(self, dot: np.ndarray, rows: np.ndarray, other: Tile, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Approximate cosines from some products, and how far off they may be."""
        near = dot.astype(np.float64) * self.scale[rows, None] * other.scale[columns][None]
        return near, self.rest[rows, None] + self.length[rows, None] * other.rest[columns][None]


def compare(one: Tile, two: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each row of one and of two (by weight), and pairs (place, place in one + two) that connect what is connected.

    For a tile with itself two is one, and a row is not compared with itself.
    """
    same, n = one is two, len(one.ids)
    count1, count2 = np.zeros(n, np.int64), np.zeros(len(two.ids), np.int64)
    group = np.arange(n + (0 if same else len(two.ids)))
    edges: list[tuple[int, int]] = []
    far = float(two.rest.max())
    for s in range(0, n, STRIP):
        rows = np.arange(s, min(n, s + STRIP))
        dot = one.products(rows, two)
        # first by the largest error of the strip, with room for the rounding of float32
        floor = (threshold - one.rest[rows].max() - one.length[rows].max() * far - 1e-4) / one.scale[rows]
        maybe = dot * two.scale.astype(np.float32) >= floor[:, None].astype(np.float32)
        left, right = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
        if not len(left):
            continue
        rows = rows[left]
        near, off = one.bounds(dot[np.ix_(left, right)], rows, two, right)
        linked = near - off >= threshold
        i, j = np.nonzero((near + off >= threshold) & ~linked)
        for a in range(0, len(i), 1 << 18):
            x, y = i[a : a + (1 << 18)], j[a : a + (1 << 18)]
            linked[x, y] = np.einsum("ij,ij->i", one.raw[rows[x]], two.raw[right[y]]) >= threshold
        if same:
            linked[rows[:, None] == right[None]] = False
        if not linked.any():
            continue
        count1[rows] += linked @ two.weight[right]
        if not same:
            count2[right] += one.weight[rows] @ linked
        left, right = rows, right + (0 if same else n)
        while True:  # the smallest group that reaches each row and column
            least = np.where(linked, group[left][:, None], len(group)).min(axis=0)
            for at, low in ((right, least), (left, None)):
                if low is None:
                    low = np.where(linked, group[right][None], len(group)).min(axis=1)
                for p, g in zip(at[low < group[at]].tolist(), low[low < group[at]].tolist(), strict=True):
                    if group[p] != g:
                        was = group[p]
                        low_g, high_g = min(g, was), max(g, was)
                        if low_g != high_g:
                            edges.append((int(low_g), int(high_g)))
                            group[group == high_g] = low_g
            both = np.where(linked, group[left][:, None] != group[right][None], False)
            if not both.any():
                break
    return count1, count2, edges


def _tile_rows(vectors: DataFrame) -> DataFrame:
    """One row per tile: tile, ids, weights, vectors, centre, radius."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, wide = [], None, False

        def ended():
            ids, weights, data = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), b"".join(x for h in held for x in h[2])
            raw = _unit(_raw(data, wide, len(ids)))
            centre = raw.mean(axis=0)
            norm = float(np.sqrt(centre @ centre))
            centre = centre / norm if norm > 1e-12 else raw[0]
            radius = float(np.arccos(np.clip(raw @ centre, -1, 1)).max()) + 1e-6
            return pa.RecordBatch.from_pydict({"tile": pa.array([now], pa.int64()), "ids": [ids.tobytes()], "weights": [weights.tobytes()], "vectors": [data], "wide": [wide], "centre": [centre.tolist()], "radius": [radius]})

        for b in batches:
            tile = b.column("tile").to_numpy()
            raw, wides = b.column("exact").to_pylist(), b.column("wide").to_pylist()
            ids, weights = b.column("id").to_numpy(), b.column("weight").to_numpy()
            cuts = np.flatnonzero(np.diff(tile)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tile)], strict=True):
                if e == s:
                    continue
                if held and tile[s] != now:
                    yield ended()
                    held = []
                now, wide = int(tile[s]), wides[s]
                held.append((ids[s:e], weights[s:e], raw[s:e]))
        if held:
            yield ended()

    ordered = vectors.select("tile", "id", "weight", "exact", "wide").repartition(partitions(vectors.sparkSession), "tile").sortWithinPartitions("tile")
    return map_arrow(ordered, build, "tile long, ids binary, weights binary, vectors binary, wide boolean, centre array<double>, radius double")


def _read(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows (id, dim, wide, exact): the vector's bytes, as doubles if wide, else as floats; null if it can't be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide = b.column(1).type.value_type != pa.float32()
            ids, dims, exact = b.column(0).to_pylist(), [], []
            for i, v in zip(ids, b.column(1), strict=True):
                x = None
                if i is not None and v.is_valid and len(v) and not v.values.null_count:
                    x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64 if wide else np.float32) + 0  # -0 is 0
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                dims.append(None if x is None else len(x))
                exact.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array([wide] * len(ids), pa.bool_()), pa.array(exact, pa.binary())], names=["id", "dim", "wide", "exact"])

    return map_arrow(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v")), run, "id long, dim int, wide boolean, exact binary")


def _numbered(sizes: list[tuple[int, int, int]], width: int, tasks: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """((dim, pivot, first tile, tiles) of each group, (tile, block) of each tile) from sizes (dim, pivot, vectors).

    Blocks hold tiles of one dimension, are as few as BLOCK_BYTES allows, but as many as give each of ``tasks`` a pair.
    """
    groups, blocks = [], []
    n_tiles, block = 0, -1
    for dim in sorted({d for d, _, _ in sizes}):
        own = [(pivot, n) for d, pivot, n in sizes if d == dim]
        most = max(16, min(TILE, TILE_BYTES // (dim * width)))
        total = sum(n for _, n in own)
        rows = max(1, min(BLOCK_BYTES // (dim * width), math.ceil(total / math.ceil(math.sqrt(2 * tasks)))))
        most = max(1, min(most, rows))
        held = rows + 1
        for pivot, n in own:
            k = max(1, math.ceil(n / most))
            groups.append((dim, pivot, n_tiles, k))
            for tile in range(n_tiles, n_tiles + k):
                if held + n / k > rows:
                    block, held = block + 1, 0
                held += n / k
                blocks.append((tile, block))
            n_tiles += k
        # the next dimension begins a block of its own
    return groups, blocks


def _block_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """(one, two) of blocks, one <= two, of one dimension that angles do not rule out."""
    spark = tiles.sparkSession
    limit = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, float]]] = {}
        for b in batches:
            for block, c, r in zip(*[b.column(x).to_pylist() for x in ("block", "centre", "radius")], strict=True):
                held.setdefault(block, []).append((np.array(c), r))
        rows = []
        for block, found in held.items():
            mean = np.mean([c for c, _ in found], axis=0)
            norm = float(np.sqrt(mean @ mean))
            mean = mean / norm if norm > 1e-12 else found[0][0]
            rows.append((block, len(mean), mean.tolist(), max(float(np.arccos(np.clip(c @ mean, -1, 1))) + r for c, r in found) + 1e-6))
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=["block", "dim", "centre", "radius"])

    metas = cut(map_arrow(tiles.select("block", "centre", "radius").repartition(partitions(spark), "block"), centre, "block long, dim int, centre array<double>, radius double"))
    size = metas.agg(F.sum(F.col("dim") * 8 + 16)).first()[0] or 0
    if size > CENTRES_BYTES:  # all pairs of blocks of one dimension, each the lower of as many as there are after it
        other = metas.select("dim", F.col("block").alias("two"))
        return metas.select("dim", F.col("block").alias("one")).join(other, "dim").filter("one <= two").select("one", "two")
    by_dim: dict[int, list[tuple[int, list[float], float]]] = {}
    for r in metas.orderBy("block").collect():
        by_dim.setdefault(r["dim"], []).append((r["block"], r["centre"], r["radius"]))
    every = spark.sparkContext.broadcast({d: (np.array([x[0] for x in v]), np.array([x[1] for x in v]), np.array([x[2] for x in v])) for d, v in by_dim.items()})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = [], []
            for block, dim, c, r in zip(*[b.column(x).to_pylist() for x in ("block", "dim", "centre", "radius")], strict=True):
                ids, centres, radii = every.value[dim]
                apart = np.arccos(np.clip(centres @ np.array(c), -1, 1)) - radii - r
                found = ids[(ids == block) | ((ids > block) & (apart <= limit))]
                two.append(found)
                one.append(np.full(len(found), block))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in (one, two)], names=["one", "two"])

    return map_arrow(metas, near, "one long, two long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, vector: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links (other rows linked), component_id (smallest vec_id reachable), kept.

    Two rows are linked if the cosine of their vectors, in double precision, reaches the threshold (above 0); one that is
    equal to the threshold links. Null, empty and zero vectors, and those with null or non-finite components, link with nothing,
    nor do vectors of different lengths. Rows that repeat a vec_id count as rows of their own; rows with a null vec_id come out
    unlinked. Labels and other columns are not read, whatever their names. The work on pairs grows with the square of the tiles
    that are not ruled out. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = cut(_read(vectors, vector))
    alone = [F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")]
    classes = cut(rows.filter("exact is not null").groupBy("exact").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("dim").alias("dim"), F.first("wide").alias("wide")))
    n = classes.count()
    if not n:
        return rows.select(F.col("id").alias("vec_id"), *alone, F.col("id").isNotNull().alias("kept"))
    tasks = partitions(spark)
    pivots: dict[int, list[np.ndarray]] = {}
    for r in bounded_sample(classes, "id", min(PIVOTS, max(math.ceil(n / TILE), math.ceil(math.sqrt(2 * tasks))))).select("dim", "wide", "exact").collect():
        pivots.setdefault(r["dim"], []).append(_unit(_raw(r["exact"], r["wide"], 1))[0])
    shared = spark.sparkContext.broadcast({d: np.array(v) for d, v in pivots.items()})

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            near = np.zeros(len(dims), np.int64)
            raw, wide = b.column("exact").to_pylist(), b.column("wide").to_pylist()
            for d in np.unique(dims).tolist():
                if d in shared.value:
                    at = np.flatnonzero(dims == d)
                    near[at] = (_raw(b"".join(raw[i] for i in at.tolist()), wide[0], len(at)) @ shared.value[d].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near)], names=[*b.schema.names, "pivot"])

    placed = cut(map_arrow(classes, nearest, T.StructType([*classes.schema.fields]).add("pivot", "long")))
    # one number for each (dim, pivot, chunk); there are about PIVOTS pivots at most
    sizes = sorted((r["dim"], r["pivot"], r["n"]) for r in placed.groupBy("dim", "pivot").agg(F.count("*").alias("n")).collect())
    groups, blocks = _numbered(sizes, 8 if placed.first()["wide"] else 4, tasks)
    numbers = F.broadcast(spark.createDataFrame(groups, "dim int, pivot long, first long, k int"))
    tiled = placed.join(numbers, ["dim", "pivot"]).withColumn("tile", F.col("first") + F.pmod(F.xxhash64("id"), F.col("k")))
    # as many rows as tiles, of two numbers
    tiles = cut(_tile_rows(tiled).join(F.broadcast(spark.createDataFrame(blocks, "tile long, block long")), "tile"))
    pairs = cut(_block_pairs(tiles, threshold))
    if pairs.count() <= BROADCAST_ROWS:
        pairs = F.broadcast(pairs)
    first = tiles.join(pairs.withColumn("block", F.col("one")), "block").withColumn("side", F.lit(0))
    second = tiles.join(pairs.filter("one < two").withColumn("block", F.col("two")), "block").withColumn("side", F.lit(1))
    both = first.unionByName(second).repartition(2 * tasks, "one", "two").sortWithinPartitions("one", "two", "side", "tile")
    limit = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in b.schema.names}
                if (row["one"], row["two"]) != now:
                    now, held = (row["one"], row["two"]), []
                tile = Tile(row)
                todo = list(held)
                if not row["side"]:
                    held.append(tile)
                    # the pair of a block with itself compares its tiles, others only those of different blocks
                    todo = held if row["one"] == row["two"] else []
                for other in todo:
                    if other is not tile and float(np.arccos(np.clip(other.centre @ tile.centre, -1, 1))) - other.radius - tile.radius > limit:
                        continue
                    n1, n2, edges = compare(other, tile, threshold)
                    ids = tile.ids if other is tile else np.concatenate([other.ids, tile.ids])
                    counts = n1 if other is tile else np.concatenate([n1, n2])
                    some = np.flatnonzero(counts)
                    a, z = [int(ids[x]) for x, _ in edges], [int(ids[y]) for _, y in edges]
                    yield pa.RecordBatch.from_arrays([pa.array([*ids[some].tolist(), *a], pa.int64()), pa.array([*[None] * len(some), *z], pa.int64()), pa.array([*counts[some].tolist(), *[0] * len(a)], pa.int64())], names=["a", "b", "n"])

    found = cut(map_arrow(both, product, "a long, b long, n long"))
    links = found.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    groups = components(found.filter("b is not null").select("a", "b"))
    lead = classes.select("exact", "id", "weight").join(links, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    lead = lead.select("exact", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("id", "exact").join(lead, "exact", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
c(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a),
m AS (SELECT a AS vec_id, min(b) AS component_id FROM c GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)
"""
