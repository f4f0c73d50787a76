"""Near-duplicate embeddings by lattice hashing.

Unit vectors are projected at random, two blocks of eight dimensions a table,
and each block is decoded to the nearest point of the E8 lattice. A vector is
stored in the cell of its two points and looked up there and in the nearest
neighbouring cells; what meets is verified by cosine.

Equal vectors are one node first, so copies make no pairs. Nodes that lie
within half the angle of a link around another one make a ball with it: by the
triangle inequality all of them link with each other, so a dense group needs
no pairs inside its balls. Cells and candidates are those of balls, and two
balls are verified as blocks by a matrix product that gives a count of links
a node, never a row a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.operators.components import connected_components
from .shared import written

#: Tables, blocks of eight dimensions in each, scale of the projection (unit
#: variance times this, where the lattice's shortest vectors have length
#: sqrt 2) and cells looked up besides a vector's own. At cosine 0.95 they find
#: over 99 of 100 pairs, at 0.98 practically all; see the tests.
TABLES, BLOCKS, SCALE, PROBES = 6, 2, 0.5, 8
#: Bits by which the signs of 64 random projections of a pair may differ: five
#: deviations above what cosine 0.95 gives.
SKETCH_BITS = 19
#: Nodes of one block of a ball, about.
BLOCK = 1024


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(1)
    rows = np.arange(len(x))
    step = np.where(off[rows, worst] >= 0, 1.0, -1.0)
    odd = near.sum(1) % 2 != 0
    near[rows[odd], worst[odd]] += step[odd]
    return near


def e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 to each row (eight numbers), doubled to integers:
    the nearer of the nearest points of D8 and of D8 moved by one half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(nearer[:, None], a, b) * 2


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: the steps to the neighbours."""
    steps = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (2, -2):
                for b in (2, -2):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    steps.append(v)
    for bits in range(256):
        v = np.array([1.0 if bits >> i & 1 else -1.0 for i in range(8)])
        if (v < 0).sum() % 2 == 0:
            steps.append(v)
    return np.array(steps)


def _keys(points: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """A hash of the rows of small integers."""
    h = (points.astype(np.int64).view(np.uint64) * multipliers).sum(-1, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def cells(unit: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: a sketch of 64 signs, the own cell in each table and
    the neighbouring cells looked up in each table, nearest first."""
    n, d = unit.shape
    rng = np.random.default_rng([seed, d])
    signs = (unit @ rng.standard_normal((d, 64)) > 0).astype(np.uint8)
    sketch = np.packbits(signs, axis=1, bitorder="little").view("<i8")[:, 0]
    steps = _shortest()
    home = np.empty((n, TABLES), dtype=np.uint64)
    near = np.empty((n, TABLES, PROBES), dtype=np.uint64)
    for t in range(TABLES):
        salt = np.uint64((2 * t + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
        multipliers = rng.integers(1, 2**63, 8 * BLOCKS, dtype=np.uint64) | np.uint64(1)
        part, gap = [], []
        for _ in range(BLOCKS):
            x = unit @ rng.standard_normal((d, 8)) * SCALE
            p = e8(x)
            # Squared distance to the neighbour at p + s, less that to p.
            off = 2 * x - p
            gain = (steps**2).sum(1)[None] - 2 * off @ steps.T
            nearest = np.argpartition(gain, PROBES, axis=1)[:, :PROBES]
            part.append((p, nearest))
            gap.append(np.take_along_axis(gain, nearest, 1))
        own = np.concatenate([p for p, _ in part], axis=1)
        home[:, t] = _keys(own, multipliers) ^ salt
        every = np.concatenate(gap, axis=1)
        order = np.argsort(every, axis=1)[:, :PROBES]
        for k in range(PROBES):
            other = own.copy()
            for b, (_, nearest) in enumerate(part):
                at = order[:, k]
                mine = at // PROBES == b
                other[mine, 8 * b : 8 * b + 8] += steps[nearest[mine, at[mine] % PROBES]]
            near[:, t, k] = _keys(other, multipliers) ^ salt
    return sketch, home.view(np.int64), near.view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column.to_numpy(zero_copy_only=False)])


def hashed(nodes: DataFrame) -> DataFrame:
    """node, dims, sketch, home (array, a cell a table) and near (array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                dims = np.asarray(part.column("dims"))
                for d in np.unique(dims).tolist():
                    own = part.filter(pa.array(dims == d))
                    v = _matrix(own.column("vector"))
                    sketch, home, near = cells(v / np.linalg.norm(v, axis=1, keepdims=True))
                    yield pa.RecordBatch.from_arrays(
                        [own.column("node"), own.column("dims"), pa.array(sketch), pa.array(list(home), pa.list_(pa.int64())), pa.array(list(near.reshape(len(near), -1)), pa.list_(pa.int64()))],
                        names=["node", "dims", "sketch", "home", "near"],
                    )

    return nodes.select("node", "dims", "vector").mapInArrow(run, "node bigint, dims int, sketch bigint, home array<bigint>, near array<bigint>")


def sketch_bits(angle: float) -> int:
    """Bits by which the sketches of a pair at an angle differ, at most: five
    deviations above the mean."""
    p = angle / np.pi
    return int(np.ceil(64 * p + 5 * np.sqrt(64 * p * (1 - p))))


def _with_cosine(pairs: DataFrame) -> DataFrame:
    """src, dst and cosine of pairs (src, dst, a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.slice(lo, 4000)
                a, b = part.column("a").to_numpy(zero_copy_only=False), part.column("b").to_numpy(zero_copy_only=False)
                cos = np.empty(len(a))
                size = np.array([len(x) for x in a])
                for d in np.unique(size).tolist():
                    at = np.flatnonzero(size == d)
                    x, y = (np.stack([np.asarray(v[i], dtype=np.float64) for i in at]) for v in (a, b))
                    cos[at] = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                yield pa.RecordBatch.from_arrays([part.column("src"), part.column("dst"), pa.array(cos)], names=["src", "dst", "cosine"])

    return pairs.mapInArrow(run, "src bigint, dst bigint, cosine double")


def balls(nodes: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """node, ball: the smallest node within half the angle of ``threshold``
    that is met in a cell and has none such itself; else the node.

    Of each cell only its smallest node is met, so this grows with the nodes."""
    half = np.arccos(threshold) / 2 - 1e-6
    homes = table.select("dims", F.explode("home").alias("cell"), F.struct("node", "sketch").alias("own"))
    least = homes.groupBy("dims", "cell").agg(F.min("own").alias("low"))
    looks = table.select("node", "dims", "sketch", F.explode(F.concat("home", "near")).alias("cell"))
    close = (F.col("low.node") < F.col("node")) & (F.bit_count(F.col("sketch").bitwiseXOR(F.col("low.sketch"))) <= sketch_bits(half))
    met = written(looks.join(least, ["dims", "cell"]).where(close).select(F.col("node").alias("src"), F.col("low.node").alias("dst")).distinct())
    a = nodes.select(F.col("node").alias("src"), F.col("vector").alias("a"))
    b = nodes.select(F.col("node").alias("dst"), F.col("vector").alias("b"))
    near = written(_with_cosine(met.join(a, "src").join(b, "dst").select("src", "dst", "a", "b")).where(F.col("cosine") >= float(np.cos(half))).select("src", "dst"))
    # A node that leads is in no ball of another one.
    led = near.join(near.select(F.col("src").alias("dst")).distinct(), "dst", "left_anti").groupBy("src").agg(F.min("dst").alias("ball"))
    return nodes.select("node").join(led, F.col("node") == F.col("src"), "left").select("node", F.coalesce("ball", "node").alias("ball"))


def met_balls(table: DataFrame, threshold: float) -> DataFrame:
    """src > dst: balls of which a node looks into a cell of the other's and
    whose leading nodes' sketches are close enough. ``table``: node, dims,
    sketch, home, near, ball, many (nodes of the ball)."""
    angle = np.arccos(threshold)
    # Only the nodes of one ball can repeat a cell.
    once = lambda df, wide: df.where(F.col(wide) == 0).union(df.where(F.col(wide) == 1).distinct())
    lead = table.where("node = ball").select("ball", F.col("sketch").alias("lead"))
    own = table.join(lead, "ball").select("ball", "dims", "lead", (F.col("many") > 1).cast("int").alias("wide"), "home", "near")
    homes = once(own.select(F.col("ball").alias("b"), "dims", F.col("lead").alias("lead_b"), F.col("wide").alias("wide_b"), F.explode("home").alias("cell")), "wide_b")
    looks = once(own.select("ball", "dims", "lead", "wide", F.explode(F.concat("home", "near")).alias("cell")), "wide")
    wide = F.col("wide") + F.col("wide_b")
    bits = F.when(wide == 0, sketch_bits(angle)).when(wide == 1, sketch_bits(1.5 * angle)).otherwise(sketch_bits(2 * angle))
    met = looks.join(homes, ["dims", "cell"]).where((F.col("ball") != F.col("b")) & (F.bit_count(F.col("lead").bitwiseXOR(F.col("lead_b"))) <= bits))
    return met.select(F.greatest("ball", "b").alias("src"), F.least("ball", "b").alias("dst")).distinct()


def block_links(pairs: DataFrame, threshold: float) -> DataFrame:
    """src, dst (balls), node, linked: of each pair of blocks (src, dst, and
    the members a and b: node, size, vector), the nodes that link with the
    other block and the rows they link with."""

    def parts(column: pa.ListArray) -> tuple:
        """First member of each row and one more, nodes, sizes, and the
        vectors as numbers with their first places."""
        flat = column.flatten()
        vectors = flat.field("vector")
        places = np.concatenate([[0], np.cumsum(np.asarray(vectors.value_lengths(), dtype=np.int64))])
        first = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths(), dtype=np.int64))])
        return first, np.asarray(flat.field("node")), np.asarray(flat.field("size"), dtype=np.int64), np.asarray(vectors.flatten(), dtype=np.float64), places

    def units(numbers: np.ndarray, places: np.ndarray, which: np.ndarray, dims: int) -> np.ndarray:
        v = numbers[places[which][:, None] + np.arange(dims)]
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.slice(lo, 4000)
                src, dst = np.asarray(part.column("src")), np.asarray(part.column("dst"))
                (fa, na, sa, va, pa_), (fb, nb, sb, vb, pb) = parts(part.column("a")), parts(part.column("b"))
                dims = np.diff(pa_)[fa[:-1]]
                lone = (np.diff(fa) == 1) & (np.diff(fb) == 1)
                out: list[list[np.ndarray]] = [[], [], [], []]

                def add(row: np.ndarray, node: np.ndarray, linked: np.ndarray) -> None:
                    for held, x in zip(out, (src[row], dst[row], node, linked)):  # noqa: B023
                        held.append(x)

                for d in np.unique(dims[lone]).tolist():
                    row = np.flatnonzero(lone & (dims == d))
                    i, j = fa[row], fb[row]
                    near = np.flatnonzero((units(va, pa_, i, d) * units(vb, pb, j, d)).sum(1) >= threshold)
                    row, i, j = row[near], i[near], j[near]
                    add(row, na[i], sb[j])
                    add(row, nb[j], sa[i])
                for row in np.flatnonzero(~lone).tolist():
                    i, j = np.arange(fa[row], fa[row + 1]), np.arange(fb[row], fb[row + 1])
                    near = units(va, pa_, i, dims[row]) @ units(vb, pb, j, dims[row]).T >= threshold
                    for node, linked in ((na[i], near @ sb[j]), (nb[j], sa[i] @ near)):
                        some = np.flatnonzero(linked)
                        add(np.full(len(some), row), node[some], linked[some])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], names=["src", "dst", "node", "linked"])

    return pairs.select("src", "dst", "a", "b").mapInArrow(run, "src bigint, dst bigint, node bigint, linked bigint")


def embedding_groups(embeddings: DataFrame, *, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row a row: vec_id, n_links, component_id, kept.

    Vectors of equal length link at cosine ``threshold`` or more. Null and
    zero vectors and those with null or non-finite components link with
    nothing: 0 links and their own id. Rows with a repeated vector link with
    each other; rows that share an id but not a vector count by themselves. A
    null id counts as largest: a component's id is null only if all of its ids
    are. An empty table gives no rows; extra columns are ignored.
    """
    rows = embeddings.select(embeddings[key].alias("vec_id"), embeddings[vector].alias("vector"))
    sound = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    good = rows.where(sound)
    classes = good.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    nodes = written(classes.withColumns({"node": F.monotonically_increasing_id(), "dims": F.size("vector")}))
    table = written(hashed(nodes))
    placed = written(balls(nodes, table, threshold))
    sizes = written(placed.join(nodes.select("node", "size", "least"), "node").groupBy("ball").agg(F.count("*").alias("many"), F.sum("size").alias("weight"), F.min("least").alias("least")))
    pairs = written(met_balls(table.join(placed, "node").join(sizes.select("ball", "many"), "ball"), threshold))
    # Members of the balls that were met, in blocks of a bounded size.
    wanted = pairs.select(F.explode(F.array("src", "dst")).alias("ball")).distinct()
    parts = F.ceil(F.col("many") / BLOCK)
    dealt = placed.join(wanted, "ball").join(sizes.select("ball", "many"), "ball").join(nodes.select("node", "size", "vector"), "node")
    blocks = written(dealt.groupBy("ball", F.pmod(F.xxhash64("node"), parts).alias("part"), parts.alias("parts")).agg(F.collect_list(F.struct("node", "size", F.col("vector").cast("array<double>").alias("vector"))).alias("members")))
    of = lambda end, name: blocks.select(F.col("ball").alias(end), F.col("members").alias(name))
    found = written(block_links(pairs.join(of("src", "a"), "src").join(of("dst", "b"), "dst"), threshold))
    roots = connected_components(found.select("src", "dst").distinct())
    linked = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    named = written(sizes.join(roots, F.col("ball") == F.col("node"), "left").select("ball", "weight", "least", F.coalesce("root", "ball").alias("root")))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_ball = named.join(groups, "root").select("ball", "weight", "component_id")
    results = written(nodes.select("node", "vector").join(placed, "node").join(of_ball, "ball").join(linked, "node", "left").select("vector", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id"))
    known = good.join(results, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.union(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
