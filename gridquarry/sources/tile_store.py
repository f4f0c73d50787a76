"""Pixel grids on disk as tiles, and reads that open only the tiles they need.

A store is a folder: ``tiles``, Parquet with a row a tile, partitioned by
image and by blocks of ``chunk`` x ``chunk`` tiles (a file a block, so that
small tiles don't make small files), and ``manifest``, a row a tile with its
place, size and digest, written last: a folder without it is no store. A
region read filters by the blocks (whole files are left out) and by the tiles
(row groups are left out) before it looks at a pixel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of the format.
MOST_TILE, MOST_EDGE, MOST_REGION_BYTES = 512, 65_536, 16 << 20


def shapes(grid: DataFrame) -> DataFrame:
    """image_id, height and width, as far as pixels reach."""
    return grid.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def _packed(grid: DataFrame, channel: str, size: int) -> DataFrame:
    """A row a tile: values, row by row. A tile has size x size pixels at most."""
    pixel = F.struct("y", "x", F.col(channel).cast("double").alias("v"))
    tile = [F.col("image_id"), F.expr(f"y div {size}").alias("ty"), F.expr(f"x div {size}").alias("tx")]
    packed = grid.groupBy(*tile).agg(F.array_sort(F.collect_list(pixel)).alias("pixels"), F.count_distinct("y", "x").alias("places"), F.count_if(F.col("y").isNull() | F.col("x").isNull() | (F.least("y", "x") < 0)).alias("unplaced"))
    return packed.withColumn("values", F.col("pixels.v"))


def digest(values: Column) -> Column:
    """SHA-256 of values as their shortest decimals, comma-joined; null as an
    empty text."""
    return F.sha2(F.array_join(F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit(""))), ","), 256)


def _laid_out(packed: DataFrame, sized: DataFrame, size: int) -> DataFrame:
    edge = lambda whole, at: F.least(F.lit(size), F.col(whole) - F.col(at) * size)
    return packed.join(sized, "image_id").select("*", edge("height", "ty").alias("h"), edge("width", "tx").alias("w"))


def faults(grid: DataFrame, size: int, sized: DataFrame | None = None) -> DataFrame:
    """image_id and reason of the images that can't be stored: a pixel that is
    outside or stands twice, a tile that lacks pixels, one that lacks
    altogether, or edges above the format's. ``sized``: declared image_id,
    height, width (else as far as pixels reach)."""
    sized = shapes(grid) if sized is None else sized
    tiles = _laid_out(_packed(grid.withColumn("_v", F.lit(0.0)), "_v", size), sized, size)
    reason = F.when((F.col("unplaced") > 0) | (F.col("h") < 1) | (F.col("w") < 1), "outside").when(F.size("pixels") > F.col("places"), "duplicate").when(F.col("places") < F.col("h") * F.col("w"), "ragged").when(F.col("places") > F.col("h") * F.col("w"), "outside")
    per_tile = tiles.select("image_id", reason.alias("reason"), "ty", "tx")
    bad = per_tile.where("reason is not null").select("image_id", "reason")
    rows = F.ceil(F.col("height") / size) * F.ceil(F.col("width") / size)
    count = sized.join(per_tile.groupBy("image_id").agg(F.count("*").alias("n")), "image_id", "left")
    lacking = count.where(F.coalesce("n", F.lit(0)) < rows).select("image_id", F.lit("missing tile").alias("reason"))
    large = sized.where((F.greatest("height", "width") > MOST_EDGE) | (F.least("height", "width") < 1)).select("image_id", F.lit("size").alias("reason"))
    return bad.union(lacking).union(large).distinct()


def write(grid: DataFrame, channel: str, path: str, size: int = MOST_TILE, chunk: int = 8, sized: DataFrame | None = None) -> "TileStore":
    """Store ``channel`` of ``grid`` (image_id, y, x) under ``path``, which must
    not exist. Raises where an image is at fault and leaves no store then."""
    if not 1 <= size <= MOST_TILE:
        raise ValueError(f"tiles must be 1 to {MOST_TILE} pixels a side")
    if wrong := faults(grid, size, sized).limit(5).collect():
        raise ValueError("images can't be stored: " + ", ".join(f"{w.image_id} ({w.reason})" for w in wrong))
    spark = grid.sparkSession
    tiles = _laid_out(_packed(grid, channel, size), shapes(grid) if sized is None else sized, size)
    block = {"by": F.expr(f"ty div {chunk}"), "bx": F.expr(f"tx div {chunk}")}
    tiles = tiles.select("image_id", "ty", "tx", "h", "w", "height", "width", "values").withColumns(block)
    # A block's tiles meet in one file, in order, so that row groups hold neighbours.
    placed = tiles.repartition("image_id", "by", "bx").sortWithinPartitions("image_id", "by", "bx", "ty", "tx")
    placed.write.partitionBy("image_id", "by", "bx").parquet(f"{path}/tiles")
    stored = spark.read.parquet(f"{path}/tiles")
    manifest = stored.select("image_id", "ty", "tx", (F.col("ty") * size).alias("y"), (F.col("tx") * size).alias("x"), "h", "w", "height", "width", F.lit(size).alias("size"), F.lit(chunk).alias("chunk"), (F.size("values") * 8).cast("bigint").alias("bytes"), digest(F.col("values")).alias("sha256"))
    manifest.write.parquet(f"{path}/manifest")
    return open_store(spark, path)


@dataclass(frozen=True)
class TileStore:
    spark: SparkSession
    path: str
    size: int
    chunk: int

    @property
    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest")

    @property
    def tiles(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/tiles")

    def verified(self) -> DataFrame:
        """image_id, ty, tx, verdict of every tile that the manifest or the
        folder has: ok, missing, unexpected, size or checksum."""
        held = self.tiles.select("image_id", "ty", "tx", F.size("values").alias("n"), digest(F.col("values")).alias("now"))
        both = self.manifest.join(held, ["image_id", "ty", "tx"], "full_outer")
        verdict = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("n") != F.col("h") * F.col("w"), "size").when(F.col("now") != F.col("sha256"), "checksum").otherwise("ok")
        return both.select("image_id", "ty", "tx", verdict.alias("verdict"))

    def _refusal(self) -> Column:
        """Why a region (y, x, h, w) of a grid (height, width) isn't read."""
        outside = (F.least("y", "x") < 0) | (F.least("h", "w") < 1) | (F.col("y") + F.col("h") > F.col("height")) | (F.col("x") + F.col("w") > F.col("width"))
        return F.when(F.col("height").isNull(), "unknown image").when(F.coalesce(outside, F.lit(True)), "outside").when(F.col("h") * F.col("w") * 8 > MOST_REGION_BYTES, "too large")

    def _pixels(self, tiles: DataFrame, more: list[str]) -> DataFrame:
        """The tiles' pixels inside y0, x0, h0, w0: only rows of the tile that
        the region meets are unpacked."""
        top = F.greatest("y0", F.col("ty") * self.size)
        bottom = F.least(F.col("y0") + F.col("h0"), F.col("ty") * self.size + F.col("h")) - 1
        rows = tiles.withColumn("y", F.explode(F.sequence(top, bottom)))
        left = F.greatest("x0", F.col("tx") * self.size)
        width = F.least(F.col("x0") + F.col("w0"), F.col("tx") * self.size + F.col("w")) - left
        start = (F.col("y") - F.col("ty") * self.size) * F.col("w") + left - F.col("tx") * self.size + 1
        cut = rows.select(*more, "y", left.alias("_left"), F.posexplode(F.slice("values", start.cast("int"), width.cast("int"))).alias("_i", "v"))
        return cut.select(*more, "y", (F.col("_left") + F.col("_i")).alias("x"), "v")

    def read_region(self, image_id: int, y: int, x: int, height: int, width: int) -> DataFrame:
        """y, x, v of one region; raises for one that is outside or too large.
        The scan's partition filters name the image and the blocks that the
        region meets, its pushed filters the tiles."""
        asked = self.manifest.where(F.col("image_id") == image_id).select("height", "width").limit(1).collect()
        region = self.spark.createDataFrame([(y, x, height, width, *(asked[0] if asked else (None, None)))], "y long, x long, h long, w long, height long, width long")
        if refused := region.select(self._refusal().alias("r")).first().r:
            raise ValueError(f"region of image {image_id} is refused: {refused}")
        ty, tx = (y // self.size, (y + height - 1) // self.size), (x // self.size, (x + width - 1) // self.size)
        names = lambda t: list(range(t[0] // self.chunk, t[1] // self.chunk + 1))
        tiles = self.tiles.where((F.col("image_id") == image_id) & F.col("by").isin(names(ty)) & F.col("bx").isin(names(tx)) & F.col("ty").between(*ty) & F.col("tx").between(*tx))
        placed = tiles.withColumns({"y0": F.lit(y), "x0": F.lit(x), "h0": F.lit(height), "w0": F.lit(width)})
        return self._pixels(placed, [])

    def read_regions(self, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pixels (region, image_id, y, x, v) and verdicts (region, refusal) of
        many regions (region, image_id, y, x, h, w) in one pass: each region is
        joined with the tiles it meets by their numbers."""
        sized = self.manifest.where("ty = 0 and tx = 0").select("image_id", "height", "width")
        judged = regions.join(sized, "image_id", "left").withColumn("refusal", self._refusal())
        span = lambda at, length: F.sequence(F.expr(f"{at} div {self.size}"), F.expr(f"({at} + {length} - 1) div {self.size}"))
        good = judged.where("refusal is null").select("region", "image_id", F.col("y").alias("y0"), F.col("x").alias("x0"), F.col("h").alias("h0"), F.col("w").alias("w0"), F.explode(span("y", "h")).alias("ty"), "x", "w")
        met = good.select("region", "image_id", "y0", "x0", "h0", "w0", "ty", F.explode(span("x", "w")).alias("tx"))
        met = met.withColumns({"by": F.expr(f"ty div {self.chunk}"), "bx": F.expr(f"tx div {self.chunk}")})
        stored = self.tiles.select(F.col("image_id").cast("bigint").alias("image_id"), F.col("by").cast("bigint").alias("by"), F.col("bx").cast("bigint").alias("bx"), "ty", "tx", "h", "w", "values")
        pixels = self._pixels(stored.join(met, ["image_id", "by", "bx", "ty", "tx"]), ["region", "image_id"])
        return pixels, judged.select("region", "refusal")


def open_store(spark: SparkSession, path: str) -> TileStore:
    """The store under ``path``; raises without a manifest."""
    first = spark.read.parquet(f"{path}/manifest").select("size", "chunk").first()
    if first is None:
        raise ValueError("a store has one tile at least")
    return TileStore(spark, path, first["size"], first["chunk"])
