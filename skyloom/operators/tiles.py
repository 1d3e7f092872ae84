"""Output tiles: regular grids, aligned splits, and quadtrees by mask density."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tile_specs(spark: SparkSession, height: int, width: int, size: int) -> DataFrame:
    """r, c, h, w of the tiles, clipped at the edges."""
    rows = spark.range(0, height, size).select(F.col("id").alias("r"))
    cols = spark.range(0, width, size).select(F.col("id").alias("c"))
    both = rows.crossJoin(F.broadcast(cols))  # one row for each tile of the result
    return both.select("r", "c", F.least(F.lit(size), F.lit(height) - F.col("r")).alias("h"), F.least(F.lit(size), F.lit(width) - F.col("c")).alias("w"))


def tile_of(row: Column, col: Column, size: int) -> tuple[Column, Column]:
    return row - row % size, col - col % size


def split_at(length: Column, least: int) -> Column:
    """First part of an aligned split: near the middle, a multiple of ``least``; the
    whole length if it is no longer than that."""
    middle = F.bround(length / F.lit(2.0) / F.lit(float(least))).cast("bigint") * least
    first = F.least(F.greatest(middle, F.lit(least).cast("bigint")), length.cast("bigint"))
    return F.when(length <= least, length.cast("bigint")).otherwise(first)


def split_length(length: int, least: int) -> list[int]:
    """The same on the driver."""
    if length <= least:
        return [length]
    first = min(max(least * round(length / 2 / least), least), length)
    return [first, length - first] if length > first else [first]


def adaptive_tiles(mask: DataFrame, height: int, width: int, size: int, least: int, row: str = "row", col: str = "col", full: float = 0.75) -> DataFrame:
    """Tiles of a quadtree: empty ones dropped, dense or small ones kept, others split.

    ``mask``: distinct pixels that are set.  They are counted in blocks once (a few
    rows for a raster, kept); levels, bounded by the tile sizes, add up blocks.
    """
    spark = mask.sparkSession
    open_tiles = tile_specs(spark, height, width, size)
    kept = None
    # all tile edges are multiples of this, so blocks stand for their pixels in every level
    unit = math.gcd(size, least)
    br, bc = tile_of(F.col(row), F.col(col), unit)
    blocks = mask.groupBy(br.alias("row"), bc.alias("col")).agg(F.count(F.lit(1)).alias("m")).persist()
    tr, tc = tile_of(F.col("row"), F.col("col"), size)
    placed = blocks.withColumn("r", tr).withColumn("c", tc)
    side = size
    while True:
        counts = placed.groupBy("r", "c").agg(F.sum("m").alias("set"))
        level = open_tiles.join(counts, ["r", "c"])
        done = (F.col("set") / (F.col("h") * F.col("w")) >= full) | ((F.col("h") <= least) & (F.col("w") <= least))
        chosen = level.where(done).select("r", "c", "h", "w")
        kept = chosen if kept is None else kept.union(chosen)
        if side <= least:
            return kept
        rest = level.where(~done).select("r", "c", "h", "w", split_at(F.col("h"), least).alias("h0"), split_at(F.col("w"), least).alias("w0"))
        quads = [("r", "c", "h0", "w0"), ("r", "c + w0", "h0", "w - w0"), ("r + h0", "c", "h - h0", "w0"), ("r + h0", "c + w0", "h - h0", "w - w0")]
        parts = F.array(*[F.struct(*[F.expr(e).cast("bigint").alias(n) for e, n in zip(q, "rchw", strict=True)]) for q in quads])
        children = rest.select(F.explode(parts).alias("q")).select("q.r", "q.c", "q.h", "q.w").where("h > 0 and w > 0")
        split = placed.join(rest, ["r", "c"])
        right_r, right_c = F.col("row") >= F.col("r") + F.col("h0"), F.col("col") >= F.col("c") + F.col("w0")
        placed = split.select("row", "col", "m", F.when(right_r, F.col("r") + F.col("h0")).otherwise(F.col("r")).alias("r"), F.when(right_c, F.col("c") + F.col("w0")).otherwise(F.col("c")).alias("c"))
        open_tiles = children
        side = max(x for n in {side} for x in split_length(n, least))


def contribution(mask: DataFrame, size: int, row: str = "row", col: str = "col") -> DataFrame:
    """Share of each tile's pixels that any scene sets (tiles of full size)."""
    r, c = tile_of(F.col(row), F.col(col), size)
    seen = mask.select(row, col).distinct()
    return seen.groupBy(r.alias("r"), c.alias("c")).agg((F.count(F.lit(1)).cast("double") / F.lit(float(size * size))).alias("share"))


def expected_reads(obs: DataFrame, size: int, bands: int, scene: str = "scene", row: str = "row", col: str = "col") -> DataFrame:
    """Tiles times contributing scenes times bands."""
    r, c = tile_of(F.col(row), F.col(col), size)
    pairs = obs.select(r.alias("r"), c.alias("c"), scene).distinct()
    return pairs.agg((F.count(F.lit(1)) * bands).alias("reads"))


def source_blocks(windows: DataFrame, block: int) -> DataFrame:
    """How many source blocks the windows (r, c, h, w) touch."""
    rows = F.explode(F.sequence(F.floor(F.col("r") / block), F.floor((F.col("r") + F.col("h") - 1) / block)))
    cols = F.explode(F.sequence(F.floor(F.col("c") / block), F.floor((F.col("c") + F.col("w") - 1) / block)))
    touched = windows.select("*", rows.alias("br")).select("br", cols.alias("bc")).distinct()
    return touched.agg(F.count(F.lit(1)).alias("blocks"))


def meeting_windows(specs: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """The tiles (r, c, h, w) with every window (r0, c0, r1, c1, half open, and other columns) that overlaps them.

    Windows are spread to the tile keys that they cover, so the join is on keys.
    """
    keys = lambda low, high: F.sequence(F.expr(f"{low} div {size}"), F.expr(f"({high} - 1) div {size}"))
    spread = windows.where("r0 < r1 and c0 < c1").withColumn("tr", F.explode(keys("r0", "r1"))).withColumn("tc", F.explode(keys("c0", "c1")))
    placed = specs.withColumn("tr", F.expr(f"r div {size}")).withColumn("tc", F.expr(f"c div {size}"))
    meets = "r0 < r + h and r1 > r and c0 < c + w and c1 > c"
    return placed.join(spread, ["tr", "tc"]).where(meets).drop("tr", "tc")


def sampled(rows: DataFrame, most: int, order: list[str]) -> DataFrame:
    """Every n-th row in an order, at most ``most``, the first among them."""
    total = rows.count()
    step = max(1, -(-total // most))
    numbered = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order)) - 1)  # a catalogue: one narrow row a scene
    return numbered.where(F.col("_n") % step == 0).drop("_n")


def sparse_reads_pay(specs: DataFrame, windows: DataFrame, block: int, share: float = 0.75) -> bool:
    """Whether reading only the given tiles touches less than ``share`` of the source blocks that whole windows touch."""
    own = windows.select("r0", "c0", "r1", "c1", F.monotonically_increasing_id().alias("_w"))
    size = specs.agg(F.max("h"), F.max("w")).first()
    if size[0] is None:
        return False
    parts = meeting_windows(specs, own, max(size))
    inner = parts.select("_w", F.greatest("r", "r0").alias("a"), F.greatest("c", "c0").alias("b"), F.least(F.col("r") + F.col("h"), "r1").alias("y"), F.least(F.col("c") + F.col("w"), "c1").alias("x"))
    blocks = lambda low, high: F.explode(F.sequence(F.expr(f"{low} div {block}"), F.expr(f"({high} - 1) div {block}")))
    touched = inner.withColumn("br", blocks("a", "y")).withColumn("bc", blocks("b", "x")).select("_w", "br", "bc").distinct().count()
    whole = own.agg(F.sum(F.expr(f"((r1 - 1) div {block} - r0 div {block} + 1) * ((c1 - 1) div {block} - c0 div {block} + 1)"))).first()[0] or 0
    return touched < share * whole
