"""Scene tables from STAC item collections in JSON (files or folders of them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog

_ITEM = "struct<id: string, bbox: array<double>, geometry: struct<type: string, coordinates: string>, properties: map<string, string>, assets: map<string, struct<href: string, `proj:transform`: array<double>>>>"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature: id, bbox, geometry, props and assets.

    ``path`` has item collections, or newline-separated items.
    """
    text = spark.read.text(path, wholetext=True)
    whole = text.select(F.from_json("value", f"struct<features: array<{_ITEM}>>").alias("c"), "value")
    items = whole.where("c.features is not null").select(F.explode("c.features").alias("i"))
    lines = whole.where("c.features is null").select(F.explode(F.split("value", "\n")).alias("l")).where("trim(l) != ''").select(F.from_json("l", _ITEM).alias("i"))
    return items.union(lines).select("i.id", "i.bbox", "i.geometry", F.col("i.properties").alias("props"), "i.assets")


def scenes(items: DataFrame) -> DataFrame:
    """The columns that search and order need, with the documented fallbacks."""
    p = lambda key: F.try_element_at("props", F.lit(key))
    product = F.coalesce(p("s2:product_uri"), p("s2:product_id"))
    rows = items.select(
        F.col("id").alias("scene_id"),
        catalog.tile(p("s2:mgrs_tile"), p("grid:code")).alias("tile"),
        F.to_timestamp(p("datetime")).alias("datetime"),
        *[F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))],
        catalog.orbit(p("sat:relative_orbit"), product).alias("orbit"),
        *[F.coalesce(p(k).try_cast("double"), F.lit(0.0)).alias(c) for k, c in (("s2:nodata_pixel_percentage", "nodata"), ("s2:high_proba_clouds_percentage", "cloud"), ("s2:cloud_shadow_percentage", "shadow"))],
        p("s2:processing_baseline").alias("baseline"),
        F.coalesce(p("proj:epsg"), F.substring_index(p("proj:code"), ":", -1)).try_cast("int").alias("epsg"),
        F.filter(F.transform(F.map_values("assets"), lambda a: a["proj:transform"]), lambda t: t.isNotNull()).alias("t"),
        "props",
        "geometry",
        F.transform_values("assets", lambda _, a: a["href"]).alias("hrefs"),
    )
    first = F.get("t", F.lit(0))
    return rows.withColumn("origin_x", F.get(first, F.lit(2))).withColumn("origin_y", F.get(first, F.lit(5))).drop("t")


def where_properties(scene_table: DataFrame, query: dict[str, dict]) -> DataFrame:
    """Scenes whose properties pass a query."""
    return scene_table.where(catalog.property_filter(query, lambda name: F.try_element_at("props", F.lit(name))))
