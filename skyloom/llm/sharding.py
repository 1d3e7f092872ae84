"""Shards by a k-d tree whose splits are distributed weighted medians.

A text is a point: logarithm of its bytes, bytes per character, logarithm of its
lines; ties are split by a content hash.  Every node is split along its widest
dimension (range relative to that of the whole table) at the weighted median of
its bytes, until there is one leaf for each shard.  A median is found by
histograms over a shrinking interval, so the driver sees at most
``BINS`` rows for each node of a level and no task sees more than a partition.
Equal texts are the same point and so share a shard: shards are as near equal as
the largest group of copies allows.

Edge cases: a null text has size 1 (no byte, plus 1) and crc32 0 and falls with
the empty text; repeated rows share a shard and have slots of their own; a null
doc_id is kept; an empty table gives an empty result.  With fewer distinct texts
than shards some shards stay empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import stored, table, text_or_empty

SHARDS = 16
#: Histogram bins of a node in one pass.
BINS = 512
#: A split is settled when its uncertain part is this share of the node.
TOLERANCE = 1e-4
#: Rows whose slots are counted in one task, on average.
SLOT_ROWS = 50_000
DIMENSIONS = ("x0", "x1", "x2")
TIE = "xh"


@dataclass
class Split:
    """Right if (dimension, hash) is above (value, tie)."""

    dimension: str
    value: float
    tie: float


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the coordinates of every row."""
    text = text_or_empty(F.col("text"))
    rows = docs.select("doc_id", text.alias("t")).select("doc_id", F.octet_length("t").cast("long").alias("b"), F.char_length("t").alias("c"), F.crc32("t").alias("text_crc32"), F.xxhash64("t").alias("h"), (F.char_length("t") - F.char_length(F.replace("t", F.lit("\n"), F.lit("")))).alias("n"))
    return rows.select(
        "doc_id",
        (F.col("b") + 1).alias("size"),
        "text_crc32",
        F.log2(F.col("b") + 1.0).alias("x0"),
        (F.col("b") / F.greatest(F.col("c"), F.lit(1))).alias("x1"),
        F.log2(F.col("n") + 1.0).alias("x2"),
        F.col("h").cast("double").alias("xh"),
    )


def _node(splits: dict[int, Split], levels: int) -> Column:
    """Number of the node (root 1, children 2n and 2n+1) that a row is in."""

    def below(n: int, depth: int) -> Column:
        if depth == levels or n not in splits:
            return F.lit(n)
        s = splits[n]
        right = (F.col(s.dimension) > s.value) | ((F.col(s.dimension) == s.value) & (F.col(TIE) > s.tie))
        return F.when(right, below(2 * n + 1, depth + 1)).otherwise(below(2 * n, depth + 1))

    return below(1, 0)


def _by_node(values: dict[int, object]) -> Column:
    out = None
    for n, v in values.items():
        out = F.when(F.col("node") == n, v) if out is None else out.when(F.col("node") == n, v)
    return out


def _search(rows: DataFrame, nodes: dict[int, dict], key: str) -> None:
    """Narrow, for every node, the interval [lo, hi] of its key that holds the weighted median.

    A node has dimension, lo, hi, before (weight below lo), goal, and within
    (condition for its rows, or None).  Ends with ``below``: the largest value that
    goes left, or with lo == hi: the value that holds the median by itself.
    """
    open_nodes = dict(nodes)
    while open_nodes:
        x = _by_node({n: F.col(v[key]) for n, v in open_nodes.items()})
        lo, hi = _by_node({n: F.lit(v["lo"]) for n, v in open_nodes.items()}), _by_node({n: F.lit(v["hi"]) for n, v in open_nodes.items()})
        inside = rows.where(F.col("node").isin(*open_nodes))
        only = [v["within"] for v in open_nodes.values() if v.get("within") is not None]
        if only:
            inside = inside.where(_by_node({n: v["within"] for n, v in open_nodes.items()}))
        inside = inside.withColumn("x", x).where((F.col("x") >= lo) & (F.col("x") <= hi))
        bins = inside.withColumn("bin", F.least(F.lit(BINS - 1), F.floor((F.col("x") - lo) / F.greatest(hi - lo, F.lit(1e-300)) * BINS)))
        found = bins.groupBy("node", "bin").agg(F.sum("size").alias("w"), F.min("x").alias("a"), F.max("x").alias("b")).collect()
        for n in list(open_nodes):
            v = open_nodes[n]
            mine = sorted((r["bin"], r["w"], r["a"], r["b"]) for r in found if r["node"] == n)
            at, below = v["before"], None
            for i, (_, w, a, b) in enumerate(mine):
                if at + w >= v["goal"] or i == len(mine) - 1:
                    v |= {"lo": a, "hi": b, "before": at, "inner": w, "under": below}
                    break
                at, below = at + w, b
            if v["lo"] == v["hi"] or v["inner"] <= TOLERANCE * v["total"]:
                del open_nodes[n]


def build(rows: DataFrame, shards: int) -> tuple[dict[int, Split], dict[int, int]]:
    """Splits, and the shard of every leaf node."""
    spread = rows.agg(*[F.max(d).alias(f"a{d}") for d in DIMENSIONS], *[F.min(d).alias(f"b{d}") for d in DIMENSIONS]).first()
    whole = {d: max((spread[f"a{d}"] or 0.0) - (spread[f"b{d}"] or 0.0), 1e-12) for d in DIMENSIONS}
    splits, parts, level = {}, {1: (0, shards)}, 0
    while any(k > 1 for _, k in parts.values()):
        # written, so that the node is a plain column in the passes below
        placed = stored(rows.withColumn("node", _node(splits, level)), "shard-level") if level else rows.withColumn("node", F.lit(1))
        stats = placed.groupBy("node").agg(F.sum("size").alias("w"), *[F.min(c).alias(f"lo_{c}") for c in (*DIMENSIONS, TIE)], *[F.max(c).alias(f"hi_{c}") for c in (*DIMENSIONS, TIE)]).collect()
        nodes = {}
        for s in stats:
            first, k = parts[s["node"]]
            if k > 1:
                d = max(DIMENSIONS, key=lambda c: ((s[f"hi_{c}"] - s[f"lo_{c}"]) / whole[c], c))
                if s[f"hi_{d}"] == s[f"lo_{d}"]:
                    d = TIE
                nodes[s["node"]] = {"dimension": d, "lo": s[f"lo_{d}"], "hi": s[f"hi_{d}"], "before": 0, "goal": s["w"] * (k // 2) / k, "total": s["w"], "tie": TIE}
        _search(placed, nodes, "dimension")
        again = {}
        for n, v in nodes.items():
            take = v["before"] + v["inner"]
            if v["lo"] == v["hi"] and v["inner"] > TOLERANCE * v["total"] and v["dimension"] != TIE:
                again[n] = {"dimension": v["dimension"], "tie": TIE, "lo": -(2.0**63), "hi": 2.0**63, "before": v["before"], "goal": v["goal"], "total": v["total"], "within": F.col(v["dimension"]) == v["lo"], "at": v["lo"]}
            elif v["under"] is not None and v["goal"] - v["before"] < take - v["goal"]:
                splits[n] = Split(v["dimension"], v["under"], float("inf"))
            else:
                splits[n] = Split(v["dimension"], v["hi"], float("inf"))
        _search(placed, again, "tie")
        for n, v in again.items():
            if v["goal"] - v["before"] < v["before"] + v["inner"] - v["goal"]:
                splits[n] = Split(v["dimension"], v["at"], v["under"] if v["under"] is not None else float("-inf"))
            else:
                splits[n] = Split(v["dimension"], v["at"], v["hi"])
        parts = {m: p for n, (first, k) in parts.items() for m, p in (((2 * n, (first, k // 2)), (2 * n + 1, (first + k // 2, k - k // 2))) if n in splits and k > 1 else ((n, (first, 1)),))}
        level += 1
    return splits, {n: first for n, (first, _) in parts.items()}


def with_slots(rows: DataFrame, n_rows: int) -> DataFrame:
    """A slot for every row, gapless from 0 in its shard, without one task for a shard."""
    from pyspark.sql import Window

    parts = max(1, -(-n_rows // SLOT_ROWS))
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)))
    own = Window.partitionBy("shard", "deal").orderBy("doc_id", "text_crc32", "size")
    counts = dealt.groupBy("shard", "deal").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = dealt.withColumn("place", F.row_number().over(own) - 1)
    return numbered.join(offsets, ["shard", "deal"]).withColumn("slot", (F.col("place") + F.col("skip")).cast("long")).drop("place", "skip", "deal")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    rows = stored(points(docs), "shard-points")
    splits, leaves = build(rows, shards)
    node = rows.withColumn("node", _node(splits, 99)).withColumn("shard", _by_node({n: F.lit(s) for n, s in leaves.items()}).cast("int"))
    return with_slots(node.select("doc_id", "size", "text_crc32", "shard"), rows.count())


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = shard(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
