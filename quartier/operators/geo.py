"""Spatial operators: rasters, nearest centroids, zone lookup and zone summaries."""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import OneHotEncoder
from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartier.operators.lookup import bounded
from quartier.operators.quantiles import bucket_of, quantiles
from quartier.operators.state import Configured, FitStep
from quartier.session import checkpointed, ship_package

MAX_CENTROIDS = 1_000
MAX_ZONES = 10_000
MAX_CELLS = 1 << 18
START_POSITIONS = 8_192


def raster_grid(df: DataFrame, x: str, y: str, n: int, pad: float = 0.03) -> DataFrame:
    """(i, j, x, y): an n-by-n raster over the value range, padded on every side."""
    b = df.agg(
        F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1")
    )

    def at(index: str, low: str, high: str):
        margin = (F.col(high) - F.col(low)) * pad
        step = (F.col(high) - F.col(low) + 2 * margin) / (n - 1)
        return F.col(low) - margin + F.col(index) * step

    cells = df.sparkSession.range(n * n).select(
        F.floor(F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j")
    )
    return cells.crossJoin(F.broadcast(b)).select(  # one row of bounds
        "i", "j", at("i", "_x0", "_x1").alias(x), at("j", "_y0", "_y1").alias(y)
    )


def assign_nearest(df: DataFrame, centroids: DataFrame, cols: list[str], out: str = "cluster") -> DataFrame:
    """Nearest centroid (ties: lowest id). Centroids travel as one array, rows are not multiplied."""
    local = bounded(centroids.select("cluster", *cols), MAX_CENTROIDS)
    if local is None:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    packed = local.agg(
        F.collect_list(F.struct("cluster", *[F.col(c).alias(f"_{c}") for c in cols])).alias("_centroids")
    )

    def distance(c):
        return sum((F.pow(F.col(name) - c[f"_{name}"], F.lit(2.0)) for name in cols), F.lit(0.0))

    ranked = F.transform("_centroids", lambda c: F.struct(distance(c).alias("d"), c["cluster"].alias("c")))
    found = df.crossJoin(F.broadcast(packed)).withColumn(out, F.array_min(ranked)["c"])
    complete = F.lit(True)
    for name in cols:
        complete = complete & F.col(name).isNotNull()
    return found.withColumn(out, F.when(complete, F.col(out))).drop("_centroids")


def assign_zone(
    df: DataFrame, zones: DataFrame, x: str, y: str, carry: list[str], names: tuple[str, str] = ("lat", "lon")
) -> DataFrame:
    """Add ``carry`` of the zone (half-open boxes ``(lo, hi]``) each point lies in, else NULL.

    The zone edges cut the plane into cells. Each point finds its cell by binary search and
    the cell's zone by an equi-join, so no row is compared with every zone. Where that would make
    more than ``MAX_CELLS`` cells, zones are cut along ``x`` only, into few strips of power-of-two
    length: a point looks its strip of each length up and searches the zones there by ``y``. Zones
    don't overlap.
    """
    a, b = names
    edges = [f"{a}_lo", f"{a}_hi", f"{b}_lo", f"{b}_hi"]
    local = bounded(zones.select(*edges, *carry), MAX_ZONES)
    if local is None:
        raise ValueError(f"more than {MAX_ZONES} zones")
    boxes = local.collect()
    xs = sorted({v for r in boxes for v in (r[edges[0]], r[edges[1]])})
    ys = sorted({v for r in boxes for v in (r[edges[2]], r[edges[3]])})
    fields = ", ".join(f"`{c}` {local.schema[c].dataType.simpleString()}" for c in carry)

    def index(col: str, cuts: list[float]):
        size = 1 << max(len(cuts), 1).bit_length()
        array = F.array(*[F.lit(float(v)) for v in cuts])
        return F.when(F.col(col).isNotNull(), bucket_of(F.col(col), array, size))

    spans = [(bisect_left(xs, r[edges[0]]) + 1, bisect_left(xs, r[edges[1]])) for r in boxes]
    heights = [bisect_left(ys, r[edges[3]]) - bisect_left(ys, r[edges[2]]) for r in boxes]
    if sum((b - a + 1) * h for (a, b), h in zip(spans, heights)) > MAX_CELLS:
        return _by_strips(df.withColumn("_i", index(x, xs)), boxes, spans, edges[2:], y, carry, fields).drop("_i")
    cells = [
        (i, j, *[r[c] for c in carry])
        for r in boxes
        for i in range(bisect_left(xs, r[edges[0]]) + 1, bisect_left(xs, r[edges[1]]) + 1)
        for j in range(bisect_left(ys, r[edges[2]]) + 1, bisect_left(ys, r[edges[3]]) + 1)
    ]
    spark = df.sparkSession
    table = spark.createDataFrame(cells, f"_i int, _j int, {fields}")
    placed = df.withColumns({"_i": index(x, xs), "_j": index(y, ys)})
    # At most MAX_CELLS cells.
    return placed.join(F.broadcast(table), ["_i", "_j"], "left").drop("_i", "_j")


def _by_strips(df: DataFrame, boxes: list, spans: list, edges: list[str], y: str, carry: list[str], fields: str) -> DataFrame:
    """Zones by strips of 2^level x-cells: a zone lies in at most two strips of a length, a cell in one."""
    strips: dict[tuple[int, int], list] = {}
    for box, (a, b) in zip(boxes, spans):
        level = 0
        while a <= b:
            if a & 1:
                strips.setdefault((level, a), []).append(box)
                a += 1
            if not b & 1:
                strips.setdefault((level, b), []).append(box)
                b -= 1
            a, b, level = a >> 1, b >> 1, level + 1
    low, high = edges
    found = []
    for level in sorted({level for level, _ in strips}):
        rows = []
        for (at, strip), zones in strips.items():
            if at == level:
                zones = sorted(zones, key=lambda z: z[high])
                rows.append((strip, [z[low] for z in zones], [z[high] for z in zones], [tuple(z[c] for c in carry) for z in zones]))
        size = 1 << max(len(r[1]) for r in rows).bit_length()
        schema = f"_strip int, _low array<double>, _high array<double>, _zones array<struct<{fields.replace('` ', '`: ')}>>"
        table = df.sparkSession.createDataFrame(rows, schema)
        key = F.shiftright("_i", level)
        # At most two rows a zone and level.
        df = df.join(F.broadcast(table), key == F.col("_strip"), "left")
        place = bucket_of(F.col(y), F.col("_high"), size)
        inside = F.col(y).isNotNull() & (F.get("_low", place) < F.col(y))
        df = df.withColumn(f"_zone{level}", F.when(inside, F.get("_zones", place))).drop("_strip", "_low", "_high", "_zones")
        found.append(f"_zone{level}")
    zone = F.coalesce(*found)
    return df.withColumns({c: zone[c] for c in carry}).drop(*found)


def zone_summary(df: DataFrame, zone: str, value: str, x: str, y: str, **kw) -> DataFrame:
    """Rows, median, mean, sample std and centroid per zone."""
    stats = quantiles(
        df, value, [0.5], [zone], "_q",
        [
            F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
            F.avg(x).alias(f"{x}_mean"), F.avg(y).alias(f"{y}_mean"),
        ],
        **kw,
    )
    return stats.withColumn("median", F.get("_q", F.lit(0))).drop("_q")


def best_split(df: DataFrame, x: str, y: str, bins: int, min_rows: int) -> DataFrame:
    """The binary split of ``x`` that most reduces the squared error of ``y``, over equal-width bins.

    One row (bin, threshold, n_left, n_right, gain); prefix sums run over at most ``bins`` rows.
    """
    df = df.select(x, y).dropna()
    bounds = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    index = F.least(F.floor((F.col(x) - F.col("_lo")) / width * bins), F.lit(bins - 1)).cast("int")
    sums = (
        df.crossJoin(F.broadcast(bounds)).where(width > 0)
        .groupBy("_lo", "_hi", index.alias("bin"))
        .agg(F.count("*").alias("_n"), F.sum(y).alias("_s"))
    )
    upto, everything = Window.partitionBy().orderBy("bin"), Window.partitionBy()
    prefix = sums.select(
        "bin", "_lo", "_hi",
        F.sum("_n").over(upto).alias("n_left"), F.sum("_s").over(upto).alias("_sl"),
        F.sum("_n").over(everything).alias("_n"), F.sum("_s").over(everything).alias("_s"),
    ).withColumn("n_right", F.col("_n") - F.col("n_left"))
    fits = (F.col("n_left") >= min_rows) & (F.col("n_right") >= min_rows)
    right = F.col("_s") - F.col("_sl")
    gain = (
        F.col("_sl") * F.col("_sl") / F.col("n_left") + right * right / F.col("n_right")
        - F.col("_s") * F.col("_s") / F.col("_n")
    )
    scored = prefix.where(fits).select(
        "bin", (F.col("_lo") + (F.col("bin") + 1) * width / bins).alias("threshold"), "n_left", "n_right",
        gain.alias("gain"),
    )
    return scored.orderBy(F.desc("gain"), "bin").limit(1)


class MissingSlot(Configured, Transformer):
    """Rows that lack one of ``cols`` get the label ``slot``: ``MissingSlot(cols=, label=, slot=)``."""

    def _transform(self, df: DataFrame) -> DataFrame:
        c = self.conf
        lacks = reduce(or_, [F.col(x).isNull() | F.isnan(F.col(x).cast("double")) for x in c["cols"]])
        return df.withColumn(c["label"], F.when(lacks, F.lit(c["slot"])).otherwise(F.col(c["label"])))


def kmeans_restarts(
    df: DataFrame, cols: list[str], k: int, restarts: int, seed: int = 0, max_iter: int = 20, tol: float = 1e-4
) -> tuple[list[list[float]], float]:
    """(centres, cost) of the best of several Lloyd runs; an iteration is one job for all of them.

    Rows are counted by position once. Each run starts from a weighted k-means++ draw over at most ``START_POSITIONS``
    positions of smallest hash; the iterations see every row. Tasks add up counts, sums and costs by (run, cluster), and
    only these sums move, whatever the number of rows. A run ends when no centre moves by more than ``tol``; a cluster
    left without rows keeps its centre. Fewer positions than ``k`` give that many centres; none raises ``ValueError``.
    """
    values = [F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)]
    names = [f"_{i}" for i in range(len(cols))]
    known = df.select(*values).dropna()
    positions = checkpointed(known.groupBy(*names).agg(F.count("*").cast("double").alias("_w")))
    start = positions.orderBy(F.xxhash64(*names), *names).limit(START_POSITIONS).collect()
    if not start:
        raise ValueError(f"no row has all of {cols}")
    table = np.array([tuple(r) for r in start], np.float64)
    k = min(k, len(table))
    centres = np.stack([_spread_start(table[:, :-1], table[:, -1], k, np.random.default_rng([seed, i])) for i in range(restarts)])
    moving, cost = np.ones(restarts, bool), np.full(restarts, np.inf)
    for step in range(max_iter + 1):
        todo = np.flatnonzero(moving)
        if not len(todo):
            break
        counts, sums, spent = _lloyd_sums(positions, names, centres[todo])
        cost[todo] = spent
        if step == max_iter:
            break
        moved = np.where(counts[..., None] > 0, sums / np.maximum(counts, 1)[..., None], centres[todo])
        far = ((moved - centres[todo]) ** 2).sum(axis=2).max(axis=1)
        # The cost belongs to the centres it was measured with.
        going = far > tol * tol
        centres[todo[going]] = moved[going]
        moving[todo[~going]] = False
    best = int(cost.argmin())
    return centres[best].tolist(), float(cost[best])


def _spread_start(points: np.ndarray, weights: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """k-means++: each centre is drawn by its weighted squared distance to those before."""
    chosen = [int(draw.choice(len(points), p=weights / weights.sum()))]
    apart = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        share = weights * apart
        if not share.sum() > 0:  # what is left is too near to tell apart
            share = np.where(np.isin(np.arange(len(points)), chosen), 0.0, weights)
        chosen.append(int(draw.choice(len(points), p=share / share.sum())))
        apart = np.minimum(apart, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen].copy()


def _lloyd_sums(positions: DataFrame, names: list[str], centres: np.ndarray):
    """Rows, sums of coordinates and squared distance by (run, cluster), added up by Spark."""
    runs, k, width = centres.shape
    shape = (runs, k, width + 2)

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            block = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (*names, "_w")])
            for a in range(0, len(block), 8192):
                x, w = block[a : a + 8192, :-1], block[a : a + 8192, -1]
                for i in range(runs):
                    apart = sum((x[:, d, None] - centres[i, :, d]) ** 2 for d in range(width))
                    near = apart.argmin(axis=1)
                    parts = [w, *(w * x[:, d] for d in range(width)), w * apart.min(axis=1)]
                    total[i] += np.stack([np.bincount(near, part, k) for part in parts], axis=1)
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["slot", "value"])

    ship_package(positions.sparkSession)
    added = positions.mapInArrow(run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value"))
    found = np.zeros(runs * k * (width + 2))
    for r in added.collect():  # one row a slot
        found[r["slot"]] = r["value"]
    found = found.reshape(shape)
    return found[..., 0], found[..., 1:-1], found[..., -1].sum(axis=1)


class NearestCentre(Configured, Transformer):
    """Number of the nearest of fixed centres, NULL without a place: ``NearestCentre(cols=, centres=, out=)``."""

    def _transform(self, df: DataFrame) -> DataFrame:
        c = self.conf
        fields = ", ".join(f"`{name}` double" for name in c["cols"])
        rows = [(i, *centre) for i, centre in enumerate(c["centres"])]
        centres = df.sparkSession.createDataFrame(rows, f"cluster int, {fields}")
        return assign_nearest(df, centres, c["cols"], c["out"])


class GeoKMeans(FitStep):
    """Best of several KMeans restarts on coordinates, as a one-hot vector column ``out``.

    Rows without a place are cluster ``k`` and have the last slot of the vector, next to the clusters' own.

    ``GeoKMeans(cols=[x, y], k=8, restarts=10, seed=0, out="geo")``
    """

    DEFAULTS = {"k": 8, "restarts": 10, "seed": 0, "out": "geo_km"}

    def _fit(self, df: DataFrame) -> PipelineModel:
        c = self.conf
        out = c["out"]
        places = df.select(*[F.when(~F.isnan(F.col(x).cast("double")), F.col(x)).alias(x) for x in c["cols"]])
        centres, _ = kmeans_restarts(places, c["cols"], c["k"], c["restarts"], c["seed"])
        nearest = NearestCentre(cols=c["cols"], centres=centres, out=f"{out}_cluster")
        hot = OneHotEncoder(inputCols=[f"{out}_cluster"], outputCols=[out], dropLast=False, handleInvalid="keep")
        known = df.sparkSession.createDataFrame([(i,) for i in range(c["k"])], f"{out}_cluster int")
        missing = MissingSlot(cols=c["cols"], label=f"{out}_cluster", slot=c["k"])
        return PipelineModel(stages=[nearest, missing, hot.fit(known)])
