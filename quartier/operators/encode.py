"""Category encodings: one-hot, dummies, out-of-fold and ordered target statistics."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartier.functions.text import hash_number
from quartier.operators.groupings import unpivot_levels
from quartier.operators.lookup import bounded, lookup
from quartier.operators.state import FitStep, FittedStep, keep_table, lookup_kept

MAX_DUMMY_COLUMNS = 10_000


class OneHotLong(FitStep):
    """One-hot in long form, ``OneHotLong(key=, cols=[...])``: an unseen level yields no row."""

    DEFAULTS = {"label": "MISSING"}

    def _fit(self, df: DataFrame) -> OneHotLongModel:
        c = self.conf
        levels = unpivot_levels(df, c["cols"], [], c["label"]).distinct()
        return OneHotLongModel({"levels": keep_table(levels.withColumn("value", F.lit(1)), "levels")}, **c)


class OneHotLongModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        c = self.conf
        long = unpivot_levels(df, c["cols"], [c["key"]], c["label"])
        return lookup_kept(long, self.state["levels"], ["feature", "level"]).where(F.col("value") == 1)


def onehot_stages(cols: list[str]) -> list:
    """Vector one-hot; NULL and unseen levels give the all-zero vector. Outputs ``<col>_ohe``."""
    index = StringIndexer(
        inputCols=cols, outputCols=[f"{c}_idx" for c in cols], handleInvalid="keep",
        stringOrderType="frequencyDesc",
    )
    hot = OneHotEncoder(
        inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}_ohe" for c in cols], dropLast=True
    )
    return [index, hot]


def dummies(df: DataFrame, col: str) -> DataFrame:
    """One 0/1 double column ``<col>_<level>`` per level seen anywhere in ``df``."""
    levels = bounded(df.select(F.col(col).cast("string").alias("level")).dropna().distinct(), MAX_DUMMY_COLUMNS)
    if levels is None:
        raise ValueError(f"{col} has too many levels for columns; use the long one-hot")
    names = sorted(r["level"] for r in levels.collect())
    text = F.col(col).cast("string")
    return df.select(
        "*", *[F.coalesce((text == n).cast("double"), F.lit(0.0)).alias(f"{col}_{n}") for n in names]
    )


def oof_target_mean(df: DataFrame, cat: list[str], y: str, fold: str, out: str) -> DataFrame:
    """Mean of ``y`` per category learnt on the other folds only, in one aggregation.

    A category without rows in the other folds, and a missing one, gets their overall mean.
    """
    sums = df.groupBy(*cat, fold).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    local = bounded(sums)
    size = None if local is None else 0  # a local relation is small already
    sums = sums if local is None else local

    def complement(w):
        return F.try_divide(F.sum("_s").over(w) - F.col("_s"), F.sum("_n").over(w) - F.col("_n"))

    # At most one row per fold in either window.
    by_cat = sums.dropna(subset=cat).withColumn(out, complement(Window.partitionBy(*cat)))
    folds = sums.groupBy(fold).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    overall = folds.withColumn("_overall", complement(Window.partitionBy()))
    found = lookup(df, by_cat.select(*cat, fold, out), [*cat, fold], size=size)
    found = lookup(found, overall.select(fold, "_overall"), [fold], size=size)
    return found.withColumn(out, F.coalesce(out, "_overall")).select(*df.columns, out)


def ordered_target_stat(
    df: DataFrame, cat: str, y: str, key: str, prior_weight: float, out: str,
    seed: int = 0, buckets: int = 4096, label: str = "MISSING",
) -> DataFrame:
    """Smoothed mean of ``y`` over the rows of the same category that precede in a hashed order.

    The hash spreads rows evenly, so a hot category is cut into ``buckets`` slices that are
    summed separately: slice totals give the offset, a window inside the slice the rest.
    """
    level = F.coalesce(F.col(cat).cast("string"), F.lit(label))
    order = hash_number(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    placed = df.withColumns({"_c": level, "_h": order}).withColumn(
        "_b", F.shiftright("_h", 32 - buckets.bit_length() + 1).cast("int")
    )
    before = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_c", "_b")
        .agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
        .select(
            "_c", "_b",
            F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        )
    )
    mean = df.agg(F.avg(y).alias("_mean"))
    inside = Window.partitionBy("_c", "_b").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_s0") + F.coalesce(F.sum(y).over(inside), F.lit(0.0))
    count = F.col("_n0") + F.count(y).over(inside)
    joined = placed.join(offsets, ["_c", "_b"]).crossJoin(F.broadcast(mean))  # one row
    stat = (total + F.lit(prior_weight) * F.col("_mean")) / (count + F.lit(prior_weight))
    return joined.withColumn(out, stat).select(*df.columns, out)


def ordered_fold_stats(
    df: DataFrame, cat: str, y: str, key: str, prior_weight: float, out: str, fold: str, k: int,
    seed: int = 0, buckets: int = 4096, label: str = "MISSING",
) -> DataFrame:
    """Columns ``out_0`` to ``out_{k-1}``: the category statistic as the model sees it that leaves fold f out.

    A training row (another fold) gets the smoothed mean over the training rows before it in the hashed order, so
    never its own target; a row of fold f, or of no fold, gets the smoothed mean over all training rows. A level without
    training rows gives their overall mean. All folds come from one pass; slices split a hot category as above.
    """
    level = F.coalesce(F.col(cat).cast("string"), F.lit(label))
    order = hash_number(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    trains = [F.col(fold) != f for f in range(k)]
    placed = df.withColumns({
        "_c": level, "_h": order, **{f"_v{f}": F.when(trains[f], F.col(y).cast("double")) for f in range(k)},
    }).withColumn("_b", F.shiftright("_h", 32 - buckets.bit_length() + 1).cast("int"))
    whole = Window.partitionBy("_c")  # at most ``buckets`` slices a level
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.sum(f"_v{f}").alias(f"_s{f}") for f in range(k)] + [F.count(f"_v{f}").alias(f"_n{f}") for f in range(k)]
    offsets = placed.groupBy("_c", "_b").agg(*sums).select(
        "_c", "_b",
        *[F.coalesce(F.sum(f"_{a}{f}").over(w), F.lit(0)).alias(f"_{a}{f}_{to}")
          for f in range(k) for a in "sn" for to, w in (("all", whole), ("before", before))],
    )
    means = df.agg(*[F.avg(F.when(trains[f], F.col(y).cast("double"))).alias(f"_mean{f}") for f in range(k)])
    inside = Window.partitionBy("_c", "_b").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, -1)

    def stat(f: int, total, count):
        return F.try_divide(total + F.lit(prior_weight) * F.col(f"_mean{f}"), count + F.lit(float(prior_weight)))

    running = {}
    for f in range(k):
        total = F.col(f"_s{f}_before") + F.coalesce(F.sum(f"_v{f}").over(inside), F.lit(0.0))
        count = F.col(f"_n{f}_before") + F.count(f"_v{f}").over(inside)
        held = stat(f, F.col(f"_s{f}_all"), F.col(f"_n{f}_all"))
        running[f"{out}_{f}"] = F.when(trains[f], stat(f, total, count)).otherwise(held)
    joined = placed.join(offsets, ["_c", "_b"]).crossJoin(F.broadcast(means))  # one row
    return joined.select(*df.columns, *[c.alias(name) for name, c in running.items()])


class OrderedTarget(FitStep):
    """Smoothed target mean of a category that shows no training row its own target.

    ``OrderedTarget(col=, y=, key=, train="training", prior_weight=1.0, out=, seed=0)`` learns from the rows whose flag
    ``train`` is true. ``transform`` gives flagged rows the running mean of ``ordered_target_stat`` over the flagged
    rows of its input, and all other rows (and inputs without the flag) the mean of their level; a level never seen gives
    the overall mean. So a pipeline fitted on flagged rows trains its later stages on running means only.
    """

    DEFAULTS = {"train": "training", "prior_weight": 1.0, "seed": 0, "label": "MISSING"}

    def _fit(self, df: DataFrame) -> OrderedTargetModel:
        c = self.conf
        rows = df.where(F.col(c["train"]))
        mean = rows.agg(F.avg(F.col(c["y"]).cast("double"))).first()[0]
        level = F.coalesce(F.col(c["col"]).cast("string"), F.lit(c["label"]))
        prior = F.lit(float(c["prior_weight"]))
        stat = F.try_divide(F.coalesce(F.sum(F.col(c["y"]).cast("double")), F.lit(0.0)) + prior * F.lit(mean), F.count(c["y"]) + prior)
        levels = rows.groupBy(level.alias("_level")).agg(stat.alias("_stat"))
        return OrderedTargetModel({"levels": keep_table(levels, "levels"), "mean": mean}, **c)


class OrderedTargetModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        c = self.conf
        keep = df.columns
        flag = F.coalesce(F.col(c["train"]), F.lit(False)) if c["train"] in keep else F.lit(False)
        found = df.withColumn("_level", F.coalesce(F.col(c["col"]).cast("string"), F.lit(c["label"])))
        found = lookup_kept(found, self.state["levels"], ["_level"])
        full = F.coalesce("_stat", F.lit(self.state["mean"]).cast("double"))
        if c["train"] not in keep:
            return found.select(*keep, full.alias(c["out"]))
        marked = found.withColumn("_y", F.when(flag, F.col(c["y"]).cast("double")))
        run = ordered_target_stat(marked, c["col"], "_y", c["key"], float(c["prior_weight"]), "_run", c["seed"], label=c["label"])
        return run.select(*keep, F.when(flag, F.col("_run")).otherwise(full).alias(c["out"]))
