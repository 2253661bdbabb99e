"""Cross-window cluster analysis of a trial log (window_id, params, score).

With ``keys`` (say, the pair columns) every key is analysed on its own in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F, types as T

from bandwalk.defaults import DEFAULTS
from bandwalk.session import settled, wide

PARAMS4 = ("ma_window", "atr_window", "mult_x4", "sl_pct")
PARAMS3 = PARAMS4[:3]


def valid_trials(
    trials: DataFrame, keep_rejected: bool = False, rejected: float = DEFAULTS.rejected_score
) -> DataFrame:
    score = F.col("score")
    return trials.filter(score >= rejected if keep_rejected else score > rejected)


def _attach(df: DataFrame, facts: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Add the per-key facts as a struct; without keys they are one row."""
    packed = facts.select(*keys, F.struct(*[c for c in facts.columns if c not in keys]).alias(name))
    if keys:
        return df.join(packed, list(keys))
    return df.withColumn(name, packed.scalar())


def param_bounds(
    valid: DataFrame, params: Sequence[str] = PARAMS4, keys: Sequence[str] = ()
) -> DataFrame:
    """Min and max of each parameter, one row per key."""
    return valid.groupBy(*keys).agg(
        *[F.min(p).alias(f"{p}_min") for p in params], *[F.max(p).alias(f"{p}_max") for p in params]
    )


def _norm(p: str, value: Column) -> Column:
    low, high = F.col(f"_r.{p}_min"), F.col(f"_r.{p}_max")
    return F.when(high > low, (value - low) / (high - low)).otherwise(0.0)


def minmax_normalise(
    valid: DataFrame, params: Sequence[str] = PARAMS4, keys: Sequence[str] = ()
) -> DataFrame:
    """Add ``<param>_norm`` in [0, 1]; 0 where a parameter is constant."""
    return (
        _attach(valid, param_bounds(valid, params, keys), keys, "_r")
        .withColumns({f"{p}_norm": _norm(p, F.col(p)) for p in params})
        .drop("_r")
    )


def top_quantile_per_window(
    valid: DataFrame, q: float = DEFAULTS.top_quantile, window: str = "window_id",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Trials at or above the interpolated quantile of their own window; ties kept.

    The exact percentile combines value counts map-side; its state is the set of distinct
    scores of a window, bounded by the parameter space.
    """
    by = [*keys, window]
    cut = valid.groupBy(*by).agg(F.percentile("score", q).alias("_cut"))
    return valid.join(cut, by).filter(F.col("score") >= F.col("_cut")).drop("_cut")


def _cell(coordinates: Sequence[Column], side: float, base: int) -> Column:
    """One number per grid cell; adding an offset code moves to another cell."""
    code = F.lit(0).cast("bigint")
    for x in coordinates:
        code = code * base + F.floor(x / side) + 4
    return code


def _codes(offsets, base: int) -> Column:
    codes = []
    for offset in offsets:
        code = 0
        for o in offset:
            code = code * base + o
        codes.append(code)
    return F.array(*[F.lit(c).cast("bigint") for c in codes])


FINE = 4  # fine cells per radius


def neighbour_windows(
    top: DataFrame, radius: float, params: Sequence[str] = PARAMS4, window: str = "window_id",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add ``nearby_windows``: other windows with a point within ``radius``.

    Most answers follow from a fine grid alone: two cells whose farthest corners are
    closer than the radius hold only close points. Each occupied (cell, window) marks the
    cells it is sure to reach, which is bounded by the number of cells. Only the windows
    a point's cell is not sure about are checked point by point, as a semi-join that
    stops at the first match; no pair of points is emitted.
    """
    params = list(params)
    norms = [f"{p}_norm" for p in params]
    points = settled(top)
    n = wide(points.sparkSession)
    keys = list(keys)
    ids = [*keys, window, *params]
    base = int(FINE / radius) + 16
    side, coarse_side = radius / FINE, radius * (1 + 1e-9)
    reach = range(-FINE + 1, FINE)
    sure = [
        o for o in product(reach, repeat=len(params)) if sum((abs(d) + 1) ** 2 for d in o) < FINE**2
    ]
    around = list(product((-1, 0, 1), repeat=len(params)))
    placed = points.select(*ids, *norms).distinct().repartition(n, *params).select(
        *ids,
        *norms,
        _cell([F.col(c) for c in norms], side, base).alias("_cell"),
        _cell([F.col(c) for c in norms], coarse_side, base).alias("_coarse"),
    )
    reached = (
        placed.select(*keys, F.col(window).alias("_w"), "_cell")
        .distinct()
        .select(*keys, "_w", F.explode(_codes(sure, base)).alias("_o"), "_cell")
        .select(*keys, "_w", (F.col("_cell") + F.col("_o")).alias("_cell"))
        .distinct()
        .groupBy(*keys, "_cell")
        .agg(F.collect_set("_w").alias("_sure"))  # at most one entry per window
    )
    windows = points.groupBy(*keys).agg(F.collect_set(window).alias("all"))
    known = settled(_attach(placed.join(reached, [*keys, "_cell"]), windows, keys, "_f"))
    # Renamed columns keep the two sides of the self-join apart.
    asked = (
        known.select(*ids, *norms, "_coarse", F.explode(F.array_except("_f.all", "_sure")).alias("_ask"))
        .select("*", F.explode(_codes(around, base)).alias("_o"))
        .select(*ids, *norms, "_ask", (F.col("_coarse") + F.col("_o")).alias("_at"))
    )
    others = placed.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(window).alias("_w"),
        F.col("_coarse").alias("_there"),
        *[F.col(c).alias(f"_{c}") for c in norms],
    )
    d2 = reduce(
        lambda a, b: a + b,
        [(F.col(f"_{c}") - F.col(c)) * (F.col(f"_{c}") - F.col(c)) for c in norms],
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col("_ask") == F.col("_w"), F.col("_at") == F.col("_there")]
        + [F.col(k) == F.col(f"_k_{k}") for k in keys],
    )
    checked = (
        asked.join(others, same & (F.sqrt(d2) <= F.lit(radius)), "left_semi")
        .groupBy(*ids)
        .agg(F.countDistinct("_ask").alias("_more"))
    )
    counts = known.select(*ids, (F.size("_sure") - 1).alias("_few")).join(checked, ids, "left")
    return points.join(
        counts.select(
            *ids,
            (F.col("_few") + F.coalesce("_more", F.lit(0))).cast("bigint").alias("nearby_windows"),
        ),
        ids,
    )


def stable_points(
    neighbours: DataFrame, trials: DataFrame, orange: float = DEFAULTS.orange_ratio,
    green: float = DEFAULTS.green_ratio, window: str = "window_id", keys: Sequence[str] = (),
) -> DataFrame:
    """Points near enough other windows of all ``trials``; a single window leaves none."""
    total = trials.groupBy(*keys).agg(F.countDistinct(window).alias("n"))
    return (
        _attach(neighbours, total, keys, "_total")
        .withColumn(
            "ratio", F.col("nearby_windows") / F.nullif(F.col("_total.n") - 1, F.lit(0))
        )
        .filter(F.col("ratio") >= orange)
        .withColumn("colour", F.when(F.col("ratio") >= green, "green").otherwise("orange"))
        .drop("_total")
    )


def cluster_centre(
    stable: DataFrame, params: Sequence[str] = PARAMS4, keys: Sequence[str] = ()
) -> DataFrame:
    """Medians of the green points, else of the orange ones; windows truncated to int.

    The state of each median is a count per distinct parameter value.
    """
    per_colour = stable.groupBy(*keys, "colour").agg(
        F.count("*").alias("n_points"), *[F.median(p).alias(p) for p in params]
    )
    # Two rows per key at most; green sorts before orange.
    best = F.min_by(F.struct("colour", "n_points", *params), F.col("colour")).alias("_b")
    return (
        per_colour.groupBy(*keys)
        .agg(best)
        .filter(F.col("_b").isNotNull())
        .select(*keys, "_b.*")
        .withColumns({p: F.col(p).cast("int") for p in params if p.endswith("window")})
    )


def param_ranges(
    top: DataFrame, params: Sequence[str] = PARAMS4, window: str = "window_id",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Range of each parameter among a window's top trials."""
    return top.groupBy(*keys, window).agg(
        *[f(p).alias(f"{p}_{f.__name__}") for p in params for f in (F.min, F.max)]
    )


def cluster_points(
    top: DataFrame, centre: DataFrame, params: Sequence[str] = PARAMS4, window: str = "window_id",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Points to plot: top trials per window and the final point (window NULL)."""
    double = [F.col(p).cast("double").alias(p) for p in params]
    return top.select(
        *keys, F.lit("top").alias("kind"), window, *double, F.col("score")
    ).unionByName(
        centre.select(
            *keys,
            F.lit("final").alias("kind"),
            F.lit(None).cast(T.IntegerType()).alias(window),
            *double,
            F.lit(None).cast("double").alias("score"),
        )
    )
