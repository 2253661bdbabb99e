"""Analysis of walk-forward results (key, split, set_name, params, sharpe).

Train and test values are aligned by conditional aggregation on the shared key, which
takes one shuffle where a self-join takes two and gives inner, left and full outer
alignment from the same frame. Groups per combination or per cell are bounded by the
grid and the number of splits, so exact medians are safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from bandwalk.defaults import DEFAULTS
from bandwalk.functions.scalars import overfit_label, round3, sign_colour, star_marker
from bandwalk.operators.ranking import ranked
from bandwalk.operators.series import KEYS

COMBO = ("ma_window", "atr_window", "mult_x2", "sl_pct")


def _of(set_name: str, value: str = "sharpe") -> Column:
    return F.when(F.col("set_name") == set_name, F.col(value))


def split_sets(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Size and null count of the train and test halves."""
    return results.groupBy(*keys, "set_name").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("sharpe").isNull()).alias("n_null")
    )


def aligned(
    results: DataFrame, keys: Sequence[str] = KEYS, combo: Sequence[str] = COMBO
) -> DataFrame:
    """Train and test Sharpe side by side; a missing side is NULL."""
    return results.groupBy(*keys, "split", *combo).agg(
        F.max(_of("train")).alias("train_sharpe"), F.max(_of("test")).alias("test_sharpe")
    )


def train_test_corr(
    results: DataFrame, keys: Sequence[str] = KEYS, combo: Sequence[str] = COMBO
) -> DataFrame:
    """Pearson correlation over aligned pairs, with its label."""
    corr = aligned(results, keys, combo).groupBy(*keys).agg(
        F.corr("train_sharpe", "test_sharpe").alias("corr")
    )
    return corr.withColumn("label", overfit_label(F.col("corr")))


def train_test_delta(
    results: DataFrame, keys: Sequence[str] = KEYS, combo: Sequence[str] = COMBO
) -> DataFrame:
    """test - train on the outer alignment."""
    return aligned(results, keys, combo).withColumn(
        "delta", F.col("test_sharpe") - F.col("train_sharpe")
    )


def combo_median(
    results: DataFrame, keys: Sequence[str] = KEYS, combo: Sequence[str] = COMBO
) -> DataFrame:
    """Median Sharpe per combination over the splits, per set."""
    return results.groupBy(*keys, "set_name", *combo).agg(
        F.median("sharpe").alias("median_sharpe")
    )


def combo_table(
    results: DataFrame, keys: Sequence[str] = KEYS, combo: Sequence[str] = COMBO
) -> DataFrame:
    """Medians and positive counts of both sets per combination, in one aggregate."""
    positive = F.col("sharpe") > 0
    is_train = F.col("set_name") == "train"
    return results.groupBy(*keys, *combo).agg(
        F.median(_of("train")).alias("train_median"),
        F.median(_of("test")).alias("test_median"),
        F.count_if(is_train & positive).alias("train_positive"),
        F.count_if(is_train).alias("train_rows"),
        F.count_if(~is_train & positive).alias("test_positive"),
        F.count_if(~is_train).alias("test_rows"),
    )


def n_splits(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return results.groupBy(*keys).agg(F.countDistinct("split").alias("n_splits"))


def heatmap(
    values: DataFrame, measure: str, mults: Sequence[float], row: str = "ma_window",
    column: str = "mult_x2", scale: float = 2.0, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Median per (row, column) cell, one column per multiplier (``m_1_5`` for 1.5).

    ``mults`` are values of ``column``; a name shows the value divided by ``scale``.
    """
    wide = values.groupBy(*keys, row).pivot(column, list(mults)).agg(F.median(measure))
    names = ["m_" + str(m / scale).replace(".", "_") for m in mults]
    return wide.toDF(*keys, row, *names)


def train_heatmap(
    results: DataFrame, mults: Sequence[float], keys: Sequence[str] = KEYS, row: str = "ma_window",
    column: str = "mult_x2", scale: float = 2.0,
) -> DataFrame:
    """Train Sharpe per cell. For results of the engine itself: ``column="atr_mult", scale=1.0``."""
    train = results.filter(F.col("set_name") == "train")
    return heatmap(train, "sharpe", mults, row, column, scale, keys)


def delta_heatmap(
    results: DataFrame, mults: Sequence[float], keys: Sequence[str] = KEYS, row: str = "ma_window",
    column: str = "mult_x2", scale: float = 2.0, combo: Sequence[str] = COMBO,
) -> DataFrame:
    """Test minus train per cell; ``combo`` are the parameter columns of the results."""
    return heatmap(train_test_delta(results, keys, combo), "delta", mults, row, column, scale, keys)


def with_robust_train(
    results: DataFrame, share: float = DEFAULTS.robust_share, keys: Sequence[str] = KEYS,
    combo: Sequence[str] = COMBO,
) -> DataFrame:
    """Combination table with ``is_robust``: positive on train in enough of all splits."""
    return (
        combo_table(results, keys, combo)
        .join(n_splits(results, keys), list(keys))
        .withColumn(
            "is_robust",
            (F.col("train_rows") > 0) & (F.col("train_positive") >= F.col("n_splits") * share),
        )
    )


def robust_combos_train(
    results: DataFrame, share: float = DEFAULTS.robust_share, keys: Sequence[str] = KEYS,
    combo: Sequence[str] = COMBO,
) -> DataFrame:
    return (
        with_robust_train(results, share, keys, combo)
        .filter("is_robust")
        .select(*keys, *combo, F.col("train_positive").alias("n_positive"), "n_splits")
    )


def robust_on_test(share: float = DEFAULTS.robust_share) -> Column:
    return F.coalesce(
        F.col("test_positive") / F.nullif(F.col("test_rows"), F.lit(0)) >= share, F.lit(False)
    )


def robust_combos_test(
    results: DataFrame, share: float = DEFAULTS.robust_share, keys: Sequence[str] = KEYS,
    combo: Sequence[str] = COMBO,
) -> DataFrame:
    """Combinations positive in enough of their own test rows."""
    return (
        combo_table(results, keys, combo)
        .filter(robust_on_test(share))
        .select(
            *keys, *combo, (F.col("test_positive") / F.col("test_rows")).alias("positive_share")
        )
    )


def best_robust_combo(
    results: DataFrame, keys: Sequence[str] = KEYS, combo: Sequence[str] = COMBO
) -> DataFrame:
    """Best train median among the robust combinations, else among all of them."""
    table = with_robust_train(results, keys=keys, combo=combo).filter(
        F.col("train_median").isNotNull()
    )
    picked = F.struct(
        *combo,
        "train_median",
        "test_median",
        F.col("train_positive").alias("n_positive"),
        "n_splits",
        "is_robust",
    )
    order = F.struct("is_robust", "train_median", *[-F.col(c) for c in combo])
    return table.groupBy(*keys).agg(F.max_by(picked, order).alias("_b")).select(*keys, "_b.*")


def oos_by_split(
    results: DataFrame, chosen: DataFrame, keys: Sequence[str] = KEYS,
    combo: Sequence[str] = COMBO,
) -> DataFrame:
    """Test Sharpe of the chosen combination in every split."""
    return (
        results.filter(F.col("set_name") == "test")
        .join(chosen.select(*keys, *combo), [*keys, *combo], "left_semi")
        .select(*keys, "split", F.col("sharpe").alias("test_sharpe"))
    )


def oos_report(by_split: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return by_split.groupBy(*keys).agg(
        F.avg("test_sharpe").alias("mean_sharpe"),
        F.median("test_sharpe").alias("median_sharpe"),
        F.count_if(F.col("test_sharpe") > 0).alias("n_positive"),
        F.count("*").alias("n_splits"),
    )


def _top(table: DataFrame, measure: str, k: int, keys, combo) -> DataFrame:
    # A key has at most as many rows as the grid has combinations.
    order = Window.partitionBy(*keys).orderBy(F.desc(measure), *combo)
    return (
        table.filter(F.col(measure).isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def top_combos(
    results: DataFrame, k: int = 10, keys: Sequence[str] = KEYS, combo: Sequence[str] = COMBO
) -> DataFrame:
    """Best train medians with their test medians."""
    return _top(combo_table(results, keys, combo), "train_median", k, keys, combo).select(
        *keys,
        "rank",
        *combo,
        F.col("train_median").alias("sharpe_train"),
        F.col("test_median").alias("sharpe_test"),
        (F.col("test_median") - F.col("train_median")).alias("delta"),
    )


def rank_pairs(
    results: DataFrame, keys: Sequence[str] = KEYS, combo: Sequence[str] = COMBO
) -> DataFrame:
    """Pairs by the test median of their train-best combination."""
    table = with_robust_train(results, keys=keys, combo=combo)
    best = table.groupBy(*keys).agg(
        F.count_if("is_robust").alias("n_robust"),
        F.max_by(
            F.struct("train_median", "test_median", *combo),
            F.struct("train_median", *[-F.col(c) for c in combo]),
        ).alias("_b"),
    )
    scored = best.join(train_test_corr(results, keys, combo), list(keys)).select(
        *keys,
        "n_robust",
        round3(F.col("_b.train_median")).alias("best_sharpe_train"),
        round3(F.col("_b.test_median")).alias("best_sharpe_test"),
        round3(F.col("_b.test_median") - F.col("_b.train_median")).alias("delta"),
        round3(F.col("corr")).alias("corr_train_test"),
        *[F.col(f"_b.{c}").alias(f"best_{c}") for c in combo],
    )
    return ranked(scored, [F.desc_nulls_last("best_sharpe_test"), *[F.asc(k) for k in keys]])


def summarise_pair(
    results: DataFrame, keys: Sequence[str] = KEYS, combo: Sequence[str] = COMBO
) -> DataFrame:
    """Combination count, robust count and the range of the medians."""
    return combo_table(results, keys, combo).groupBy(*keys).agg(
        F.count_if(F.col("train_rows") > 0).alias("n_combos"),
        F.count_if(robust_on_test()).alias("n_robust"),
        F.min("train_median").alias("train_min"),
        F.max("train_median").alias("train_max"),
        F.min("test_median").alias("test_min"),
        F.max("test_median").alias("test_max"),
    )


def top_test_combos(
    results: DataFrame, k: int = 5, keys: Sequence[str] = KEYS, combo: Sequence[str] = COMBO
) -> DataFrame:
    return _top(combo_table(results, keys, combo), "test_median", k, keys, combo).select(
        *keys, "rank", *combo, "test_median"
    )


def rank_pairs_by_test(
    results: DataFrame, keys: Sequence[str] = KEYS, combo: Sequence[str] = COMBO
) -> DataFrame:
    """Pairs by their best test median, with a marker and the count of positive pairs."""
    best = combo_table(results, keys, combo).groupBy(*keys).agg(
        F.max("test_median").alias("best_sharpe"), F.count_if(robust_on_test()).alias("n_robust")
    )
    out = ranked(best, [F.desc_nulls_last("best_sharpe"), *[F.asc(k) for k in keys]])
    positive = out.agg(F.count_if(F.col("best_sharpe") > 0).alias("n")).scalar()
    return out.withColumn("marker", star_marker(F.col("best_sharpe"))).withColumn(
        "n_positive_pairs", positive
    )


def ranking_bars(
    ranking: DataFrame, label: Sequence[str] = KEYS, value: str = "best_sharpe_test"
) -> DataFrame:
    """Label, value and colour of each bar of the ranking chart."""
    return ranking.select(
        F.concat_ws(" ", *label).alias("label"),
        F.col(value).alias("value"),
        sign_colour(F.col(value)).alias("colour"),
    )
