"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bandwalk.defaults import DEFAULTS, Defaults


def known_tf_seconds(tf: Column) -> Column:
    """Seconds of a timeframe such as ``5m``; units m, h, d, w. NULL for any other text."""
    unit = (
        F.when(F.right(tf, F.lit(1)) == "m", 60)
        .when(F.right(tf, F.lit(1)) == "h", 3_600)
        .when(F.right(tf, F.lit(1)) == "d", 86_400)
        .when(F.right(tf, F.lit(1)) == "w", 604_800)
    )
    seconds = tf.substr(F.lit(1), F.length(tf) - 1).try_cast("bigint") * unit
    return F.when(seconds > 0, seconds)


def tf_seconds(tf: Column) -> Column:
    """``known_tf_seconds``, with an error for a text that is no timeframe."""
    seconds = known_tf_seconds(tf)
    unknown = F.raise_error(F.concat(F.lit("unknown timeframe "), F.coalesce(tf, F.lit("NULL"))))
    return F.when(seconds.isNotNull(), seconds).otherwise(unknown.cast("bigint"))


def num_or_zero(value: Column) -> Column:
    """A missing or unreadable figure counts as zero."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def composite_score(
    n_trades: Column, drawdown: Column, sharpe: Column, total_return: Column,
    d: Defaults = DEFAULTS,
) -> Column:
    """Weighted Sharpe and drawdown-scaled return; rejected trials get a fixed low score."""
    return F.when(
        (n_trades < d.min_trades) | (drawdown > d.max_drawdown), F.lit(d.rejected_score)
    ).otherwise(
        sharpe * d.sharpe_weight + total_return * d.return_weight * (1 - drawdown)
    )


def overfit_label(corr: Column) -> Column:
    return F.when(corr > 0.5, "good").when(corr > 0, "weak").otherwise("overfit")


def sign_colour(value: Column) -> Column:
    return F.when(value > 0, "green").otherwise("red")


def star_marker(value: Column) -> Column:
    return F.when(value > 0, "***").otherwise("")


def round3(value: Column) -> Column:
    """Half-even rounding to three decimals."""
    return F.bround(value, 3)
