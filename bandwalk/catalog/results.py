"""Queries over walk-forward results, trial logs and clusters."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

from bandwalk.catalog.base import TRIALS, WF, ctes, query, rounded
from bandwalk.defaults import DEFAULTS
from bandwalk.fixtures import table, trials, wf_results
from bandwalk.functions.scalars import (
    composite_score,
    overfit_label,
    round3,
    sign_colour,
    star_marker,
)
from bandwalk.operators import analysis as an
from bandwalk.operators import clusters as cl

COMBO = "ma_window, atr_window, mult_x2, sl_pct"
MULTS = (2, 3, 4, 5)

WF_SQL = ("wf", WF)
TRAIN = ("train", "select * from wf where set_name = 'train'")
TEST = ("test", "select * from wf where set_name = 'test'")
ALIGNED = (
    "al",
    f"""select symbol, split, {COMBO}, max(case when set_name = 'train' then sharpe end) as train_sharpe,
        max(case when set_name = 'test' then sharpe end) as test_sharpe from wf group by all""",
)
MEDIANS = [
    ("mtr", f"select symbol, {COMBO}, median(sharpe) as train_median, count(*) filter (where sharpe > 0) as n_pos from train group by all"),
    ("mte", f"select symbol, {COMBO}, median(sharpe) as test_median, count(*) filter (where sharpe > 0) as n_pos, count(*) as n from test group by all"),
    ("ns", "select symbol, count(distinct split) as n_splits from wf group by symbol"),
    ("tab", f"""select a.*, b.test_median, n_splits, a.n_pos >= 0.5 * n_splits as is_robust
                from mtr a join ns using (symbol) left join mte b using (symbol, {COMBO})"""),
]
BASE = [WF_SQL, TRAIN, TEST, ALIGNED, *MEDIANS]


@query("split_sets", ctes(WF_SQL) + """select symbol, set_name, count(*) as n_rows,
       count(*) filter (where sharpe is null) as n_null from wf group by 1, 2""")
def _(spark, sf):
    return an.split_sets(wf_results(spark, sf))


CORR_SQL = ("co", "select symbol, corr(train_sharpe, test_sharpe) as corr from al group by symbol")


@query("train_test_corr", ctes(WF_SQL, ALIGNED, CORR_SQL) + """select symbol, round(corr, 8) as corr,
       case when corr > 0.5 then 'good' when corr > 0 then 'weak' else 'overfit' end as label from co""")
def _(spark, sf):
    return rounded(an.train_test_corr(wf_results(spark, sf)))


@query("combo_median", ctes(WF_SQL) + f"""select symbol, set_name, {COMBO}, round(median(sharpe), 8) as median_sharpe
       from wf group by all""")
def _(spark, sf):
    return rounded(an.combo_median(wf_results(spark, sf)))


def heat_sql(src: str, value: str) -> str:
    cells = ", ".join(f"round(median(case when mult_x2 = {m} then {value} end), 8) as m_{str(m / 2).replace('.', '_')}" for m in MULTS)
    return f"select symbol, ma_window, {cells} from {src} group by 1, 2"


@query("train_heatmap", ctes(WF_SQL, TRAIN) + heat_sql("train", "sharpe"))
def _(spark, sf):
    return rounded(an.train_heatmap(wf_results(spark, sf), MULTS))


@query("train_test_delta", ctes(WF_SQL, TRAIN, TEST) + f"""
       select symbol, split, {COMBO}, round(a.sharpe, 8) as train_sharpe, round(b.sharpe, 8) as test_sharpe,
              round(b.sharpe - a.sharpe, 8) as delta from train a full outer join test b using (symbol, split, {COMBO})""")
def _(spark, sf):
    return rounded(an.train_test_delta(wf_results(spark, sf)))


@query("delta_heatmap", ctes(WF_SQL, ALIGNED) + heat_sql("al", "test_sharpe - train_sharpe"))
def _(spark, sf):
    return rounded(an.delta_heatmap(wf_results(spark, sf), MULTS))


@query("robust_combos_train", ctes(*BASE) + f"select symbol, {COMBO}, n_pos as n_positive, n_splits from tab where is_robust")
def _(spark, sf):
    return an.robust_combos_train(wf_results(spark, sf))


@query("robust_combos_test", ctes(*BASE) + f"""select symbol, {COMBO}, round(n_pos / n, 8) as positive_share from mte
       where n_pos / n >= 0.5""")
def _(spark, sf):
    return rounded(an.robust_combos_test(wf_results(spark, sf)))


BEST = ("best", f"""select *, row_number() over (partition by symbol order by is_robust desc, train_median desc, {COMBO}) as rn
        from tab where train_median is not null""")


@query("best_robust_combo", ctes(*BASE, BEST) + f"""select symbol, {COMBO}, round(train_median, 8) as train_median,
       round(test_median, 8) as test_median, n_pos as n_positive, n_splits, is_robust from best where rn = 1""")
def _(spark, sf):
    return rounded(an.best_robust_combo(wf_results(spark, sf)))


OOS = ("oos", f"select symbol, split, t.sharpe as test_sharpe from test t join (select symbol, {COMBO} from best where rn = 1) b using (symbol, {COMBO})")


def chosen_by_split(spark, sf):
    results = wf_results(spark, sf)
    return an.oos_by_split(results, an.best_robust_combo(results))


@query("oos_by_split", ctes(*BASE, BEST, OOS) + "select symbol, split, round(test_sharpe, 8) as test_sharpe from oos")
def _(spark, sf):
    return rounded(chosen_by_split(spark, sf))


@query("oos_report", ctes(*BASE, BEST, OOS) + """select symbol, round(avg(test_sharpe), 8) as mean_sharpe,
       round(median(test_sharpe), 8) as median_sharpe, count(*) filter (where test_sharpe > 0) as n_positive,
       count(*) as n_splits from oos group by symbol""")
def _(spark, sf):
    return rounded(an.oos_report(chosen_by_split(spark, sf)))


@query("top_combos", ctes(*BASE, ("r", f"""select *, row_number() over (partition by symbol order by train_median desc, {COMBO}) as rn
       from tab where train_median is not null""")) + f"""select symbol, cast(rn as int) as rank, {COMBO},
       round(train_median, 8) as sharpe_train, round(test_median, 8) as sharpe_test,
       round(test_median - train_median, 8) as delta from r where rn <= 10""")
def _(spark, sf):
    return rounded(an.top_combos(wf_results(spark, sf)))


RANKED = [
    *BASE,
    CORR_SQL,
    ("pick", f"""select *, row_number() over (partition by symbol order by train_median desc nulls last, {COMBO}) as rn,
                 count(*) filter (where is_robust) over (partition by symbol) as n_robust from tab"""),
    ("pairs", f"""select symbol, n_robust, round_even(train_median, 3) as best_sharpe_train,
                  round_even(test_median, 3) as best_sharpe_test, round_even(test_median - train_median, 3) as delta,
                  round_even(corr, 3) as corr_train_test, ma_window as best_ma_window, atr_window as best_atr_window,
                  mult_x2 as best_mult_x2, sl_pct as best_sl_pct from pick join co using (symbol) where rn = 1"""),
    ("rk", "select *, row_number() over (order by best_sharpe_test desc nulls last, symbol) as rank from pairs"),
]


@query("rank_pairs", ctes(*RANKED) + "select * from rk")
def _(spark, sf):
    return rounded(an.rank_pairs(wf_results(spark, sf)))


@query("ranking_bars", ctes(*RANKED) + """select symbol as label, best_sharpe_test as value,
       case when best_sharpe_test > 0 then 'green' else 'red' end as colour from rk""")
def _(spark, sf):
    return rounded(an.ranking_bars(an.rank_pairs(wf_results(spark, sf))))


@query("summarise_pair", ctes(*BASE) + """
       select a.symbol, n_combos, n_robust, round(train_min, 8) as train_min, round(train_max, 8) as train_max,
              round(test_min, 8) as test_min, round(test_max, 8) as test_max
       from (select symbol, count(*) as n_combos, min(train_median) as train_min, max(train_median) as train_max from mtr group by 1) a
       join (select symbol, count(*) filter (where n_pos / n >= 0.5) as n_robust, min(test_median) as test_min,
                    max(test_median) as test_max from mte group by 1) b using (symbol)""")
def _(spark, sf):
    return rounded(an.summarise_pair(wf_results(spark, sf)))


@query("top_test_combos", ctes(*BASE, ("r", f"""select *, row_number() over (partition by symbol order by test_median desc, {COMBO}) as rn
       from mte where test_median is not null""")) + f"""select symbol, cast(rn as int) as rank, {COMBO},
       round(test_median, 8) as test_median from r where rn <= 5""")
def _(spark, sf):
    return rounded(an.top_test_combos(wf_results(spark, sf)))


@query("rank_pairs_by_test", ctes(*BASE, ("b", """select symbol, max(test_median) as best_sharpe,
       count(*) filter (where n_pos / n >= 0.5) as n_robust from mte group by 1""")) + """
       select symbol, round(best_sharpe, 8) as best_sharpe, n_robust,
              row_number() over (order by best_sharpe desc nulls last, symbol) as rank,
              case when best_sharpe > 0 then '***' else '' end as marker,
              (select count(*) from b where best_sharpe > 0) as n_positive_pairs from b""")
def _(spark, sf):
    return rounded(an.rank_pairs_by_test(wf_results(spark, sf)))


# ---- scalar expressions -------------------------------------------------------------


def exact_sum(name: str) -> Column:
    """Sum of a double column by its decimal digits, so that no row order changes it.

    Figures in cents are added as integers, others as decimals. NULL for a group with a figure that decimals
    do not hold (NaN, infinite, 1e20 or more).
    """
    value = F.col(name)
    cents = F.when(F.abs(value) < 1e7, F.rint(value * 100).cast("bigint"))
    whole = F.coalesce(cents / 100 == value, F.lit(False))
    rest = F.when(~whole, value).try_cast("decimal(38,18)")
    total = F.coalesce(F.sum(F.when(whole, cents)), F.lit(0)) * F.lit(Decimal("0.01")) + F.when(
        F.count(rest) > 0, F.try_sum(rest)
    ).otherwise(F.lit(0))
    held = (F.count_if(whole) + F.count(rest) == F.count(value)) & (F.count(value) > 0)
    return F.when(held, total).try_cast("decimal(38,18)")


def round_half_down(value: Column, digits: int) -> Column:
    """Rounding that takes values within double precision of halfway towards zero."""
    off = F.least(F.abs(value) * 2.0**-50, F.lit(0.4 * 10.0**-digits))
    return F.round(value - F.signum(value) * off, digits)


@query("composite_score", """
       with t as (select l_returnflag, l_suppkey, count(*) as n, avg(l_discount) * 6 as dd, sum(l_tax) as sh, avg(l_quantity) / 100 as ret
                  from lineitem group by 1, 2)
       select l_returnflag, l_suppkey, round(case when n < 30 or dd > 0.3 then -999.0
              else 0.7 * sh + 0.3 * ret * (1 - dd) end, 8) as score from t""")
def _(spark, sf):
    """Scores from exact sums: a drawdown of just 0.3 is not rejected, a score just halfway is rounded down.

    The SQL adds doubles in the order its threads meet them, and falls on either side at such ties.
    """
    mean = {c: exact_sum(c) / F.count(c) for c in ("l_discount", "l_quantity")}
    t = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(
        F.count("*").alias("n"),
        F.coalesce((mean["l_discount"] * 6).cast("double"), F.avg("l_discount") * 6).alias("dd"),
        F.coalesce(exact_sum("l_tax").cast("double"), F.sum("l_tax")).alias("sh"),
        F.coalesce((mean["l_quantity"] / 100).cast("double"), F.avg("l_quantity") / 100).alias("ret"),
    )
    score = composite_score(F.col("n"), F.col("dd"), F.col("sh"), F.col("ret"))
    return t.select("l_returnflag", "l_suppkey", round_half_down(score, 8).alias("score"))


@query("overfit_label", ctes(WF_SQL, ALIGNED) + f"""select symbol, ma_window, mult_x2,
       case when corr(train_sharpe, test_sharpe) > 0.5 then 'good' when corr(train_sharpe, test_sharpe) > 0 then 'weak'
            else 'overfit' end as label from al group by all""")
def _(spark, sf):
    pairs = an.aligned(wf_results(spark, sf)).groupBy("symbol", "ma_window", "mult_x2")
    return pairs.agg(overfit_label(F.corr("train_sharpe", "test_sharpe")).alias("label"))


@query("sign_markers", ctes(WF_SQL) + f"""select symbol, {COMBO}, set_name,
       case when median(sharpe) > 0 then 'green' else 'red' end as colour,
       case when median(sharpe) > 0 then '***' else '' end as marker,
       count(*) filter (where sharpe > 0) as n_positive from wf group by all""")
def _(spark, sf):
    return wf_results(spark, sf).groupBy("symbol", *an.COMBO, "set_name").agg(
        sign_colour(F.median("sharpe")).alias("colour"),
        star_marker(F.median("sharpe")).alias("marker"),
        F.count_if(F.col("sharpe") > 0).alias("n_positive"),
    )


@query("round_half_even", ctes(WF_SQL) + f"""select symbol, split, set_name, {COMBO},
       round_even(sharpe * 0.125, 3) as rounded_sharpe from wf""")
def _(spark, sf):
    return wf_results(spark, sf).select(
        "symbol", "split", "set_name", *an.COMBO, round3(F.col("sharpe") * 0.125).alias("rounded_sharpe")
    )


# ---- clusters -----------------------------------------------------------------------

P4 = "ma_window, atr_window, mult_x4, sl_pct"
T_SQL = ("t", TRIALS)
VALID = ("valid", "select * from t where score > -999")


def norm_sql(params) -> tuple[str, str]:
    cols = ", ".join(
        f"case when max({p}) over () > min({p}) over () then ({p} - min({p}) over ()) / cast(max({p}) over () - min({p}) over () as double) else 0 end as {p}_norm"
        for p in params
    )
    return ("norm", f"select *, {cols} from valid")


TOP = ("topq", """select n.* from norm n join (select window_id, quantile_cont(score, 0.7) as cut from norm group by 1) q
                 using (window_id) where score >= cut""")


def near_sql(params, radius: float) -> tuple[str, str]:
    terms = " + ".join(f"(a.{p}_norm - b.{p}_norm) * (a.{p}_norm - b.{p}_norm)" for p in params)
    keys = ", ".join(f"a.{p}" for p in params)
    return ("near", f"""select a.window_id, {keys}, count(distinct b.window_id) as nearby_windows
            from (select distinct window_id, {', '.join(params)}, {', '.join(p + '_norm' for p in params)} from topq) a
            join (select distinct window_id, {', '.join(params)}, {', '.join(p + '_norm' for p in params)} from topq) b
            on a.window_id <> b.window_id and sqrt({terms}) <= {radius} group by all""")


def stable_sql(params) -> list[tuple[str, str]]:
    keys = ", ".join(params)
    return [
        ("nb", f"""select q.*, coalesce(n.nearby_windows, 0) as nearby_windows from topq q left join near n using (window_id, {keys})"""),
        ("tot", "select count(distinct window_id) as n from t"),
        ("rt", "select nb.*, nearby_windows / cast(nullif(n - 1, 0) as double) as ratio from nb, tot"),
        ("stable", "select *, case when ratio >= 0.7 then 'green' else 'orange' end as colour from rt where ratio >= 0.5"),
    ]


CLUSTER = [T_SQL, VALID, norm_sql(cl.PARAMS4), TOP]
FULL4 = [*CLUSTER, near_sql(cl.PARAMS4, 0.35), *stable_sql(cl.PARAMS4)]
FULL3 = [T_SQL, VALID, norm_sql(cl.PARAMS3), TOP, near_sql(cl.PARAMS3, 0.30), *stable_sql(cl.PARAMS3)]


def top_trials(spark, sf, params=cl.PARAMS4):
    valid = cl.valid_trials(trials(spark, sf))
    return cl.top_quantile_per_window(cl.minmax_normalise(valid, params))


def neighbours(spark, sf, params=cl.PARAMS4):
    radius = DEFAULTS.cluster_radius[len(params)]
    return cl.neighbour_windows(top_trials(spark, sf, params), radius, params)


def stable(spark, sf, params=cl.PARAMS4):
    return cl.stable_points(neighbours(spark, sf, params), trials(spark, sf))


@query("valid_trials", ctes(T_SQL, VALID) + f"select window_id, {P4}, score from valid")
def _(spark, sf):
    return cl.valid_trials(trials(spark, sf))


@query("minmax_normalise", ctes(T_SQL, VALID, norm_sql(cl.PARAMS4)) + f"""select window_id, {P4}, score,
       {', '.join(f'round({p}_norm, 8) as {p}_norm' for p in cl.PARAMS4)} from norm""")
def _(spark, sf):
    return rounded(cl.minmax_normalise(cl.valid_trials(trials(spark, sf))))


@query("top_quantile_per_window", ctes(*CLUSTER) + f"select window_id, {P4}, score from topq")
def _(spark, sf):
    return top_trials(spark, sf).select("window_id", *cl.PARAMS4, "score")


@query("neighbour_windows", ctes(*FULL4) + f"select window_id, {P4}, score, nearby_windows from nb")
def _(spark, sf):
    return neighbours(spark, sf).select("window_id", *cl.PARAMS4, "score", "nearby_windows")


STABLE_COLUMNS = ("window_id", "score", "nearby_windows", "ratio", "colour")


@query("stable_points", ctes(*FULL4) + f"""select window_id, {P4}, score, nearby_windows, round(ratio, 8) as ratio, colour from stable""")
def _(spark, sf):
    return rounded(stable(spark, sf).select(*cl.PARAMS4, *STABLE_COLUMNS))


@query("stable_points_3d", ctes(*FULL3) + f"""select window_id, ma_window, atr_window, mult_x4, score, nearby_windows,
       round(ratio, 8) as ratio, colour from stable""")
def _(spark, sf):
    return rounded(stable(spark, sf, cl.PARAMS3).select(*cl.PARAMS3, *STABLE_COLUMNS))


CENTRE = ("centre", """select colour, count(*) as n_points, cast(trunc(median(ma_window)) as int) as ma_window,
          cast(trunc(median(atr_window)) as int) as atr_window, median(mult_x4) as mult_x4, median(sl_pct) as sl_pct
          from stable group by colour order by colour limit 1""")


@query("cluster_centre", ctes(*FULL4, CENTRE) + "select * from centre")
def _(spark, sf):
    return cl.cluster_centre(stable(spark, sf))


@query("param_ranges", ctes(*CLUSTER) + "select window_id, "
       + ", ".join(f"{f}({p}) as {p}_{f}" for p in cl.PARAMS4 for f in ("min", "max"))
       + " from topq group by 1")
def _(spark, sf):
    return cl.param_ranges(top_trials(spark, sf))


DOUBLES = ", ".join(f"cast({p} as double) as {p}" for p in cl.PARAMS4)


@query("cluster_points", ctes(*FULL4, CENTRE) + f"""select 'top' as kind, window_id, {DOUBLES}, score from topq
       union all select 'final', null, {DOUBLES}, null from centre""")
def _(spark, sf):
    return cl.cluster_points(top_trials(spark, sf), cl.cluster_centre(stable(spark, sf)))


# The same analysis for many pairs in one job.
BY_SYMBOL = ("t", TRIALS.replace("select cast", "select l_returnflag as symbol, cast", 1).replace("1, 2, 3, 4, 5", "1, 2, 3, 4, 5, 6"))


def _per_symbol() -> list[tuple[str, str]]:
    norm = ", ".join(
        f"case when max({p}) over s > min({p}) over s then ({p} - min({p}) over s) / cast(max({p}) over s - min({p}) over s as double) else 0 end as {p}_norm"
        for p in cl.PARAMS4
    )
    d2 = " + ".join(f"(a.{p}_norm - b.{p}_norm) * (a.{p}_norm - b.{p}_norm)" for p in cl.PARAMS4)
    return [
        BY_SYMBOL,
        VALID,
        ("norm", f"select *, {norm} from valid window s as (partition by symbol)"),
        ("topq", """select n.* from norm n join (select symbol, window_id, quantile_cont(score, 0.7) as cut from norm group by 1, 2) q
                    using (symbol, window_id) where score >= cut"""),
        ("near", f"""select a.symbol, a.window_id, a.ma_window, a.atr_window, a.mult_x4, a.sl_pct, count(distinct b.window_id) as nearby_windows
                    from topq a join topq b on a.symbol = b.symbol and a.window_id <> b.window_id and sqrt({d2}) <= 0.35 group by all"""),
        ("tot", "select symbol, count(distinct window_id) as n from t group by symbol"),
        ("rt", f"""select q.*, coalesce(nearby_windows, 0) / cast(nullif(n - 1, 0) as double) as ratio
                    from topq q join tot using (symbol) left join near using (symbol, window_id, {P4})"""),
        ("stable", "select *, case when ratio >= 0.7 then 'green' else 'orange' end as colour from rt where ratio >= 0.5"),
        ("centre", """select symbol, colour, count(*) as n_points, cast(trunc(median(ma_window)) as int) as ma_window,
                      cast(trunc(median(atr_window)) as int) as atr_window, median(mult_x4) as mult_x4, median(sl_pct) as sl_pct,
                      row_number() over (partition by symbol order by colour) as rn from stable group by symbol, colour"""),
    ]


@query("cluster_centre_by_symbol", ctes(*_per_symbol()) + f"select symbol, colour, n_points, {P4} from centre where rn = 1")
def _(spark, sf):
    keys = ["symbol"]
    log = trials(spark, sf, ["l_returnflag"]).withColumnRenamed("l_returnflag", "symbol")
    top = cl.top_quantile_per_window(
        cl.minmax_normalise(cl.valid_trials(log), keys=keys), keys=keys
    )
    near = cl.neighbour_windows(top, DEFAULTS.cluster_radius[4], keys=keys)
    return cl.cluster_centre(cl.stable_points(near, log, keys=keys), keys=keys)
