import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandwalk.operators import clusters as cl

SCHEMA = "window_id int, ma_window int, atr_window int, mult_x4 int, sl_pct int, score double"


def log(rng, n, windows=6, spread=1.0):
    centre = rng.uniform(0, 1, (3, 4))
    near = centre[rng.integers(0, 3, n)] + rng.normal(0, 0.1 * spread, (n, 4))
    near = np.clip(near, 0, 1)
    frame = pd.DataFrame(
        {
            "window_id": rng.integers(1, windows + 1, n),
            "ma_window": (10 + 5 * np.rint(near[:, 0] * 98)).astype(int),
            "atr_window": (5 + 5 * np.rint(near[:, 1] * 19)).astype(int),
            "mult_x4": (2 + np.rint(near[:, 2] * 38)).astype(int),
            "sl_pct": (1 + np.rint(near[:, 3] * 14)).astype(int),
            "score": rng.integers(-5, 20, n) / 4.0,
        }
    ).drop_duplicates(["window_id", *cl.PARAMS4])
    return frame


def brute(top, params, radius):
    x = top[[f"{p}_norm" for p in params]].to_numpy()
    w = top["window_id"].to_numpy()
    d = np.sqrt(sum((x[:, None, k] - x[None, :, k]) ** 2 for k in range(len(params))))
    return [len({w[j] for j in np.flatnonzero(d[i] <= radius)} - {w[i]}) for i in range(len(top))]


@pytest.mark.parametrize("n, spread", [(40, 1.0), (400, 0.5), (1500, 3.0)])
@pytest.mark.parametrize("params", [cl.PARAMS4, cl.PARAMS3])
def test_neighbours_equal_brute_force(spark, n, spread, params):
    pdf = log(np.random.default_rng(n), n, spread=spread)
    norm = cl.minmax_normalise(spark.createDataFrame(pdf, SCHEMA), params)
    radius = 0.35 if len(params) == 4 else 0.30
    got = cl.neighbour_windows(norm, radius, params).toPandas()
    assert len(got) == len(pdf)
    assert got["nearby_windows"].tolist() == brute(got, params, radius)


def test_single_window_gives_a_typed_empty_table(spark):
    pdf = log(np.random.default_rng(1), 30, windows=1)
    trials = spark.createDataFrame(pdf, SCHEMA)
    top = cl.top_quantile_per_window(cl.minmax_normalise(trials))
    stable = cl.stable_points(cl.neighbour_windows(top, 0.35), trials)
    assert stable.count() == 0
    centre = cl.cluster_centre(stable)
    assert centre.count() == 0 and centre.schema["ma_window"].dataType.typeName() == "integer"


def test_constant_parameter_normalises_to_zero(spark):
    pdf = log(np.random.default_rng(2), 30)
    pdf["ma_window"] = 50
    got = cl.minmax_normalise(spark.createDataFrame(pdf, SCHEMA)).toPandas()
    assert (got["ma_window_norm"] == 0).all()
    assert got["sl_pct_norm"].between(0, 1).all()


def test_quantile_keeps_ties_and_rejected_go(spark):
    rows = [(1, 10, 5, 2, 1 + i, s) for i, s in enumerate((-999.0, 1.0, 2.0, 2.0, 2.0))]
    trials = spark.createDataFrame(rows, SCHEMA)
    assert cl.valid_trials(trials).count() == 4
    assert cl.valid_trials(trials, keep_rejected=True).count() == 5
    top = cl.top_quantile_per_window(cl.valid_trials(trials))
    assert top.count() == 3 and top.agg(F.min("score")).first()[0] == 2.0


def test_centre_prefers_green_and_truncates(spark):
    rows = [(25, 8, 4, 2, "green"), (30, 9, 6, 4, "green"), (500, 100, 40, 15, "orange")]
    stable = spark.createDataFrame(rows, "ma_window int, atr_window int, mult_x4 int, sl_pct int, colour string")
    got = cl.cluster_centre(stable).first()
    assert (got["colour"], got["ma_window"], got["atr_window"], got["mult_x4"]) == ("green", 27, 8, 5.0)


def test_keys_are_analysed_apart(spark):
    frames = {k: log(np.random.default_rng(i), 120, windows=4) for i, k in enumerate("ab")}
    both = pd.concat([f.assign(symbol=k) for k, f in frames.items()])
    keyed = spark.createDataFrame(both, SCHEMA + ", symbol string")
    keys = ["symbol"]

    def centre(df, keys=()):
        top = cl.top_quantile_per_window(cl.minmax_normalise(df, keys=keys), keys=keys)
        near = cl.neighbour_windows(top, 0.35, keys=keys)
        return cl.cluster_centre(cl.stable_points(near, df, keys=keys), keys=keys)

    got = centre(keyed, keys).toPandas().set_index("symbol")
    for k, f in frames.items():
        want = centre(spark.createDataFrame(f, SCHEMA)).first().asDict()
        assert got.loc[k].to_dict() == want
