"""composite_score: ties that sums of doubles take to either side, and figures that are no cents."""

import math
from fractions import Fraction

import duckdb
import pytest

from bandwalk.catalog import REGISTRY
from tests.helpers import np, pd
from tools.compare import compare

QUERY = REGISTRY["composite_score"]
SCHEMA = "l_returnflag string, l_suppkey bigint, l_discount double, l_tax double, l_quantity double"


def in_cents(flag, supplier, discounts, taxes, quantities):
    return pd.DataFrame({
        "l_returnflag": flag, "l_suppkey": supplier,
        "l_discount": np.array(discounts) / 100, "l_tax": np.array(taxes) / 100, "l_quantity": np.array(quantities) / 1.0,
    })


def exact_score(discounts, taxes, quantities):
    n = len(discounts)
    drawdown = Fraction(6 * sum(discounts), 100 * n)
    if n < 30 or drawdown > Fraction(3, 10):
        return -999.0
    score = Fraction(7, 10) * Fraction(sum(taxes), 100) + Fraction(3, 10) * Fraction(sum(quantities), 100 * n) * (1 - drawdown)
    return float(Fraction(math.ceil(score * 10**8 - Fraction(1, 2)), 10**8))


def scores(spark, rows, path, files):
    spark.createDataFrame(rows).repartition(files).write.parquet(f"{path}/lineitem.parquet")
    return {(r[0], r[1]): r[2] for r in QUERY.run(spark, str(path)).collect()}


def tied_groups():
    """Groups whose mean discount is 5 %, one just over, and groups whose score is halfway at the ninth digit."""
    rng = np.random.default_rng(5)
    out = {}
    for supplier in range(40):
        half = rng.integers(0, 11, int(rng.integers(20, 700))).tolist()
        discounts = half + [10 - d for d in half]
        out["A", supplier] = discounts, rng.integers(0, 9, len(discounts)).tolist(), rng.integers(1, 51, len(discounts)).tolist()
    over = out["A", 0]
    out["N", 0] = [over[0][0] + 1, *over[0][1:]], *over[1:]
    while len(out) < 61:
        discounts, taxes, quantities = (rng.integers(0, top, 200).tolist() for top in (10, 9, 51))
        score = Fraction(3, 10) * Fraction(sum(quantities), 20000) * (1 - Fraction(6 * sum(discounts), 20000)) * 10**8
        if score.denominator == 2:
            out["R", len(out)] = discounts, taxes, quantities
    return out


@pytest.mark.parametrize("files", [1, 7])
def test_ties_do_not_depend_on_row_order(spark, tmp_path, files):
    groups = tied_groups()
    want = {key: exact_score(*figures) for key, figures in groups.items()}
    assert want["A", 0] > 0 and want["N", 0] == -999.0
    rows = pd.concat([in_cents(*key, *figures) for key, figures in groups.items()])
    for seed in range(2):
        assert scores(spark, rows.sample(frac=1, random_state=seed), tmp_path / str(seed), files) == want


def test_other_figures_equal_sql(spark, tmp_path):
    rng = np.random.default_rng(6)
    cents = [rng.integers(0, 6, 40) / 100 for _ in range(3)]
    none, thousandths = [None] * 40, rng.integers(0, 45, 40) / 1000
    long = rng.uniform(0, 0.04, 40)

    def but(values, odd):
        return [odd, *values[1:]]

    cases = [
        cents, [thousandths, long, long], [long, thousandths, -long], [none, none, none], [none, *cents[1:]],
        [cents[0], none, cents[2]], [but(cents[0], None), but(cents[1], None), but(cents[2], None)],
        [but(cents[0], math.nan), *cents[1:]], [cents[0], but(cents[1], math.nan), cents[2]],
        [cents[0], but(cents[1], 1e300), but(long, -1e25)], [cents[0], cents[1] * 0 + 9e19, cents[2] * 0 + 3e7],
        [-cents[0], -cents[1], -cents[2]], [cents[0][:29], cents[1][:29], cents[2][:29]],
    ]
    rows = [("A", k, *(None if v is None else float(v) for v in row)) for k, case in enumerate(cases) for row in zip(*case)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    verdict = compare(spark, con, "composite_score", QUERY.run, QUERY.sql, str(tmp_path))
    assert verdict.startswith(f"ok    composite_score: {len(cases)} rows") and "TYPES" not in verdict, verdict


def test_empty_table_has_no_scores(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert QUERY.run(spark, str(tmp_path)).collect() == []
