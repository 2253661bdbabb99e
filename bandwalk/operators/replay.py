"""Backtests with a stop, for many parameter combinations at once.

The stop makes a trade's exit depend on its own entry price, which no window
expression can state. Spark cuts every series into blocks, spreads (block, group of
combinations) over tasks and merges the block summaries; inside a task ``walk`` goes from
trade to trade, with all combinations of the group held in arrays.

A block starts ``runup`` bars early from a flat position. A bar that forces every
position shut makes the state independent of the past, so a combination that meets
one during the run-up is exact from there. For the rest, each block's leaving state is
found as a function of its entering state; these functions are composed along the series
by pointer doubling, and the blocks are replayed once more, all together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from bandwalk.defaults import (
    COMBOS_PER_TASK,
    DEFAULTS,
    REPLAY_BLOCK_BARS,
    REPLAY_RUNUP_BARS,
)
from bandwalk.operators.backtest import annual_scale
from bandwalk.operators.indicators import true_range_of
from bandwalk.operators.series import (
    KEYS,
    blocks_until_vanished,
    exponential,
    overlapping_blocks,
    seeded_weight,
)
from bandwalk.operators.signals import fill_price, signals
from bandwalk.operators.walk import Bars, Steps, Walkers, flags_of, given_flags, transitions, walk
from bandwalk.session import settled, wide

MERGE_BLOCKS = 4_096  # block summaries folded at a time
MOST_COMBOS = 100_000  # combinations sent to the tasks (a few MB); longer lists travel as rows
PARAMS = ("ma_window", "atr_window", "atr_mult", "sl_stop")
FLAGGED = ("long_entry", "long_exit", "short_entry", "short_exit", "px")


@dataclass(frozen=True)
class ReplayConfig:
    ma_kind: str = "ema"  # or "sma"
    atr_kind: str = "wilder"  # or "simple"
    size: float = DEFAULTS.size
    fees: float = DEFAULTS.fees
    init_cash: float = DEFAULTS.init_cash
    block_bars: int = REPLAY_BLOCK_BARS
    runup: int = REPLAY_RUNUP_BARS
    combos_per_task: int = COMBOS_PER_TASK
    max_window: int = 0  # at least the longest window of the parameters

    @property
    def lead(self) -> int:
        """Bars a block sees before its first own bar: one at least, whose close is its first mark."""
        rolling = "sma" in self.ma_kind or self.atr_kind == "simple"
        return max(self.runup, self.max_window + 1) if rolling else max(self.runup, 1)


STATE = [
    T.StructField("resolved", T.BooleanType()),
    T.StructField("out_side", T.IntegerType()),
    T.StructField("out_px", T.DoubleType()),
    T.StructField("out_pos", T.LongType()),
]
SUMMARY = [
    T.StructField(name, T.DoubleType())
    for name in ("growth", "high", "low", "drop", "n", "mean", "m2", "trades", "closed", "wins", "fees")
]
TRADES = T.ArrayType(
    T.StructType(
        [T.StructField("side", T.IntegerType()), T.StructField("entry_pos", T.LongType())]
        + [T.StructField(n, T.DoubleType()) for n in ("entry_px", "exit_px", "ret")]
        + [T.StructField("exit_pos", T.LongType()), T.StructField("reason", T.StringType())]
    )
)


def carry_table(
    series: DataFrame, params: DataFrame, cfg: ReplayConfig, keys: Sequence[str] = KEYS
) -> DataFrame:
    """State of every distinct recursive mean just before each block's run-up.

    Rows (key, blk >= 1, kind, n, carry). The weighted sums are combined map-side.
    """
    keys = list(keys)
    wanted = []
    if cfg.ma_kind == "ema":
        wanted.append(("ma", "ma_window", "close", lambda n: 2.0 / (n + 1)))
    if cfg.atr_kind == "wilder":
        wanted.append(("atr", "atr_window", "tr", lambda n: 1.0 / n))
    if not wanted:
        return None
    # One row: the distinct windows of the grid (a grid axis, never data sized).
    axes = params.agg(*[F.collect_set(col).alias(kind) for kind, col, _, _ in wanted])
    # Cell c covers the bars between the run-up starts of blocks c and c + 1.
    cell = F.floor((F.col("pos") + cfg.lead) / cfg.block_bars)
    last = F.least((cell + 1) * cfg.block_bars - cfg.lead, F.col("len")) - 1
    order = Window.partitionBy(*keys, "blk").orderBy("pos")
    ranged = (
        overlapping_blocks(series.filter(F.col("len") > cfg.block_bars), 1, cfg.block_bars)
        .withColumn("tr", true_range_of(order))
        .filter("own")
        .withColumns({f"_{kind}": axes.select(kind).scalar() for kind, *_ in wanted})
    )

    def entries(kind: str, source: str, alpha) -> Column:
        return F.transform(
            f"_{kind}",
            lambda n: F.struct(
                F.lit(kind).alias("kind"),
                n.alias("n"),
                alpha(n.cast("double")).alias("alpha"),
                F.col(source).alias("x"),
            ),
        )

    entry = F.explode(F.concat(*[entries(kind, src, alpha) for kind, _, src, alpha in wanted]))
    sums = (
        ranged.select(*keys, "pos", cell.alias("cell"), last.alias("last"), entry.alias("e"))
        .groupBy(*keys, "cell", F.col("e.kind").alias("kind"), F.col("e.n").alias("n"))
        .agg(
            F.sum(seeded_weight(F.col("e.alpha"), F.col("pos"), F.col("last")) * F.col("e.x")).alias("s"),
            F.first("e.alpha").alias("alpha"),
        )
    )
    reach = blocks_until_vanished(1.0 / cfg.max_window, cfg.block_bars)
    past = F.collect_list("s").over(
        Window.partitionBy(*keys, "kind", "n").orderBy("cell").rowsBetween(-(reach - 1), 0)
    )
    decay = F.pow(1 - F.col("alpha"), F.lit(cfg.block_bars))
    return sums.select(
        *keys,
        (F.col("cell") + 1).cast("long").alias("blk"),
        "kind",
        "n",
        F.aggregate(past, F.lit(0.0), lambda acc, s: acc * decay + s).alias("carry"),
    )


def wide_carries(series: DataFrame, windows: dict[str, list[int]], cfg: ReplayConfig, keys: Sequence[str] = KEYS) -> DataFrame:
    """(key, blk >= 1, ma, atr): the state of each window's recursive mean before the block's run-up, one array per kind.

    As ``carry_table``, with one column per window instead of one row per bar and window.
    """
    keys = list(keys)
    cell = F.floor((F.col("pos") + cfg.lead) / cfg.block_bars)
    last = F.least((cell + 1) * cfg.block_bars - cfg.lead, F.col("len")) - 1
    order = Window.partitionBy(*keys, "blk").orderBy("pos")
    ranged = (
        overlapping_blocks(series.filter(F.col("len") > cfg.block_bars), 1, cfg.block_bars)
        .withColumn("tr", true_range_of(order))
        .filter("own")
        .withColumns({"_cell": cell, "_last": last})
    )
    alphas = {"ma": lambda n: 2.0 / (n + 1), "atr": lambda n: 1.0 / n}
    source = {"ma": "close", "atr": "tr"}
    columns = [(f"_{kind}_{n}", alphas[kind](n), source[kind]) for kind in windows for n in windows[kind]]
    sums = ranged.groupBy(*keys, "_cell").agg(
        *[F.sum(seeded_weight(F.lit(alpha), F.col("pos"), F.col("_last")) * F.col(x)).alias(name) for name, alpha, x in columns])
    reach = blocks_until_vanished(1.0 / cfg.max_window, cfg.block_bars)
    past = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(-(reach - 1), 0)

    def carry(name: str, alpha: float) -> Column:
        decay = (1 - alpha) ** cfg.block_bars
        return F.aggregate(F.collect_list(name).over(past), F.lit(0.0), lambda acc, x: acc * decay + x).alias(name)

    carried = sums.select(*keys, (F.col("_cell") + 1).cast("long").alias("blk"), *[carry(name, alpha) for name, alpha, _ in columns])
    return carried.select(*keys, "blk", *[
        F.array(*[F.col(f"_{kind}_{n}") for n in windows.get(kind, [])]).cast("array<double>").alias(kind) for kind in ("ma", "atr")])


def _lagged_bank(bars: pd.DataFrame, work: pd.DataFrame, start: int, cfg: ReplayConfig):
    """Mid and ATR known before each bar, one row per distinct window."""
    close = bars["close"].to_numpy()
    before = np.concatenate([[np.nan], close[:-1]])
    high, low = bars["high"].to_numpy(), bars["low"].to_numpy()
    tr = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
    skip = 1 if start > 0 else 0  # the first row only supplies the previous close

    def lines(column: str, carry: str, x: np.ndarray, recursive, alpha):
        windows, index = np.unique(work[column].to_numpy(), return_inverse=True)
        heads = work.groupby(column)[carry].first()
        rows = []
        for n in windows:
            n = int(n)
            if recursive:
                head = float(heads[n]) if start > 0 else None
                rows.append(exponential(x[skip:], alpha(n), n, start, head, True))
            else:
                mean = pd.Series(x[skip:]).rolling(n).mean().to_numpy()
                rows.append(np.concatenate([[np.nan], mean[:-1]]))
        return np.ascontiguousarray(np.array(rows).T), index

    mid = lines("ma_window", "carry_ma", close, cfg.ma_kind == "ema", lambda n: 2.0 / (n + 1))
    atr = lines("atr_window", "carry_atr", tr, cfg.atr_kind == "wilder", lambda n: 1.0 / n)
    return mid, atr, skip


BAND_CELLS = 1 << 20  # bars x bands whose signals are held together
MARK_CELLS = 1 << 18  # bars x combinations whose equity is held together


def _banded(bars: pd.DataFrame, work: pd.DataFrame, cfg: ReplayConfig):
    """(bars, first own bar, its position, slices): the combinations of ``work`` with the signals of their bands.

    A slice is (rows of ``work``, band of each, function of the first bar to the signals from it on).
    Combinations that differ only in the stop share a band. Bars that carry their own flags have one.
    """
    own = int(work["blk"].iloc[0]) * cfg.block_bars
    start = max(0, own - cfg.lead)
    if FLAGGED[0] in bars.columns:
        given = [bars[c].to_numpy()[:, None] for c in FLAGGED]
        every = np.arange(len(work)), np.zeros(len(work), np.int64), lambda a: given_flags(*(x[a:] for x in given))
        return Bars(*(bars[c].to_numpy() for c in ("open", "high", "low", "close"))), own - start, start, [every]
    (mids, mi), (atrs, ai), skip = _lagged_bank(bars, work, start, cfg)
    walked = Bars(*(bars[c].to_numpy()[skip:] for c in ("open", "high", "low", "close")))
    bands, band = np.unique(
        np.column_stack([mi, ai, work["atr_mult"].to_numpy(dtype=float)]), axis=0, return_inverse=True
    )
    band = band.ravel()
    order = np.argsort(band, kind="stable")
    step = max(1, BAND_CELLS // max(1, len(walked)))

    def slices():
        for low in range(0, len(bands), step):
            part = bands[low : low + step]
            rows = order[slice(*np.searchsorted(band[order], [low, low + step]))]
            mid, width = mids[:, part[:, 0].astype(int)], part[:, 2] * atrs[:, part[:, 1].astype(int)]
            yield rows, band[rows] - low, lambda a, m=mid, w=width: flags_of(m[a:], w[a:], walked.high[a:], walked.low[a:])

    return walked, own - start, start, slices()


def replay_block(
    bars: pd.DataFrame, work: pd.DataFrame, cfg: ReplayConfig, log: bool = False
) -> pd.DataFrame:
    """Walk one block once; returns one row per combination, in the order of ``work``."""
    bars = bars.sort_values("pos", ignore_index=True)
    walked, first, start, slices = _banded(bars, work, cfg)
    seeded = bool(work["seeded"].iloc[0])
    parts = []
    for rows, band, flags_from in slices:
        flags = flags_from(0)
        n, mine = len(rows), work.iloc[rows]
        side, px, pos = np.zeros(n, np.int64), np.ones(n), np.zeros(n, np.int64)
        exact = np.full(n, start == 0 or seeded)
        if seeded:
            side = mine["in_side"].to_numpy(dtype=np.int64)
            px = np.where(side != 0, mine["in_px"].to_numpy(dtype=float), 1.0)
            pos = mine["in_pos"].to_numpy(dtype=np.int64)
        else:
            # a rolling mean that the run-up has not filled yet says nothing about the bar
            exact |= flags.shut[:first].any(axis=0)[band]
        begin = np.full(n, first if seeded else 0, np.int64)
        stop = mine["sl_stop"].to_numpy(dtype=float)
        left, steps = walk(walked, flags, Walkers(band, stop, side, px, pos, begin), start)
        step = max(1, MARK_CELLS // max(1, len(walked) - first))
        for low in range(0, n, step):
            high = min(low + step, n)
            a, b = np.searchsorted(steps.walker, [low, high])
            some = Steps(*(x[a:b] for x in steps))._replace(walker=steps.walker[a:b] - low)
            out = _summaries(walked, some, Walkers(*(x[low:high] for x in left)), first, start, cfg, log,
                             int(bars["len"].iloc[0]))
            out.insert(0, "resolved", exact[low:high])
            out.insert(0, "combo_id", mine["combo_id"].to_numpy()[low:high])
            out.index = rows[low:high]
            parts.append(out)
    return pd.concat(parts).sort_index()


def _summaries(
    bars: Bars, steps: Steps, left: Walkers, first: int, start: int, cfg: ReplayConfig, log: bool, length: int
) -> pd.DataFrame:
    """Equity of each walker over the bars from ``first`` on, relative to the mark one bar before."""
    n, size, fees = len(left.side), cfg.size, cfg.fees
    close = bars.close[first:]
    count = len(close)
    # trades that end here, and the one still open, as (walker, side, entry, exit)
    here = steps.exit >= first
    who, side, pos, p_in, leave, p_out, stopped = (x[here] for x in steps)
    still = np.flatnonzero(left.side)
    owner = np.concatenate([who, still])
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    side, pos, p_in = (np.concatenate(x)[order] for x in ((side, left.side[still]), (pos, left.pos[still]), (p_in, left.px[still])))
    closes = np.concatenate([np.ones(len(who), bool), np.zeros(len(still), bool)])[order]
    leave, p_out = (np.concatenate([x, np.zeros(len(still), x.dtype)])[order] for x in (leave - first, p_out))
    enter = pos - start - first  # before 0: held when the block began
    trades = len(owner)
    # equity at the start, and after each closed trade
    lead = np.ones(trades, bool)
    lead[1:] = owner[1:] != owner[:-1]
    base0 = np.ones(n)
    held = lead & (enter < 0)
    if first + start > 0 and held.any():
        mark = 1 + size * (side[held] * (bars.close[first - 1] / p_in[held] - 1) - fees)
        base0[owner[held]] = np.where(mark > 0, 1 / np.where(mark > 0, mark, 1.0), 1.0)
    ratio = np.where(closes, p_out / p_in, 1.0)
    ret = np.where(closes, size * (side * (ratio - 1) - fees - fees * ratio), 0.0)
    base = _compounded(base0[owner], np.maximum(1 + ret, 0.0), lead)  # at the entry of each trade
    after = base * np.maximum(1 + ret, 0.0)
    # marks are a + b * close: one piece while a position is held, one while there is none
    piece_at = np.concatenate([np.maximum(enter, 0), leave[closes]])
    piece_of = np.concatenate([owner, owner[closes]])
    piece_a = np.concatenate([base * (1 - size * side - size * fees), after[closes]])
    piece_b = np.concatenate([base * size * side / p_in, np.zeros(int(closes.sum()))])
    # of two pieces at one bar, an exit comes before the entry of the trade after it
    nth = np.concatenate([2 * np.arange(trades), 2 * np.flatnonzero(closes) + 1])
    order = np.lexsort((nth, piece_of))
    piece_at, piece_of, piece_a, piece_b = (x[order] for x in (piece_at, piece_of, piece_a, piece_b))
    changes = np.bincount(piece_of * count + piece_at, minlength=n * count).reshape(n, count)
    begins = np.searchsorted(piece_of, np.arange(n)) + np.arange(n)
    index = np.cumsum(changes, axis=1) + begins[:, None]
    all_a, all_b = np.empty(len(piece_a) + n), np.zeros(len(piece_a) + n)
    place = np.arange(len(piece_a)) + piece_of + 1
    all_a[begins], all_a[place], all_b[place] = base0, piece_a, piece_b
    marks = all_a[index] + all_b[index] * close
    # ruined: equity stays at zero
    broke = marks <= 0
    dead = np.where(broke.any(axis=1), broke.argmax(axis=1), count)
    marks[np.arange(count) >= dead[:, None]] = 0.0
    before = np.column_stack([np.ones(n), marks[:, :-1]])
    r = np.divide(marks, before, out=np.ones_like(marks), where=before > 0) - 1
    s1, s2 = r.sum(axis=1), np.einsum("ij,ij->i", r, r)
    peaks = np.maximum(np.maximum.accumulate(marks, axis=1), 1.0)
    # what happens up to the bar of ruin counts
    opens, ends = (enter >= 0) & (enter <= dead[owner]), closes & (leave <= dead[owner])

    def total(where: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(owner[where], None if weight is None else weight[where], n).astype(float)

    paid = total(opens, base * size * fees) + total(ends, base * size * fees * ratio)
    out = pd.DataFrame(
        {
            "out_side": left.side.astype(np.int32),
            "out_px": np.where(left.side != 0, left.px, np.nan),
            "out_pos": np.where(left.side != 0, left.pos, 0),
            "growth": marks[:, -1], "high": peaks[:, -1], "low": np.minimum(marks.min(axis=1), 1.0),
            "drop": (1 - marks / peaks).max(axis=1), "n": float(count),
            "mean": s1 / count, "m2": np.maximum(s2 - s1 * s1 / count, 0.0),
            "trades": total(opens), "closed": total(ends), "wins": total(ends & (ret > 0)), "fees": paid,
        }
    )
    if log:
        reason = np.where(stopped, "stop", "signal")
        columns = {"side": side[closes], "entry_pos": pos[closes], "entry_px": p_in[closes], "exit_px": p_out[closes],
                   "ret": ret[closes], "exit_pos": leave[closes] + first + start, "reason": reason}
        out["log"] = _trade_log(columns, owner[closes], n)
        if start + len(bars) >= length:  # a trade still open at the end of the series is marked
            for i in still:
                s, p = int(left.side[i]), float(left.px[i])
                mark = size * (s * (close[-1] / p - 1) - fees)
                out.at[i, "log"].append(
                    {"side": s, "entry_pos": int(left.pos[i]), "entry_px": p, "exit_px": float(close[-1]), "ret": float(mark),
                     "exit_pos": start + len(bars) - 1, "reason": "open"})
    return out


def _compounded(first: np.ndarray, factor: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """first, then first times all factors before, restarting at every ``lead``."""
    row = np.cumsum(lead) - 1
    starts = np.flatnonzero(lead)
    nth = np.arange(len(factor)) - starts[row]
    grid = np.ones((len(starts), int(nth.max(initial=0)) + 2))
    grid[:, 0] = first[starts]
    grid[row, nth + 1] = factor
    return np.cumprod(grid, axis=1)[row, nth]


def _trade_log(columns: dict[str, np.ndarray], owner: np.ndarray, n: int) -> list[list[dict]]:
    """Closed trades per walker."""
    per: list[list[dict]] = [[] for _ in range(n)]
    for i, *trade in zip(owner.tolist(), *(c.tolist() for c in columns.values())):
        per[i].append(dict(zip(columns, trade)))
    return per


def partitions(spark: SparkSession, n_groups: int) -> int:
    """Enough tasks for every core; with many (block, bucket) groups about eight per task."""
    return max(wide(spark), n_groups // 8)


def _replay(
    blocks: DataFrame, work: DataFrame, keys: list[str], cfg: ReplayConfig, log: bool, n: int
) -> DataFrame:
    """Run every (block, group of combinations) of ``work`` in its own task."""
    group = [*keys, "blk", "bucket"]
    # Bars go only where work is waiting for them.
    tasks = work.select(*[F.col(c).alias(c) for c in group]).distinct()
    bars = blocks.join(tasks, [*keys, "blk"])
    fields = [f for f in work.schema.fields if f.name in (*keys, "blk", "bucket")]
    fields = sorted(fields, key=lambda f: group.index(f.name))
    schema = T.StructType(
        fields
        + [work.schema["combo_id"]]
        + STATE
        + SUMMARY
        + ([T.StructField("log", TRADES)] if log else [])
    )
    names = schema.fieldNames()

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({f: pd.Series(dtype="object") for f in names})
        right = right.sort_values("combo_id", ignore_index=True)
        out = replay_block(left, right, cfg, log)
        for name, value in zip(group, key):
            out[name] = value
        return out[names]

    return (
        bars.repartition(n, *group)
        .groupBy(*group)
        .cogroup(work.repartition(n, *group).groupBy(*group))
        .applyInPandas(run, schema)
    )


def _replay_listed(
    series: DataFrame, params: DataFrame, combos: pd.DataFrame, cfg: ReplayConfig, keys: list[str], log: bool
) -> DataFrame:
    """Block summaries where every series has the same combinations: what moves is bars and one carry row per block."""
    combos = combos.sort_values("combo_id", ignore_index=True)
    cfg = replace(cfg, max_window=max(cfg.max_window, 1, *(int(combos[c].max()) for c in ("ma_window", "atr_window") if len(combos))))
    recursive = {"ma": ("ma_window", cfg.ma_kind == "ema"), "atr": ("atr_window", cfg.atr_kind == "wilder")}
    windows = {kind: sorted({int(x) for x in combos[column]}) for kind, (column, used) in recursive.items() if used}
    series = series.select(*keys, "pos", "len", "open", "high", "low", "close")
    blocks = overlapping_blocks(series, cfg.lead + 1, cfg.block_bars).drop("own")
    lengths = series.groupBy(*keys).agg(F.max("len").alias("len"))
    longest, n_blocks = lengths.agg(F.max("len"), F.sum(F.ceil(F.col("len") / cfg.block_bars))).first()
    buckets = max(1, -(-len(combos) // cfg.combos_per_task))
    n = partitions(series.sparkSession, int(n_blocks or 0) * buckets)
    group = [*keys, "blk", "bucket"]
    schema = T.StructType(
        [series.schema[k] for k in keys]
        + [T.StructField("blk", T.LongType()), T.StructField("bucket", T.IntegerType()), params.schema["combo_id"]]
        + STATE + SUMMARY + ([T.StructField("log", TRADES)] if log else []))
    names = schema.fieldNames()

    def done_of(key, bars, carries):
        low = key[-1] * cfg.combos_per_task
        work = combos.iloc[low : low + cfg.combos_per_task].assign(blk=key[-2], seeded=False, carry_ma=np.nan, carry_atr=np.nan)
        if len(carries):
            for kind, of in windows.items():
                at = np.searchsorted(of, work[recursive[kind][0]].to_numpy())
                work[f"carry_{kind}"] = np.asarray(carries[kind].iloc[0], float)[at]
        out = replay_block(bars, work, cfg, log)
        for name, value in zip(group, key):
            out[name] = value
        return out[names]

    def spread(frame: DataFrame) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))) if buckets > 1 else F.lit(0)
        return frame.withColumn("bucket", every).repartition(n, *group)

    carries = None
    if windows and (longest or 0) > cfg.block_bars:
        carries = settled(wide_carries(series, windows, cfg, keys))

        def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return done_of(key, left, right) if len(left) else pd.DataFrame({f: pd.Series(dtype="object") for f in names})

        made = spread(blocks).groupBy(*group).cogroup(spread(carries).groupBy(*group)).applyInPandas(run, schema)
    else:
        made = spread(blocks).groupBy(*group).applyInPandas(lambda key, bars: done_of(key, bars, ()), schema)
    done = settled(made)
    pending = done.filter(~F.col("resolved"))
    if pending.isEmpty():
        return done
    work = pending.select(*keys, "blk", "bucket", "combo_id").join(params.select("combo_id", *PARAMS), "combo_id")
    if carries is not None:
        work = work.join(carries, [*keys, "blk"], "left")
    for kind, (column, _) in recursive.items():
        if kind in windows and carries is not None:
            place = F.array_position(F.array(*[F.lit(w) for w in windows[kind]]), F.col(column).cast("int"))
            value = F.get(F.col(kind), (place - 1).cast("int"))
        else:
            value = F.lit(None).cast("double")
        work = work.withColumn(f"carry_{kind}", value)
    return _resolve(blocks, work, done, keys, cfg, log)


def replay_blocks(
    series: DataFrame, params: DataFrame, cfg: ReplayConfig = ReplayConfig(),
    keys: Sequence[str] = KEYS, log: bool = False,
) -> DataFrame:
    """Block summaries (key, blk, combo_id, ...), all of them exact.

    ``series`` carries ``pos`` and ``len`` per key and is read a few times, so it should
    be a stored table or a cheap step on one. ``params`` has ``combo_id`` and the
    four parameters, plus any of the key columns when combinations differ per key.
    """
    keys = list(keys)
    if not any(k in params.columns for k in keys):
        # one list of combinations for all series, sent to the tasks if it is small
        sent = params.select("combo_id", *PARAMS).limit(MOST_COMBOS + 1).toPandas()
        if 0 < len(sent) <= MOST_COMBOS:
            return _replay_listed(series, params, sent, cfg, keys, log)
    longest = params.agg(F.max(F.greatest("ma_window", "atr_window"))).first()[0] or 1
    cfg = replace(cfg, max_window=max(cfg.max_window, int(longest)))
    shared = [k for k in keys if k in params.columns]
    series = series.select(*keys, "pos", "len", "open", "high", "low", "close")
    blocks = overlapping_blocks(series, cfg.lead + 1, cfg.block_bars).drop("own")
    # One row per block: bars / block_bars rows, so counting them is cheap.
    spans = settled(
        series.groupBy(*keys)
        .agg(F.max("len").alias("len"))
        .select(
            *keys,
            F.explode(
                F.sequence(F.lit(0).cast("long"), F.floor((F.col("len") - 1) / cfg.block_bars))
            ).alias("blk"),
        )
    )
    chosen = params.select(
        *shared,
        *PARAMS,
        "combo_id",
        F.floor(F.col("combo_id") / cfg.combos_per_task).cast("int").alias("bucket"),
    )
    if shared:
        work = spans.join(chosen, shared)
    else:
        last = chosen.agg(F.max("bucket").alias("b")).scalar()
        work = spans.withColumn("bucket", F.explode(F.sequence(F.lit(0), last))).join(chosen, "bucket")
    carries = carry_table(series, params, cfg, keys)
    for kind, column in (("ma", "ma_window"), ("atr", "atr_window")):
        name = f"carry_{kind}"
        if carries is None:
            work = work.withColumn(name, F.lit(None).cast("double"))
            continue
        part = carries.filter(F.col("kind") == kind).select(
            *keys, "blk", F.col("n").alias(column), F.col("carry").alias(name)
        )
        work = work.join(part, [*keys, "blk", column], "left")
    work = work.withColumns(
        {
            "seeded": F.lit(False),
            "in_side": F.lit(0),
            "in_px": F.lit(None).cast("double"),
            "in_pos": F.lit(0).cast("long"),
        }
    )
    work = settled(work)
    n = partitions(work.sparkSession, work.select(*keys, "blk", "bucket").distinct().count())
    done = settled(_replay(blocks, work, keys, cfg, log, n))
    pending = done.filter(~F.col("resolved"))
    if pending.isEmpty():
        return done
    return _resolve(blocks, work, done, keys, cfg, log)


PIECE = T.StructType([
    T.StructField("level", T.DoubleType()), T.StructField("held", T.BooleanType()), T.StructField("side", T.IntegerType()),
    T.StructField("px", T.DoubleType()), T.StructField("pos", T.LongType()),
])
FUNCTION = [T.StructField("flat", PIECE), T.StructField("longs", T.ArrayType(PIECE)), T.StructField("shorts", T.ArrayType(PIECE))]


def block_transitions(blocks: DataFrame, work: DataFrame, keys: list[str], cfg: ReplayConfig, n: int) -> DataFrame:
    """(key, blk, combo_id, sl_stop, flat, longs, shorts): what each block of ``work`` makes of any entering state.

    See ``walk.transitions``. A function has a piece per new low or high of the block at most,
    and neighbours that lead to one state are merged.
    """
    group = [*keys, "blk", "bucket"]
    fields = [work.schema[f] for f in (*keys, "blk", "combo_id", "sl_stop")]
    schema = T.StructType(fields + FUNCTION)
    names = schema.fieldNames()

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({f: pd.Series(dtype="object") for f in names})
        left = left.sort_values("pos", ignore_index=True)
        walked, first, start, slices = _banded(left, right, cfg)
        own = Bars(*(x[first:] for x in (walked.open, walked.high, walked.low, walked.close)))
        parts = []
        for rows, band, flags_from in slices:
            flags = flags_from(first)
            some = right.iloc[rows][["combo_id", "sl_stop"]].reset_index(drop=True)
            made = transitions(own, flags, band, some["sl_stop"].to_numpy(dtype=float), start + first)
            parts.append(some.assign(**{name: [m[i] for m in made] for i, name in enumerate(("flat", "longs", "shorts"))}))
        out = pd.concat(parts)
        for name, value in zip(group, key):
            out[name] = value
        return out[names]

    bars = blocks.join(work.select(*[F.col(c).alias(c) for c in group]).distinct(), [*keys, "blk"])
    return bars.repartition(n, *group).groupBy(*group).cogroup(work.repartition(n, *group).groupBy(*group)).applyInPandas(run, schema)


def _applied(longs: Column, shorts: Column, flat: Column, state: Column, stop: Column) -> Column:
    """The state that a function leaves when entered in ``state``."""
    price = lambda sign: F.coalesce(sign * (state["px"] * (1 - sign * stop)), F.lit(float("-inf")))
    first = lambda pieces, level: F.get(F.filter(pieces, lambda p: p["level"] <= level), 0)
    piece = F.when(state["side"] > 0, first(longs, price(1))).when(state["side"] < 0, first(shorts, price(-1))).otherwise(flat)
    return F.transform(F.array(piece), lambda p: F.when(p["held"], state).otherwise(p))[0]


def _after(second: list[Column], pieces: Column, mine: Column, stop: Column) -> Column:
    """Pieces of one side, followed by a function (longs, shorts, flat) of which ``mine`` is the same side."""
    ended = F.filter(pieces, lambda p: ~p["held"])
    # a position that is still held meets the second function's levels below those it has outlived
    lowest = F.coalesce(F.array_min(F.transform(ended, lambda p: p["level"])), F.lit(float("inf")))
    onwards = F.transform(ended, lambda p: _applied(*second, p, stop).withField("level", p["level"]))
    later = F.when(F.exists(pieces, lambda p: p["held"]), F.filter(mine, lambda p: p["level"] < lowest)).otherwise(F.array())
    return F.concat(onwards, later)


def leaving_states(functions: DataFrame, known: DataFrame, ids: list[str]) -> tuple[DataFrame, int]:
    """(ids, blk, state) that every block of ``functions`` is left in, and the rounds it took.

    ``known``: (ids, blk, state) of the blocks right before runs of ``functions``. In every round a
    block's function takes in that of the block it hangs on, so the distance bridged doubles
    and a run of n blocks needs about log2(n) rounds, each one join of small rows.
    """
    opens = functions.withColumn("hang", F.col("blk") - 1)
    none = F.lit(None)
    done = known.select(*ids, "blk", "state")
    rounds = 0
    while True:
        rounds += 1
        ends = done.select(
            *ids, F.col("blk").alias("hang"), F.col("state").alias("s"), *[none.cast(f.dataType).alias(f"{f.name}0") for f in FUNCTION],
            none.cast("bigint").alias("hang0"))
        # a block without functions or known state before it lies behind nothing that is open
        links = opens.select(*ids, F.col("blk").alias("next"), none.cast(PIECE).alias("s"),
                             *[F.col(f.name).alias(f"{f.name}0") for f in FUNCTION], F.col("hang").alias("hang0"))
        before = ends.unionByName(links.withColumnRenamed("next", "hang"))
        # own columns get other names than those made of them: inside lambdas a name would mean the new column
        mine = opens.withColumnsRenamed({f.name: f"{f.name}1" for f in FUNCTION} | {"hang": "at"})
        second = [F.col("longs1"), F.col("shorts1"), F.col("flat1")]
        stop = F.col("sl_stop")
        met = F.col("s").isNotNull()
        joined = mine.join(before.withColumnRenamed("hang", "at"), [*ids, "at"]).select(
            *ids, "blk", "sl_stop", F.col("hang0").alias("hang"),
            F.when(met, _applied(*second, F.col("s"), stop)).alias("state"),
            F.when(~met, _applied(*second, F.col("flat0"), stop)).alias("flat"),
            F.when(~met, _after(second, F.col("longs0"), F.col("longs1"), stop)).alias("longs"),
            F.when(~met, _after(second, F.col("shorts0"), F.col("shorts1"), stop)).alias("shorts"))
        step = settled(joined)
        done = done.unionByName(step.filter("state is not null").select(*ids, "blk", "state"))
        opens = step.filter("state is null").drop("state")
        if opens.isEmpty():
            return done, rounds


def _resolve(blocks, work, done, keys: list[str], cfg: ReplayConfig, log: bool) -> DataFrame:
    """Replay the blocks whose run-up met no forced-flat bar from their true state.

    Their transition functions, composed along each run of such blocks, give every entering state at
    once, so there is one replay more whatever the length of the runs.
    """
    ids = [*keys, "combo_id"]
    pending = done.filter(~F.col("resolved")).select(*ids, "blk")
    todo = settled(work.drop("seeded", "in_side", "in_px", "in_pos").join(pending, [*ids, "blk"], "left_semi"))
    n = partitions(todo.sparkSession, todo.select(*keys, "blk", "bucket").distinct().count())
    functions = settled(block_transitions(blocks, todo, keys, cfg, n))
    state = F.struct(F.lit(float("-inf")).alias("level"), F.lit(False).alias("held"), F.col("out_side").alias("side"),
                     F.col("out_px").alias("px"), F.col("out_pos").alias("pos"))
    heads = functions.select(*ids, (F.col("blk") - 1).alias("blk"))
    known = settled(done.filter("resolved").join(heads, [*ids, "blk"], "left_semi").select(*ids, "blk", state.alias("state")))
    left, _ = leaving_states(functions, known, ids)
    entering = left.select(*ids, (F.col("blk") + 1).alias("blk"), F.lit(True).alias("seeded"), F.col("state.side").alias("in_side"),
                           F.col("state.px").alias("in_px"), F.col("state.pos").alias("in_pos"))
    ready = settled(todo.join(entering, [*ids, "blk"]))
    return done.filter("resolved").unionByName(_replay(blocks, ready, keys, cfg, log, n))


def flagged_blocks(
    flagged: DataFrame, stops: Sequence[float | None] = (None,), cfg: ReplayConfig = ReplayConfig(),
    keys: Sequence[str] = KEYS, log: bool = False,
) -> DataFrame:
    """Block summaries (key, blk, combo_id, ...) of any strategy's flags, one per stop (``combo_id`` is its place).

    ``flagged``: ``pos``, ``len``, prices, the four flags and ``px`` per bar; a null flag is false. Bars are
    shuffled once. Entries of the other leg close and turn a position (see ``walk.given_flags``). An
    empty frame gives no rows.
    """
    keys, spark = list(keys), flagged.sparkSession
    cfg = replace(cfg, ma_kind="none", atr_kind="none")
    columns = [*keys, "pos", "len", "open", "high", "low", "close", *(F.coalesce(c, F.lit(False)).alias(c) for c in FLAGGED[:4]), "px"]
    narrow = flagged.select(*columns)
    named = T.StructType([narrow.schema[k] for k in keys] + [T.StructField("blk", T.LongType()), T.StructField("combo_id", T.IntegerType())]
                         + STATE + SUMMARY + ([T.StructField("log", TRADES)] if log else []))
    names = named.fieldNames()

    def run(key, bars):
        work = pd.DataFrame({"combo_id": range(len(stops)), "sl_stop": np.array(stops, float), "blk": key[-1], "seeded": False})
        out = replay_block(bars, work, cfg, log)
        for name, value in zip((*keys, "blk"), key):
            out[name] = value
        return out[names]

    def cut(frame: DataFrame) -> DataFrame:
        return overlapping_blocks(frame, cfg.lead, cfg.block_bars).drop("own")

    done = settled(cut(narrow).groupBy(*keys, "blk").applyInPandas(run, named))
    pending = done.filter(~F.col("resolved"))
    if pending.isEmpty():
        return done
    level = F.element_at(F.array(*[F.lit(s).cast("double") for s in stops]), F.col("combo_id") + 1)
    work = pending.select(*keys, "blk", F.lit(0).alias("bucket"), "combo_id", level.alias("sl_stop"))
    return _resolve(cut(settled(narrow)), work, done.withColumn("bucket", F.lit(0)), keys, cfg, log)


def flagged_metrics(
    flagged: DataFrame, bar_seconds: int | Column, stops: Sequence[float | None] = (None,), cfg: ReplayConfig = ReplayConfig(),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Metrics of a strategy's flags for every stop."""
    return merge_blocks(flagged_blocks(flagged, stops, cfg, keys), bar_seconds, cfg, keys)


MERGED = tuple(f.name for f in SUMMARY)


def _merge(acc: Column, x: Column) -> Column:
    """Append one block summary to the summary of everything before it."""
    live = acc["growth"] > 0
    if_live = lambda v: F.when(live, v).otherwise(0.0)
    n = acc["n"] + x["n"]
    delta = if_live(x["mean"]) - acc["mean"]
    scaled = acc["growth"] * x["low"]
    return F.struct(
        (acc["growth"] * x["growth"]).alias("growth"),
        F.greatest(acc["high"], acc["growth"] * x["high"]).alias("high"),
        F.least(acc["low"], scaled).alias("low"),
        F.greatest(acc["drop"], if_live(x["drop"]), 1 - scaled / acc["high"]).alias("drop"),
        n.alias("n"),
        (acc["mean"] + delta * x["n"] / n).alias("mean"),
        (acc["m2"] + if_live(x["m2"]) + delta * delta * acc["n"] * x["n"] / n).alias("m2"),
        (acc["trades"] + if_live(x["trades"])).alias("trades"),
        (acc["closed"] + if_live(x["closed"])).alias("closed"),
        (acc["wins"] + if_live(x["wins"])).alias("wins"),
        (acc["fees"] + acc["growth"] * x["fees"]).alias("fees"),
    )


def merge_blocks(
    summaries: DataFrame, bar_seconds: int | Column, cfg: ReplayConfig = ReplayConfig(),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Block summaries to one metrics row per (key, combination).

    Summaries are shuffled once by (key, combination) and folded in two levels: runs of
    ``MERGE_BLOCKS`` blocks, then the runs. A run is 33 million bars, so the second list has
    one entry for any series so far and a few thousand for the longest thinkable one.
    """
    keys = [*keys, "combo_id"]
    zero = F.struct(
        *[F.lit(1.0 if c in ("growth", "high", "low") else 0.0).alias(c) for c in MERGED]
    )

    def fold(df: DataFrame, by: list[str], order: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(order, *MERGED)))
        return (
            df.groupBy(*by)
            .agg(F.aggregate(listed, zero, _merge).alias("m"))
            .select(*by, "m.*")
        )

    runs = summaries.withColumn("_run", F.floor(F.col("blk") / MERGE_BLOCKS)).repartition(*keys)
    merged = fold(fold(runs, [*keys, "_run"], "blk"), keys, "_run")
    folded = merged.select(*keys, F.struct(*MERGED).alias("m"))
    std = F.sqrt(F.col("m.m2") / F.nullif(F.col("m.n") - 1, F.lit(0.0)))
    return folded.select(
        *keys,
        (F.col("m.mean") / F.nullif(std, F.lit(0.0)) * annual_scale(bar_seconds)).alias("sharpe"),
        (F.col("m.growth") - 1).alias("total_return"),
        F.col("m.drop").alias("max_drawdown"),
        F.col("m.trades").cast("long").alias("n_trades"),
        (F.col("m.wins") / F.nullif(F.col("m.closed"), F.lit(0.0))).alias("win_rate"),
        (F.lit(cfg.init_cash) * F.col("m.fees")).alias("fees_paid"),
        (F.lit(cfg.init_cash) * F.col("m.growth")).alias("end_equity"),
    )


def channel_metrics(
    channel: DataFrame, bar_seconds: int | Column, cfg: ReplayConfig = ReplayConfig(), keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Metrics of a channel's touches without a stop: one summary per block of bars, merged."""
    return flagged_metrics(fill_price(signals(channel)), bar_seconds, cfg=cfg, keys=keys).drop("combo_id")


def replay_metrics(
    series: DataFrame, params: DataFrame, bar_seconds: int | Column, cfg: ReplayConfig = ReplayConfig(),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Metrics of every combination on every series."""
    return merge_blocks(replay_blocks(series, params, cfg, keys), bar_seconds, cfg, keys)


def replay_trades(
    series: DataFrame, params: DataFrame, cfg: ReplayConfig = ReplayConfig(),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One row per trade of every combination, stops included; needs ``ts`` in ``series``."""
    return logged_trades(replay_blocks(series, params, cfg, keys, log=True), series, keys)


def logged_trades(blocks: DataFrame, series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The trades in the logs of block summaries, with the times of their bars."""
    keys = list(keys)
    made = blocks.select(*keys, "combo_id", F.explode("log").alias("t")).select(*keys, "combo_id", "t.*")
    stamps = series.select(*keys, "pos", "ts")
    return (
        made.join(stamps.withColumnsRenamed({"pos": "entry_pos", "ts": "entry_ts"}), [*keys, "entry_pos"])
        .join(stamps.withColumnsRenamed({"pos": "exit_pos", "ts": "exit_ts"}), [*keys, "exit_pos"])
        .select(
            *keys, "combo_id", "side", "entry_ts", "entry_px", "exit_ts", "exit_px",
            (F.col("reason") == "open").alias("is_open"), "reason", "ret",
        )
    )
