"""Forecasts of one series, and of panels as one shuffle and one hand-over to Python workers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelith.constants import MOST_PERIODS, NOISE_PERIODS
from panelith.functions import calendar
from panelith.functions.calendar import season_of
from panelith.functions.numeric import item_seed
from panelith.operators import clean, evaluate
from panelith.operators import prune as prune_
from panelith.operators.kernel import Series, fill, sample_paths
from panelith.operators.stacked import stacks
from panelith.shipping import ship


#: Rows that a task holds before it forecasts the series that are whole among them, together.
HELD_ROWS = 1 << 18


def seed_of(series_id: object, channel: int = 0) -> int:
    """The seed of a series: the first 32 bits of its id's MD5 plus the channel, within 32 bits."""
    return (int(hashlib.md5(str(series_id).encode()).hexdigest()[:8], 16) + channel) % 2**32


def _columns(name: str, x: object, n: int, length: str) -> np.ndarray:
    a = np.asarray(x, dtype=np.float64)
    if a.ndim not in (1, 2):
        raise ValueError(f"{name} must be 1D or 2D")
    a = a.reshape(len(a), -1)
    if len(a) != n:
        raise ValueError(f"{name} length {len(a)} must be {length} {n}")
    return a


def forecast(y: object, horizon: int, freq: str, n_samples: int = 200, seed: int | None = None, X_hist: object = None, X_future: object = None, noise: str = "bootstrap", period: int | None = None) -> np.ndarray:
    """Sample paths (n_samples, horizon) of one series of values, NaN for missing ones. noise: see sample_paths(). period: held instead of chosen from the frequency's by the values.

    X_hist and X_future are known columns for the history and the horizon; a future column without values takes the last of its history.
    """
    clean.validate_request(horizon, freq, n_samples, noise, period)
    raw = np.asarray(y, dtype=np.float64)
    if raw.ndim != 1:
        raise ValueError("y must be 1-dimensional")
    if not len(raw):
        raise ValueError("y must not be empty")
    if np.isinf(raw).any():
        raise ValueError("y must not have infinite values")
    if (X_hist is None) != (X_future is None):
        raise ValueError("X_hist and X_future must be provided together")
    past = ahead = None
    if X_hist is not None:
        past, ahead = _columns("X_hist", X_hist, len(raw), "that of y,"), _columns("X_future", X_future, horizon, "the horizon,")
        if past.shape[1] != ahead.shape[1]:
            raise ValueError(f"X_hist columns {past.shape[1]} must be as many as those of X_future, {ahead.shape[1]}")
        past = np.column_stack([fill(c) for c in past.T])
        ahead = np.column_stack([fill(c, past[-1, i]) for i, c in enumerate(ahead.T)])
    return sample_paths(Series.of(raw, horizon, past), horizon, freq, n_samples, seed, ahead, noise, period)


@dataclass(frozen=True)
class PanelForecaster:
    """Defaults for forecasts. Without a seed each series has one of its own from its id, so that a task that runs again gives the same paths.

    freq: a code for all series; None where a column of the panel has each series' own.
    prune: look first for what is too old to matter, so that it isn't shuffled; see prune.recent(). It reads the history twice, so it is for tables, and for series longer than need().
    period: held for all series, where they have enough of it; None: each series' own, chosen from its frequency's by a criterion that noise can turn to no period at all.
    on_error: "raise" ends the query with a series that can't be forecast; "report" gives such a series one row, with the reason in the column `fault`, which is null in all others.
    """

    freq: str | None
    n_samples: int = 200
    seed: int | None = None
    noise: str = "bootstrap"
    partitions: int | None = None  # that series are dealt into; None: as many as Spark's shuffles have
    prune: bool = False
    on_error: str = "raise"
    period: int | None = None

    def __post_init__(self) -> None:
        clean.validate_request(1, "" if self.freq is None else self.freq, self.n_samples, self.noise, self.period)
        if self.on_error not in ("raise", "report"):
            raise ValueError('on_error must be "raise" or "report"')

    def predict(self, y: object, horizon: int, n_samples: int | None = None, seed: int | None = None, X_hist: object = None, X_future: object = None) -> np.ndarray:
        """forecast() of one series with these defaults; a seed of 0 counts as given."""
        return forecast(y, horizon, self.freq, self.n_samples if n_samples is None else n_samples, self.seed if seed is None else seed, X_hist, X_future, self.noise, self.period)

    def forecast(
        self, history: DataFrame, horizon: int | str, series: str | Sequence[str] = "series_id", ts: str = "ts", y: str = "y", exog: Sequence[str] = (), future: DataFrame | None = None, output: str = "samples", quantiles: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9), seeds: str | None = None, freqs: str | None = None
    ) -> DataFrame:
        """(series, sample_id, step, value), or with output='quantiles' (series, step, quantile, value).

        history: (series, ts, y, exog...), y null or NaN where missing; future: (series, step from 0, exog...), horizon rows each: if not, the
        query fails when it runs. series: one key column or several. seeds: a column of history with each series' seed (the least counts), as explode_channels() gives; without it and without
        a seed of the config, seed_of() of the key. freqs: a column with each series' frequency (the least counts; null: that of the config), so that one job
        holds hourly, daily and monthly series; horizon may be the name of such a column too. All rows of a series, past and known ahead, are dealt out once; see _dealt() and _walk().
        """
        clean.validate_request(1 if isinstance(horizon, str) else horizon, self.freq or "", self.n_samples)
        keys = [series] if isinstance(series, str) else list(series)
        clean.check_exog(history, future, exog)
        self._known_freq(freqs)
        rows = _rows(history, keys, ts, y, exog, seeds, freqs, horizon)
        if future is not None:
            null = lambda c, kind: F.lit(None).cast(kind).alias(c)
            rows = rows.unionByName(future.select(*keys, null("_order", dict(rows.dtypes)["_order"]), F.col("step").cast("long").alias("_step"), F.lit(True).alias("_ahead"), null("y", "double"), *[F.col(c).cast("double").alias(c) for c in exog], null("_seed", "long"), null("_freq", "string"), null("_horizon", "int")))
        narrow = output == "quantiles"
        levels = [float(q) for q in quantiles]
        names = ["step", "quantile", "value"] if narrow else ["sample_id", "step", "value"]

        def made(paths: np.ndarray, known: list[Ahead]) -> list[list[np.ndarray]]:
            out = np.quantile(paths, levels, axis=1).swapaxes(0, 1) if narrow else paths
            many, h = out.shape[1:]
            first, step = np.repeat(np.arange(many, dtype=np.int32), h), np.tile(np.arange(h, dtype=np.int32), many)
            before = [step, np.array(levels)[first]] if narrow else [first, step]
            return [[*before, x.ravel()] for x in out]

        return self._walked(rows, keys, exog, names, "step int, quantile double, value double" if narrow else "sample_id int, step int, value double", made, freqs is not None, self.prune)

    def backtest(
        self, history: DataFrame, train: int | str, horizon: int | str, n_origins: int, season: int | None = None, series: str | Sequence[str] = "series_id", ts: str = "ts", exog: Sequence[str] = (), same_seed: bool = False, seeds: str | None = None, freqs: str | None = None, output: str = "scores", quantiles: Sequence[float] = ()
    ) -> DataFrame:
        """(series, origin, mase, mae, smape) of median forecasts from rolling origins; every origin of every series is a series of its own.

        With exog, the test window's rows of these columns are known ahead. same_seed: one seed for all origins (that of the
        series, or of the column seeds), so that runs with and without exogenous columns differ by these alone; else each origin has its own.
        The test window travels with its training rows, so that rows are dealt out once for each origin and scores are sums over what the kernel returns.
        freqs, and names of columns for train and horizon: as in forecast(). season: of the naive error's scale; None takes that of each series' frequency.
        output='steps': (series, origin, step, actual, pred, naive, again, q...) before they are summed, with the value a season ago (again) and a column for each of quantiles, named q1, q2...
        """
        clean.validate_request(1 if isinstance(horizon, str) else horizon, self.freq or "", self.n_samples)
        keys = [series] if isinstance(series, str) else list(series)
        self._known_freq(freqs)
        whole = _rows(history, keys, ts, "y", exog, seeds, freqs, horizon)
        if isinstance(train, str):
            whole = _rows(history, keys, ts, "y", [*exog, train], seeds, freqs, horizon).withColumnRenamed(train, "_train")
        if same_seed and self.seed is None and seeds is None:
            whole = whole.withColumn("_seed", item_seed(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys])))
        w = Window.partitionBy(*keys)
        whole = whole.withColumn("i", F.row_number().over(w.orderBy("_order")) - 1)
        parts = evaluate.rolling_origins(whole, "_train" if isinstance(train, str) else train, "_horizon" if isinstance(horizon, str) else horizon, n_origins, keys, keep=[*exog, "_seed", "_freq", "_horizon"])
        own = [*keys, "origin"]
        ahead = F.col("part") == "test"
        rows = parts.select(*own, F.lit(None).cast("long").alias("_order"), F.col("at").cast("long").alias("_step"), ahead.alias("_ahead"), F.col("y").cast("double").alias("y"), *exog, "_seed", "_freq", "_horizon")
        levels = [float(q) for q in quantiles]
        names = ["step", "actual", "pred", "naive", *(["again"] if output == "steps" else []), *(f"q{i + 1}" for i in range(len(levels)))]

        def each(paths: np.ndarray, known: Ahead) -> list[np.ndarray]:
            h = paths.shape[1]
            own = season_of(known.freq) if season is None else season
            out = [np.arange(h, dtype=np.int32), known.actual, np.median(paths, axis=0), np.full(h, naive(known.history, own))]
            if output == "steps":
                out.append(np.resize(fill(known.history)[-own:], h))
            return out + (list(np.quantile(paths, levels, axis=0)) if levels else [])

        def made(paths: np.ndarray, known: list[Ahead]) -> list[list[np.ndarray]]:
            return [each(*x) for x in zip(paths, known, strict=True)]

        out = self._walked(rows, own, exog, names, ", ".join(f"{n} {'int' if n == 'step' else 'double'}" for n in names), made, freqs is not None, False)
        if output == "steps":
            return out
        extra = [F.max("fault").alias("fault")] if self.on_error == "report" else []
        return evaluate.scores(out, own, extra=extra).select(*own, "mase", "mae", "smape", *(["fault"] if extra else []))

    def _known_freq(self, freqs: str | None) -> None:
        if self.freq is None and freqs is None:
            raise ValueError("freq must be given for all series, or as a column")

    def _walked(self, rows: DataFrame, keys: list[str], exog: Sequence[str], names: list[str], ddl: str, made: Callable[[np.ndarray, list[Ahead]], list[list[np.ndarray]]], own_freqs: bool, prune: bool) -> DataFrame:
        """(keys, names): made() of the sample paths of some series (series, samples, steps) and what is known of each one's horizon.

        rows: (keys, _order, _step, _ahead, y, exog..., _seed, _freq, _horizon), in the order of _order and _step. Spark computes what depends on all rows of a series (length, least value, shift, whole numbers, faults),
        then drops rows that are too old for the kernel, so that a series has at most need() rows there, and one before them to interpolate from. Then the kernel walks
        the sorted partitions and holds HELD_ROWS rows and one series. Series of one length are forecast together, see stacked.stacks(): a Python group, or NumPy's calls, for each would cost far more than the forecasts of short ones.
        """
        ship(rows.sparkSession)
        n_parts = self.partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = _needed(rows, self.freq, own_freqs, self.period)
        facts = None
        if prune:
            rows, facts = prune_.recent(rows, keys)
        rows = _dealt(rows, keys, exog, n_parts, facts)
        default, n_samples, seed, noise, report = self.freq or "", self.n_samples, self.seed, self.noise, self.on_error == "report"
        period = self.period
        kinds = dict(rows.dtypes)
        keep = [*keys, "_ahead", "_old", "i", "n", "seen", "low", "whole", "shift", "_seed", "_freq", "_horizon", "fault", *exog]
        n_keys = len(keys)

        def asked(key: tuple, col: dict[str, np.ndarray], lo: int, hi: int) -> tuple[Series, int, str, int, np.ndarray | None, Ahead] | None:
            """The series, horizon, frequency, seed and known columns of a forecast, and what it is compared with."""
            past = lo + int(np.count_nonzero(~col["_ahead"][lo:hi]))
            if past == lo:
                return None  # known rows of a series without a history
            place, value = col["i"][lo:past], col["seen"][lo:past]
            known = ~np.isnan(value)
            lo += int(col["_old"][lo])
            fault = col["fault"][lo]
            if fault is not None and (report or fault == clean.INFINITE):
                raise ValueError(f"{fault}" if report else f"y must not have infinite values; series {key} has")
            freq, horizon = col["_freq"][lo] or default, int(col["_horizon"][lo])
            seen = col["seen"][lo:past]
            low, own_seed = col["low"][lo], col["_seed"][lo]
            lookback = max(2 * horizon, 50)
            back = seen[len(seen) - min(lookback, len(seen)) :]
            x = np.column_stack([col[c][lo:past] for c in exog]) if exog else np.zeros((past - lo, 0))
            ahead = None
            if exog:
                if hi - past != horizon:
                    raise ValueError(f"X_future length must be the horizon, {horizon}; series {key} has {hi - past} rows")
                ahead = np.column_stack([col[c][past:hi] for c in exog])
                ahead = np.where(np.isnan(ahead), x[-1], ahead)  # a column without any value takes the last of its history
            y = np.interp(col["i"][lo:past], place[known], value[known]) if known.any() else np.zeros(past - lo)
            s = Series(y + col["shift"][lo], int(col["n"][lo]), float(col["shift"][lo]), None if np.isnan(low) else float(low), back[~np.isnan(back)], bool(col["whole"][lo]), x)
            used = seed if seed is not None else int(own_seed) if not np.isnan(own_seed) else seed_of(key[0] if n_keys == 1 else "\x1f".join(map(str, key)))
            return s, horizon, freq, used, ahead, Ahead(col["seen"][past:hi], seen, freq)

        def tried(call: Callable) -> tuple[object, str | None]:
            try:
                return call(), None
            except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
                if not report:
                    raise
                return None, str(e) or type(e).__name__

        def forecasts(keys: list[tuple], col: dict[str, np.ndarray], cut: np.ndarray) -> list[tuple[int, list[np.ndarray] | None, str | None]]:
            """(first row, columns or None, fault or None) of each series."""
            asks = [tried(lambda k=k, lo=lo, hi=hi: asked(k, col, lo, hi)) for k, lo, hi in zip(keys, cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            out: dict[int, tuple[list[np.ndarray] | None, str | None]] = {}
            groups: dict[tuple[int, str], list[int]] = {}
            for i, (a, fault) in enumerate(asks):
                if a is None:
                    out[i] = None, fault
                else:
                    groups.setdefault((a[1], a[2]), []).append(i)
            for (horizon, freq), at in groups.items():
                for places, paths in stacks([asks[i][0][0] for i in at], horizon, freq, n_samples, [asks[i][0][3] for i in at], noise, period):
                    own = [at[i] for i in places]
                    out.update(zip(own, ((x, None) for x in made(paths, [asks[i][0][5] for i in own])), strict=True))
            for i, (a, _) in enumerate(asks):
                if i not in out:
                    s, horizon, freq, used, ahead, known = a
                    out[i] = tried(lambda s=s, horizon=horizon, freq=freq, used=used, ahead=ahead, known=known: made(sample_paths(s, horizon, freq, n_samples, used, ahead, noise, period)[None], [known])[0])
            return [(lo, *out[i]) for i, lo in enumerate(cut[:-1].tolist())]

        fields = [pa.field(*f) for f in zip(names, [pa.int32() if x.strip().split(" ")[1] == "int" else pa.float64() for x in ddl.split(",")], strict=True)]

        def done(t: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
            """What the whole series of t give, and the rows of the last one, which may go on in the next batch."""
            new = np.zeros(len(t), bool)
            for c in range(n_keys):
                place = t.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= place[1:] != place[:-1]
            cut = np.concatenate(([0], np.flatnonzero(new), [len(t)] if last else []))
            cut = cut.astype(np.int64)
            if len(cut) < 2:
                return None, t
            col = {c: t.column(c).to_numpy(zero_copy_only=False) for c in keep[n_keys:]}
            for c in ("seen", "low", "_seed", *exog):
                col[c] = col[c].astype(np.float64)
            own = t.select(range(n_keys)).combine_chunks()
            first = list(zip(*(c.take(pa.array(cut[:-1])).to_pylist() for c in own.columns), strict=True))
            got = forecasts(first, col, cut)
            whole = [(lo, g) for lo, g, _ in got if g is not None]
            failed = [(lo, e) for lo, _, e in got if e is not None]
            if not whole and not failed:
                return None, t.slice(cut[-1])
            at = pa.array(np.concatenate([np.repeat([lo for lo, _ in whole], [len(g[0]) for _, g in whole]), [lo for lo, _ in failed]]).astype(np.int64))
            n_good = len(at) - len(failed)
            values = [pa.array(np.concatenate(c) if whole else [], f.type) for c, f in zip(zip(*(g for _, g in whole), strict=True) if whole else [()] * len(fields), fields, strict=True)]
            if failed:
                values = [pa.concat_arrays([v, pa.nulls(len(failed), v.type)]) for v in values]
            if report:
                values.append(pa.array([None] * n_good + [e for _, e in failed], pa.string()))
            columns = [c.take(at).combine_chunks() for c in own.columns]
            return pa.RecordBatch.from_arrays([*columns, *values], names=[*keys, *names, *(["fault"] if report else [])]), t.slice(cut[-1])

        def pieces(out: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            return (out.slice(i, HELD_ROWS) for i in range(0, out.num_rows, HELD_ROWS))

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.Table] = []
            new = 0
            for b in batches:
                held.append(pa.Table.from_batches([b]))
                new += b.num_rows
                if new >= HELD_ROWS:
                    out, rest = done(pa.concat_tables(held), False)
                    held, new = [rest], 0
                    if out is not None:
                        yield from pieces(out)
            if held and (t := pa.concat_tables(held)).num_rows:
                out, _ = done(t, True)
                if out is not None:
                    yield from pieces(out)

        return rows.select(*keep).mapInArrow(stream, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), ddl, *(["fault string"] if report else [])]))


@dataclass(frozen=True)
class Ahead:
    """What a backtest compares a forecast with: the horizon's values, and the history's as they were observed."""

    actual: np.ndarray
    history: np.ndarray
    freq: str


def naive(history: np.ndarray, season: int) -> float:
    """The mean absolute error of repeating the value a season ago; NaN for histories no longer than that."""
    gone = np.abs(history[season:] - history[:-season])
    gone = gone[~np.isnan(gone)]
    return float(gone.mean()) if len(gone) else float("nan")


def faults(forecasts: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """(keys, fault) of the series that a forecast with on_error='report' couldn't do; the others are forecasts.filter('fault is null'). Write the forecasts first, or they are made twice."""
    return forecasts.filter("fault is not null").select(*keys, "fault")


def _rows(history: DataFrame, keys: list[str], ts: str, y: str, exog: Sequence[str], seeds: str | None, freqs: str | None, horizon: int | str) -> DataFrame:
    seed = F.col(seeds).cast("long") if seeds else F.lit(None).cast("long")
    freq = F.col(freqs).cast("string") if freqs else F.lit(None).cast("string")
    ahead = F.col(horizon) if isinstance(horizon, str) else F.lit(int(horizon))
    return history.select(*keys, F.col(ts).alias("_order"), F.lit(None).cast("long").alias("_step"), F.lit(False).alias("_ahead"), F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in exog], seed.alias("_seed"), freq.alias("_freq"), ahead.cast("int").alias("_horizon"))


def _needed(rows: DataFrame, freq: str | None, own: bool, period: int | None = None) -> DataFrame:
    """rows with _need, how many rows from its end a series needs at most, and _second, how far apart its rows are by its frequency. Where the panel has frequencies of its own, both come from a broadcast dimension of its codes."""
    h = F.coalesce("_horizon", F.lit(1))
    if not own:
        reach, second = F.lit(calendar.reach_of(freq)), F.lit(calendar.seconds_of(freq))
    else:
        rows = calendar.with_dimension(rows, "_freq", freq or "")
        reach, second = F.col("_reach"), F.col("_seconds")
    return rows.withColumn("_need", F.greatest(reach, F.lit(MOST_PERIODS * (period or 1)), 2 * h, F.lit(NOISE_PERIODS)).cast("long")).withColumn("_second", second.cast("long")).drop("_reach", "_seconds")


def _dealt(rows: DataFrame, keys: list[str], exog: Sequence[str], n_parts: int, facts: DataFrame | None = None) -> DataFrame:
    """rows, dealt out by series in one shuffle and sorted, with i, n, seen (y, null where missing), low, whole, shift, fault, and exogenous columns interpolated.

    Past and known rows are sides of a window each. The number of partitions is held: sizes before the kernel say little about its work, so partitions
    mustn't be merged by size. For that the shuffle is by a hash beside the keys, or an earlier one by the keys alone would take its place.
    Rows of one time come in the order of their values. Of rows that are too old only the last observed one stays (_old): values missing at the beginning of the others are interpolated from it. So one sort serves all. facts: what prune.recent() knows of whole series, of which rows then has the ends.
    """
    deal = ["_deal", *keys]
    rows = rows.withColumn("_deal", F.xxhash64(*keys)).repartition(n_parts, *deal)
    side = Window.partitionBy(*deal, "_ahead")
    order = side.orderBy("_order", "_step", "y")
    rows = rows.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(side)).withColumn("seen", F.when(~F.isnan("y"), F.col("y")))
    for c in exog:  # a column ahead without any value stays null until the kernel knows the last of its history
        rows = clean.interpolate(rows, c, F.when(~F.col("_ahead"), F.lit(0.0)), [*deal, "_ahead"])
    over = {name: c.over(side) for name, c in prune_.of_series("seen").items()}
    series = Window.partitionBy(*deal)
    rows = rows.withColumns({c: F.min(c).over(series) for c in ("_seed", "_freq", "_horizon")}).withColumn("_need", F.max("_need").over(series))
    if facts is None:
        rows = rows.withColumns(over)
    else:
        rows = rows.join(F.broadcast(facts), [F.col(k).eqNullSafe(F.col(f"_f_{k}")) for k in keys], "left")
        past = lambda c: F.when(F.col("_ahead"), over[c]).otherwise(F.col(f"_f_{c}"))
        rows = rows.withColumn("i", F.when(F.col("_ahead"), F.col("i")).otherwise(F.col("i") + F.col("_f_n") - F.col("n")).cast("int")).withColumns({c: past(c) for c in over})
        rows = rows.withColumn("n", F.when(F.col("_ahead"), F.col("n")).otherwise(F.col("_f_n")))
    rows = rows.withColumn("_old", ~F.col("_ahead") & (F.col("n") - F.col("i") > F.col("_need")))
    rows = rows.withColumn("_before", F.max(F.when(F.col("_old") & F.col("seen").isNotNull(), F.col("i"))).over(side)).filter(~F.col("_old") | (F.col("i") == F.col("_before")))
    rows = rows.withColumn("whole", F.coalesce("whole", F.lit(False))).withColumn("shift", F.greatest(1 - F.coalesce("low", F.lit(0.0)), F.lit(1.0)))
    rows = rows.withColumn("fault", clean.fault(F.col("largest")))
    return rows.sortWithinPartitions(*deal, "_ahead", "i")


#: The single-series call under its second name.
panel_forecast = forecast


def explode_channels(items: DataFrame, target: str = "target", item: str = "item_id") -> DataFrame:
    """A series for each channel of items whose target is an array of arrays: (item, channel, i, y, seed)."""
    rows = items.select(item, F.posexplode(target).alias("channel", "_values"))
    rows = rows.withColumn("seed", item_seed(F.col(item), F.col("channel")))
    return rows.select(item, "channel", "seed", F.posexplode("_values").alias("i", "y"))


def forecast_start(history: DataFrame, horizon: int, every: str, series: str = "series_id", ts: str = "ts") -> DataFrame:
    """(series, step, ts): when each forecast step is. every: an interval, such as '1 hour'."""
    last = history.groupBy(series).agg(F.max(ts).alias("_last"))
    return last.select(series, F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("step"), "_last").select(series, "step", F.expr(f"_last + (step + 1) * interval {every}").alias("ts"))
