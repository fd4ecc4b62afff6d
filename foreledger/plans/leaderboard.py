"""Train, calibrate, score and decide: one (task, format) cell of the leaderboard."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreledger.functions import EPS_BOARD, log_floor
from foreledger.operators import calibrate as C
from foreledger.operators import guards, models, resample
from foreledger.operators import metrics as M
from foreledger.operators import tables as T
from foreledger.operators.scan import join_on, pin
from foreledger.sources.stored import stored

# Names of the ladder, simplest first.
LADDER = ("B0_marginal", "B1_table", "B2_logistic", "B3_gbm")


@dataclass(frozen=True)
class Cell:
    board: DataFrame        # model, split, metric, value, lo, hi
    decision: DataFrame     # one row: the challenger rule
    canaries: DataFrame     # ladder inversion on val
    settings: dict[str, dict[str, float]]
    val: DataFrame          # scored rows, raw (p_*) and calibrated (c_*)
    test: DataFrame
    counts: DataFrame       # split, n_rows, n_groups
    cuts: DataFrame         # model, facet (year or bucket), name, n, nll, brier, p_mean, y_mean, ece, max_ce on test
    reliability: DataFrame  # model, bin, n, p_mean, y_mean, weight on test


def fit_ladder(train: DataFrame, val: DataFrame, y: str, k: int, features: Sequence[str], fmt: str,
               group: str, order: Sequence[str] = (), c_grid: Sequence[float] = models.C_GRID,
               boosted: dict | None = None, names: Sequence[str] = LADDER) -> list[models.Fitted]:
    """The named models, in their order."""
    fits = {
        "B0_marginal": lambda: models.fit_marginal(train, y, k, group, order),
        "B1_table": lambda: (models.fit_table_binary(train, val, y, fmt) if k == 2
                             else models.fit_table_multi(train, val, y, k, fmt)),
        "B2_logistic": lambda: models.fit_logistic(train, val, y, k, features, c_grid),
        "B3_gbm": lambda: models.fit_boosted(train, val, y, k, features, **(boosted or {}))}
    return [fits[n]() for n in names]


def _predict(df: DataFrame, ladder: Sequence[models.Fitted], keep: Sequence[str]) -> DataFrame:
    for i, m in enumerate(ladder):
        df = m.predict(df, f"p_{i}")
    return df.select(*keep, *[f"p_{i}" for i in range(len(ladder))])


def calibrated(val: DataFrame, test: DataFrame, n: int, y: str, k: int, n_groups: int):
    """Append c_<i> to both splits (and the alternate a_<i> for two classes); rows stand for __w rows."""
    info: list[dict[str, float]] = []
    if k != 2:
        found = C.fit_temperatures(val, [log_floor(F.col(f"p_{i}")) for i in range(n)], y, "__w")
        val, test = (d.withColumns({f"c_{i}": C.temperature_probs(F.col(f"p_{i}"), t) for i, t in enumerate(found)})
                     for d in (val, test))
        return val, test, [{"temperature": t} for t in found]
    method = C.board_calibration(n_groups)
    for i in range(n):
        p, c = f"p_{i}", f"c_{i}"
        platt = C.fit_platt(val, p, y, "__w")
        iso, _ = C.fit_isotonic(val, p, y, "__w")
        plat, isot = (c, f"a_{i}") if method == "platt" else (f"a_{i}", c)
        val, test = (iso(d.withColumn(plat, platt.apply(F.col(p))), p, isot) for d in (val, test))
        info.append({"platt_a": platt.a, "platt_b": platt.b, "isotonic": float(method == "isotonic")})
    return val, test, info


def _losses(i: int, y: str, k: int, prefix: str = "c") -> dict:
    p, yy = F.col(f"{prefix}_{i}"), F.col(y)
    if k == 2:
        return {f"nll_{i}": M.nll_binary(p, yy, EPS_BOARD), f"brier_{i}": M.brier_binary(p, yy)}
    return {f"nll_{i}": M.nll_multi(p, yy, EPS_BOARD), f"brier_{i}": M.brier_multi(p, yy, k)}


def run_cell(train: DataFrame, val: DataFrame, test: DataFrame, *, k: int, features: Sequence[str], fmt: str,
             y: str = "y", group: str = "match_id", order: Sequence[str] = (),
             n_boot: int = resample.B_RESAMPLES, c_grid: Sequence[float] = models.C_GRID,
             boosted: dict | None = None, names: Sequence[str] = LADDER, date: str | None = None,
             buckets: Column | None = None) -> Cell:
    """Fit on train, tune and calibrate on val, touch test once.

    Rows alike in features, label, year and buckets are scored once, as one with
    their number, and every metric reads those; only the sums per group meet each
    row.  Fitted parameters, curves of grid points and intervals reach the driver.
    ``date`` cuts test by calendar year, ``buckets`` (an array of names a row) by bucket.
    """
    ladder = fit_ladder(train, val, y, k, features, fmt, group, order, c_grid, boosted, names)
    n, table = len(ladder), T.AXIS_SOURCES if LADDER[1] in names else ()
    alike = list(dict.fromkeys([*features, *table, y, "__year", "__buckets"]))
    none = F.array().cast("array<string>")
    marks = {"__year": F.array(F.year(date).cast("string")) if date else none,
             "__buckets": none if buckets is None else buckets}
    parts = {s: d.withColumns(marks).select(group, *alike) for s, d in (("val", val), ("test", test))}
    sv, st = (stored(d.groupBy(*alike).agg(F.count(F.lit(1)).alias("__w")), "alike") for d in parts.values())
    sv, st = (stored(_predict(d, ladder, [*alike, "__w"])) for d in (sv, st))
    sv, st, info = calibrated(sv, st, n, y, k, val.select(group).distinct().count())
    sv, st = stored(sv), stored(st)
    losses = {key: e for i in range(n) for key, e in _losses(i, y, k).items()}
    board, gl, reps = None, {}, {}
    for split, df in (("val", sv), ("test", st)):
        lost = join_on(parts[split], df.select(*alike, *[e.alias(key) for key, e in losses.items()]), alike)
        gl[split] = stored(M.group_losses(lost, [group], {key: F.col(key) for key in losses}))
        reps[split] = stored(resample.replicate_sums(gl[split], [group], list(losses), n_boot=n_boot))
        ci = resample.intervals(gl[split], [group], list(losses), reps=reps[split])
        tagged = ci.select(F.split("metric", "_")[1].cast("int").alias("i"), F.lit(split).alias("split"),
                           F.split("metric", "_")[0].alias("metric"), F.col("point").alias("value"), "lo", "hi")
        e = M.forecast_calibration(df, [f"c_{i}" for i in range(n)], y, k, w="__w")
        e = pin(e.withColumn("i", F.split("forecast", "_")[1].cast("int")))
        long = e.select("i", F.explode(F.array(*[F.struct(
            F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("ece", "max_ce")])).alias("r"))
        none = F.lit(None).cast("double")
        rows = tagged.unionByName(long.select(
            "i", F.lit(split).alias("split"), "r.metric", "r.value", none.alias("lo"), none.alias("hi")))
        board = rows if board is None else board.unionByName(rows)
    if k == 2:
        alt = {f"{s}|{i}": df.agg(M.mean(_losses(i, y, k, "a")[f"nll_{i}"], "__w").alias("v"))
               for s, df in (("test", st),) for i in range(n)}
        for key, frame in alt.items():
            none = F.lit(None).cast("double")
            board = board.unionByName(frame.select(
                F.lit(int(key.split("|")[1])).alias("i"), F.lit("test").alias("split"),
                F.lit("alternate_nll").alias("metric"), F.col("v").alias("value"), none.alias("lo"), none.alias("hi")))
    board = pin(board)
    base = board.filter("i = 0").select("split", "metric", F.col("value").alias("__b0"))
    named = F.array(*[F.lit(x) for x in names])
    out = board.join(F.broadcast(base), ["split", "metric"]).select(
        named[F.col("i")].alias("model"), "split", "metric", "value", "lo", "hi",
        F.when(F.col("metric").isin("nll", "brier"), M.skill(F.col("value"), F.col("__b0"))).alias("skill"))
    got = {(r["i"], r["split"], r["metric"]): r["value"] for r in board.collect()}
    settings = {m.name: m.tuned | info[i] for i, m in enumerate(ladder)}
    kept = [group, y, "__year", "__buckets", *[c for c in sv.columns if c not in alike and c != "__w"]]
    scored = [join_on(d, s.drop("__w"), alike).select(*kept) for d, s in zip(parts.values(), (sv, st))]
    return Cell(out, _decision(gl, reps, group, got, names), _ladder_check(sv, y, k, names), settings, *scored,
                _counts({"train": train, "val": val, "test": test}, group), _cuts(st, names, y, k),
                _model_of(M.forecast_reliability(st, [f"c_{i}" for i in range(n)], y, k, w="__w"), names))


def _counts(parts: dict[str, DataFrame], group: str) -> DataFrame:
    """Rows and groups of every split."""
    tagged = [d.select(F.lit(s).alias("split"), group) for s, d in parts.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(group).alias("n_groups"))


def _model_of(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The column ``forecast`` (c_<i>) as the name of its model."""
    named = F.array(*[F.lit(x) for x in names])
    rest = [c for c in df.columns if c != "forecast"]
    return df.select(named[F.split("forecast", "_")[1].cast("int")].alias("model"), *rest)


def _cuts(scored: DataFrame, names: Sequence[str], y: str, k: int) -> DataFrame:
    """Test rows by year and by bucket; buckets have a calibration error of their own."""
    cols = [f"c_{i}" for i in range(len(names))]
    means = M.breakdown(scored, cols, y, k, {"year": F.col("__year"), "bucket": F.col("__buckets")}, w="__w")
    errors = M.facet_calibration(scored, cols, y, k, F.col("__buckets"), w="__w").withColumn("facet", F.lit("bucket"))
    return _model_of(means.join(errors, ["forecast", "facet", "name"], "left"), names)


def run_cells(cells: Mapping[tuple[str, str], Mapping], **common) -> dict[str, DataFrame]:
    """Cells named (task, format), a fixed few, each table of theirs as one with those two columns in front.

    A cell gives its splits, class count and whatever else ``run_cell`` takes.
    """
    tables: dict[str, list[DataFrame]] = {}
    for (task, fmt), cell in cells.items():
        done = run_cell(**{**common, "fmt": fmt, **cell})
        for part in ("board", "decision", "canaries", "counts", "cuts", "reliability"):
            tables.setdefault(part, []).append(
                getattr(done, part).select(F.lit(task).alias("task"), F.lit(fmt).alias("fmt"), "*"))
    return {part: reduce(DataFrame.unionByName, frames) for part, frames in tables.items()}


def _decision(gl: dict[str, DataFrame], reps: dict[str, DataFrame], group: str, got: dict, names: Sequence[str]) -> DataFrame:
    """The challenger rule: the last model against the best simpler one on test NLL, by the replicates of the board."""
    ch = len(names) - 1
    best = min(range(ch), key=lambda i: got[(i, "test", "nll")])
    d = {s: pin(resample.paired_deltas(gl[s], [group], {"d": (f"nll_{ch}", f"nll_{best}")}, reps=reps[s]))
         for s in ("val", "test")}
    row = d["val"].select(F.col("point").alias("val_point"), F.col("lo").alias("val_lo"), F.col("hi").alias("val_hi"))
    row = row.withColumns({f"test_{c}": d["test"].select(c).scalar() for c in ("point", "lo", "hi")} | {
        "challenger": F.lit(names[ch]), "baseline": F.lit(names[best]),
        "baseline_nll": F.lit(got[(best, "test", "nll")]),
        "challenger_ece": F.lit(got[(ch, "test", "ece")]), "baseline_ece": F.lit(got[(best, "test", "ece")])})
    return resample.challenger_rule(row)


def _ladder_check(sv: DataFrame, y: str, k: int, names: Sequence[str]) -> DataFrame:
    """Raw val NLL of the marginal, logistic and boosted models; null, and no verdict, for one left out."""
    def nll(rung: int) -> Column:
        if LADDER[rung] not in names:
            return F.lit(None).cast("double")
        i = list(names).index(LADDER[rung])
        return M.mean(_losses(i, y, k, "p")[f"nll_{i}"], "__w")

    s = sv.agg(*[nll(rung).alias(f"b{rung}") for rung in (0, 2, 3)])
    return s.withColumns(guards.ladder_inversion(F.col("b0"), F.col("b2"), F.col("b3")))


def shuffled_target(train: DataFrame, val: DataFrame, base_nll: float, *, k: int, features: Sequence[str],
                    c: float, key: Sequence[str], y: str = "y") -> DataFrame:
    """Refit the logistic model on permuted labels; its val NLL must sit at the marginal's."""
    m = models.fit_logistic(guards.shuffle_labels(train, y, key, hex_digits=4), val, y, k, features, [c])
    nll = models.mean_nll(m.predict(val, "__p"), "__p", y, k)
    row = train.sparkSession.createDataFrame([(nll, base_nll)], "nll_shuffled double, nll_base double")
    return row.withColumns(guards.shuffle_canary(F.col("nll_shuffled"), F.col("nll_base")))
