"""Reports that put operators together: evaluation, information, regimes and the meta-model. All frames are lazy."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.windows import lag
from quantloom.operators import evaluate, features, information, meta, regimes


@dataclass(frozen=True)
class Evaluation:
    metrics: DataFrame
    drawdowns: DataFrame
    distribution: DataFrame
    percentiles: DataFrame
    rolling: DataFrame
    stability: DataFrame
    hac: DataFrame
    robustness: DataFrame
    benchmark: DataFrame | None


def evaluate_strategy(bars: DataFrame, returns: str = "pnl", equity: str = "equity", position: str | None = "applied", benchmark: DataFrame | None = None, windows: tuple[int, ...] = (20, 60, 252), periods: float | None = 252.0, trials: int = 10) -> Evaluation:
    """Everything about a return series. benchmark: (ts, benchmark), or with instrument; stability is of the longest window."""
    metrics = evaluate.performance(bars, returns, equity, position, periods)
    drawn = evaluate.drawdowns(bars, equity)
    shape = evaluate.distribution(bars, returns)
    rolling = evaluate.rolling_metrics(bars, windows, returns, periods)
    against = None
    if benchmark is not None:
        on = ["instrument", "ts"] if "instrument" in benchmark.columns else ["ts"]
        against = evaluate.benchmark(bars.join(benchmark, on), returns, "benchmark", periods)
    return Evaluation(
        evaluate.calmar(metrics, drawn),
        drawn,
        shape,
        evaluate.percentile_table(bars, returns),
        rolling,
        evaluate.stability(rolling, f"sharpe_{max(windows)}"),
        evaluate.hac_sharpe(bars, returns, periods),
        evaluate.psr_dsr(metrics.select("instrument", "n", "sharpe").join(shape, "instrument"), trials),
        against,
    )


@dataclass(frozen=True)
class InformationConfig:
    horizon: int = 1
    target: str = "forward_return"
    ic_method: str = "spearman"
    ic_window: int | None = None
    overlap: bool = True
    feature_shift: int = 0
    bins: int = 10
    te_bins: int = 5
    te_top: int = 25
    te_runs: int = 200
    costs_bps: float = 0.0
    alpha: float = 0.05

    def __post_init__(self):
        if self.target not in ("forward_return", "binary_up", "meta_label") or self.horizon < 1:
            raise ValueError("unknown target or horizon")


@dataclass(frozen=True)
class Information:
    ic: DataFrame
    mi: DataFrame
    redundancy: DataFrame
    summary: DataFrame
    te: DataFrame | None = None
    drift: DataFrame | None = None
    ic_by_regime: DataFrame | None = None
    cmi: DataFrame | None = None


def information_report(panel: DataFrame, names: list[str], returns: str = "returns", signal: str | None = None, regime: str | None = None, live: DataFrame | None = None, cfg: InformationConfig = InformationConfig()) -> Information:
    """IC, mutual information, redundancy, and with a signal transfer entropy, with live features drift, with regimes both by regime.

    The panel has the features, the returns and, if named, signal and regime. TE is found for the features of greatest IC
    and marked by the Benjamini-Hochberg rule.
    """
    out = panel.withColumn("fwd", features.forward_return(returns, cfg.horizon))
    if cfg.feature_shift:
        out = out.withColumns({c: lag(c, cfg.feature_shift) for c in names})
    out = information.targets(out, "fwd", signal, cfg.costs_bps)
    out = out.withColumn("y", F.col({"forward_return": "fwd", "binary_up": "up", "meta_label": "pays"}[cfg.target]).cast("double"))
    extra = [c for c in (returns, regime) if c]
    long = information.unpivot(out, names, ("instrument", "ts", "y", *extra))
    if cfg.ic_window:
        series = information.ic_rolling(long, cfg.ic_window, cfg.ic_method)
        ic = information.ic_stats(series, information.newey_west_lags(cfg.horizon, cfg.overlap))
        strength = "ic_mean"
    else:
        ic, strength = information.ic(long, cfg.ic_method), "ic"
    mi = information.mi_hist(long, cfg.bins)
    te = drift = by_regime = cmi = None
    if signal:
        chosen = information.top_features(ic, cfg.te_top, strength).select("instrument", "feature")
        picked = long.join(chosen, ["instrument", "feature"], "left_semi").withColumn("y", F.col(returns))
        te = information.bh_fdr(information.te_significance(picked, cfg.te_bins, cfg.te_runs), cfg.alpha)
    if live is not None:
        fresh = information.unpivot(live.withColumn("y", F.lit(0.0)), [c for c in names if c in live.columns])
        drift = information.drift(long, fresh, cfg.bins)
    if regime:
        named = long.withColumnRenamed(regime, "regime") if regime != "regime" else long
        by_regime = information.ic(named.filter("regime is not null"), cfg.ic_method, ("instrument", "feature", "regime"))
        cmi = information.conditional_mi(named, cfg.bins)
    parts = [ic, mi, *([te] if te is not None else []), *([drift] if drift is not None else [])]
    return Information(ic, mi, information.pairwise_mi(long, cfg.bins), information.summary_table(*parts), te, drift, by_regime, cmi)


def future_usage(panel: DataFrame, target: DataFrame) -> DataFrame:
    """(instrument, last_feature, last_target, warning): features that end after the targets hint at use of the future."""
    a = panel.groupBy("instrument").agg(F.max("ts").alias("last_feature"))
    b = target.groupBy("instrument").agg(F.max("ts").alias("last_target"))
    return a.join(b, "instrument", "left").withColumn("warning", F.coalesce(F.col("last_feature") > F.col("last_target"), F.lit(True)))


@dataclass(frozen=True)
class RegimeConfig:
    method: str = "quantile_vol"
    window: int = 20
    quantiles: tuple[float, ...] = (0.3, 0.7)
    trend_quantile: float = 0.7
    least_r2: float = 0.5
    hmm: regimes.HmmConfig = field(default_factory=regimes.HmmConfig)
    hmm_mode: str = "filter"
    calibrate_from: str | None = None
    calibrate_to: str | None = None
    output_shift: int = 0
    periods: float | None = None

    def __post_init__(self):
        if self.method not in ("quantile_vol", "trend_range", "hmm") or self.window < 2 or self.output_shift < 0:
            raise ValueError("unknown method, window or shift")


@dataclass(frozen=True)
class Regimes:
    states: DataFrame
    transitions: DataFrame
    durations: DataFrame
    features: DataFrame
    warnings: tuple[str, ...]


def infer_regimes(panel: DataFrame, cfg: RegimeConfig = RegimeConfig()) -> Regimes:
    """States of a panel with price, or with returns only, from which a pseudo-price is compounded."""
    if "price" not in panel.columns:
        panel = panel.withColumn("price", features.pseudo_price("returns"))
    feats = features.regime_features(panel, (cfg.window,), cfg.periods)
    inside = F.lit(True)
    if cfg.calibrate_from:
        inside = inside & (F.col("ts") >= F.lit(cfg.calibrate_from).cast("timestamp_ntz"))
    if cfg.calibrate_to:
        inside = inside & (F.col("ts") <= F.lit(cfg.calibrate_to).cast("timestamp_ntz"))
    limited = bool(cfg.calibrate_from or cfg.calibrate_to)
    w, warnings = cfg.window, []
    if cfg.method == "quantile_vol":
        states, n = regimes.quantile_labels(feats, f"vol_roll_{w}", cfg.quantiles, inside if limited else None), len(cfg.quantiles) + 1
    elif cfg.method == "trend_range":
        states, n = regimes.trend_labels(feats, f"slope_{w}", f"r2_{w}", cfg.trend_quantile, cfg.least_r2, inside if limited else None), 2
    else:
        marked = feats.withColumn("_c", inside)
        states, n = regimes.hmm(marked, ["ret_abs", f"vol_roll_{w}"], cfg.hmm, cfg.hmm_mode, "_c" if limited else None), cfg.hmm.n_states
        if cfg.hmm_mode != "filter":
            warnings.append("smoothed and Viterbi states use later rows: not for trading")
    if not limited:
        warnings.append("thresholds are calibrated on all rows, later ones included")
    kept = [c for c in states.columns if c in ("instrument", "ts", "state") or c.startswith("p_state_")]
    states = regimes.shift_states(states.select(*kept), cfg.output_shift, n)
    return Regimes(states, regimes.transition_matrix(states, n), regimes.durations(states), feats, tuple(warnings))


@dataclass(frozen=True)
class MetaConfig:
    label: str = "meta_label"
    horizon: int = 5
    costs_bps: float = 0.0
    up: float = 0.02
    down: float = 0.02
    quantile: float = 0.8
    cv: str = "purged_kfold"
    folds: int = 4
    purge: int = 0
    embargo: int = 0
    train_rows: int = 252
    test_rows: int = 63
    calibration: str = "none"
    model: meta.ModelConfig = field(default_factory=meta.ModelConfig)
    policy: str = "threshold"
    threshold: float | None = None
    feature_shift: int = 0
    output_shift: int = 1
    min_train_rows: int = 50
    feature_selection: str = "none"

    def __post_init__(self):
        if self.feature_selection != "none":
            raise NotImplementedError("features are not selected by the fit")
        if self.label not in ("meta_label", "return_sign", "quantile", "triple_barrier") or self.folds < 2 or self.horizon < 1:
            raise ValueError("unknown label, folds or horizon")
        if self.cv not in ("purged_kfold", "combinatorial_purged_cv", "walk_forward") or self.calibration not in ("none", "platt", "beta", "isotonic"):
            raise ValueError("unknown folds or calibration")


@dataclass(frozen=True)
class MetaFit:
    names: tuple[str, ...]
    models: DataFrame
    out_of_sample: DataFrame
    calibration: DataFrame
    thresholds: DataFrame
    schema_hash: str
    config_hash: str


def _shifted(panel: DataFrame, names: list[str], shift: int) -> DataFrame:
    return panel.withColumns({c: lag(c, shift) for c in names}) if shift else panel


def fit_meta_model(panel: DataFrame, names: list[str], signal: str = "signal", returns: str = "returns", cfg: MetaConfig = MetaConfig()) -> MetaFit:
    """Labels, purged folds, out-of-sample scores, the final model of each instrument and its threshold.

    The panel has price, returns, the signal and the features; rows without a label or a feature take no part, and an
    instrument left with fewer than min_train_rows rows has no model.
    """
    rows = _shifted(panel, names, cfg.feature_shift)
    if cfg.label == "triple_barrier":
        rows = meta.triple_barrier(rows, "price", signal, cfg.horizon, cfg.up, cfg.down)
    elif cfg.label == "quantile":
        rows = meta.quantile_label(rows, returns, cfg.horizon, cfg.quantile)
    else:
        label = meta.meta_label(signal, returns, cfg.horizon, cfg.costs_bps) if cfg.label == "meta_label" else meta.sign_label(returns, cfg.horizon)
        rows = rows.withColumn("label", label)
    paid = rows.select("instrument", "ts", F.signum(lag(signal, cfg.output_shift) if cfg.output_shift else F.col(signal)).alias("_side"), features.forward_return(returns, cfg.horizon).alias("_f"))
    rows = rows.dropna(subset=[*names, "label"])
    enough = rows.groupBy("instrument").agg(F.count("*").alias("_n")).filter(F.col("_n") >= cfg.min_train_rows)
    rows = rows.join(enough.select("instrument"), "instrument", "left_semi")
    if cfg.cv == "walk_forward":
        folds = meta.walk_forward(rows, cfg.train_rows, cfg.test_rows, gap=max(cfg.purge, cfg.horizon))
    else:
        folds = meta.purged_kfold(rows, cfg.folds, cfg.horizon, cfg.purge, cfg.embargo)
    tested = meta.out_of_sample(rows, names, "label", folds, cfg.model, cfg.calibration)
    # a score is acted on output_shift rows later, with the side of its own row
    late = tested.withColumn("p_follow", lag("p_follow", cfg.output_shift)) if cfg.output_shift else tested
    scored = late.join(paid, ["instrument", "ts"]).withColumn("pnl", F.col("_side") * F.col("_f") - cfg.costs_bps / 1e4)
    thresholds = meta.select_threshold(scored)
    if cfg.threshold is not None:
        thresholds = thresholds.withColumn("threshold", F.lit(cfg.threshold))
    return MetaFit(tuple(sorted(names)), meta.fit_models(rows, names, "label", cfg.model, calibration=cfg.calibration), tested, meta.brier_ece(tested), thresholds, meta.schema_fingerprint(names), meta.fingerprint(cfg))


def predict_meta_model(fit: MetaFit, panel: DataFrame, signal: str = "signal", cfg: MetaConfig = MetaConfig()) -> DataFrame:
    """(instrument, ts, p_follow, action, size, edge): what was known ``output_shift`` rows before; threshold 0.5 where none was found."""
    names = [c for c in fit.names if c in panel.columns]
    scored = meta.predict(_shifted(panel, names, cfg.feature_shift), fit.models, list(fit.names), calibration=cfg.calibration)
    lined = scored.join(fit.thresholds.select("instrument", F.col("threshold").alias("_t")), "instrument", "left")
    decided = meta.decide(lined, cfg.policy, F.coalesce("_t", F.lit(0.5)), signal=signal)
    given = ("p_follow", "action", "size", "edge")
    out = decided.select("instrument", "ts", *given)
    return out.withColumns({c: lag(c, cfg.output_shift) for c in given}) if cfg.output_shift else out


def save_meta_model(fit: MetaFit, folder: str) -> None:
    """A fit as Parquet folders, and its names and hashes as JSON beside them."""
    for name in ("models", "out_of_sample", "calibration", "thresholds"):
        getattr(fit, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = fit.models.sparkSession
    spark.createDataFrame([(list(fit.names), fit.schema_hash, fit.config_hash)], "names array<string>, schema_hash string, config_hash string").write.mode("overwrite").json(f"{folder}/facts")


def load_meta_model(spark: SparkSession, folder: str) -> MetaFit:
    """The fit that save_meta_model() wrote."""
    facts = spark.read.schema("names array<string>, schema_hash string, config_hash string").json(f"{folder}/facts").first()
    frames = {name: spark.read.parquet(f"{folder}/{name}") for name in ("models", "out_of_sample", "calibration", "thresholds")}
    return MetaFit(tuple(facts["names"]), schema_hash=facts["schema_hash"], config_hash=facts["config_hash"], **frames)


DECISIONS = "instrument string, ts timestamp_ntz, p_follow double, action int, size double, edge double"


def save_meta_output(decisions: DataFrame, fit: MetaFit, folder: str) -> None:
    """Decisions as JSON lines, with the thresholds that they were taken by and the hashes of the fit beside them."""
    decisions.selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in DECISIONS.split(", "))).write.mode("overwrite").json(f"{folder}/decisions")
    fit.thresholds.withColumns({"schema_hash": F.lit(fit.schema_hash), "config_hash": F.lit(fit.config_hash)}).write.mode("overwrite").json(f"{folder}/facts")


def load_meta_output(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The decisions and the facts that save_meta_output() wrote."""
    facts = "instrument string, threshold double, mean_pnl double, schema_hash string, config_hash string"
    return spark.read.schema(DECISIONS).json(f"{folder}/decisions"), spark.read.schema(facts).json(f"{folder}/facts")
