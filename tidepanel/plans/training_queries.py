"""Queries that build feature matrices and train models on the panel of twenty cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clip, from_log
from ..functions.storage import stored
from ..operators import boosting, features, linear_models, metrics, selection
from .selection_queries import CellStudy, query
from .study import rounded

KEYS = ["cell", "origin_h", "hz"]

# Matrices

_WAVE = {"target_hour_sin": "sin(2 * pi() * (h % 24) / 24)", "target_hour_cos": "cos(2 * pi() * (h % 24) / 24)", "target_dow_sin": "sin(2 * pi() * ((h // 24 + 3) % 7) / 7)", "target_dow_cos": "cos(2 * pi() * ((h // 24 + 3) % 7) / 7)"}
_OWN = {f"origin_lag{k}": f"coalesce(max(z) FILTER (off = {336 - k}), median(z), 0)" for k in (1, 6, 12, 24, 48, 72, 168, 336)} | {f"origin_lag{k}_mask": f"(count(z) FILTER (off = {336 - k}))::DOUBLE" for k in (1, 6, 12, 24, 48, 72, 168, 336)}
for _k in (24, 72, 168, 336):
    _last = f"FILTER (off >= {336 - _k})"
    _OWN |= {f"roll{_k}_{n}": f"coalesce({f}(z) {_last}, median(z), 0)" for n, f in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max"))}
    _OWN |= {f"roll{_k}_std": f"coalesce(stddev_samp(z) {_last}, 0)", f"roll{_k}_missing_ratio": f"1 - count(z) {_last} / {_k}.0"}
_OWN["last_observed_age"] = "coalesce(336 - max(off) FILTER (z IS NOT NULL), 336)::DOUBLE"


def _matrix_sql(where: str, targets: bool) -> str:
    each = ", ".join(f"max({n}) FILTER (metric = {k}) AS {n}_m{k}" for k in range(4) for n in _OWN)
    told = ", ".join(f"round({n}_m{k}, 6) + 0.0 AS {n}_m{k}" for k in range(4) for n in _OWN)
    logs = ", ".join(f"max(z) FILTER (metric = {k}) AS t{k}" for k in range(4))
    return f""", so AS (SELECT cell, origin_h, metric, {", ".join(f"{v} AS {n}" for n, v in _OWN.items())} FROM hist GROUP BY ALL),
    sw AS (SELECT cell, origin_h, {each} FROM so GROUP BY ALL), tz AS (SELECT cell, h, {logs} FROM panel GROUP BY ALL),
    rows AS (SELECT w.cell, w.origin_h, (w.origin_h + hz - 1) AS h, hz, layer, sw.* EXCLUDE (cell, origin_h) FROM (SELECT *, unnest(range(1, 25))::INT AS hz FROM win) w JOIN sw ON sw.cell = w.cell AND sw.origin_h = w.origin_h WHERE {where})
    SELECT cell, origin_h, hz, (hz - 1)::DOUBLE AS horizon, {", ".join(f"round({v}, 6) + 0.0 AS {k}" for k, v in _WAVE.items())}, (((h // 24 + 3) % 7) >= 5)::INT::DOUBLE AS is_weekend,
        0::DOUBLE AS azimuth_sin, 1::DOUBLE AS azimuth_cos, 0::DOUBLE AS scene_code, 0::DOUBLE AS x, 0::DOUBLE AS y, {told}{", " + ", ".join(f"round(t{k}, 6) AS t{k}" for k in range(4)) if targets else ""} FROM rows {"JOIN tz USING (cell, h)" if targets else ""}"""


def _told(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*KEYS, *[(F.round(c, 6) + 0.0).alias(c) for c in features.standard_names()], *[F.round(c, 6).alias(c) for c in more])


class TrainingStudy(CellStudy):
    """A CellStudy with its matrix written once."""

    def __init__(self, study: CellStudy):
        super().__init__(study.spark, study.sf_dir)
        self.rows_ = stored(features.with_targets(features.standard_rows(self.windows, self.panel, self.history), self.panel), "matrix")

    def states(self, days: tuple[int, int], variants: tuple[str, ...] = ("full",), split: F.Column | None = None) -> DataFrame:
        """A row for each metric and variant: model = (split * 4 + metric) * variants + variant, y the metric's log target."""
        rows = selection.with_folds(self.rows_.where(F.col("day_rank").between(*days)))
        rows = rows.withColumn("split", F.explode(split) if split is not None else F.lit(0))
        n = len(variants)
        each = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(v).alias("variant"), F.col(f"t{m}").alias("y")) for m in range(4) for v in range(n)])
        # The panel's y is a place; the target takes the name y here, so the place is out of the way.
        rows = rows.withColumnRenamed("y", "place_y").withColumn("s", F.explode(each))
        return rows.withColumns({"model": ((F.col("split") * 4 + F.col("s.metric")) * n + F.col("s.variant")).cast("int"), "metric": F.col("s.metric"), "variant": F.col("s.variant"), "y": F.col("s.y")}).drop("s")


def _columns(variant: str, metric: int) -> list[str]:
    """The features that a model of a metric may use: its own, or those of all metrics."""
    return [c for c in NAMES if variant == "full" or not c.endswith(("_m0", "_m1", "_m2", "_m3")) or c.endswith(f"_m{metric}")]


NAMES = [("place_y" if c == "y" else c) for c in features.standard_names()]
VARIANTS = ("own", "full")


@query(_matrix_sql("layer IN ('fit', 'inner')", True))
def training_matrix(s: CellStudy) -> DataFrame:
    """The 175 columns of fit and inner requests with log targets, nulls kept."""
    windows = s.windows.where("layer IN ('fit', 'inner')")
    rows = features.standard_rows(windows, s.panel, s.history.where("layer IN ('fit', 'inner')"))
    return _told(features.with_targets(rows, s.panel), "t0", "t1", "t2", "t3")


@query(_matrix_sql("layer = 'holdout'", False))
def test_matrix(s: CellStudy) -> DataFrame:
    """The same columns of the holdout's requests, without targets."""
    return _told(features.standard_rows(s.windows.where("layer = 'holdout'"), s.panel, s.history.where("layer = 'holdout'")))


# Trees


def _settings(rounds: int) -> boosting.Settings:
    return boosting.Settings(rounds=rounds, depth=3, rate=0.15, bins=24, min_rows=20, patience=3)


def _scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """WAPE and mean absolute error of rows(y, p); actual values are raw."""
    return rows.where("y IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"), metrics.wape().alias("wape"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))


def _models(splits: range, variants: tuple[str, ...]) -> tuple[dict[int, float], dict[int, list[str]]]:
    n = len(variants)
    numbers = {(k * 4 + m) * n + v: (m, name) for k in splits for m in range(4) for v, name in enumerate(variants)}
    return dict.fromkeys(numbers, 0.5), {i: _columns(name, m) for i, (m, name) in numbers.items()}


def _selection(s: TrainingStudy, rounds: int) -> boosting.Boosted:
    """Models of both feature sets, grown on fit days and watched on inner days."""
    rows = s.states((1, 9), VARIANTS).withColumn("valid", F.col("day_rank") > 7)
    taus, columns = _models(range(1), VARIANTS)
    return boosting.fit(rows, NAMES, taus, columns, _settings(rounds))


@query()
def boosted_rounds(s: CellStudy) -> DataFrame:
    """Losses on fit and inner days by metric, feature set and number of trees, and whether the number is the chosen one."""
    found = _selection(TrainingStudy(s), 12)
    best = found.rounds()
    rows = [(r["model"] // 2, VARIANTS[r["model"] % 2], r["round"], r["train"], r["valid"], best.get(r["model"]) == r["round"]) for r in found.losses]
    return rounded(s.spark.createDataFrame(rows, "metric int, variant string, trees int, fit_loss double, inner_loss double, chosen boolean"))


@query()
def boosted_holdout_scores(s: CellStudy) -> DataFrame:
    """Trees with the chosen numbers of rounds, grown again on fit and inner days, on the holdout."""
    t = TrainingStudy(s)
    rounds = _selection(t, 12).rounds()
    taus, columns = _models(range(1), VARIANTS)
    model = boosting.fit(t.states((1, 9), VARIANTS).withColumn("valid", F.lit(False)), NAMES, taus, columns, _settings(12), rounds)
    judged = t.states((10, 16), VARIANTS).withColumnRenamed("y", "t")
    rows = boosting.predict(model, judged, ["metric", "variant", "t"]).select("metric", F.element_at(F.array(*map(F.lit, VARIANTS)), F.col("variant") + 1).alias("variant"), from_log("t").alias("y"), from_log("f").alias("p"))
    return rounded(_scores(rows, ["metric", "variant"]), 6)


@query()
def nested_boosted_scores(s: CellStudy) -> DataFrame:
    """Nested evaluation of trees: for each outer fold both feature sets are stopped early on the development days of the other cells, the
    better one is grown again on all days before the locked box, and judged there on the fold's own cells; fold -1 pools all."""
    t = TrainingStudy(s)
    others = F.filter(F.sequence(F.lit(0), F.lit(selection.FOLDS - 1)), lambda k: k != F.col("fold"))
    taus, columns = _models(range(selection.FOLDS), VARIANTS)
    first = boosting.fit(t.states((1, 13), VARIANTS, others).withColumn("valid", F.col("day_rank") > 10), NAMES, taus, columns, _settings(6))
    rounds = first.rounds()
    least = {r["model"]: r["valid"] for r in first.losses if rounds.get(r["model"]) == r["round"]}
    total = {(k, v): sum(least.get((k * 4 + m) * 2 + v, 0.0) for m in range(4)) for k in range(selection.FOLDS) for v in range(2)}
    choice = {k: min(range(2), key=lambda v, k=k: (total[k, v], v)) for k in range(selection.FOLDS)}
    own = {i: r for i, r in rounds.items() if i % 2 == choice[i // 8]}
    final = boosting.fit(t.states((1, 13), VARIANTS, others).withColumn("valid", F.lit(False)), NAMES, {i: 0.5 for i in own}, columns, _settings(4), own)
    judged = t.states((14, 16), VARIANTS, F.array("fold")).withColumnRenamed("y", "t")
    rows = boosting.predict(final, judged, ["split", "metric", "variant", "t"]).select("split", "metric", "variant", from_log("t").alias("y"), from_log("f").alias("p"))
    each = rows.withColumn("fold", F.explode(F.array("split", F.lit(-1))))
    variant = F.when(F.col("fold") >= 0, F.element_at(F.array(*map(F.lit, VARIANTS)), F.max("variant") + 1))
    out = each.where("y IS NOT NULL").groupBy("fold", "metric").agg(variant.alias("variant"), F.count("*").alias("n"), metrics.wape().alias("wape"))
    return rounded(out, 6)


# Quantiles

TAUS = (0.5, 0.7, 0.8, 0.9)

#: The two indicators that levels are fitted for.
LEVELLED = (2, 3)


def _levels(rows: DataFrame) -> DataFrame:
    """A row for each levelled metric and level; model = metric * 4 + place of the level."""
    each = F.array(*[F.struct(F.lit(m * 4 + k).alias("model"), F.lit(m).alias("metric"), F.lit(t).alias("tau"), F.col(f"t{m}").alias("y")) for m in LEVELLED for k, t in enumerate(TAUS)])
    rows = rows.withColumnRenamed("y", "place_y").withColumn("s", F.explode(each))
    return rows.withColumns({c: F.col(f"s.{c}") for c in ("model", "metric", "tau", "y")}).drop("s")


def _costs(rows: DataFrame, method: str) -> DataFrame:
    """Coverage and pinball cost, over the sum of actual values, of rows(metric, tau, y, p)."""
    cost = F.sum(F.col("tau") * F.greatest(F.col("y") - F.col("p"), F.lit(0.0)) + (1 - F.col("tau")) * F.greatest(F.col("p") - F.col("y"), F.lit(0.0))) / F.greatest(F.sum("y"), F.lit(1e-12))
    return rows.where("y IS NOT NULL").groupBy("metric", "tau").agg(F.lit(method).alias("method"), F.count("*").alias("n"), F.avg((F.col("y") <= F.col("p")).cast("double")).alias("coverage"), cost.alias("cost"))


@query()
def quantile_model_costs(s: CellStudy) -> DataFrame:
    """Linear and tree models of four levels for two indicators, trained before the holdout and judged on it."""
    t = TrainingStudy(s)
    names = [c for c in NAMES if c.endswith(("_m2", "_m3")) or c in NAMES[:6]]
    taus = {m * 4 + k: tau for m in LEVELLED for k, tau in enumerate(TAUS)}
    train, judged = (_levels(t.rows_.where(F.col("day_rank").between(*d))) for d in ((1, 9), (10, 16)))
    judged = judged.withColumnRenamed("y", "t")
    lines = linear_models.quantile_lines(train, names, taus, rounds=12)
    told = lambda rows: rows.select("metric", "tau", from_log("t").alias("y"), from_log("f").alias("p"))
    out = _costs(told(linear_models.quantile_values(lines, judged, ["metric", "tau", "t"])), "lines")
    trees = boosting.fit(train.withColumn("valid", F.col("day_rank") > 7), names, taus, None, _settings(8))
    return rounded(out.unionByName(_costs(told(boosting.predict(trees, judged, ["metric", "tau", "t"], trees.rounds())), "trees")), 5)


# Linear maps


@query()
def linear_map_scores(s: CellStudy) -> DataFrame:
    """Maps of remainder and trend, and of histories less their last value: penalty chosen on inner days, judged on the holdout."""
    stats = F.broadcast(metrics.normalization(s.history.where("layer = 'fit'")))  # a row for each metric
    windows = s.windows.where("layer IS NOT NULL")
    history = features.standardized(s.history.where("layer IS NOT NULL"), stats)
    targets = s.targets.where("layer IS NOT NULL").join(stats, "metric").withColumn("u", (F.log1p(clip("y", 0.0)) - F.col("mean")) / F.col("sd"))
    rows = stored(linear_models.sequences(history, targets).join(windows.select("cell", "origin_h"), ["cell", "origin_h"], "left_semi"), "sequences")
    out = None
    for kind in linear_models.KINDS:
        model = linear_models.linear_maps(rows.where("layer = 'fit'"), kind, (30.0, 1000.0), rounds=8)
        values = linear_models.map_values(model, rows.where("layer <> 'fit'")).join(stats, "metric")
        raw = values.select("metric", "penalty", "layer", *[features.restored(F.col(c), F.col("mean"), F.col("sd")).alias(n) for c, n in (("y", "y"), ("u", "p"))])
        scores = stored(_scores(raw, ["metric", "penalty", "layer"]), "scores")
        inner = scores.where("layer = 'inner'").groupBy("metric").agg(F.min_by("penalty", F.struct("wape", "penalty")).alias("penalty"))
        one = scores.where("layer = 'holdout'").join(inner, ["metric", "penalty"]).select(F.lit(kind).alias("kind"), "metric", "penalty", "n", "wape", "mae")
        out = one if out is None else out.unionByName(one)
    return rounded(out, 5)
