"""Queries that train routers on the panel of twenty cells and judge them on the holdout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import from_log, to_log
from ..functions.storage import stored
from ..operators import evidence, metrics, neural_router, router_training
from .selection_queries import CellStudy, query
from .study import SEED, rounded

#: Variants without augmentation: the others differ from them in their training rows only.
TRAINED = tuple(v for v in neural_router.VARIANTS if v.augmentation == "clean" and v.attention != "fixed")
STEPS = 14


def _rows(s: CellStudy) -> DataFrame:
    """Experts with contexts and log targets of all layered requests, written once."""
    own = evidence.context(s.history, s.priors).select("cell", "origin_h", "metric", F.array("mean", "median", "sd", "missing", "delta").alias("own"))
    both = neural_router.shared_context(own.withColumn("context", F.col("own"))).withColumnRenamed("context", "all")
    rows = s.experts.where("layer IS NOT NULL").join(both, ["cell", "origin_h", "metric"])
    return stored(rows.select("cell", "origin_h", "hz", "metric", "layer", "v", "a", "rho", "own", "all", "y", to_log("y").alias("t")), "experts")


def _chosen(rows: DataFrame) -> router_training.Trained:
    return router_training.train(rows, TRAINED, steps=STEPS, patience=5, rate=0.03, seed=SEED)


@query()
def router_training_steps(s: CellStudy) -> DataFrame:
    """Loss on fit days and macro WAPE on inner days of every step, and whether it is the chosen one."""
    found = _chosen(_rows(s))
    rows = [(r["model"], r["step"], r["loss"], r["inner_wape"], found.steps[r["model"]] == r["step"]) for r in found.told]
    return rounded(s.spark.createDataFrame(rows, "variant string, step int, fit_loss double, inner_wape double, chosen boolean"), 5)


@query()
def trained_router_scores(s: CellStudy) -> DataFrame:
    """Routers trained again on fit and inner days for the chosen numbers of steps, and the fixed mixture, on the holdout."""
    rows = _rows(s)
    final = router_training.train(rows, TRAINED, fit=("fit", "inner"), inner=None, steps=_chosen(rows).steps, rate=0.03, seed=SEED)
    out, judged = None, rows.where("layer = 'holdout' AND y IS NOT NULL")
    for variant in (neural_router.VARIANTS[0], *TRAINED):
        w = final.weights.get(variant.name) or {}
        one = neural_router.forward(judged.withColumn("context", F.col("own")), variant, w).select(F.lit(variant.name).alias("variant"), "metric", "y", "p")
        out = one if out is None else out.unionByName(one)
    return rounded(out.groupBy("variant", "metric").agg(F.count("*").alias("n"), metrics.wape().alias("wape"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae")), 5)


@query()
def trained_router_forecasts(s: CellStudy) -> DataFrame:
    """Every holdout forecast of the full router (reliability and bounded residual) after training, with its entropy."""
    rows, full = _rows(s), [v for v in TRAINED if v.name == "A5_residual"]
    steps = router_training.train(rows, full, steps=STEPS, patience=5, rate=0.03, seed=SEED).steps
    final = router_training.train(rows, full, fit=("fit", "inner"), inner=None, steps=steps, rate=0.03, seed=SEED)
    one = neural_router.forward(rows.where("layer = 'holdout'").withColumn("context", F.col("own")), full[0], final.weights[full[0].name])
    return rounded(one.select("cell", "origin_h", "hz", "metric", from_log("t").alias("y"), "p", "entropy", "residual"), 5)
