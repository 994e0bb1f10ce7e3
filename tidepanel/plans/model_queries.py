"""Queries on routing variants, request-local masks, fits, reports, joins by identity and more files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources
from ..operators import audit, corruption, evidence, metrics, models, neural_router
from .evaluation_queries import _AUC, _IND, _mask
from .study import SEED, Study, query, rounded
from .survey_queries import _SEEDED, _SEEN, _WAPE, KEYS, _folder, _seeded


def _written(s: Study, rows: DataFrame, name: str) -> DataFrame:
    """rows as a table in the shared folder, for plans that use them many times."""
    path = _folder(s, name)
    rows.write.parquet(path)
    return s.spark.read.parquet(path)


# Routing variants


_VARIANTS = """('A0_fixed', 'fixed', true, false, 0.0, 'clean', 0.0, false), ('A0_global_static', 'global_softmax', true, false, 0.0, 'clean', 0.0, false), ('A0_horizon_indicator', 'horizon_softmax', true, false, 0.0, 'clean', 0.0, false),
    ('A1_softmax', 'softmax', false, false, 0.0, 'clean', 0.0, false), ('A2_entmax', 'entmax15', false, false, 0.0, 'clean', 0.0, false), ('A3_hard_mask', 'entmax15', true, false, 0.0, 'clean', 0.0, false), ('A4_reliability', 'entmax15', true, true, 0.0, 'clean', 0.0, false),
    ('A5_residual', 'entmax15', true, true, 0.5, 'clean', 0.0, false), ('A6_mcar_aug', 'entmax15', true, true, 0.5, 'mcar', 0.0, false), ('A6_block_aug', 'entmax15', true, true, 0.5, 'block', 0.0, false), ('A6_mixed_aug', 'entmax15', true, true, 0.5, 'mixed', 0.0, false),
    ('A6_consistency', 'entmax15', true, true, 0.5, 'mixed', 0.05, false), ('A7_cross_indicator', 'entmax15', true, true, 0.5, 'mixed', 0.05, true)"""


@query(f"SELECT name, attention, hard_mask, reliability, residual_bound::DOUBLE AS residual_bound, augmentation, consistency_weight::DOUBLE AS consistency_weight, cross_indicator, round(CASE WHEN hard_mask THEN (SELECT avg(len([x FOR x IN a IF x])) FROM experts) ELSE 8 END, 6) AS open_experts FROM (VALUES {_VARIANTS}) v(name, attention, hard_mask, reliability, residual_bound, augmentation, consistency_weight, cross_indicator)")
def router_variants(s: Study) -> DataFrame:
    """The variants, and how many experts take part in a forecast on average: those available, or all without the hard mask."""
    available = s.experts.agg(F.avg(F.size(F.filter("a", lambda x: x))).alias("available"))
    rows = s.spark.createDataFrame([tuple(vars(v).values()) for v in neural_router.VARIANTS], "name string, attention string, hard_mask boolean, reliability boolean, residual_bound double, augmentation string, consistency_weight double, cross_indicator boolean")
    return rows.crossJoin(available).withColumn("open_experts", F.round(F.when(F.col("hard_mask"), F.col("available")).otherwise(8.0), 6)).drop("available")  # one row


@query()
def variant_forecasts(s: Study) -> DataFrame:
    """The forward pass of every variant on all requests, with drawn weights."""
    about = evidence.context(s.history, s.priors).select("cell", "origin_h", "metric", F.array("mean", "median", "sd", "missing", "delta").alias("own"))
    # Contexts go to hours after the metrics of a request have met, so the window is over requests.
    about = neural_router.shared_context(about.withColumn("context", F.col("own"))).withColumnRenamed("context", "all")
    rows = _written(s, s.experts.select(*KEYS, "v", "a", "rho").join(about, ["cell", "origin_h", "metric"]), "experts")
    out = []
    for variant in neural_router.VARIANTS:
        one = rows.withColumn("context", F.col("all" if variant.cross_indicator else "own")).drop("all", "own")
        one = neural_router.forward(one, variant, neural_router.drawn_weights(variant, seed=SEED))
        out.append(one.select(F.lit(variant.name).alias("variant"), *KEYS, "entropy", "residual", "p"))
    total = out[0]
    for one in out[1:]:
        total = total.unionByName(one)
    return rounded(total, 6)


# Masks of each request by itself


def _requests(s: Study) -> DataFrame:
    return s.windows.select("cell", "origin_h")


@query()
def request_masks(s: Study) -> DataFrame:
    return corruption.request_masks(_requests(s), "request", [(m, r) for m in corruption.MECHANISMS for r in corruption.RATES])


@query()
def lock_box_masks(s: Study) -> DataFrame:
    return corruption.request_masks(_requests(s), "lock_box", [("random", r) for r in (0.1, 0.2, 0.3)] + [("block", n) for n in (24, 48, 96)])


@query()
def asynchronous_mask_overlap(s: Study) -> DataFrame:
    return corruption.mask_overlap(corruption.request_masks(_requests(s), "each_metric", [("independent_random", r) for r in (0.1, 0.2, 0.3)] + [("staggered_block", 48)]))


def _rates(prefix: str) -> str:
    return f"round(avg((x IS NULL)::INT), 7) AS {prefix}_original, round(avg(block::INT), 7) AS {prefix}_selected, round(avg((block AND x IS NOT NULL)::INT), 7) AS {prefix}_newly_removed, round(avg((block OR x IS NULL)::INT), 7) AS {prefix}_final"


@query(f""", {_mask(0.3)}, e AS (SELECT {_rates("exposure")} FROM hist JOIN mk USING (cell, h, metric) WHERE layer = 'holdout'), u AS (SELECT {_rates("unique")} FROM mk JOIN panel USING (cell, h, metric))
    SELECT 'absolute_cell_timeline' AS corruption_scope, 'tail of each cell''s unique evaluated timeline' AS recent_tail_definition, * FROM u, e""")
def corruption_report(s: Study) -> DataFrame:
    return rounded(corruption.report(s.history.where("layer = 'holdout'").join(s.mask("block", 0.3), ["cell", "h", "metric"])))


_MIXED = lambda prefix: _rates(prefix).replace("block", "mixed")


@query(f""", {_mask(0.15).replace("layer = 'holdout'", "layer = 'fit'")}, e AS (SELECT {_MIXED("exposure")} FROM hist JOIN mk USING (cell, h, metric) WHERE layer = 'fit'), u AS (SELECT {_MIXED("unique")} FROM mk JOIN panel USING (cell, h, metric))
    SELECT 'mixed' AS augmentation, 0.15::DOUBLE AS requested_rate, (SELECT count(y) FROM tgt WHERE layer = 'fit') AS targets_kept, * FROM u, e""")
def augmentation_view(s: Study) -> DataFrame:
    """The mixed corruption of training requests' inputs: what it takes from histories and from hours; targets stay."""
    mask = s.mask("mixed", 0.15, "fit")
    rates = corruption.report(s.history.where("layer = 'fit'").join(mask, ["cell", "h", "metric"]))
    kept = s.targets.where("layer = 'fit'").agg(F.count("y").alias("targets_kept"))
    return rounded(rates.drop("corruption_scope", "recent_tail_definition").crossJoin(kept).select(F.lit("mixed").alias("augmentation"), F.lit(0.15).alias("requested_rate"), "*"))


# Fits


@query()
def ridge_coefficients(s: Study) -> DataFrame:
    """Ridge fits of log targets on the eight experts' values, for each metric and penalty."""
    names = [f"v{k}" for k in range(8)]
    rows = _written(s, s.experts.where("layer = 'fit' AND y IS NOT NULL").select("metric", F.log1p("y").alias("t"), *[F.get("v", F.lit(k)).alias(n) for k, n in enumerate(names)]), "fit")
    out = []
    for metric in range(4):
        for alpha, (intercept, coefficients) in models.ridge(rows.where(F.col("metric") == metric), names, "t").items():
            out += [(metric, alpha, name, value) for name, value in (("intercept", intercept), *coefficients.items())]
    return rounded(s.spark.createDataFrame(out, "metric int, alpha double, name string, value double"), 5)


# Reports


@query(f""", x AS ({_IND}), m AS (SELECT method, avg(wape) AS macro_wape, avg(mae) AS macro_mae FROM x GROUP BY method), w AS (SELECT method, {_WAPE} AS pooled_wape, count(*) AS observations FROM pred WHERE {_SEEN} GROUP BY method), a AS (SELECT method, count(*) AS samples, {_AUC} AS auc FROM ok GROUP BY method)
    SELECT method, samples, round(auc, 6) AS auc, observations, round(pooled_wape, 6) AS pooled_wape, round(macro_wape, 6) AS macro_wape, round(macro_mae, 6) AS macro_mae FROM m JOIN w USING (method) JOIN a USING (method)""")
def method_summary(s: Study) -> DataFrame:
    """What reports hold of each method, side by side."""
    hits = metrics.hit_scores(metrics.official_filter(s.rows), ("method",)).select("method", "samples", "auc")
    seen = s.predictions.where(_SEEN).groupBy("method").agg(F.count("*").alias("observations"))
    macro = metrics.macro(metrics.indicator_metrics(s.predictions)).select("method", "macro_wape", "macro_mae")
    rows = hits.join(seen, "method").join(metrics.pooled_wape(s.predictions), "method").join(macro, "method")
    return rounded(rows.select("method", "samples", "auc", "observations", "pooled_wape", "macro_wape", "macro_mae"), 6)


@query(f", x AS ({_IND}) SELECT method, " + ", ".join(f"max({c}) FILTER (metric = {k}) AS {c}_m{k}" for c in ("n",) for k in range(4)) + ", " + ", ".join(f"round(max({c}) FILTER (metric = {k}), 6) AS {c}_m{k}" for c in ("mae", "wape") for k in range(4)) + " FROM x GROUP BY method")
def flattened_scores(s: Study) -> DataFrame:
    rows = metrics.indicator_metrics(s.predictions)
    return rounded(rows.groupBy("method").agg(*[F.max(F.when(F.col("metric") == k, F.col(c))).alias(f"{c}_m{k}") for c in ("n", "mae", "wape") for k in range(4)]), 6)


@query(f", w AS (SELECT method, round({_WAPE}, 9)::DECIMAL(18,9) AS w FROM pred WHERE {_SEEN} GROUP BY method), d AS (SELECT w.method, w.w, w.w - b.w AS d FROM w, w b WHERE b.method = 'last_week') SELECT method, round(100 * w, 2)::DECIMAL(18,2)::VARCHAR AS percent, CASE WHEN d >= 0 THEN '+' ELSE '' END || round(100 * d, 3)::DECIMAL(18,3)::VARCHAR AS difference FROM d")
def formatted_scores(s: Study) -> DataFrame:
    """Percentages as text, halves rounded up, and signed differences from the last week's."""
    rows = metrics.pooled_wape(s.predictions).select("method", F.round("pooled_wape", 9).cast("decimal(18,9)").alias("w"))
    rows = rows.join(F.broadcast(rows.where("method = 'last_week'").select(F.col("w").alias("base"))), F.lit(True)).withColumn("d", F.col("w") - F.col("base"))
    text = lambda c, places: F.round(F.lit(100).cast("decimal(3,0)") * F.col(c), places).cast(f"decimal(18,{places})").cast("string")
    return rows.select("method", text("w", 2).alias("percent"), F.concat(F.when(F.col("d") >= 0, "+").otherwise(""), text("d", 3)).alias("difference"))


# Joins by identity, subsets


@query("SELECT method, count(*) AS rows, count(x) AS observed, sum((y IS DISTINCT FROM x)::INT)::BIGINT AS differing, round(sum(abs(x - p)), 3) AS error FROM pred JOIN panel USING (cell, h, metric) WHERE p IS NOT NULL GROUP BY method")
def identity_joined_targets(s: Study) -> DataFrame:
    """Predictions joined with the panel's own values by cell and hour; values that are not those of the row's target count as differing."""
    own = s.panel.select("cell", "h", "metric", F.col("x").alias("actual"))
    rows = s.predictions.where("p IS NOT NULL").join(own, ["cell", "h", "metric"])
    return rows.groupBy("method").agg(F.count("*").alias("rows"), F.count("actual").alias("observed"), F.count_if(~F.col("y").eqNullSafe(F.col("actual"))).alias("differing"), F.round(F.sum(F.abs(F.col("actual") - F.col("p"))), 3).alias("error"))


@query("SELECT method, cell, origin_h, hz, layer, " + ", ".join(f"round(p[{k + 1}], 6) AS p{k}" for k in range(4)) + " FROM rw WHERE n = 4 AND list_min(y) > 0")
def complete_rows(s: Study) -> DataFrame:
    """The subset of wide rows whose mask (all four values there and positive) is true."""
    rows = s.rows.where(F.forall("y", lambda v: v.isNotNull() & (v > 0)))
    return rounded(rows.select("method", "cell", "origin_h", "hz", "layer", *[F.get("p", F.lit(k)).alias(f"p{k}") for k in range(4)]), 6)


# Files


@query(f", {_SEEDED} SELECT cell, origin_h, hz::INT AS hz, metric::INT AS metric, " + ", ".join(f"round(max(p) FILTER (seed = {k}), 6) AS seed_{k}" for k in range(5)) + ", round(avg(p), 6) AS ensemble FROM sd GROUP BY ALL")
def seed_file_rows(s: Study) -> DataFrame:
    """A gzip CSV with a column for each seed and their mean, read back."""
    wide = _seeded(s).groupBy(*KEYS).agg(*[F.max(F.when(F.col("seed") == k, F.col("p"))).alias(f"seed_{k}") for k in range(5)], F.avg("p").alias("ensemble"))
    path = _folder(s, "seeds")
    wide.write.option("header", True).option("compression", "gzip").csv(path)
    back = sources.read_rows(s.spark, path, tuple(KEYS))
    return rounded(back.select("cell", F.col("origin_h").cast("long"), F.col("hz").cast("int"), F.col("metric").cast("int"), *[F.col(c).cast("double") for c in wide.columns if c not in KEYS]), 6)


@query("SELECT (day_rank % 5)::INT AS fold, cell, origin_h, hz::INT AS hz, metric::INT AS metric, round(p, 6) AS p FROM pred WHERE method = 'fixed'")
def fold_file_rows(s: Study) -> DataFrame:
    """Predictions by fold, a folder each, read back with a check that no key is there twice."""
    path = _folder(s, "folds")
    rows = s.predictions.where("method = 'fixed'").select(F.expr("cast(day_rank % 5 AS int)").alias("fold"), *KEYS, "p")
    rows.repartition("fold", "cell").write.partitionBy("fold").parquet(path)
    back = s.spark.read.parquet(path)
    once = back.groupBy(*KEYS).agg(F.count("*").alias("n"), F.max("fold").alias("fold"), F.max("p").alias("p"))
    once = once.withColumn("fold", F.when(F.col("n") == 1, F.col("fold")).otherwise(F.raise_error(F.lit("a key is in two folds")).cast("int")))
    return rounded(once.select("fold", "cell", "origin_h", F.col("hz").cast("int"), F.col("metric").cast("int"), "p"), 6)


@query("SELECT cell, origin_h, hz::INT AS hz, metric::INT AS metric, round(entropy, 6) + 0.0 AS entropy, len([x FOR x IN a IF x])::INT AS available, round(alpha[2], 6) AS second_weight FROM routed")
def audit_file_rows(s: Study) -> DataFrame:
    """Forecast audits as nested JSON lines, read back."""
    path = _folder(s, "audit")
    record = F.struct("cell", "origin_h", "hz", "metric", F.struct(F.struct("alpha", "a").alias("experts"), "entropy").alias("routing"))
    s.routed.select(F.to_json(record).alias("value")).write.text(path)
    back = s.spark.read.schema("cell string, origin_h long, hz int, metric int, routing struct<experts: struct<alpha: array<double>, a: array<boolean>>, entropy: double>").json(path)
    return back.select("cell", "origin_h", "hz", "metric", (F.round("routing.entropy", 6) + 0.0).alias("entropy"), F.size(F.filter("routing.experts.a", lambda x: x)).alias("available"), F.round(F.get("routing.experts.alpha", F.lit(1)), 6).alias("second_weight"))


@query("SELECT length(t)::BIGINT AS length, sha256(t) AS sha256 FROM (SELECT string_agg(n_name || chr(10), '' ORDER BY n_name) AS t FROM nation GROUP BY n_regionkey)")
def file_manifest(s: Study) -> DataFrame:
    """Size and SHA-256 of files, one for each region."""
    path = _folder(s, "manifest")
    s.table("nation").repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_name").select("n_name", "n_regionkey").write.partitionBy("n_regionkey").text(path)
    return audit.manifest(s.spark, path).where("name LIKE 'part-%'").select("length", "sha256")


@query("""SELECT coalesce(f.name, e.name) AS name, CASE WHEN f.h IS NULL THEN 'missing' WHEN e.h IS NULL THEN 'unexpected' ELSE 'different' END AS problem
    FROM (SELECT n_regionkey::VARCHAR AS name, sha256(string_agg(n_name || chr(10), '' ORDER BY n_name)) AS h FROM nation GROUP BY n_regionkey) f
    FULL JOIN (SELECT n_regionkey::VARCHAR AS name, sha256(string_agg(CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END || chr(10), '' ORDER BY n_name)) AS h FROM nation WHERE n_regionkey <> 0 GROUP BY n_regionkey UNION ALL SELECT 'customers', sha256(count(*)::VARCHAR) FROM customer) e ON e.name = f.name
    WHERE f.h IS DISTINCT FROM e.h""")
def manifest_differences(s: Study) -> DataFrame:
    """Files of nations by region against a manifest that lacks one region, knows another under other names and lists a file that is not there."""
    nation, path = s.table("nation"), _folder(s, "regions")
    nation.repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_name").select("n_name", "n_regionkey").write.partitionBy("n_regionkey").text(path)
    files = s.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("path LIKE '%/part-%'")
    found = files.select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))
    line = F.concat(F.when(F.col("n_regionkey") == 2, F.lower("n_name")).otherwise(F.col("n_name")), F.lit("\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", line.alias("line")))), lambda x: x["line"]), "")
    known = nation.where("n_regionkey <> 0").groupBy(F.col("n_regionkey").cast("string").alias("name")).agg(text.alias("t")).select("name", F.octet_length("t").cast("long").alias("length"), F.sha2("t", 256).alias("sha256"))
    gone = s.table("customer").agg(F.count("*").cast("string").alias("t")).select(F.lit("customers").alias("name"), F.octet_length("t").cast("long").alias("length"), F.sha2("t", 256).alias("sha256"))
    return audit.manifest_problems(found, known.unionByName(gone))
