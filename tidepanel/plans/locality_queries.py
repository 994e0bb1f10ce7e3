"""Queries on the audit of request locality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored
from ..operators import locality
from .selection_queries import CellStudy, query

AUDITED = 8

_STRATA = """au AS (SELECT cell, origin_h, count(*) FILTER (z IS NULL) AS missing_count, count(*) AS input_elements FROM hist WHERE layer = 'holdout' GROUP BY ALL),
    ab AS (SELECT *, strftime(make_timestamp(origin_h * 3600000000), '%Y-%m-%d') AS target_date, CASE WHEN missing_count = 0 THEN 'none_0pct' WHEN missing_count / input_elements <= 0.10 THEN 'low_0_to_10pct' WHEN missing_count / input_elements <= 0.25 THEN 'moderate_10_to_25pct' ELSE 'high_above_25pct' END AS missingness_bin FROM au)"""


def _requests(s: CellStudy) -> tuple[DataFrame, DataFrame]:
    history = stored(s.history.where("layer = 'holdout'").select("cell", "origin_h", "metric", "off", "z"), "copies")
    return locality.audit_requests(s.windows.where("layer = 'holdout'"), history), history


@query(f", {_STRATA} SELECT (row_number() OVER (ORDER BY cell, origin_h) - 1)::BIGINT AS index, cell, origin_h, target_date, missing_count, input_elements, missingness_bin FROM ab")
def audit_request_strata(s: CellStudy) -> DataFrame:
    return _requests(s)[0].drop("stratum")


@query()
def audit_request_sample(s: CellStudy) -> DataFrame:
    """Requests by round robin over date and missingness, cells not seen yet first."""
    return locality.round_robin(_requests(s)[0], 32).select("turn", "index", "cell", "target_date", "missingness_bin")


def _audits(s: CellStudy) -> DataFrame:
    requests, history = _requests(s)
    chosen = stored(locality.round_robin(requests, AUDITED).select("index", "cell", "origin_h"), "audited")
    return locality.audit(lambda rows: locality.forecasts(rows, s.priors), history, chosen)


@query()
def request_locality_audit(s: CellStudy) -> DataFrame:
    """For each audited request: what was changed around it, and how many outputs differ in any bit."""
    return _audits(s)


@query()
def request_locality_summary(s: CellStudy) -> DataFrame:
    return locality.summary(_audits(s)).withColumn("passed", F.col("violations") == 0)
