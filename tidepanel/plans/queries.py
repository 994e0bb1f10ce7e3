"""All queries of the panel engine, by name, and their SQL."""

from . import evaluation_queries, file_queries, influence_queries, locality_queries, model_queries, panel_queries, resampling_queries, router_queries, selection_queries, survey_queries, training_queries  # noqa: F401
from .study import QUERIES, SQL  # noqa: F401
