"""Imports every query family so that it registers itself."""

from checks import genome_queries  # noqa: F401
from checks import interval_queries  # noqa: F401
from checks import graph_queries  # noqa: F401
from checks import matrix_queries  # noqa: F401
from checks import embedding_queries  # noqa: F401
from checks import aggregate_queries  # noqa: F401
from checks import inference_queries  # noqa: F401
from checks import cohort_queries  # noqa: F401
from checks import source_queries  # noqa: F401
