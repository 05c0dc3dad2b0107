"""Importing this module registers every query."""
from checks import (  # noqa: F401
    q_candidates,
    q_cleaning,
    q_diagnostics,
    q_features,
    q_metrics,
    q_models,
    q_reliability,
    q_sources,
    q_splits,
    q_streaming,
)
