from .registry import CATALOG
from . import q_sources, q_resample, q_features, q_gaps, q_structure, q_labels, q_outliers, q_stats, q_hmm, q_models, q_streaming  # noqa: F401

__all__ = ["CATALOG"]
