"""Dominance (preference) queries over multidimensional points, on Spark DataFrames."""

from .operators.score import dominance_score
from .operators.skyline import skyline
from .operators.topk import topk_dominating, topk_skyline

__all__ = ["dominance_score", "skyline", "topk_dominating", "topk_skyline"]
