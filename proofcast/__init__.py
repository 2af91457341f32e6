"""Forecast verification at archive scale, written as Spark DataFrame operators."""

from proofcast.operators.ensemble import build_mme, load_forecast, normal_to_ensemble
from proofcast.operators.observations import seasonal_anomaly
from proofcast.operators.ranks import rank_distribution, top_n
from proofcast.operators.reliability import reliability
from proofcast.operators.scoring import score
from proofcast.operators.skill import skill

__all__ = [
    "build_mme",
    "load_forecast",
    "normal_to_ensemble",
    "rank_distribution",
    "reliability",
    "score",
    "seasonal_anomaly",
    "skill",
    "top_n",
]
