"""Text evidence on Spark: typed features of short texts, count tables, and log-odds scores."""

from .params import ExtractParams, ModelParams
from .plans.model import EvidenceModel

__all__ = ["EvidenceModel", "ExtractParams", "ModelParams"]
