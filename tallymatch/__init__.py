"""Usage-vs-forecast reconciliation as Spark DataFrame operators."""

from tallymatch.config import CategoryLabels, ReconConfig

__all__ = ["CategoryLabels", "ReconConfig"]
