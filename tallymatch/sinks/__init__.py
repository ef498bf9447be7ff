"""Result files, results kept by month, and intermediate tables."""

from tallymatch.sinks.monthly import MonthlyResult, month_ends
from tallymatch.sinks.results import read_result, shared_dir, write_result, written

__all__ = ["MonthlyResult", "month_ends", "read_result", "shared_dir", "write_result", "written"]
