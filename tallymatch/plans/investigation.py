"""Root-cause investigation of every flagged row of a run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallymatch.config import ReconConfig
from tallymatch.operators import investigate as inv
from tallymatch.sinks import written


@dataclass(frozen=True)
class Investigation:
    """The evidence frames of one run, all lazy but the cases. History and presence read the whole tables, not the run range.

    Several branches read the cases, so ``of`` writes them once; the result they are taken from is read once.
    """

    cases: DataFrame
    history: DataFrame
    presence: DataFrame
    checked: DataFrame
    cfg: ReconConfig

    @classmethod
    def of(cls, source, result: DataFrame, cfg: ReconConfig, keys: DataFrame | None = None) -> Investigation:
        """All flagged rows, or the rows named by ``keys`` (company, part_num, location, period), flagged or not."""
        cases = written(inv.flagged(result, cfg) if keys is None else inv.chosen(result, keys, cfg))
        history = inv.usage_history(cases, source.usage_among(cases), cfg, source.reduces)
        presence = inv.forecast_presence(cases, source.forecast_among(cases), cfg, source.reduces)
        checked = inv.criteria(cases, history, source.part_master(), source.part_site(), cfg)
        return cls(cases, history, presence, checked, cfg)

    def root_cause(self, exclusions_on: bool | None = None) -> DataFrame:
        return inv.root_cause(self.cases, self.checked, self.presence, self.cfg, exclusions_on)
