"""Run configuration: range, companies, site mapping, usage and exclusion rules, labels."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import date


# The category labels, and the names of methods that exclude a part (in ReconConfig below).
@dataclass(frozen=True)
class CategoryLabels:
    """Names of the variance categories. The default is the report set, ``snake()`` the detail-view set."""

    match: str = "Perfect Match"
    missing_forecast: str = "Missing From Forecast"
    missing_usage: str = "Missing From Usage"
    more_forecast: str = "More In Forecast"
    more_usage: str = "More In Usage"
    error: str = "ERROR"

    @classmethod
    def snake(cls) -> CategoryLabels:
        return cls(
            "PERFECT_MATCH", "MISSING_FROM_FORECAST", "MISSING_FROM_USAGE", "MORE_IN_FORECAST", "MORE_IN_USAGE"
        )

    @property
    def critical(self) -> list[str]:
        return [self.missing_forecast, self.missing_usage]

    @property
    def variances(self) -> list[str]:
        return [self.more_forecast, self.more_usage, self.missing_usage, self.missing_forecast]

    @property
    def stacking_order(self) -> list[str]:
        """Bottom to top, as the stacked month chart draws them."""
        return [self.match, self.more_forecast, self.more_usage, self.missing_usage, self.missing_forecast]


@dataclass(frozen=True)
class ReconConfig:
    """One immutable value that every operator reads its parameters from."""

    start: date
    end: date
    companies: tuple[str, ...]
    # company -> plant -> location, in the order that decides the reverse mapping of shared locations
    locations: dict[str, dict[str, str]]
    excluded_companies: tuple[str, ...] = ()

    # detail view only: location of every plant of a company that is not listed
    default_locations: dict[str, str] = field(default_factory=dict)
    default_plant: str = "HQ"

    # usage rule: the head office site adds up several components, everything else uses one
    hq_company: str = "NORTH"
    hq_plant: str = "HQ"
    hq_location: str = "North HQ"
    hq_components: tuple[str, ...] = ("qty_a", "qty_b", "qty_c")
    default_component: str = "qty_c"

    # exclusion rules
    apply_exclusions: bool = True
    excluded_classes: tuple[str, ...] = ("RAW", "CSM")
    excluded_methods: tuple[int, ...] = (1, 2, 3)
    excluded_method_names: tuple[str, ...] = ("Exception", "Min/Max", "New- No History")
    method_code_type: str = "Methods"
    lookback_months: int = 12
    max_rare_transactions: int = 2
    max_low_units: int = 2
    # 'run_range' counts only months of the run itself, 'full_history' the whole look-back window
    frequency_source: str = "run_range"
    # 'transactions' or 'units'
    frequency_measure: str = "transactions"

    # compare
    pre_aggregate: bool = False
    normalize_keys: bool = False
    # 'double', or e.g. 'decimal(18,4)'
    amount_type: str = "double"
    labels: CategoryLabels = CategoryLabels()

    # detail view calendar; None stands for the current date
    as_of: date | None = None
    sort_epoch: date | None = None

    output_format: str = "csv"
    output_path: str = "reconciliation_results"
    # 'run': one folder per run; 'months': one result, of which each run replaces its own months
    result_layout: str = "run"

    def __post_init__(self) -> None:
        if self.frequency_source not in ("run_range", "full_history"):
            raise ValueError(f"unknown frequency_source: {self.frequency_source}")
        if self.frequency_measure not in ("transactions", "units"):
            raise ValueError(f"unknown frequency_measure: {self.frequency_measure}")
        if self.result_layout not in ("run", "months"):
            raise ValueError(f"unknown result_layout: {self.result_layout}")

    def location_rows(self) -> list[tuple[str, str, str]]:
        return [(c, p, loc) for c, plants in self.locations.items() for p, loc in plants.items()]

    def reverse_sites(self) -> dict[tuple[str, str], str]:
        """(company, location) -> plant; the first plant listed for a shared location wins."""
        sites: dict[tuple[str, str], str] = {}
        for company, plant, location in self.location_rows():
            sites.setdefault((company, location), plant)
        return sites

    @classmethod
    def from_dict(cls, raw: dict) -> ReconConfig:
        """Build from the nested layout of a config file; see ``conf/example.json``."""
        run, rules, options = raw["validation"], raw.get("rules", {}), raw.get("options", {})
        usage_rule = rules.get("usage_calculation", {})
        known = {
            "start": date.fromisoformat(run["start_date"]),
            "end": date.fromisoformat(run["end_date"]),
            "companies": tuple(run["companies"]),
            "excluded_companies": tuple(run.get("excluded_companies", ())),
            "locations": raw["mappings"]["locations"],
            "default_locations": raw["mappings"].get("default_locations", {}),
        }
        for name in ("hq_company", "hq_plant", "hq_location", "default_component"):
            if name in usage_rule:
                known[name] = usage_rule[name]
        if "hq_components" in usage_rule:
            known["hq_components"] = tuple(usage_rule["hq_components"])
        exclusion = rules.get("exclusions", {})
        for name in ("excluded_classes", "excluded_methods", "excluded_method_names"):
            if name in exclusion:
                known[name] = tuple(exclusion[name])
        for name in ("method_code_type", "lookback_months", "max_rare_transactions", "max_low_units"):
            if name in exclusion:
                known[name] = exclusion[name]
        if "labels" in raw:
            known["labels"] = CategoryLabels(**raw["labels"])
        for name in (
            "default_plant",
            "apply_exclusions",
            "frequency_source",
            "frequency_measure",
            "pre_aggregate",
            "normalize_keys",
            "amount_type",
            "output_format",
            "output_path",
            "result_layout",
        ):
            if name in options:
                known[name] = options[name]
        for name in ("as_of", "sort_epoch"):
            if options.get(name):
                known[name] = date.fromisoformat(options[name])
        return cls(**known)

    @classmethod
    def from_json(cls, path: str) -> ReconConfig:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))
