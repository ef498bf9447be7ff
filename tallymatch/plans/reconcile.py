"""The reconciliation run: scan, normalize, exclude, compare, categorize."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallymatch.config import ReconConfig
from tallymatch.operators import compare as cmp
from tallymatch.operators import metadata as md
from tallymatch.operators import normalize as nz


def prepared_usage(source, cfg: ReconConfig, observed: Observation | None = None) -> DataFrame:
    """Normalized usage with metadata flags and, if exclusions are on, without excluded and infrequent parts.

    ``observed`` gets the counts of both filters while the run's own stage passes the rows on.
    """
    raw, metadata = nz.scan_usage(source, cfg), md.scan_part_metadata(source, cfg)
    if not cfg.apply_exclusions:
        return md.enrich_metadata(nz.normalize_usage(raw, cfg), metadata, source.unique_grain)
    if source.unique_grain and cfg.frequency_source == "run_range":
        flagged = md.with_own_facts(raw, metadata, cfg)
    else:
        facts = md.key_facts(metadata, md.frequency_usage(source, cfg), cfg)
        flagged = md.with_key_facts(nz.normalize_usage(raw, cfg), facts)
    if observed is not None:
        flagged = flagged.observe(observed, *md.filter_counts(cfg))
    return flagged.where(~F.col("excluded") & md.frequent_enough(cfg)).drop("excluded")


def joined_sides(source, cfg: ReconConfig, keep_plant: bool = False, observed: Observation | None = None) -> DataFrame:
    forecast = nz.normalize_forecast(nz.scan_forecast(source, cfg), cfg)
    return cmp.join_sides(prepared_usage(source, cfg, observed), forecast, cfg, source.unique_grain, keep_plant)


def reconcile(source, cfg: ReconConfig, keep_plant: bool = False, observed: Observation | None = None) -> DataFrame:
    """The result table: 15 columns, 14 with exclusions off (no look-back count then).

    Exclusions apply to usage only. A forecast row of an excluded part therefore stays and shows up as missing from
    usage. ``keep_plant`` adds ``in_usage`` and the plant of the usage row, which the investigation looks up by; usage
    summed up over plants has none.
    """
    measured = cmp.with_variance(joined_sides(source, cfg, keep_plant, observed), cfg)
    result = cmp.categorize(measured, cfg.labels)
    wanted = [*cmp.RESULT_COLUMNS, *(["plant", "in_usage"] if keep_plant else [])]
    return result.select(*[c for c in wanted if c in result.columns])


def reconcile_stepwise(source, cfg: ReconConfig) -> DataFrame:
    """The same run from the single operators, one join each. Kept to check ``reconcile`` against."""
    usage = nz.normalize_usage(nz.scan_usage(source, cfg), cfg)
    metadata = md.scan_part_metadata(source, cfg)
    usage = md.enrich_metadata(usage, metadata)
    if cfg.apply_exclusions:
        usage = md.apply_exclusions(usage, metadata, cfg)
        usage = md.frequency_filter(usage, md.frequency_counts(md.frequency_usage(source, cfg), cfg), cfg)
    forecast = nz.normalize_forecast(nz.scan_forecast(source, cfg), cfg)
    result = cmp.categorize(cmp.compare(usage, forecast, cfg, source.unique_grain), cfg.labels)
    return result.select(*[c for c in cmp.RESULT_COLUMNS if c in result.columns])


def impact(source, cfg: ReconConfig) -> DataFrame:
    usage = nz.normalize_usage(nz.scan_usage(source, cfg), cfg)
    facts = md.key_facts(md.scan_part_metadata(source, cfg), md.frequency_usage(source, cfg), cfg)
    return md.exclusion_impact(usage, facts, cfg)
