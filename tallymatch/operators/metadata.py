"""Part metadata, exclusion rules and the frequency rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymatch import schema
from tallymatch.config import ReconConfig
from tallymatch.operators.lookup import lookup
from tallymatch.operators.normalize import normalize_key_text, normalize_usage, parse_key
from tallymatch.sources.tables import bounded

METADATA_FLAGS = ["non_stock", "method_code", "inactive", "runout"]


def scan_part_metadata(source, cfg: ReconConfig) -> DataFrame:
    """Part, plant and method rows of the run's companies; parts without a plant or method row drop out.

    The part key is joined last: what follows groups by part and plant, and is then partitioned for it already.
    """
    companies = F.col("company").isin(*cfg.companies)
    sites = source.part_site().where(companies).join(source.part_site_ud(), F.col("row_id") == F.col("foreign_row_id"))
    metadata = (
        sites.join(source.part_master().where(companies), schema.PART_KEY)
        .select(
            "company",
            "part_num",
            "plant",
            "class_id",
            "inactive",
            "runout",
            "non_stock",
            "prod_code",
            "method_code",
        )
    )
    return normalize_key_text(metadata, schema.USAGE_KEY, cfg)


def exclusion_predicate(metadata: DataFrame, cfg: ReconConfig) -> Column:
    """True if any criterion holds. A null criterion does not hold, which ``where`` and ``max`` give for free.

    Method codes are compared as what they are: numbers with numbers (1.0 is 1), text with exact text ('1.0' is
    not '1').
    """
    is_text = isinstance(metadata.schema["method_code"].dataType, T.StringType)
    methods = [str(m) if is_text else m for m in cfg.excluded_methods]
    flags = [F.col(c).cast("boolean") for c in ("inactive", "runout", "non_stock")]
    met = flags[0] | flags[1] | flags[2]
    return met | F.col("class_id").isin(*cfg.excluded_classes) | F.col("method_code").isin(*methods)


def exclusion_keys(metadata: DataFrame, cfg: ReconConfig) -> DataFrame:
    return metadata.where(exclusion_predicate(metadata, cfg)).select("company", "plant", "part_num").distinct()


def unique_metadata(metadata: DataFrame, columns: list[str]) -> DataFrame:
    """One row per (company, plant, part); a second row for a key fails the job instead of fanning out."""
    return _guarded(
        metadata.groupBy(*schema.USAGE_KEY).agg(
            F.count("*").alias("__rows"), *[F.max(c).alias(c) for c in columns]
        ),
        columns,
    ).drop("__rows")


def _guarded(grouped: DataFrame, columns: list[str]) -> DataFrame:
    message = F.concat(
        F.lit("duplicate part metadata for "), F.concat_ws("/", "company", "plant", "part_num")
    )
    return grouped.withColumns(
        {c: F.when(F.col("__rows") > 1, F.raise_error(message)).otherwise(F.col(c)) for c in columns}
    )


def enrich_metadata(usage: DataFrame, metadata: DataFrame, unique_grain: bool = False) -> DataFrame:
    """Left lookup of the metadata flags; unknown keys get nulls."""
    facts = unique_metadata(metadata, METADATA_FLAGS)
    return _few_per_key(usage, facts) if unique_grain else lookup(usage, facts, schema.USAGE_KEY)


def _few_per_key(usage: DataFrame, facts: DataFrame) -> DataFrame:
    """The lookup for usage without hot keys. Metadata has no null part, and a key without plant has no part either, so
    null keys match nothing."""
    return usage.join(facts, schema.USAGE_KEY, "left").select(
        *[usage[c] for c in usage.columns], *[facts[c] for c in facts.columns if c not in schema.USAGE_KEY]
    )


def apply_exclusions(usage: DataFrame, metadata: DataFrame, cfg: ReconConfig) -> DataFrame:
    return lookup(usage, exclusion_keys(metadata, cfg), schema.USAGE_KEY, "left_anti")


def tran_totals(usage: DataFrame) -> DataFrame:
    counts = [F.coalesce(F.col(c), F.lit(0)) for c in schema.COUNT_COLUMNS]
    return usage.withColumn("total_transactions", (counts[0] + counts[1] + counts[2] + counts[3]).cast("bigint"))


def total_units() -> Column:
    """Units of the three moving components; null if one of them is null."""
    return F.col("qty_a") + F.col("qty_b") + F.col("qty_c")


def frequency_counts(usage: DataFrame, cfg: ReconConfig) -> DataFrame:
    """Transactions (or units) per company, plant and part in the look-back window, both ends included.

    Which rows are passed in decides the meaning: the run's own scan (``run_range``) or the full history.
    Keys with a missing piece are left out.
    """
    in_window = _frequency_rows(usage, cfg)
    return (
        in_window.groupBy(*schema.USAGE_KEY)
        .agg(F.sum("__measure").alias("transaction_count_12mo"))
        .dropna(subset=schema.USAGE_KEY)
    )


def _in_window(cfg: ReconConfig) -> Column:
    return F.col("period_end").between(F.add_months(F.lit(cfg.end), -cfg.lookback_months), F.lit(cfg.end))


def _with_measure(usage: DataFrame, cfg: ReconConfig) -> DataFrame:
    if cfg.frequency_measure == "transactions":
        return tran_totals(usage).withColumnRenamed("total_transactions", "__measure")
    return usage.withColumn("__measure", F.coalesce(total_units(), F.lit(0.0)))


def _frequency_rows(usage: DataFrame, cfg: ReconConfig) -> DataFrame:
    measured = _with_measure(usage.where(_in_window(cfg)), cfg)
    return normalize_key_text(parse_key(measured), schema.USAGE_KEY, cfg).select(*schema.USAGE_KEY, "__measure")


def frequent_enough(cfg: ReconConfig) -> Column:
    """Head office location always passes; elsewhere more than the allowed number of rare transactions is needed."""
    return (F.col("location") == cfg.hq_location) | (F.col("transaction_count_12mo") > cfg.max_rare_transactions)


def with_frequency(usage: DataFrame, counts: DataFrame) -> DataFrame:
    return lookup(usage, counts, schema.USAGE_KEY).withColumn(
        "transaction_count_12mo", F.coalesce("transaction_count_12mo", F.lit(0))
    )


def frequency_filter(usage: DataFrame, counts: DataFrame, cfg: ReconConfig) -> DataFrame:
    return with_frequency(usage, counts).where(frequent_enough(cfg))


def frequency_usage(source, cfg: ReconConfig) -> DataFrame:
    """The rows the frequency rule counts. The default is the run's own scan, so a short run sees a short window."""
    if cfg.frequency_source == "run_range":
        return source.usage(cfg.start, cfg.end)
    return source.usage(None, cfg.end)


def key_facts(metadata: DataFrame, usage_rows: DataFrame, cfg: ReconConfig) -> DataFrame:
    """Everything the pipeline asks per (company, plant, part), in one row per key and one shuffle.

    Metadata flags, the exclusion verdict and the look-back count share their key. Both inputs are aggregated
    together, and usage, the large side, is shuffled and joined once instead of three times.
    """
    meta_side = _judged(metadata, cfg).withColumn("__meta", F.lit(1))
    counted = _frequency_rows(usage_rows, cfg).dropna(subset=schema.USAGE_KEY)
    stacked = meta_side.unionByName(counted, allowMissingColumns=True)
    grouped = stacked.groupBy(*schema.USAGE_KEY).agg(
        F.count("__meta").alias("__rows"),
        *[F.max(c).alias(c) for c in METADATA_FLAGS],
        F.max("excluded").alias("excluded"),
        F.sum("__measure").alias("transaction_count_12mo"),
    )
    return _guarded(grouped, [*METADATA_FLAGS, "excluded"]).drop("__rows")


def _judged(metadata: DataFrame, cfg: ReconConfig) -> DataFrame:
    """Keys and flags with the exclusion verdict."""
    excluded = F.coalesce(exclusion_predicate(metadata, cfg), F.lit(False))
    return metadata.select(*schema.USAGE_KEY, *METADATA_FLAGS, excluded.alias("excluded"))


def with_key_facts(usage: DataFrame, facts: DataFrame) -> DataFrame:
    """Usage with metadata flags, ``excluded`` and the look-back count; keys without facts count 0, not excluded."""
    return _filled(lookup(usage, facts, schema.USAGE_KEY))


def _filled(flagged: DataFrame) -> DataFrame:
    return flagged.withColumns(
        {
            "excluded": F.coalesce("excluded", F.lit(False)),
            "transaction_count_12mo": F.coalesce("transaction_count_12mo", F.lit(0)),
        }
    )


def with_own_facts(usage: DataFrame, metadata: DataFrame, cfg: ReconConfig) -> DataFrame:
    """The same for raw usage of unique grain that counts its own rows (``run_range``): it is read and shuffled once.

    A window group holds one part at one site, so its size is the number of months; the join with the metadata takes over
    its partitioning and order.
    """
    measure = F.when(_in_window(cfg), F.col("__measure"))
    measured = normalize_usage(_with_measure(usage, cfg).withColumn("__measure", measure), cfg, "__measure")
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in schema.USAGE_KEY])
    counted = F.sum("__measure").over(W.partitionBy(*schema.USAGE_KEY))
    rows = measured.withColumn("transaction_count_12mo", F.when(complete, counted)).drop("__measure")
    facts = unique_metadata(_judged(metadata, cfg), [*METADATA_FLAGS, "excluded"])
    return _filled(_few_per_key(rows, facts))


def filter_counts(cfg: ReconConfig) -> list[Column]:
    """Rows before, removed and left for both filters, as aggregates over usage with its key facts."""
    kept = ~F.col("excluded")
    passes = F.coalesce(frequent_enough(cfg), F.lit(False))
    return [
        F.count(F.lit(1)).alias("initial_rows"),
        F.count_if(F.col("excluded")).alias("excluded_rows"),
        F.count_if(kept).alias("rows_after_exclusion"),
        F.count_if(kept & ~passes).alias("infrequent_rows"),
        F.count_if(kept & (F.col("location") == cfg.hq_location)).alias("exempt_rows"),
        F.count_if(kept & passes).alias("remaining_rows"),
    ]


def exclusion_impact(usage: DataFrame, facts: DataFrame, cfg: ReconConfig) -> DataFrame:
    """Rows before, removed and left for both filters, in one pass over usage."""
    counts = with_key_facts(usage, facts).agg(*filter_counts(cfg))
    share = F.round(F.col("excluded_rows") * 100.0 / F.col("initial_rows"), 1)
    return counts.withColumn("excluded_percent", F.when(F.col("initial_rows") > 0, share).otherwise(0.0))


# --- detail view: exclusion reasons -----------------------------------------------------------------------------


def last_forecast_period(source) -> DataFrame:
    """One row: month end of the newest forecast period, from that one column; no other is read."""
    return source.last_forecast().select(F.last_day(F.col("last").cast("date")).alias("max_period"))


def view_date_bounds(source, cfg: ReconConfig) -> DataFrame:
    return last_forecast_period(source).select(
        F.lit(cfg.start).alias("start_date"),
        F.lit(cfg.end).alias("end_date"),
        "max_period",
        F.add_months("max_period", -cfg.lookback_months).alias("lookback_start"),
    )


def low_usage_parts(
    parsed_usage: DataFrame, max_period: DataFrame, cfg: ReconConfig, parts: DataFrame | None = None
) -> DataFrame:
    """Parts, over all plants, whose units since the look-back start are few; parts without any row are not listed.

    With ``parts`` (company, part_num) only those are looked at, and the others dropped before anything is grouped.
    """
    if parts is not None:
        parsed_usage = lookup(parsed_usage, parts, schema.PART_KEY, "left_semi")
    lookback_start = F.add_months(max_period.select("max_period").scalar(), -cfg.lookback_months)
    return (
        parsed_usage.where(F.col("period_end") >= lookback_start)
        .groupBy("company", "part_num")
        .agg(F.sum(total_units()).alias("units"))
        .where(F.col("units") <= cfg.max_low_units)
    )


def exclusion_reasons(
    source, low_usage: DataFrame, cfg: ReconConfig, parts: DataFrame | None = None
) -> DataFrame:
    """Reasons per (company, plant, part): five lists, each distinct in itself, duplicates across lists kept.

    The three lists that read part and plant are produced by one join, and all lists are made distinct in one
    shuffle with the list number as part of the row. With ``parts`` (company, part_num) only their reasons are made.
    """
    companies = F.col("company").isin(*cfg.companies)
    sites, masters = source.part_site().where(companies), source.part_master().where(companies)
    if parts is not None:
        sites = lookup(sites, parts, schema.PART_KEY, "left_semi")

    def listed(number: int, reason: Column) -> Column:
        return F.struct(F.lit(number).alias("list_no"), reason.alias("reason"))

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name).cast("boolean"), F.lit(False))

    status = F.when(flag("non_stock"), "NonStock").when(flag("inactive"), "InActive").when(flag("runout"), "Runout")
    candidates = F.array(
        F.when(status.isNotNull(), listed(2, status)),
        F.when(
            F.col("class_id").isin(*cfg.excluded_classes), listed(3, F.concat(F.lit("ClassID: "), F.col("class_id")))
        ),
        F.when(F.col("part_num").contains("?"), listed(4, F.lit("Data Quality Issue"))),
    )
    by_part = (
        masters.join(sites, schema.PART_KEY)
        .select("company", "plant", "part_num", F.inline(F.filter(candidates, lambda c: c.isNotNull())))
    )
    codes = source.method_codes().where(
        (F.col("code_type") == cfg.method_code_type)
        & F.col("code_desc").isin(*cfg.excluded_method_names)
        & companies
    )
    by_method = (
        sites.join(source.part_site_ud(), F.col("row_id") == F.col("foreign_row_id"))
        .join(codes.withColumn("__code", code_number(F.col("code_id"))), "company")
        .where(F.col("method_code").cast("double") == F.col("__code"))
        .select("company", "plant", "part_num", F.lit(1).alias("list_no"), F.col("code_desc").alias("reason"))
    )
    # Fixed value: the reason text.
    low_reason = F.lit("Low Usage (≤2 units/12mo)")
    by_usage = (
        low_usage.where(companies)
        .select("company", "part_num")
        .join(sites, schema.PART_KEY)
        .select("company", "plant", "part_num", F.lit(5).alias("list_no"), low_reason.alias("reason"))
    )
    return by_part.unionByName(by_method).unionByName(by_usage).distinct()


def code_number(code_id: Column) -> Column:
    """Code text as number for comparison with a numeric code; text that is no number matches nothing."""
    return code_id.try_cast("double")


def reason_lists(reasons: DataFrame) -> DataFrame:
    """One row per (company, plant, part) with its few reasons as an array, duplicates across lists kept."""
    return reasons.groupBy(*schema.USAGE_KEY).agg(F.array_sort(F.collect_list("reason")).alias("reasons"))


def with_reasons(rows: DataFrame, reasons: DataFrame) -> DataFrame:
    """Rows with the array of their key's reasons, null without any.

    Usage and forecast both look reasons up this way. The two lookups need the same columns of the same lists, so the
    lists are made and shuffled once and the second lookup reuses them. Listed keys have no null piece, so the null-safe
    match of the lookup never matches one.
    """
    return lookup(rows, reason_lists(reasons), schema.USAGE_KEY)


def exclude_listed(parsed_usage: DataFrame, reasons: DataFrame) -> DataFrame:
    """Usage without the keys that are on the reason list."""
    return with_reasons(parsed_usage, reasons).where(F.col("reasons").isNull()).drop("reasons")
