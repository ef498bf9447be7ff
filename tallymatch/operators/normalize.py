"""From raw usage and forecast rows to one common grain: company, location, part, month end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymatch import schema
from tallymatch.config import ReconConfig
from tallymatch.functions.calendar import month_end
from tallymatch.functions.keys import key_parts, normalized_text, view_key_parts
from tallymatch.sources.literal import small_frame

BROADCAST_ROWS = 5000


def parse_key(df: DataFrame, key: str = "site_part_key") -> DataFrame:
    company, plant, part = key_parts(F.col(key))
    return df.withColumns({"company": company, "plant": plant, "part_num": part})


def parse_key_view(df: DataFrame, key: str = "site_part_key") -> DataFrame:
    company, plant, part = view_key_parts(F.col(key))
    return df.withColumns({"company": company, "plant": plant, "part_num": part})


def normalize_key_text(df: DataFrame, columns: list[str], cfg: ReconConfig) -> DataFrame:
    """Optional: compare keys the way a case-insensitive database would. Off by default."""
    if not cfg.normalize_keys:
        return df
    return df.withColumns({c: normalized_text(F.col(c)) for c in columns})


def location_frame(spark: SparkSession, cfg: ReconConfig) -> DataFrame:
    rows = cfg.location_rows()
    frame = small_frame(spark, schema.LOCATION, rows)
    return normalize_key_text(frame, ["company", "plant"], cfg)


def map_location(df: DataFrame, cfg: ReconConfig) -> DataFrame:
    """Add ``location`` for (company, plant); an unlisted pair gets a name that tells the pair.

    The mapping is the config itself, so its broadcast cannot grow with the data. Beyond some thousand rows the hint is
    left out and the planner goes by the size of the table.
    """
    mapping = location_frame(df.sparkSession, cfg).withColumnRenamed("location", "__mapped")
    if len(cfg.location_rows()) <= BROADCAST_ROWS:
        mapping = F.broadcast(mapping)
    unmapped = F.concat_ws(
        "_",
        F.lit("UNMAPPED_LOCATION"),
        F.coalesce("company", F.lit("None")),
        F.coalesce("plant", F.lit("None")),
    )
    return (
        df.join(mapping, ["company", "plant"], "left")
        .withColumn("location", F.coalesce("__mapped", unmapped))
        .select(*df.columns, "location")
    )


def view_location(company: Column, plant: Column, cfg: ReconConfig) -> Column:
    """Detail-view mapping: any other plant of a known company falls through to that company's default."""
    chosen = F.lit("UNMAPPED_LOCATION")
    for name, location in cfg.default_locations.items():
        chosen = F.when(company == name, location).otherwise(chosen)
    for name, site, location in reversed(cfg.location_rows()):
        chosen = F.when((company == name) & (plant == site), location).otherwise(chosen)
    return chosen


def map_location_view(df: DataFrame, cfg: ReconConfig) -> DataFrame:
    return df.withColumn("location", view_location(F.col("company"), F.col("plant"), cfg))


def reverse_map_site(df: DataFrame, cfg: ReconConfig) -> DataFrame:
    """Add ``plant`` for (company, location). Of plants sharing a location only the first listed is found."""
    plant = F.lit(cfg.default_plant)
    for (company, location), site in cfg.reverse_sites().items():
        plant = F.when((F.col("company") == company) & (F.col("location") == location), site).otherwise(plant)
    return df.withColumn("plant", plant)


def usage_amount(df: DataFrame, cfg: ReconConfig) -> Column:
    """Head office site: sum of the configured components; any other: the default component.

    A null component makes the amount null (read as 0 when compared); a column the table lacks counts as 0.
    """

    def component(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(0.0)

    total = component(cfg.hq_components[0])
    for name in cfg.hq_components[1:]:
        total = total + component(name)
    at_hq = (F.col("company") == cfg.hq_company) & (F.col("plant") == cfg.hq_plant)
    return F.when(at_hq, total).otherwise(component(cfg.default_component))


def usage_rule(df: DataFrame, cfg: ReconConfig) -> DataFrame:
    return df.withColumn("actual_usage", usage_amount(df, cfg))


def filter_companies(df: DataFrame, cfg: ReconConfig, keep_null: bool = True) -> DataFrame:
    """Drop excluded companies. A null company stays, except in the detail view (``keep_null=False``)."""
    if not cfg.excluded_companies:
        return df
    kept = ~F.col("company").isin(*cfg.excluded_companies)
    return df.where(kept | F.col("company").isNull()) if keep_null else df.where(kept)


def scan_usage(source, cfg: ReconConfig) -> DataFrame:
    return source.usage(cfg.start, cfg.end)


def scan_forecast(source, cfg: ReconConfig) -> DataFrame:
    """The range is on the raw period (usually the first of a month), before the month-end shift."""
    return source.forecast(cfg.start, cfg.end)


def normalize_usage(usage: DataFrame, cfg: ReconConfig, *more: str) -> DataFrame:
    """``more`` names columns that are kept as they are."""
    parsed = normalize_key_text(parse_key(usage), schema.USAGE_KEY, cfg)
    return (
        usage_rule(map_location(filter_companies(parsed, cfg), cfg), cfg)
        .withColumn("period", month_end(F.col("period_end")))
        .select("company", "location", "plant", "part_num", "period", "actual_usage", *more)
    )


def normalize_forecast(forecast: DataFrame, cfg: ReconConfig) -> DataFrame:
    return normalize_key_text(
        forecast.select(
            "company",
            "location",
            F.col("product").alias("part_num"),
            month_end(F.col("period")).alias("period"),
            F.col("qty").alias("forecast_usage"),
        ),
        ["company", "part_num"],
        cfg,
    )


def normalize_usage_view(parsed: DataFrame, cfg: ReconConfig) -> DataFrame:
    """Detail-view form of already parsed usage: keeps components, counts and the original key."""
    return usage_rule(map_location_view(parsed, cfg), cfg).select(
        "company",
        "location",
        "plant",
        "part_num",
        month_end(F.col("period_end")).alias("period"),
        "actual_usage",
        *schema.QTY_COLUMNS,
        *schema.COUNT_COLUMNS,
        F.col("site_part_key").alias("original_key"),
    )


def normalize_forecast_view(forecast: DataFrame, cfg: ReconConfig) -> DataFrame:
    return reverse_map_site(
        forecast.select(
            "company",
            "location",
            F.col("product").alias("part_num"),
            month_end(F.col("period")).alias("period"),
            F.col("qty").alias("forecast_usage"),
            F.col("period").alias("original_period"),
        ),
        cfg,
    )


def key_cardinality(usage: DataFrame) -> DataFrame:
    """Distinct companies, plants and parts. Keys are made distinct first, so each is parsed and counted once."""
    return parse_key(usage.select("site_part_key").distinct()).agg(
        F.count_distinct("company").alias("n_companies"),
        F.count_distinct("plant").alias("n_plants"),
        F.count_distinct("part_num").alias("n_parts"),
    )


def source_row_counts(usage: DataFrame, forecast: DataFrame) -> DataFrame:
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")

    return counted(usage, "usage").unionByName(counted(forecast, "forecast"))
