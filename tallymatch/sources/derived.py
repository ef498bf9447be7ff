"""The six tables derived from the order-line and part tables of a sample directory.

Two order-line columns and the part key stand in for a site, so that the derived tables have the traits that matter:
underscores and question marks inside part numbers, two plants sharing one location, an unmapped site, an excluded
company, parts that never or no longer reach the forecast, and parts without site or method rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymatch.operators.lookup import possible
from tallymatch.sources.literal import small_frame
from tallymatch.sources.tables import Source, bounded

# Site number, company, plant, mapped location (null = unmapped), location used by the forecast.
SITES = [
    (0, "NORTH", "HQ", "North HQ", "North HQ"),
    (1, "NORTH", "A1", "Harbor", "Harbor"),
    (2, "NORTH", "A2", "Harbor", "Harbor"),
    (3, "NORTH", "B7", "Mill", "Mill"),
    (4, "EAST", "HQ", "East", "East"),
    (5, "EAST", "E5", "Quarry", "Quarry"),
    (6, "SOUTH", "HQ", "South", "South"),
    (7, "WEST", "HQ", "West", "West"),
    (8, "SOUTH", "S9", None, "South"),
]
COMPANIES = ["NORTH", "SOUTH", "EAST", "WEST"]

# Code type, code, description; one code is not a number.
CODES = [
    ("Methods", "1", "Exception"),
    ("Methods", "2", "Min/Max"),
    ("Methods", "3", "New- No History"),
    ("Methods", "4", "Standard"),
    ("Methods", "N/A", "Unknown"),
    ("Other", "1", "Exception"),
]


def _month_start(day: date) -> date:
    return day.replace(day=1)


def _next_month(day: date) -> date:
    return _month_start(_month_start(day) + timedelta(days=32))


def _sql_text(value: str | None) -> str:
    return "cast(null as string)" if value is None else f"'{value}'"


def _part_name(key: str) -> str:
    return f"concat('P_', cast({key} as string), if({key} % 97 = 0, '?', ''))"


# the nine sites as a literal array, indexed by site number: no join and no shuffle to look one up
_SITE_ARRAY = "array({})".format(
    ", ".join(
        f"named_struct('n', {n}, 'company', '{company}', 'plant', '{plant}', 'fc_location', {_sql_text(fc_location)})"
        for n, company, plant, _, fc_location in SITES
    )
)


def _key_of(part_num: str) -> Column:
    """The part key that a name was made of; null for other texts."""
    return F.expr(f"try_cast(rtrim('?', substring({part_num}, 3)) as bigint)").alias("pk")


def _site_of(company: str, plant: str) -> Column:
    sites = " ".join(f"when {company} = '{c}' and {plant} = '{p}' then {n}" for n, c, p, *_ in SITES)
    return F.expr(f"case {sites} end").alias("n")


class DerivedSource(Source):
    """Usage and forecast are aggregates by their own grain, so no compare key can be hot."""

    unique_grain = True
    # order lines of other keys are left out before they are aggregated
    reduces = True

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self._dir = directory
        self._known: dict[tuple, DataFrame] = {}

    def _once(self, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
        """Plan every table once per source; only the plan is kept, never data."""
        if key not in self._known:
            self._known[key] = build()
        return self._known[key]

    def read(self, name: str) -> DataFrame:
        return self._once(("file", name), lambda: self.spark.read.parquet(f"{self._dir}/{name}.parquet"))

    def _part_names(self) -> DataFrame:
        return self._once(
            ("part names",),
            lambda: self.read("part").selectExpr(
                "p_partkey as pk",
                f"{_part_name('p_partkey')} as part_num",
                "p_type",
                "p_size",
                "p_brand",
            ),
        )

    def _parts(self) -> DataFrame:
        return self._once(("parts",), lambda: self.read("part").selectExpr("p_partkey as pk"))

    def _lines(self, first_day: date | None, next_day: date | None) -> DataFrame:
        """Order lines with site number and month end.

        The month range of the caller is restated on the stored ship date, which parquet can prune by; a range on
        ``last_day(...)`` alone would read every row group.
        """
        lines = self.read("lineitem")
        if first_day is not None:
            lines = lines.where(f"l_shipdate >= timestamp_ntz'{first_day}'")
        if next_day is not None:
            lines = lines.where(f"l_shipdate < timestamp_ntz'{next_day}'")
        return lines.selectExpr(
            "l_partkey as pk",
            "cast((l_partkey + l_linenumber % 2) % 9 as int) as n",
            "last_day(cast(l_shipdate as date)) as period_end",
            "l_quantity as quantity",
            "l_returnflag as flag",
            "l_linestatus as status",
        )

    def usage(self, start: date | None = None, end: date | None = None) -> DataFrame:
        return self._once(("usage", start, end), lambda: self._usage(start, end))

    def usage_among(self, keys: DataFrame) -> DataFrame:
        return self._usage(None, None, keys.select(_key_of("part_num"), _site_of("company", "plant")))

    def _usage(self, start: date | None, end: date | None, among: DataFrame | None = None) -> DataFrame:
        # a month end is in [start, end] for ship dates from the first of start's month on, and before the month
        # whose end is past `end`
        next_day = None if end is None else _month_start(end + timedelta(days=1))
        lines = self._lines(None if start is None else _month_start(start), next_day)
        if among is not None:
            lines = possible(lines, among, {"pk": F.col("pk"), "n": F.col("n")})
        conditions = {"a": "flag = 'A'", "b": "flag = 'N'", "c": "flag = 'R'", "d": "status = 'O'"}
        grouped = lines.groupBy("pk", "n", "period_end").agg(
            *[F.expr(f"sum(if({cond}, quantity, 0.0)) as qty_{c}") for c, cond in conditions.items()],
            *[F.expr(f"count_if({cond}) as cnt_{c}") for c, cond in conditions.items()],
        )
        usage = (
            # named by the key of the lines: only that key has to be shuffled and looked up
            grouped.join(self._parts(), "pk")
            .selectExpr("*", f"{_SITE_ARRAY}[n] as site", f"{_part_name('pk')} as part_num")
            .selectExpr(
                "concat_ws('_', site.company, site.plant, part_num) as site_part_key",
                "period_end",
                *[f"qty_{c}" for c in conditions],
                *[f"cnt_{c}" for c in conditions],
            )
        )
        return bounded(usage, "period_end", start, end)

    def forecast(self, start: date | None = None, end: date | None = None) -> DataFrame:
        return self._once(("forecast", start, end), lambda: self._forecast(start, end))

    def forecast_among(self, keys: DataFrame) -> DataFrame:
        return self._forecast(None, None, keys.select(_key_of("part_num"), "company"))

    def _forecast(self, start: date | None, end: date | None, among: DataFrame | None = None) -> DataFrame:
        # a first of month is in [start, end] for ship dates from the first full month on, up to end's month
        first_day = None
        if start is not None:
            first_day = start if start.day == 1 else _next_month(start)
        lines = self._lines(first_day, None if end is None else _next_month(end))
        if among is not None:
            company = F.expr(f"{_SITE_ARRAY}[n].company")
            lines = possible(lines, among, {"pk": F.col("pk"), "company": company})
        by_month = (
            lines.where("pk % 11 <> 0 and not (pk % 9 = 0 and period_end >= date'2000-10-01')")
            .selectExpr("*", f"{_SITE_ARRAY}[n] as site")
            .selectExpr("*", "site.company as company", "site.plant as plant", "site.fc_location as fc_location")
            .where("company <> 'WEST'")
            .groupBy("pk", "company", "fc_location", F.expr("trunc(period_end, 'MM') as period"))
            .agg(
                F.expr(
                    "sum(if(flag = 'R' or (company = 'NORTH' and plant = 'HQ' and flag in ('A', 'N')), quantity, 0.0))"
                    " as moved"
                )
            )
            .join(self._parts(), "pk")
            .selectExpr(
                "company",
                "fc_location as location",
                f"{_part_name('pk')} as product",
                "period",
                "moved + case pk % 7 when 0 then 5.0D when 1 then -3.0D else 0.0D end as qty",
            )
        )
        fixed = (
            self._part_names()
            .where("pk % 40 = 0")
            .selectExpr(
                "'EAST' as company",
                "'Quarry' as location",
                "part_num as product",
                "date'2000-06-01' as period",
                "cast(p_size as double) as qty",
            )
        )
        return bounded(by_month.unionByName(fixed), "period", start, end)

    def last_forecast(self) -> DataFrame:
        """From the order lines alone: grouping and naming parts don't change the newest month."""
        lines = self._lines(None, None).where(
            f"pk % 11 <> 0 and not (pk % 9 = 0 and period_end >= date'2000-10-01') and {_SITE_ARRAY}[n].company <> 'WEST'"
        )
        fixed = self.read("part").where("p_partkey % 40 = 0").selectExpr("date'2000-06-01' as period")
        return lines.selectExpr("trunc(period_end, 'MM') as period").unionByName(fixed).agg(F.max("period").alias("last"))

    # The three part tables multiply the part rows after the scan. Size estimates ignore that and would broadcast
    # tables many times the threshold, so their joins are told to shuffle. A file of parts is small, so few tasks read it;
    # its rows are dealt out to all before they are multiplied.

    def part_master(self) -> DataFrame:
        companies = ", ".join(f"'{c}'" for c in COMPANIES)
        return self._once(
            ("part_master",),
            lambda: self._part_names().repartition("pk").selectExpr(
                f"explode(array({companies})) as company",
                "part_num",
                "case when p_type = 'ECONOMY' and p_size < 10 then 'RAW' when p_type = 'SMALL' and p_size < 10 then"
                " 'CSM' when p_type = 'PROMO' then 'MFG' else 'PUR' end as class_id",
                "pk % 17 = 0 as inactive",
                "pk % 23 = 0 as runout",
                "p_brand as prod_code",
            ).hint("merge"),
        )

    def _part_at_site(self) -> DataFrame:
        return self._part_names().repartition("pk").selectExpr("pk", "part_num", "p_size", f"inline({_SITE_ARRAY})")

    def part_site(self) -> DataFrame:
        return self._once(
            ("part_site",),
            lambda: self._part_at_site()
            .where("pk % 50 <> 0")
            .selectExpr("company", "part_num", "plant", "(pk + n) % 13 = 0 as non_stock", "pk * 16 + n as row_id")
            .hint("merge"),
        )

    def part_site_ud(self) -> DataFrame:
        return self._once(
            ("part_site_ud",),
            lambda: self._part_at_site()
            .where("pk % 60 <> 0")
            .selectExpr("pk * 16 + n as foreign_row_id", "p_size % 12 as method_code")
            .hint("merge"),
        )

    def method_codes(self) -> DataFrame:
        names = ("company", "code_type", "code_id", "code_desc")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
        return self._once(
            ("method_codes",),
            lambda: small_frame(self.spark, schema, [(c, *code) for c in COMPANIES for code in CODES]),
        )
