"""Table schemas and the check that a source really delivers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Join keys, the most distinct one first: a sort compares the first bytes of its first key before anything else, and a
# handful of companies would leave every comparison to the slow path.
USAGE_KEY = ["part_num", "plant", "company"]
PART_KEY = ["part_num", "company"]
COMPARE_KEY = ["part_num", "period", "location", "company"]
QTY_COLUMNS = ["qty_a", "qty_b", "qty_c", "qty_d"]
COUNT_COLUMNS = ["cnt_a", "cnt_b", "cnt_c", "cnt_d"]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


USAGE = _struct(
    site_part_key=T.StringType(),
    period_end=T.DateType(),
    **{c: T.DoubleType() for c in QTY_COLUMNS},
    **{c: T.LongType() for c in COUNT_COLUMNS},
)
FORECAST = _struct(
    company=T.StringType(),
    location=T.StringType(),
    product=T.StringType(),
    period=T.DateType(),
    qty=T.DoubleType(),
)
PART_MASTER = _struct(
    company=T.StringType(),
    part_num=T.StringType(),
    class_id=T.StringType(),
    inactive=T.BooleanType(),
    runout=T.BooleanType(),
    prod_code=T.StringType(),
)
PART_SITE = _struct(
    company=T.StringType(),
    part_num=T.StringType(),
    plant=T.StringType(),
    non_stock=T.BooleanType(),
    row_id=T.LongType(),
)
PART_SITE_UD = _struct(foreign_row_id=T.LongType(), method_code=T.IntegerType())
METHOD_CODES = _struct(
    company=T.StringType(),
    code_type=T.StringType(),
    code_id=T.StringType(),
    code_desc=T.StringType(),
)
TABLES = {
    "usage": USAGE,
    "forecast": FORECAST,
    "part_master": PART_MASTER,
    "part_site": PART_SITE,
    "part_site_ud": PART_SITE_UD,
    "method_codes": METHOD_CODES,
}

# shown where a table has them, never required
OPTIONAL = {"part_master": ["part_description", "user_char_1"]}

LOCATION = _struct(company=T.StringType(), plant=T.StringType(), location=T.StringType())

RESULT = _struct(
    company=T.StringType(),
    location=T.StringType(),
    part_num=T.StringType(),
    period=T.DateType(),
    actual_usage=T.DoubleType(),
    non_stock=T.BooleanType(),
    method_code=T.IntegerType(),
    inactive=T.BooleanType(),
    runout=T.BooleanType(),
    transaction_count_12mo=T.LongType(),
    forecast_usage=T.DoubleType(),
    variance=T.DoubleType(),
    variance_percent=T.DoubleType(),
    absolute_variance=T.DoubleType(),
    variance_category=T.StringType(),
)

# usage rows before, between and after the filters of a run
FILTER_COUNTS = _struct(
    **{c: T.LongType() for c in ("initial_rows", "excluded_rows", "rows_after_exclusion", "infrequent_rows", "exempt_rows", "remaining_rows")}
)

RUN_EVENT = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("event_seq", T.IntegerType()),
        T.StructField("state", T.StringType()),
        T.StructField("triggered_by", T.StringType()),
        T.StructField(
            "date_range",
            T.StructType([T.StructField("start", T.DateType()), T.StructField("end", T.DateType())]),
        ),
        T.StructField("companies", T.ArrayType(T.StringType())),
        T.StructField("total_records", T.LongType()),
        T.StructField("critical_issues", T.LongType()),
        T.StructField("execution_seconds", T.DoubleType()),
        T.StructField("error", T.StringType()),
        T.StructField("filters", FILTER_COUNTS),
    ]
)


def _accepts(wanted: T.DataType, found: T.DataType) -> bool:
    if isinstance(wanted, T.NumericType):
        return isinstance(found, (T.NumericType, T.StringType))
    if isinstance(wanted, T.BooleanType):
        return isinstance(found, (T.BooleanType, T.NumericType))
    if isinstance(wanted, T.DateType):
        return isinstance(found, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return isinstance(found, type(wanted))


def check_columns(df: DataFrame, schema: T.StructType, table: str) -> DataFrame:
    """Select the declared columns, or say which one is missing or of an unusable type.

    Looks at the schema only, so no job runs. Numbers may be wider than declared, dates may be timestamps and
    flags may be 0/1; those are left as they are so that range filters still reach the scan.
    """
    found = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in found]
    if missing:
        raise ValueError(f"table '{table}' lacks columns: {', '.join(missing)}")
    wrong = [
        f"{f.name} is {found[f.name].simpleString()}, expected {f.dataType.simpleString()}"
        for f in schema.fields
        if not _accepts(f.dataType, found[f.name])
    ]
    if wrong:
        raise ValueError(f"table '{table}' has unusable types: {'; '.join(wrong)}")
    extra = [c for c in OPTIONAL.get(table, []) if c in found]
    return df.select(*schema.fieldNames(), *extra)
