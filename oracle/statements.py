"""One SQL statement per registered query."""

from __future__ import annotations

from oracle.ctes import RESULT, with_ctes

_KEYS = """select site_part_key from usage_raw union all select part_num from part_master
union all select prod_code from part_master"""
_SPLIT = f"""select site_part_key, split_part(site_part_key, '_', 1) as company,
 case when contains(site_part_key, '_') then split_part(site_part_key, '_', 2) end as plant,
 case when length(site_part_key) - length(replace(site_part_key, '_', '')) >= 2
  then substr(site_part_key, length(split_part(site_part_key, '_', 1)) + length(split_part(site_part_key, '_', 2)) + 3)
 end as part_num from ({_KEYS}) k"""
_SPLIT_VIEW = f"""select site_part_key, company, coalesce(plant, company) as plant, coalesce(part_num, '') as part_num
from ({_SPLIT}) v"""
_VIEW_LOCATION = """case when company = 'NORTH' and plant = 'B7' then 'Mill'
 when company = 'NORTH' and plant in ('A1','A2') then 'Harbor'
 when company = 'EAST' and plant = 'E5' then 'Quarry' when company = 'NORTH' then 'North HQ'
 when company = 'SOUTH' then 'South' when company = 'EAST' then 'East' when company = 'WEST' then 'West'
 else 'UNMAPPED_LOCATION' end"""
_CALENDAR = """cast(year({p}) as int) as validation_year, cast(month({p}) as int) as validation_month,
 cast(quarter({p}) as int) as validation_quarter, cast(day({p}) as int) as validation_day,
 monthname({p}) as month_name, left(monthname({p}), 3) as month_abbreviation"""
_PERIOD_KEYS = """strftime({p}, '%Y%m') as period_key, strftime({p}, '%Y-%m') as period_year_month,
 cast(year({p}) as varchar) || 'Q' || cast(quarter({p}) as varchar) as quarter_key"""
_RELATIVE = """cast({p} = date '2001-02-28' as int) as is_current_month,
 cast({p} = date '2001-01-31' as int) as is_previous_month,
 cast(year({p}) = 2001 and quarter({p}) = 1 as int) as is_current_quarter,
 cast(year({p}) = 2000 and quarter({p}) = 4 as int) as is_previous_quarter,
 cast(year({p}) = 2001 as int) as is_current_year,
 cast(date_diff('month', {p}, date '2001-02-28') as int) as months_from_current,
 cast(date_diff('quarter', {p}, date '2001-02-15') as int) as quarters_from_current,
 cast(date_diff('month', date '2000-01-01', {p}) as int) as sort_order,
 cast({p} < date '2001-02-28' as int) as is_month_complete, cast(day(last_day({p})) as int) as days_in_month"""
_FLAGS = """cast(variance_category in ('{mf}', '{mu}') as int) as is_critical_issue,
 cast(variance_category = '{ok}' as int) as is_perfect_match,
 cast(variance_category in ('{mof}', '{mou}', '{mu}', '{mf}') as int) as has_variance"""
_TITLE_FLAGS = _FLAGS.format(
    ok="Perfect Match",
    mf="Missing From Forecast",
    mu="Missing From Usage",
    mof="More In Forecast",
    mou="More In Usage",
)
_SNAKE_FLAGS = _FLAGS.format(
    ok="PERFECT_MATCH",
    mf="MISSING_FROM_FORECAST",
    mu="MISSING_FROM_USAGE",
    mof="MORE_IN_FORECAST",
    mou="MORE_IN_USAGE",
)


def _wide(part_column: str, prod_code: bool) -> str:
    p = "period"
    return f"""company as company_code, location as location_name, part_num as {part_column},
 {'prod_code,' if prod_code else ''} period as validation_date, actual_usage, forecast_usage,
 variance as variance_amount, variance_percent, absolute_variance, variance_category, {_SNAKE_FLAGS},
 coalesce(qty_a, 0) as qty_a_amount, coalesce(qty_b, 0) as qty_b_amount, coalesce(qty_c, 0) as qty_c_amount,
 coalesce(qty_d, 0) as qty_d_amount, original_key, exclusion_reason,
 {_CALENDAR.format(p=p)}, {_PERIOD_KEYS.format(p=p)}, {_RELATIVE.format(p=p)}"""


_RUN_KEY = "strftime(created_at, '%Y%m%d_%H%M%S') as run_key"
_CATEGORIES = ["Perfect Match", "More In Forecast", "More In Usage", "Missing From Usage", "Missing From Forecast"]
_POSITION = "case variance_category " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(_CATEGORIES)) + " end"

SELECTS: dict[str, str] = {
    "scan_usage": "select * from usage_scan",
    "scan_forecast": "select * from forecast_scan",
    "scan_part_metadata": "select * from metadata",
    "source_row_counts": """select 'usage' as table_name, count(*) as n_rows from usage_raw
union all select 'forecast', count(*) from forecast_raw""",
    "view_date_bounds": """select start_date, end_date, max_period,
 cast(max_period - interval 12 month as date) as lookback_start from bounds""",
    "parse_key": _SPLIT,
    "parse_key_view": _SPLIT_VIEW,
    "key_cardinality": """select count(distinct company) as n_companies, count(distinct plant) as n_plants,
 count(distinct part_num) as n_parts from usage_keyed""",
    "map_location": f"""select k.*, coalesce(s.location,
 'UNMAPPED_LOCATION_' || coalesce(k.company, 'None') || '_' || coalesce(k.plant, 'None')) as location
from ({_SPLIT}) k left join site_dim s on s.company = k.company and s.plant = k.plant""",
    "map_location_view": f"select k.*, {_VIEW_LOCATION} as location from ({_SPLIT_VIEW}) k",
    "reverse_map_site": """select company, location, product, period, qty,
 case when company = 'NORTH' and location = 'Mill' then 'B7'
  when company = 'NORTH' and location = 'Harbor' then 'A1'
  when company = 'EAST' and location = 'Quarry' then 'E5' else 'HQ' end as plant from forecast_raw""",
    "usage_rule": """select site_part_key, period_end, case when company = 'NORTH' and plant = 'HQ'
 then qty_a + qty_b + qty_c else qty_c end as actual_usage from usage_keyed""",
    "month_end": "select l_orderkey, l_linenumber, last_day(cast(l_shipdate as date)) as period from lineitem",
    "tran_totals": """select site_part_key, period_end, cnt_a + cnt_b + cnt_c + cnt_d as total_transactions
from usage_raw""",
    "filter_companies": """select company, plant, part_num, period_end from usage_parsed
where company not in ('WEST')""",
    "normalize_usage": "select * from usage_norm",
    "normalize_forecast": "select * from forecast_norm",
    "calendar_parts": f"""select site_part_key, period_end as period, {_CALENDAR.format(p='period_end')}
from usage_raw""",
    "period_keys": f"select site_part_key, period_end as period, {_PERIOD_KEYS.format(p='period_end')} from usage_raw",
    "relative_dates": f"select site_part_key, period_end as period, {_RELATIVE.format(p='period_end')} from usage_raw",
    "enrich_metadata": "select * from usage_enriched",
    "exclusion_keys": "select * from excluded_keys",
    "apply_exclusions": "select company, location, plant, part_num, period, actual_usage from usage_allowed",
    "frequency_counts": "select * from frequency",
    "frequency_filter": """select u.company, u.location, u.plant, u.part_num, u.period, u.actual_usage,
 coalesce(f.transaction_count_12mo, 0) as transaction_count_12mo
from usage_norm u left join frequency f on f.company = u.company and f.plant = u.plant and f.part_num = u.part_num
where u.location = 'North HQ' or f.transaction_count_12mo > 2""",
    "frequency_full_history": """select company, plant, part_num, sum(qty_a + qty_b + qty_c) as transaction_count_12mo
from usage_keyed where period_end between cast(date '2000-12-31' - interval 12 month as date) and date '2000-12-31'
group by 1, 2, 3""",
    "exclusion_impact": """select a.n as initial_rows, a.n - b.n as excluded_rows, b.n as rows_after_exclusion,
 b.n - c.n as infrequent_rows, d.n as exempt_rows, c.n as remaining_rows,
 case when a.n > 0 then round((a.n - b.n) * 100.0::double / a.n, 1) else 0.0 end as excluded_percent
from (select count(*) as n from usage_norm) a, (select count(*) as n from usage_allowed) b,
 (select count(*) as n from usage_kept) c, (select count(*) as n from usage_allowed where location = 'North HQ') d""",
    "compare": f"select {RESULT.replace(', variance_category', '')} from measured_all",
    "variance_percent": """select company, location, part_num, period, actual_usage, forecast_usage, variance_percent
from measured_plain""",
    "categorize": """select company, location, part_num, period, actual_usage, forecast_usage,
 upper(replace(variance_category, ' ', '_')) as variance_category from measured_plain""",
    "category_flags": f"select company, location, part_num, period, variance_category, {_TITLE_FLAGS} from result",
    "match_presence": """select case when in_usage and in_forecast then 'both' when in_usage then 'usage_only'
 else 'forecast_only' end as presence, count(*) as n_rows,
 count(case when actual_usage > 0 and forecast_usage > 0 then 1 end) as positive_rows from joined group by 1""",
    "reconcile": "select * from result",
    "reconcile_no_exclusions": "select * from result_plain",
    "reconcile_stepwise": "select * from result",
    "reconcile_pre_aggregated": f"select {RESULT} from measured_summed",
    "reconcile_hot_keys": "select * from result",
    "chart_cube": 'select month, location, variance_category, n as "count" from chart',
    "chart_json": """select '{"month":"' || month || '","location":"' || location || '","variance_category":"'
 || variance_category || '","count":' || cast(n as varchar) || '}' as record from chart""",
    "breakdowns": """
select 'category' as dimension, null as company, null as location, variance_category, count(*) as n_rows,
 any_value(t) as group_total, round(count(*) * 100.0::double / any_value(t), 2) as share_percent
from result, (select count(*) as t from result) group by variance_category
union all select 'company', company, null, null, count(*), any_value(t), round(count(*) * 100.0::double / any_value(t), 2)
from result, (select count(*) as t from result) group by company
union all select 'location', null, location, null, count(*), any_value(t),
 round(count(*) * 100.0::double / any_value(t), 2)
from result, (select count(*) as t from result) group by location
union all select 'total', null, null, null, count(*) as n, count(*) as t, 100.0 from result
union all select 'company_category', r.company, null, variance_category, count(*) as n, any_value(c.t) as t,
 round(count(*) * 100.0::double / any_value(c.t), 2)
from result r join (select company, count(*) as t from result group by 1) c on c.company = r.company
group by r.company, variance_category
union all select 'location_category', null, r.location, variance_category, count(*) as n, any_value(c.t) as t,
 round(count(*) * 100.0::double / any_value(c.t), 2)
from result r join (select location, count(*) as t from result group by 1) c on c.location = r.location
group by r.location, variance_category""",
    "summary_counts": """select count(*) as total_records,
 count(case when variance_category <> 'Perfect Match' then 1 end) as total_variances,
 count(case when variance_category = 'Perfect Match' then 1 end) as perfect_matches,
 count(case when variance_category in ('Missing From Forecast', 'Missing From Usage') then 1 end) as critical_issues,
 round(total_variances * 100.0::double / total_records, 2) as variance_share_percent from result""",
    "variance_stats": """select round(avg(absolute_variance), 2) as mean_variance,
 round(median(absolute_variance), 2) as median_variance, round(max(absolute_variance), 2) as max_variance,
 round(sum(absolute_variance), 2) as total_variance from result""",
    "period_range": """select min(period) as first_period, max(period) as last_period,
 count(distinct period) as n_months from result""",
    "slicer_values": """select distinct 'company' as slicer, company as value from result
union all select distinct 'location', location from result
union all select distinct 'year', strftime(period, '%Y') from result""",
    "slice_cube": """select month, variance_category, cast(sum(n) as bigint) as "count" from chart
where location in ('East', 'North HQ') and month in ('2000-03', '2000-04', '2000-05', '2000-12') group by 1, 2""",
    "slice_cube_range": """select month, variance_category, cast(sum(n) as bigint) as "count" from chart
where location = 'South' and month between '2000-04' and '2000-09' group by 1, 2""",
    "crosstab": "select month, "
    + ", ".join(
        f"cast(sum(case when variance_category = '{c}' then n else 0 end) as bigint) as \"{c}\"" for c in _CATEGORIES
    )
    + ", cast(sum(case when variance_category in ("
    + ", ".join(f"'{c}'" for c in _CATEGORIES)
    + ") then 0 else n end) as bigint) as other from chart group by month",
    "stack_max": """select cast(ceil(max(t) * 1.1::double) as bigint) as axis_max
from (select cast(sum(n) as bigint) as t from chart group by month) m""",
    "segment_share": f"""select month, variance_category, cast({_POSITION} as int) as stack_position, n as "count",
 t as month_total, round(n / t * 100, 2) as share_percent,
 case when n / t * 100 >= 3 then printf('%.1f%%', round(n / t * 100, 1)) end as label
from (select month, variance_category, cast(sum(n) as bigint) as n,
 cast(sum(sum(n)) over (partition by month) as bigint) as t from chart group by 1, 2) m""",
    "low_usage_parts": "select * from low_usage",
    "exclusion_reasons": "select company, plant, part_num, cast(list_no as int) as list_no, reason from reasons",
    "view_anti_exclusions": "select * from view_usage",
    "view_compare": "select * from view_rows",
    "view_full": f"select {_wide('part_num', True)} from view_rows",
    "view_hot_keys": f"select {_wide('part_num', True)} from view_rows",
    "view_single_period": f"select {_wide('product_code', False)} from view_rows where period = date '2000-08-31'",
    "investigate_verify": """
select c.company, c.plant, c.part_num, c.period, c.location, c.actual_usage, c.forecast_usage,
 coalesce(u.found, 0) as found_actual, coalesce(f.found, 0) as found_forecast,
 coalesce(u.found, 0) = c.actual_usage as actual_matches, coalesce(f.found, 0) = c.forecast_usage as forecast_matches,
 actual_matches and forecast_matches as data_verified
from cases c
left join (select company, plant, part_num, period_end, min(case when company = 'NORTH' and plant = 'HQ'
  then qty_a + qty_b + qty_c else qty_c end) as found from usage_keyed group by 1, 2, 3, 4) u
 on u.company = c.company and u.plant = c.plant and u.part_num = c.part_num and u.period_end = c.period
left join (select company, part_num, period, qty as found from (
  select company, product as part_num, last_day(period) as period, qty,
   row_number() over (partition by company, product, last_day(period) order by location, forecast_raw.period, qty) as rn
  from forecast_raw) r where rn = 1) f
 on f.company = c.company and f.part_num = c.part_num and f.period = c.period""",
    "investigate_history": "select * from history",
    "investigate_presence": "select * from presence",
    "investigate_criteria": "select * from checked",
    "investigate_chosen": "select * from chosen_diagnosed",
    "root_cause": "select * from diagnosed",
    "root_cause_exclusions_off": "select * from diagnosed_off",
    "root_cause_priority": """select d.*, owner, verdict, severity,
 coalesce(fixed, case when total_12mo > 50 then 'High' when total_12mo > 10 then 'Medium' else 'Low' end) as priority
from diagnosed d join (values
 ('CONFIGURATION_ISSUE', 'Configuration/Admin team', 'NOT A DATA ISSUE - Configuration choice', 'Low', 'Low'),
 ('LEGITIMATE_MISSING_PART', 'Procurement/Planning team', 'LEGITIMATE DATA INTEGRITY ISSUE - Requires action',
  null, 'Medium-High'),
 ('DATA_SYNC_ISSUE', 'IT/Integration team', 'SYSTEM ISSUE - Check integration', 'High', 'High'),
 ('FORECASTING_ACCURACY', 'Planning/Forecasting team', 'FORECASTING ISSUE - Review parameters', 'Medium',
  'Low-Medium'),
 ('UNKNOWN', 'Analysis team', 'UNKNOWN - Requires manual review', 'Medium', null))
 as t(cause, owner, verdict, fixed, severity) on t.cause = d.root_cause""",
    "quick_patterns": """select company, plant, part_num, period, location, actual_usage, forecast_usage,
 coalesce(fails_non_stock and total_12mo <= 2 and not ever_in_forecast, false) as non_stock_low_usage,
 coalesce(not fails_non_stock and class_id in ('PUR', 'MFG') and total_12mo > 10 and not ever_in_forecast, false)
  as stocked_never_forecast,
 ever_in_forecast and forecast_usage = 0 and actual_usage > 0 as stopped_in_forecast,
 actual_usage > 0 and forecast_usage > 0 and not should_be_excluded as forecast_variance from diagnosed""",
    "part_forecast_lookup": "select * from forecast_raw where product = 'P_1'",
    "part_usage_lookup": """select site_part_key, period_end, sum(qty_a + qty_b + qty_c) as total_usage from usage_raw
where contains(site_part_key, 'P_1') group by 1, 2""",
    "part_exemption_lookup": """select u.method_code, c.code_desc, s.company, s.plant, s.part_num, s.non_stock, s.row_id
from part_site s join part_site_ud u on u.foreign_row_id = s.row_id
join method_codes c on c.company = s.company and c.code_type = 'Methods'
 and try_cast(c.code_id as double) = u.method_code
where s.part_num = 'P_1'""",
    "part_card_lookup": """select company, part_num, inactive, runout, class_id, prod_code from part_master
where company = 'NORTH' and part_num = 'P_1'""",
    "csv_roundtrip": "select * from result",
    "parquet_roundtrip": "select * from result",
    "rerun_months": f"""select {RESULT} from result where month(period) not in (6, 7, 8)
union all by name select *, cast(null as bigint) as transaction_count_12mo from result_plain where month(period) in (6, 7, 8)""",
    "job_result": "select * from result",
    "job_log": """select r.*, date '2000-01-01' as "start", date '2000-12-31' as "end", 'NORTH,SOUTH,EAST' as companies,
 true as status_found, t.total_records, t.critical_issues, i.* from (values
 ('good', 'pending,running,completed', 'completed', 'manual', null),
 ('broken', 'pending,running,failed', 'failed', 'scheduler', 'Unsupported output format: excel'))
 as r(run, states, state, triggered_by, error)
left join (select count(*) as total_records,
 count(case when variance_category in ('Missing From Forecast', 'Missing From Usage') then 1 end) as critical_issues
 from result) t on run = 'good'
left join (select a.n as initial_rows, a.n - b.n as excluded_rows, b.n as rows_after_exclusion,
 b.n - c.n as infrequent_rows, d.n as exempt_rows, c.n as remaining_rows
 from (select count(*) as n from usage_norm) a, (select count(*) as n from usage_allowed) b,
  (select count(*) as n from usage_kept) c, (select count(*) as n from usage_allowed where location = 'North HQ') d) i
 on run = 'good'""",
    "run_log_roundtrip": """select cast(run_id as varchar) as run_id, created_at, ts as updated_at,
 'events' as triggered_by, state, case when state = 'completed' then event_id end as total_records,
 case when state = 'completed' then event_id % 7 end as critical_issues,
 case when state = 'completed' then value end as execution_seconds,
 case when state = 'failed' then 'event ' || cast(event_id as varchar) end as error from (
 select *, row_number() over (partition by run_id order by ts desc, event_id desc) as rn,
  min(ts) over (partition by run_id) as created_at from run_events) where rn = 1""",
    "run_log_latest": f"select *, {_RUN_KEY} from run_latest",
    "run_status": """select c_custkey as run_id, coalesce(state, 'not_found') as state
from customer left join run_latest on run_id = c_custkey""",
    "run_page": """select *, 2 as page, (select cast(ceil(count(*) / 20) as bigint) from run_latest) as total_pages
from run_latest order by created_at desc, run_id desc limit 20 offset 20""",
}


def statements() -> dict[str, str]:
    return {name: with_ctes(select) for name, select in SELECTS.items()}
