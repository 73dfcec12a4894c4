"""SQL twins of the registered queries, for DuckDB on the same tables.

Each twin is written on its own terms, not generated from the library. ``STEPS``
are shared ``WITH`` terms; a twin carries those it needs.
"""

from __future__ import annotations

import re

from fleetspan.sources.binding import AS_OF, HORIZON, TABLES, VIEWS

DAY = f"date '{AS_OF}'"
H = HORIZON


def S(x):  # stripped text
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def N(x):  # normalised key
    return f"nullif(upper({S(x)}), '')"


def ND(x):  # normalised key without domain
    return f"nullif(split_part(upper({S(x)}), '.', 1), '')"


def NUM(x):  # number from text
    return rf"case when regexp_matches({S(x)}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') then try_cast({S(x)} as double) end"


def by_text(x):
    t = N(x)
    return f"""case when regexp_matches({t}, 'SWITCH|HUB') then 'Switch'
      when regexp_matches({t}, 'ROUTER|INTEGRATED\\s*SERVICES|EDGE\\s*PLATFORM|\\bASR\\b') then 'Router'
      when regexp_matches({t}, 'ACCESS\\s*POINT|UNIFIED\\s*ACCESS\\s*POINT|\\bAP\\b') then 'AP'
      when regexp_matches({t}, 'WIRELESS\\s*CONTROLLER|\\bWLC\\b') then 'Wireless Controller'
      when regexp_matches({t}, 'VOICE\\s*GATEWAY') then 'Voice Gateway' end"""


NO = "cast(null as varchar)"


def bucket(d):
    return f"""case when {d} is null then 'unknown' when {d} < 0 then 'overdue'
      when {d} <= {H} then 'within_horizon' else 'future' end"""


METRICS = f"""
  date_diff('day', {DAY}, modeldata_eol) as days_to_eol,
  {bucket(f"date_diff('day', {DAY}, modeldata_eol)")} as eol_bucket,
  coalesce(pricing_total_estimate, modeldata_material_cost, 0e0) as replacement_cost_estimate,
  coalesce(modeldata_labor_cost, 0e0) as labor_cost_estimate,
  software_version is null and firmware_version is null as version_missing"""

SCORES = """
  case when days_to_eol is null then 30e0
    else least(greatest((days_to_eol + 365e0) / 1460e0 * 100e0, 0e0), 100e0) end as support_coverage_score,
  least(greatest(case eol_bucket when 'overdue' then 80e0 when 'within_horizon' then 50e0 when 'future' then 20e0
    else 45e0 end + case when version_missing then 10e0 else 0e0 end, 0e0), 100e0) as security_risk_score,
  case when eol_bucket in ('overdue', 'within_horizon') then replacement_cost_estimate else 0e0 end
    as near_term_cost_component"""

DATASET_COLUMNS = """
  device_name, device_source, source_device_id, state_code, site_code, loc_site_name is not null as location_matched,
  loc_state, loc_site_code, loc_site_name, loc_address_1, loc_city, loc_zip, loc_county,
  loc_call_group, loc_owner, loc_latitude, loc_longitude, device_model, device_type, device_status,
  device_reachability, device_vendor, device_ip, serial_number, software_version, uptime,
  modeldata_model, modeldata_model_parent, modeldata_category, modeldata_in_scope, modeldata_repl_device,
  modeldata_eos, modeldata_eol, modeldata_dna_y_n, modeldata_dna_part_number, modeldata_stg_config_y_n,
  modeldata_de_hrs, modeldata_se_hrs, modeldata_fot_hrs, modeldata_de_cost, modeldata_se_cost,
  modeldata_fot_cost, modeldata_labor_cost, modeldata_device_cost, modeldata_dna_cost, modeldata_staging_cost,
  modeldata_tax_oh, modeldata_material_cost, repl_device_key, replacement_device_sku, replacement_device_cost,
  replacement_labor_de_hours, replacement_labor_se_hours, replacement_labor_fo_hours, pricing_component_count,
  pricing_total_estimate, device_role, free_ports, total_ports, ports_in_use"""
CLEANED_AWAY = """
  modeldata_pm_hrs, software_type, source_location, country_code, controller_name, loc_address_2, device_model_raw,
  firmware_version, associated_wlc_ip, source_platform_id, management_state"""

STEPS = {name: text.format(**{n: n for n in (*TABLES, *VIEWS)}) for name, text in VIEWS.items()}
STEPS.update(
    {
        "f_solid": "select * from solid s where not exists (select 1 from decom d where d.site_cd is not distinct from s.site_code)",
        "f_solid_loc": "select * from solid_loc s where not exists (select 1 from decom d where d.site_cd is not distinct from s.site_code)",
        "f_catctr": """
select * replace (split_part(hostname, '.', 1) as hostname,
  case family when 'Unified AP' then 'AP' when 'Routers' then 'Router' when 'Switches and Hubs' then 'Switch'
    else family end as family)
from catctr
where (reachabilitystatus is null or reachabilitystatus not in ('Unreachable', 'Ping Reachable')) and hostname is not null""",
        "f_primeap": "select * from primeap p where not exists (select 1 from f_catctr c where c.hostname is not distinct from p.name)",
        "f_primewlc": "select * from primewlc p where not exists (select 1 from f_catctr c where c.hostname is not distinct from p.devicename)",
        "na_unique": """
select * from na n
where not exists (select 1 from f_catctr c where c.hostname is not distinct from n.host_name)
  and not exists (select 1 from f_primeap c where c.name is not distinct from n.host_name)
  and not exists (select 1 from f_primewlc c where c.devicename is not distinct from n.host_name)""",
        "f_na": """
select * replace (case when device_type like '%Switch%' then 'Switch' else device_type end as device_type)
from na_unique
where device_status is distinct from 'Inactive'
  and (device_type is null or device_type not in ('Wireless Controller', 'Firewall', 'Virtual Firewall', 'WirelessLC'))""",
        "f_modeldata": "select * from modeldata where category is null or category not in ('Sec/SD-WAN', 'Sec/Vid', 'Voice')",
        "device_rows": f"""
select *, {NO} as device_ip, {NO} as associated_wlc_ip, {NO} as uptime, {NO} as source_location,
  {NO} as total_ports, {NO} as ports_in_use
from (
  select 'CatCtr' as device_source, hostname as source_device_id, {ND('hostname')} as device_name,
    {N('platformid')} as device_model_raw, {S(f"split_part({N('platformid')}, ',', 1)")} as device_model, source_row_index,
    family as device_family_raw, platformid as source_platform_id, reachabilitystatus as device_reachability,
    serialnumber as serial_number, softwareversion as software_version, type as device_type_raw,
    vendor as device_vendor, managementstate as management_state, role as device_role
  from f_catctr
  union all by name
  select 'PrimeAP' as device_source, name as source_device_id, {ND('name')} as device_name,
    {N('model')} as device_model_raw, {S(f"split_part({N('model')}, ',', 1)")} as device_model, source_row_index,
    status as device_status, serialnumber as serial_number, softwareversion as software_version,
    type as device_type_raw, controllername as controller_name, countrycode as country_code
  from f_primeap
  union all by name
  select 'PrimeWLC' as device_source, devicename as source_device_id, {ND('devicename')} as device_name,
    {N('manufacturer_part_partnumber')} as device_model_raw,
    {S(f"split_part({N('manufacturer_part_partnumber')}, ',', 1)")} as device_model, source_row_index,
    reachability as device_reachability, softwareversion as software_version, softwaretype as software_type,
    productfamily as device_family_raw, adminstatus as device_status
  from f_primewlc
  union all by name
  select 'NA' as device_source, host_name as source_device_id, {ND('host_name')} as device_name,
    {N('device_model')} as device_model_raw, {S(f"split_part({N('device_model')}, ',', 1)")} as device_model, source_row_index,
    device_type as device_type_raw, device_status, software_version, firmware_version, free_ports
  from f_na
)
where device_name is not null""",
        "typed_rows": f"""
select *, case device_source when 'PrimeAP' then 'AP' when 'PrimeWLC' then 'Wireless Controller'
    when 'NA' then {by_text('device_type_raw')}
    else coalesce(case {N('device_family_raw')} when 'AP' then 'AP' when 'ROUTER' then 'Router' when 'SWITCH' then 'Switch'
      when 'WIRELESS CONTROLLER' then 'Wireless Controller' when 'VOICE GATEWAY' then 'Voice Gateway' end,
      {by_text('device_type_raw')}) end as device_type
from device_rows""",
        "best_rows": """
select *, substr(device_name, 1, 2) as state_code, substr(device_name, 3, 3) as site_code
from typed_rows
qualify row_number() over (partition by device_name
  order by case device_source when 'CatCtr' then 1 when 'NA' then 3 else 2 end,
    case device_source when 'CatCtr' then 1 when 'PrimeAP' then 2 when 'PrimeWLC' then 3 else 4 end,
    source_row_index nulls last, device_model_raw nulls last, software_version nulls last) = 1""",
        "places": f"""
select {N('s.site_code')} as loc_site_code, {N('s.state')} as loc_state,
  coalesce(s.site_name, l.site_name) as loc_site_name, s.street_address_1 as loc_address_1,
  s.street_address_2 as loc_address_2, s.city as loc_city, s.zip as loc_zip,
  {NUM('l.latitude')} as loc_latitude, {NUM('l.longitude')} as loc_longitude,
  l.physicaladdresscounty as loc_county, l.call_group as loc_call_group, l.owner as loc_owner
from f_solid s left join f_solid_loc l on {N('s.site_code')} is not distinct from {N('l.site_code')}""",
        "models": f"""
select model as modeldata_model, model_parent as modeldata_model_parent, category as modeldata_category,
  {NO} as modeldata_in_scope, repl_device as modeldata_repl_device, {NO} as modeldata_eos,
  cast(eol as varchar) as modeldata_eol, {NO} as modeldata_dna_y_n, {NO} as modeldata_dna_part_number,
  {NO} as modeldata_stg_config_y_n, cast(null as double) as modeldata_de_hrs, cast(null as double) as modeldata_se_hrs,
  cast(null as double) as modeldata_fot_hrs, cast(null as double) as modeldata_pm_hrs,
  cast(null as double) as modeldata_de_cost, cast(null as double) as modeldata_se_cost,
  cast(null as double) as modeldata_fot_cost, {NUM('labor_cost')} as modeldata_labor_cost,
  cast(null as double) as modeldata_device_cost, cast(null as double) as modeldata_dna_cost,
  cast(null as double) as modeldata_staging_cost, {NO} as modeldata_tax_oh,
  {NUM('material_cost')} as modeldata_material_cost,
  {N('model')} as model_key, {N('repl_device')} as repl_device_key
from f_modeldata""",
        "price_rows": f"""
select {N('parent_product')} as parent_product_key, {N('product')} as product_key, {N('device')} as device_flag,
  {NUM('pricing')} as amount, {NUM('labor_de')} as de, {NUM('labor_se')} as se, {NUM('labor_fo')} as fo
from pricing""",
        "price_totals": """
select parent_product_key, count(product_key) as pricing_component_count,
  coalesce(sum(amount), 0e0) as pricing_total_estimate
from price_rows where parent_product_key is not null group by 1""",
        "prices": """
select t.*, r.product_key as replacement_device_sku, r.amount as replacement_device_cost,
  r.de as replacement_labor_de_hours, r.se as replacement_labor_se_hours, r.fo as replacement_labor_fo_hours
from price_totals t left join (select * from price_rows where device_flag = 'Y') r using (parent_product_key)""",
        "at_sites": """
select d.*, p.* from best_rows d left join places p on d.state_code = p.loc_state and d.site_code = p.loc_site_code""",
        "with_models": "select d.*, m.* from at_sites d left join models m on d.device_model is not distinct from m.model_key",
        "full_rows": """
select d.*, p.* exclude (parent_product_key) from with_models d left join prices p on d.repl_device_key = p.parent_product_key""",
        "devs": f"""
select * replace ({N('loc_state')} as loc_state, {N('loc_site_code')} as loc_site_code, {S('loc_site_name')} as loc_site_name,
  try_cast(modeldata_eol as date) as modeldata_eol,
  coalesce(nullif(nullif({S('device_source')}, ''), 'NAN'), 'NA') as device_source)
from full_rows""",
        "mapped": """
select * from devs where loc_state is not null and loc_site_code is not null and loc_latitude is not null
  and loc_longitude is not null""",
        "mapped_days": f"select *, {METRICS} from mapped",
        "found": f"select *, {SCORES}, loc_state || '-' || loc_site_code as site_id from mapped_days",
        "sites": """
select loc_state, loc_site_code, loc_site_name, site_id, count(*) as total_devices,
  count(*) filter (eol_bucket = 'overdue') as overdue_count,
  count(*) filter (eol_bucket = 'within_horizon') as within_horizon_count,
  count(*) filter (eol_bucket = 'future') as future_count,
  count(*) filter (eol_bucket = 'unknown') as unknown_count,
  count(days_to_eol) as eol_known_devices, round(avg(days_to_eol), 6) as avg_days_to_eol,
  round(avg(support_coverage_score), 6) as support_coverage_score,
  round(avg(security_risk_score), 6) as security_risk_score,
  sum(replacement_cost_estimate) as replacement_cost_total, sum(near_term_cost_component) as near_term_cost,
  cast(count(*) filter (eol_bucket = 'overdue') as double) / count(*) * 100e0 as overdue_rate
from found group by all""",
        "spots": """
select loc_state, loc_site_code, loc_site_name, loc_latitude, loc_longitude, count(*) as device_count,
  count(days_to_eol) as eol_known_devices, count(*) filter (days_to_eol < 0) as overdue_devices,
  cast(sum(days_to_eol) as bigint) as remaining_days_total, round(avg(days_to_eol), 6) as remaining_days_avg,
  cast(sum(case when days_to_eol >= 0 then days_to_eol else 2 * days_to_eol end) as bigint) as remaining_days_weighted_total,
  loc_state || '-' || loc_site_code as cluster_id
from mapped_days group by loc_state, loc_site_code, loc_site_name, loc_latitude, loc_longitude""",
        "scale": """
select case when p10 is null then -365e0 when p10 = p90 then p10 - 1 else p10 end as metric_min,
  case when p10 is null then 365e0 when p10 = p90 then p90 + 1 else p90 end as metric_max, largest
from (select quantile_cont(cast(remaining_days_weighted_total as double), 0.1) as p10,
  quantile_cont(cast(remaining_days_weighted_total as double), 0.9) as p90, coalesce(max(device_count), 1) as largest from spots)""",
        "local_sites": """
select loc_state, loc_site_code, min(loc_site_name) as site_name, count(distinct device_name) as device_count,
  count(days_to_eol) as eol_known_devices, count(*) filter (days_to_eol < 0) as overdue_devices,
  cast(sum(days_to_eol) as bigint) as remaining_days_total, round(avg(days_to_eol), 6) as remaining_days_avg,
  count(*) as total_devices, count(*) filter (eol_bucket = 'overdue') as overdue_count,
  count(*) filter (eol_bucket = 'within_horizon') as within_horizon_count,
  count(*) filter (eol_bucket = 'future') as future_count, count(*) filter (eol_bucket = 'unknown') as unknown_count,
  count(days_to_eol) as known_count, count(distinct device_name) = count(*) as consistent
from mapped_days group by 1, 2""",
        "local_sources": """
select loc_state, loc_site_code, string_agg(device_source || '=' || n, ',' order by device_source) as sources
from (select loc_state, loc_site_code, device_source, count(*) as n from mapped_days group by all) group by all""",
        "all_days": f"select *, {METRICS} from devs",
        "rep": f"""
select * replace (upper({S('loc_state')}) as loc_state, upper({S('loc_site_code')}) as loc_site_code), {SCORES},
  coalesce(upper({S('loc_state')}), 'NA') || '-' || coalesce(upper({S('loc_site_code')}), 'NA') as site_id
from all_days""",
        "bucket_names": """
select * from (values (1, 'overdue', 'Overdue'), (2, 'within_horizon', 'Within 365d'), (3, 'future', 'Future'),
  (4, 'unknown', 'Unknown')) t(position, eol_bucket, label)""",
        "preds": f"""
select cast(predicted_behavior_class as int) as predicted_behavior_class, prediction_confidence,
  {N('loc_state')} as loc_state, {S('device_model')} as device_model, coalesce({S('device_source')}, 'NA') as device_source
from predictions where predicted_behavior_class in (-1, 0, 1)""",
        "pred_rows": """
select *, predicted_behavior_class in (-1, 1) as risky,
  predicted_behavior_class = -1 as passed, predicted_behavior_class = 1 as within_y, predicted_behavior_class = 0 as later
from preds""",
        "learn": f"""
select *, case when date_diff('day', {DAY}, modeldata_eol) < 0 then -1
    when date_diff('day', {DAY}, modeldata_eol) <= 365 then 1 else 0 end as target
from devs where loc_state is not null and modeldata_eol is not null""",
        "points": """
select * from (
  select -1 as class_id, actual = -1 as hit, p_passed as score from scored
  union all select 0, actual = 0, p_beyond from scored
  union all select 1, actual = 1, p_within from scored)""",
        "by_score": """
select class_id, score, count(*) filter (hit) as pos, count(*) filter (not hit) as neg from points group by 1, 2""",
        "running": """
select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by class_id) as all_pos,
  sum(neg) over (partition by class_id) as all_neg,
  lead(pos) over (partition by class_id order by score desc) as next_pos,
  lead(neg) over (partition by class_id order by score desc) as next_neg,
  row_number() over (partition by class_id order by score desc) as place
from by_score window w as (partition by class_id order by score desc rows unbounded preceding)""",
        "corners": """
select class_id, cast(fp as double) / cast(all_neg as double) as fpr, cast(tp as double) / cast(all_pos as double) as tpr
from running where place = 1 or next_pos is null or next_pos <> pos or next_neg <> neg
union all select unnest([-1, 0, 1]), 0e0, 0e0""",
        "steps_at": "select class_id, fpr, min(tpr) as low, max(tpr) as high from corners group by 1, 2",
        "confusion": """
select a.c as actual, p.c as predicted, count(s.doc_id) as n
from (values (-1), (0), (1)) a(c) cross join (values (-1), (0), (1)) p(c)
left join scored s on s.actual = a.c and s.predicted = p.c group by 1, 2""",
        "per_class": """
select c.c as class_id, cast(sum(case when actual = c.c and predicted = c.c then n else 0 end) as bigint) as tp,
  cast(sum(case when actual = c.c then n else 0 end) as bigint) as support,
  cast(sum(case when predicted = c.c then n else 0 end) as bigint) as chosen
from confusion cross join (values (-1), (0), (1)) c(c) group by 1""",
        "per_score": """
select class_id, support, tp, case when chosen > 0 then cast(tp as double) / chosen else 0e0 end as p,
  case when support > 0 then cast(tp as double) / support else 0e0 end as r,
  case when support + chosen > 0 then cast(2 * tp as double) / (support + chosen) else 0e0 end as f
from per_class""",
        "logits": """
select vec_id, label, list_transform(embedding, lambda v: cast(v as double)) as x from embeddings""",
    }
)


def with_steps(select: str) -> str:
    """The twin with the terms it needs, in order."""
    needed: set[str] = set()
    todo = [select]
    while todo:
        text = todo.pop()
        for name in STEPS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(STEPS[name])
    terms = ",\n".join(f"{n} as ({STEPS[n].strip()})" for n in STEPS if n in needed)
    recursive = "recursive " if any(n.endswith("_heavy") for n in needed) else ""
    return f"with {recursive}{terms}\n{select.strip()}" if terms else select.strip()


TWINS: dict[str, str] = {}


def twin(key: str, select: str) -> None:
    TWINS[key] = with_steps(select)


# --- tabs, keys, filters -----------------------------------------------------

_RAW = {"SOLID": "solid", "SOLID-Loc": "solid_loc", "NA": "na", "PrimeAP": "primeap", "PrimeWLC": "primewlc",
        "CatCtr": "catctr", "Decom": "decom", "ModelData": "modeldata", "Pricing": "pricing"}
_FILTERED = {t: v if t in ("Decom", "Pricing") else f"f_{v}" for t, v in _RAW.items()}
# Columns each tab is read for, the row number of the inventories and the link column of the model data included.
_WIDTH = {"SOLID": 7, "SOLID-Loc": 7, "NA": 14, "PrimeAP": 12, "PrimeWLC": 12, "CatCtr": 13, "Decom": 1, "ModelData": 24, "Pricing": 7}
twin(
    "tabs_row_counts",
    " union all ".join(
        [f"select 'raw' as stage, '{t}' as tab, count(*) as n_rows, {_WIDTH[t]} as n_columns from {v}" for t, v in _RAW.items()]
        + [f"select 'filtered', '{t}', count(*), {_WIDTH[t]} from {v}" for t, v in _FILTERED.items()]
    ),
)
twin("read_tabs_roundtrip", "select device_name, device_source, device_model from best_rows")
twin("null_tokens", """
select case when parent_product not in ('', 'NA', 'n/a', 'NULL') then parent_product end as parent_product,
  case when product not in ('', 'NA', 'n/a', 'NULL') then product end as product,
  case when device not in ('', 'NA', 'n/a', 'NULL') then device end as device,
  case when pricing not in ('', 'NA', 'n/a', 'NULL') then pricing end as pricing from pricing""")
twin("normalize_keys", f"""
select source_row_index, hostname, {ND('hostname')} as host_key, {N('hostname')} as host_text from catctr""")
twin("filter_catctr", "select hostname, family, reachabilitystatus, source_row_index from f_catctr")
twin("filter_na", """
select host_name, case when device_type like '%Switch%' then 'Switch' else device_type end as device_type, device_status,
  source_row_index
from na where device_status is distinct from 'Inactive'
  and (device_type is null or device_type not in ('Wireless Controller', 'Firewall', 'Virtual Firewall', 'WirelessLC'))""")
twin("filter_modeldata", "select model, category from f_modeldata")
twin("active_sites", "select 'SOLID' as tab, site_code from f_solid union all select 'SOLID-Loc', site_code from f_solid_loc")
twin("cross_source_filter", """
select 'PrimeAP' as tab, name as host, source_row_index from f_primeap
union all select 'PrimeWLC', devicename, source_row_index from f_primewlc
union all select 'NA', host_name, source_row_index from na_unique""")
twin("overlap_hosts", """
select 'PrimeAP' as also_in, host_name, device_model, source_row_index from na n
where exists (select 1 from primeap p where p.name is not distinct from n.host_name)
union all
select 'PrimeWLC', host_name, device_model, source_row_index from na n
where exists (select 1 from primewlc p where p.devicename is not distinct from n.host_name)""")
twin("site_coverage_gaps", """
select 'SOLID' as only_in, site_code, site_name from f_solid s
where not exists (select 1 from f_solid_loc l where l.site_code is not distinct from s.site_code)
union all
select 'SOLID-Loc', site_code, site_name from f_solid_loc s
where not exists (select 1 from f_solid l where l.site_code is not distinct from s.site_code)""")
twin("na_value_counts", """
select 'device_type' as "column", device_type as value, count(*) as n_rows from f_na where device_type is not null group by 2
union all
select 'device_status', device_status, count(*) from f_na where device_status is not null group by 2""")
twin("filter_audit", """
select 'decommissioned' as step, 'SOLID' as tab, count(*) as n_rows from solid s
  where exists (select 1 from decom d where d.site_cd is not distinct from s.site_code)
union all select 'unreachable', 'CatCtr', count(*) from catctr where reachabilitystatus in ('Unreachable', 'Ping Reachable')
union all select 'no_hostname', 'CatCtr', count(*) from catctr where hostname is null
  and (reachabilitystatus is null or reachabilitystatus not in ('Unreachable', 'Ping Reachable'))
union all select 'in_catctr', 'PrimeAP', (select count(*) from primeap) - (select count(*) from f_primeap)
union all select 'in_catctr', 'PrimeWLC', (select count(*) from primewlc) - (select count(*) from f_primewlc)
union all select 'in_catctr', 'NA', count(*) from na n
  where exists (select 1 from f_catctr c where c.hostname is not distinct from n.host_name)
union all select 'in_primeap', 'NA', count(*) from na n
  where not exists (select 1 from f_catctr c where c.hostname is not distinct from n.host_name)
  and exists (select 1 from f_primeap c where c.name is not distinct from n.host_name)
union all select 'in_primewlc', 'NA', count(*) from na n
  where not exists (select 1 from f_catctr c where c.hostname is not distinct from n.host_name)
  and exists (select 1 from f_primewlc c where c.devicename is not distinct from n.host_name)
union all select 'inactive', 'NA', count(*) from na_unique where device_status = 'Inactive'
union all select 'out_of_scope_type', 'NA', count(*) from na_unique where device_status is distinct from 'Inactive'
  and device_type in ('Wireless Controller', 'Firewall', 'Virtual Firewall', 'WirelessLC')
union all select 'out_of_scope_category', 'ModelData', count(*) from modeldata where category in ('Sec/SD-WAN', 'Sec/Vid', 'Voice')""")

# --- device dataset ----------------------------------------------------------

twin("source_frames", f"""
select device_source, source_device_id, device_name, model as device_model_raw,
  {S("split_part(model, ',', 1)")} as device_model, source_row_index
from (
  select 'CatCtr' as device_source, hostname as source_device_id, {ND('hostname')} as device_name, {N('platformid')} as model, source_row_index from catctr
  union all select 'PrimeAP', name, {ND('name')}, {N('model')}, source_row_index from primeap
  union all select 'PrimeWLC', devicename, {ND('devicename')}, {N('manufacturer_part_partnumber')}, source_row_index from primewlc
  union all select 'NA', host_name, {ND('host_name')}, {N('device_model')}, source_row_index from na)
where device_name is not null""")
twin("device_union", "select * from device_rows")
twin("device_type", "select device_name, device_source, source_row_index, device_type from typed_rows")
twin("device_dedup", "select device_name, device_source, source_row_index, device_model from best_rows")
twin("device_codes", "select device_name, state_code, site_code from best_rows")
twin("location_dim", "select * from places")
twin("model_dim", "select * from models")
twin("pricing_rollup", "select * from price_totals")
twin("pricing_dim", "select * from prices")
twin("device_location", """
select device_name, loc_state, loc_site_code, loc_site_name, loc_latitude, loc_longitude,
  loc_site_name is not null as location_matched from at_sites""")
twin("device_model_join", """
select device_name, modeldata_model, modeldata_category, modeldata_eol, modeldata_material_cost, repl_device_key
from best_rows d left join models m on d.device_model is not distinct from m.model_key""")
twin("device_dataset", f"select {DATASET_COLUMNS}, {CLEANED_AWAY} from full_rows")
twin("clean_devices", f"select {DATASET_COLUMNS} from full_rows")
twin("reconciliation", """
select count(*) as total_rows, (select count(*) from mapped) as mapped_rows,
  count(*) - (select count(*) from mapped) as excluded_rows from devs""")
twin("join_fanout", """
select '1_devices' as step, count(*) as n_rows from best_rows union all select '2_location', count(*) from at_sites
union all select '3_model', count(*) from with_models union all select '4_pricing', count(*) from full_rows""")
twin("load_devices", """
select device_name, loc_state, loc_site_code, loc_site_name, loc_latitude, loc_longitude,
  cast(modeldata_eol as varchar) as modeldata_eol, device_source from devs""")
twin("mappable_devices", "select device_name, loc_state, loc_site_code from mapped")

# --- lifecycle ---------------------------------------------------------------

twin("days_to_eol", "select device_name, cast(modeldata_eol as varchar) as modeldata_eol, cast(days_to_eol as int) as days_to_eol from all_days")
twin("eol_bucket", "select device_name, eol_bucket from all_days")
twin("eol_bucket_counts", """
select count(*) as total_devices, count(*) filter (eol_bucket = 'overdue') as overdue_count,
  count(*) filter (eol_bucket = 'within_horizon') as within_horizon_count, count(*) filter (eol_bucket = 'future') as future_count,
  count(*) filter (eol_bucket = 'unknown') as unknown_count, count(*) filter (eol_bucket <> 'unknown') as known_count from all_days""")
twin("device_metrics", """
select device_name, site_id, cast(days_to_eol as int) as days_to_eol, eol_bucket, replacement_cost_estimate,
  labor_cost_estimate, version_missing, support_coverage_score, security_risk_score, near_term_cost_component from found""")

# --- clusters ----------------------------------------------------------------

twin("site_clusters", "select * from spots")
twin("clusters_by_state", "select * from spots where loc_state = 'AC'")
twin("metric_domain", """
select round(metric_min, 6) as metric_min, round(metric_max, 6) as metric_max, largest as max_device_count,
  largest as global_max_device_count from scale""")
twin("cluster_urgency", """
select cluster_id, loc_site_name, loc_latitude, loc_longitude, device_count,
  case when remaining_days_weighted_total is not null then round((greatest(metric_min, least(metric_max,
    cast(remaining_days_weighted_total as double))) - metric_min) / (metric_max - metric_min), 6) end as urgency_position,
  round(4e0 + 28e0 * sqrt(device_count) / sqrt(greatest(1, largest)), 6) as base_radius
from spots cross join scale""")
_LOCAL = """
  s.site_name, s.device_count, s.eol_known_devices, s.overdue_devices, s.remaining_days_total, s.remaining_days_avg,
  o.sources"""
twin("location_summary_horizon", f"""
select s.loc_state, s.loc_site_code, {_LOCAL}, s.total_devices, s.overdue_count, s.within_horizon_count, s.future_count, s.unknown_count,
  s.known_count, s.consistent, cast(s.overdue_count as double) / s.total_devices * 100e0 as overdue_share,
  cast(s.within_horizon_count as double) / s.total_devices * 100e0 as within_horizon_share,
  cast(s.future_count as double) / s.total_devices * 100e0 as future_share,
  cast(s.unknown_count as double) / s.total_devices * 100e0 as unknown_share
from local_sites s join local_sources o using (loc_state, loc_site_code)""")
twin("location_summary", f"""
select w.loc_state, w.loc_site_code, {_LOCAL}, coalesce(s.total_devices, 0) as total_devices,
  coalesce(s.overdue_count, 0) as overdue_count, coalesce(s.within_horizon_count, 0) as within_horizon_count,
  coalesce(s.future_count, 0) as future_count, coalesce(s.unknown_count, 0) as unknown_count,
  coalesce(s.known_count, 0) as known_count, s.total_devices is not null as found, {H} as horizon_days
from (values ('AC', 'ABF'), ('ZZ', 'ZZZ')) w(loc_state, loc_site_code)
left join local_sites s using (loc_state, loc_site_code) left join local_sources o using (loc_state, loc_site_code)""")

# --- findings ----------------------------------------------------------------

twin("site_summary", "select * from sites")
twin("top_overdue_sites", """
select loc_state as state, loc_site_code as site_code, loc_site_name as site_name, site_id, total_devices, overdue_count,
  overdue_rate, near_term_cost
from sites order by overdue_count desc, near_term_cost desc, total_devices desc, loc_state, loc_site_code, loc_site_name nulls first limit 10""")
twin("site_risk_scatter", """
select site_id, loc_site_name as site_name, loc_state as state, loc_site_code as site_code, total_devices, support_coverage_score,
  security_risk_score, replacement_cost_total, near_term_cost, overdue_rate,
  round(least(greatest(7e0 + sqrt(greatest(near_term_cost, 0e0)) / 28e0, 7e0), 40e0), 6) as marker_size
from sites order by total_devices desc, overdue_count desc, near_term_cost desc, loc_state, loc_site_code, loc_site_name nulls first limit 350""")
twin("state_exposure", """
select loc_state as state, count(*) as total_devices, count(*) filter (eol_bucket = 'overdue') as overdue_count,
  count(*) filter (eol_bucket = 'unknown') as unknown_count, round(avg(support_coverage_score), 6) as support_coverage_score,
  round(avg(security_risk_score), 6) as security_risk_score, sum(near_term_cost_component) as near_term_cost
from found where loc_state is not null group by 1 order by near_term_cost desc, overdue_count desc, state limit 15""")
twin("source_lifecycle_mix", """
select device_source, count(*) as total_devices, count(*) filter (eol_bucket = 'overdue') as overdue_count,
  count(*) filter (eol_bucket = 'within_horizon') as within_horizon_count, count(*) filter (eol_bucket = 'future') as future_count,
  count(*) filter (eol_bucket = 'unknown') as unknown_count from found group by 1""")
twin("model_hotspots", """
select device_model, count(*) as total_devices, count(*) filter (eol_bucket = 'overdue') as overdue_count,
  sum(near_term_cost_component) as near_term_cost, round(avg(security_risk_score), 6) as security_risk_score
from found where device_model is not null group by 1
order by overdue_count desc, near_term_cost desc, total_devices desc, device_model limit 12""")
twin("findings_kpis", """
select cast(sum(total_devices) as bigint) as total_devices, count(*) as total_sites,
  cast(sum(overdue_count) as bigint) as overdue_devices, cast(sum(unknown_count) as bigint) as unknown_eol_devices,
  sum(near_term_cost) as near_term_cost_estimate from sites""")

# --- predictions -------------------------------------------------------------

twin("load_predictions", "select * from preds")
twin("pred_kpis", """
select count(*) as total_scored, count(*) filter (passed) as predicted_passed_eol, count(*) filter (within_y) as predicted_within_365,
  count(*) filter (later) as predicted_gt_365, count(*) filter (risky) as predicted_risk_total,
  cast(count(*) filter (risky) as double) / count(*) * 100e0 as predicted_risk_rate from pred_rows""")
twin("class_mix", """
select position, class_id, label, count(p.risky) as n_devices,
  cast(count(p.risky) as double) / (select count(*) from pred_rows) * 100e0 as share_pct
from (values (1, -1, 'Likely Passed EoL'), (2, 1, 'Likely EoL <= 365d'), (3, 0, 'Likely EoL > 365d')) c(position, class_id, label)
left join pred_rows p on p.predicted_behavior_class = class_id group by 1, 2, 3""")
_RISK = """count(*) as total_devices, count(*) filter (risky) as predicted_risk_devices,
  count(*) filter (passed) as predicted_passed_eol, count(*) filter (within_y) as predicted_within_365"""
_RISK_ORDER = "order by predicted_risk_devices desc, predicted_passed_eol desc, total_devices desc, 1"
twin("pred_state_risk", f"""
select loc_state as state, {_RISK}, cast(count(*) filter (risky) as double) / count(*) * 100e0 as predicted_risk_rate
from pred_rows where loc_state is not null group by 1 {_RISK_ORDER} limit 15""")
twin("pred_model_risk", f"""
select device_model, {_RISK} from pred_rows where device_model is not null group by 1 {_RISK_ORDER} limit 12""")
twin("pred_source_mix", """
select device_source, count(*) as total_devices, count(*) filter (passed) as predicted_passed_eol,
  count(*) filter (within_y) as predicted_within_365, count(*) filter (later) as predicted_gt_365 from pred_rows group by 1""")
twin("confidence_hist", """
select b.bin, count(p.c) as n_devices
from (values ('0.0-0.2', -1e0, 0.2e0), ('0.2-0.4', 0.2e0, 0.4e0), ('0.4-0.6', 0.4e0, 0.6e0), ('0.6-0.8', 0.6e0, 0.8e0),
  ('0.8-1.0', 0.8e0, 1e0)) b(bin, low, high)
left join (select least(greatest(prediction_confidence, 0e0), 1e0) as c from preds) p on p.c > b.low and p.c <= b.high group by 1""")
twin("top_confident", """
select * from preds order by prediction_confidence desc nulls last, predicted_behavior_class nulls last, loc_state nulls last,
  device_model nulls last, device_source nulls last limit 15""")
twin("rep_pred_mix", """
select 'class' as part, cast(position as bigint) as position, label as name, count(p.risky) as total_devices,
  cast(null as bigint) as predicted_risk_devices
from (values (1, -1, 'Likely Passed EoL'), (2, 1, 'Likely EoL <= 365d'), (3, 0, 'Likely EoL > 365d')) c(position, class_id, label)
left join pred_rows p on p.predicted_behavior_class = class_id group by position, label
union all
select * from (select 'state', cast(null as bigint), loc_state, count(*) as n, count(*) filter (risky) as r from pred_rows
  where loc_state is not null group by loc_state order by r desc, n desc, loc_state limit 12)""")

# --- reports -----------------------------------------------------------------

twin("rep_eol_bucket", """
select position, b.eol_bucket, label, count(r.device_name) as n_devices
from bucket_names b left join rep r on r.eol_bucket = b.eol_bucket group by 1, 2, 3""")


def histogram_twin(value: str, where: str, bins: int) -> str:
    return f"""
select i as bin, low + i * ((high - low) / {bins}) as bin_start, low + (i + 1) * ((high - low) / {bins}) as bin_end,
  count(v) as n_devices
from (select unnest(range(0, {bins}))::int as i)
cross join (select min(v) - pad as low, max(v) + pad as high from
  (select {value} as v, case when min({value}) over () = max({value}) over () then 0.5e0 else 0e0 end as pad from rep where {where}) group by pad)
left join (select {value} as v from rep where {where}) d on least(floor((v - low) * {bins} / (high - low)), {bins} - 1) = i
group by i, low, high"""


twin("rep_days_hist", histogram_twin("days_to_eol", "days_to_eol is not null", 40))
twin("rep_overdue_age", histogram_twin("-days_to_eol", "days_to_eol < 0", 35))
twin("rep_days_kde", """
select point, round(x, 6) as days_to_eol, round(sum(n * exp(-0.5e0 * pow((x - v) / h, 2))) * (high - low) / 40
  / (h * sqrt(2 * pi())), 4) as density
from (select cast(days_to_eol as double) as v, count(*) as n from rep where days_to_eol is not null group by 1)
cross join (select min(days_to_eol) as low, max(days_to_eol) as high,
  stddev_samp(days_to_eol) * pow(count(*), -0.2e0) as h from rep where days_to_eol is not null)
cross join (select unnest(range(0, 200))::int as point)
cross join lateral (select low + (high - low) * point / 199e0 as x)
group by point, x, low, high, h""")
_SITED = "loc_state is not null and loc_site_code is not null and loc_site_name is not null"
_OVERDUE = "count(*) filter (eol_bucket = 'overdue')"
_WITHIN = "count(*) filter (eol_bucket = 'within_horizon')"
_FUTURE = "count(*) filter (eol_bucket = 'future')"
_UNKNOWN = "count(*) filter (eol_bucket = 'unknown')"
twin("rep_top_sites", f"""
select loc_state, loc_site_code, loc_site_name, {_OVERDUE} as overdue_count, count(*) as total_devices,
  sum(near_term_cost_component) as near_term_cost, loc_state || '-' || loc_site_code as site_label
from rep where {_SITED} group by 1, 2, 3 order by overdue_count desc, near_term_cost desc, total_devices desc, 1, 2, 3 limit 10""")
twin("rep_state_exposure", f"""
select loc_state, sum(near_term_cost_component) as near_term_cost, {_OVERDUE} as overdue_count
from rep where loc_state is not null group by 1 order by near_term_cost desc, 1 limit 15""")
twin("rep_source_mix", f"""
select device_source, cast({_OVERDUE} as double) / count(*) as overdue, cast({_WITHIN} as double) / count(*) as within_horizon,
  cast({_FUTURE} as double) / count(*) as future, cast({_UNKNOWN} as double) / count(*) as unknown from rep group by 1""")
twin("rep_category_heat", f"""
select coalesce(modeldata_category, 'Unknown') as modeldata_category, {_OVERDUE} as overdue, {_WITHIN} as within_horizon,
  {_FUTURE} as future, {_UNKNOWN} as unknown from rep group by 1 order by overdue desc, 1 limit 12""")
twin("rep_model_hotspots", f"""
select device_model, count(*) as total_devices, {_OVERDUE} as overdue_count, sum(near_term_cost_component) as near_term_cost
from rep where device_model is not null group by 1
order by overdue_count desc, near_term_cost desc, total_devices desc, 1 limit 12""")
twin("rep_risk_scatter", f"""
select site_id, loc_site_name, loc_state, loc_site_code, count(*) as total_devices,
  round(avg(support_coverage_score), 6) as support_coverage_score, round(avg(security_risk_score), 6) as security_risk_score,
  sum(near_term_cost_component) as near_term_cost, {_OVERDUE} as overdue_count,
  cast({_OVERDUE} as double) / count(*) * 100e0 as overdue_rate,
  round(least(greatest(20e0 + sqrt(sum(near_term_cost_component)) / 20e0, 18e0), 220e0), 6) as marker_size
from rep where {_SITED} group by 1, 2, 3, 4 order by total_devices desc, near_term_cost desc, 1, 2, 3, 4 limit 500""")
_OWNERS = """
(select coalesce(loc_owner, 'Unknown') as loc_owner, count(*) as n from rep group by 1 order by n desc, 1 limit 8)"""
twin("owner_risk_box", f"""
select coalesce(r.loc_owner, 'Unknown') as loc_owner, security_risk_score, count(*) as n_devices
from rep r where coalesce(r.loc_owner, 'Unknown') in (select loc_owner from {_OWNERS}) group by 1, 2""")
twin("rep_owner_box", f"""
select loc_owner, count(*) as n_devices, q[1] as q1, q[2] as median, q[3] as q3,
  min(s) filter (s >= q[1] - 1.5e0 * (q[3] - q[1])) as whisker_low, max(s) filter (s <= q[3] + 1.5e0 * (q[3] - q[1])) as whisker_high,
  count(*) filter (s < q[1] - 1.5e0 * (q[3] - q[1]) or s > q[3] + 1.5e0 * (q[3] - q[1])) as n_outliers
from (select coalesce(loc_owner, 'Unknown') as loc_owner, security_risk_score as s from rep) r
join (select coalesce(loc_owner, 'Unknown') as loc_owner, quantile_cont(security_risk_score, [0.25, 0.5, 0.75]) as q from rep group by 1) using (loc_owner)
where loc_owner in (select loc_owner from {_OWNERS}) group by loc_owner, q""")
twin("rep_call_group", f"""
select loc_call_group, {_OVERDUE} as overdue_count, {_WITHIN} as within_count, count(*) as total_devices
from rep where loc_call_group is not null group by 1 order by overdue_count desc, within_count desc, total_devices desc, 1 limit 12""")
twin("rep_unknown_state", f"""
select loc_state, count(*) as total_devices, {_UNKNOWN} as unknown_count, cast({_UNKNOWN} as double) / count(*) * 100e0 as unknown_rate
from rep where loc_state is not null group by 1 order by unknown_count desc, 1 limit 15""")
twin("rep_cost_bucket", """
select position, b.eol_bucket, coalesce(sum(replacement_cost_estimate), 0e0) as replacement_cost,
  coalesce(sum(labor_cost_estimate), 0e0) as labor_cost
from bucket_names b left join rep r on r.eol_bucket = b.eol_bucket group by 1, 2""")
twin("site_priority_matrix", f"""
select site_id, loc_site_name, {_OVERDUE} as overdue_count, {_WITHIN} as within_count, {_UNKNOWN} as unknown_count,
  sum(near_term_cost_component) as near_term_cost, round(avg(security_risk_score), 6) as security_risk_score,
  {_OVERDUE} + {_WITHIN} as action_backlog,
  round(least(greatest(30e0 + sqrt({_UNKNOWN} + 1) * 12e0, 24e0), 220e0), 6) as marker_size
from rep where {_SITED} group by 1, 2 order by action_backlog desc, near_term_cost desc, 1, 2 limit 250""")

# --- model data --------------------------------------------------------------

FEATURES = [
    "state_code", "site_code", "loc_state", "loc_site_code", "loc_city", "loc_county", "loc_call_group", "loc_owner",
    "device_model", "device_type", "device_status", "software_version", "modeldata_model", "modeldata_model_parent",
    "modeldata_category", "modeldata_repl_device", "modeldata_eos", "modeldata_stg_config_y_n", "device_role",
    "free_ports", "total_ports", "ports_in_use",
]
_NUMBERS = ("free_ports", "total_ports", "ports_in_use")
twin("ml_target", "select device_name, target, coalesce(device_model, 'UNKNOWN_MODEL') as model_group, "
     + ", ".join(f"try_cast({c} as double) as {c}" if c in _NUMBERS else c for c in FEATURES) + " from learn")
twin("ml_known_unknown", """
select device_name, case when modeldata_eol is null then 'unknown' else 'known' end as part from devs where loc_state is not null""")
twin("class_distribution", """
select c.t as target, count(l.device_name) as n_rows, round(cast(count(l.device_name) as double) / (select count(*) from learn), 3) as share
from (values (-1), (0), (1)) c(t) left join learn l on l.target = c.t group by 1""")
_located = "select * from devs where loc_state is not null"


def rates_twin(rows: str) -> str:
    return " union all ".join(f"select '{c}' as name, cast(count(*) filter ({c} is null) as double) / count(*) as rate from ({rows})" for c in FEATURES)


twin("missing_rates", f"""select name as "column", rate as missing_rate, rate > 0.5 as too_sparse from ({rates_twin(_located)})
order by rate desc, name limit 10""")


# Groups dealt to folds: the largest 64 one by one, the others by pieces of equal rows.
_N = ("n_0", "n_1", "n_2")
_G = f"select coalesce(device_model, 'UNKNOWN_MODEL') as model_group, count(*) as n_rows, {', '.join(f'count(*) filter (target = {c - 1}) as n_{c}' for c in range(3))} from learn group by 1"


def deal_terms(name: str, groups: str, folds: int, seed: int, share: float) -> None:
    cost = " + ".join(f"cast(x[{k + 1}] * r.{n} as double) / greatest(t.{n}, 1)" for k, n in enumerate(_N))
    more = ", ".join(f"l[i][{k + 1}] + r.{n}" for k, n in enumerate(_N))
    least = "list_position(costs, list_min(costs))"
    STEPS.update({
        f"{name}_sums": f"select {', '.join(f'coalesce(sum({n}), 0)::bigint as {n}' for n in _N)}, sum(n_rows)::bigint as n_rows from ({groups})",
        f"{name}_line": f"""
select *, md5('{seed}:' || model_group) as noise, row_number() over (order by n_rows desc, md5('{seed}:' || model_group), model_group) as place
from ({groups})""",
        f"{name}_heavy": f"""
select 0::bigint as place, 0::bigint as fold, list_transform(range(0, {folds}), lambda i: [0::bigint, 0::bigint, 0::bigint]) as l
union all
select place, best - 1, list_transform(range(1, {folds} + 1), lambda i: case when i = best then [{more.replace('r.', '')}] else l[i] end)
from (select *, {least} as best from (
  select r.place, h.l, {', '.join(f'r.{n}' for n in _N)}, list_transform(h.l, lambda x: {cost}) as costs
  from {name}_heavy h join {name}_line r on r.place = h.place + 1 and r.place <= 64 cross join {name}_sums t))""",
        f"{name}_tail": f"""
select *, sum(n_rows) over (partition by main order by noise || model_group rows unbounded preceding) - n_rows as ahead,
  sum(n_rows) over (partition by main) as main_rows
from (select *, case when n_0 = greatest(n_0, n_1, n_2) then 0 when n_1 = greatest(n_0, n_1, n_2) then 1 else 2 end as main
  from {name}_line where place > 64)""",
        f"{name}_dealt": f"""
select model_group, n_rows, n_0, n_1, n_2, cast(h.fold as int) as fold from {name}_line r join {name}_heavy h using (place)
union all
select model_group, n_rows, n_0, n_1, n_2, cast(least(ahead * {folds} // main_rows, {folds - 1}) as int) from {name}_tail""",
        f"{name}_folds": f"""
select *, missing_classes * 10e0 + (0e0 + {' + '.join(f'abs(cast({n} as double) / n_rows - cast(all_{n} as double) / all_rows)' for n in _N)})
  + abs(cast(n_rows as double) / all_rows - {share}) as score
from (select f.*, {', '.join(f't.{n} as all_{n}' for n in _N)}, t.n_rows as all_rows, {' + '.join(f'cast(f.{n} = 0 as int)' for n in _N)} as missing_classes
  from (select fold, {', '.join(f'sum({n})::bigint as {n}' for n in ('n_rows', *_N))} from {name}_dealt group by fold) f cross join {name}_sums t)""",
        f"{name}_best": f"select fold from {name}_folds order by score, fold limit 1",
    })


STEPS["all_groups"] = _G
deal_terms("first", "select * from all_groups", 5, 42, 0.2)
STEPS["other_groups"] = "select model_group, n_rows, n_0, n_1, n_2 from first_dealt where fold <> (select fold from first_best)"
deal_terms("second", "select * from other_groups", 4, 43, 0.25)
STEPS["group_splits"] = """
select model_group, 'test' as split from first_dealt where fold = (select fold from first_best)
union all
select model_group, case when fold = (select fold from second_best) then 'val' else 'train' end from second_dealt"""
STEPS["split_rows"] = "select l.*, g.split from learn l join group_splits g on g.model_group = coalesce(l.device_model, 'UNKNOWN_MODEL')"
STEPS["train_rows"] = "select * from split_rows where split = 'train'"
twin("usable_features", f"""select name as "column", rate as missing_rate, coalesce(rate <= 0.5, false) as used
from ({rates_twin("select * from train_rows")})""")
twin("ml_folds", "select * from first_dealt")
twin("ml_best_fold", """
select fold, n_rows, n_0, n_1, n_2, missing_classes, round(score, 6) as score, fold = (select fold from first_best) as is_best from first_folds""")
twin("split_stats", f"""
select split, count(*) as n_rows, count(distinct device_model) as n_models, {', '.join(f'count(*) filter (target = {c - 1}) as n_{c}' for c in range(3))}
from split_rows group by 1""")
twin("split_distribution", """
select s.s as split, c.t as target, count(l.device_name) as n_rows,
  round(cast(count(l.device_name) as double) / nullif((select count(*) from split_rows where split = s.s), 0), 3) as share
from (values ('train'), ('val'), ('test')) s(s) cross join (values (-1), (0), (1)) c(t)
left join split_rows l on l.split = s.s and l.target = c.t group by 1, 2""")
_MODE = "(select {0} from train_rows where {0} is not null group by {0} order by count(*) desc, {0} limit 1)"
_MEDIAN = "(select quantile_cont(try_cast({0} as double), 0.5) from train_rows)"
_TEXTS = [c for c in FEATURES if c not in _NUMBERS]
twin("ml_impute", "select * from (" + " union all ".join(
    f"""select '{c}' as "column", {_MODE.format(c)} as text_value, cast(null as double) as number_value""" for c in _TEXTS)
    + " union all " + " union all ".join(f"select '{c}', cast(null as varchar), {_MEDIAN.format(c)}" for c in _NUMBERS)
    + ") where text_value is not null or number_value is not null")
# Slots: numbers first, then the values of each text column that is not mostly missing, in order.
STEPS["rates"] = rates_twin("select * from train_rows")
STEPS["numeric_slots"] = "select name, row_number() over (order by p) - 1 as slot from (" + " union all ".join(
    f"select '{c}' as name, {p} as p where (select rate from rates where name = '{c}') <= 0.5" for p, c in enumerate(FEATURES) if c in _NUMBERS) + ")"
STEPS["dictionary"] = """
select name, value, row_number() over (order by p, value) - 1 + (select count(*) from numeric_slots) as slot from (""" + " union all ".join(
    f"select distinct '{c}' as name, {p} as p, {c} as value from train_rows where {c} is not null and (select rate from rates where name = '{c}') <= 0.5"
    for p, c in enumerate(FEATURES) if c not in _NUMBERS) + ")"
twin("ml_dictionary", 'select name as "column", value, slot from dictionary')
STEPS["slots_used"] = " union all ".join(
    [f"select device_name, slot from split_rows join dictionary d on d.name = '{c}' and d.value = coalesce({c}, {_MODE.format(c)})" for c in _TEXTS]
    + [f"select device_name, slot from split_rows join numeric_slots d on d.name = '{c}' where coalesce(try_cast({c} as double), {_MEDIAN.format(c)}) <> 0" for c in _NUMBERS])
twin("ml_features", """
select device_name, target, split, cast((select count(*) from numeric_slots) + (select count(*) from dictionary) as int) as n_slots,
  cast(count(slot) as int) as n_active, coalesce(sum(slot), 0)::bigint as slot_sum
from split_rows left join slots_used using (device_name) group by 1, 2, 3""")

# --- evaluation --------------------------------------------------------------

twin("weighted_decision", """
select doc_id, case when a >= b and a >= c then -1 when b >= c then 0 else 1 end as predicted_behavior_class,
  greatest(a, b, c) as prediction_confidence
from (select doc_id, p_passed * 2e0 as a, p_beyond * 1e0 as b, p_within * 1.5e0 as c from scored)""")
_F1 = """case when {0}_s + {0}_k > 0 then cast(2 * {0}_t as double) / ({0}_s + {0}_k) else 0e0 end"""
twin("weight_grid", f"""
select position, weight_passed, weight_within, macro_f1,
  row_number() over (order by macro_f1 desc, position) = 1 as is_best
from (
  select position, weight_passed, weight_within,
    ({_F1.format('a')} + {_F1.format('b')} + {_F1.format('c')})
      / (cast(a_s + a_k > 0 as int) + cast(b_s + b_k > 0 as int) + cast(c_s + c_k > 0 as int)) as macro_f1
  from (
    select position, weight_passed, weight_within,
      count(*) filter (actual = -1) as a_s, count(*) filter (chosen = -1) as a_k, count(*) filter (actual = -1 and chosen = -1) as a_t,
      count(*) filter (actual = 0) as b_s, count(*) filter (chosen = 0) as b_k, count(*) filter (actual = 0 and chosen = 0) as b_t,
      count(*) filter (actual = 1) as c_s, count(*) filter (chosen = 1) as c_k, count(*) filter (actual = 1 and chosen = 1) as c_t
    from (
      select *, case when p_passed * weight_passed >= p_beyond and p_passed * weight_passed >= p_within * weight_within then -1
          when p_beyond >= p_within * weight_within then 0 else 1 end as chosen
      from scored cross join (
        select (i * 4 + j)::int as position, wn as weight_passed, wp as weight_within
        from (select unnest(range(0, 6)) as i, unnest([1e0, 1.5e0, 2e0, 3e0, 4e0, 5e0]) as wn)
        cross join (select unnest(range(0, 4)) as j, unnest([1e0, 1.5e0, 2e0, 3e0]) as wp)))
    group by 1, 2, 3))""")
twin("confusion_matrix", "select actual, predicted, n as value from confusion")
twin("class_report", "select name, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from ("
     + """
select cast(class_id as varchar) as name, p as precision, r as recall, f as f1, support from per_score
union all
select 'accuracy', a, a, a, n from (select cast(sum(tp) as double) / cast(sum(support) as double) as a, cast(sum(support) as bigint) as n from per_score)
union all
select 'macro avg', avg(p), avg(r), avg(f), cast(sum(support) as bigint) from per_score
union all
select 'weighted avg', sum(p * support) / cast(sum(support) as double), sum(r * support) / cast(sum(support) as double),
  sum(f * support) / cast(sum(support) as double), cast(sum(support) as bigint) from per_score)""")
_AUC = """
select class_id, sum(pos * (all_neg - fp + neg / 2e0)) / (cast(max(all_pos) as double) * cast(max(all_neg) as double)) as auc
from running group by 1"""
twin("macro_auc", f"""
select round(avg(auc), 6) as macro_auc, round(max(auc) filter (class_id = -1), 6) as auc_0,
  round(max(auc) filter (class_id = 0), 6) as auc_1, round(max(auc) filter (class_id = 1), 6) as auc_2 from ({_AUC})""")
twin("roc_curves", "select class_id, round(fpr, 6) as fpr, round(tpr, 6) as tpr from corners")
_MACRO = """
select fpr, avg(coalesce(high, before_high + (after_low - before_high) / (after_x - before_x) * (fpr - before_x))) as macro_tpr
from (
  select g.fpr, c.class_id, s.high,
    last_value(case when s.high is not null then g.fpr end ignore nulls) over w_before as before_x,
    last_value(s.high ignore nulls) over w_before as before_high,
    first_value(case when s.high is not null then g.fpr end ignore nulls) over w_after as after_x,
    first_value(s.low ignore nulls) over w_after as after_low
  from (select distinct fpr from steps_at) g cross join (select unnest([-1, 0, 1]) as class_id) c
  left join steps_at s on s.fpr = g.fpr and s.class_id = c.class_id
  window w_before as (partition by c.class_id order by g.fpr rows between unbounded preceding and 1 preceding),
    w_after as (partition by c.class_id order by g.fpr rows between 1 following and unbounded following))
group by fpr"""
twin("roc_points", f"select round(fpr, 6) as fpr, round(macro_tpr, 6) as macro_tpr from ({_MACRO})")
twin("model_evaluation", f"""
select 'confusion' as part, actual || '/' || predicted as name, cast(n as double) as value from confusion
union all select 'report', name || '/' || m, round(v, 6) from (
  unpivot (select cast(class_id as varchar) as name, p as precision, r as recall, f as f1, cast(support as double) as support from per_score
    union all select 'accuracy', a, a, a, n from (select cast(sum(tp) as double) / cast(sum(support) as double) as a, cast(sum(support) as double) as n from per_score)
    union all select 'macro avg', avg(p), avg(r), avg(f), cast(sum(support) as double) from per_score
    union all select 'weighted avg', sum(p * support) / cast(sum(support) as double), sum(r * support) / cast(sum(support) as double),
      sum(f * support) / cast(sum(support) as double), cast(sum(support) as double) from per_score)
  on precision, recall, f1, support into name m value v)
union all select 'auc', 'auc_' || (class_id + 1), round(auc, 6) from ({_AUC})
union all select 'auc', 'macro_auc', round(avg(auc), 6) from ({_AUC})
union all select 'roc_corners', cast(class_id as varchar), cast(count(*) as double) from corners group by 2
union all select 'macro_roc', 'mean_tpr', round(avg(macro_tpr), 6) from ({_MACRO})""")
_HOT = "list_transform(range(0, 64), lambda i: cast(cast(i = label as int) as double))"
twin("eval_loss", f"""
select loss, round(avg(v), 6) as value, count(v) as n_rows from (
  select 'cross_entropy_loss' as loss, list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) - x[label + 1] as v from logits
  union all
  select 'bce_with_logits_loss', list_avg(list_transform(list_zip(x, {_HOT}), lambda p: greatest(p[1], 0e0) - p[1] * p[2] + ln(1 + exp(-abs(p[1]))))) from logits
  union all
  select 'mse_loss', list_avg(list_transform(list_zip(x, {_HOT}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) from logits)
group by 1""")
twin("softmax_scores", """
select vec_id, (i - 1)::int as class_id, round(exp(x[i] - list_max(x)) / list_sum(list_transform(x, lambda v: exp(v - list_max(x)))), 6) as softmax,
  round(1 / (1 + exp(-x[i])), 6) as sigmoid
from logits cross join (select unnest(range(1, 65)) as i)""")
