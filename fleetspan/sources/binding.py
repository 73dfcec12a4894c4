"""The test tables seen as fleet tabs.

A device is a line item (site = supplier, model = part). All line items are
spread over the four inventory tabs by line number. The texts parse unchanged
in Spark SQL and in DuckDB, so that the SQL twins read the same tabs.

``{name}`` stands for a table or an earlier view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tabs import TAB_ORDER, Tabs, conform

AS_OF = "1999-06-01"
HORIZON = 365

# The columns read from each table; naming them spares a look into the files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_tax double, l_returnflag string, l_linestatus string",
    "documents": "doc_id bigint, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
}
TABLES = tuple(SCHEMAS)

_STATE = "translate(lpad(cast(s_nationkey as string), 2, '0'), '0123456789', 'ABCDEFGHIJ')"


def _place(divisor: int, alphabets: int) -> str:
    """One character of a site code: a decimal digit of the supplier, in one of three alphabets by its thousands."""
    digit = f"cast(floor(s_suppkey / {divisor}) as bigint) % 10"
    alphabet = f"cast(floor(s_suppkey / {1000 * alphabets}) as bigint) % 3"
    return f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123', cast({digit} + 10 * ({alphabet}) + 1 as int), 1)"


# Three characters that differ for 27,000 suppliers; beyond that, sites share codes and devices multiply.
_SITE = f"concat({_place(100, 9)}, {_place(10, 3)}, {_place(1, 1)})"

VIEWS = {
    # Device names and row positions. Rows with one name and one position are equal in
    # every column, so that the position settles the order of a name's rows.
    "dev_raw": f"""
select l_linenumber % 4 as src_no,
  concat({_STATE}, {_SITE}, '-', cast(l_orderkey as string)) as nm,
  (((l_partkey * 10 + l_linenumber) * 100 + cast(l_quantity as bigint)) * 100 + cast(round(l_tax * 100) as bigint)) * 10
    + case l_returnflag when 'A' then 0 when 'N' then 2 else 4 end
    + case l_linestatus when 'F' then 0 else 1 end as source_row_index,
  l_partkey, cast(l_quantity as int) as qty, l_returnflag, l_linestatus, cast(round(l_tax * 100) as int) as tax
from {{lineitem}} join {{supplier}} on l_suppkey = s_suppkey""",
    # Sites, one per supplier: lower-case code, some names missing.
    "solid": f"""
select lower({_SITE}) as site_code, {_STATE} as state,
  case when s_suppkey % 7 = 3 then null else concat('Supplier#', lpad(cast(s_suppkey as string), 9, '0')) end as site_name,
  concat(cast(s_suppkey as string), ' MAIN ST') as street_address_1, cast(null as string) as street_address_2,
  n_name as city, lpad(cast(s_suppkey as string), 5, '0') as zip
from {{supplier}} join {{nation}} on s_nationkey = n_nationkey""",
    # Site coordinates: some codes mistyped (they meet no site), bad latitude text, some owners missing.
    "solid_loc": f"""
select case when s_suppkey % 11 = 10 then concat('-', substr({_SITE}, 2, 2)) else {_SITE} end as site_code,
  concat('Supplier#', lpad(cast(s_suppkey as string), 9, '0'), ' LOC') as site_name,
  case when s_suppkey % 10 = 9 then 'unknown' else cast(25 + s_suppkey % 24 as string) end as latitude,
  cast(-70 - s_suppkey % 50 as string) as longitude, n_name as physicaladdresscounty,
  r_name as call_group, case when s_suppkey % 5 = 0 then null else concat('OWNER', cast(s_suppkey % 9 as string)) end as owner
from {{supplier}} join {{nation}} on s_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey""",
    # Sites that are closed.
    "decom": f"""
select lower({_SITE}) as site_cd from {{supplier}} where s_suppkey % 13 = 12""",
    # Inventory 1: half of the hosts carry a blank, lower case and a domain.
    "catctr": """
select case when qty = 50 then null
    when l_partkey % 2 = 0 then concat(nm, '.corp.example') else concat(' ', lower(nm), '.corp.example') end as hostname,
  concat('p', cast(l_partkey as string), ', extra') as platformid,
  case when l_returnflag = 'R' then 'Unreachable' when l_returnflag = 'A' then 'Reachable'
    when l_linestatus = 'O' then 'Ping Reachable' else null end as reachabilitystatus,
  case l_partkey % 6 when 0 then 'Unified AP' when 1 then 'Routers' when 2 then 'Switches and Hubs'
    when 3 then 'Wireless Controller' when 4 then 'Other' else null end as family,
  case l_partkey % 4 when 0 then 'Cisco Integrated Services Router' when 1 then 'Catalyst Switch'
    when 2 then 'Unified AP' else 'Voice Gateway' end as type,
  concat('SN', cast(l_partkey as string)) as serialnumber,
  case when tax = 0 then null else concat('17.', cast(tax as string)) end as softwareversion,
  'Cisco' as vendor, 'Managed' as managementstate, 'ACCESS' as role, source_row_index
from {dev_raw} where src_no = 1""",
    "primeap": """
select nm as name, concat('P', cast(l_partkey as string)) as model, 'CLEARED' as status,
  concat('SN', cast(l_partkey as string)) as serialnumber,
  case when tax = 0 then null else concat('8.', cast(tax as string)) end as softwareversion,
  'Unified AP' as type, concat('wlc', cast(qty as string)) as controllername, 'US' as countrycode, source_row_index
from {dev_raw} where src_no = 2""",
    "primewlc": """
select nm as devicename, concat('P', cast(l_partkey as string)) as manufacturer_part_partnumber,
  'REACHABLE' as reachability,
  case when tax = 0 then null else concat('8.', cast(tax as string)) end as softwareversion, 'IOS' as softwaretype,
  'Wireless Controller' as productfamily, 'UP' as adminstatus, source_row_index
from {dev_raw} where src_no = 3""",
    "na": """
select nm as host_name, concat(' P', cast(l_partkey as string), ' ') as device_model,
  case qty % 6 when 0 then 'Firewall' when 1 then 'L3 Switch' when 2 then 'Router' when 3 then 'WirelessLC'
    when 4 then 'Voice Gateway' else null end as device_type,
  case when l_returnflag = 'R' then 'Inactive' when l_returnflag = 'A' then 'Active' else null end as device_status,
  case when tax = 0 then null else cast(tax as string) end as software_version,
  case when tax < 3 then null else cast(tax as string) end as firmware_version,
  cast(qty as string) as free_ports, source_row_index
from {dev_raw} where src_no = 0""",
    # Model lifecycle and cost: missing EoL, cost as text, a link column.
    "modeldata": """
select concat('P', cast(p_partkey as string)) as model, p_name as model_parent,
  case when p_size = 50 then 'Voice' when p_size = 49 then 'Sec/Vid' when p_size = 48 then null else p_type end as category,
  case when p_size % 10 = 0 then null else concat('R', p_brand) end as repl_device,
  case when p_size % 3 = 0 then null else make_date(cast(1998 + p_partkey % 4 as int),
    cast(1 + p_partkey % 12 as int), cast(1 + p_partkey % 28 as int)) end as eol,
  case when p_size % 8 = 0 then 'TBD' when p_size % 8 = 1 then null else cast(p_size * 100 as string) end as material_cost,
  cast(p_size * 20 as string) as labor_cost, 'http://example' as info_url
from {part}""",
    # Price components: one device row per brand; the prices of one brand stand under another name.
    "pricing": """
select case when p_brand = 'Brand#5' then 'unlisted' else concat(' r', lower(p_brand)) end as parent_product, concat('sku', cast(p_partkey as string)) as product,
  case when p_partkey in (select min(p_partkey) from {part} group by p_brand) then 'y' else 'N' end as device,
  case when p_size % 9 = 0 then 'n/a' else cast(p_size * 10 as string) end as pricing,
  '1' as labor_de, '2' as labor_se, 'x' as labor_fo
from {part}""",
    # Scored devices: one class is invalid, confidence may exceed 1.
    "predictions": """
select case p_partkey % 5 when 4 then null
    else translate(lpad(cast(p_partkey % 25 as string), 2, '0'), '0123456789', 'ABCDEFGHIJ') end as loc_state,
  p_brand as device_model, case when p_partkey % 3 = 0 then null else concat(' S', cast(p_size % 4 as string)) end as device_source,
  p_size % 4 - 1 as predicted_behavior_class,
  case when p_size = 7 then null else cast(p_size as double) / cast(40 as double) end as prediction_confidence
from {part}""",
    # Actual and predicted class with a score per class, adding up to one.
    "scored": """
select doc_id, quality * 1 + toxic * 1 - 1 as actual, cast(n_chars % 3 - 1 as int) as predicted,
  cast(n_chars % 100 + 1 as double) / cast(n_chars % 100 + n_chars % 37 + n_chars % 11 + 3 as double) as p_passed,
  cast(n_chars % 37 + 1 as double) / cast(n_chars % 100 + n_chars % 37 + n_chars % 11 + 3 as double) as p_beyond,
  cast(n_chars % 11 + 1 as double) / cast(n_chars % 100 + n_chars % 37 + n_chars % 11 + 3 as double) as p_within
from {labels} join {documents} using (doc_id)""",
}

_TAB_VIEW = {
    "SOLID": "solid", "SOLID-Loc": "solid_loc", "NA": "na", "PrimeAP": "primeap", "PrimeWLC": "primewlc",
    "CatCtr": "catctr", "Decom": "decom", "ModelData": "modeldata", "Pricing": "pricing",
}


class Binding:
    """Views over the tables of one directory; each is built once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.built = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.built:
            self.built[name] = self._build(name)
        return self.built[name]

    def _build(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")
        text = VIEWS[name]
        needed = [n for n in (*TABLES, *VIEWS) if "{" + n + "}" in text]
        return self.spark.sql(text, **{n: self[n] for n in needed})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view of the binding, or a base table."""
    return Binding(spark, sf_dir)[name]


def bind_tabs(spark: SparkSession, sf_dir: str) -> Tabs:
    """All ten tabs over the tables of one directory."""
    views, tabs = Binding(spark, sf_dir), {}
    for tab in TAB_ORDER:
        if tab == "Glossary":
            # Required by the tab contract, read by nothing.
            tabs[tab] = spark.range(0).select(F.lit(None).cast("string").alias("term"))
        else:
            tabs[tab] = conform(tab, views[_TAB_VIEW[tab]])
    return tabs
