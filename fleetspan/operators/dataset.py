"""From tabs to one row per device, joined with location, model and price."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_segment, normalize_key, require_columns, strip, to_double
from ..sources.tabs import ROW_INDEX, Tabs, check_dataset_tabs
from .filters import apply_filters
from .sizing import Dimension, join_dimension, settle


@dataclass(frozen=True)
class Source:
    """How one inventory tab maps to device columns, and how it ranks among the sources."""

    name: str
    id_column: str
    model_column: str
    priority: int
    tiebreak: int
    extras: dict[str, str]


# Column mapping and rank of the four inventories.
SOURCES = (
    Source(
        "CatCtr", "hostname", "platformid", 1, 1,
        {
            "dnsresolvedmanagementaddress": "device_ip",
            "family": "device_family_raw",
            "platformid": "source_platform_id",
            "reachabilitystatus": "device_reachability",
            "serialnumber": "serial_number",
            "softwareversion": "software_version",
            "type": "device_type_raw",
            "vendor": "device_vendor",
            "associatedwlcip": "associated_wlc_ip",
            "managementstate": "management_state",
            "role": "device_role",
        },
    ),
    Source(
        "PrimeAP", "name", "model", 2, 2,
        {
            "ipaddress": "device_ip",
            "status": "device_status",
            "serialnumber": "serial_number",
            "softwareversion": "software_version",
            "type": "device_type_raw",
            "controlleripaddress": "associated_wlc_ip",
            "controllername": "controller_name",
            "uptime": "uptime",
            "countrycode": "country_code",
        },
    ),
    Source(
        "PrimeWLC", "devicename", "manufacturer_part_partnumber", 2, 3,
        {
            "ipaddress": "device_ip",
            "reachability": "device_reachability",
            "manufacturer_part_serialnumber": "serial_number",
            "softwareversion": "software_version",
            "softwaretype": "software_type",
            "devicetype": "device_type_raw",
            "productfamily": "device_family_raw",
            "adminstatus": "device_status",
            "location": "source_location",
        },
    ),
    Source(
        "NA", "host_name", "device_model", 3, 4,
        {
            "device_ip": "device_ip",
            "device_type": "device_type_raw",
            "device_status": "device_status",
            "device_vendor": "device_vendor",
            "serial_number": "serial_number",
            "software_version": "software_version",
            "firmware_version": "firmware_version",
            "uptime": "uptime",
            "free_ports": "free_ports",
            "total_ports": "total_ports",
            "ports_in_use": "ports_in_use",
        },
    ),
)
UNKNOWN_RANK = 999

# Device types, and the text patterns that imply one. When several
# patterns match, the one listed last decides.
FAMILY_TYPES = {
    "AP": "AP",
    "ROUTER": "Router",
    "SWITCH": "Switch",
    "WIRELESS CONTROLLER": "Wireless Controller",
    "VOICE GATEWAY": "Voice Gateway",
}
TYPE_PATTERNS = (
    ("Voice Gateway", r"VOICE\s*GATEWAY"),
    ("Wireless Controller", r"WIRELESS\s*CONTROLLER|\bWLC\b"),
    ("AP", r"ACCESS\s*POINT|UNIFIED\s*ACCESS\s*POINT|\bAP\b"),
    ("Router", r"ROUTER|INTEGRATED\s*SERVICES|EDGE\s*PLATFORM|\bASR\b"),
    ("Switch", r"SWITCH|HUB"),
)

# Order of the dataset's columns; others follow.
COLUMN_ORDER = (
    "device_name", "device_source", "source_device_id", "state_code", "site_code", "location_matched",
    "loc_state", "loc_site_code", "loc_site_name", "loc_address_1", "loc_address_2", "loc_city", "loc_zip",
    "loc_county", "loc_call_group", "loc_owner", "loc_latitude", "loc_longitude",
    "device_model_raw", "device_model", "device_type", "device_status", "device_reachability", "device_vendor",
    "device_ip", "serial_number", "software_version", "firmware_version", "uptime", "controller_name",
    "associated_wlc_ip", "source_platform_id",
    "modeldata_model", "modeldata_model_parent", "modeldata_category", "modeldata_in_scope",
    "modeldata_repl_device", "modeldata_eos", "modeldata_eol", "modeldata_dna_y_n", "modeldata_dna_part_number",
    "modeldata_stg_config_y_n", "modeldata_de_hrs", "modeldata_se_hrs", "modeldata_fot_hrs", "modeldata_pm_hrs",
    "modeldata_de_cost", "modeldata_se_cost", "modeldata_fot_cost", "modeldata_labor_cost",
    "modeldata_device_cost", "modeldata_dna_cost", "modeldata_staging_cost", "modeldata_tax_oh",
    "modeldata_material_cost",
    "repl_device_key", "replacement_device_sku", "replacement_device_cost", "replacement_labor_de_hours",
    "replacement_labor_se_hours", "replacement_labor_fo_hours", "pricing_component_count",
    "pricing_total_estimate",
)
# Columns that only build the dataset, that are nearly empty, and that are not analysed.
HELPERS = (
    "source_priority", "source_tiebreak", ROW_INDEX, "model_key", "parent_product_key", "device_type_raw",
    "device_family_raw",
)
SPARSE = (
    "modeldata_pm_hrs", "software_type", "source_location", "country_code", "controller_name", "loc_address_2",
)
NOT_ANALYSED = (
    "device_model_raw", "firmware_version", "associated_wlc_ip", "source_platform_id", "management_state",
)


# --- devices -----------------------------------------------------------------


def source_frame(source: Source, tab: DataFrame) -> DataFrame:
    """One inventory in device columns; rows without a name are left out.

    The name is empty instead of null until the filter. Being never null, it
    spares the plan null checks, each of which would compute the name again.
    """
    name = F.coalesce(F.substring_index(F.upper(strip(source.id_column)), ".", 1), F.lit(""))
    raw_model = normalize_key(source.model_column)
    return tab.select(
        F.lit(source.name).alias("device_source"),
        F.col(source.id_column).alias("source_device_id"),
        name.alias("device_name"),
        raw_model.alias("device_model_raw"),
        first_segment(raw_model).alias("device_model"),
        F.col(ROW_INDEX),
        *[F.col(old).alias(new) for old, new in source.extras.items() if old in tab.columns],
    ).filter(F.col("device_name") != "")


def device_union(tabs: Tabs) -> DataFrame:
    """All inventories under each other; a column an inventory lacks is null."""
    frames = [source_frame(s, tabs[s.name]) for s in SOURCES]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def type_from_text(text: Column) -> Column:
    """Device type that a normalised type text implies."""
    out = F.lit(None).cast("string")
    for name, pattern in TYPE_PATTERNS:
        out = F.when(text.rlike("(?U)" + pattern), name).otherwise(out)
    return out


def type_from_family(family: Column) -> Column:
    """Device type of a normalised family, if it names one."""
    out = F.lit(None).cast("string")
    for raw, name in FAMILY_TYPES.items():
        out = F.when(family == raw, name).otherwise(out)
    return out


def with_device_type(devices: DataFrame) -> DataFrame:
    source = F.col("device_source")
    family, by_text = type_from_family(F.col("_family")), type_from_text(F.col("_text"))
    # The texts are normalised once, in a projection of their own.
    return (
        devices.withColumns(
            {"_family": normalize_key("device_family_raw"), "_text": normalize_key("device_type_raw")}
        )
        .withColumn(
            "device_type",
            F.when(source == "PrimeAP", "AP")
            .when(source == "PrimeWLC", "Wireless Controller")
            .when(source == "CatCtr", F.coalesce(family, by_text))
            .when(source == "NA", by_text),
        )
        .drop("_family", "_text")
    )


def _rank(attribute: str) -> Column:
    out = F.lit(UNKNOWN_RANK)
    for s in SOURCES:
        out = F.when(F.col("device_source") == s.name, getattr(s, attribute)).otherwise(out)
    return out


def best_source_rows(devices: DataFrame) -> DataFrame:
    """One row per device name: best source first, then position in its tab.

    Model and version close the order, so the result does not depend on how the
    rows are laid out. Spark keeps only the first row of a name per map task
    before the shuffle, so a name with many copies stays cheap.
    """
    order = Window.partitionBy("device_name").orderBy(
        "source_priority",
        "source_tiebreak",
        F.asc_nulls_last(ROW_INDEX),
        F.asc_nulls_last("device_model_raw"),
        F.asc_nulls_last("software_version"),
    )
    return (
        devices.withColumns({"source_priority": _rank("priority"), "source_tiebreak": _rank("tiebreak")})
        .withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") == 1)
        .drop("_place")
    )


def with_codes(devices: DataFrame) -> DataFrame:
    """State from characters 1-2 and site from characters 3-5 of the name."""
    return devices.withColumns(
        {"state_code": F.substring("device_name", 1, 2), "site_code": F.substring("device_name", 3, 3)}
    )


# --- dimensions --------------------------------------------------------------


def location_dim(solid: DataFrame, solid_loc: DataFrame) -> DataFrame:
    """Sites with coordinates; a missing site name is taken from the coordinate list."""
    left = solid.select(
        normalize_key("site_code").alias("loc_site_code"),
        normalize_key("state").alias("loc_state"),
        F.col("site_name").alias("_name"),
        F.col("street_address_1").alias("loc_address_1"),
        F.col("street_address_2").alias("loc_address_2"),
        F.col("city").alias("loc_city"),
        F.col("zip").alias("loc_zip"),
    )
    right = solid_loc.select(
        normalize_key("site_code").alias("_code"),
        F.col("site_name").alias("_other_name"),
        to_double("latitude").alias("loc_latitude"),
        to_double("longitude").alias("loc_longitude"),
        F.col("physicaladdresscounty").alias("loc_county"),
        F.col("call_group").alias("loc_call_group"),
        F.col("owner").alias("loc_owner"),
    )
    joined = left.join(right, F.col("loc_site_code").eqNullSafe(F.col("_code")), "left")
    return joined.select(
        "loc_site_code", "loc_state", F.coalesce("_name", "_other_name").alias("loc_site_name"), "loc_address_1",
        "loc_address_2", "loc_city", "loc_zip", "loc_latitude", "loc_longitude", "loc_county", "loc_call_group",
        "loc_owner",
    )


def model_dim(modeldata: DataFrame) -> DataFrame:
    """Model data: links dropped, columns prefixed, cost and hour columns as numbers."""
    kept = [c for c in modeldata.columns if "url" not in c.lower()]

    def typed(name: str) -> Column:
        value = to_double(name) if name.endswith(("_cost", "_hrs")) else F.col(name)
        return value.alias(f"modeldata_{name}")

    return modeldata.select(
        *[typed(c) for c in kept],
        normalize_key("model").alias("model_key"),
        normalize_key("repl_device").alias("repl_device_key"),
    )


def pricing_rows(pricing: DataFrame) -> DataFrame:
    return pricing.select(
        normalize_key("parent_product").alias("parent_product_key"),
        normalize_key("product").alias("product_key"),
        normalize_key("device").alias("device_flag"),
        to_double("pricing").alias("pricing_amount"),
        to_double("labor_de").alias("labor_de_hours"),
        to_double("labor_se").alias("labor_se_hours"),
        to_double("labor_fo").alias("labor_fo_hours"),
    )


def pricing_rollup(pricing: DataFrame) -> DataFrame:
    """Components and price per parent; a parent without any amount totals 0, not null."""
    return (
        pricing_rows(pricing)
        .filter(F.col("parent_product_key").isNotNull())
        .groupBy("parent_product_key")
        .agg(
            F.count("product_key").alias("pricing_component_count"),
            F.coalesce(F.sum("pricing_amount"), F.lit(0.0)).alias("pricing_total_estimate"),
        )
    )


def pricing_dim(pricing: DataFrame) -> DataFrame:
    """Price per parent, once for each of its device rows."""
    skus = (
        pricing_rows(pricing)
        .filter(F.col("device_flag") == "Y")
        .select(
            "parent_product_key",
            F.col("product_key").alias("replacement_device_sku"),
            F.col("pricing_amount").alias("replacement_device_cost"),
            F.col("labor_de_hours").alias("replacement_labor_de_hours"),
            F.col("labor_se_hours").alias("replacement_labor_se_hours"),
            F.col("labor_fo_hours").alias("replacement_labor_fo_hours"),
        )
    )
    return pricing_rollup(pricing).join(skus, "parent_product_key", "left")


def unique_rows(dim: DataFrame, key: list[str]) -> DataFrame:
    """Guard for callers who want no fan-out: the lowest row per key."""
    order = Window.partitionBy(*key).orderBy(*[F.asc_nulls_last(c) for c in dim.columns if c not in key])
    return dim.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") == 1).drop("_place")


@dataclass(frozen=True)
class Dimensions:
    """The three written dimensions of a build; several datasets and reports may share them."""

    location: Dimension
    model: Dimension
    pricing: Dimension


def dimensions(tabs: Tabs, unique: bool = False) -> Dimensions:
    """Dimensions from filtered tabs.

    Duplicate keys multiply devices (see ``join_fanout``) unless ``unique`` is set.
    """
    check_dataset_tabs(tabs)
    location = location_dim(tabs["SOLID"], tabs["SOLID-Loc"])
    model = model_dim(tabs["ModelData"])
    pricing = pricing_dim(tabs["Pricing"])
    if unique:
        location = unique_rows(location, ["loc_state", "loc_site_code"])
        model = unique_rows(model, ["model_key"])
        pricing = unique_rows(pricing, ["parent_product_key"])
    return Dimensions(*settle(location, model, pricing))


# --- joins -------------------------------------------------------------------


def join_location(devices: DataFrame, location: Dimension) -> DataFrame:
    on = [("state_code", "loc_state"), ("site_code", "loc_site_code")]
    joined = join_dimension(devices, location, on, spread_by="device_name")
    return joined.withColumn("location_matched", F.col("loc_site_name").isNotNull())


def join_model(devices: DataFrame, model: Dimension) -> DataFrame:
    """Null-safe: devices without a model meet model rows without a name."""
    return join_dimension(devices, model, [("device_model", "model_key")], spread_by="device_name", null_safe=True)


def join_pricing(devices: DataFrame, pricing: Dimension) -> DataFrame:
    return join_dimension(devices, pricing, [("repl_device_key", "parent_product_key")], spread_by="device_name")


def deduplicated(tabs: Tabs) -> DataFrame:
    """Typed devices, one row per name, with state and site codes."""
    return with_codes(best_source_rows(with_device_type(device_union(tabs))))


def device_dataset(tabs: Tabs, dims: Dimensions | None = None) -> DataFrame:
    """The device dataset from filtered tabs; ``dims`` reuses dimensions built before."""
    check_dataset_tabs(tabs)
    dims = dims or dimensions(tabs)
    # Locations last: sites that share a code multiply the devices, and the copies must not be shuffled for the models.
    priced = join_pricing(join_model(deduplicated(tabs), dims.model), dims.pricing)
    return ordered(join_location(priced, dims.location).drop(*HELPERS))


def devices_from_tabs(tabs: Tabs, dims: Dimensions | None = None) -> DataFrame:
    """Filter the tabs and build the dataset, without the redundant anti-joins."""
    return device_dataset(apply_filters(tabs, cross_source=False), dims)


def ordered(df: DataFrame) -> DataFrame:
    first = [c for c in COLUMN_ORDER if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in set(first)])


def clean_devices(df: DataFrame) -> DataFrame:
    """Drop sparse and unused columns; they must all be there."""
    require_columns(df, [*SPARSE, *NOT_ANALYSED], "device dataset")
    return df.drop(*SPARSE, *NOT_ANALYSED)


# --- audits ------------------------------------------------------------------


def reconciliation(devices: DataFrame) -> DataFrame:
    """Rows, rows with a full location, and the difference."""
    mapped = (
        F.col("loc_state").isNotNull()
        & F.col("loc_site_code").isNotNull()
        & F.col("loc_latitude").isNotNull()
        & F.col("loc_longitude").isNotNull()
    )
    return devices.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(mapped).alias("mapped_rows"),
        F.count_if(~mapped).alias("excluded_rows"),
    )


def join_fanout(tabs: Tabs, dims: Dimensions | None = None) -> DataFrame:
    """Rows after each join step, from filtered tabs.

    Nothing is fanned out to be counted: the dimensions are reduced to matches
    per key, and one pass over the devices sums the products.
    """
    dims = dims or dimensions(tabs)
    one, zero = F.lit(1).cast("bigint"), F.lit(0)
    sites = dims.location.table.groupBy("loc_state", "loc_site_code").agg(F.count(F.lit(1)).alias("n_site"))
    prices = dims.pricing.table.groupBy("parent_product_key").agg(F.count(F.lit(1)).alias("n_price"))
    models = (
        dims.model.table.join(prices, F.col("repl_device_key") == F.col("parent_product_key"), "left")
        .groupBy("model_key")
        .agg(F.count(F.lit(1)).alias("n_model"), F.sum(F.coalesce("n_price", one)).alias("n_model_price"))
    )
    devices = deduplicated(tabs).select("device_name", "state_code", "site_code", "device_model")
    on_site = [("state_code", "loc_state"), ("site_code", "loc_site_code")]
    n_site, n_model = settle(sites, models)
    devices = join_dimension(devices, n_site, on_site, "device_name")
    devices = join_dimension(devices, n_model, [("device_model", "model_key")], "device_name", null_safe=True)
    site = F.coalesce("n_site", one)
    steps = {
        "1_devices": F.count(F.lit(1)),
        "2_location": F.coalesce(F.sum(site), zero),
        "3_model": F.coalesce(F.sum(site * F.coalesce("n_model", one)), zero),
        "4_pricing": F.coalesce(F.sum(site * F.coalesce("n_model_price", one)), zero),
    }
    rows = [F.struct(F.lit(name).alias("step"), n.alias("n_rows")) for name, n in steps.items()]
    return devices.agg(F.array(*rows).alias("steps")).select(F.inline("steps"))
