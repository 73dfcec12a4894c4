"""Business filters on the tabs, and the audit of what they remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import not_in
from ..sources.tabs import Tabs, check_tab_set
from .sizing import absent_from, members_of, present_in, without_members

# Fixed values.
UNREACHABLE = ("Unreachable", "Ping Reachable")
INACTIVE = "Inactive"
OUT_OF_SCOPE_TYPES = ("Wireless Controller", "Firewall", "Virtual Firewall", "WirelessLC")
OUT_OF_SCOPE_CATEGORIES = ("Sec/SD-WAN", "Sec/Vid", "Voice")
FAMILY_NAMES = {"Unified AP": "AP", "Routers": "Router", "Switches and Hubs": "Switch"}


def active_sites(sites: DataFrame, decom: DataFrame) -> DataFrame:
    return absent_from(sites, "site_code", (decom, "site_cd"))


def cut_hosts(catctr: DataFrame) -> DataFrame:
    """Host up to the first dot; case and blanks stay."""
    return catctr.withColumn("hostname", F.substring_index("hostname", ".", 1))


def filter_catctr(catctr: DataFrame) -> DataFrame:
    family = F.col("family")
    for old, new in FAMILY_NAMES.items():
        family = F.when(F.col("family") == old, new).otherwise(family)
    return (
        cut_hosts(catctr)
        .filter(not_in("reachabilitystatus", UNREACHABLE))
        .filter(F.col("hostname").isNotNull())
        .withColumn("family", family)
    )


def filter_na(na: DataFrame) -> DataFrame:
    """Active devices of the types in scope; any kind of switch becomes ``Switch``."""
    return (
        na.filter(~F.col("device_status").eqNullSafe(INACTIVE))
        .filter(not_in("device_type", OUT_OF_SCOPE_TYPES))
        .withColumn("device_type", F.regexp_replace("device_type", ".*Switch.*", "Switch"))
    )


def filter_modeldata(modeldata: DataFrame) -> DataFrame:
    return modeldata.filter(not_in("category", OUT_OF_SCOPE_CATEGORIES))


def drop_cross_source(catctr: DataFrame, prime_ap: DataFrame, prime_wlc: DataFrame, na: DataFrame) -> Tabs:
    """Remove hosts that a better source lists. ``catctr`` must be filtered already.

    The names are compared as they stand, so case differences are not caught here.
    The last inventory is checked against all three others at once: whether their
    own duplicates are gone by then makes no difference to the set of names. The
    names of the three better sources are merged once, and all three joins read that.
    """
    members = members_of((catctr, "hostname"), (prime_ap, "name"), (prime_wlc, "devicename"))
    return {
        "PrimeAP": without_members(prime_ap, "name", members, 0b001),
        "PrimeWLC": without_members(prime_wlc, "devicename", members, 0b001),
        "NA": without_members(na, "host_name", members, 0b111),
    }


def apply_filters(tabs: Tabs, cross_source: bool = True) -> Tabs:
    """All filters; the input is not changed.

    ``cross_source=False`` leaves out the anti-joins between inventories. The
    device dataset is the same without them: a row they remove has the name of a
    row of a better source, and the choice of one row per name drops it anyway.
    That saves shuffling every inventory once more.
    """
    check_tab_set(tabs)
    catctr = filter_catctr(tabs["CatCtr"])
    out = dict(tabs)
    out["SOLID"] = active_sites(tabs["SOLID"], tabs["Decom"])
    out["SOLID-Loc"] = active_sites(tabs["SOLID-Loc"], tabs["Decom"])
    out["CatCtr"] = catctr
    if cross_source:
        out.update(drop_cross_source(catctr, tabs["PrimeAP"], tabs["PrimeWLC"], tabs["NA"]))
    out["NA"] = filter_na(out["NA"])
    out["ModelData"] = filter_modeldata(tabs["ModelData"])
    return out


def _tagged(parts: list[tuple[DataFrame, Column, dict[str, Column]]], names: list[str], key: str) -> DataFrame:
    """Tables under each other as (key, a count per name), summed per key: one exchange for all of them; null is a key."""
    out = None
    for table, value, counts in parts:
        part = table.select(value.alias(key), *[counts.get(n, F.lit(0)).cast("bigint").alias(n) for n in names])
        out = part if out is None else out.unionAll(part)
    return out.groupBy(key).agg(*[F.sum(n).alias(n) for n in names])


def step_counts(tabs: Tabs) -> DataFrame:
    """One row with the rows of every tab before and after all filters, and those each filter step matches.

    Nothing is joined. The inventories are counted per host under each other, and
    whether a host occurs in a better one follows from its counts; the sites likewise.
    """
    unreachable = F.coalesce(F.col("reachabilitystatus").isin(*UNREACHABLE), F.lit(False))
    hostname = F.substring_index("hostname", ".", 1)
    inactive = F.col("device_status").eqNullSafe(INACTIVE)
    typed = F.coalesce(F.col("device_type").isin(*OUT_OF_SCOPE_TYPES), F.lit(False))
    one = F.lit(1)
    hosts = _tagged(
        [
            (tabs["CatCtr"], hostname, {
                "cat": one, "unreachable": unreachable, "no_hostname": ~unreachable & hostname.isNull(),
                "cat_kept": ~unreachable & hostname.isNotNull(),
            }),
            (tabs["PrimeAP"], F.col("name"), {"ap": one}),
            (tabs["PrimeWLC"], F.col("devicename"), {"wlc": one}),
            (tabs["NA"], F.col("host_name"), {"na": one, "na_inactive": inactive, "na_typed": ~inactive & typed}),
        ],
        ["cat", "unreachable", "no_hostname", "cat_kept", "ap", "wlc", "na", "na_inactive", "na_typed"], "host",
    )
    in_cat, in_ap, in_wlc = F.col("cat_kept") > 0, F.col("ap") > 0, F.col("wlc") > 0
    free = ~in_cat & ~in_ap & ~in_wlc

    def rows(name: str, where: Column | None = None) -> Column:
        value = F.col(name) if where is None else F.when(where, F.col(name))
        return F.coalesce(F.sum(value), F.lit(0))

    by_host = hosts.agg(
        rows("cat").alias("raw_CatCtr"), rows("ap").alias("raw_PrimeAP"), rows("wlc").alias("raw_PrimeWLC"), rows("na").alias("raw_NA"),
        rows("cat_kept").alias("kept_CatCtr"), rows("ap", ~in_cat).alias("kept_PrimeAP"), rows("wlc", ~in_cat).alias("kept_PrimeWLC"),
        (rows("na", free) - rows("na_inactive", free) - rows("na_typed", free)).alias("kept_NA"),
        rows("unreachable").alias("unreachable"), rows("no_hostname").alias("no_hostname"),
        rows("ap", in_cat).alias("ap_in_cat"), rows("wlc", in_cat).alias("wlc_in_cat"), rows("na", in_cat).alias("na_in_cat"),
        rows("na", ~in_cat & in_ap).alias("na_in_ap"), rows("na", ~in_cat & in_wlc).alias("na_in_wlc"),
        rows("na_inactive", free).alias("inactive"), rows("na_typed", free).alias("out_of_scope_type"),
    )
    sites = _tagged(
        [
            (tabs["SOLID"], F.col("site_code"), {"solid": one}), (tabs["SOLID-Loc"], F.col("site_code"), {"loc": one}),
            (tabs["Decom"], F.col("site_cd"), {"gone": one}),
        ],
        ["solid", "loc", "gone"], "site",
    )
    closed = F.col("gone") > 0
    by_site = sites.agg(
        rows("solid").alias("raw_SOLID"), rows("loc").alias("raw_SOLID-Loc"), rows("gone").alias("raw_Decom"), rows("gone").alias("kept_Decom"),
        rows("solid", ~closed).alias("kept_SOLID"), rows("loc", ~closed).alias("kept_SOLID-Loc"), rows("solid", closed).alias("decommissioned"),
    )
    category = F.coalesce(F.col("category").isin(*OUT_OF_SCOPE_CATEGORIES), F.lit(False))
    models = tabs["ModelData"].agg(
        F.count(one).alias("raw_ModelData"), F.count_if(~category).alias("kept_ModelData"), F.count_if(category).alias("out_of_scope_category"),
    )
    prices = tabs["Pricing"].agg(F.count(one).alias("raw_Pricing"), F.count(one).alias("kept_Pricing"))
    struct = lambda df: df.select(F.struct("*").alias("one"))
    parts = [struct(df).scalar() for df in (by_site, models, prices)]
    whole = by_host.select("*", *[p.alias(f"_{i}") for i, p in enumerate(parts)])
    return whole.select(*by_host.columns, "_0.*", "_1.*", "_2.*")


# Steps of the audit: name, tab and the count of step_counts.
AUDIT = (
    ("decommissioned", "SOLID", "decommissioned"), ("unreachable", "CatCtr", "unreachable"), ("no_hostname", "CatCtr", "no_hostname"),
    ("in_catctr", "PrimeAP", "ap_in_cat"), ("in_catctr", "PrimeWLC", "wlc_in_cat"), ("in_catctr", "NA", "na_in_cat"),
    ("in_primeap", "NA", "na_in_ap"), ("in_primewlc", "NA", "na_in_wlc"), ("inactive", "NA", "inactive"),
    ("out_of_scope_type", "NA", "out_of_scope_type"), ("out_of_scope_category", "ModelData", "out_of_scope_category"),
)


def filter_audit(tabs: Tabs) -> DataFrame:
    """Rows each filter step matches, each step seeing what the earlier ones left."""
    rows = [F.struct(F.lit(s).alias("step"), F.lit(t).alias("tab"), F.col(n).alias("n_rows")) for s, t, n in AUDIT]
    return step_counts(tabs).select(F.inline(F.array(*rows)))


def tab_counts(tabs: Tabs) -> DataFrame:
    """Rows and columns of every tab that is read, before (``raw``) and after all filters (``filtered``)."""
    rows = [
        F.struct(
            F.lit(stage).alias("stage"), F.lit(tab).alias("tab"), F.col(f"`{kind}_{tab}`").alias("n_rows"),
            F.lit(len(tabs[tab].columns)).alias("n_columns"),
        )
        for stage, kind in (("raw", "raw"), ("filtered", "kept"))
        for tab in tabs
        if tab != "Glossary"
    ]
    return step_counts(tabs).select(F.inline(F.array(*rows)))


def overlap_hosts(tabs: Tabs) -> DataFrame:
    """Hosts of the last inventory that another one lists too, before any filter."""
    na, ap, wlc = tabs["NA"], tabs["PrimeAP"], tabs["PrimeWLC"]
    parts = [
        present_in(na, "host_name", (ap, "name")).withColumn("also_in", F.lit("PrimeAP")),
        present_in(na, "host_name", (wlc, "devicename")).withColumn("also_in", F.lit("PrimeWLC")),
    ]
    return parts[0].unionByName(parts[1]).select("also_in", "host_name", "device_model", "source_row_index")


def site_coverage_gaps(solid: DataFrame, solid_loc: DataFrame) -> DataFrame:
    """Sites listed on one side only."""
    left = absent_from(solid, "site_code", (solid_loc, "site_code"))
    right = absent_from(solid_loc, "site_code", (solid, "site_code"))
    return left.select(F.lit("SOLID").alias("only_in"), "site_code", "site_name").unionAll(
        right.select(F.lit("SOLID-Loc").alias("only_in"), "site_code", "site_name")
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per value of each column, nulls left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    return (
        df.select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
