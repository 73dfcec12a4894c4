import random

import pytest
from pyspark.sql import functions as F

from fleetspan.operators import dataset, filters, sizing
from fleetspan.sources.devices import load_devices, mappable, normalize_devices, write_devices
from fleetspan.sources.tabs import read_tabs, tab_shapes


def build(tabs, **options):
    kept = filters.apply_filters(tabs)
    return dataset.device_dataset(kept, dataset.dimensions(kept, **options))


def rows(df):
    return sorted(map(repr, df.collect()))


def test_precedence(tabs_from):
    tabs = tabs_from(
        CatCtr=[{"hostname": " gaabc-1.x", "platformid": "p1, q"}],
        PrimeAP=[{"name": "GAABC-1", "model": "p2"}, {"name": "GAABC-2", "model": "p2"}],
        PrimeWLC=[{"devicename": "GAABC-2", "manufacturer_part_partnumber": "p3"}],
        NA=[
            {"host_name": "gaabc-2.y", "device_model": "p4"},
            {"host_name": "GAABC-3", "device_model": "late", "source_row_index": 9},
            {"host_name": "gaabc-3", "device_model": "early", "source_row_index": 2},
            {"host_name": " .only", "device_model": "none"},
        ],
    )
    found = {r.device_name: (r.device_source, r.device_model, r.state_code, r.site_code) for r in build(tabs).collect()}
    assert found == {
        "GAABC-1": ("CatCtr", "P1", "GA", "ABC"),
        "GAABC-2": ("PrimeAP", "P2", "GA", "ABC"),
        "GAABC-3": ("NA", "EARLY", "GA", "ABC"),
    }


def test_device_types(tabs_from):
    texts = {
        "a": ("AP", None), "b": (None, "SWITCH ROUTER"), "c": (None, "VOICE GATEWAY ROUTER"), "d": ("Odd", "Smart Hub"),
        "e": ("voice gateway", "Router"), "f": ("Odd", "my WLC box"), "g": (None, "tap"), "h": (None, None),
        "i": (None, "Unified AP"),
    }
    tabs = tabs_from(
        CatCtr=[{"hostname": n, "family": f, "type": t} for n, (f, t) in texts.items()],
        PrimeAP=[{"name": "p", "type": "Switch"}],
        PrimeWLC=[{"devicename": "w", "productfamily": "AP"}],
        NA=[{"host_name": "n", "device_type": "Core Switch 9"}, {"host_name": "m", "device_type": "ASR 1000"}],
    )
    found = {r.device_name: r.device_type for r in build(tabs).collect()}
    assert found == {
        "A": "AP", "B": "Switch", "C": "Router", "D": "Switch", "E": "Voice Gateway", "F": "Wireless Controller",
        "G": None, "H": None, "I": "AP", "P": "AP", "W": "Wireless Controller", "N": "Switch", "M": "Router",
    }


def doubled(tabs_from):
    return tabs_from(
        CatCtr=[
            {"hostname": "gaabc-1", "platformid": "m1"},
            {"hostname": "gaxyz-2", "platformid": None},
            {"hostname": "alabc-3", "platformid": "m2"},
        ],
        SOLID=[{"site_code": "abc", "state": "ga", "site_name": None}, {"site_code": "abc", "state": "al", "site_name": "AL"}],
        SOLID_Loc=[
            {"site_code": "ABC", "site_name": "Loc 1", "latitude": "33.5", "longitude": "-84"},
            {"site_code": "Abc ", "site_name": "Loc 2", "latitude": "bad", "longitude": "-85"},
        ],
        ModelData=[
            {"model": "M1", "repl_device": "r1", "material_cost": "50"},
            {"model": "m1 ", "repl_device": "R2", "material_cost": "60"},
            {"model": None, "category": "nameless"},
        ],
        Pricing=[
            {"parent_product": "R1", "product": "s1", "device": "y", "pricing": "n/a"},
            {"parent_product": "r1", "product": "s2", "device": "Y", "pricing": "call"},
            {"parent_product": "r2", "product": "s3", "device": "n", "pricing": "10"},
            {"parent_product": "r2", "product": None, "device": "n", "pricing": "5.5"},
            {"parent_product": None, "product": "s4", "device": "y", "pricing": "1"},
        ],
    )


def test_fanout_and_prices(tabs_from):
    tabs = doubled(tabs_from)
    out = build(tabs).collect()
    first = [r for r in out if r.device_name == "GAABC-1"]
    # 2 locations x (model row R1 with 2 device rows + model row R2 without one).
    assert len(first) == 6
    assert {(r.repl_device_key, r.replacement_device_sku, r.pricing_total_estimate, r.pricing_component_count) for r in first} == {
        ("R1", "S1", 0.0, 2), ("R1", "S2", 0.0, 2), ("R2", None, 15.5, 1),
    }
    assert {r.loc_site_name for r in first} == {"Loc 1", "Loc 2"}
    # A device without a model meets the model row without a name.
    assert [r.modeldata_category for r in out if r.device_name == "GAXYZ-2"] == ["nameless"]
    assert [r.location_matched for r in out if r.device_name == "GAXYZ-2"] == [False]
    steps = {r.step: r.n_rows for r in dataset.join_fanout(filters.apply_filters(tabs)).collect()}
    assert steps == {"1_devices": 3, "2_location": 5, "3_model": 7, "4_pricing": len(out)}
    assert len(out) == 9
    guarded = build(tabs, unique=True)
    assert guarded.count() == 3


def test_columns_and_clean(tabs_from):
    out = build(doubled(tabs_from))
    assert tuple(out.columns[: len(dataset.COLUMN_ORDER)]) == dataset.COLUMN_ORDER
    assert not set(dataset.HELPERS) & set(out.columns)
    clean = dataset.clean_devices(out)
    assert set(out.columns) - set(clean.columns) == {*dataset.SPARSE, *dataset.NOT_ANALYSED}
    with pytest.raises(ValueError, match="lacks"):
        dataset.clean_devices(clean)


def random_tabs(tabs_from, seed):
    rng = random.Random(seed)

    def host():
        name = rng.choice(["gaabc-", "GAABC-", "alabc-", " GAxyz-"]) + str(rng.choice([0] * 8 + list(range(1, 12))))
        return rng.choice([name, name, name + ".corp", name.upper(), None])

    return tabs_from(
        CatCtr=[{"hostname": host(), "reachabilitystatus": rng.choice(["Unreachable", None]), "platformid": f"m{rng.randrange(3)}"} for _ in range(40)],
        PrimeAP=[{"name": host(), "model": f"m{rng.randrange(3)}"} for _ in range(40)],
        PrimeWLC=[{"devicename": host(), "manufacturer_part_partnumber": f"m{rng.randrange(3)}"} for _ in range(40)],
        NA=[{"host_name": host(), "device_model": f"m{rng.randrange(3)}", "device_status": rng.choice(["Inactive", "Active"])} for _ in range(60)],
        SOLID=[{"site_code": "abc", "state": "GA", "site_name": "S"}],
        ModelData=[{"model": "M1", "repl_device": "r1"}],
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_anti_joins_do_not_change_the_dataset(tabs_from, seed):
    tabs = random_tabs(tabs_from, seed)
    assert rows(build(tabs)) == rows(dataset.devices_from_tabs(tabs))


def test_dedup_does_not_depend_on_layout(tabs_from):
    union = dataset.device_union(random_tabs(tabs_from, 5))
    once = dataset.best_source_rows(union).drop("source_priority", "source_tiebreak")
    assert rows(once) == rows(
        dataset.best_source_rows(union.repartition(7, F.rand(3))).drop("source_priority", "source_tiebreak")
    )
    assert rows(once) == rows(dataset.best_source_rows(once).drop("source_priority", "source_tiebreak"))


def test_dimension_paths_agree(spark, monkeypatch):
    facts = spark.range(3000).select(
        F.concat(F.lit("d"), "id").alias("device_name"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
    )
    dim = spark.createDataFrame([("hot", 1), ("hot", 2), (None, 3), ("k5", 4)], "key string, v int")
    (settled,) = sizing.settle(dim)
    assert (settled.n_rows, settled.fits_broadcast) == (4, True)
    on = [("k", "key")]
    small = sizing.join_dimension(facts, settled, on, "device_name", null_safe=True)
    assert small.count() == 4000 and small.filter("v = 3").count() == 1000
    salted = sizing.join_dimension(facts, settled, on, "device_name", null_safe=True, salts=5)
    large = sizing.Dimension(settled.table, sizing.BROADCAST_ROWS + 1, 0)
    shuffled = sizing.join_dimension(facts, large, on, "device_name", null_safe=True)
    assert rows(small) == rows(salted) == rows(shuffled)
    monkeypatch.setattr(sizing, "_splits_skew", lambda _: False)
    assert rows(sizing.join_dimension(facts, large, on, "device_name", null_safe=True)) == rows(small)


def test_normalised_devices_and_files(spark, tmp_path):
    df = spark.createDataFrame(
        [("D", " ga ", "abc", " n ", "33", "x", "2025-01-02", ""), ("E", "", None, None, "1", "2", "soon", "NAN")],
        "device_name string, loc_state string, loc_site_code string, loc_site_name string, loc_latitude string, "
        "loc_longitude string, modeldata_eol string, device_source string",
    )
    d, e = normalize_devices(df).orderBy("device_name").collect()
    assert (d.loc_state, d.loc_site_name, d.loc_latitude, d.loc_longitude, str(d.modeldata_eol), d.device_source) == (
        "GA", "n", 33.0, None, "2025-01-02", "NA",
    )
    assert (e.loc_state, e.modeldata_eol, e.device_source) == (None, None, "NA")
    assert mappable(normalize_devices(df)).count() == 0
    write_devices(normalize_devices(df), str(tmp_path / "d"), by_state=True)
    loaded = load_devices(spark, str(tmp_path / "d"))
    assert loaded.count() == 2
    text = loaded.filter("loc_state = 'GA'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "PartitionFilters: []" not in text
    with pytest.raises(ValueError, match="device_name"):
        normalize_devices(df.drop("device_name"))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_read_tabs(spark, tabs_from, tmp_path, fmt):
    for name, df in doubled(tabs_from).items():
        renamed = df.drop("source_row_index")
        if name == "Pricing":
            renamed = renamed.withColumnRenamed("device", "Device?").withColumnRenamed("labor_de", "Labor-DE")
        renamed.coalesce(1).write.option("header", True).format(fmt).save(str(tmp_path / f"{name}.{fmt}"))
    tabs = read_tabs(spark, str(tmp_path), fmt)
    assert {r.tab: r.n_rows for r in tab_shapes(tabs).collect()}["Pricing"] == 5
    again, first = build(tabs), build(doubled(tabs_from))
    assert again.columns == first.columns and again.count() == first.count()
    with pytest.raises(ValueError, match="unsupported"):
        read_tabs(spark, str(tmp_path), "xml")
