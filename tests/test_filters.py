import pytest

from fleetspan.operators import filters
from fleetspan.operators.sizing import absent_from, mark_members, present_in
from fleetspan.sources.tabs import check_dataset_tabs, check_tab_set


def keys(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "k string")


@pytest.mark.parametrize(
    ("left", "right", "kept"),
    [
        ([None, "a", "b"], ["a"], [None, "b"]),
        (["a", "b"], [None, "a"], ["b"]),
        ([None, "a"], [None], ["a"]),
        (["a"], [], ["a"]),
        (["a", "a", "b"], ["a", "a"], ["b"]),
    ],
)
def test_null_membership(spark, left, right, kept):
    df, other = keys(spark, *left), keys(spark, *right)
    assert sorted((r.k for r in absent_from(df, "k", (other, "k")).collect()), key=str) == sorted(kept, key=str)
    assert present_in(df, "k", (other, "k")).count() == len(left) - len(kept)
    marked = mark_members(df, "k", {"hit": (other, "k")})
    assert sum(r.hit for r in marked.collect()) == len(left) - len(kept)


def test_several_tables(spark):
    df = keys(spark, "a", "b", "c", "d")
    x, y = keys(spark, "a", "b"), keys(spark, "b", "c")
    assert [r.k for r in absent_from(df, "k", (x, "k"), (y, "k")).collect()] == ["d"]
    flags = {r.k: (r.x, r.y) for r in mark_members(df, "k", {"x": (x, "k"), "y": (y, "k")}).collect()}
    assert flags == {"a": (True, False), "b": (True, True), "c": (False, True), "d": (False, False)}


def sample(tabs_from):
    return tabs_from(
        SOLID=[{"site_code": "abc"}, {"site_code": "old"}, {"site_code": None}],
        SOLID_Loc=[{"site_code": "abc"}, {"site_code": "OLD"}],
        Decom=[{"site_cd": "old"}],
        CatCtr=[
            {"hostname": "H1.corp", "reachabilitystatus": "Reachable", "family": "Routers"},
            {"hostname": "h2.corp", "reachabilitystatus": None, "family": "Other"},
            {"hostname": "H3", "reachabilitystatus": "Unreachable"},
            {"hostname": None, "reachabilitystatus": "Reachable"},
            {"hostname": None, "reachabilitystatus": "Ping Reachable"},
        ],
        PrimeAP=[{"name": "H1"}, {"name": "A1"}, {"name": "H2"}, {"name": None}],
        PrimeWLC=[{"devicename": "H1"}, {"devicename": "W1"}],
        NA=[
            {"host_name": "H1"},
            {"host_name": "A1"},
            {"host_name": "W1"},
            {"host_name": None},
            {"host_name": "N1", "device_status": "Inactive", "device_type": "Firewall"},
            {"host_name": "N2", "device_status": None, "device_type": "Firewall"},
            {"host_name": "N3", "device_status": "Active", "device_type": "L3 Switch"},
            {"host_name": "N4", "device_status": "Active", "device_type": None},
        ],
        ModelData=[{"category": "Voice"}, {"category": None}, {"category": "AP"}],
    )


def test_apply_filters(tabs_from):
    out = filters.apply_filters(sample(tabs_from))
    assert {r.site_code for r in out["SOLID"].collect()} == {"abc", None}
    assert {r.site_code for r in out["SOLID-Loc"].collect()} == {"abc", "OLD"}
    assert {(r.hostname, r.family) for r in out["CatCtr"].collect()} == {("H1", "Router"), ("h2", "Other")}
    # Case differs, so this step keeps H2; choosing one row per name drops it later.
    assert {r.name for r in out["PrimeAP"].collect()} == {"A1", "H2", None}
    assert {r.devicename for r in out["PrimeWLC"].collect()} == {"W1"}
    # The missing name meets a missing name in another inventory.
    assert {(r.host_name, r.device_type) for r in out["NA"].collect()} == {("N3", "Switch"), ("N4", None)}
    assert {r.category for r in out["ModelData"].collect()} == {None, "AP"}


def test_audit(tabs_from):
    found = {(r.step, r.tab): r.n_rows for r in filters.filter_audit(sample(tabs_from)).collect()}
    assert found == {
        ("decommissioned", "SOLID"): 1,
        ("unreachable", "CatCtr"): 2,
        ("no_hostname", "CatCtr"): 1,
        ("in_catctr", "PrimeAP"): 1,
        ("in_catctr", "PrimeWLC"): 1,
        ("in_catctr", "NA"): 1,
        ("in_primeap", "NA"): 2,
        ("in_primewlc", "NA"): 1,
        ("inactive", "NA"): 1,
        ("out_of_scope_type", "NA"): 1,
        ("out_of_scope_category", "ModelData"): 1,
    }


def test_contracts(tabs_from):
    tabs = tabs_from()
    check_tab_set(tabs)
    with pytest.raises(ValueError, match="expected the tabs"):
        check_tab_set(dict(reversed(tabs.items())))
    with pytest.raises(ValueError, match="Pricing"):
        check_dataset_tabs({n: t for n, t in tabs.items() if n != "Pricing"})
