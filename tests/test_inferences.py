import pytest

from fleetspan.plans import inferences
from fleetspan.sources.predictions import load_predictions, normalize_predictions, write_predictions


def scored(spark, rows):
    return spark.createDataFrame(
        rows,
        "predicted_behavior_class int, prediction_confidence double, loc_state string, device_model string, device_source string",
    )


def test_confidence_bins(spark):
    given = [0.0, 0.2, 0.6, 0.6000001, 1.0, 1.25, None, -0.5]
    df = scored(spark, [(0, c, None, None, "NA") for c in given])
    found = [r[0] for r in df.select(inferences.confidence_bin("prediction_confidence")).collect()]
    assert found == [1, 1, 3, 4, 5, 5, None, 1]
    assert [r.n_devices for r in inferences.confidence_histogram(df).collect()] == [3, 0, 1, 1, 2]
    assert inferences.confidence_histogram(scored(spark, [(0, None, None, None, "NA")])).count() == 0


def test_summaries(spark):
    df = scored(spark, [(-1, 0.5, "GA", "M", "A"), (1, 0.5, "GA", "M", "A"), (0, 0.5, None, None, "B")])
    kpi = inferences.prediction_kpis(df).first()
    assert (kpi.total_scored, kpi.predicted_risk_total, round(kpi.predicted_risk_rate, 6)) == (3, 2, 66.666667)
    assert [(r.class_id, r.n_devices) for r in inferences.class_mix(df).orderBy("position").collect()] == [(-1, 1), (1, 1), (0, 1)]
    assert [tuple(r) for r in inferences.state_risk(df).collect()] == [("GA", 2, 2, 1, 1, 100.0)]
    assert [tuple(r) for r in inferences.source_mix(df).collect()] == [("A", 2, 1, 1, 0), ("B", 1, 0, 0, 1)]
    empty = inferences.class_mix(df.filter("false")).collect()
    assert [(r.n_devices, r.share_pct) for r in empty] == [(0, 0.0)] * 3


def test_load(spark, tmp_path):
    raw = spark.createDataFrame([("-1", "0.4", " ga"), ("2", "1", "AL"), ("0.0", "x", ""), ("one", "1", None)], "predicted_behavior_class string, prediction_confidence string, loc_state string")
    out = sorted(normalize_predictions(raw).collect(), key=lambda r: r.predicted_behavior_class)
    assert [(r.predicted_behavior_class, r.prediction_confidence, r.loc_state, r.device_source) for r in out] == [
        (-1, 0.4, "GA", "NA"), (0, None, None, "NA"),
    ]
    with pytest.raises(ValueError):
        normalize_predictions(raw.drop("predicted_behavior_class"))
    second = str(tmp_path / "second")
    assert load_predictions(spark, [str(tmp_path / "first"), second]) is None
    assert inferences.inferences(None) == {"available": False}
    write_predictions(raw, second)
    loaded = load_predictions(spark, [str(tmp_path / "first"), second])
    bundle = inferences.inferences(loaded)
    assert bundle["available"] and bundle["kpis"].first().total_scored == 2
    assert not inferences.inferences(loaded.filter("false"))["available"]
