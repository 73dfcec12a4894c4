import random

import pytest
from pyspark.ml.linalg import SparseVector

from fleetspan.operators.sizing import BROADCAST_ROWS
from fleetspan.plans import encoding
from fleetspan.plans.encoding import fit_encoder, load_encoder

SCHEMA = "device_name string, a string, b string, n double, empty string"


def table(spark, n_values, rows=400, seed=1):
    rng = random.Random(seed)
    data = [(f"d{k}", rng.choice([None, f"v{rng.randrange(n_values)}"]), rng.choice(["x", "y", None]), rng.choice([None, 0.0, 2.5, 4.0]), None) for k in range(rows)]
    return data, spark.createDataFrame(data, SCHEMA)


def by_hand(train, rows):
    """One-hot vectors as a dict of slots, from the training rows alone."""
    numbers = sorted(r[3] for r in train if r[3] is not None)
    middle = (numbers[(len(numbers) - 1) // 2] + numbers[len(numbers) // 2]) / 2
    names, fills, slot = {}, {}, 1
    for place in (1, 2):
        values = [r[place] for r in train if r[place] is not None]
        fills[place] = min(set(values), key=lambda v: (-values.count(v), v))
        for v in sorted(set(values)):
            names[place, v] = slot
            slot += 1
    out = {}
    for r in rows:
        vector = {0: middle if r[3] is None else r[3]}
        for place in (1, 2):
            at = names.get((place, fills[place] if r[place] is None else r[place]))
            if at is not None:
                vector[at] = 1.0
        out[r[0]] = {k: v for k, v in vector.items() if v}
    return out, slot


@pytest.mark.parametrize("n_values", [3, 65, 6500])
@pytest.mark.parametrize("joined", ["broadcast", "shuffle"])
def test_vectors_equal_one_hot(spark, monkeypatch, n_values, joined):
    """Few and very many values take the same path; a large dictionary is joined by shuffle."""
    train, df = table(spark, n_values)
    rows, other = table(spark, n_values * 2, seed=2)  # half of the values are new
    encoder = fit_encoder(df, ["a", "b", "empty"], ["n"])
    if joined == "shuffle":
        monkeypatch.setattr(encoding, "BROADCAST_BYTES", 10)
    assert "empty" not in encoder.texts
    wanted, width = by_hand(train, rows)
    assert encoder.width == width
    encoded = encoder.transform(other, "device_name")
    assert encoded.columns == [*other.columns, "features"]
    got = {}
    for r in encoded.collect():
        assert isinstance(r.features, SparseVector) and r.features.size == width
        got[r.device_name] = {int(k): float(v) for k, v in zip(r.features.indices, r.features.values)}
    assert got == wanted
    side = encoder._side("a", joined == "broadcast")
    assert side.fits_broadcast == (joined == "broadcast") and side.n_rows <= BROADCAST_ROWS + 1


def test_encoder_survives_saving(spark, tmp_path):
    _, df = table(spark, 40)
    encoder = fit_encoder(df, ["a", "b"], ["n"])
    encoder.save(str(tmp_path / "e"))
    again = load_encoder(spark, str(tmp_path / "e"))
    assert (again.numbers, again.texts, again.sizes, again.width) == (encoder.numbers, encoder.texts, encoder.sizes, encoder.width)
    rows = lambda e: sorted(map(repr, e.sparse(df, "device_name").collect()))
    assert rows(again) == rows(encoder)


def test_nothing_to_encode(spark):
    _, df = table(spark, 3)
    assert fit_encoder(df, ["empty"], []).width == 0
    assert fit_encoder(df, [], ["n"]).width == 1
    assert fit_encoder(df.limit(0), ["a"], ["n"]).transform(df, "device_name").where("features is null").count() == 0


def test_restricted_to_the_values_some_rows_hold(spark):
    """Slots that are zero in all those rows go; what is left stands in the same order."""
    _, df = table(spark, 60)
    encoder, few = fit_encoder(df, ["a", "b"], ["n"]), df.limit(20).localCheckpoint()
    small = encoder.restricted(few)
    assert small.width < encoder.width and small.numbers == encoder.numbers and small.texts == encoder.texts

    def named(e, rows):
        names = {r.slot: (r.column, r.value) for r in e.dictionary.collect()}
        return {r.device_name: [(names.get(i, i), v) for i, v in zip(r.features.indices, r.features.values)] for r in e.transform(rows, "device_name").collect()}

    assert named(small, few) == named(encoder, few)
    held = {n for entries in named(encoder, few).values() for n, _ in entries}
    assert named(small, df) == {d: [(n, v) for n, v in entries if n in held or isinstance(n, int)] for d, entries in named(encoder, df).items()}
