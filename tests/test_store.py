"""Documents, training that is killed and goes on, models that are activated, and gradient steps by hand."""

import json
import os

import numpy as np
import pytest

from tideline.operators import models
from tideline.sources import store as S


@pytest.fixture
def store(spark, tmp_path):
    return S.Store(spark, f"file://{tmp_path}/store")


def counts(spark, n=400):
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 2))
    y = r.poisson(np.exp(1 + 0.4 * x[:, 0] - 0.2 * x[:, 1]))
    return x, y, spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")


def test_gradient_steps_by_hand(spark):
    x, y, rows = counts(spark)
    w = np.array([np.log(y.mean()), 0.0, 0.0])
    for _ in range(30):
        error = np.clip(y - np.exp(w[0] + x @ w[1:]), -4, 4)
        w = w + 0.025 * (np.array([error.mean(), *(error[:, None] * x).mean(axis=0)]) - 0.003 * np.array([0, *w[1:]]))
    assert models.count_regression(rows, ["a", "b"], "y") == pytest.approx(w.tolist(), rel=1e-10)


def test_the_conditional_logit_by_hand(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(60, 5, 2))
    won = np.zeros((60, 5))
    for k in range(60):
        p = np.exp(x[k] @ [1.0, -0.5])
        won[k, r.choice(5, p=p / p.sum())] = 1
    rows = spark.createDataFrame([(k, float(x[k, i, 0]), float(x[k, i, 1]), int(won[k, i])) for k in range(60) for i in range(5)], "race long, a double, b double, won int")
    w = np.zeros(2)
    for _ in range(60):
        e = np.exp(x @ w)
        d = won - e / e.sum(axis=1, keepdims=True)
        w = w + 0.045 * ((d[..., None] * x).sum(axis=(0, 1)) / 60 - 0.004 * w)
    got = models.conditional_logit(rows, "race", ["a", "b"], "won")
    assert got == pytest.approx(w.tolist(), rel=1e-9) and got[0] > 0 > got[1]


def test_documents_appear_whole(store, tmp_path):
    assert store.read("a.json") is None
    store.write("deep/a.json", {"x": [1, 2.5, None], "é": "ü"})
    store.write("deep/a.json", {"x": 2})
    assert store.read("deep/a.json") == {"x": 2}
    assert [f for _, _, names in os.walk(tmp_path) for f in names if f.startswith(".") and not f.endswith(".crc")] == []
    with pytest.raises(ValueError):
        store.write("a.json", {"x": float("nan")})
    store.delete("deep")
    assert store.read("deep/a.json") is None


def test_killed_training_goes_on_to_the_same_weights(spark, store):
    _, _, rows = counts(spark)
    data, taken = S.fingerprint(rows), []

    def step(state, kill=None):
        if kill is not None and len(taken) >= kill:
            raise RuntimeError("killed")
        taken.append(state["epoch"])
        return {"epoch": state["epoch"] + 1, "w": models.gradient_step(rows, ["a", "b"], "y", state["w"], 0.025, 0.003)}

    start = lambda: {"epoch": 0, "w": [1.0, 0.0, 0.0]}
    with pytest.raises(RuntimeError):
        S.resumed(store, data, start, lambda s: step(s, 8), 12)
    assert taken == list(range(8)) and store.read("checkpoint.json")["epoch"] == 5
    state = S.resumed(store, data, start, step, 12)
    assert taken == [*range(8), *range(5, 12)]  # from the last checkpoint on
    whole = start()
    for _ in range(12):
        whole = {"epoch": whole["epoch"] + 1, "w": models.gradient_step(rows, ["a", "b"], "y", whole["w"], 0.025, 0.003)}
    assert state["epoch"] == 12 and state["w"] == pytest.approx(whole["w"], rel=1e-12)
    taken.clear()
    assert S.resumed(store, data, start, step, 12) == state and taken == []  # done already
    S.resumed(store, "other data", start, step, 2)
    assert taken == [0, 1]
    S.resumed(store, "other data", start, step, 2, restart=True)
    assert taken == [0, 1, 0, 1]


def test_a_broken_checkpoint_counts_as_none(store, tmp_path):
    store.write("checkpoint.json", {"data": "d", "epoch": 3, "state": {"n": 3}})
    path = tmp_path / "store" / "checkpoint.json"
    path.write_text(path.read_text()[:10])
    (tmp_path / "store" / ".checkpoint.json.crc").unlink(missing_ok=True)
    assert S.resumed(store, "d", lambda: {"n": 0}, lambda s: {"n": s["n"] + 1}, 4) == {"n": 4}


def test_only_sound_models_of_present_data_are_activated(store, tmp_path):
    assert S.active(store) is None
    first = S.activate(store, {"w": [1.0, 2.0]}, "d1", "d1")
    assert S.active(store) == {"version": first, "data": "d1", "model": {"w": [1.0, 2.0]}}
    for model, data, now, check, said in (({"w": [float("inf")]}, "d1", "d1", lambda m: True, "finite"), ({"w": []}, "d1", "d1", lambda m: len(m["w"]) == 2, "check"), ({"w": [3.0]}, "d1", "d2", lambda m: True, "changed")):
        with pytest.raises(ValueError, match=said):
            S.activate(store, model, data, now, check)
        assert S.active(store)["version"] == first
    second = S.activate(store, {"w": [4.0]}, "d2", "d2")
    assert second != first and S.active(store)["model"] == {"w": [4.0]} and store.read(f"versions/{first}.json") is not None
    path = tmp_path / "store" / "versions" / f"{second}.json"
    path.write_text(path.read_text().replace("4.0", "5.0"))
    (tmp_path / "store" / "versions" / f".{second}.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="broken"):
        S.active(store)


def test_fingerprints_tell_tables_apart(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id long, v string")
    assert S.fingerprint(rows) == S.fingerprint(rows.orderBy("id", ascending=False).repartition(3).select("v", "id"))
    assert len({S.fingerprint(rows), S.fingerprint(rows.distinct()), S.fingerprint(rows.limit(0)), S.fingerprint(rows.withColumnRenamed("v", "w"))}) == 4


def test_seeds_keep_whole_numbers_whole(spark):
    rows = spark.createDataFrame([("E0", 2, 'A "x"', 7, 0.123456789), ("E0", 1, None, None, 2.0), ("E1", 1, "B", 1, None)], "division string, n long, team string, hc int, odds double")
    got = {r.division: r for r in S.seeds(rows, ["division"], ["n"], ["team", "hc", "odds"]).collect()}
    assert json.loads(got["E0"].payload) == [[None, None, 2.0], ['A "x"', 7, 0.12346]] and got["E0"].n == 2 and len(got["E0"].version) == 16
    assert got["E1"].payload == '[["B",1,null]]'


def test_training_by_parts_gives_the_whole_regression(spark, data):
    from tideline.queries import QUERIES

    a, b = ({r.k: r.expected for r in QUERIES[q](spark, data).collect()} for q in ("q_resumed_training", "q_count_regression"))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=2e-6) for k in a)
