"""The prepared store and resumable training: commits, lost drivers, orphans."""
import os

import numpy as np
import pytest

from fernrec.config import ModelConfig, RuntimeConfig
from fernrec.plans import store, train as train_module
from fernrec.plans.prepare import prepare
from fernrec.plans.train import train
from fernrec.sources.tables import events_interactions

from conftest import SF001

MODEL = ModelConfig(factors=3, c0=16.0, iterations=4, min_user_interactions=5,
                    min_item_interactions=5, dtype="float64")


@pytest.fixture(scope="module")
def prepared(spark):
    return prepare(events_interactions(spark, SF001), MODEL)


def matrix(df):
    return np.array([r.vec for r in df.orderBy("idx").collect()])


def test_lost_driver_resumes(spark, prepared, tmp_path, monkeypatch):
    """The driver goes in iteration 3; a new run ends as an unbroken one."""
    state = str(tmp_path / "state")
    whole = train(prepared, MODEL)
    real, calls = train_module.item_step, []

    def dies(*args):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return real(*args)
    monkeypatch.setattr(train_module, "item_step", dies)
    with pytest.raises(KeyboardInterrupt):
        train(prepared, MODEL, state=state)
    # a writer that was lost within a commit leaves a folder without manifest
    os.makedirs(f"{state}/v-00000003/p")
    assert store.newest(spark, state) == 2
    again = train(prepared, MODEL, state=state)
    assert len(calls) == 5 and [r["iteration"] for r in again.train_log] == [1, 2, 3, 4]
    assert np.allclose(matrix(again.p), matrix(whole.p), atol=1e-9)
    assert np.allclose(matrix(again.q), matrix(whole.q), atol=1e-9)
    left = sorted(os.listdir(state))
    assert len(left) == 2 and all(os.path.exists(f"{state}/{v}/manifest.json") for v in left)
    assert len(train(prepared, MODEL, state=state).train_log) == 4 and len(calls) == 5
    with pytest.raises(ValueError, match="other data or settings"):
        train(prepared, MODEL.with_(c0=2.0), state=state)


def test_prepared_set_round_trip(spark, prepared, tmp_path):
    path = str(tmp_path / "prepared")
    with pytest.raises(FileNotFoundError):
        store.load_prepared(spark, path)
    assert store.save_prepared(prepared, path) == 1
    os.makedirs(f"{path}/v-00000002/train")
    found = store.load_prepared(spark, path)
    assert (found.num_users, found.num_items) == (prepared.num_users, prepared.num_items)
    assert found.stats["test_users"] == prepared.stats["test_users"]
    for name in ("user_index", "item_index", "indexed", "train", "test", "weights", "hist"):
        a, b = getattr(found, name), getattr(prepared, name)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    # the unfinished version is removed, its number not used again
    assert store.save_prepared(prepared, path) == 3
    assert sorted(os.listdir(path)) == ["v-00000001", "v-00000003"]
    one = train(found, MODEL, RuntimeConfig(), iterations=1)
    assert np.allclose(matrix(one.p), matrix(train(prepared, MODEL, iterations=1).p), atol=1e-9)
