"""JSON-lines submission sink and the name registry."""

import json

import pytest

from braid import registry
from braid.operators import metrics as mt


def test_submission_written_per_task(spark, tmp_path):
    preds = spark.createDataFrame([("lang", 10, 1), ("lang", 11, 0), ("quality", 5, 2)],
                                  "task string, id bigint, pred_idx int")
    dim = spark.createDataFrame([("lang", 'de "x"', 0), ("lang", "en", 1), ("quality", "q1t0", 2)],
                                "task string, label string, label_idx int")
    lines = mt.submission_lines(mt.decode_labels(preds, dim))
    out = str(tmp_path / "sub")
    mt.write_submission(lines, out)
    back = spark.read.text(out).collect()
    got = sorted(json.loads(r["value"])["label"] for r in back)
    assert got == ['de "x"', "en", "q1t0"]
    assert {p.name for p in (tmp_path / "sub").iterdir() if p.is_dir()} == {"task=lang", "task=quality"}


def test_registry_names_and_errors():
    assert registry.names("loss") == ["cross_entropy", "dice_loss", "focal_loss"]
    assert set(registry.names("strategy")) == {"none", "dwa", "dtp", "uw"}
    assert set(registry.names("adversarial")) == {"fgm", "pgd", "freelb"}
    assert registry.names("head") == ["linear", "majority", "nb"]
    with pytest.raises(ValueError):
        registry.get("loss", "hinge")


def test_dispatch_by_task(spark):
    rows = spark.createDataFrame([("a", 1, [0.0, 2.0]), ("b", 2, [0.0, 2.0])], "task string, id bigint, logits array<double>")
    prior = spark.createDataFrame([("a", [-1.0, -2.0]), ("b", [-1.0, -2.0])], "task string, log_prior array<double>")
    got = registry.dispatch(rows, {"a": "nb", "b": "majority"}, prior=prior).collect()
    assert {r["task"]: r["pred_idx"] for r in got} == {"a": 1, "b": 0}
