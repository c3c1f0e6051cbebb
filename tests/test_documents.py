"""Settings, evidence documents and commands."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F


def test_settings(tmp_path):
    from factorloom.config import digest, redacted, resolve

    (tmp_path / "a.json").write_text('{"x": {"y": 1, "z": 2}}')
    (tmp_path / "b.toml").write_text("[x]\ny = 3\n")
    s = resolve([str(tmp_path / "a.json"), str(tmp_path / "b.toml")], ["x.w=true", "n=1.5"])
    assert s == {"x": {"y": 3, "z": 2, "w": True}, "n": 1.5}
    assert digest(s) == digest(dict(reversed(s.items())))
    assert redacted({"api_token": "x", "deep": {"password": "y", "n": 1}}) == {"api_token": "***", "deep": {"password": "***", "n": 1}}
    with pytest.raises(ValueError):
        resolve([], ["nothing"])


def test_audit():
    from factorloom.analytics.snapshot import audit, json_safe

    for bad in ({"a": [{"tickers": 1}]}, {"a": float("inf")}, {"p": "/home/x"}):
        with pytest.raises(ValueError):
            audit(bad)
    audit(json_safe({"a": float("nan"), "b": datetime(2024, 1, 1)}))


def panel(spark):
    rows = [(datetime(2024, 1, 1) + timedelta(days=i), f"t{j}", 10.0 + j, 11.0 + j, 9.0 + j, 10.0 + j + (i * j) % 3, 100.0, float(j), ((i * 7 + j * 3) % 5) / 100 + j / 1000) for i in range(30) for j in range(12)]
    return spark.createDataFrame(rows, "date timestamp, ticker string, open double, high double, low double, close double, volume double, f double, next_period_return double")


def test_evidence(spark):
    from factorloom.analytics.snapshot import evidence
    from factorloom.sources.tables import settled

    p = panel(spark).withColumn("gone", F.lit(None).cast("double"))
    d = evidence(p, ["f", "gone"], "next_period_return", groups=4, settle=settled)
    assert d["dataset"] == {"observations": 360, "dates": 30, "names": 12}
    assert d["inference"] == "partial" and d["factors"]["gone"]["inference"]["status"] == "not_provided"
    assert [g["group"] for g in d["factors"]["f"]["groups"]] == [1, 2, 3, 4]
    assert d["factors"]["f"]["slices"][0]["valid_dates"] == 30
    json.dumps(d, allow_nan=False)


def test_commands(spark, tmp_path, capsys):
    from factorloom.cli import main

    where = str(tmp_path / "panel.parquet")
    panel(spark).write.parquet(where)
    assert main(["data-status", "--panel", where, "--mode", "off"]) == 0
    assert json.loads(capsys.readouterr().out)["panel"]["n_rows"] == 360
    assert main(["data-snapshot", "--panel", where]) == 0
    assert json.loads(capsys.readouterr().out)["rows"] == 360
    assert main(["factor-evidence", "--panel", where, "--factor", "f", "--groups", "3"]) == 0
    assert json.loads(capsys.readouterr().out)["factors"]["f"]["ic"]["periods"] == 30
    assert main(["parquet-rewrite", where, where + "2", "--level", "5"]) == 0
