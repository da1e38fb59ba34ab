"""Protocol files, manifests, column functions and the stream."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.sources import config, manifest, sinks


def test_protocol(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"name": "x", "gate": {"depth": 5}, "other": {"a": 1}}))
    p = config.load(spark, str(tmp_path / "p.json"))
    assert (p.name, p.gate.depth, p.emulation.folds) == ("x", 5, 5)
    with pytest.raises(ValueError, match="unknown keys: nope"):
        config.parse({"gate": {"nope": 1}})
    with pytest.raises(ValueError, match="epsilon"):
        config.parse({"emulation": {"epsilon": 0.7}})


def test_manifest_drift(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for d, files in ((a, {"x": "1", "y": "2", "z": "3"}), (b, {"x": "1", "y": "changed", "w": "4"})):
        d.mkdir()
        for n, t in files.items():
            (d / n).write_text(t)
    got = manifest.drift(manifest.manifest(spark, str(a)), manifest.manifest(spark, str(b))).collect()
    assert {r["name"]: r["status"] for r in got} == {"y": "changed", "z": "removed", "w": "added"}


def test_manifest_names_files_by_their_path_and_lists_empty_ones(spark, tmp_path):
    """Files of one name in two folders are two files; names may hold blanks, signs and letters; empty files count."""
    names = ["one/data.txt", "two/data.txt", "data.txt", "two/a b+c%20é.txt", "two/empty.txt", "none.bin"]
    for i, n in enumerate(names):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("" if "empty" in n or "none" in n else f"content {i}")
    files = manifest.manifest(spark, str(tmp_path)).collect()
    assert sorted(r["name"] for r in files) == sorted(names) and all((r["length"] == 0) == ("empty" in r["name"] or "none" in r["name"]) for r in files)
    assert {r["digest"] for r in files if r["length"] == 0} == {hashlib.sha256(b"").hexdigest()}
    before = spark.createDataFrame(files)
    assert manifest.drift(before, manifest.manifest(spark, str(tmp_path))).count() == 0
    (tmp_path / "two/data.txt").write_text("changed")
    (tmp_path / "two/empty.txt").unlink()
    assert {(r["name"], r["status"]) for r in manifest.drift(before, manifest.manifest(spark, str(tmp_path))).collect()} == {("two/data.txt", "changed"), ("two/empty.txt", "removed")}
    assert {r["name"] for r in manifest.manifest(spark, str(tmp_path), "*.bin").collect()} == {"none.bin"}


def test_functions(spark):
    d = spark.range(1).select(
        fn.sigmoid(F.lit(-800.0)).alias("lo"), fn.sigmoid(F.lit(0.0)).alias("mid"), fn.safe_divide(F.lit(1.0), F.lit(0.0), -1.0).alias("fill"), fn.logit(F.lit(0.0)).alias("edge"),
        fn.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("c"))).alias("j"), fn.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("none"),
        fn.step_integral(F.array(*map(F.lit, (1.0, 2.0, 4.0))), F.array(*map(F.lit, (0.0, 1.0, 3.0)))).alias("step"), fn.interaction_ratio(F.lit(-17.7), F.lit(-8.4), F.lit(-7.8)).alias("ir"), fn.interaction_ratio(F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("nan"),
    ).first()
    assert d.lo == 0.0 and d.mid == 0.5 and d.fill == -1.0 and d.edge < -27 and d.j == pytest.approx(1 / 3) and d.none == 1.0
    assert d.step == 5.0 and d.ir == pytest.approx(0.9153, abs=1e-4) and math.isnan(d.nan)


def test_uniform_is_spread(spark):
    u = spark.range(20000).select(fn.uniform(F.col("id"), 1).alias("a"), fn.uniform(F.col("id"), 2).alias("b")).agg(F.avg("a"), F.avg("b"), F.corr("a", "b"), F.min("a"), F.max("a")).first()
    assert abs(u[0] - 0.5) < 0.02 and abs(u[1] - 0.5) < 0.02 and abs(u[2]) < 0.2 and 0 < u[3] < u[4] < 1


def test_merge_and_summary(spark, tmp_path):
    base = {"gate": {"depth": 3, "alpha": 0.1}, "name": "a"}
    assert config.merge(base, {"gate": {"depth": 5}, "name": "b"}) == {"gate": {"depth": 5, "alpha": 0.1}, "name": "b"} and base["gate"]["depth"] == 3
    for i in range(30):
        (tmp_path / f"f{i}").write_text("x" * (i + 1))
    files = manifest.manifest(spark, str(tmp_path))
    a, b = manifest.summary(files).first(), manifest.summary(files.repartition(7)).first()
    assert (a.files, a.bytes) == (30, sum(range(31))) and a.digest == b.digest
    (tmp_path / "f3").write_text("yyy")
    assert manifest.summary(manifest.manifest(spark, str(tmp_path))).first().digest != a.digest


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_sinks_round_trip(spark, tmp_path, fmt):
    d = spark.createDataFrame([(1, "a"), (2, None), (3, "c, d")], "k bigint, v string")
    for _ in range(2):
        sinks.write(d, str(tmp_path / fmt), fmt)
    assert sorted(map(tuple, sinks.read(spark, str(tmp_path / fmt), fmt, d.schema).collect()), key=str) == sorted(map(tuple, d.collect()), key=str)
    with pytest.raises(ValueError, match="none of"):
        sinks.write(d, str(tmp_path / "x"), "exe")


def test_flat_columns_and_text(spark):
    d = spark.sql("SELECT 1 AS a, named_struct('x', 2, 'y', named_struct('z', 'q')) AS b")
    flat = sinks.flatten(d)
    assert flat.columns == ["a", "b.x", "b.y.z"] and sinks.unflatten(flat).schema == d.schema and sinks.unflatten(flat).collect() == d.collect()
    assert sinks.to_text(flat) == "a  b.x  b.y.z\n1  2    q\n"
    with pytest.raises(ValueError, match="more than"):
        sinks.to_text(spark.range(sinks.SHOWN + 1))
    with pytest.raises(ValueError, match="missing columns: nope"):
        sinks.require(d, ["a", "nope"])


def test_intervals(spark):
    assert fn.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    lo, hi = fn.two_sided(F.lit(1.0), F.lit(0.5))
    d = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0)], "v double, w double").agg(fn.weighted_mean(F.col("v"), F.col("w")).alias("m"), fn.weighted_mean(F.col("v"), F.col("w") * 0, -1.0).alias("f"))
    r = d.select("m", "f", lo.alias("lo"), hi.alias("hi"), fn.one_sided_upper(F.lit(1.0), F.lit(0.5)).alias("up"), fn.excludes(lo, hi, F.lit(2.5)).alias("out")).first()
    assert (r.m, r.f, r.out) == (2.5, -1.0, True) and r.lo == pytest.approx(0.020018, abs=1e-6) and r.up == pytest.approx(1.822427, abs=1e-6)
