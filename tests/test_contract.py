"""Record contracts: a bad row of each kind, several at once, columns that are missing, and panels read back."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import contract as C

GOOD = {
    "decision_id": 1, "patient_id": 7, "site": "A", "line_of_therapy": "first", "slide_source": "metastasis", "metastatic_pattern": "lung_only", "presentation": "synchronous", "sidedness": "right_sided",
    "modality_availability": "all_three", "assay_panel": "broad", "microsatellite_assay": "pcr", "backbone_regimen": "folfox", "age_years": 60.0, "prior_lines": 0, "organ_sites": 1, "albumin_g_per_l": 40.0,
    "ldh_ratio_to_upper_limit": 1.0, "cea_ng_per_ml": 3.0, "comorbidity_count": 0, "tile_count": 10, "tumour_purity": 0.5, "follow_up_months": 4.0, "ecog": 1, "female": True, "ras_mutant": True, "braf_v600e": False,
    "msi_high": False, "pi3k_altered": False, "event": True, "objective_response": False, "erbb2_amplified": "false", "kras_g12c": "true",
}
TYPES = {bool: "boolean", int: "bigint", float: "double", str: "string"}
SCHEMA = ", ".join(f"{k} {TYPES[type(v)]}" for k, v in GOOD.items())
BAD = [
    ({}, []), ({"site": "D"}, ["site: not declared"]), ({"site": None}, ["site: not declared"]), ({"line_of_therapy": "FIRST"}, ["line_of_therapy: not declared"]), ({"backbone_regimen": ""}, ["backbone_regimen: not declared"]),
    ({"age_years": 17.9}, ["age_years: out of bounds"]), ({"age_years": 18.0}, []), ({"age_years": None}, ["age_years: out of bounds"]), ({"age_years": float("nan")}, ["age_years: out of bounds"]), ({"tile_count": 0}, ["tile_count: out of bounds"]),
    ({"follow_up_months": 0.0}, ["follow_up_months: not positive"]), ({"follow_up_months": -1.0}, ["follow_up_months: out of bounds", "follow_up_months: not positive"]), ({"event": None}, ["event: no flag"]),
    ({"erbb2_amplified": None, "kras_g12c": None}, []), ({"erbb2_amplified": "perhaps"}, ["erbb2_amplified: no flag"]), ({"msi_high": True}, ["msi_high, ras_mutant: both"]), ({"msi_high": True, "ras_mutant": False}, []),
    ({"decision_id": None}, ["decision_id: no key"]), ({"site": "D", "organ_sites": 7, "kras_g12c": "?"}, ["site: not declared", "organ_sites: out of bounds", "kras_g12c: no flag"]), ({"msi_high": None}, ["msi_high: no flag"]),
]


def frame(spark):
    return spark.createDataFrame([tuple((GOOD | change).values()) for change, _ in BAD], SCHEMA).coalesce(1)


def test_reasons_of_each_kind(spark):
    d = frame(spark).withColumn("reasons", F.lit("clash"))
    assert [r.reasons for r in C.CLINICAL.check(d).collect()] == [want for _, want in BAD]
    assert C.CLINICAL.accepted(d).count() == sum(not want for _, want in BAD)
    counts = {r.reason: r.n for r in C.CLINICAL.rejects(d).collect()}
    flat = [x for _, want in BAD for x in (want or ["valid"])]
    assert counts == {x: flat.count(x) for x in flat}
    assert C.CLINICAL.rejects(d.limit(0)).count() == 0 and C.CLINICAL.check(d.limit(0)).count() == 0


def test_missing_columns_are_named_and_reject_every_row(spark):
    d = frame(spark).drop("site", "msi_high")
    assert C.CLINICAL.missing(d) == ("site", "msi_high") and C.CLINICAL.missing(frame(spark)) == () and C.CLINICAL.required[:3] == ("decision_id", "patient_id", "site")
    assert [r.reasons[:2] for r in C.CLINICAL.check(d).limit(1).collect()] == [["site: missing", "msi_high: missing"]] and C.CLINICAL.accepted(d).count() == 0


def test_one_pass_without_a_shuffle(spark):
    plan = C.CLINICAL.check(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("Coalesce", "")


def test_one_column_set(spark):
    d = frame(spark)
    assert C.one_column_set([d, d.select(*reversed(d.columns))]) == tuple(sorted(d.columns)) and C.one_column_set([]) == ()
    with pytest.raises(ValueError, match="table 1 differs in columns: site"):
        C.one_column_set([d, d.drop("site")])


def test_panels(spark):
    rows = [{}, {"erbb2_amplified": None}, {"msi_high": True}, {"braf_v600e": True, "kras_g12c": None}, {"ras_mutant": False}, {"kras_g12c": None, "ras_mutant": False}]
    d = spark.createDataFrame([tuple((GOOD | r).values()) for r in rows], SCHEMA).coalesce(1).withColumn("p", C.panel())
    got = d.select("p", C.fully_typed(F.col("p")).alias("typed"), C.stratum(F.col("p")).alias("stratum")).collect()
    assert [r.stratum for r in got] == ["ras_mutant_mss", "other_including_not_fully_typed", "msi_high", "braf_v600e", "ras_braf_wild_type_mss", "other_including_not_fully_typed"]
    assert [r.typed for r in got] == [True, False, True, False, True, False] and got[0].p.kras_g12c is True and got[1].p.erbb2_amplified is None and got[0].p.assay_panel == "broad"


def test_bands_and_availability(spark):
    d = spark.createDataFrame([("x", "y", 40.0, 1.5), (None, "y", 40.0, 2.0), ("x", None, 40.0, 0.0), ("x", "y", 0.0, 4.0), ("x", "y", None, 1.0)], "slide_source string, assay_panel string, albumin_g_per_l double, e double").coalesce(1)
    assert [(r.a, r.b) for r in d.select(C.availability().alias("a"), C.performance_band(F.col("e")).alias("b")).collect()] == [("all_three", 0), ("at_least_one_missing", 1), ("at_least_one_missing", 0), ("at_least_one_missing", 1), ("at_least_one_missing", 0)]
