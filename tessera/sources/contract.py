"""Record contracts: what a table must hold, stated as data and checked in one pass over it, with every reason of every row.

A contract compiles to column expressions inside the scan: no shuffle, and no second look at a row for another rule.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """The columns that a table must have and what each may hold.

    domains: the values of a column, none of them null. bounds: least and largest value of a number. flags: true or false, tri_state ones
    also null, for what was not tested. positive: numbers above zero. excluded: pairs of flags that are never both true.
    """

    domains: Mapping[str, tuple] = field(default_factory=dict)
    bounds: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    flags: tuple[str, ...] = ()
    tri_state: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    excluded: tuple[tuple[str, str], ...] = ()
    keys: tuple[str, ...] = ()

    @property
    def required(self) -> tuple[str, ...]:
        """Every column that the contract names, in its order."""
        named = [*self.keys, *self.domains, *self.bounds, *self.flags, *self.tri_state, *self.positive, *(c for pair in self.excluded for c in pair)]
        return tuple(dict.fromkeys(named))

    def missing(self, df: DataFrame) -> tuple[str, ...]:
        return tuple(c for c in self.required if c not in df.columns)

    def reasons(self, df: DataFrame) -> Column:
        """array<string>: what is wrong with a row, in the contract's order; empty if nothing is. Columns that df lacks are wrong in every row.

        Numbers that don't read as one, and nulls where none may be, are outside of every domain and bound.
        """
        absent = set(self.missing(df))
        rules: list[tuple[str, str, Column]] = []
        number = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)")
        flag = lambda c: F.expr(f"try_cast(`{c}` AS BOOLEAN)")
        rules += [(c, "no key", F.col(f"`{c}`").isNotNull()) for c in self.keys if c not in absent]
        rules += [(c, "not declared", F.col(f"`{c}`").isin(*values)) for c, values in self.domains.items() if c not in absent]
        rules += [(c, "out of bounds", number(c).between(low, high)) for c, (low, high) in self.bounds.items() if c not in absent]
        rules += [(c, "no flag", flag(c).isNotNull()) for c in self.flags if c not in absent]
        rules += [(c, "no flag", F.col(f"`{c}`").isNull() | flag(c).isNotNull()) for c in self.tri_state if c not in absent]
        rules += [(c, "not positive", number(c) > 0) for c in self.positive if c not in absent]
        rules += [(f"{a}, {b}", "both", ~(flag(a) & flag(b))) for a, b in self.excluded if not absent & {a, b}]
        # A rule that can't be decided isn't kept, but flags that are missing exclude nothing.
        kept = lambda what, rule: F.coalesce(rule, F.lit(what == "both"))
        named = [F.when(~kept(what, rule), F.lit(f"{name}: {what}")) for name, what, rule in rules]
        return F.filter(F.array(*[F.lit(f"{c}: missing") for c in self.missing(df)], *named, F.lit(None).cast("string")), lambda x: x.isNotNull())

    def check(self, df: DataFrame, into: str = "reasons") -> DataFrame:
        """df with its rows' reasons, under a name that replaces a column of that name. No row goes; an empty table stays one."""
        return df.withColumn(into, self.reasons(df))

    def accepted(self, df: DataFrame) -> DataFrame:
        return df.where(F.size(self.reasons(df)) == 0)

    def rejects(self, df: DataFrame) -> DataFrame:
        """(reason, n): rows by reason, one with several counted for each, and under ``valid`` those without any."""
        r = F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("valid")))
        return df.select(self.reasons(df).alias("reasons")).select(F.explode(r).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def one_column_set(tables: list[DataFrame]) -> tuple[str, ...]:
    """The columns of all tables, sorted; an error names what a table has or lacks beside the first."""
    first = set(tables[0].columns) if tables else set()
    for i, t in enumerate(tables[1:], 1):
        if odd := first ^ set(t.columns):
            raise ValueError(f"table {i} differs in columns: {', '.join(sorted(odd))}")
    return tuple(sorted(first))


# The declared domains and bounds of a decision record.
CLINICAL = Contract(
    keys=("decision_id", "patient_id"),
    domains={
        "site": ("A", "B", "C"), "line_of_therapy": ("first", "second", "third_plus"), "slide_source": ("primary_resection", "primary_biopsy", "metastasis"),
        "metastatic_pattern": ("liver_limited", "lung_only", "multi_organ"), "presentation": ("synchronous", "metachronous"), "sidedness": ("right_sided", "left_sided_including_rectum"),
        "modality_availability": ("all_three", "at_least_one_missing"), "assay_panel": ("narrow", "intermediate", "broad"), "microsatellite_assay": ("pcr", "ihc"),
        "backbone_regimen": ("folfox", "folfiri", "folfoxiri", "capox", "trifluridine-tipiracil", "regorafenib"),
    },
    bounds={
        "age_years": (18, 105), "prior_lines": (0, 8), "organ_sites": (1, 6), "albumin_g_per_l": (15, 55), "ldh_ratio_to_upper_limit": (0.2, 8), "cea_ng_per_ml": (0, 5000),
        "comorbidity_count": (0, 12), "tile_count": (1, 200000), "tumour_purity": (0, 1), "follow_up_months": (0, 120), "ecog": (0, 4),
    },
    flags=("female", "ras_mutant", "braf_v600e", "msi_high", "pi3k_altered", "event", "objective_response"),
    tri_state=("erbb2_amplified", "kras_g12c"),
    positive=("follow_up_months",),
    excluded=(("msi_high", "ras_mutant"),),
)
PANEL = ("ras_mutant", "braf_v600e", "msi_high", "pi3k_altered", "erbb2_amplified", "kras_g12c")


def panel() -> Column:
    """The molecular panel of a flat record as one struct: its flags, those that weren't tested null, and its two assays."""
    return F.struct(*[F.col(c).cast("boolean").alias(c) for c in PANEL], F.col("assay_panel").cast("string").alias("assay_panel"), F.col("microsatellite_assay").cast("string").alias("microsatellite_assay"))


def fully_typed(p: Column) -> Column:
    return p["erbb2_amplified"].isNotNull() & p["kras_g12c"].isNotNull()


def stratum(p: Column) -> Column:
    """The panel's stratum, in order of precedence: a panel that isn't fully typed is never taken for the wild type."""
    return F.when(p["msi_high"], "msi_high").when(p["braf_v600e"], "braf_v600e").when(~fully_typed(p), "other_including_not_fully_typed").when(p["ras_mutant"], "ras_mutant_mss").otherwise("ras_braf_wild_type_mss")


def performance_band(value: Column) -> Column:
    """Performance status, collapsed at two."""
    return F.when(value < 2, 0).otherwise(1)


def availability() -> Column:
    """Whether a record has all three modalities: a slide, an assay and a record with albumin."""
    missing = F.col("slide_source").isNull() | F.col("assay_panel").isNull() | (F.coalesce(F.col("albumin_g_per_l").cast("double"), F.lit(0.0)) <= 0)
    return F.when(missing, "at_least_one_missing").otherwise("all_three")
