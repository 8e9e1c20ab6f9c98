"""Admission policies and their later confirmation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorgrid.functions.cells import STRUCTURAL_LABELS, SUPPORT_SURFACE_LABELS, label_group
from spoorgrid.operators.vote import CELL


def cell_labels(labels: DataFrame, prefix: str) -> DataFrame:
    """Dominant label and frame support per cell of a label store."""
    return labels.groupBy(*CELL).agg(F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias(prefix + "label"),
                                     F.sum("n").alias(prefix + "support"))


def _judged(current: DataFrame, future: DataFrame, lookup: DataFrame) -> DataFrame:
    j = cell_labels(current, "").join(lookup, CELL, "left")
    return j.join(cell_labels(future, "future_"), CELL, "left")


def update_safety_cells(current, future, lookup, min_support=3, min_stability=0.70, min_evidence=3) -> DataFrame:
    """One row per current cell and accepting policy: naive, semantic_static, stable_static, persistent_label."""
    j = _judged(current, future, lookup)
    static = label_group("label") == 0
    stable = (static & F.col("evidence").isNotNull() & (F.col("dominant_group") == 0)
              & (F.col("stability") >= F.lit(min_stability)) & (F.col("evidence") >= min_evidence))
    persistent = stable & (F.col("support") >= min_support) & (F.col("dominant_label") == F.col("label"))
    return _explode(j, {"naive": F.lit(True), "semantic_static": static, "stable_static": stable,
                        "persistent_label": persistent}, static)


def structural_safety_cells(current, future, lookup, min_support=3, min_stability=0.70, min_evidence=3) -> DataFrame:
    """As above under the class prior: naive, current_static, persistent_static, structural_persistent."""
    j = _judged(current, future, lookup)
    static = F.col("label").isin(*STRUCTURAL_LABELS, *SUPPORT_SURFACE_LABELS)
    known = (static & (F.col("dominant_label") == F.col("label")) & (F.col("stability") >= F.lit(min_stability))
             & (F.col("evidence") >= min_evidence) & (F.col("support") >= min_support))
    return _explode(j, {"naive": F.lit(True), "current_static": static, "persistent_static": known,
                        "structural_persistent": known & F.col("label").isin(*STRUCTURAL_LABELS)},
                    label_group("label") == 0)


def _explode(judged: DataFrame, policies: dict, confirmable) -> DataFrame:
    names = F.array(*[F.struct(F.lit(n).alias("policy"), F.coalesce(c, F.lit(False)).alias("accepted"))
                      for n, c in policies.items()])
    confirmed = F.when(F.col("future_label").isNotNull(), confirmable & (F.col("future_label") == F.col("label")))
    return judged.select(*CELL, "label", confirmed.alias("confirmed"), F.inline(names))


def safety_report(cells: DataFrame, by_label: bool = False) -> DataFrame:
    """Coverage, later observation, confirmation and contradiction per policy (and label of observed cells)."""
    seen = F.col("accepted") & F.col("confirmed").isNotNull()
    yes = F.col("accepted") & F.coalesce("confirmed", F.lit(False))
    if by_label:
        return cells.where(seen).groupBy("policy", "label").agg(
            F.count("*").alias("observed_cells"), F.count_if("confirmed").alias("confirmed_cells"))
    n_seen = F.greatest(F.count_if(seen), F.lit(1))
    return cells.groupBy("policy").agg(
        F.count_if("accepted").alias("accepted_cells"),
        (F.count_if("accepted") / F.greatest(F.count("*"), F.lit(1))).alias("coverage"),
        F.count_if(seen).alias("observed_cells"), F.count_if(yes).alias("confirmed_cells"),
        (F.count_if(yes) / n_seen).alias("confirmation_rate"),
        ((F.count_if(seen) - F.count_if(yes)) / n_seen).alias("contradiction_rate"))
