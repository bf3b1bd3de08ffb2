"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adlattice.llm import canonical, history, mixing, names, near, packing, quality, residue
from adlattice.sources.tables import table


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return canonical.found(table(s, d, "jobs"), table(s, d, "location_ref"), table(s, d, "job_class"), canonical.aliases(s))


def p1_unmatched(s: SparkSession, d: str) -> DataFrame:
    """The distinct values without an entry, with their number of rows."""
    rows = canonical.cases(table(s, d, "jobs"), table(s, d, "location_ref"), table(s, d, "job_class"))
    none = p1_found(s, d).filter("ref_id = 0").select("internal_id", "field")
    return rows.join(none, ["internal_id", "field"], "left_semi").groupBy("field", "value").count()


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return names.found(table(s, d, "jobs"))


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return residue.found(table(s, d, "jobs"))


def p4_validation(s: SparkSession, d: str) -> DataFrame:
    """Precision and recall on each board of a model that has not seen the board."""
    return residue.validation(table(s, d, "jobs"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return history.found(table(s, d, "jobs"), table(s, d, "jobs_raw"))


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return near.found(table(s, d, "jobs"))


def p7_groups(s: SparkSession, d: str) -> DataFrame:
    return near.groups(table(s, d, "jobs"))


def p8_containers(s: SparkSession, d: str) -> DataFrame:
    limits = table(s, d, "pack_limit")
    return packing.containers(packing.pack(table(s, d, "documents"), limits), limits)


def p8_members(s: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(s, d, "documents"), table(s, d, "pack_limit"))


def p8_summary(s: SparkSession, d: str) -> DataFrame:
    return packing.summary(p8_containers(s, d))


def p8_tiers(s: SparkSession, d: str) -> DataFrame:
    return packing.by_tier(p8_containers(s, d))


def p9_mix(s: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(s, d, "documents"), table(s, d, "mix_target"))[0]


def p9_shares(s: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(s, d, "documents"), table(s, d, "mix_target"))[1]


def p10_found(s: SparkSession, d: str) -> DataFrame:
    return quality.found(table(s, d, "documents"))


def p10_statistics(s: SparkSession, d: str) -> DataFrame:
    return quality.measure(table(s, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_unmatched, p2_found, p4_found, p4_validation, p6_found, p7_found, p7_groups, p8_containers, p8_members, p8_summary, p8_tiers, p9_mix, p9_shares, p10_found, p10_statistics)
}
SQL: dict[str, str] = {}
