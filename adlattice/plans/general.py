"""Queries of the general data-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adlattice.operators import instants, quantities
from adlattice.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    clocks = instants.board_clocks(table(spark, d, "source_platform"), table(spark, d, "source_clock"))
    return instants.found(table(spark, d, "jobs"), clocks)


def p3_unread(spark: SparkSession, d: str) -> DataFrame:
    """The values that fix no instant, with the reason."""
    clocks = instants.board_clocks(table(spark, d, "source_platform"), table(spark, d, "source_clock"))
    return instants.unread(table(spark, d, "jobs"), clocks)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return quantities.found(table(spark, d, "jobs"), table(spark, d, "pay_period"))


QUERIES = {"p3_found": p3_found, "p3_unread": p3_unread, "p5_found": p5_found}
