"""Near-duplicate postings (problem 7).

Method: SuperMinHash signatures of the sets of k-word runs, banding, verification and union-find
grouping. Copies collapse to one node (the number of their set); candidate links between nodes are verified
exactly, and verified links are united to groups. The bands alone find nearly every pair at the threshold (see
:class:`adlattice.llm.keyruns.Plan`), so nothing is compared all against all, neither in a group nor in a window.

Defined results: rows without an advert (NULL, blank, 'N/A', 'Error: <Type>', residue) never take part;
equal texts are always together; texts of fewer than k words are one run; texts of signs or tags alone, without a word,
are equal; texts are read whole; repeated keys are one row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlattice.llm import keyruns as kr
from adlattice.llm import residue
from adlattice.llm.components import connected_components
from adlattice.session import cut


class NearDuplicates:
    """The relations of one run: ``records (rec, sh)``, ``pairs (a, b)`` between different sets, ``components``."""

    def __init__(self, jobs: DataFrame, plan: kr.Plan | None = None, model: residue.Model | None = None):
        self.plan = plan or kr.Plan()
        model = model or residue.fit(jobs)
        base = jobs.filter(residue.advert_column())
        rows = base.select(F.col("internal_id").alias("rec"), F.col("internal_id").alias("ord"), "name", "description")
        labels = kr.range_labels(kr.ranges_for(jobs.count()))
        found, records = kr.split_links(cut(kr.links_and_records(kr.texts_to_run(rows, model, self.plan, labels), self.plan, len(labels))))
        self.records = records.select("rec", "sh")
        found = cut(found)
        nodes = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = kr.exact_sets(kr.needed_texts(self.records, nodes, base.select(F.col("internal_id").alias("rec"), "description")), self.plan)
        self.pairs = cut(kr.verified(found, sets.dropDuplicates(["sh"]), self.plan))

    @cached_property
    def components(self) -> DataFrame:
        """``(node, component)`` of the verified links, by union-find in rounds of large and small stars."""
        return connected_components(self.pairs)


def found(jobs: DataFrame, plan: kr.Plan | None = None) -> DataFrame:
    """All pairs of rows whose sets of runs reach the threshold, ``id_a < id_b``; copies count."""
    near = NearDuplicates(jobs, plan)
    rec = near.records
    copies = rec.join(rec.groupBy("sh").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("sh"), "sh", "left_semi")
    a, b = copies.select("sh", F.col("rec").alias("id_a")), copies.select("sh", F.col("rec").alias("id_b"))
    same = a.join(b, "sh").filter("id_a < id_b").select("id_a", "id_b")
    x = near.pairs.join(rec.select(F.col("sh").alias("a"), F.col("rec").alias("x")), "a")
    y = x.join(rec.select(F.col("sh").alias("b"), F.col("rec").alias("y")), "b")
    return same.unionByName(y.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")))


def groups(jobs: DataFrame, plan: kr.Plan | None = None) -> DataFrame:
    """One row ``(internal_id, class_id, links)`` per advert: its group (smallest row of it) and its number of links."""
    near = NearDuplicates(jobs, plan)
    copies = near.records.groupBy("sh").agg(F.count(F.lit(1)).alias("copies"), F.min("rec").alias("low"))
    linked = near.pairs.select(F.explode(F.array(F.struct(F.col("a").alias("sh"), F.col("b").alias("other")), F.struct(F.col("b").alias("sh"), F.col("a").alias("other")))).alias("p")).select("p.*")
    other = linked.join(copies.select(F.col("sh").alias("other"), "copies"), "other").groupBy("sh").agg(F.sum("copies").alias("others"))
    per_set = copies.join(near.components.withColumnRenamed("node", "sh"), "sh", "left").join(other, "sh", "left").withColumn("component", F.coalesce("component", "sh"))
    classes = per_set.groupBy("component").agg(F.min("low").alias("class_id"))
    full = per_set.join(classes, "component").select("sh", "class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return near.records.join(full, "sh").select(F.col("rec").alias("internal_id"), "class_id", "links")
