"""Connected components of an edge table, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.labelled import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a and b); label is the smallest node of its component.

    Every round gives a node the smallest label among itself and its neighbours, gives the node that a label names the
    smallest label that its bearers found, and then takes the label of that label. So whole labelled regions join at
    once, and the rounds do not grow with the length of a chain. Labels only fall, and the search ends when none does:
    then neighbours have equal labels, and the smallest node of a component, which keeps its own, has given it to all.
    Labels are met by aggregation, which combines before it shuffles, so a node may have any number of edges.
    """
    both = stored(
        edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels"
    )
    while True:
        seen = labels.select(F.col("node").alias("b"), "label")
        nearest = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lowered = labels.join(nearest, "node").select("node", "label", F.least("label", "near").alias("low"))
        lowered = stored(lowered, "lowered")
        found = lowered.groupBy(F.col("label").alias("node")).agg(F.min("low").alias("found"))
        hooked = lowered.join(found, "node", "left").select(
            "node", "label", F.least("low", F.coalesce("found", "low")).alias("low")
        )
        hooked = stored(hooked, "hooked")
        jump = hooked.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        after = stored(
            hooked.join(jump, "low", "left").select(
                "node", F.col("label").alias("was"), F.least("low", F.coalesce("lower", "low")).alias("label")
            ),
            "labels",
        )
        labels = after.select("node", "label")
        if after.filter("was <> label").isEmpty():
            return labels
