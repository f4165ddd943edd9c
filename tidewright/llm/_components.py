"""Connected components over a link table, wholly as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (id, component), component being the smallest id reachable.

    Each round passes the smallest label over every link, then jumps to the label's own
    label, so chains of length n take about log n rounds. Nothing but one count per
    round reaches the driver. Null ends, self links and repeated links are harmless.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    both = materialize(links.union(links.select("b", "a")), "links")
    label = materialize(
        both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "label"
    )
    for _ in range(most_rounds):
        near = both.join(label, both.b == label.id).groupBy(F.col("a").alias("id")).agg(
            F.min("component").alias("near")
        )
        step = label.join(near, "id").select(
            "id", F.col("component").alias("old"), F.least("component", "near").alias("new")
        )
        up = label.select(F.col("id").alias("new"), F.col("component").alias("above"))
        step = step.join(up, "new", "left").select(
            "id", "old", F.least("new", F.coalesce("above", "new")).alias("component")
        )
        step = materialize(step, "label")
        label = step.select("id", "component")
        if not step.where("old <> component").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle; raise most_rounds")
    return label
