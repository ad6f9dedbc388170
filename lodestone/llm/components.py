"""Connected components of a link table, without a driver-side union-find.

Every round each node picks the neighbour (or itself) of least random
priority and the links are contracted along the choice, which removes a
constant share of the nodes whatever the shape of the graph: long chains with
ascending ids do not need as many rounds as they have nodes. Each round is two
shuffles over a shrinking table that is written to the shared folder. Once
the contracted table is below ``FINISH_LINKS`` rows one executor task ends it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import merge_labels, stored

#: A contracted table up to this many links is finished by one task (16 MB).
FINISH_LINKS = 1_000_000


def _finish(table: pa.Table) -> pa.Table:
    a, b = (np.asarray(table.column(c)) for c in ("src", "dst"))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = merge_labels(len(nodes), at[: len(a)], at[len(a) :])
    return pa.table({"node": nodes, "root": nodes[label]})


def components(links: DataFrame, finish_links: int = FINISH_LINKS) -> DataFrame:
    """``(node, component)`` for every node of ``links(src long, dst long)``.

    ``component`` is the smallest node reachable. Self-links, repeated links
    and links with a null end are ignored; an empty table gives an empty one.
    """
    ends = links.where("src is not null and dst is not null and src <> dst")
    edges = stored(ends.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "links")
    steps: list[DataFrame] = []
    while True:
        n = edges.count()
        if n <= finish_links:
            steps.append(stored(edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_finish, "node long, root long"), "finish"))
            break
        own = F.xxhash64("src", F.lit(len(steps)))
        both = edges.union(edges.select("dst", "src"))
        chosen = both.groupBy("src").agg(F.min(F.struct(F.xxhash64("dst", F.lit(len(steps))).alias("rank"), F.col("dst").alias("to"))).alias("best"))
        step = stored(chosen.select(F.col("src").alias("node"), F.when(F.col("best.rank") < own, F.col("best.to")).otherwise(F.col("src")).alias("root")), "step")
        steps.append(step)
        a, b = (step.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("src", "dst"))
        moved = edges.join(a, "src").join(b, "dst").where("src_root <> dst_root")
        edges = stored(moved.select(F.least("src_root", "dst_root").alias("src"), F.greatest("src_root", "dst_root").alias("dst")).distinct(), "links")
    labels = steps[0]
    for step in steps[1:]:
        onward = step.select(F.col("node").alias("root"), F.col("root").alias("next_root"))
        labels = labels.join(onward, "root", "left").select("node", F.coalesce("next_root", "root").alias("root"))
    if len(steps) == 1:
        return labels.select("node", F.col("root").alias("component"))
    labels = stored(labels, "labels")
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(least, "root").select("node", "component")
