"""Near-duplicate vectors by NN-descent, with exact links.

1. Equal vectors become one node with a weight.
2. Random-hyperplane codes put similar nodes next to each other; blocks of
   ``BLOCK`` neighbours in code order give the first neighbour lists. Blocks
   are cut from a sorted range partition, so a code that a third of all nodes
   share is cut like any other.
3. Rounds of local joins: the neighbours of a node, forward and reverse, are
   compared with each other, and lists take what is nearer. A list whose last
   entry is still a link is saturated; it may hold twice as many next round.
4. Pairs over the threshold (as a spanning forest of what a comparison has
   seen, never all pairs) give candidate components. Lists that are saturated
   to the end are enlarged to their whole component: tile by tile all pairs
   are compared in double precision, which keeps the true links, counts them
   and confirms the component.
5. An audit compares a hash sample with all nodes by brute force. The sample
   grows until it holds ``LINKED`` linked nodes of few links, which one large
   cluster cannot outweigh. Under ``RECALL`` of these nodes the search goes on
   with further hyperplanes; the number of orders grows with log2 of the nodes.
6. What ``PASSES`` passes leave under ``RECALL``, what an audit without so much
   evidence cannot judge, and a failed table of at most ``WHOLE`` nodes end in
   a comparison of all nodes with all, in waves of ``WAVE``. It is exact.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import merge_labels, scratch_dir, stored
from lodestone.llm.components import components

THRESHOLD, NEIGHBOURS, TREES, PLANES, BLOCK, ROUNDS = 0.9, 8, 3, 24, 256, 3
TILE, RECALL, PASSES = 1024, 0.97, 3
#: The audit's first sample and its bound; the linked nodes it must see that
#: have at most ``SMALL`` others in reach.
AUDIT, AUDIT_MOST, LINKED, SMALL = 512, 8192, 200, 32
#: Up to ``WHOLE`` nodes comparing all costs less than another pass.
WAVE, WHOLE = 4096, 1 << 16
#: Candidates come from single precision; the final comparison is exact.
_SLACK = 1e-5
_log = logging.getLogger(__name__)


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length, in double precision and of length one."""
    if not len(column):
        return np.zeros((0, 0))
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    raw = np.asarray(flat, dtype=np.float64).reshape(len(column), -1)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in keys], axis=1)
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(values)]):
            if held and (values[a] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = values[a]
    if held:
        yield pa.Table.from_batches(held)


def _nearest(unit: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its ``keep`` nearest others: row, other, cosine."""
    n = len(unit)
    if n < 2:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    keep = min(keep, n - 1)
    best = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
    rows = np.repeat(np.arange(n), keep)
    return rows, best.ravel(), sims[rows, best.ravel()]


def _forest(sims: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest that connects what the pairs over the threshold connect."""
    i, j = np.nonzero(sims >= threshold)
    keep = i < j
    if not keep.any():
        return np.zeros(0, int), np.zeros(0, int)
    label = merge_labels(len(sims), i[keep], j[keep])
    linked = np.flatnonzero(label != np.arange(len(sims)))
    return linked, label[linked]


def _pairs(src, dst, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(np.asarray(sim, dtype=np.float64))], ["src", "dst", "sim"])


_PAIR = "src long, dst long, sim double"


#: A hash of vectors that gives two different ones the same number is replaced
#: by another; so many are tried (at a billion different vectors one in 40 fails).
HASHES = 8


def nodes_of(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """``rows(vec_id, node)`` for all rows, ``nodes(node, least_id, weight, dim, v)``.

    Equal vectors are one node; they are compared themselves, not their hash."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    for seed in range(HASHES):
        name = F.xxhash64("v", F.lit(seed)) if seed else F.xxhash64("v")
        named = rows.select("vec_id", F.when(usable, name).alias("node"), "v")
        nodes = named.where("node is not null").groupBy("node", "v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"))
        nodes = stored(nodes.select("node", "least_id", "weight", "v", F.size("v").alias("dim")), "nodes")
        if nodes.groupBy("node").count().where("count > 1").isEmpty():
            return named.select("vec_id", "node"), nodes
    raise RuntimeError("too many different vectors for a 64-bit number each")


def _orders(size: int) -> int:
    """``TREES`` up to 4,096 nodes, one more for each doubling."""
    return TREES + max(0, (size - 1).bit_length() - 12)


def _first_lists(nodes: DataFrame, seed: int, keep: int, threshold: float, trees: int = TREES) -> DataFrame:
    def code(batches):
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                unit = _units(part.column("v"))
                for tree in range(trees):
                    planes = np.random.default_rng([seed, tree, int(dim)]).standard_normal((int(dim), PLANES))
                    bits = (unit @ planes > 0).astype(np.int64) @ (1 << np.arange(PLANES, dtype=np.int64))[::-1]
                    yield pa.RecordBatch.from_arrays([part.column("node"), part.column("dim"), pa.array(np.full(len(unit), tree, np.int32)), pa.array(bits), part.column("v")], ["node", "dim", "tree", "code", "v"])

    def compare(batches):
        for table in _runs(batches, ["dim", "tree"]):
            for at in range(0, table.num_rows, BLOCK):
                part = table.slice(at, BLOCK)
                unit, name = _units(part.column("v")).astype(np.float32), np.asarray(part.column("node"))
                i, j, s = _nearest(unit, keep)
                yield _pairs(name[i], name[j], s)
                a, b = _forest(unit @ unit.T, threshold - _SLACK)
                if len(a):
                    yield _pairs(name[a], name[b], np.full(len(a), 3.0))

    coded = nodes.select("node", "dim", "v").mapInArrow(code, "node long, dim int, tree int, code long, v array<double>")
    ordered = coded.repartitionByRange("dim", "tree", "code", "node").sortWithinPartitions("dim", "tree", "code", "node")
    return ordered.mapInArrow(compare, _PAIR)


def _best(found: DataFrame, keep: int, threshold: float, rounds: int) -> DataFrame:
    """Lists of the nearest; saturated ones may hold more, doubled each round."""
    order = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    ranked = found.groupBy("src", "dst").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep << rounds)
    return ranked.where((F.col("rank") <= keep) | (F.col("sim") >= threshold - _SLACK))


def _local_join(nodes: DataFrame, lists: DataFrame, keep: int, threshold: float) -> DataFrame:
    kth = lists.groupBy("src").agg(F.min("sim").alias("kth"))
    info = nodes.select("node", "dim", "v").join(kth.withColumnRenamed("src", "node"), "node", "left")
    member = lists.select(F.col("src").alias("centre"), F.col("dst").alias("node"))
    reverse = lists.where(F.col("rank") <= keep).select(F.col("dst").alias("centre"), F.col("src").alias("node"))
    # A node that very many others list: its reverse neighbours form blocks by hash.
    salt = F.pmod(F.xxhash64("node"), F.lit(1 << 20))
    order = Window.partitionBy("centre").orderBy(salt, "node")
    reverse = reverse.withColumn("part", F.floor((F.row_number().over(order) - 1) / (4 * keep)).cast("int"))
    parts = reverse.groupBy("centre").agg(F.max("part").alias("last"))
    forward = member.join(parts, "centre", "left").select("centre", "node", F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0)))).alias("part"))
    groups = forward.union(reverse.select("centre", "node", "part")).distinct()
    rows = groups.join(info, "node").select("centre", "part", "node", "dim", "kth", "v")

    def compare(batches):
        for table in _runs(batches, ["centre", "part"]):
            unit, name, least = _units(table.column("v")).astype(np.float32), np.asarray(table.column("node")), np.asarray(table.column("kth").fill_null(-2.0))
            sims = unit @ unit.T
            i, j = np.nonzero(sims > least[:, None])
            near = name[i] != name[j]
            i, j = i[near], j[near]
            if len(i):
                order = np.lexsort((-sims[i, j], i))
                i, j = i[order], j[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[rank < keep], j[rank < keep]
                yield _pairs(name[i], name[j], sims[i, j])
            a, b = _forest(sims, threshold - _SLACK)
            if len(a):
                yield _pairs(name[a], name[b], np.full(len(a), 3.0))

    # All vectors of a node's neighbourhood have its length, as lists never mix lengths.
    dealt = rows.repartition("centre", "part").sortWithinPartitions("centre", "part", "node")
    return dealt.mapInArrow(compare, _PAIR)


def _exact(nodes: DataFrame, candidates: DataFrame, threshold: float, tile: int) -> DataFrame:
    """True links inside candidate components: ``(kind, a, b)`` with kind 0 for
    a forest link a-b and kind 1 for b links counted at node a."""
    named = stored(components(candidates), "candidates")
    sizes = named.groupBy("component").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    rows = nodes.join(named, "node").join(sizes, "component").select("component", "node", "weight", "v", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("far"))
    dealt = rows.select("component", F.least("own", "far").alias("one"), F.greatest("own", "far").alias("two"), (F.col("own") > F.col("far")).alias("second"), "node", "weight", "v")
    keys = ["component", "one", "two"]

    def compare(batches):
        for table in _runs(batches, keys):
            second = np.asarray(table.column("second")).astype(bool)
            unit, name, weight = _units(table.column("v")), np.asarray(table.column("node")), np.asarray(table.column("weight"))
            same = table.column("one")[0] == table.column("two")[0]
            rows_, cols = (np.arange(len(name)),) * 2 if same else (np.flatnonzero(~second), np.flatnonzero(second))
            label, links = np.arange(len(name)), np.zeros(len(name), np.int64)
            for at in range(0, len(rows_), tile):
                some = rows_[at : at + tile]
                hit = unit[some] @ unit[cols].T >= threshold
                hit &= some[:, None] != cols[None, :]
                links[some] += hit @ weight[cols]
                if not same:
                    links[cols] += weight[some] @ hit
                i, j = np.nonzero(hit)
                if len(i):
                    label = merge_labels(len(name), some[i], cols[j], label)
            linked, counted = np.flatnonzero(label != np.arange(len(name))), np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [len(linked), len(counted)]).astype(np.int32)), pa.array(np.concatenate([name[linked], name[counted]])), pa.array(np.concatenate([name[label[linked]], links[counted]]))], ["kind", "a", "b"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "kind int, a long, b long")


def _all_links(nodes: DataFrame, size: int, threshold: float) -> DataFrame:
    """As ``_exact``, for all nodes: each wave of nodes travels to all others,
    whose vectors stay where they are."""
    waves = max(1, -(-size // WAVE))
    path = f"{scratch_dir(nodes.sparkSession)}/all"
    schema = "kind int, a long, b long"
    for k in range(waves):
        picked = nodes.where(F.pmod(F.xxhash64("node", F.lit("wave")), F.lit(waves)) == k).select("node", "dim", "v").toPandas()
        by_dim = {int(d): (_units(pa.array(g["v"])), g["node"].to_numpy()) for d, g in picked.groupby("dim")}

        def compare(batches, by_dim=by_dim):
            label = {d: np.arange(len(name)) for d, (_, name) in by_dim.items()}
            links = {d: np.zeros(len(name), np.int64) for d, (_, name) in by_dim.items()}
            for batch in batches:
                dims = np.asarray(batch.column("dim"))
                for dim in set(np.unique(dims).tolist()) & by_dim.keys():
                    same = batch.filter(pa.array(dims == dim))
                    unit, name = by_dim[dim]
                    for at in range(0, same.num_rows, TILE):
                        part = same.slice(at, TILE)
                        other = np.asarray(part.column("node"))
                        i, j = np.nonzero((unit @ _units(part.column("v")).T >= threshold) & (name[:, None] != other[None, :]))
                        if len(i):
                            links[dim] += np.bincount(i, np.asarray(part.column("weight"))[j], len(name)).astype(np.int64)
                            before = np.concatenate([label[dim], len(name) + np.arange(len(other))])
                            after = merge_labels(len(before), i, len(name) + j, before)
                            new, both = np.flatnonzero(after != before), np.concatenate([name, other])
                            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(new), np.int32)), pa.array(both[new]), pa.array(both[after[new]])], ["kind", "a", "b"])
                            label[dim] = after[: len(name)]
            for dim, (_, name) in by_dim.items():
                some = np.flatnonzero(links[dim])
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(some), np.int32)), pa.array(name[some]), pa.array(links[dim][some])], ["kind", "a", "b"])

        nodes.select("node", "dim", "v", "weight").mapInArrow(compare, schema).write.mode("append").parquet(path)
    return nodes.sparkSession.read.schema(schema).parquet(path)


def _counts(exact: DataFrame) -> DataFrame:
    return stored(exact.where("kind = 1").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n_links")), "counts")


def _true_links(nodes: DataFrame, picked, threshold: float) -> DataFrame:
    """For each picked node with links ``(node, n, others)``: its links, and the
    nodes they lead to, by brute force."""
    by_dim = {int(d): (g.index.to_numpy(), _units(pa.array(g["v"])), g["node"].to_numpy()) for d, g in picked.groupby("dim")}
    names = picked["node"].to_numpy()

    def count(batches):
        total, others = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in set(np.unique(dims).tolist()) & by_dim.keys():
                same = batch.filter(pa.array(dims == dim))
                index, unit, name = by_dim[dim]
                for at in range(0, same.num_rows, TILE):
                    part = same.slice(at, TILE)
                    i, j = np.nonzero((unit @ _units(part.column("v")).T >= threshold) & (name[:, None] != np.asarray(part.column("node"))[None, :]))
                    total[index] += np.bincount(i, np.asarray(part.column("weight"))[j], len(name)).astype(np.int64)
                    others[index] += np.bincount(i, minlength=len(name))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total), pa.array(others)], ["node", "n", "others"])

    found = nodes.select("node", "dim", "v", "weight").mapInArrow(count, "node long, n long, others long")
    return found.groupBy("node").agg(F.sum("n").alias("n"), F.sum("others").alias("others")).where("n > 0")


def evidence(nodes: DataFrame, size: int, threshold: float = THRESHOLD) -> tuple[list, bool]:
    """``(node, n, others)`` for the linked nodes of a hash sample, and whether
    they say enough: ``LINKED`` of them have few links, or all nodes are in."""
    parts = max(1, size // AUDIT)
    part = F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(parts))
    rows, done, upto = [], 0, 1
    while True:
        picked = nodes.where((part >= done) & (part < upto)).select("node", "dim", "v").toPandas()
        if not picked.empty:
            rows += _true_links(nodes, picked, threshold).collect()
        enough = upto >= parts or sum(r.others <= SMALL for r in rows) >= LINKED
        if enough or upto >= AUDIT_MOST // AUDIT:
            return rows, enough
        done, upto = upto, min(2 * upto, parts, AUDIT_MOST // AUDIT)


def audit(rows: list, enough: bool, counts: DataFrame) -> float:
    """Share of the sampled linked nodes whose links ``counts(node, n_links)``
    has to the last one: the lesser of the shares among nodes of few links and
    among the others. 0 without enough evidence."""
    if not enough or not rows:
        return float(enough)
    truth = counts.sparkSession.createDataFrame([tuple(r) for r in rows], "node long, n long, others long")
    whole = F.avg((F.coalesce("n_links", F.lit(0)) >= F.col("n")).cast("double"))
    shares = truth.join(counts, "node", "left").groupBy(F.col("others") <= SMALL).agg(whole.alias("share")).collect()
    return min(r.share for r in shares)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, keep: int = NEIGHBOURS, rounds: int = ROUNDS, tile: int = TILE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows with a null id, link with nothing and are their own component.
    Vectors of different lengths do not link. Repeated rows count as vectors of
    their own: copies link to each other. An empty table gives an empty one.
    """
    rows, nodes = nodes_of(vectors, id_col, vec_col)
    pairs, lists = None, None
    size = nodes.count()
    linked_rows, enough = evidence(nodes, size, threshold)
    for attempt in range(PASSES):
        found = _first_lists(nodes, attempt, keep, threshold, _orders(size))
        found = stored(found if lists is None else found.unionByName(lists.select("src", "dst", "sim")), "found")
        pairs = found.where(F.col("sim") >= threshold - _SLACK).select("src", "dst") if pairs is None else pairs.union(found.where(F.col("sim") >= threshold - _SLACK).select("src", "dst"))
        lists = stored(_best(found.where("sim < 2.5"), keep, threshold, 0), "lists")
        total = lists.count()
        for k in range(1, rounds + 1):
            more = stored(_local_join(nodes, lists, keep, threshold), "joined")
            pairs = pairs.union(more.where(F.col("sim") >= threshold - _SLACK).select("src", "dst"))
            before = lists
            lists = stored(_best(more.where("sim < 2.5").union(before.select("src", "dst", "sim")), keep, threshold, k), "lists")
            if lists.join(before, ["src", "dst"], "left_anti").count() < 0.01 * total:
                break
        exact = stored(_exact(nodes, pairs, threshold, tile), "exact")
        counts = _counts(exact)
        recall = audit(linked_rows, enough, counts)
        _log.info("audited recall %.4f after pass %d", recall, attempt + 1)
        if recall >= RECALL:
            break
        if not enough or size <= WHOLE or attempt + 1 == PASSES:
            _log.info("comparing all %d nodes", size)
            exact = _all_links(nodes, size, threshold)
            counts = _counts(exact)
            break
    joined = components(exact.where("kind = 0").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    rooted = nodes.select("node", "least_id", "weight").join(joined, "node", "left").join(counts, "node", "left")
    rooted = stored(rooted.select("node", "least_id", (F.col("weight") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = stored(rooted.join(least, "root").select("node", "n_links", "component_id"), "named")
    linked = rows.where("node is not null").join(named, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
