"""Traversals and graph analytics over node and edge DataFrames.

Bounded traversals are loops of joins over a frontier; a level that is read more than once is cut from its lineage with a
checkpoint in the cluster's shared folder. All seeds travel in one traversal, keyed by seed. Caps are applied level by level, in a total order.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import CALLER_TYPES, NON_PATH, TRACE_PRIORITY, definite_of, impact_edge
from tessera.operators.lineage import cut, discard, store


def neighbours(edges: DataFrame, node: str, direction: str = "both", types: tuple[str, ...] | None = None) -> DataFrame:
    """Edges at a node, by direction and type."""
    out, back = F.col("source") == node, F.col("target") == node
    cond = {"outgoing": out, "incoming": back, "both": out | back}[direction]
    return edges.where(cond & F.col("type").isin(*types) if types else cond)


def callers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Who calls, handles, triggers or continues to the targets (column id)."""
    return edges.where(F.col("type").isin(*CALLER_TYPES)).join(targets.select(F.col("id").alias("target")), "target", "left_semi")


def _oriented(edges: DataFrame, reverse: bool, extra: list[str]) -> DataFrame:
    a, b = ("target", "source") if reverse else ("source", "target")
    return edges.select(F.col(a).alias("_from"), F.col(b).alias("_to"), *extra)


def simple_paths(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False, keep: Column | None = None, limit: int | None = None) -> DataFrame:
    """All simple paths of up to ``depth`` edges from the seeds (column id): seed, node, distance, confidence (the least of the
    path's), path (node ids), edge_ids, potential (whether any edge is not definite).

    Of each level only the paths that can go on (some edge leaves their end) are a checkpoint, from which the next level is made; ends of paths are made
    where they are read and never stored, and the search is over when nothing can go on. So the plan of a level is one join, however deep the search. With a limit, a seed stops at the level where it has that many paths: of that level the first by path and edges stay, nothing longer
    is ever made, and ``truncated`` tells whether there was more."""
    e = edges.where(impact_edge() if keep is None else keep)
    step = _oriented(e, reverse, [F.col("confidence").alias("_c"), F.col("id").alias("_e"), (~definite_of(edges)).alias("_p")])
    # a column for each step: the arrays are built last, and not at all where nobody reads them
    level = seeds.select(F.col("id").alias("_n0"), F.lit(1.0).alias("confidence"), F.lit(False).alias("potential"))
    if limit is not None:
        level = level.distinct().withColumn("_have", F.lit(0).cast("long"))
    carried = [] if limit is None else ["_have"]
    out: DataFrame | None = None
    if limit is None and depth > 1:
        step = cut(step)
        onward = step.join(step.select(F.col("_from").alias("_to")).distinct(), "_to", "left_semi").select(*step.columns)
    for d in range(1, depth + 1):
        nodes, ids = [f"_n{i}" for i in range(d + 1)], [f"_e{i}" for i in range(1, d + 1)]
        fresh = reduce(lambda x, y: x & y, [F.col("_to") != F.col(n) for n in nodes[:-1]])
        grown = lambda by: level.join(by, level[nodes[-2]] == by["_from"]).where(fresh).select(*carried, *nodes[:-1], *ids[:-1], F.col("_to").alias(nodes[-1]), F.col("_e").alias(ids[-1]), F.least("confidence", "_c").alias("confidence"), (F.col("potential") | F.col("_p")).alias("potential"))  # noqa: B023, E731
        if limit is None:
            paths = grown(step).select(F.col("_n0").alias("seed"), F.col(nodes[-1]).alias("node"), F.lit(d).alias("distance"), "confidence", F.array(*nodes).alias("path"), F.array(*ids).alias("edge_ids"), "potential")
            out = paths if out is None else out.unionByName(paths)
            if d < depth:
                level = cut(grown(onward))
                if level.isEmpty():
                    break
            continue
        level = grown(step)
        order = Window.partitionBy("_n0").orderBy(F.concat_ws("\n", *nodes), F.concat_ws("\n", *ids))
        level = level.withColumn("_rank", F.row_number().over(order)).where(F.col("_have") + F.col("_rank") <= limit + 1)
        level = level.withColumn("_now", F.col("_have") + F.max("_rank").over(Window.partitionBy("_n0")))
        if d < depth:
            level = cut(level)
        paths = level.select(F.col("_n0").alias("seed"), F.col(nodes[-1]).alias("node"), F.lit(d).alias("distance"), "confidence", F.array(*nodes).alias("path"), F.array(*ids).alias("edge_ids"), "potential", (F.col("_have") + F.col("_rank")).alias("_n"))
        out = paths if out is None else out.unionByName(paths)
        if d < depth:
            # seeds that have more than the limit are done; those at the limit look one level further, for whether there is more
            level = level.where(F.col("_now") <= limit).drop("_rank", "_have").withColumnRenamed("_now", "_have")
            if level.isEmpty():
                break
    if limit is None:
        return out
    more = F.max("_n").over(Window.partitionBy("seed")) > limit
    return out.withColumn("truncated", more).where(F.col("_n") <= limit).drop("_n")


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 8, limit: int | None = None) -> DataFrame:
    """Definite reverse paths: who is affected by a change of the seeds, and by which path. With a limit, the first paths of each seed
    by distance and path, and whether there were more."""
    return simple_paths(edges, seeds, depth, reverse=True, keep=definite_of(edges), limit=limit)


def dependencies(edges: DataFrame, seeds: DataFrame, depth: int = 8) -> DataFrame:
    return simple_paths(edges, seeds, depth, keep=definite_of(edges))


def potential_impact(edges: DataFrame, seeds: DataFrame, depth: int = 8) -> DataFrame:
    """Reverse paths over any impact edge that hold at least one which is not definite."""
    return simple_paths(edges, seeds, depth, reverse=True).where("potential")


#: Rows of a batch that path counts are unpacked to.
_UNPACKED = 200_000
_PACKED = "node string, confidence double, n long, seeds binary"


def _coded(seed: np.ndarray, start: np.ndarray) -> pa.Array:
    """Ascending numbers, cut into lists that begin at ``start``, to a binary a list: first number and differences, seven bits a byte."""
    step = np.diff(seed, prepend=0)
    step[start] = seed[start]
    size = 1 + sum((step >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    end = np.cumsum(size)
    raw = np.empty(int(end[-1]), np.uint8)
    for k in range(int(size.max())):
        some = np.flatnonzero(size > k)
        raw[end[some] - size[some] + k] = (step[some] >> 7 * k & 127) | (size[some] > k + 1).astype(np.int64) << 7
    cuts = np.append((end - size)[start], end[-1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(cuts), pa.py_buffer(raw)])


def _decoded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of lists that ``_coded`` made, and their numbers in a row."""
    cuts = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    raw = np.frombuffer(lists.buffers()[2], np.uint8)[cuts[0] : cuts[-1]]
    last = raw < 128
    end = np.flatnonzero(last)
    size = np.diff(end, prepend=-1)
    step = np.zeros(len(end), np.int64)
    for k in range(int(size.max())):
        some = np.flatnonzero(size > k)
        step[some] |= (raw[end[some] - size[some] + 1 + k] & 127).astype(np.int64) << 7 * k
    n = np.add.reduceat(last.astype(np.int64), cuts[:-1] - cuts[0])
    total, first = np.cumsum(step), np.cumsum(n) - n
    return n, total - np.repeat(total[first] - step[first], n)


def _merged(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed rows, sorted by node, to the nodes and to entries in order of node and seed: place of the node, seed, best confidence, number of paths."""
    node = rows.column("node").combine_chunks()
    new = np.concatenate([[True], pc.not_equal(node[1:], node[:-1]).to_numpy(zero_copy_only=False)])
    size, seed = _decoded(rows.column("seeds").combine_chunks())
    key = np.repeat(np.cumsum(new) - 1, size) << 32 | seed
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    confidence = np.maximum.reduceat(np.repeat(rows.column("confidence").to_numpy(), size)[order], start)
    n = np.add.reduceat(np.repeat(rows.column("n").to_numpy(), size)[order], start)
    return node.filter(pa.array(new)), key[start] >> 32, key[start] & 0xFFFFFFFF, confidence, n


def _packed(nodes: pa.Array, at: np.ndarray, seed: np.ndarray, confidence: np.ndarray, n: np.ndarray) -> pa.Table:
    """Entries to a row for each node, confidence and number of paths, with its seeds."""
    order = np.lexsort((n, confidence, at))
    at, seed, confidence, n = at[order], seed[order], confidence[order], n[order]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (confidence[1:] != confidence[:-1]) | (n[1:] != n[:-1])])
    start = np.flatnonzero(new)
    return pa.table({"node": nodes.take(pa.array(at[start])), "confidence": confidence[start], "n": n[start], "seeds": _coded(seed, start)})


def _by_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Packed rows sorted by node, in tables that hold all rows of their nodes; what is carried from batch to batch is merged."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.table(batch)
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        last = pc.equal(rows.column("node"), rows.column("node")[-1])
        done = rows.filter(pc.invert(last))
        if done.num_rows:
            yield done
        rest = _packed(*_merged(rows.filter(last)))
    if rest is not None:
        yield rest


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by_node(batches):
        yield from _packed(*_merged(rows)).to_batches()


def _unpack(names, distance: int, merge: bool):
    """Packed rows to a row for each seed, node and distance; ``names`` are the seeds' ids by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.array(names.value, pa.string())
        for rows in _by_node(batches) if merge else (pa.table(b) for b in batches if b.num_rows):
            if merge:
                nodes, at, seed, confidence, n = _merged(rows)
            else:
                size, seed = _decoded(rows.column("seeds").combine_chunks())
                at, nodes = np.repeat(np.arange(rows.num_rows), size), rows.column("node").combine_chunks()
                confidence, n = rows.column("confidence").to_numpy()[at], rows.column("n").to_numpy()[at]
            for a in range(0, len(at), _UNPACKED):
                part = slice(a, a + _UNPACKED)
                found = {"seed": ids.take(pa.array(seed[part])), "node": nodes.take(pa.array(at[part])), "distance": np.full(len(at[part]), distance, np.int32)}
                yield pa.RecordBatch.from_pydict(found | {"confidence": confidence[part], "n_paths": n[part]})

    return run


def _gathered(rows: DataFrame) -> DataFrame:
    return rows.repartition("node").sortWithinPartitions("node")


class _Levels:
    """Definite walks from seeds, level by level, as packed rows: what goes on is stored, ends are made where they are read. ``whole`` says that all
    walks ended, so that none runs in a cycle and each is a simple path. The ids of the seeds are sent to the executors, once."""

    def __init__(self, edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool) -> None:
        spark = edges.sparkSession
        plain = store(_oriented(edges.where(definite_of(edges)), reverse, [F.col("confidence").alias("_c")]).where("_from <> _to"))
        left = plain.select(F.col("_from").alias("_to")).distinct().withColumn("_on", F.lit(True))
        step = store(plain.join(left, "_to", "left").select("_from", "_to", "_c", F.col("_on").isNotNull().alias("_on")))
        discard(spark, plain.stored)
        times = {r["id"]: r["n"] for r in seeds.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).collect()}
        ids = sorted(times)
        frontier = spark.createDataFrame(pa.table({"node": pa.array(ids, pa.string()), "confidence": pa.array([1.0] * len(ids), pa.float64()), "n": pa.array([times[i] for i in ids], pa.int64()), "seeds": _coded(np.arange(len(ids)), np.arange(len(ids))) if ids else pa.array([], pa.binary())}))
        self.names, self.whole = spark.sparkContext.broadcast(ids), False
        self.ends: list[DataFrame] = []  # of each level, several rows a node
        self.onward: list[DataFrame] = []

        def met(on: bool) -> DataFrame:
            by = step.where("_on" if on else "NOT _on")
            return frontier.join(by, frontier["node"] == by["_from"]).select(F.col("_to").alias("node"), F.least("confidence", "_c").alias("confidence"), "n", "seeds")

        for _ in range(depth):
            self.ends.append(met(False))
            frontier_ = store(_gathered(met(True)).mapInArrow(_pack, _PACKED))
            if frontier_.isEmpty():
                self.whole = True
                break
            self.onward.append(frontier_)
            frontier = frontier_


def path_counts(edges: DataFrame, seeds: DataFrame, depth: int = 8, reverse: bool = True) -> DataFrame:
    """(seed, node, distance, confidence, n_paths): for each end and length of definite simple paths their best confidence and their number, which is what
    ``simple_paths`` gives when grouped, without a row for any path.

    Seeds travel as numbers in lists: a node has a row for each confidence and number of paths that some seeds share. All that meets at a node is merged in the task
    that has the node, so nothing is ever shuffled by pairs of seed and node, and pairs are made where they are read. Rows that can go on are stored level by
    level, ends never. Lists count walks; where the last level is reached before all walks end, some may run in cycles, and paths are listed instead."""
    levels = _Levels(edges, seeds, depth, reverse)
    if levels.whole:
        schema = "seed string, node string, distance int, confidence double, n_paths long"
        parts = [_gathered(x).mapInArrow(_unpack(levels.names, d, True), schema) for d, x in enumerate(levels.ends, 1)]
        return reduce(DataFrame.unionByName, parts + [x.mapInArrow(_unpack(levels.names, d, False), schema) for d, x in enumerate(levels.onward, 1)])
    paths = simple_paths(edges, seeds, depth, reverse, definite_of(edges))
    return paths.groupBy("seed", "node", "distance").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n_paths"))


def _per_seed(names):
    """Rows sorted by node, at distance 0 what is known of it (kind, file, domain), at others lists of seeds, to a row for each seed that occurs: what it
    meets in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((3, len(names.value)), np.int64)
        codes: tuple[dict[str, int], dict[str, int]] = {}, {}
        pairs = [np.zeros(0, np.int64), np.zeros(0, np.int64)]  # seeds and codes of files, and of domains, each pair once

        def add(rows: pa.Table) -> None:
            node = rows.column("node").combine_chunks()
            at = np.cumsum(np.concatenate([[True], pc.not_equal(node[1:], node[:-1]).to_numpy(zero_copy_only=False)])) - 1
            distance = rows.column("distance").to_numpy()
            about, lists = rows.filter(pa.array(distance == 0)), rows.filter(pa.array(distance > 0))
            if not about.num_rows or not lists.num_rows:
                return
            size, seed = _decoded(lists.column("seeds").combine_chunks())
            key = np.repeat(at[distance > 0], size) << 32 | seed
            order = np.argsort(key, kind="stable")
            start = np.flatnonzero(np.diff(key[order], prepend=-1))
            flags = np.bitwise_or.reduceat(np.repeat(np.where(distance[distance > 0] == 1, 1, 2), size)[order], start)
            where, met = key[order][start] >> 32, key[order][start] & 0xFFFFFFFF
            of = at[distance == 0]
            point = pc.fill_null(pc.equal(about.column("kind"), "endpoint"), False).to_numpy()
            known, points = (np.bincount(x, minlength=at[-1] + 1)[where] > 0 for x in (of, of[point]))
            for i, some in enumerate((known & (flags & 1 > 0), known & (flags & 2 > 0), points)):
                count[i] += np.bincount(met[some], minlength=count.shape[1])
            n = np.bincount(where, minlength=at[-1] + 1)
            each = n[of]  # seeds of each row about a node
            seed = met[np.repeat((np.cumsum(n) - n)[of] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
            for i, column in enumerate(("file", "domain")):
                code = np.asarray([-1 if x is None else codes[i].setdefault(x, len(codes[i])) for x in about.column(column).to_pylist()], np.int64)
                found = np.repeat(code, each)
                pairs[i] = np.union1d(pairs[i], (seed << 32 | found)[found >= 0])

        rest: pa.Table | None = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.table(batch) if rest is None else pa.concat_tables([rest, pa.table(batch)])
                last = pc.equal(rows.column("node"), rows.column("node")[-1])
                rest = rows.filter(last)
                if rest.num_rows < rows.num_rows:
                    add(rows.filter(pc.invert(last)))
        if rest is not None:
            add(rest)
        some = np.flatnonzero(count.sum(axis=0))
        ids = pa.array(names.value, pa.string())
        for a in range(0, len(some), 2000):
            part = some[a : a + 2000]
            out = {"seed": ids.take(pa.array(part))} | {c: count[i, part] for i, c in enumerate(("n_direct", "n_transitive", "n_entrypoints"))}
            for i, c in enumerate(("files", "domains")):
                begin, end = np.searchsorted(pairs[i], part << 32), np.searchsorted(pairs[i], part + 1 << 32)
                mine = pairs[i][begin[0] : end[-1]] & 0xFFFFFFFF  # seeds that do not occur have no pairs
                out[c] = pa.ListArray.from_arrays(pa.array(np.append(begin, end[-1]).astype(np.int64) - begin[0], pa.int32()), pa.array(list(codes[i]), pa.string()).take(pa.array(mine)))
            yield pa.RecordBatch.from_pydict(out)

    return run


def impact_description(edges: DataFrame, seeds: DataFrame, nodes: DataFrame, depth: int = 8) -> DataFrame:
    """(seed, n_direct, n_transitive, n_files, n_domains, n_entrypoints) over the nodes (node, kind, file, domain) that definite reverse paths end at. A node counts as direct
    if a path of one edge leads to it, and as transitive if a longer one does. Seeds meet nodes as the lists of ``path_counts``, and each task has a row for each seed."""
    levels = _Levels(edges, seeds, depth, True)
    if levels.whole:
        none = [F.lit(None).cast("string").alias(c) for c in ("kind", "file", "domain")]
        parts = [x.select("node", F.lit(d).alias("distance"), "seeds", *none) for level in (levels.ends, levels.onward) for d, x in enumerate(level, 1)]
        about = nodes.select("node", F.lit(0).alias("distance"), F.lit(None).cast("binary").alias("seeds"), "kind", "file", "domain")
        # what is known of a node comes with its lists, so these are shuffled once
        met = reduce(DataFrame.unionByName, [about, *parts]).where("node IS NOT NULL").repartition("node").sortWithinPartitions("node")
        per = met.mapInArrow(_per_seed(levels.names), "seed string, n_direct long, n_transitive long, n_entrypoints long, files array<string>, domains array<string>")
        several = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
        return per.groupBy("seed").agg(F.sum("n_direct").alias("n_direct"), F.sum("n_transitive").alias("n_transitive"), several("files").alias("n_files"), several("domains").alias("n_domains"), F.sum("n_entrypoints").alias("n_entrypoints"))
    paths = simple_paths(edges, seeds, depth, True, definite_of(edges)).groupBy("seed", "node").agg(F.max((F.col("distance") == 1).cast("long")).alias("direct"), F.max((F.col("distance") > 1).cast("long")).alias("more"))
    return paths.join(nodes, "node").groupBy("seed").agg(F.sum("direct").alias("n_direct"), F.sum("more").alias("n_transitive"), F.size(F.collect_set("file")).cast("long").alias("n_files"), F.size(F.collect_set("domain")).cast("long").alias("n_domains"), F.count_if(F.col("kind") == "endpoint").alias("n_entrypoints"))


def path_distances(edges: DataFrame, seeds: DataFrame, depth: int = 8, reverse: bool = True) -> DataFrame:
    """(seed, node, first): every node that a definite simple path of up to ``depth`` edges ends at, and the fewest edges of such a path. A
    shortest walk is a simple path, so this needs a visited set and no paths."""
    reached = bfs(edges.where(definite_of(edges)), seeds, depth, reverse=reverse)
    return reached.where("distance > 0").select("seed", "node", F.col("distance").alias("first"))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False, types: tuple[str, ...] | None = None) -> DataFrame:
    """Level by level with a visited set: (seed, node, distance, confidence). Confidence is the best over shortest paths of the
    least on the path. What was reached in a level meets the visited set in one aggregate by (seed, node), and frontiers are checkpoints."""
    e = edges.where(F.col("type").isin(*types)) if types else edges
    step = cut(_oriented(e, reverse, ["confidence"]).where("_from <> _to").groupBy("_from", "_to").agg(F.max("confidence").alias("_c")))
    visited = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("distance"), F.lit(1.0).alias("confidence")).distinct()
    frontier = visited
    for level in range(1, depth + 1):
        reached = frontier.join(step, frontier["node"] == step["_from"]).groupBy("seed", F.col("_to").alias("node")).agg(F.max(F.least("confidence", "_c")).alias("confidence"))
        frontier = cut(reached.join(visited, ["seed", "node"], "left_anti").select("seed", "node", F.lit(level).alias("distance"), "confidence"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


#: Where a graph is no larger, each task that searches it holds it: its edges, its nodes, and edges times seeds.
_HELD_EDGES, _HELD_NODES, _HELD_WORK = 1 << 23, 1 << 20, 1 << 40
#: Edges that a search follows at once, nodes whose seeds it unpacks at once, pairs in a row.
_FOLLOWED, _LISTED, _PAIRS = 1 << 18, 1 << 12, 1 << 17


def _numbered(names):
    """Edges (_from, _to) by the places of their ends in ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = pd.Index(names.value.to_pylist(), dtype=object)
        for rows in batches:
            yield pa.RecordBatch.from_pydict({c: at.get_indexer(rows.column(c).to_pylist()).astype(np.int32) for c in ("_from", "_to")})

    return run


def _searched(held, depth: int, width: int):
    """Numbers of blocks of ``width`` seeds to what these reach: rows of a distance, seeds, nodes, and pairs as node * width + seed by their places there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, source, target, seeds = held.value
        for block in (x for rows in batches for x in rows.column(0).to_pylist()):
            mine = seeds[block * width : (block + 1) * width]
            ids, bit = names.take(pa.array(mine)).to_pylist(), np.arange(len(mine))
            seen = np.zeros((len(names), width // 64), np.dtype("<u8"))
            seen[mine, bit >> 6] = np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64))
            every, front = np.bitwise_or.reduce(seen, axis=0), seen
            for distance in range(1, depth + 1):
                live, full = front.any(axis=1), (seen == every).all(axis=1)
                met = np.zeros_like(seen)
                for a in range(0, len(source), _FOLLOWED):
                    x, y = source[a : a + _FOLLOWED], target[a : a + _FOLLOWED]
                    some = np.flatnonzero(live[x] & ~full[y])
                    if len(some):
                        x, y = x[some], y[some]
                        start = np.flatnonzero(np.diff(y, prepend=-1))
                        met[y[start]] |= np.bitwise_or.reduceat(front[x], start, axis=0)
                met &= ~seen
                if not met.any():
                    break
                seen, front = seen | met, met
                for a in range(0, len(names), _LISTED):
                    pair = np.flatnonzero(np.unpackbits(front[a : a + _LISTED].view(np.uint8), axis=1, bitorder="little"))
                    for c in range(0, len(pair), _PAIRS):
                        part = pair[c : c + _PAIRS]
                        first, last = part[0] // width, part[-1] // width
                        row = {"distance": pa.array([distance], pa.int32()), "seeds": [ids], "nodes": [names[a + first : a + last + 1].to_pylist()]}
                        yield pa.RecordBatch.from_pydict(row | {"pairs": pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array((part - first * width).astype(np.int32)))})

    return run


def _reach_held(step: DataFrame, seeds: DataFrame, depth: int) -> DataFrame | None:
    """What the seeds reach at distance 1 and more, found in tasks that hold the graph; none if it is too large for that."""
    spark = step.sparkSession
    ends = step.select(F.col("_from").alias("id")).unionByName(step.select(F.col("_to").alias("id"))).distinct()
    starts = seeds.join(step.select(F.col("_from").alias("id")).distinct(), "id", "left_semi")
    n_edges = step.count()
    if n_edges > _HELD_EDGES or ends.count() > _HELD_NODES or n_edges * starts.count() > _HELD_WORK:
        return None
    names = ends.toArrow().column("id").combine_chunks()
    found = step.mapInArrow(_numbered(spark.sparkContext.broadcast(names)), "_from int, _to int").toArrow()
    source, target = (found.column(c).to_numpy() for c in ("_from", "_to"))
    order = np.argsort(target, kind="stable")
    some = np.sort(pd.Index(names.to_pylist(), dtype=object).get_indexer(starts.toArrow().column("id").to_pylist()).astype(np.int32))
    width = 64
    while width < 1024 and width * 32 < len(some) and len(names) * width <= 1 << 27:
        width *= 2
    held, blocks = spark.sparkContext.broadcast((names, source[order], target[order], some)), -(-len(some) // width)
    rows = spark.range(0, blocks, 1, max(1, blocks)).mapInArrow(_searched(held, depth, width), "distance int, seeds array<string>, nodes array<string>, pairs array<int>")
    rows = rows.select("distance", "seeds", "nodes", F.explode("pairs").alias("_p"))
    return rows.select(F.col("seeds")[F.col("_p").bitwiseAND(width - 1)].alias("seed"), F.col("nodes")[F.shiftright("_p", width.bit_length() - 1)].alias("node"), "distance")


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, distance) as ``bfs`` has them, without confidence. A graph of bounded size goes to all tasks; each searches it from a block of seeds, a bit a
    seed, and pairs are made where they are read, so nothing is shuffled or stored but the edges. In a larger one 64 seeds travel as the bits of one number, and a level joins
    and stores a row for each node that any of them newly reaches; that is no less than a row a pair where few of the 64 share what they reach."""
    step = store(_oriented(edges, False, []).where("_from <> _to").distinct())
    seeds = store(seeds.select("id").distinct())
    found = _reach_held(step, seeds, depth)
    if found is not None:
        discard(step.sparkSession, step.stored)
        return seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("distance")).unionByName(found)
    return _reach_joined(step, seeds, depth)


def _reach_joined(step: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    group = F.pmod(F.xxhash64("seed"), F.lit(32)).cast("int")
    place = F.row_number().over(Window.partitionBy("_g").orderBy("seed")) - 1
    numbered = seeds.select(F.col("id").alias("seed")).withColumn("_g", group).withColumn("_n", place)
    numbered = cut(numbered.select("seed", (F.floor(F.col("_n") / 64) * 32 + F.col("_g")).alias("_b"), F.expr("shiftleft(1L, CAST(_n % 64 AS INT))").alias("_bit")))
    frontier = numbered.select(F.col("seed").alias("node"), "_b", F.col("_bit").alias("_bits"))
    levels = [frontier.withColumn("distance", F.lit(0))]
    none = F.lit(0).cast("long")
    for level in range(1, depth + 1):
        met = frontier.join(step, frontier["node"] == step["_from"]).select(F.col("_to").alias("node"), "_b", F.col("_bits").alias("_r"), none.alias("_v"))
        known = reduce(DataFrame.unionByName, [x.select("node", "_b", none.alias("_r"), F.col("_bits").alias("_v")) for x in levels])
        both = met.unionByName(known).groupBy("node", "_b").agg(F.bit_or("_r").alias("_r"), F.bit_or("_v").alias("_v"))
        frontier = cut(both.select("node", "_b", F.col("_r").bitwiseAND(F.bitwise_not("_v")).alias("_bits")).where("_bits <> 0"))
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("distance", F.lit(level)))
    lists = numbered.groupBy("_b").agg(F.collect_list(F.struct("_bit", "seed")).alias("_seeds"))
    met = reduce(DataFrame.unionByName, levels).join(lists, "_b")
    return met.select(F.explode(F.filter("_seeds", lambda s: F.col("_bits").bitwiseAND(s["_bit"]) != 0)).alias("_s"), "node", "distance").select("_s.seed", "node", "distance")


def traverse(edges: DataFrame, seeds: DataFrame, depth: int, max_nodes: int, reverse: bool = False, types: tuple[str, ...] | None = None) -> DataFrame:
    """Bounded breadth-first search that returns edges: seed, edge_id, node (where the edge leads), depth, confidence (the least on the way),
    deterministic (no heuristic and no confidence below 1 on the way), truncated (whether a cap of the seed left something out).

    In each level the edges of a seed's frontier stand in the order of type, source, target and id. At most ``max_nodes`` edges are returned for a seed, and
    nodes are visited, the first edge that leads to one deciding its state, until ``max_nodes`` are. Edges beyond the caps of one level are not even ranked twice:
    every level is a checkpoint of what was kept."""
    e = edges.where(F.col("type").isin(*types)) if types else edges
    a, b = ("target", "source") if reverse else ("source", "target")
    step = e.select(F.col(a).alias("_from"), F.col(b).alias("_to"), F.col("id").alias("edge_id"), "type", "source", "target", F.col("confidence").alias("_c"), ((F.col("source_type") != "heuristic") & (F.col("confidence") == 1)).alias("_d"))
    visited = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node")).distinct()
    frontier = visited.select("seed", "node", F.lit(1.0).alias("confidence"), F.lit(True).alias("deterministic"))
    totals = visited.select("seed", F.lit(0).cast("long").alias("items"), F.lit(1).cast("long").alias("seen"))
    done: DataFrame | None = None
    full: DataFrame | None = None
    for level in range(1, depth + 1):
        w = Window.partitionBy("seed").orderBy("type", "source", "target", "edge_id")
        met = frontier.join(step, frontier["node"] == step["_from"]).drop("node").join(totals, "seed").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_nodes - F.col("items") + 1)
        met = cut(met)
        over = met.where(F.col("_n") > max_nodes - F.col("items")).select("seed").distinct()
        rows = met.where(F.col("_n") <= max_nodes - F.col("items"))
        if done is not None:
            rows = rows.join(done.select("seed", "edge_id"), ["seed", "edge_id"], "left_anti")
        rows = rows.withColumn("confidence", F.least("confidence", "_c")).withColumn("deterministic", F.col("deterministic") & F.col("_d"))
        known = visited.select("seed", F.col("node").alias("_to"), F.lit(True).alias("_known"))
        first = F.row_number().over(Window.partitionBy("seed", "_to").orderBy("_n")) == 1
        rows = rows.join(known, ["seed", "_to"], "left").withColumn("_new", F.col("_known").isNull() & first)
        # how many nodes are visited before each edge
        at = F.col("seen") + F.coalesce(F.sum(F.col("_new").cast("long")).over(Window.partitionBy("seed").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = cut(rows.withColumn("_at", at))
        kept = rows.select("seed", "edge_id", F.col("_to").alias("node"), F.lit(level).alias("depth"), "confidence", "deterministic")
        done = kept if done is None else done.unionByName(kept)
        over = over.unionByName(rows.where(F.col("_at") >= max_nodes).select("seed"))
        full = over if full is None else full.unionByName(over)
        frontier = cut(rows.where(F.col("_new") & (F.col("_at") < max_nodes)).select("seed", F.col("_to").alias("node"), "confidence", "deterministic"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.select("seed", "node"))
        counts = done.groupBy("seed").agg(F.count("*").alias("items")).join(visited.groupBy("seed").agg(F.count("*").alias("seen")), "seed")
        totals = cut(counts)
        full = full.unionByName(frontier.select("seed").distinct().join(totals.where(F.col("items") >= max_nodes).select("seed"), "seed", "left_semi"))
        frontier = frontier.join(totals.where(F.col("items") < max_nodes).select("seed"), "seed", "left_semi")
    if done is None:
        done = visited.select("seed", F.lit("").alias("edge_id"), "node", F.lit(0).alias("depth"), F.lit(1.0).alias("confidence"), F.lit(True).alias("deterministic")).limit(0)
        full = visited.select("seed").limit(0)
    return done.join(full.distinct().withColumn("truncated", F.lit(True)), "seed", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def subgraph(edges: DataFrame, seeds: DataFrame, hops: int = 2, max_nodes: int | None = None, max_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, hop) within some hops of the seeds (id), either way, and the edges among them. With caps the nearest nodes and then the smallest ids stay, and of
    the edges those with the smallest ids."""
    both = edges.select(F.col("source").alias("_a"), F.col("target").alias("_b"))
    both = both.unionByName(both.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    near = cut(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    front = near
    for hop in range(1, hops + 1):
        met = front.join(both, front["id"] == both["_a"]).select(F.col("_b").alias("id")).distinct()
        front = cut(met.join(near.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)))
        near = near.unionByName(front)
        if max_nodes is not None:
            near = cut(near.orderBy("hop", "id").limit(max_nodes))
            front = near.where(F.col("hop") == hop)
    ids = near.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return near, (inner if max_edges is None else inner.orderBy("id").limit(max_edges))


def shortest_path(edges: DataFrame, source: str, target: str, depth: int) -> DataFrame:
    """One row a step of a path with the fewest edges: step, node, edge_id. Ties: each node is reached by its smallest edge id."""
    e = edges.where(~F.col("type").isin(*NON_PATH))
    spark = edges.sparkSession
    reached = cut(spark.createDataFrame([(source, 0, None, None)], "node string, distance int, via string, edge_id string"))
    frontier = reached
    for level in range(1, depth + 1):
        new = frontier.select("node").join(e, F.col("node") == F.col("source")).groupBy(F.col("target").alias("_to")).agg(F.min_by("source", "id").alias("via"), F.min("id").alias("edge_id"))
        frontier = cut(new.join(reached, new["_to"] == reached["node"], "left_anti").select(F.col("_to").alias("node"), F.lit(level).alias("distance"), "via", "edge_id"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if not frontier.where(F.col("node") == target).isEmpty():
            break
    back, at = [], target
    for _ in range(depth + 1):  # at most depth + 1 point lookups
        row = reached.where(F.col("node") == at).first()
        if row is None:
            return spark.createDataFrame([], "step int, node string, edge_id string")
        back.append((row["distance"], row["node"], row["edge_id"]))
        if row["via"] is None:
            break
        at = row["via"]
    return spark.createDataFrame(back, "step int, node string, edge_id string")


def longest_depth(links: DataFrame, source: str, target: str, cap: int = 10) -> DataFrame:
    """Longest dependency depth of each file, in synchronous rounds; cycles saturate at the cap."""
    pairs = cut(links.select(F.col(source).alias("a"), F.col(target).alias("b")).distinct())
    depth = pairs.select(F.col("a").alias("file")).union(pairs.select("b")).distinct().withColumn("depth", F.lit(0))
    for _ in range(cap):
        up = pairs.join(depth, pairs["b"] == depth["file"]).groupBy("a").agg((F.max("depth") + 1).alias("d"))
        depth = cut(depth.join(up, depth["file"] == up["a"], "left").select("file", F.least(F.lit(cap), F.greatest("depth", F.coalesce("d", F.lit(0)))).alias("depth")))
    return depth


def weak_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): smallest id in the weakly connected component. Label rounds with pointer jumping."""
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = cut(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = cut(both.select(F.col("x").alias("id"), F.col("x").alias("component")).distinct())
    while True:
        least = both.join(label, both["y"] == label["id"]).groupBy("x").agg(F.min("component").alias("m"))
        hooked = label.join(least, label["id"] == least["x"], "left").select("id", "component", F.least("component", F.coalesce("m", "component")).alias("c"))
        up = hooked.select(F.col("id").alias("j"), F.col("c").alias("jump"))
        jumped = cut(hooked.join(up, hooked["c"] == up["j"], "left").select("id", F.col("component").alias("old"), F.least("c", F.coalesce("jump", "c")).alias("component")))
        changed = not jumped.where("old <> component").isEmpty()
        label = jumped.select("id", "component")
        if not changed:
            return label


def tarjan(nodes: list[str], out: dict[str, list[str]]) -> dict[str, str]:
    """Strongly connected components without recursion: node to the smallest member of its component."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    found: dict[str, str] = {}
    for start in nodes:
        if start in index:
            continue
        work: list[tuple[str, Iterator[str]]] = [(start, iter(out.get(start, ())))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(out.get(nxt, ()))))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        members.append(x)
                        if x == node:
                            break
                    least = min(members)
                    for x in members:
                        found[x] = least
    return found


def strong_components(links: DataFrame, a: str, b: str, trims: int = 3) -> DataFrame:
    """(id, component, size) of strongly connected components of more than one member, or of one with a link to itself.

    Nodes without a way in or out are trimmed in ``trims`` rounds, then each weakly connected rest is one group for an
    iterative Tarjan, so that chains of any length need no further rounds. A rest too large for a task is the limit."""
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).distinct()
    loops = pairs.where("x = y")
    rest = cut(pairs.where("x <> y"))
    for _ in range(trims):
        inner = rest.select(F.col("x").alias("n")).intersect(rest.select(F.col("y").alias("n")))
        rest = cut(rest.join(inner.withColumnRenamed("n", "x"), "x", "left_semi").join(inner.withColumnRenamed("n", "y"), "y", "left_semi").select("x", "y"))
    label = weak_components(rest, "x", "y")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[str]] = {}
        for x, y in zip(group["x"], group["y"], strict=True):
            out.setdefault(x, []).append(y)
        got = tarjan(sorted(set(group["x"]) | set(group["y"])), out)
        return pd.DataFrame({"id": list(got), "component": list(got.values())})

    found = rest.join(label, rest["x"] == label["id"]).select("x", "y", F.col("component").alias("weak")).groupBy("weak").applyInPandas(run, "id string, component string")
    size = F.count("*").over(Window.partitionBy("component"))
    strong = found.withColumn("size", size).where("size > 1")
    alone = loops.select(F.col("x").alias("id"), F.col("x").alias("component"), F.lit(1).cast("long").alias("size")).join(strong, "id", "left_anti")
    return strong.unionByName(alone)


#: Sweeps of one level and levels of the search for communities.
SWEEPS, LEVELS = 50, 20
_SAME = 1e-12


def _local_moves(start: np.ndarray, near: np.ndarray, weight: np.ndarray, total: float) -> np.ndarray:
    """Local moving over a graph in compressed rows: the community of each node once a whole sweep moves none.

    Taking a node out of its community, the gain of joining community c is (weight towards c) - degree x volume(c) / total; a loop of the node counts
    as weight towards the community that it leaves. Of gains that differ by rounding only the smallest community wins."""
    n = len(start) - 1
    owner = np.repeat(np.arange(n), np.diff(start))
    degree = np.bincount(owner, weight, minlength=n)
    of, volume = np.arange(n), degree.copy()
    for _ in range(SWEEPS):
        before = of.copy()
        for v in np.flatnonzero(degree).tolist():
            row = slice(start[v], start[v + 1])
            volume[of[v]] -= degree[v]
            options, place = np.unique(np.append(of[near[row]], of[v]), return_inverse=True)
            toward = np.bincount(place, np.append(weight[row], 0.0))
            gain = toward - degree[v] * volume[options] / total
            of[v] = options[int(np.argmax(gain >= gain.max() - _SAME))]
            volume[of[v]] += degree[v]
        if np.array_equal(before, of):
            break
    return of


def modularity_communities(n: int, x: np.ndarray, y: np.ndarray, weight: np.ndarray, total: float) -> np.ndarray:
    """Blondel et al.'s multilevel search over an undirected graph of ``n`` numbered nodes: the community (its smallest number) of each. After
    each level communities become nodes, and what lies inside one becomes its loop. ``total`` is twice the weight of all edges."""
    labels = np.arange(n)  # the number that each node of the current level stands for
    member = np.arange(n)  # the current node of each original one
    a, b, w = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([weight, weight])
    for _ in range(LEVELS):
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], w[order]
        of = _local_moves(np.searchsorted(a, np.arange(len(labels) + 1)), b, w, total)
        kept, to = np.unique(of, return_inverse=True)
        member, labels = to[member], labels[kept]
        if len(kept) in (1, len(of)):
            break
        pair, place = np.unique(to[a] * len(kept) + to[b], return_inverse=True)
        a, b, w = pair // len(kept), pair % len(kept), np.bincount(place, w)
    least = np.full(len(labels), n)
    np.minimum.at(least, member, np.arange(n))
    return least[member]


def louvain(links: DataFrame, a: str, b: str, confidence: str = "confidence") -> DataFrame:
    """(id, community): multilevel modularity. Sequential by definition, hence per weakly connected component, with the weight of the
    whole graph in every gain; only neighbouring communities are ever compared, so components do not depend on each other."""
    w = F.greatest(F.lit(0.05), F.col(confidence))
    pairs = cut(links.where(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).agg(F.sum(w).alias("w")))
    total = 2 * (pairs.agg(F.sum("w")).first()[0] or 0.0)
    label = weak_components(pairs, "x", "y")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([group["x"].to_numpy(str), group["y"].to_numpy(str)]), return_inverse=True)
        x, y = at[: len(group)], at[len(group) :]
        found = modularity_communities(len(ids), x, y, group["w"].to_numpy(), total)
        return pd.DataFrame({"id": ids, "community": ids[found]})

    return pairs.join(label, pairs["x"] == label["id"]).select("x", "y", "w", "component").groupBy("component").applyInPandas(run, "id string, community string")


def flows(edges: DataFrame, entrypoints: DataFrame, types: tuple[str, ...], depth: int = 8, max_paths: int = 20, max_steps: int = 80, names: DataFrame | None = None) -> DataFrame:
    """Execution paths from entrypoints: seed, path, edge_ids, cycle (the path ends where it meets itself), truncated (it was cut), rank.

    Paths grow level by level in one order: by the rank of what they extend, then the falling confidence of the edge, the name of its target (``names``: id,
    name) and its id. No level of a seed holds more than ``max_paths`` open paths; those beyond are cut there, as are those at ``depth`` that could go on. Of all ends
    the first ``max_paths`` are returned, and of a seed no more than ``max_steps`` different nodes are expanded."""
    e = edges.where(F.col("type").isin(*types)).select(F.col("id").alias("_e"), F.col("source").alias("_from"), F.col("target").alias("_to"), F.col("confidence").alias("_c"))
    if names is not None:
        e = e.join(names.select(F.col("id").alias("_i"), F.col("name").alias("_name")), F.col("_to") == F.col("_i"), "left").drop("_i")
    else:
        e = e.withColumn("_name", F.lit(None).cast("string"))
    level = entrypoints.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.array("id").alias("path"), F.array().cast("array<string>").alias("edge_ids"), F.lit(1).alias("_rank"))
    ends: list[DataFrame] = []
    columns = ("seed", "path", "edge_ids", "cycle", "truncated")
    seen = level.select("seed", "node").distinct()
    for d in range(depth + 1):
        grown = level.join(e, F.col("node") == F.col("_from"), "left")
        if d == depth:
            last = level.join(e.select(F.col("_from").alias("node")).distinct().withColumn("_more", F.lit(True)), "node", "left")
            ends.append(last.where(F.size("path") > 1).select("seed", "path", "edge_ids", F.lit(False).alias("cycle"), F.coalesce("_more", F.lit(False)).alias("truncated"), F.lit(d).alias("_d"), "_rank"))
            break
        ends.append(grown.where("_to IS NULL AND size(path) > 1").select("seed", "path", "edge_ids", F.lit(False).alias("cycle"), F.lit(False).alias("truncated"), F.lit(d).alias("_d"), "_rank"))
        order = Window.partitionBy("seed").orderBy("_rank", F.desc("_c"), F.coalesce("_name", "_to"), "_e")
        grown = grown.where("_to IS NOT NULL").select("seed", F.col("_to").alias("node"), F.concat("path", F.array("_to")).alias("path"), F.concat("edge_ids", F.array("_e")).alias("edge_ids"), F.array_contains("path", F.col("_to")).alias("cycle"), F.row_number().over(order).alias("_rank"))
        grown = cut(grown.where(F.col("_rank") <= 2 * max_paths))  # the first ones are all that can be returned or grow
        ends.append(grown.where("cycle").select("seed", "path", "edge_ids", "cycle", F.lit(False).alias("truncated"), F.lit(d + 1).alias("_d"), "_rank"))
        live = grown.where("NOT cycle").withColumn("_live", F.row_number().over(Window.partitionBy("seed").orderBy("_rank")))
        ends.append(live.where(F.col("_live") > max_paths).select("seed", "path", "edge_ids", F.lit(False).alias("cycle"), F.lit(True).alias("truncated"), F.lit(d + 1).alias("_d"), "_rank"))
        level = live.where(F.col("_live") <= max_paths)
        # nodes met for the first time, up to max_steps a seed; paths to further ones are cut
        fresh = level.groupBy("seed", "node").agg(F.min("_rank").alias("_at")).join(seen, ["seed", "node"], "left_anti")
        room = seen.groupBy("seed").agg((F.lit(max_steps) - F.count("*")).alias("_room"))
        fresh = cut(fresh.withColumn("_k", F.row_number().over(Window.partitionBy("seed").orderBy("_at"))).join(room, "seed"))
        beyond = fresh.where(F.col("_k") > F.col("_room")).select("seed", "node")
        ends.append(level.join(beyond, ["seed", "node"], "left_semi").select("seed", "path", "edge_ids", F.lit(False).alias("cycle"), F.lit(True).alias("truncated"), F.lit(d + 1).alias("_d"), "_rank"))
        level = cut(level.join(beyond, ["seed", "node"], "left_anti").select("seed", "node", "path", "edge_ids", "_rank"))
        if level.isEmpty():
            break
        seen = seen.unionByName(fresh.where(F.col("_k") <= F.col("_room")).select("seed", "node"))
    done = reduce(lambda x, y: x.unionByName(y), ends)
    w = Window.partitionBy("seed").orderBy("_d", "_rank")
    return done.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_paths).select(*columns, "rank")


def flow_counts(edges: DataFrame) -> DataFrame:
    """(seed, cycle, n_nodes, n_paths): how many flows of up to four edges each node with a way out has, as ``flows`` without caps would list them, by whether the flow ends where
    it meets itself and by its nodes. Parallel edges count once, loops not at all.

    No path is made: a path of four edges is two halves of two. ``two`` holds how many ways of two edges lead from one node to another; walks are sums over it, and those
    that meet themselves too early are taken off, which only two-way pairs, triangles and pairs of halves can be."""
    pairs = cut(edges.where("source <> target").select(F.col("source").alias("a"), F.col("target").alias("b")).distinct())
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).cast("long").alias("_r"))
    outs = pairs.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("_o"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    # r: the edge goes both ways; o: edges that leave its end, none if it is a dead end
    e = cut(pairs.join(back, ["a", "b"], "left").join(outs, "b", "left").select("a", "b", zero("_r").alias("r"), zero("_o").alias("o")))
    node = cut(e.groupBy("a").agg(F.count("*").alias("out"), F.sum("r").alias("rec"), F.count_if(F.col("o") == 0).alias("dead"), F.sum("o").alias("w")))
    two = cut(e.select("a", "b").join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").groupBy("a", "c").agg(F.count("*").alias("p")))
    forth = two.select("a", F.col("c").alias("b"), F.col("p").alias("_p"))
    close = two.select(F.col("a").alias("b"), F.col("c").alias("a"), F.col("p").alias("_t"))
    ends = node.select(F.col("a").alias("b"), F.col("rec").alias("_rec"), F.col("dead").alias("_dead"))
    # t: triangles that begin with the edge; p: ways of two edges beside it
    e = cut(e.join(ends, "b", "left").join(close, ["a", "b"], "left").join(forth, ["a", "b"], "left").select("a", "b", "r", "o", zero("_rec").alias("rec_b"), zero("_dead").alias("dead_b"), zero("_t").alias("t"), zero("_p").alias("p")))
    triangles = e.groupBy(F.col("a").alias("b")).agg(F.sum("t").alias("_tri"))
    sums = e.join(triangles, "b", "left").groupBy("a").agg(
        F.sum("dead_b").alias("dead3"), F.sum("rec_b").alias("recs"), F.sum(F.col("o") * (F.col("rec_b") - F.col("r"))).alias("turned"), F.sum(F.col("r") * (F.col("rec_b") - 1)).alias("there_and_back"),
        F.sum(F.col("r") * F.col("p")).alias("beside"), F.sum("t").alias("tri"), F.sum(zero("_tri")).alias("tris"),
    )
    at = node.select(F.col("a").alias("c"), F.col("rec").alias("_rec"), F.col("dead").alias("_dead"), F.col("w").alias("_w"))
    home = two.select(F.col("a").alias("c"), F.col("c").alias("a"), F.col("p").alias("_q"))
    halves = two.where("a <> c").join(at, "c", "left").join(home, ["a", "c"], "left").groupBy("a").agg(*[F.sum(F.col("p") * zero(c)).alias(name) for c, name in (("_w", "walks"), ("_dead", "dead4"), ("_rec", "rec_c"), ("_q", "squares"))])
    c = F.col
    x = node.join(sums, "a").join(halves, "a", "left").select(*node.columns, *[k for k in sums.columns if k != "a"], *[zero(k).alias(k) for k in ("walks", "dead4", "rec_c", "squares")])
    simple = c("walks") - c("tri") * c("out") - c("turned")
    to_start = c("squares") - c("there_and_back")
    to_second = c("tris") - c("beside") - c("tri")
    to_third = c("rec_c") - (c("recs") - c("rec")) - c("beside")
    met = to_start + to_second + to_third
    counts = [(False, 2, c("dead")), (True, 3, c("rec")), (False, 3, c("dead3")), (True, 4, c("tri") + c("recs") - c("rec")), (False, 4, c("dead4")), (True, 5, met), (False, 5, simple - met)]
    rows = F.explode(F.array(*[F.struct(F.lit(cycle).alias("cycle"), F.lit(n).alias("n_nodes"), k.alias("n_paths")) for cycle, n, k in counts]))
    return x.select(c("a").alias("seed"), rows.alias("_x")).select("seed", "_x.*").where("n_paths > 0")


def trace(edges: DataFrame, start: str, max_depth: int = 6, max_nodes: int = 200, max_paths: int = 50) -> DataFrame:
    """Best-first trace of paths from one node: position, node, depth, edge_id (the edge that first led there, null for the start),
    confidence (the least on the way), deterministic, truncated (whether a cap left something out).

    The best open path is extended next: by the worth of its last edge's type, then confidence, then fewer edges, then node. A path ends at ``max_depth`` or where
    nothing new follows; ``max_paths`` bounds ended and open paths, ``max_nodes`` the nodes. Only the heap is on the driver: it holds at most ``max_paths`` paths.
    Edges are fetched in batches, for all open paths whose node lacks them: of each node the best ``max_nodes``, ranked by the executors."""
    worth = F.element_at(F.create_map(*[F.lit(x) for kv in TRACE_PRIORITY.items() for x in kv]), F.col("type"))
    followed = edges.where(F.col("type").isin(*TRACE_PRIORITY)).withColumn("worth", worth)
    best = Window.partitionBy("source").orderBy(F.desc("worth"), F.desc("confidence"), "target", "id")
    heap: list[tuple] = [(-math.inf, 0, start, 1.0, True, (start,))]
    fetched: dict[str, list] = {}
    nodes: dict[str, tuple] = {start: (0, None, 1.0, True)}
    ended, truncated = 0, False
    while heap and ended < max_paths and len(nodes) <= max_nodes:
        _, depth, node, confidence, sure, path = heapq.heappop(heap)
        if depth >= max_depth:
            ended += 1
            continue
        if node not in fetched:
            lacking = sorted({p[2] for p in heap if p[1] < max_depth and p[2] not in fetched} | {node})
            rows = followed.where(F.col("source").isin(*lacking)).withColumn("n", F.row_number().over(best)).where(F.col("n") <= max_nodes).orderBy("source", "n").collect()
            fetched |= {x: [] for x in lacking}
            for r in rows:
                fetched[r["source"]].append(r)
        onward = [r for r in fetched[node] if r["target"] not in path]
        pushed = 0
        for r in onward:
            if ended + len(heap) >= max_paths or len(nodes) >= max_nodes:
                truncated = True
                break
            least, certain = min(confidence, r["confidence"]), sure and r["source_type"] != "heuristic" and r["confidence"] == 1
            nodes.setdefault(r["target"], (depth + 1, r["id"], least, certain))
            heapq.heappush(heap, (-(r["worth"] * 1000 + least * 100 - depth - 1), depth + 1, r["target"], least, certain, (*path, r["target"])))
            pushed += 1
        ended += pushed == 0
    truncated = truncated or bool(heap)
    out = [(i, node, depth, via, least, certain, truncated) for i, (node, (depth, via, least, certain)) in enumerate(nodes.items())]
    return edges.sparkSession.createDataFrame(out, "position int, node string, depth int, edge_id string, confidence double, deterministic boolean, truncated boolean")
