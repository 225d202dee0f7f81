"""Trees: each tree is one row (a Newick string or a small distance matrix), so trees are independent and parallel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordinals import materialized


def parse(newick: str) -> list[tuple[int, int | None, str, float | None]]:
    """(node, parent, name, length) of every node, the root first; names may be missing, lengths too."""
    nodes: list[list] = [[0, None, "", None]]
    at, i, text = 0, 0, newick.strip().rstrip(";")
    while i < len(text):
        c = text[i]
        if c == "(":
            nodes.append([len(nodes), at, "", None])
            at = len(nodes) - 1
        elif c == ",":
            parent = nodes[at][1]
            if parent is None:
                raise ValueError("comma outside of brackets")
            nodes.append([len(nodes), parent, "", None])
            at = len(nodes) - 1
        elif c == ")":
            at = nodes[at][1]
            if at is None:
                raise ValueError("bracket without its pair")
        else:
            j = i
            while j < len(text) and text[j] not in "(),":
                j += 1
            name, _, length = text[i:j].partition(":")
            nodes[at][2] = name.strip() or nodes[at][2]
            if length.strip():
                nodes[at][3] = float(length)
            i = j - 1
        i += 1
    if at != 0:
        raise ValueError("bracket left open")
    return [tuple(n) for n in nodes]


def render(nodes: list[tuple]) -> str:
    children: dict[int, list[int]] = {}
    for n in nodes:
        if n[1] is not None:
            children.setdefault(n[1], []).append(n[0])
    done: dict[int, str] = {}
    for n in reversed(nodes):  # children come after their parent
        own = children.get(n[0])
        done[n[0]] = ("(" + ",".join(done[c] for c in own) + ")" if own else "") + n[2] + (f":{n[3]:g}" if n[3] is not None else "")
    return done[0] + ";"


def facts(newick: str) -> tuple[int, int, float, int, bool]:
    """(tips, inner nodes, total length, depth in edges, whether every inner node has two children)."""
    nodes = parse(newick)
    parents = [n[1] for n in nodes if n[1] is not None]
    inner = set(parents)
    depth = [0] * len(nodes)
    for n in nodes[1:]:
        depth[n[0]] = depth[n[1]] + 1
    return len(nodes) - len(inner), len(inner), sum(n[3] or 0.0 for n in nodes), max(depth), all(parents.count(p) == 2 for p in inner)


def splits(newick: str) -> set[frozenset]:
    """The non-trivial splits, each as its side without the least tip."""
    nodes = parse(newick)
    below: list[set] = [set() for _ in nodes]
    inner = {n[1] for n in nodes}
    for n in reversed(nodes):
        if n[0] not in inner:
            below[n[0]].add(n[2])
        if n[1] is not None:
            below[n[1]] |= below[n[0]]
    tips = below[0]
    least = min(tips, default="")
    made = {frozenset(tips - b if least in b else b) for b in below}
    return {s for s in made if 1 < len(s) < len(tips) - 1}


def neighbour_joining(names: list[str], d: np.ndarray) -> str:
    """Saitou and Nei's tree of a distance matrix; equal choices go to the first pair."""
    d, labels = d.astype(float).copy(), list(names)
    while len(labels) > 2:
        n = len(labels)
        total = d.sum(1)
        q = (n - 2) * d - total[:, None] - total[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(np.unravel_index(int(q.argmin()), q.shape))
        a = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        b = d[i, j] - a
        new = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(n) if k not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], new[keep][:, None]], [new[keep][None, :], np.zeros((1, 1))]])
        labels = [labels[k] for k in keep] + [f"({labels[i]}:{a:.6g},{labels[j]}:{b:.6g})"]
    return f"({labels[0]}:{d[0, 1] / 2:.6g},{labels[1]}:{d[0, 1] / 2:.6g});" if len(labels) == 2 else (labels[0] if labels else "") + ";"


def average_linkage(names: list[str], d: np.ndarray) -> str:
    """UPGMA."""
    d, labels, size, height = d.astype(float).copy(), list(names), [1] * len(names), [0.0] * len(names)
    while len(labels) > 1:
        np.fill_diagonal(d, np.inf)
        i, j = sorted(np.unravel_index(int(d.argmin()), d.shape))
        h = d[i, j] / 2
        label = f"({labels[i]}:{h - height[i]:.6g},{labels[j]}:{h - height[j]:.6g})"
        row = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        keep = [k for k in range(len(labels)) if k not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], row[keep][:, None]], [row[keep][None, :], np.zeros((1, 1))]])
        labels, size, height = [labels[k] for k in keep] + [label], [size[k] for k in keep] + [size[i] + size[j]], [height[k] for k in keep] + [h]
    return (labels[0] if labels else "") + ";"


def _per_row(df: DataFrame, columns: list[str], schema: str, f) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for values in frame.itertuples(index=False) for r in f(*values)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return df.select(*columns).mapInPandas(run, schema)


def edges(df: DataFrame, id: str, newick: str) -> DataFrame:
    """(tree, node, parent, name, length) of every tree."""
    return _per_row(df, [id, newick], "tree string, node long, parent long, name string, length double", lambda i, t: [(str(i), *n) for n in parse(t)])


def statistics(df: DataFrame, id: str, newick: str) -> DataFrame:
    return _per_row(df, [id, newick], "tree string, tips long, inner long, length double, depth long, binary boolean", lambda i, t: [(str(i), *facts(t))])


def robinson_foulds(df: DataFrame, id: str, first: str, second: str) -> DataFrame:
    """Splits of one tree only."""
    return _per_row(df, [id, first, second], "tree string, distance long", lambda i, a, b: [(str(i), len(splits(a) ^ splits(b)))])


def from_distances(df: DataFrame, group: str, method: str = "nj") -> DataFrame:
    """(tree, newick) of each group of distances (a, b, d): a group is one small matrix, the input of one tree."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(frame.a) | set(frame.b))
        at = {n: i for i, n in enumerate(names)}
        d = np.zeros((len(names), len(names)))
        for a, b, x in zip(frame.a, frame.b, frame.d, strict=True):
            d[at[a], at[b]] = d[at[b], at[a]] = x
        return pd.DataFrame({"tree": [str(frame[group].iat[0])], "newick": [(neighbour_joining if method == "nj" else average_linkage)(names, d)]})

    return df.select(group, "a", "b", "d").groupBy(group).applyInPandas(build, "tree string, newick string")


def split_name(side: frozenset) -> str:
    return ",".join(sorted(side))


def from_splits(tips: list[str], found: list[tuple[frozenset, float]]) -> str:
    """The tree of tips that has the splits (sides without the least tip, with their support), of which no two conflict;
    supports are the names of inner nodes."""
    order = sorted(found, key=lambda s: (-len(s[0]), split_name(s[0])))
    nodes: list[tuple[int, int | None, str, float | None]] = [(0, None, "", None)]
    sides = [frozenset(tips)]
    for side, support in order:
        parent = min((i for i, other in enumerate(sides) if side < other), key=lambda i: len(sides[i]))
        nodes.append((len(nodes), parent, f"{support:.6g}", None))
        sides.append(side)
    for tip in sorted(tips):
        parent = min((i for i, other in enumerate(sides) if tip in other), key=lambda i: len(sides[i]))
        nodes.append((len(nodes), parent, tip, None))
    return render(nodes)


def compatible(a: frozenset, b: frozenset) -> bool:
    """Whether two splits (sides without the least tip) fit into one tree."""
    return a <= b or b <= a or not a & b


def support(trees: DataFrame, newick: str = "newick", group: str = "tree_group") -> DataFrame:
    """(group, split, size, n, support): how many of the trees of each group have each split, by its side without the
    least tip. Trees are taken apart where they lie; the splits are counted as keys."""
    kind = trees.schema[group].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(g, split_name(s), len(s)) for g, t in zip(frame[group], frame[newick], strict=True) for s in splits(t)]
            yield pd.DataFrame(rows, columns=[group, "split", "size"])

    total = trees.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("trees"))
    counted = trees.select(group, newick).mapInPandas(run, f"`{group}` {kind}, split string, size long").groupBy(group, "split", "size").agg(F.count("*").alias("n"))
    return counted.join(total, F.col(group).eqNullSafe(F.col("_g"))).select(group, "split", "size", "n", (F.col("n") / F.col("trees")).alias("support"))


def consensus(trees: DataFrame, newick: str = "newick", group: str = "tree_group", cutoff: float = 0.5) -> DataFrame:
    """(group, trees, newick): for each group of trees on the same tips, the tree of the splits that more than ``cutoff``
    of them have, with their support as names of inner nodes. Below a half, splits that conflict with more frequent
    ones (then the larger, then the first by name) are left out. A group's distinct splits meet in one row."""
    kind = trees.schema[group].dataType.simpleString()

    def tips_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for g, t in zip(frame[group], frame[newick], strict=True):
                nodes = parse(t)
                inner = {n[1] for n in nodes}
                rows.append((g, sorted(n[2] for n in nodes if n[0] not in inner)))
            yield pd.DataFrame(rows, columns=[group, "tips"])

    tips = trees.select(group, newick).mapInPandas(tips_of, f"`{group}` {kind}, tips array<string>").groupBy(group).agg(F.min("tips").alias("tips"), F.count("*").alias("trees"))
    kept = support(trees, newick, group).where(F.col("support") > cutoff).groupBy(F.col(group).alias("_g")).agg(F.collect_list(F.struct("support", "split")).alias("found"))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for own, found in zip(frame["tips"], frame["found"], strict=True):
                chosen: list[tuple[frozenset, float]] = []
                rows = [] if found is None else [(frozenset(x["split"].split(",")), x["support"]) for x in found]
                for side, share in sorted(rows, key=lambda x: (-x[1], -len(x[0]), split_name(x[0]))):
                    if all(compatible(side, other) for other, _ in chosen):
                        chosen.append((side, share))
                made.append(from_splits(list(own), chosen))
            yield frame[[group, "trees"]].assign(newick=made)

    both = tips.join(kept, F.col(group).eqNullSafe(F.col("_g")), "left")
    return both.select(group, "trees", "tips", "found").mapInPandas(build, f"`{group}` {kind}, trees long, newick string")


def column_weights(length: int, replicates: int, seed: int) -> np.ndarray:
    """How often each replicate draws each column; row by row from the seed, so the same in every task."""
    return np.stack([np.random.default_rng([seed, r]).multinomial(length, np.full(length, 1 / length)) for r in range(replicates)]) if length else np.zeros((replicates, 0), np.int64)


def bootstrap_trees(alignment: DataFrame, id: str = "id", seq: str = "seq", replicates: int = 100, method: str = "nj", seed: int = 1, model: str = "p") -> DataFrame:
    """(tree, newick): a tree of an alignment (rows of equal length) for each replicate, a draw of as many columns.

    The draws are weights of the columns, a row a replicate, and each pair of sequences gives its distances in all
    replicates at once: the weighted share of columns that differ, of those without a gap (-, .) in either, or its
    Jukes-Cantor correction (``jc``; 3 where it has no value). No shared column is distance 1. Each replicate then
    is one small matrix and one tree. Letters' case doesn't count; a shorter sequence ends in gaps."""
    if method not in ("nj", "upgma") or model not in ("p", "jc"):
        raise ValueError((method, model))
    rows = materialized(alignment.select(F.col(id).cast("string").alias("id"), F.upper(F.col(seq)).alias("seq")).where("seq IS NOT NULL"))
    length = rows.agg(F.max(F.length("seq"))).first()[0] or 0
    pairs = rows.toDF("a", "x").join(rows.toDF("b", "y"), F.col("a") < F.col("b"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = None
        for frame in frames:
            weights = column_weights(length, replicates, seed).astype(float) if weights is None else weights
            for a, b, x, y in zip(frame["a"], frame["b"], frame["x"], frame["y"], strict=True):
                p, q = (np.frombuffer(s.ljust(length, "-").replace(".", "-").encode("latin-1", "replace"), np.uint8) for s in (x, y))
                both = (p != 45) & (q != 45)
                shared, differ = weights @ both, weights @ (both & (p != q))
                d = np.divide(differ, shared, out=np.ones(replicates), where=shared > 0)
                if model == "jc":
                    d = np.where(d < 0.75, -0.75 * np.log(np.maximum(1 - 4 * d / 3, 1e-300)), 3.0)
                yield pd.DataFrame({"replicate": np.arange(replicates), "a": a, "b": b, "d": np.abs(d)})

    return from_distances(pairs.mapInPandas(run, "replicate long, a string, b string, d double"), "replicate", method)


def bootstrap(alignment: DataFrame, id: str = "id", seq: str = "seq", replicates: int = 100, method: str = "nj", seed: int = 1, model: str = "p") -> DataFrame:
    """(split, size, n, support): the share of ``bootstrap_trees`` that have each split; the same at any partitioning."""
    trees = bootstrap_trees(alignment, id, seq, replicates, method, seed, model).withColumn("tree_group", F.lit(1))
    return support(trees).drop("tree_group")
