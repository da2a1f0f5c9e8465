"""Near duplicates among embeddings: exact threshold pairs by dual traversal of cover trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .components import components

COSINE = 0.93
#: The distance of unit vectors at the threshold.
LIMIT = float(np.sqrt(2 - 2 * COSINE))
#: Vectors of a label that stand for its regions: the nearest one decides a vector's block. A fixed number.
PIVOTS = 8
#: Vectors in a block at most, about: a region with more is dealt into several blocks.
BLOCK = 2048
#: Bytes of vectors in a group of blocks, about; a group has one block at least. Two groups meet in a tile, a task's work.
GROUP_BYTES = 4 << 20
#: Groups of a label whose blocks' centres meet the other blocks' in one task.
STRIPE = 64
#: Levels below the root, whose radius is 2 (the diameter of the unit sphere): radii 1, 1/2, ... 1/16.
LEVELS = 5
#: Slack of the pruning bounds for rounding.
SLACK = 1e-9
#: Cosines as near to the threshold are computed anew, pair by pair.
NEAR = 1e-9


class Tree:
    """A cover tree of unit vectors in nested levels: each level's centres are the rows of ``centre[k]``.

    ``parent[k]``: the place of each centre's parent in the level above; ``radius[k]``: its distance to the
    farthest vector below it. The last level has every vector as a centre.
    """

    def __init__(self, unit: np.ndarray):
        n = len(unit)
        self.unit, self.centre, self.parent, self.radius, self.below = unit, [np.array([0])], [np.array([0])], [], []
        home = np.zeros(n, np.int64)  # of each vector: its centre's place in the last level made
        homes = [home]
        for level in range(1, LEVELS + 1):
            reach = 2.0 / 2**level
            centres, new_home, parents = [], np.full(n, -1), []
            for place, old in enumerate(self.centre[-1]):
                members = np.flatnonzero(home == place)
                left, first = members, old
                while len(left):  # a greedy net of the parent's vectors; the parent's centre comes first
                    far = np.sqrt(np.maximum(2 - 2 * (unit[left] @ unit[first]), 0)) > reach
                    near = left[~far] if len(left[~far]) else left[:1]
                    new_home[near] = len(centres)
                    centres.append(first)
                    parents.append(place)
                    left = left[far] if len(left[~far]) else left[1:]
                    first = left[0] if len(left) else -1
            home = new_home
            homes.append(home)
            self.centre.append(np.array(centres))
            self.parent.append(np.array(parents))
        self.centre.append(np.arange(n))
        self.parent.append(home)
        for own, centre in zip(homes, self.centre):
            d = np.sqrt(np.maximum(((unit - unit[centre[own]]) ** 2).sum(1), 0))
            r = np.zeros(len(centre))
            np.maximum.at(r, own, d)
            self.radius.append(r)
            self.below.append(np.bincount(own, minlength=len(centre)))
        self.radius.append(np.zeros(n))
        self.below.append(np.ones(n, np.int64))
        self.homes = [*homes, np.arange(n)]


#: Rows of the last level that are multiplied at once with the columns that they are open to.
TILE = 256


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def dual(a: Tree, b: Tree, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each vector of either tree, and for each the least place, b's after a's, that its links lead to.

    Node pairs whose nearest points are beyond the threshold distance are pruned; pairs whose farthest
    points are within it are taken whole: their links are counted by the nodes' sizes, and the nodes are tied
    together by an edge or two each, whatever the number of pairs. The rest is opened.
    """
    limit, n = LIMIT, len(a.unit)
    count_a, count_b, edges = np.zeros(n, np.int64), np.zeros(len(b.unit), np.int64), []
    shift = 0 if same else n
    open_ = np.ones((1, 1), bool)
    last = len(a.centre) - 1
    for level in range(last + 1):
        if level:
            open_ = open_[a.parent[level]][:, b.parent[level]]
            if same and level == last:
                np.fill_diagonal(open_, False)
        rows, cols = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if not len(rows):
            break
        part = open_[np.ix_(rows, cols)]
        if level == last:
            order = np.argsort(a.homes[level - 1][rows], kind="stable")
            for at in range(0, len(rows), TILE):
                tile = order[at : at + TILE]
                own = np.flatnonzero(part[tile].any(0))
                ca, cb = rows[tile], cols[own]
                cos = a.unit[ca] @ b.unit[cb].T
                near = part[np.ix_(tile, own)]
                hit = near & (cos >= COSINE)
                i, j = np.nonzero(near & (np.abs(cos - COSINE) < NEAR))
                if len(i):
                    hit[i, j] = np.einsum("ij,ij->i", a.unit[ca[i]], b.unit[cb[j]]) >= COSINE
                count_a[ca] += hit.sum(1)
                count_b[cb] += hit.sum(0)
                edges.append(_spanning(ca, cb + shift, hit))
            break
        d = _distances(a.unit[a.centre[level][rows]], b.unit[b.centre[level][cols]])
        ra, rb = a.radius[level][rows], b.radius[level][cols]
        whole = part & (d + ra[:, None] + rb[None, :] <= limit - 1e-7)
        if whole.any():
            for count, tree, at, n_links in ((count_a, a, rows, whole @ b.below[level][cols]), (count_b, b, cols, a.below[level][rows] @ whole)):
                of_node = np.zeros(len(tree.below[level]), np.int64)
                of_node[at] = n_links
                count += of_node[tree.homes[level]]
            if same:  # no vector of a node that is whole with itself links to itself
                itself = rows[(whole & (rows[:, None] == cols[None, :])).any(1)]
                for count in (count_a, count_b):
                    count -= np.isin(a.homes[level], itself)
            edges += [_tied(a, level, rows[whole.any(1)], 0), _tied(b, level, cols[whole.any(0)], shift)]
            edges.append(_spanning(a.centre[level][rows], b.centre[level][cols] + shift, whole))
        part &= ~whole & (d - ra[:, None] - rb[None, :] <= limit + SLACK)
        open_ = np.zeros_like(open_)
        open_[np.ix_(rows, cols)] = part
    return count_a, count_b, _least(edges, n + (0 if same else len(b.unit)))


def _tied(tree: Tree, level: int, nodes: np.ndarray, shift: int) -> np.ndarray:
    """An edge from each vector of the nodes to its node's centre."""
    at = np.flatnonzero(np.isin(tree.homes[level], nodes))
    return np.stack([at, tree.centre[level][tree.homes[level][at]]]) + shift


def _spanning(a: np.ndarray, b: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Edges that connect what ``hit`` connects, one a row or column at most: by the least row that each leads to."""
    rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    if not len(rows):
        return np.zeros((2, 0), np.int64)
    hit, far = hit[np.ix_(rows, cols)], len(a)
    of_row, of_col = rows, None
    while True:
        of_col = np.where(hit, of_row[:, None], far).min(0)
        new = np.minimum(of_row, np.where(hit, of_col[None, :], far).min(1))
        if (new == of_row).all():
            break
        of_row = new
    return np.concatenate([np.stack([a[rows], a[of_row]]), np.stack([b[cols], a[of_col]])], 1)


def _least(edges: list[np.ndarray], n: int) -> np.ndarray:
    """The least place that each of ``n`` places is connected with."""
    label = np.arange(n)
    if edges:
        x, y = np.concatenate(edges, 1)
        while True:
            least = label.copy()
            np.minimum.at(least, label[x], label[y])
            np.minimum.at(least, label[y], label[x])
            least = least[least]
            new = least[label]
            if (new == label).all():
                break
            label = new
    return label


def _units(batch_vectors: list) -> tuple[np.ndarray, list[bool]]:
    ok, units, width = [], [], None
    for v in batch_vectors:
        x = None if v is None else np.array([np.nan if c is None else c for c in v], np.float64)
        norm = 0.0 if x is None or not len(x) else float(np.sqrt((x * x).sum()))
        good = bool(norm > 0 and np.isfinite(norm))
        if x is not None and not good and len(x) and np.isfinite(x).all() and x.any():  # squares out of range
            x = x / np.abs(x).max()
            norm, good = float(np.sqrt((x * x).sum())), True
        ok.append(good)
        units.append(x / norm if good else None)
    return units, ok


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label and unit (its double components) of the rows that can have links."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("width", pa.int32()), ("unit", pa.binary())])

    def fn(batch):
        units, ok = _units(batch.column(2).to_pylist())
        keep = pa.array(ok)
        own = [u for u in units if u is not None]
        return [batch.column(0).filter(keep), batch.column(1).filter(keep), [len(u) for u in own], [u.tobytes() for u in own]]

    rows = vectors.filter("label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL").select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding")
    return rows.mapInArrow(common.batches(fn, schema), "vec_id long, label string, width int, unit binary")


def blocks(rows: DataFrame) -> DataFrame:
    """(block, label, width, bundle, ids, units, centre, radius): the vectors of a label dealt by nearest pivot, BLOCK at most, about.

    ``bundle``: the number of the group that the block is in, within its label and width; neighbours in pivot order share one.
    """
    key = ["label", "width"]
    ranked = rows.select(*key, F.struct(F.xxhash64("vec_id").alias("h"), "vec_id", "unit").alias("x"))
    pivots = ranked.groupBy(*key, F.pmod("x.h", F.lit(PIVOTS)).alias("slot")).agg(F.min("x").alias("x")).groupBy(*key).agg(F.sort_array(F.collect_list("x.unit")).alias("pivots"))
    pivots = common.materialise(pivots.select(*key, F.array_join(F.transform("pivots", lambda x: F.hex(x)), "").alias("pivots")).select(*key, F.unhex("pivots").alias("pivots")), "pivots")
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("width", pa.int32()), ("unit", pa.binary()), ("region", pa.int32())])

    def nearest(batch):
        out, units, groups = np.zeros(batch.num_rows, np.int32), batch.column(3).to_pylist(), {}
        for i, group in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            groups.setdefault(group, []).append(i)
        for (_, width), at in groups.items():
            own = np.frombuffer(b"".join([units[i] for i in at])).reshape(-1, width)
            out[at] = np.argmax(own @ np.frombuffer(batch.column(4)[at[0]].as_py()).reshape(-1, width).T, 1)
        return [*batch.columns[:4], out]

    placed = rows.join(pivots, key).select("vec_id", *key, "unit", "pivots").mapInArrow(common.batches(nearest, schema), "vec_id long, label string, width int, unit binary, region int")
    placed = common.materialise(placed, "placed")
    sizes = placed.groupBy(*key, "region").agg(F.count(F.lit(1)).alias("size")).withColumn("parts", F.ceil(F.col("size") / BLOCK))
    earlier = F.sum("size").over(W.partitionBy(*key).orderBy("region")) - F.col("size")  # a label has PIVOTS regions at most
    sizes = common.materialise(sizes.withColumn("earlier", earlier), "regions")
    dealt = placed.join(sizes, [*key, "region"]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")))
    span = F.greatest(F.lit(BLOCK), F.floor(F.lit(GROUP_BYTES) / (8 * F.col("width"))))
    dealt = dealt.withColumn("bundle", F.floor((F.col("earlier") + F.floor(F.col("size") * F.col("part") / F.col("parts"))) / span).cast("long"))
    out = pa.schema([("label", pa.string()), ("width", pa.int32()), ("bundle", pa.int64()), ("ids", pa.binary()), ("units", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())])

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        raw = b"".join(table.column("unit").to_pylist())
        unit = np.frombuffer(raw).reshape(table.num_rows, -1)
        centre = unit.mean(0)
        radius = float(np.sqrt(((unit - centre) ** 2).sum(1)).max())
        ids = np.array(table.column("vec_id").to_pylist(), np.int64).tobytes()
        first = [[table.column(c)[0].as_py()] for c in ("label", "width", "bundle")]
        return pa.table([*first, [ids], [raw], [centre.tolist()], [radius]], schema=out)

    made = dealt.select(*key, "region", "part", "bundle", "vec_id", "unit").groupBy(*key, "region", "part").applyInArrow(packed, "label string, width int, bundle long, ids binary, units binary, centre array<double>, radius double")
    return common.materialise(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def tiles(own: DataFrame) -> DataFrame:
    """(label, width, bundle_a, bundle_b, block): the pairs of groups that have near blocks, and the blocks that are near one.

    Blocks of a label meet by stripes of its groups, so a label that holds most rows is spread over many tasks; a block's row
    is its centre and radius.
    """
    ends = own.select("block", "label", "width", "bundle", "centre", "radius")
    stripe = F.floor(F.col("bundle") / STRIPE)
    left = ends.withColumn("stripe", stripe).select(*[F.col(c).alias(f"{c}_a") for c in [*ends.columns, "stripe"]])
    right = ends.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), stripe))).select(*[F.col(c).alias(f"{c}_b") for c in [*ends.columns, "stripe"]])
    gap = F.sqrt(F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))
    once = (F.col("bundle_a") < F.col("bundle_b")) | ((F.col("bundle_a") == F.col("bundle_b")) & (F.col("block_a") <= F.col("block_b")))
    same = (F.col("label_a") == F.col("label_b")) & (F.col("width_a") == F.col("width_b")) & (F.col("stripe_a") == F.col("stripe_b"))
    pairs = left.join(right, same & once & (gap - F.col("radius_a") - F.col("radius_b") <= LIMIT + SLACK))
    return pairs.select(F.col("label_a").alias("label"), F.col("width_a").alias("width"), "bundle_a", "bundle_b", F.explode(F.array("block_a", "block_b")).alias("block")).distinct()


def linked(tile: pa.Table) -> pa.Table:
    """The links between a tile's two groups of blocks: a row for each vector with links, their number and one that it leads to."""
    tile = tile.sort_by("block")
    places, low, high = tile.column("bundle").to_pylist(), tile.column("bundle_a")[0].as_py(), tile.column("bundle_b")[0].as_py()
    ids = [np.frombuffer(x.as_buffer(), np.int64) for x in tile.column("ids")]
    trees = [Tree(np.frombuffer(x.as_buffer()).reshape(len(i), -1)) for x, i in zip(tile.column("units"), ids)]
    centres, radii = np.array(tile.column("centre").to_pylist()), tile.column("radius").to_pylist()
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    count, edges = np.zeros(starts[-1], np.int64), []
    for i, j in ((i, j) for i in range(len(ids)) for j in range(i if low == high else 0, len(ids)) if places[i] == low and places[j] == high):
        if np.sqrt(((centres[i] - centres[j]) ** 2).sum()) - radii[i] - radii[j] > LIMIT + SLACK:
            continue
        n_i, n_j, least = dual(trees[i], trees[j], i == j)
        count[starts[i] : starts[i + 1]] += n_i
        at = np.arange(starts[i], starts[i + 1])
        if i != j:
            count[starts[j] : starts[j + 1]] += n_j
            at = np.concatenate([at, np.arange(starts[j], starts[j + 1])])
        led = np.flatnonzero(least != np.arange(len(least)))
        edges.append(np.stack([at[led], at[least[led]]]))
    ids, has = np.concatenate(ids), count > 0
    return pa.table({"a": ids[has], "b": ids[_least(edges, len(ids))[has]], "n": count[has]})


def near_vectors(vectors: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null labels are linked when their cosine is COSINE or more in double precision.
    Vectors that are null, empty, zero or hold null or non-finite components are linked with nothing, and so
    are vectors of different lengths. A label's vectors are dealt to blocks by their nearest pivot, and blocks to groups of
    about GROUP_BYTES; two groups that have near blocks are a tile, a task's row of work: a cover tree of each block, made once
    for all its pairs there; pairs of blocks too far apart by centres and radii are pruned; every other pair is a
    dual traversal that prunes pairs of nodes by covering radius, and counts
    pairs that are all within the threshold without listing them. Whatever a group's size, a tile gives
    one row for each of its vectors that has links: their number, and a vector that it is connected with. All links are exact; each tile has a
    bounded size whatever a label's share of the rows.

    A row with a null vec_id has no links, a null component and isn't kept. Rows that repeat a vec_id are
    vectors of their own that share the sum of their links and a component. No rows give no rows.
    """
    since = common.mark()
    own = blocks(prepared(vectors))
    met = common.materialise(tiles(own), "tiles")
    work = own.select("block", "bundle", "ids", "units", "centre", "radius").join(met, "block")
    links = common.materialise(work.groupBy("label", "width", "bundle_a", "bundle_b").applyInArrow(linked, "a long, b long, n long"), "links")
    counts = links.groupBy("a").agg(F.sum("n").alias("n"))
    groups = components(links.filter("a <> b").select("a", "b"))
    out = vectors.select(F.col("vec_id").cast("long"))
    out = out.join(counts.withColumnRenamed("a", "vec_id"), "vec_id", "left").join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
    return common.sweep(since, out)
