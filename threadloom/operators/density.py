"""Density clustering (hierarchical, variable density) as Spark jobs.

Published method: Campello et al. 2013, McInnes & Healy 2017.  Stages, all on tables:

  neighbours   exact k nearest of every point; core distance
  tree         minimum spanning tree of mutual reachability by Boruvka rounds
  dendrogram   merges in weight order; the edges are cut into bounded runs of weights,
               each run is merged in its own task once its endpoints carry the names of the
               components that lighter runs form (divide and conquer over runs)
  condense     pointer doubling to the first large ancestor and to the cluster's top merge
  select       excess of mass or leaves, then epsilon, then labels
Nothing grows with the data on the driver or in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalise
from ..session import cut
from .graph import TASK_ROWS, climb, components
from .nearest import (
    BLOCK_ROWS,
    MAX_PIVOTS,
    STEP,
    _Block,
    _grouped,
    _nearest_pivot,
    _pivots,
    _plain,
    _sweep,
    exact_distances,
    fast_distances,
    knn,
    prepare,
    stack,
)
from .ordered import numbered

NEIGHBOURS = 12
RUN_EDGES = 200_000
TASK_CLUSTERS = 500_000
TASK_POINTS = 2048
LARGEST_LAMBDA = 1e12
SCOPE = 1 << 42


# --- neighbours --------------------------------------------------------------------


def _points(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``v, id, vec`` with v = 1..n in id order."""
    rows = vectors.filter(F.col(vec_col).isNotNull()).select(
        F.lit(0).alias("all"), F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")
    )
    return cut(numbered(rows, ["all"], ["id"], "v").select(F.col("v").cast("long").alias("v"), "id", "vec"))


def _kernel_metric(metric: str) -> str:
    return {"cosine": "l2", "euclidean": "l2", "manhattan": "manhattan"}[metric]


def core_distances(points: DataFrame, metric: str, min_samples: int, k: int) -> tuple[DataFrame, DataFrame]:
    """``v, core, reach`` and candidate edges ``a, b, d``; ``reach`` is the k-th distance."""
    near = cut(knn(points, k, metric=metric, vector_id="v", vector="vec"))
    core = near.groupBy("id").agg(
        F.max(F.when(F.col("rank") == F.least(F.lit(min_samples), F.lit(k)), F.col("distance"))).alias("core"),
        F.max("distance").alias("reach"),
        F.count("*").alias("found"),
    )
    # with fewer than k others every edge is known and nothing is left to look for
    reach = F.when(F.col("found") < k, F.lit(float("inf"))).otherwise(F.col("reach"))
    cores = cut(core.select(F.col("id").alias("v"), F.coalesce("core", F.col("reach")).alias("core"), reach.alias("reach")))
    return cores, near.select(F.col("id").alias("a"), F.col("neighbour").alias("b"), F.col("distance").alias("d"))


# --- spanning tree -----------------------------------------------------------------
# One rule at every size: weights count to nine places, and edges are ordered by (weight, lower
# point, higher point). No two edges are equal, so the tree is the same however it is found.

_PLACES, _EXACT_BELOW = 1e9, 1e6


def _weight(w: np.ndarray) -> np.ndarray:
    return np.where(w < _EXACT_BELOW, np.floor(w * _PLACES + 0.5) / _PLACES, w)


def _weight_column(w: Column) -> Column:
    return F.when(w < _EXACT_BELOW, F.floor(w * _PLACES + 0.5) / _PLACES).otherwise(w)


def _tree_task(metric: str, min_samples: int):
    """The spanning tree of at most TASK_POINTS points, by Prim's method on their matrix."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["v"].to_numpy()
        x = prepare(stack(pdf["vec"]), metric)
        d = np.zeros((len(x), len(x)))
        for col in x.T:
            step = col[:, None] - col[None, :]
            d += np.abs(step) if metric == "manhattan" else step * step
        if metric != "manhattan":
            d = np.sqrt(d)
        near = min(min_samples, len(x) - 1)
        core = np.partition(d, near, axis=1)[:, near]
        reach = _weight(np.maximum(np.maximum(d, core[:, None]), core[None, :]))
        least, lo, hi = reach[0].copy(), np.minimum(v, v[0]), np.maximum(v, v[0])
        least[0] = np.inf
        inside = np.zeros(len(x), dtype=bool)
        inside[0] = True
        edges = []
        for _ in range(len(x) - 1):
            ties = np.flatnonzero(least == least.min())
            j = int(ties[np.lexsort((hi[ties], lo[ties]))[0]])
            edges.append((lo[j], hi[j], least[j]))
            inside[j] = True
            low, high = np.minimum(v, v[j]), np.maximum(v, v[j])
            tie = (reach[j] == least) & ((low < lo) | ((low == lo) & (high < hi)))
            closer = ((reach[j] < least) | tie) & ~inside
            least[closer], lo[closer], hi[closer] = reach[j][closer], low[closer], high[closer]
            least[j] = np.inf
        return pd.DataFrame(edges, columns=["a", "b", "w"])

    return run


def spanning_tree(
    points: DataFrame, metric: str = "l2", min_samples: int = 1, k: int = NEIGHBOURS, task_points: int = TASK_POINTS
) -> DataFrame:
    """``a, b, w``: minimum spanning tree of mutual reachability, ties by (a, b).

    Few points (counted) are spanned in one task; otherwise components grow by rounds, each
    choosing its least outgoing edge among the known neighbours and, where those do not
    settle it, by a search limited to the cells that can matter.
    """
    if points.count() <= task_points:
        return cut(points.select("v", "vec").groupBy(F.lit(0).alias("g")).applyInPandas(_tree_task(metric, min_samples), "a long, b long, w double"))
    k = max(k, min_samples)
    cores, near = core_distances(points, metric, min_samples, k)
    ca = cores.select(F.col("v").alias("a"), F.col("core").alias("_ca"))
    cb = cores.select(F.col("v").alias("b"), F.col("core").alias("_cb"))
    edges = cut(
        near.join(ca, "a").join(cb, "b").select("a", "b", _weight_column(F.greatest("_ca", "_cb", "d")).alias("w"))
    )
    placed = None
    pivots = None
    comp = cut(cores.select("v", F.col("v").alias("c")))
    tree = None
    while True:
        of_a = comp.select(F.col("v").alias("a"), F.col("c").alias("c"))
        of_b = comp.select(F.col("v").alias("b"), F.col("c").alias("_cb"))
        edges = cut(edges.drop("c").join(of_a, "a").join(of_b, "b").filter("c <> _cb").drop("_cb"))
        best = edges.groupBy("c").agg(F.min(_edge_key()).alias("e"))
        state = comp.join(cores, "v").join(best, "c", "left")
        bound = F.coalesce("e.w", F.lit(float("inf")))
        unsure = cut(state.filter((_weight_column(F.col("reach")) <= bound) & F.col("reach").isNotNull() & (F.col("reach") < float("inf"))).select("v", "c", "core", bound.alias("bound")))
        if not unsure.isEmpty():
            if placed is None:
                named = points.select(F.col("v").alias("vector_id"), F.col("vec").alias("vector"))
                pivots = _pivots(named, metric, MAX_PIVOTS)
                placed = cut(
                    named.withColumn("_p", _nearest_pivot(pivots, metric)("vector"))
                    .select(F.col("vector_id").alias("v"), F.col("vector").alias("vec"), F.col("_p.cell").alias("cell"), F.col("_p.reach").alias("far"))
                    .join(cores.select("v", "core"), "v")
                )
            seen = _nearest_outside(unsure, placed, comp, pivots, metric)
            both = edges.select("c", "a", "b", "w").unionByName(seen.select("c", "a", "b", "w"))
            best = both.groupBy("c").agg(F.min(_edge_key()).alias("e"))
        best = cut(best.select("c", "e.w", "e.lo", "e.hi"))
        added = best.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "w").distinct()
        tree = added if tree is None else tree.unionByName(added)
        # each component points to the one its edge leads to; of a mutual pair the lesser stays
        c_lo = comp.select(F.col("v").alias("lo"), F.col("c").alias("_lo"))
        c_hi = comp.select(F.col("v").alias("hi"), F.col("c").alias("_hi"))
        target = best.join(c_lo, "lo").join(c_hi, "hi").select(
            "c", "lo", "hi", F.when(F.col("_lo") == F.col("c"), F.col("_hi")).otherwise(F.col("_lo")).alias("to")
        )
        back = best.select(F.col("c").alias("to"), F.col("lo").alias("_l"), F.col("hi").alias("_h"))
        mutual = (F.col("lo") == F.col("_l")) & (F.col("hi") == F.col("_h")) & (F.col("c") < F.col("to"))
        hooks = target.join(back, "to", "left").select(
            F.col("c").alias("node"), F.when(F.coalesce(mutual, F.lit(False)), F.col("c")).otherwise(F.col("to")).alias("ptr")
        )
        merged = climb(hooks).select(F.col("node").alias("c"), F.col("ptr").alias("_n"))
        comp = cut(comp.join(merged, "c").select("v", F.col("_n").alias("c")))
        span = comp.agg(F.min("c").alias("lo"), F.max("c").alias("hi")).first()
        if span["lo"] == span["hi"]:
            return cut(tree)


def _edge_key():
    return F.struct("w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))


def _nearest_outside(unsure: DataFrame, placed: DataFrame, comp: DataFrame, pivots: np.ndarray, metric: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For points whose known neighbours do not settle it, the closest point of another
    component.  A cell is skipped when it lies beyond the component's best known edge, or
    when all its points belong to the asking component."""
    s = cut(placed.join(comp.withColumnRenamed("c", "comp"), "v"))
    stats = s.groupBy("cell").agg(
        F.max("far").alias("radius"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")
    ).collect()  # at most MAX_PIVOTS rows
    count = len(pivots)
    radius, lo, hi, size = np.zeros(count), np.full(count, -1), np.full(count, -1), np.zeros(count, dtype=np.int64)
    for r in stats:
        radius[r["cell"]], lo[r["cell"]], hi[r["cell"]], size[r["cell"]] = r["radius"], r["lo"], r["hi"], r["n"]

    def route(asked: pd.Series) -> pd.Series:
        rows = stack(asked)
        x, limit, mine = prepare(rows[:, :-3], metric), rows[:, -1:], rows[:, -2:-1]
        d = _plain(fast_distances(x, pivots, metric), metric)
        inside = (lo == hi)[None, :] & (lo[None, :] == mine)
        near = (d - radius[None, :]) <= limit * (1 + 1e-6) + 1e-5
        return pd.Series([np.nonzero(row)[0].astype("int32") for row in near & ~inside & (size > 0)[None, :]])

    # core, component and bound travel behind the components of a vector; numbers of points are exact in doubles
    asked = unsure.join(placed.select("v", "vec"), "v").select(
        F.col("v").alias("query_id"), F.expr("concat(vec, array(core, double(c), bound))").alias("query_vec")
    )
    others = s.select(F.col("v").alias("vector_id"), F.expr("concat(vec, array(core, double(comp)))").alias("vector"), "cell")
    asked, wanted = _grouped(asked, pivots, metric, route, extra=3)
    return _sweep(asked, others, wanted, 1, metric, block_rows, found=("c long, a long, b long, w double", _Outside))


class _Outside(_Block):
    """For each component of a block's points the least edge to a point of another one."""

    def start(self) -> None:
        rows = np.concatenate(self.x)
        self.q, self.x = prepare(rows[:, :-3], self.metric), None
        self.v = pa.concat_arrays(self.names).to_numpy()
        self.core, self.c, self.least = rows[:, -3], rows[:, -2].astype(np.int64), rows[:, -1].copy()
        self.found = []

    def step(self) -> None:
        if self.q is None:
            self.start()
        v, rows = pa.concat_arrays(self.ids).to_numpy(), np.concatenate(self.rows)
        self.ids, self.rows, self.held = [], [], 0
        y, core, comp = prepare(rows[:, :-2], self.metric), rows[:, -2], rows[:, -1].astype(np.int64)
        step = STEP if self.metric != "manhattan" else max(1, 2**22 // max(1, y.size))
        for at in range(0, len(self.q), step):
            part = slice(at, at + step)
            d = fast_distances(self.q[part], y, self.metric)
            limit = np.minimum(self.least[part], 1e150) * (1 + 1e-6) + 1e-5
            i, j = np.nonzero(d <= (limit if self.metric == "manhattan" else limit * limit * (1 + 1e-9))[:, None])
            other = self.c[at + i] != comp[j]
            i, j = i[other], j[other]
            for a in range(0, len(i), 65536):
                r, c = at + i[a : a + 65536], j[a : a + 65536]
                w = _weight(np.maximum(np.maximum(exact_distances(self.q[r], y[c], self.metric), self.core[r]), core[c]))
                keep = w <= self.least[r]
                self._keep(self.c[r][keep], self.v[r][keep], v[c[keep]], w[keep])
                np.minimum.at(self.least, r, w)
        self._first()

    def _keep(self, c, a, b, w) -> None:
        if len(c):
            order = np.lexsort((np.maximum(a, b), np.minimum(a, b), w, c))
            first = order[np.r_[True, np.diff(c[order]) > 0]]
            self.found.append((c[first], a[first], b[first], w[first]))

    def _first(self) -> None:
        if len(self.found) > 1:
            parts, self.found = [np.concatenate(x) for x in zip(*self.found)], []
            self._keep(*parts)
        if self.found:  # the least edge of a component bounds all its points
            c, _, _, w = self.found[0]
            at = np.minimum(np.searchsorted(c, self.c), len(c) - 1)
            self.least = np.where(c[at] == self.c, np.minimum(self.least, w[at]), self.least)

    def hits(self, fields):
        if self.held:
            self.step()
        for c, a, b, w in self.found if self.q is not None else []:
            yield pa.record_batch([pa.array(x) for x in (c, a, b, w)], names=["c", "a", "b", "w"])


# --- dendrogram --------------------------------------------------------------------

_MERGES = "r long, w double, l_node long, l_vertex long, l_size long, r_node long, r_vertex long, r_size long"


def _merge_run(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merge one run of edges in weight order; endpoints already carry name, size and node."""
    parent: dict[int, int] = {}
    info: dict[int, tuple[int, int, int]] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    rows = []
    pdf = pdf.sort_values("r")
    for r, w, a, sa, na, b, sb, nb in pdf[["r", "w", "ca", "sa", "na", "cb", "sb", "nb"]].itertuples(index=False):
        for name, size, node in ((a, sa, na), (b, sb, nb)):
            if name not in parent:
                parent[name] = name
                info[name] = (node, name, size)
        x, y = find(a), find(b)
        (ln, lv, ls), (rn, rv, rs) = info[x], info[y]
        rows.append((r, w, ln, lv, ls, rn, rv, rs))
        parent[y] = x
        info[x] = (r, -1, ls + rs)
    out = pd.DataFrame(rows, columns=["r", "w", "l_node", "l_vertex", "l_size", "r_node", "r_vertex", "r_size"])
    return out


def dendrogram(tree: DataFrame, run_edges: int = RUN_EDGES, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row per merge, numbered ``r`` by weight: its two sides as earlier merge (``node``)
    or single point (``node`` 0, ``vertex``), with their sizes."""
    ranked = numbered(tree.withColumn("all", F.lit(0)), ["all"], ["w", "a", "b"], "r")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    edges = cut(
        ranked.select(
            F.col("r").cast("long").alias("r"), "w", F.floor((F.col("r") - 1) / run_edges).cast("long").alias("run"),
            F.col("a").alias("ca"), one.alias("sa"), none.alias("na"), F.col("b").alias("cb"), one.alias("sb"), none.alias("nb"),
        )
    )
    runs = (edges.agg(F.max("run")).first()[0] or 0) + 1
    span = 1
    while span < runs:
        span *= 2
    while span > 1:
        half = span // 2
        # one name space for all ranges of this level: a vertex may occur in several
        offset = F.floor(F.col("run") / span).cast("long") * F.lit(SCOPE)
        scoped = edges.withColumns(
            {"xa": offset + F.col("ca"), "xb": offset + F.col("cb"), "heavy": F.floor(F.col("run") / half) % 2 == 1}
        )
        light = cut(scoped.filter(~F.col("heavy")))
        roots = components(light.select(F.col("xa").alias("a"), F.col("xb").alias("b")), task_rows)
        ends = light.select(F.col("xa").alias("node"), F.col("sa").alias("size")).unionByName(
            light.select(F.col("xb").alias("node"), F.col("sb").alias("size"))
        ).distinct()
        sizes = roots.join(ends, "node").groupBy("root").agg(F.sum("size").alias("size"))
        tops = light.select(F.col("xa").alias("node"), "r").join(roots, "node").groupBy("root").agg(F.max("r").alias("top"))
        name = cut(roots.join(sizes, "root").join(tops, "root"))
        heavy = scoped.filter("heavy")
        for side in ("a", "b"):
            mine = name.select(
                F.col("node").alias(f"x{side}"), (F.col("root") % SCOPE).alias("_c"), F.col("size").alias("_s"), F.col("top").alias("_n")
            )
            heavy = heavy.join(mine, f"x{side}", "left").withColumns(
                {f"c{side}": F.coalesce("_c", f"c{side}"), f"s{side}": F.coalesce("_s", f"s{side}"), f"n{side}": F.coalesce("_n", f"n{side}")}
            ).drop("_c", "_s", "_n")
        edges = cut(light.select(edges.columns).unionByName(heavy.select(edges.columns)))
        span = half
    return cut(edges.groupBy("run").applyInPandas(_merge_run, _MERGES))


# --- condensed tree ----------------------------------------------------------------


def condense(merges: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """Condensed clusters and the cluster each point falls out of.

    ``clusters``: ``c, parent, birth, stability, size`` (the root has no parent), and
    ``members``: ``v, c, lam``.
    """
    lam = F.least(F.lit(LARGEST_LAMBDA), F.when(F.col("w") > 0, 1.0 / F.col("w")).otherwise(F.lit(LARGEST_LAMBDA)))
    nodes = merges.select(
        "r", lam.alias("lam"), (F.col("l_size") + F.col("r_size")).alias("size"),
        ((F.col("l_size") >= min_size) & (F.col("r_size") >= min_size)).alias("split"),
    )
    sides = merges.select("r", F.col("l_node").alias("node"), F.col("l_vertex").alias("vertex")).unionByName(
        merges.select("r", F.col("r_node").alias("node"), F.col("r_vertex").alias("vertex"))
    )
    up = sides.filter("node > 0").select(F.col("node").alias("r"), F.col("r").alias("up"))
    above = nodes.select(F.col("r").alias("up"), F.col("split").alias("up_split"), F.col("lam").alias("up_lam"))
    linked = cut(nodes.join(up, "r", "left").join(above, "up", "left"))
    # points: the lowest merge around them that is large enough
    small = linked.select(F.col("r").alias("node"), F.when(F.col("size") >= min_size, F.col("r")).otherwise(F.col("up")).alias("ptr"))
    leaf = sides.filter("node = 0").select(F.col("vertex").alias("v"), F.col("r").alias("node"))
    fallen = leaf.join(climb(small), "node").select("v", F.col("ptr").alias("r"))
    # large merges: the top merge of their cluster
    large = linked.filter(F.col("size") >= min_size)
    is_top = F.col("up").isNull() | F.col("up_split")
    tops = cut(climb(large.select(F.col("r").alias("node"), F.when(is_top, F.col("r")).otherwise(F.col("up")).alias("ptr"))).select(F.col("node").alias("r"), F.col("ptr").alias("c")))
    members = cut(fallen.join(tops, "r").join(nodes.select("r", "lam"), "r").select("v", "c", "lam"))
    heads = large.filter(is_top).select(F.col("r").alias("c"), "size", "up", F.coalesce("up_lam", F.lit(0.0)).alias("birth"))
    born = cut(
        heads.join(tops.select(F.col("r").alias("up"), F.col("c").alias("parent")), "up", "left").select("c", "parent", "birth", "size")
    )
    gone = members.select("c", F.col("lam"), F.lit(1).cast("long").alias("n")).unionByName(
        born.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("c"), F.col("birth").alias("lam"), F.col("size").alias("n"))
    )
    sums = gone.groupBy("c").agg(F.sum(F.col("lam") * F.col("n")).alias("mass"), F.sum("n").alias("n"))
    clusters = born.join(sums, "c", "left").select(
        "c", "parent", "birth", "size", (F.coalesce("mass", F.lit(0.0)) - F.col("birth") * F.coalesce("n", F.lit(0))).alias("stability")
    )
    return cut(clusters), members


# --- selection ---------------------------------------------------------------------


def _values_task(pdf: pd.DataFrame) -> pd.DataFrame:
    """Excess-of-mass values of a bounded rest of the cluster tree, leaves first.

    A cluster has a greater merge number than its descendants, so ascending order works."""
    total = dict(zip(pdf["c"], pdf["below"]))
    value, wins = {}, {}
    for c, parent, own in pdf.sort_values("c")[["c", "parent", "stability"]].itertuples(index=False):
        wins[c] = own >= total[c]
        value[c] = max(own, total[c])
        if parent == parent and parent in total:
            total[parent] += value[c]
    return pd.DataFrame({"c": list(wins), "wins": list(wins.values())})


def _winners(clusters: DataFrame, task_clusters: int) -> DataFrame:
    """``c, wins``: whether a cluster outweighs the best choice among its descendants.

    Leaves are settled round by round until the rest fits one task of bounded size."""
    rest = cut(clusters.select("c", "parent", "stability", F.lit(0.0).alias("below")))
    settled = None
    while rest.count() > task_clusters:
        has_kids = rest.select(F.col("parent").alias("c")).filter("c is not null").distinct()
        leaves = cut(rest.join(has_kids, "c", "left_anti"))
        done = leaves.select("c", (F.col("stability") >= F.col("below")).alias("wins"))
        settled = cut(done if settled is None else settled.unionByName(done))
        gain = leaves.groupBy(F.col("parent").alias("c")).agg(F.sum(F.greatest("stability", "below")).alias("_g"))
        rest = cut(
            rest.join(leaves.select("c"), "c", "left_anti").join(gain, "c", "left")
            .select("c", "parent", "stability", (F.col("below") + F.coalesce("_g", F.lit(0.0))).alias("below"))
        )
    last = rest.groupBy(F.lit(0).alias("g")).applyInPandas(_values_task, "c long, wins boolean")
    return cut(last if settled is None else settled.unionByName(last))


def select_clusters(clusters: DataFrame, method: str = "eom", epsilon: float = 0.0, task_clusters: int = TASK_CLUSTERS) -> DataFrame:
    """``c`` of the chosen clusters; the root is never chosen."""
    inner = clusters.filter(F.col("parent").isNotNull())
    if method == "leaf":
        chosen = inner.join(clusters.select(F.col("parent").alias("c")).filter("c is not null").distinct(), "c", "left_anti").select("c")
    else:
        wins = _winners(clusters, task_clusters).join(clusters.select("c", "parent"), "c")
        # the nearest winner at or above each cluster's parent; chosen ones have none
        stop = F.col("parent").isNull() | F.col("wins")
        ups = climb(wins.select(F.col("c").alias("node"), F.when(stop, F.col("c")).otherwise(F.col("parent")).alias("ptr")))
        end = ups.join(wins.select(F.col("c").alias("ptr"), (F.col("wins") & F.col("parent").isNotNull()).alias("covered")), "ptr")
        chosen = (
            wins.filter("wins and parent is not null")
            .join(end.select(F.col("node").alias("parent"), "covered"), "parent")
            .filter("not covered")
            .select("c")
        )
    if epsilon <= 0.0:
        return cut(chosen)
    roots = clusters.filter(F.col("parent").isNull()).select(F.col("c").alias("parent"), F.lit(True).alias("under_root"))
    eps = inner.join(roots, "parent", "left").select(
        "c", "parent", (1.0 / F.col("birth")).alias("eps"), F.coalesce("under_root", F.lit(False)).alias("under_root")
    )
    # up to the first ancestor born above epsilon, or the last one below the root
    halt = (F.col("eps") > epsilon) | F.col("under_root")
    ends = climb(eps.select(F.col("c").alias("node"), F.when(halt, F.col("c")).otherwise(F.col("parent")).alias("ptr")))
    moved = chosen.join(eps.select("c", "eps"), "c").join(ends.select(F.col("node").alias("c"), "ptr"), "c")
    return cut(moved.select(F.when(F.col("eps") < epsilon, F.col("ptr")).otherwise(F.col("c")).alias("c")).distinct())


# --- public operators --------------------------------------------------------------


def checked_size(n: int, min_cluster_size: int) -> int:
    if min_cluster_size < 2:
        raise ValueError(f"min_cluster_size must be at least 2, got {min_cluster_size}")
    return max(2, n // 2) if min_cluster_size > n else min_cluster_size


def _unit(points: DataFrame, metric: str) -> DataFrame:
    return points.withColumn("vec", l2_normalise(F.col("vec"))) if metric == "cosine" else points


def cluster(
    vectors: DataFrame,
    id_col: str = "chunk_id",
    vec_col: str = "embedding",
    *,
    min_cluster_size: int = 2,
    min_samples: int = 1,
    metric: str = "cosine",
    method: str = "eom",
    epsilon: float = 0.0,
    run_edges: int = RUN_EDGES,
    task_clusters: int = TASK_CLUSTERS,
    neighbours: int = NEIGHBOURS,
    task_points: int = TASK_POINTS,
) -> DataFrame:
    """``id_col, label``: labels 0.. in order of their first member, -1 for noise."""
    if metric not in ("cosine", "euclidean", "manhattan"):
        raise ValueError(f"metric '{metric}' not supported")
    points = cut(_unit(_points(vectors, id_col, vec_col), metric))
    n = points.count()
    size = checked_size(n, min_cluster_size)
    if n < 2:
        return points.select(F.col("id").alias(id_col), F.lit(-1).cast("long").alias("label"))
    tree = spanning_tree(points, _kernel_metric(metric), min_samples, neighbours, task_points)
    clusters, members = condense(dendrogram(tree, run_edges), size)
    chosen = select_clusters(clusters, method, epsilon, task_clusters).withColumn("hit", F.lit(True))
    own = clusters.join(chosen, "c", "left")
    stop = F.col("hit").isNotNull() | F.col("parent").isNull()
    ends = climb(own.select(F.col("c").alias("node"), F.when(stop, F.col("c")).otherwise(F.col("parent")).alias("ptr")))
    found = members.join(ends.select(F.col("node").alias("c"), "ptr"), "c").join(chosen.select(F.col("c").alias("ptr"), "hit"), "ptr")
    firsts = found.groupBy("ptr").agg(F.min("v").alias("first")).withColumn("all", F.lit(0))
    names = numbered(firsts, ["all"], ["first"], "n").select("ptr", (F.col("n") - 1).cast("long").alias("label"))
    labelled = found.select("v", "ptr").join(names, "ptr").select("v", "label")
    return points.join(labelled, "v", "left").select(F.col("id").alias(id_col), F.coalesce("label", F.lit(-1)).alias("label"))


def flat_cut(vectors: DataFrame, epsilon: float, id_col: str = "chunk_id", vec_col: str = "embedding", metric: str = "euclidean", task_points: int = TASK_POINTS) -> DataFrame:
    """``id_col, root``: groups connected by steps of at most ``epsilon``, named by least id.

    Two points are so connected exactly when the spanning tree connects them by such edges,
    so no list of all close pairs is needed.
    """
    points = cut(_unit(_points(vectors, id_col, vec_col), metric))
    tree = spanning_tree(points, _kernel_metric(metric), task_points=task_points)
    roots = components(tree.filter(F.col("w") <= epsilon))
    named = points.join(roots.select(F.col("node").alias("v"), "root"), "v", "left").select("id", F.coalesce("root", "v").alias("root"))
    ids = points.select(F.col("v").alias("root"), F.col("id").alias("root_id"))
    return named.join(ids, "root").select(F.col("id").alias(id_col), F.col("root_id").alias("root"))


def spanning_tree_of(vectors: DataFrame, id_col: str = "chunk_id", vec_col: str = "embedding", metric: str = "euclidean", min_samples: int = 1, task_points: int = TASK_POINTS) -> DataFrame:
    """The tree with the caller's ids."""
    points = cut(_unit(_points(vectors, id_col, vec_col), metric))
    tree = spanning_tree(points, _kernel_metric(metric), min_samples, task_points=task_points)
    ids = points.select("v", "id")
    return (
        tree.join(ids.select(F.col("v").alias("a"), F.col("id").alias("_a")), "a")
        .join(ids.select(F.col("v").alias("b"), F.col("id").alias("_b")), "b")
        .select(F.col("_a").alias("a"), F.col("_b").alias("b"), "w")
    )
