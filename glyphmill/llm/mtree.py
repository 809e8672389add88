"""Exact top-k by inner product with M-trees.

Vectors are integers.  With one more component, sqrt(M - |x|^2) for stored vectors (M: the largest squared length) and
0 for queries, the squared Euclidean distance of a query and a stored vector is |q|^2 + M - 2 q.x, so the nearest
vectors are those of greatest inner product.  The stored vectors are kept in M-trees: pages of entries with covering
radii and distances to the parent's routing vector.  A search takes the pages of least possible distance first, and
the triangle inequality over stored distances spares it distances of entries that cannot matter.  The queries of a
block search a tree together: each keeps its own order and bound, and those that want the same page share a product.

The forest is distributed.  Its upper levels are pivots, which grow in number with the vectors, and shells of distance
around each pivot, cut so that a tree has a bounded number of vectors.  A query first searches the tree it would lie
in, which gives it a bound, then the few trees nearest to it, and at last all others that its bound still reaches.
Only trees that some query of a block reaches travel to that block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.session import checkpointed, semi_by_size, tidy

#: Entries of a page.
PAGE = 96
#: Pivots at least and at most; between these, one for each half TREE of vectors.
PIVOTS = 32
MOST_PIVOTS = 1024
#: Vectors that the pivots are chosen from (by smallest hash), for each pivot.
SAMPLE = 16
#: Distinct vectors of a tree, and distinct queries that a tree sees in one task, on average.
TREE = 8192
QUERIES = 2048
#: Trees that a query visits in each round of the search, nearest first; the last round visits all that are left.
ROUNDS = (1, 4, 0)
#: Rows of tree bounds (about 40 bytes each) and of wanted trees that may be broadcast.
BROADCAST_ROWS = 200_000


class Forest:
    """Metric of stored vectors (rows of integers) and queries, in doubles; products are exact integers."""

    def __init__(self, most: float):
        self.most = most  # M
        self.slack = 1e-7 * (1 + math.sqrt(most))

    def extra(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.most - (x * x).sum(axis=1)))

    def stored(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of all rows of ``x`` to all rows of ``y``, both with their extra components."""
        square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
        return np.sqrt(np.maximum(0.0, square))

    def products(self, x: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Exact inner products (int64) of integer rows of ``x``, stored ones, with the rows of ``queries``."""
        if self.most * float((queries * queries).sum(axis=1).max(initial=0)) < 2.0**104:  # no partial sum passes 2**52
            return (x @ queries.T).astype(np.int64)
        return x.astype(np.int64) @ queries.T.astype(np.int64)

    def query(self, square, products: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, square + self.most - 2 * products))


class Page:
    """Entries of one node: vectors, covering radii (0 in leaves), distances to the routing vector above, children."""

    __slots__ = ("leaf", "vectors", "radii", "up", "children")

    def __init__(self, leaf: bool, vectors: np.ndarray, radii: np.ndarray, up: np.ndarray, children: list[int]):
        self.leaf, self.vectors, self.radii, self.up, self.children = leaf, vectors, radii, up, np.asarray(children)


def build(x: np.ndarray, root: np.ndarray, forest: Forest, page: int = PAGE) -> list[Page]:
    """Pages of a tree over the rows of ``x``; children of leaves are row numbers.  Page 0 is the root.

    ``root`` is the routing vector (with its extra component) above the root page.
    """
    full = np.column_stack([x, forest.extra(x)])
    pages: list[Page | None] = []

    def place(rows: np.ndarray, above: np.ndarray) -> int:
        own = len(pages)
        pages.append(None)
        up = forest.stored(full[rows], above[None, :])[:, 0]
        if len(rows) <= page:
            pages[own] = Page(True, x[rows], np.zeros(len(rows)), up, rows.tolist())
            return own
        # Routing vectors: half of them each the farthest from those before it, half spread over all rows.
        ways = min(page, -(-len(rows) // page) * 2)
        some = rows[np.linspace(0, len(rows) - 1, min(len(rows), 16 * ways)).astype(int)]
        apart = some[_farthest(full[some], -(-ways // 2), forest)]
        routing = np.concatenate([apart, rows[np.linspace(0, len(rows) - 1, ways // 2 + 1).astype(int)]])
        routing = routing[np.unique(x[routing], axis=0, return_index=True)[1]]
        distance = forest.stored(full[rows], full[routing])
        nearest = distance.argmin(axis=1)
        if (nearest == nearest[0]).all():  # all alike: cut evenly
            nearest = np.arange(len(rows)) % len(routing) if len(routing) > 1 else np.arange(len(rows)) // page
            if len(routing) == 1:
                routing = np.repeat(routing, nearest.max() + 1)
                distance = np.repeat(distance, len(routing), axis=1)
        groups = [(k, np.flatnonzero(nearest == k)) for k in range(len(routing))]
        groups = [(k, g) for k, g in groups if len(g)]
        chosen = routing[[k for k, _ in groups]]
        radii = np.array([distance[g, k].max() for k, g in groups])
        children = [place(rows[g], full[routing[k]]) for k, g in groups]
        pages[own] = Page(False, x[chosen], radii, forest.stored(full[chosen], above[None, :])[:, 0], children)
        return own

    place(np.arange(len(x)), root)
    return pages


class Best:
    """The ``k`` best (query, id, score) of each of ``m`` queries: scores from high to low, ties to the smaller id."""

    def __init__(self, m: int, k: int):
        self.k = k
        self.query, self.id, self.score = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.least = np.full(m, np.iinfo(np.int64).min)  # scores under these can't get in

    def add(self, query: np.ndarray, id_: np.ndarray, score: np.ndarray) -> None:
        query, id_, score = (np.concatenate(x) for x in ((self.query, query), (self.id, id_), (self.score, score)))
        order = np.lexsort((id_, -score, query))
        query, id_, score = query[order], id_[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.query, self.id, self.score = (x[place < self.k] for x in (query, id_, score))
        last = place == self.k - 1
        self.least[query[last]] = score[last]


def search(pages: list[Page], ids: list[np.ndarray], queries: np.ndarray, to_root: np.ndarray, forest: Forest, k: int, bound: np.ndarray) -> tuple[Best, int]:
    """The ``k`` best of the tree's vectors for each row of ``queries``, and the number of distances computed.

    ``ids``: the ids that stand for each stored row.  ``to_root``: distances to the routing vector above the root page.
    Nothing farther than ``bound`` (one for each query, inf: none) is of interest.  Every wave takes the nearest pages
    of each query, twice as many as the wave before.
    """
    square = (queries * queries).sum(axis=1)
    bound = bound + forest.slack
    best = Best(len(queries), k)
    # Pages that are still to be visited: by which query, how near it can be at least, and the distance above.
    query, page, low, above = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64), np.zeros(len(queries)), to_root
    sizes = np.array([len(x) for x in ids])
    computed, width = 0, 1
    while len(query):
        order = np.lexsort((low, query))
        query, page, low, above = query[order], page[order], low[order], above[order]
        nearest = np.arange(len(query)) - np.searchsorted(query, query) < width
        now = np.flatnonzero(nearest)
        now = now[np.argsort(page[now], kind="stable")]
        further: list[tuple] = [(query[~nearest], page[~nearest], low[~nearest], above[~nearest])]
        hits: list[tuple] = []
        for rows in np.split(now, np.flatnonzero(np.diff(page[now])) + 1):
            p, q = pages[page[rows[0]]], query[rows]
            wanted = np.abs(above[rows][None, :] - p.up[:, None]) - p.radii[:, None] <= bound[q][None, :]
            near = np.flatnonzero(wanted.any(axis=1))
            if not len(near):
                continue
            scores = forest.products(p.vectors[near], queries[q])
            computed += scores.size
            children = p.children[near]
            if p.leaf:
                i, j = np.nonzero(wanted[near] & (scores >= best.least[q][None, :]))
                hits.append((q[j], children[i], scores[i, j]))
            else:
                far = forest.query(square[q][None, :], scores)
                lows = np.maximum(0.0, far - p.radii[near][:, None])
                i, j = np.nonzero(wanted[near] & (lows <= bound[q][None, :]))
                further.append((q[j], children[i], lows[i, j], far[i, j]))
        if hits:
            asked, row, score = (np.concatenate(x) for x in zip(*hits))
            n = sizes[row]
            best.add(np.repeat(asked, n), np.concatenate([ids[r] for r in row] or [np.zeros(0, np.int64)]), np.repeat(score, n))
            full = best.least > np.iinfo(np.int64).min
            bound = np.where(full, np.minimum(bound, forest.query(square, np.where(full, best.least, 0).astype(float)) + forest.slack), bound)
        query, page, low, above = (np.concatenate(x) for x in zip(*further))
        open_ = low <= bound[query]
        query, page, low, above = query[open_], page[open_], low[open_], above[open_]
        width *= 2
    return best, computed


def _vectors(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column)).reshape(len(column), width) if width else np.zeros((len(column), 0))


def _pages_of(forest: Forest, pivots: np.ndarray):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        x = _vectors(pdf["packed"], pivots.shape[1])
        pivot = int(pdf["pivot"].iloc[0])
        root = np.append(pivots[pivot], forest.extra(pivots[pivot][None, :]))
        ids = pdf["ids"].tolist()
        rows = []
        for number, p in enumerate(build(x, root, forest)):
            own = [np.asarray(ids[c], dtype=np.int64) for c in p.children] if p.leaf else []
            rows.append(
                (pivot, int(pdf["shell"].iloc[0]), int(pdf["part"].iloc[0]), number, p.leaf, p.vectors.astype(np.float64).tobytes(), p.radii.tobytes(), p.up.tobytes(), list(range(len(p.children))) if p.leaf else list(p.children), [len(i) for i in own], np.concatenate(own).tolist() if own else [])
            )
        return pd.DataFrame(rows, columns=["pivot", "shell", "part", "page", "leaf", "vectors", "radii", "up", "children", "n_ids", "ids"])

    return of


_PAGES = "pivot int, shell int, part int, page int, leaf boolean, vectors binary, radii binary, up binary, children array<int>, n_ids array<int>, ids array<long>"


def _loaded(pdf: pd.DataFrame, width: int) -> tuple[list[Page], list[np.ndarray]]:
    pages, ids = [], []
    for r in pdf.sort_values("page").itertuples():
        children = np.array(r.children, dtype=np.int64)
        if r.leaf:
            children = len(ids) + children
            ids += np.split(np.asarray(r.ids, dtype=np.int64), np.cumsum(r.n_ids)[:-1])
        pages.append(Page(bool(r.leaf), _vectors([r.vectors], len(children) * width).reshape(len(children), width), np.frombuffer(r.radii), np.frombuffer(r.up), children))
    return pages, ids


def _searched(forest: Forest, pivots: np.ndarray, k: int, counter):
    def of(key, tree: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not (len(tree) and len(queries)):
            return pd.DataFrame({"rep": [], "vec_id": [], "score": []}, dtype="int64")
        pages, ids = _loaded(tree, pivots.shape[1])
        best, computed = search(pages, ids, _vectors(queries["packed"], pivots.shape[1]), queries["far"].to_numpy(), forest, k, queries["bound"].to_numpy())
        if counter is not None:
            counter.add(computed)
        return pd.DataFrame({"rep": queries["rep"].to_numpy()[best.query], "vec_id": best.id, "score": best.score})

    return of


def _packed(column: pa.Array, width: int) -> tuple[np.ndarray, pa.Array]:
    """A column of integer arrays of ``width`` as rows of doubles, and these as bytes."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
    return x, pa.array([row.tobytes() for row in x], pa.binary())


def _dealt(forest: Forest, pivots: np.ndarray):
    """The nearest pivot of each vector, and the distance to it."""
    extra = np.column_stack([pivots, forest.extra(pivots)])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, packed = _packed(batch.column(1), pivots.shape[1])
                far = forest.stored(np.column_stack([x, forest.extra(x)]), extra)
                own = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, batch.column(2), pa.array(own, pa.int32()), pa.array(far[np.arange(len(x)), own])], ["rep", "vector", "packed", "ids", "pivot", "up"])

    return of


def _reached(forest: Forest, pivots: np.ndarray, lows: np.ndarray, highs: np.ndarray, home: bool):
    """For each query the pivots some of whose vectors may lie within its bound (at ``home`` only the nearest pivot), and the distances."""
    full = np.flatnonzero(highs >= 0)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = _vectors(batch.column(1).to_pylist(), pivots.shape[1])
                bound = batch.column(2).to_numpy()
                far = forest.query((q * q).sum(1)[:, None], forest.products(pivots[full], q).T.astype(float))
                if home:
                    i, p = np.arange(len(q)), far.argmin(axis=1)
                else:
                    i, p = np.nonzero(np.maximum(far - highs[full], lows[full] - far) <= bound[:, None] + forest.slack)
                some = batch.select([0, 2]).take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(full[p], pa.int32()), pa.array(far[i, p])], ["rep", "bound", "pivot", "far"])

    return of


def scaled(embeddings: DataFrame, factor: int = 256) -> DataFrame:
    """``vec_id, vector``: floor(factor * x) of every component; rows without a whole finite vector are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * factor).cast("long")).alias("vector"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, counter=None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row of ``queries`` the ``k`` vectors of greatest inner product.

    Both tables have ``vec_id, vector`` (arrays of integers); a query's own vec_id is no candidate.  Ties go to the
    smaller vec_id; with fewer than ``k`` candidates all are given.

    - Vectors are compared within their number of components; a query without others of its length has no rows.
    - Equal vectors are stored once, with as many of their smallest ids as can be needed (k + 1, where ids don't repeat), so a vector that many rows share costs one entry.
    - Repeated rows (same id and vector) count once.  Null ids or vectors take no part.  Empty tables give no rows.
    - An id with several vectors is a candidate with each of them, and a query with each of its own; its rows are
      ranked together, and an id may come more than once.

    Products are exact while they fit 64 bits.  ``counter``: an accumulator of the distances computed below the pivots.
    """
    out = None
    vectors = vectors.where("vec_id is not null and vector is not null").select("vec_id", "vector")
    queries = queries.where("vec_id is not null and vector is not null").select("vec_id", "vector").distinct()
    widths = [r[0] for r in queries.select(F.size("vector")).distinct().collect()]
    for width in sorted(widths):
        some = _top_k(vectors.where(F.size("vector") == width), queries.where(F.size("vector") == width), k, counter)
        out = some if out is None else out.union(some)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _top_k(vectors: DataFrame, queries: DataFrame, k: int, counter) -> DataFrame:
    spark = vectors.sparkSession
    # A query's own vectors may be among its best: so many more are kept.
    deep = k + (queries.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0)
    ranked = vectors.withColumn("_n", F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("_n") <= deep)
    # The number of a class is only good within this checkpoint.
    classes = checkpointed(ranked.groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("rep"), "vector", "ids"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most, n = classes.agg(F.max(square), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    forest = Forest(most)
    wanted = min(MOST_PIVOTS, max(PIVOTS, -(-2 * n // TREE)))
    sample = [r.vector for r in classes.orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE * wanted).select("vector").collect()]
    x = np.array(sample, dtype=np.float64).reshape(len(sample), -1)
    pivots = x[_farthest(np.column_stack([x, forest.extra(x)]), wanted, forest)]
    dealt = checkpointed(classes.select("rep", "vector", "ids").mapInArrow(tidy(_dealt(forest, pivots)), "rep long, vector array<long>, packed binary, ids array<long>, pivot int, up double"))
    reps = queries.withColumnRenamed("vec_id", "query_id").join(dealt.select("vector", "rep", "packed"), "vector").drop("vector")
    asked = checkpointed(reps)
    # Shells: a pivot with more than TREE vectors is cut by distance; a shell of ties that is still too large, by hash.
    sizes = {r.pivot: r["count"] for r in dealt.groupBy("pivot").count().collect()}
    cuts = {}
    if large := {p: -(-size // TREE) for p, size in sizes.items() if size > TREE}:
        steps = max(large.values())
        marks = dealt.where(F.col("pivot").isin(list(large))).groupBy("pivot").agg(F.percentile_approx("up", [i / steps for i in range(1, steps)], 100 * steps).alias("at")).collect()
        cuts = {r.pivot: sorted({r.at[round(i * steps / large[r.pivot]) - 1] for i in range(1, large[r.pivot])}) for r in marks}
    shell = F.lit(0)
    if cuts:
        table = F.create_map(*[F.lit(x) for p, at in cuts.items() for x in (p, F.array(*[F.lit(float(y)) for y in at]))])
        shell = F.coalesce(F.size(F.filter(F.element_at(table, F.col("pivot")), lambda y: y < F.col("up"))), F.lit(0))
    placed = dealt.withColumn("shell", shell.cast("int"))
    trees = checkpointed(placed.groupBy("pivot", "shell").agg(F.ceil(F.count("*") / (2 * TREE)).cast("int").alias("parts"), F.min("up").alias("low"), F.max("up").alias("high")))
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    placed = semi_by_size(placed, trees.select("pivot", "shell", "parts"), ["pivot", "shell"], "inner", BROADCAST_ROWS).withColumn("part", part)
    keys = ["pivot", "shell", "part"]
    pages = checkpointed(placed.select("rep", "packed", "ids", *keys).groupBy(*keys).applyInPandas(_pages_of(forest, pivots), _PAGES))
    ends = {r.pivot: (r.low, r.high) for r in trees.groupBy("pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    lows, highs = (np.array([ends.get(p, (0.0, -1.0))[i] for p in range(len(pivots))]) for i in (0, 1))
    blocks = max(1, -(-asked.select("rep").distinct().count() // QUERIES))

    def pairs(open_: DataFrame, home: bool) -> DataFrame:
        """Trees that ``open_(rep, packed, bound)`` may still need, and how near they can be at least."""
        reached = open_.select("rep", "packed", "bound").mapInArrow(tidy(_reached(forest, pivots, lows, highs, home)), "rep long, bound double, pivot int, far double")
        least = F.greatest(F.lit(0.0), F.col("far") - F.col("high"), F.col("low") - F.col("far"))
        return semi_by_size(reached, trees, "pivot", "inner", BROADCAST_ROWS).withColumn("least", least).where(F.col("least") <= F.col("bound") + forest.slack)

    def search_in(visits: DataFrame) -> DataFrame:
        """The best of each tree for ``visits(rep, bound, far, pivot, shell, parts)``."""
        part_of = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        by = visits.select("rep", "bound", "far", "pivot", "shell", part_of, F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block")).join(own, "rep")
        # A tree travels to the blocks whose queries want it.
        there = checkpointed(by.select(*keys, "block").distinct())
        spread = semi_by_size(pages, there, keys, "inner", BROADCAST_ROWS)
        return spread.groupBy(*keys, "block").cogroup(by.groupBy(*keys, "block")).applyInPandas(_searched(forest, pivots, deep, counter), "rep long, vec_id long, score long")

    nearest = Window.partitionBy("rep").orderBy("least", "far", "pivot", "shell")
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    own = asked.select("rep", "packed").dropDuplicates(["rep"])
    squared = own.mapInArrow(tidy(_squares(pivots.shape[1])), "rep long, square double")
    top = visited = None
    for most_trees in ROUNDS:
        if top is None:  # home needs no bound
            visits = pairs(own.withColumn("bound", F.lit(math.inf)), True)
        else:
            kth = top.where(F.col("_n") == deep).select("rep", F.col("score").alias("kth")).join(squared, "rep")
            far = F.sqrt(F.greatest(F.lit(0.0), F.col("square") + F.lit(float(most)) - 2 * F.col("kth")))
            open_ = own.join(kth.select("rep", far.alias("bound")), "rep", "left").withColumn("bound", F.coalesce("bound", F.lit(math.inf)))
            visits = pairs(open_, False).join(visited, ["rep", "pivot", "shell"], "left_anti")
        if most_trees:
            visits = visits.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= most_trees).drop("_n")
        visits = checkpointed(visits.select("rep", "bound", "far", "pivot", "shell", "parts"))
        seen = visits.select("rep", "pivot", "shell")
        visited = seen if visited is None else visited.union(seen)
        found = search_in(visits)
        found = found if top is None else top.select("rep", "vec_id", "score").union(found)
        top = checkpointed(found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= deep))
    joined = asked.select("query_id", "rep").join(top.drop("_n"), "rep").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return joined.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _squares(width: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _vectors(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((q * q).sum(1))], ["rep", "square"])

    return of


def _farthest(full: np.ndarray, most: int, forest: Forest) -> np.ndarray:
    """Up to ``most`` row numbers, each the farthest from those before it; equal rows are taken once."""
    chosen = [0]
    far = forest.stored(full, full[:1])[:, 0]
    while len(chosen) < min(most, len(full)):
        next_ = int(far.argmax())
        if far[next_] <= forest.slack:
            break
        chosen.append(next_)
        far = np.minimum(far, forest.stored(full, full[next_ : next_ + 1])[:, 0])
    return np.array(chosen)
