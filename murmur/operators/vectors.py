"""Similarity search and clustering on dense vectors (C8): an inverted file.

Vectors are scaled to length one and equal ones collapse into a class (its
smallest id stands for it, with the number of copies), so a vector repeated in
a third of all rows is one row of work.  The index deals the classes to *cells*
(the nearest of the centroids, which are fitted on a bounded sample) and within
a cell to *rings* of equal angle to the centroid; a ring of more than BLOCK
classes is split by hash.  Every row is indexed.

Range search (``similar_vectors``) is exact: by the triangle inequality on the
sphere, a vector within angle phi of a query whose angle to the centroid is
theta lies in the rings from theta - phi to theta + phi, and only those are
asked.  ``exact_neighbours`` finds the k nearest the same way, phi being the
angle to the k-th best of the nearest cells.  Approximate search
(``nearest_vectors``) asks the cells nearest to the query alone; how many is not guessed but measured (``probes_for``): true
neighbours of a bounded sample of queries are found by brute force over all
rows, and the least number of cells that holds the wanted share of them is used.

Clustering (``dense_clusters``) needs every pair within a wide angle, where rings
leave little out: classes are dealt to blocks by hash, every pair of blocks is a
task, and what leaves it are counts and spanning trees, never the pairs.

Queries meet a block of the index as one matrix product.  Queries of a block
are split by hash as well, so neither side of a product grows with the data,
however many queries ask for the same cell.

Null vectors, vectors without entries, with null or non-finite entries, of
another length than the most frequent one, or of norm zero have no direction:
they are in no class."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import spread

MAX_CELLS = 4096
SAMPLE = 65_536      # vectors that the centroids are fitted on, at most
ROUNDS = 8
RING = 0.16          # radians
BLOCK = 4096         # classes, and queries, of one matrix product
PROBE_SAMPLE = 256   # queries whose true neighbours set the number of probes
SLACK = 1e-6
PART = 1 << 21       # numbers in a block of clustering's vectors (16 MB), and in a piece of a matrix of cosines
LEAST_PARTS = 10     # blocks of clustering, while those are smaller


def _as_matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else 1)


def unit_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, u array<double>) of the rows that have a direction, all of one length."""
    v = F.col(vec_col).cast("array<double>")
    ok = (vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND size(v) > 0")
          .filter(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
          .withColumn("s", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).filter("s > 0"))
    rows = cut(spread(ok, "id").select("id", F.transform("v", lambda c: c / F.col("s")).alias("u")))
    most = rows.groupBy(F.size("u").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows if most is None else rows.filter(F.size("u") == most.d)


def classes_of(units: DataFrame, query: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(classes: uid, u, mult, asks; members: id, uid).  ``query`` marks the rows
    that are queries; a class with one of them asks."""
    asks = F.lit(True) if query is None else F.coalesce(query, F.lit(False))
    classes = cut(units.groupBy("u").agg(F.min("id").alias("uid"), F.count(F.lit(1)).alias("mult"), F.max(asks).alias("asks")))
    return classes, units.join(classes.select("u", "uid"), "u").select("id", "uid")


# ------------------------------------------------------------------------ index

def fit_centroids(classes: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Spherical k-means on at most ``sample`` classes (those with the smallest
    hash of the id): one row per cell, at most MAX_CELLS."""
    n = classes.count()
    if not n:
        return np.ones((1, 1))
    cells = min(cells or max(1, round(math.sqrt(n))), MAX_CELLS, max(n, 1))
    rows = classes.select("u", F.xxhash64("uid").alias("h"), "uid").orderBy("h", "uid").limit(sample).select("u").toArrow()
    x = _as_matrix(rows["u"]).astype(np.float32)
    centre = x[:cells].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([np.argmax(x[a:a + BLOCK] @ centre.T, axis=1) for a in range(0, len(x), BLOCK)])
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(size > 1e-6, total / np.maximum(size, 1e-6), centre)
    return centre.astype(np.float64) / np.linalg.norm(centre.astype(np.float64), axis=1, keepdims=True)


def _angles(u: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ centre.T, -1.0, 1.0))


@dataclass
class Index:
    """classes with their place (cell, ring, piece), the pieces of every ring, the centroids."""
    rows: DataFrame       # uid, u, mult, asks, cell, ring, piece
    rings: DataFrame      # cell, ring, pieces
    centre: np.ndarray


def build_index(classes: DataFrame, cells: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> Index:
    centre = fit_centroids(classes, cells, sample)

    def assign(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                a = _angles(_as_matrix(part.column("u")), centre)
                cell = a.argmin(axis=1)
                ring = np.floor(a[np.arange(len(a)), cell] / RING).astype(np.int32)
                yield pa.record_batch([*part.columns, pa.array(cell.astype(np.int32)), pa.array(ring)],
                                      names=["uid", "u", "mult", "asks", "cell", "ring"])

    placed = cut(classes.select("uid", "u", "mult", "asks")
                 .mapInArrow(assign, "uid long, u array<double>, mult long, asks boolean, cell int, ring int"))
    rings = cut(placed.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("pieces")))
    rows = (placed.join(F.broadcast(rings), ["cell", "ring"])     # at most MAX_CELLS * pi / RING rows of 12 bytes
            .withColumn("piece", F.pmod(F.xxhash64("uid"), F.col("pieces")).cast("int")).drop("pieces"))
    return Index(rows, rings, centre)


# ----------------------------------------------------------------------- search

def _asked_rings(queries: DataFrame, index: Index, reach: float | None, probes: int | None) -> DataFrame:
    """(qid, cell, ring, piece) for queries (qid, u): what lies within the angle
    ``reach`` (None: of every query its own, from its column ``least``, the
    cosine of that angle), or all rings of the ``probes`` nearest cells."""
    centre = index.centre
    last = int(math.pi / RING) + 1

    def ask(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                a = _angles(_as_matrix(part.column("u")), centre)
                if probes is None:
                    q, cell = np.nonzero(np.ones_like(a, dtype=bool))
                    own = np.arccos(np.clip(part.column("least").to_numpy(), -1.0, 1.0))[q] if reach is None else reach
                    low = np.floor((a[q, cell] - own - SLACK) / RING).clip(0)
                    high = np.floor((a[q, cell] + own + SLACK) / RING).clip(0, last)
                else:
                    near = np.argsort(a, axis=1, kind="stable")[:, :probes]
                    q, cell = np.repeat(np.arange(len(a)), near.shape[1]), near.ravel()
                    low, high = np.zeros(len(q)), np.full(len(q), last)
                yield pa.record_batch([part.column("qid").take(pa.array(q)), pa.array(cell.astype(np.int32)),
                                       pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
                                      names=["qid", "cell", "low", "high"])

    places = queries.mapInArrow(ask, "qid long, cell int, low int, high int")
    return (places.join(F.broadcast(index.rings), "cell").filter("ring BETWEEN low AND high")
            .select("qid", "cell", "ring", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")))


def _products(queries: DataFrame, index: Index, asked: DataFrame, take, block: int) -> DataFrame:
    """(qid, uid, mult, cosine): ``take`` chooses from each product of a block
    of queries (qid, u, least: no smaller cosine is of use) and a block of the index."""
    key = ["cell", "ring", "piece"]
    asked = cut(asked)
    parts = cut(asked.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")))
    left = (asked.join(parts, key).withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int"))
            .join(queries, "qid").select(*[F.col(c).alias(f"q_{c}") for c in (*key, "part")], "qid", F.col("u").alias("q_u"), "least"))
    right = (index.rows.join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select(*key, "part", "uid", "u", "mult"))

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            cos = _as_matrix(a["q_u"]) @ _as_matrix(b["u"]).T
            q, x = take(cos, b["uid"].to_numpy(), a["least"].to_numpy())
        else:
            cos, q, x = np.zeros((1, 1)), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return pa.table([a["qid"].take(pa.array(q)), b["uid"].take(pa.array(x)), b["mult"].take(pa.array(x)), pa.array(cos[q, x])],
                        names=["qid", "uid", "mult", "cosine"])

    return (left.groupBy(*[f"q_{c}" for c in (*key, "part")]).cogroup(right.groupBy(*key, "part"))
            .applyInArrow(multiply, "qid long, uid long, mult long, cosine double"))


def _queries(index: Index) -> DataFrame:
    return index.rows.filter("asks").select(F.col("uid").alias("qid"), "u", F.lit(-2.0).alias("least"))


def similar_vectors(index: Index, threshold: float, block: int = BLOCK) -> DataFrame:
    """(qid, uid, mult, cosine): for every asking class the other classes with
    cosine of ``threshold`` (> -1) or more.  Exact."""
    queries = _queries(index)
    take = lambda cos, *_: np.nonzero(cos >= threshold)
    found = _products(queries, index, _asked_rings(queries, index, math.acos(threshold), None), take, block)
    return found.filter("qid <> uid")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("cosine"), "uid")
    return (found.filter("qid <> uid").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("qid", "rank", "uid", "mult", "cosine"))


def _take_nearest(k: int):
    def take(cos, uid, least):
        least = least[:, None]
        if cos.shape[1] > k + 1:
            least = np.maximum(least, np.partition(cos, -(k + 1), axis=1)[:, [-(k + 1)]])    # one more, as the query may find itself
        q, x = np.nonzero(cos >= least)
        order = np.lexsort((uid[x], -cos[q, x], q))
        q, x = q[order], x[order]
        start = np.flatnonzero(np.diff(q, prepend=-1))
        at = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        return q[at <= k], x[at <= k]

    return take


def nearest_vectors(index: Index, k: int, probes: int, block: int = BLOCK) -> DataFrame:
    """(qid, rank, uid, mult, cosine): for every asking class the ``k`` other
    classes with the largest cosine (equal ones by uid) in the ``probes`` cells
    nearest to it; with as many probes as cells, of all."""
    queries = _queries(index)
    return _best(_products(queries, index, _asked_rings(queries, index, None, probes), _take_nearest(k), block), k)


def exact_neighbours(index: Index, k: int, probes: int = 1, block: int = BLOCK) -> DataFrame:
    """``nearest_vectors`` over all classes: the k-th best of the ``probes``
    nearest cells bounds how far away the true neighbours can be, and only the
    rings within that angle are asked."""
    first = cut(nearest_vectors(index, k, probes, block))
    bound = (first.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("c"))
             .select("qid", F.when(F.col("n") >= k, F.col("c")).otherwise(F.lit(-1.0)).alias("least")))
    queries = cut(_queries(index).drop("least").join(bound, "qid", "left")
                  .select("qid", "u", (F.coalesce("least", F.lit(-1.0)) - SLACK).alias("least")))
    return _best(_products(queries, index, _asked_rings(queries, index, None, None), _take_nearest(k), block), k)


def true_neighbours(index: Index, k: int, sample: int = PROBE_SAMPLE) -> DataFrame:
    """(qid, uid, cell, cosine): the ``k`` nearest other classes, by brute force,
    of at most ``sample`` asking classes (those with the smallest hash), and
    the cell that holds each.  Every task keeps the best k of its rows."""
    q = (_queries(index).select("qid", "u", F.xxhash64("qid").alias("h")).orderBy("h", "qid").limit(sample).toArrow())
    ids, qu = q["qid"].to_numpy(), _as_matrix(q["u"]) if q.num_rows else np.zeros((0, 1))

    def best(batches):
        held = [(np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))] * len(ids)
        for b in batches:
            for at in range(0, b.num_rows if len(ids) else 0, BLOCK):
                part = b.slice(at, BLOCK)
                uid, cell = part.column("uid").to_numpy(), part.column("cell").to_numpy()
                cos = qu @ _as_matrix(part.column("u")).T
                for j in range(len(ids)):
                    some = np.argsort(-cos[j], kind="stable")[:k + 1]
                    some = some[uid[some] != ids[j]]
                    both = [np.concatenate(x) for x in zip(held[j], (cos[j, some], uid[some], cell[some]))]
                    order = np.lexsort((both[1], -both[0]))[:k]
                    held[j] = tuple(x[order] for x in both)
        if held:
            cosine, uid, cell = (np.concatenate(x) for x in zip(*held))
            yield pa.record_batch([pa.array(np.repeat(ids, [len(x[0]) for x in held])), pa.array(uid), pa.array(cell), pa.array(cosine)],
                                  names=["qid", "uid", "cell", "cosine"])

    w = Window.partitionBy("qid").orderBy(F.desc("cosine"), "uid")
    near = index.rows.select("uid", "u", "cell").mapInArrow(best, "qid long, uid long, cell int, cosine double")
    return near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def probes_for(index: Index, k: int, recall: float = 0.9, sample: int = PROBE_SAMPLE) -> tuple[int, float]:
    """(probes, measured recall): the least number of nearest cells that holds
    the share ``recall`` of the true ``k`` neighbours of the sampled queries."""
    truth = cut(true_neighbours(index, k, sample))
    rows = truth.join(_queries(index), "qid").select("u", "cell").toArrow()      # at most sample * k rows
    if not rows.num_rows:
        return 1, 1.0
    a = _angles(_as_matrix(rows["u"]), index.centre)
    place = (np.argsort(a, axis=1, kind="stable") == rows["cell"].to_numpy()[:, None]).argmax(axis=1)
    held = np.cumsum(np.bincount(place, minlength=a.shape[1])) / len(place)
    probes = int(np.argmax(held >= min(recall, held[-1]))) + 1
    return probes, float(held[probes - 1])


# ------------------------------------------------------------------- clustering

def _parts(classes: DataFrame, numbers: int) -> int:
    """How many blocks hold ``classes`` with at most about ``numbers`` numbers in each."""
    n = classes.agg(F.count(F.lit(1)), F.max(F.size("u"))).first()
    return max(LEAST_PARTS, math.ceil(n[0] * (n[1] or 0) / numbers))


def _block_pairs(left: DataFrame, right: DataFrame, work, schema: str, numbers: int, halves: bool) -> DataFrame:
    """``work(a, b, same)`` of every pair of blocks of ``left`` and ``right`` (uid,
    u, and one long ``with``).  ``halves``: both are one table, and a pair of blocks
    is taken once, also that of a block with itself (``same``)."""
    x, y = _parts(left, numbers), _parts(right, numbers)
    own = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    names = ["a", "b", "uid", "u", "with"]
    a = (left.withColumn("a", own(x)).withColumn("b", F.explode(F.sequence(F.col("a") if halves else F.lit(0), F.lit(y - 1))))
             .select(*[F.col(c).alias(f"l_{c}") for c in names]))
    b = (right.withColumn("b", own(y)).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("b") if halves else F.lit(x - 1))))
              .select(*[F.col(c).alias(f"r_{c}") for c in names]))

    def meet(key, s: pa.Table, t: pa.Table) -> pa.Table:
        s, t = s.rename_columns(names), t.rename_columns(names)
        out = work(s, t, halves and key[0].as_py() == key[1].as_py()) if s.num_rows and t.num_rows else ([], [])
        return pa.table([pa.array(c, type=pa.int64()) for c in out], names=["uid", "v"])

    return a.groupBy("l_a", "l_b").cogroup(b.groupBy("r_a", "r_b")).applyInArrow(meet, schema)


def _hits(a: np.ndarray, b: np.ndarray, threshold: float):
    """(rows, columns) of the cosines of ``threshold`` or more, a piece of the matrix at a time."""
    step = max(1, PART // len(b))
    for at in range(0, len(a), step):
        flat = np.flatnonzero(a[at:at + step] @ b.T >= threshold)
        yield flat // len(b) + at, flat % len(b)


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` (of every node, the smallest of its tree) once i and j are linked."""
    while True:
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        apart = low != high
        if not apart.any():
            return root
        i, j = i[apart], j[apart]
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(up := root[root], root):
            root = up


def neighbour_counts(classes: DataFrame, threshold: float, numbers: int = PART) -> DataFrame:
    """(uid, mult, degree): rows within ``threshold`` of the class, its own included."""

    def count(s, t, same):
        n, m = s["with"].to_numpy(), t["with"].to_numpy()
        of_a, of_b = np.zeros(len(n)), np.zeros(len(m))
        ids = s["uid"].to_numpy(), t["uid"].to_numpy()
        for i, j in _hits(_as_matrix(s["u"]), _as_matrix(t["u"]), threshold):
            if same:
                i, j = (x[ids[0][i] != ids[1][j]] for x in (i, j))
            else:
                of_b += np.bincount(j, n[i], len(m))
            of_a += np.bincount(i, m[j], len(n))
        at = of_a > 0, of_b > 0
        return np.concatenate([ids[0][at[0]], ids[1][at[1]]]), np.concatenate([of_a[at[0]], of_b[at[1]]]).astype(np.int64)

    x = classes.select("uid", "u", F.col("mult").alias("with"))
    near = _block_pairs(x, x, count, "uid long, v long", numbers, True).groupBy("uid").agg(F.sum("v").alias("nb"))
    return (classes.select("uid", "mult").join(near, "uid", "left")
            .select("uid", "mult", (F.col("mult") + F.coalesce("nb", F.lit(0))).alias("degree")))


def spanning_links(classes: DataFrame, threshold: float, numbers: int = PART) -> DataFrame:
    """(i, j): links that connect what the pairs of ``threshold`` or more connect;
    at most one a class and pair of blocks."""

    def span(s, t, same):
        ids = np.unique(np.concatenate([s["uid"].to_numpy(), t["uid"].to_numpy()]))
        a, b = np.searchsorted(ids, s["uid"].to_numpy()), np.searchsorted(ids, t["uid"].to_numpy())
        root = np.arange(len(ids))
        for i, j in _hits(_as_matrix(s["u"]), _as_matrix(t["u"]), threshold):
            root = _unite(root, a[i], b[j])
        low = root != np.arange(len(ids))
        return ids[root[low]], ids[low]

    x = classes.select("uid", "u", F.lit(0).cast("long").alias("with"))
    return _block_pairs(x, x, span, "uid long, v long", numbers, True).select(F.col("uid").alias("i"), F.col("v").alias("j"))


def smallest_near(some: DataFrame, labelled: DataFrame, threshold: float, numbers: int = PART) -> DataFrame:
    """(uid, label): for the classes of ``some`` (uid, u) with one of ``labelled``
    (uid, u, label) within ``threshold``, the smallest label of those."""

    def least(s, t, _):
        label, none = t["with"].to_numpy(), np.iinfo(np.int64).max
        best = np.full(s.num_rows, none)
        for i, j in _hits(_as_matrix(s["u"]), _as_matrix(t["u"]), threshold):
            np.minimum.at(best, i, label[j])
        return s["uid"].to_numpy()[best < none], best[best < none]

    x, y = some.select("uid", "u", F.lit(0).cast("long").alias("with")), labelled.select("uid", "u", F.col("label").alias("with"))
    return _block_pairs(x, y, least, "uid long, v long", numbers, False).groupBy("uid").agg(F.min("v").alias("label"))


def dense_clusters(vectors: DataFrame, threshold: float, min_samples: int, id_col: str = "vec_id",
                   vec_col: str = "embedding", numbers: int = PART) -> DataFrame:
    """C8 with C3: (id, label) by density clustering of dense vectors within
    cosine distance ``1 - threshold``; noise is left out.  Copies count as
    neighbours, as in the text clustering.  All pairs are compared, so the work
    grows with the square of the classes; what is shuffled and written does with
    the number of blocks.  ``numbers`` bounds the size of a block."""
    from .cluster import connected_components, labels_to_posts, undirected
    classes, members = classes_of(unit_vectors(vectors, id_col, vec_col))
    degree = cut(neighbour_counts(classes, threshold, numbers))
    core = cut(classes.join(degree.filter(F.col("degree") >= min_samples).select("uid"), "uid").select("uid", "u"))
    comp = connected_components(core.select("uid"), undirected(spanning_links(core, threshold, numbers)))
    labels = comp.select("uid", F.col("comp").alias("label"))
    # a class without other neighbours is noise
    edge = cut(classes.join(degree.filter((F.col("degree") < min_samples) & (F.col("degree") > F.col("mult"))).select("uid"), "uid")
               .select("uid", "u"))
    border = smallest_near(edge, core.join(labels, "uid"), threshold, numbers)
    return labels_to_posts(labels.unionByName(border), members)
