"""Balanced label propagation for sharding (operator 6), by the ``rows`` law:
the shards' row counts differ by at most one.

Linked documents (equal texts) should share a shard.  Groups larger than a shard
are dealt out first, to whole shards and one for the rest; the other rows start
on hashed shards, by the room that is left.  In every round each group that is
cut looks at where its members are (counts by group and shard) and proposes to
gather on the fullest of these shards that has room, or, when such proposals are
hardly accepted any more, on any shard that has room for all of it.  A group's
proposals are accepted together, largest groups first, as far as the shard's
quota allows: its even share, less the linked rows that it has, with those that
leave it in the same round.  A group that was accepted is whole in the rounds to
come; the last rounds may go over the share by a twentieth, and end when no
proposal is accepted.  A last exchange of rows, unlinked ones first, then small
groups as a whole, makes the counts even.

What is decided on the driver is bounded: quotas by shard and by a fixed number
of priority classes and hash buckets, and the groups larger than a shard (fewer
than twice the shards), never rows.  Ranks inside a shard come from counts by
hash bucket, so no shard is one task.

Sizes are UTF-8 bytes of the text (null: none) plus 16.

Edge cases: null texts are equal to each other and not to the empty text; rows
without doc_id and repeated rows are sharded like any other; an empty table
gives no rows; other columns of the input are ignored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS = 40
BUCKETS = 1024          # hash buckets of a priority class: the grain of the last exchange
CELLS = 64              # hash buckets of a priority class in a round: the bits of a long
CLASSES = 64            # priority classes by group size (powers of two)
SEED = 17


def _members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, size, text_crc32, g, salt, n): ``g`` names the equal
    texts, ``n`` counts them, ``row`` numbers the rows."""
    text, ident = docs[text_col].cast("string"), docs[id_col].cast("long")
    rows = docs.select(
        ident.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha1(text.cast("binary")), F.lit("null")).alias("g"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    n = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    salt = F.xxhash64(F.lit(SEED), "doc_id", "row")
    return rows.join(n, "g").withColumn("salt", salt)


def _seats(sizes: list, shards: int, cap: int):
    """([(group, rows up to here, shard)], room left by shard): groups larger
    than ``cap`` on whole shards, what is left over of each on the tightest shard
    that holds it."""
    free, out, rests = np.full(shards, cap, dtype=np.int64), [], []
    for g, n in sizes:
        whole = np.flatnonzero(free == cap)[:n // cap]
        free[whole] = 0
        out += [(g, cap * (i + 1), int(s)) for i, s in enumerate(whole)]
        rests.append((n - cap * len(whole), n, g))
    for rest, n, g in sorted(rests, reverse=True):
        while rest:
            fit = np.flatnonzero(free >= rest)
            s = int(fit[np.argmin(free[fit])]) if len(fit) else int(np.argmax(free))
            k = min(rest, int(free[s])) or rest         # no room anywhere: the last exchange moves them
            free[s] = max(0, free[s] - k)
            rest -= k
            out.append((g, n - rest, s))
    return out, free


def _placed(m: DataFrame, shards: int, cap: int) -> DataFrame:
    """``m`` with the first ``shard`` of every row."""
    large = m.filter(F.col("n") > cap).select("g", "n").distinct().collect()        # fewer than 2 * shards
    seats, free = _seats(sorted(((r["g"], r["n"]) for r in large), key=lambda r: (-r[1], r[0])), shards, cap)
    if not free.any():
        free[:] = 1
    at = F.pmod(F.xxhash64("salt"), F.lit(int(free.sum())))
    shard = F.lit(0)
    for x in np.cumsum(free)[:-1]:
        shard = shard + F.when(at >= F.lit(int(x)), 1).otherwise(0)
    out = m.filter(F.col("n") <= cap).withColumn("shard", shard.cast("int"))
    if not seats:
        return out
    own = F.lit(None).cast("int")
    for g, till, s in sorted(seats, key=lambda x: -x[1]):
        own = F.when((F.col("g") == g) & (F.col("rank") < till), F.lit(s)).otherwise(own)
    ranked = _ranked(m.filter(F.col("n") > cap).withColumn("place", _bucket()), ["g"], ["place", "salt", "row"])
    return out.unionByName(ranked.withColumn("shard", own).select(out.columns))


def _bucket():
    return F.pmod(F.shiftright("salt", 20), F.lit(BUCKETS)).cast("int")


def _class(n):
    return F.least(F.lit(CLASSES - 1), F.floor(F.log2(n.cast("double")))).cast("int")


def _loads(m: DataFrame, shards: int) -> np.ndarray:
    out = np.zeros(shards, dtype=np.int64)
    for s, k in m.groupBy("shard").agg(F.count(F.lit(1))).collect():       # one number per shard
        out[s] = k
    return out


def _accepted(cells, loads: np.ndarray, shards: int, cap: int):
    """(bit masks by shard and class of the accepted buckets, rows moved), from
    (shard, goal, klass, bucket, k): no shard goes over ``cap``, counting the
    rows that leave it.  Larger classes first; a bucket that does not fit is
    passed over.  Refusals only add up, as they keep rows where they are."""
    src, goal, klass, bucket, k = (cells.column(c).to_numpy() for c in ("shard", "goal", "klass", "bucket", "k"))
    name, unit = np.unique(((goal * CLASSES) + (CLASSES - 1 - klass)) * CELLS + bucket, return_inverse=True)
    size = np.bincount(unit, weights=k, minlength=len(name)).astype(np.int64)
    to = name // (CLASSES * CELLS)
    ok = np.ones(len(name), dtype=bool)
    while True:
        out = np.bincount(src, weights=k * ok[unit], minlength=shards).astype(np.int64)
        room = cap - loads + out
        into = np.bincount(to, weights=size * ok, minlength=shards).astype(np.int64)
        over = np.flatnonzero((into > room) & (into > 0))
        if not len(over):
            break
        for s in over:
            left = int(room[s])
            for u in np.flatnonzero(ok & (to == s)).tolist():
                if size[u] <= left:
                    left -= int(size[u])
                else:
                    ok[u] = False
    masks = np.zeros(shards * CLASSES, dtype=np.uint64)
    np.bitwise_or.at(masks, name[ok] // CELLS, np.uint64(1) << (name[ok] % CELLS).astype(np.uint64))
    return masks.view(np.int64), int(size[ok].sum())


def _round(m: DataFrame, shards: int, cap: int, anywhere: bool, number: int):
    """One round: (members after it, rows proposed, rows moved).  ``anywhere``: groups without a
    shard that has room may go to one where they have no member."""
    linked = m.filter("n > 1")
    loads = _loads(linked, shards)
    room = np.maximum(0, cap - loads)
    by = linked.filter(F.col("n") <= cap).groupBy("g", "shard", "n").agg(F.count(F.lit(1)).alias("here")).filter("here < n")
    has = lambda s: F.element_at(F.array(*[F.lit(int(x)) for x in room]), s + 1)      # noqa: E731
    # the fullest shard of a group that has room for the rest of it
    fits = (has(F.col("shard")) >= F.col("n") - F.col("here")).cast("int")
    best = F.struct(fits.alias("fits"), "here", F.xxhash64("g", "shard", F.lit(number)).alias("tie"), "shard")
    want = by.groupBy("g", "n").agg(F.max(best).alias("best"))
    goal = F.col("best.shard")
    if anywhere:
        # one of all shards that have room for the group, by hash: roomiest first, so they are the first ``able``
        able = sum((F.lit(int(x)) >= F.col("n")).cast("int") for x in room)
        other = F.element_at(F.array(*[F.lit(int(s)) for s in np.argsort(-room, kind="stable")]),
                             F.pmod(F.xxhash64("g", F.lit(number)), F.greatest(able, F.lit(1))).cast("int") + 1)
        goal = F.when((F.col("best.fits") == 0) & (able > 0), other).otherwise(goal)
    prop = m.join(want.select("g", goal.alias("goal")), "g", "left").withColumn("goal", F.coalesce("goal", "shard"))
    # a group has one bucket: it is accepted as a whole
    prop = cut(prop.withColumn("klass", _class(F.col("n")))
                   .withColumn("bucket", F.pmod(F.xxhash64("g", F.lit(number + SEED)), F.lit(CELLS)).cast("int")))
    asked = (prop.filter("goal <> shard").groupBy("shard", "goal", "klass", "bucket")
                 .agg(F.count(F.lit(1)).alias("k")).toArrow())     # bounded: shards x shards x classes x buckets
    masks, moved = _accepted(asked, loads, shards, cap)
    mask = F.element_at(F.array(*[F.lit(int(x)) for x in masks]),
                        F.col("goal") * CLASSES + (F.lit(CLASSES - 1) - F.col("klass")) + 1)
    moves = (F.col("goal") != F.col("shard")) & (F.call_function("shiftright", mask, F.col("bucket")).bitwiseAND(F.lit(1)) == 1)
    out = prop.withColumn("shard", F.when(moves, F.col("goal")).otherwise(F.col("shard"))).drop("goal", "klass", "bucket")
    return out, int(asked.column("k").to_numpy().sum()), moved


def _ranked(m: DataFrame, keys: list, order: list) -> DataFrame:
    """``m`` with rank (from 0) among the rows of equal ``keys``, in the order of
    ``order`` (its first entry a bucket number): counts by bucket,
    then a row number inside the bucket."""
    first = order[0]
    c = m.groupBy(*keys, first).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*keys).orderBy(first)
    c = c.withColumn("_before", F.sum("_k").over(w) - F.col("_k")).drop("_k")
    own = Window.partitionBy(*keys, first).orderBy(*order[1:])
    return (m.withColumn("_i", F.row_number().over(own)).join(c, [*keys, first])
             .withColumn("rank", F.col("_before") + F.col("_i") - 1).drop("_before", "_i"))


def _even(m: DataFrame, shards: int, total: int) -> DataFrame:
    """Move the rows that are over a shard's exact share to the shards under it:
    rows without links first, then of the smallest groups."""
    loads = _loads(m, shards)
    share = np.full(shards, total // shards)
    # the larger shares go to the fuller shards: fewer moves
    share[np.argsort(-loads, kind="stable")[:total % shards]] += 1
    over = np.maximum(0, loads - share)
    under = np.maximum(0, share - loads)
    if not over.any():
        return m
    # a shard's rows by how readily they leave: class of the group size, then hash bucket
    # (small groups leave as a whole, large ones are spread over the buckets)
    small = F.col("n") <= max(1, total // shards // 8)
    place = F.when(small, F.pmod(F.xxhash64("g"), F.lit(BUCKETS)).cast("int")).otherwise(_bucket())
    m = m.withColumn("ready", _class(F.col("n")) * BUCKETS + place)
    hist = m.groupBy("shard", "ready").agg(F.count(F.lit(1)).alias("k")).collect()     # bounded: shards x classes x buckets
    limit, taken = np.full(shards, -1), np.zeros(shards, dtype=np.int64)
    for s in range(shards):
        for ready, k in sorted((r["ready"], r["k"]) for r in hist if r["shard"] == s):
            if taken[s] >= over[s]:
                break
            limit[s], taken[s] = ready, taken[s] + k
    lim = F.element_at(F.array(*[F.lit(int(x)) for x in limit]), F.col("shard") + 1)
    leave = _ranked(m.filter(F.col("ready") <= lim), ["shard"], ["ready", "g", "salt", "row"])
    quota = F.element_at(F.array(*[F.lit(int(x)) for x in over]), F.col("shard") + 1)
    base = F.element_at(F.array(*[F.lit(int(x)) for x in np.cumsum(over) - over]), F.col("shard") + 1)
    seats = np.cumsum(under)
    seat = F.col("rank") + base
    to = F.lit(0)
    for s in range(shards - 1):
        to = to + F.when(seat >= F.lit(int(seats[s])), 1).otherwise(0)
    gone = leave.filter(F.col("rank") < quota).select("row", to.cast("int").alias("new"))
    return (m.join(gone, "row", "left").withColumn("shard", F.coalesce("new", "shard")).drop("new", "ready"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, size, text_crc32, law, shard, slot,
    grown_shard)."""
    m = cut(_members(docs, id_col, text_col))
    total = m.count()
    cap = max(1, total // shards)
    m = cut(_placed(m, shards, cap))
    # within the share; on other shards too; a little over the share, which the last exchange takes off by whole groups
    number, phases = 0, [(cap, False), (cap, True), (cap + cap // 20 + 1, True)]
    while total and phases:
        after, asked, moved = _round(m, shards, *phases[0], number)
        if moved:
            m = cut(after)
        # the last phase goes on until nothing is accepted, the others give way when little is
        if not asked:
            break
        if moved <= (0 if len(phases) == 1 else asked // 100):
            phases.pop(0)
        number += 1
    m = cut(_even(m, shards, total)) if total else m
    m = m.withColumn("place", F.pmod(F.shiftright("salt", 32), F.lit(BUCKETS * 4)).cast("int"))
    out = _ranked(m, ["shard"], ["place", "salt", "row"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                      F.col("rank").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_edges(assigned: DataFrame, group: str = "text_crc32") -> DataFrame:
    """(linked, cut): pairs of linked rows, and those of them in different
    shards, from counts by group and shard (no pairs are made)."""
    c = assigned.groupBy(group, "shard").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("k"))
    g = c.groupBy(group).agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("inside"))
    return g.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("linked"),
                 F.sum(F.col("n") * (F.col("n") - 1) / 2 - F.col("inside")).alias("cut"))
