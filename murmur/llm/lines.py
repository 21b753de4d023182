"""Line deduplication by an exact set-similarity join (operator 1).

Lines are the parts of a text between line feeds; their tokens are the distinct
lower-cased words.  A line is removed if an earlier line (smaller doc_id, or
earlier in the same text; whether it is removed itself or not) has a Jaccard
similarity of at least ``num / den`` (4/5) with it.  Lines without words stay.

DataFrame operations only.  Lines with the same token set are one class, known
by its earliest line; every later one is removed.  Tokens are ordered by rarity
(the class of their frequency over all documents, counted in a fixed number of
hash buckets, then the hash, so the order is total and the table of classes has
a fixed size); a token that occurs once leads to no partner and is not joined.
Two similar classes share a token in their prefixes of n - ceil(t * n) + 1
tokens; the join on prefix tokens applies the length filter, the positional
filter at the first shared token and a 64-bit parity signature, and what is left
is verified on the words themselves.

A group of near copies must not be paired all with all, and one match is enough
for a line.  So the nearest predecessors at a line's rarest tokens are tried
first; then, where a token shows that a crowd of similar lines shares it, its open
lines meet growing shares of all lines (by hash).  A line with a verified match
asks no more; all others are joined with all earlier lines, so the result is exact.

Edge cases: a null text has no lines with words; repeated rows (same id and
text) are one document, reported as often as they come; rows without doc_id
come before all others in the order of a hash of their text; different texts
must have different ids (``dedup_lines`` takes those that have not for rows
without id); an empty table gives no rows; other columns of the input are
ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import remove_path, scratch_path
from .common import cut, documents_of, input_tasks

NUM, DEN = 4, 5
LONG_LINE = 64          # tokens from which a line has the wide signature too
CLASS_BITS = 20         # hash buckets in which token frequencies are counted: 2^20
FIRST, LOOK_BACK = 3, 2  # rarest tokens of a line, and predecessors at each, that are tried first
CROWD, CROWD_HITS = 64, 4   # predecessors, and likely matches beyond so many, that make a crowd
CROWD_STEP = 8          # by which the share of lines that a crowd meets grows
FILTER_BITS = 20


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = documents_of(docs, id_col, text_col)
    low = F.lit(-(2**62)) - F.shiftrightunsigned(F.xxhash64(F.coalesce("_m_text", F.lit(""))), 2)
    return d.select(F.coalesce("_m_id", low).alias("doc"), "_m_id", F.coalesce("_m_text", F.lit("")).alias("_m_text"))


def _words(line):
    return F.split(F.lower(line), r"[ \t\x0B\f\r]+")


def _tokens(line):
    """Hashes of the distinct words; a blank line has none."""
    return F.array_remove(F.array_distinct(F.transform(_words(line), lambda t: F.xxhash64(t))), F.xxhash64(F.lit("")))


def _lines(d: DataFrame) -> DataFrame:
    return d.select("doc", F.posexplode(F.split("_m_text", "\n")).alias("line", "text"))


def token_classes(d: DataFrame):
    """One binary value: for every hash bucket the class of how often its words
    occur in all documents, the rarest first.  2^CLASS_BITS bytes for any corpus;
    class 1 holds the words that occur once, which no other line can share.
    A scalar subquery: a literal of that size would stand in hexadecimal in every
    description of a plan that the driver keeps and sends to its listeners."""
    page = 12
    bucket = F.shiftrightunsigned(F.xxhash64("t"), 64 - CLASS_BITS)
    seen = (d.select(F.explode(F.split(F.lower("_m_text"), r"[ \n\t\x0B\f\r]+")).alias("t")).filter("t <> ''")
             .select(bucket.alias("b"), F.lit(1).cast("long").alias("k")))
    every = d.sparkSession.range(1 << CLASS_BITS).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("k"))
    # two classes for a word that occurs twice, three steps for every doubling from there
    klass = F.when(F.col("n") < 2, 1).otherwise(F.least(F.lit(126), F.floor(3 * F.log2(F.col("n").cast("double"))) - 1))
    pages = (seen.unionByName(every).groupBy("b").agg(F.sum("k").alias("n"))
                 .select(F.shiftright("b", page).alias("page"),
                         F.struct(F.col("b").bitwiseAND(F.lit((1 << page) - 1)).cast("short").alias("at"), klass.cast("byte").alias("c")).alias("e"))
                 .groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: F.char(e["c"])), "").alias("s")))
    return _in_order(pages, "page", "s", lambda s: F.array_join(s, "").cast("binary")).scalar()


def _in_order(pages: DataFrame, key: str, value: str, join) -> DataFrame:
    """One row: what ``join`` makes of the values of a few pages in order of their key."""
    every = F.array_sort(F.collect_list(F.struct(key, value)))
    return cut(pages.agg(join(F.transform(every, lambda x: x[value])).alias("v")))


def _coded(d: DataFrame, num: int, den: int) -> DataFrame:
    """(doc, line, h1, h2, size, sig, wide, skip, prefix) of every line with words; a code is
    a token's class, then 56 bits of its hash: sorted codes are rarest first.  The first
    ``skip`` tokens of the prefix occur in no other line and are left out of ``prefix``."""
    low = 56
    # asked of the text: a filter on the tokens would be pushed down and make them twice
    x = _lines(d).filter(F.col("text").rlike(r"[^ \t\x0B\f\r]")).select("doc", "line", _tokens(F.col("text")).alias("hashes"))
    klass = lambda h: F.ascii(F.substring(F.col("classes"), (F.shiftrightunsigned(h, 64 - CLASS_BITS) + 1).cast("int"), F.lit(1)).cast("string"))
    code = lambda h: F.shiftleft(klass(h).cast("long"), low).bitwiseOR(h.bitwiseAND(F.lit((1 << low) - 1)))      # noqa: E731
    # the optimiser puts the subquery in place of the column, which is used once: no row carries it
    x = x.withColumn("classes", token_classes(d)).select("doc", "line", F.sort_array(F.transform("hashes", code)).alias("codes"))
    # long lines differ in more tokens than 64 bits can tell: four times the signature, empty for the others
    parts = [f"aggregate(filter(codes, c -> (shiftright(c, 6) & 3) = {k}), 0L, (a, c) -> a ^ shiftleft(1L, cast(c & 63 as int)))" for k in range(4)]
    size = F.size("codes")
    x = x.select("doc", "line", F.xxhash64("codes").alias("h1"), F.xxhash64(F.lit(9), "codes").alias("h2"), size.alias("size"),
                 F.expr("aggregate(codes, 0L, (a, c) -> a ^ shiftleft(1L, cast(c & 63 as int)))").alias("sig"),
                 F.expr(f"CASE WHEN size(codes) > {LONG_LINE} THEN array({', '.join(parts)}) ELSE cast(array() as array<bigint>) END").alias("wide"),
                 F.slice("codes", 1, size - F.expr(f"({num} * size(codes) + {den - 1}) div {den}").cast("int") + 1).alias("first"))
    once = F.size(F.filter("first", lambda c: c < F.lit(2 << low)))
    x = x.withColumn("skip", once)
    return x.select("doc", "line", "h1", "h2", "size", "sig", "wide", "skip",
                    F.slice("first", F.col("skip") + 1, F.size("first")).alias("prefix"))


def _passes(x: str, y: str, num: int, den: int) -> str:
    """Length, signature and positional filters for prefix rows under the names
    ``x`` and ``y`` at a shared token, which is taken as the first shared one;
    whole-number SQL, the cheapest tests first."""
    both = f"({x}.size + {y}.size)"
    least = f"(({num} * {both} + {num + den - 1}) div {num + den})"
    return (f"{den} * {x}.size >= {num} * {y}.size AND {den} * {y}.size >= {num} * {x}.size"
            f" AND bit_count({x}.sig ^ {y}.sig) <= {both} - 2 * {least}"
            f" AND (size({x}.wide) = 0 OR size({y}.wide) = 0"
            f" OR {' + '.join(f'bit_count(get({x}.wide, {k}) ^ get({y}.wide, {k}))' for k in range(4))} <= {both} - 2 * {least})"
            f" AND 1 + least({x}.size - {x}.i, {y}.size - {y}.i) - 1 >= {least}")


def _prefix_rows(reps: DataFrame, first: int | None = None) -> DataFrame:
    """A row for every token of the prefixes (the ``first`` ones), dealt by token;
    a column ``asks`` of ``reps`` goes with them."""
    prefix = F.slice("prefix", 1, first) if first else F.col("prefix")
    rows = reps.select(*[c for c in reps.columns if c != "prefix"], F.posexplode(prefix).alias("i", "code"))
    rows = rows.withColumn("i", F.col("i") + F.col("skip")).drop("skip")
    # stated here, so that no reader of the rows adds them and all share one exchange
    return rows.filter(" AND ".join(f"{c} IS NOT NULL" for c in rows.columns)).repartition("code")


def _pairs_of(x: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """(doc, line, doc2, line2): prefix rows of ``x`` (those that ask, if it has
    such a column) with all earlier rows that pass the filters."""
    earlier = "(y.doc < x.doc OR (y.doc = x.doc AND y.line < x.line))"
    # y.size is never negative: a test of x alone would be made before the rows are dealt, and they would be dealt twice
    asks = "(x.asks OR y.size < 0) AND " if "asks" in x.columns else ""
    j = x.alias("x").join(rows.alias("y"), F.expr(f"x.code = y.code AND {asks}{_passes('x', 'y', num, den)} AND {earlier}"))
    return j.select("x.doc", "x.line", F.col("y.doc").alias("doc2"), F.col("y.line").alias("line2"))


def _candidates(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(doc, line, doc2, line2, code, place): a likely match among the nearest
    predecessors at the same token, for the rows that have one; ``place`` counts
    the token's rows up to this one."""
    w = Window.partitionBy("code").orderBy("doc", "line")
    x = rows.withColumn("x", F.struct("doc", "line", "size", "sig", "wide", "i"))
    x = x.select("code", "x", F.row_number().over(w).alias("place"), *[F.lag("x", k).over(w).alias(f"y{k}") for k in range(1, LOOK_BACK + 1)])
    near = F.coalesce(*[F.expr(f"CASE WHEN {_passes('x', f'y{k}', num, den)} THEN y{k} END") for k in range(1, LOOK_BACK + 1)])
    return (x.withColumn("near", near).filter("near IS NOT NULL")
             .select("x.doc", "x.line", F.col("near.doc").alias("doc2"), F.col("near.line").alias("line2"), "code", "place"))


def _crowd_matches(d: DataFrame, reps: DataFrame, likely: DataFrame, good: DataFrame, num: int, den: int) -> list[DataFrame]:
    """Lines with a verified match that are not in ``good`` yet, of those that
    share a token with a crowd.  A line that is similar to many of them meets one
    in a small share of all lines; only lines without go on to the next, larger
    share, so the pairs grow with the lines and not with the square of a crowd.
    Likely matches side by side far down a token's rows are a crowd's mark: lines
    that share the token and no more seldom lie so."""
    far = cut(likely.filter(f"place > {CROWD}").groupBy("code").agg(F.count(F.lit(1)).alias("hits"), F.max("place").alias("place"))
                    .filter(f"hits >= {CROWD_HITS}").select("code", "place"))
    top = far.agg(F.max("place")).first()[0]
    if top is None:
        return []
    where = ["doc", "line"]
    asks = cut(reps.select(*where, F.explode("prefix").alias("code")).join(far.select("code"), "code", "left_semi").select(*where).distinct()
                   .join(good, where, "left_anti"))
    found, share = [], CROWD_STEP
    while share * CROWD < top:
        share *= CROWD_STEP
    while share > 1 and not asks.isEmpty():
        some = reps.filter(F.pmod(F.xxhash64(*where), F.lit(share)) == 0)
        pairs = cut(_pairs_of(_prefix_rows(reps.join(asks, where, "left_semi")), _prefix_rows(some), num, den).distinct())
        found.append(cut(_verified(d, pairs, num, den)))
        asks = cut(asks.join(found[-1], where, "left_anti"))
        share //= CROWD_STEP
    return found


def _only(d: DataFrame, asked: DataFrame) -> DataFrame:
    """``d`` without most of the rows whose doc is not in ``asked``: a filter of
    2^FILTER_BITS bits (hash of the doc), so the texts of others stay where they are.
    Rows of ``asked`` always pass."""
    bit = F.pmod(F.xxhash64("doc"), F.lit(1 << FILTER_BITS))
    held = asked.select((bit / 64).cast("long").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc), {1 << FILTER_BITS}) % 64 as int))").alias("m"))
    every = d.sparkSession.range(1 << (FILTER_BITS - 6)).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("m"))
    pages = (held.unionByName(every).groupBy("w").agg(F.bit_or("m").alias("m")).groupBy(F.shiftright("w", 7).alias("page"))
                 .agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "m"))), lambda x: x["m"]).alias("words")))
    bits = _in_order(pages, "page", "words", F.flatten).scalar()     # not a literal, see token_classes
    word = F.get(bits, (bit / 64).cast("int"))
    return d.withColumn("_b", (bit % 64).cast("int")).withColumn("_w", word).filter("getbit(_w, _b) = 1").drop("_b", "_w")


def _verified(d: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(doc, line) of the lines that have the similarity with a partner of theirs,
    on the 64-bit hashes of all words."""
    ends = (pairs.select("doc", "line").unionByName(pairs.select(F.col("doc2").alias("doc"), F.col("line2").alias("line")))
                 .distinct())
    asked = cut(ends.groupBy("doc").agg(F.collect_list("line").alias("wanted")))
    text = _only(d.select("doc", "_m_text"), asked).join(asked, "doc")
    parts = F.split("_m_text", "\n")
    line = F.element_at("parts", F.col("line") + 1)
    words = cut(text.select("doc", F.explode("wanted").alias("line"), parts.alias("parts"))
                    .select("doc", "line", _tokens(line).alias("words")).distinct())
    x = words.select("doc", "line", F.col("words").alias("wx"))
    y = words.select(F.col("doc").alias("doc2"), F.col("line").alias("line2"), F.col("words").alias("wy"))
    both = F.size(F.array_intersect("wx", "wy"))

    def hold(some):
        return (some.join(x, ["doc", "line"]).join(y, ["doc2", "line2"])
                    .filter(den * both >= num * (F.size("wx") + F.size("wy") - both)).select("doc", "line").distinct())

    # four times the signature, for long lines, before any pair carries its words
    parts = [F.expr(f"aggregate(filter(words, w -> ((w >> 6) & 3) = {k}), 0L, (a, w) -> a ^ shiftleft(1L, cast(w & 63 as int)))")
             .alias(f"s{k}") for k in range(4)]
    signs = cut(words.select("doc", "line", F.size("words").alias("n"), *parts))
    other = signs.select(*[F.col(c).alias(c + "2") for c in signs.columns])
    differ = " + ".join(f"bit_count(s{k} ^ s{k}2)" for k in range(4))
    pairs = cut(pairs.join(signs, ["doc", "line"]).join(other, ["doc2", "line2"])
                     .filter(f"{differ} <= n + n2 - 2 * (({num} * (n + n2) + {num + den - 1}) div {num + den})")
                     .select("doc", "line", "doc2", "line2"))
    # one match is enough: first a single partner of every line, then all others of the lines that it did not settle
    first = cut(pairs.groupBy("doc", "line").agg(F.min(F.struct("doc2", "line2")).alias("p")).select("doc", "line", "p.*"))
    settled = cut(hold(first))
    rest = pairs.join(settled, ["doc", "line"], "left_anti").join(first, ["doc", "line", "doc2", "line2"], "left_anti")
    return settled.unionByName(hold(rest))


def removed_lines(docs: DataFrame, num: int = NUM, den: int = DEN, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc, line): the lines to remove, counted from 0; ``doc`` as in ``_identified``."""
    d = input_tasks(_identified(docs, id_col, text_col))
    path = scratch_path(d.sparkSession, "lines")
    _coded(d, num, den).write.mode("overwrite").parquet(path)
    coded = d.sparkSession.read.parquet(path)
    place = F.struct("doc", "line")
    reps = cut(coded.groupBy("h1", "h2").agg(F.min(F.struct("doc", "line", "size", "sig", "wide", "skip", "prefix")).alias("r"),
                                             F.count(F.lit(1)).alias("copies")))
    again = cut(coded.select("h1", "h2", "doc", "line")
                     .join(reps.filter("copies > 1").select("h1", "h2", F.struct("r.doc", "r.line").alias("p")), ["h1", "h2"])
                     .filter(place != F.col("p")).select("doc", "line"))
    remove_path(d.sparkSession, path)       # every line's prefix: the classes' are enough from here
    reps = reps.select("r.*")
    likely = cut(_candidates(_prefix_rows(reps, FIRST), num, den))
    good = cut(_verified(d, likely.select("doc", "line", "doc2", "line2").distinct(), num, den))
    for more in _crowd_matches(d, reps, likely, good, num, den):
        good = good.unionByName(more)
    open_ = reps.join(good.withColumn("done", F.lit(True)), ["doc", "line"], "left")
    rows = _prefix_rows(open_.withColumn("asks", F.col("done").isNull()).drop("done"))
    rest = _verified(d, cut(_pairs_of(rows, rows, num, den).distinct()), num, den)
    return again.unionByName(good).unionByName(rest).distinct()


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **threshold) -> DataFrame:
    """One row per document: (doc_id, n_lines, n_removed, removed_lines = the
    numbers of the removed lines from 0, ascending)."""
    gone = removed_lines(docs, id_col=id_col, text_col=text_col, **threshold)
    per = gone.groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("removed_lines"))
    d = _identified(docs, id_col, text_col).select("doc", "_m_id", F.size(F.split("_m_text", "\n")).cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    return (d.join(per, "doc", "left")
             .select(F.col("_m_id").alias("doc_id"), "n_lines",
                     F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_removed"),
                     F.coalesce("removed_lines", none).alias("removed_lines")))


def dedup_lines(docs: DataFrame, **threshold) -> DataFrame:
    """``docs`` with the removed lines cut out of ``text`` (and n_chars, where
    there is such a column, counted anew); all documents stay, columns as in
    ``docs``."""
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    # different texts under one id are documents of their own, known by their text like rows without id
    twice = (docs.groupBy(F.col("doc_id").cast("long").alias("_m_twice")).agg(F.min(own).alias("a"), F.max(own).alias("b"))
                 .filter("a <> b AND _m_twice IS NOT NULL").select("_m_twice"))
    base = docs.join(cut(twice), docs["doc_id"].cast("long") == F.col("_m_twice"), "left")
    base = base.withColumn("_m_named", F.when(F.col("_m_twice").isNull(), F.col("doc_id").cast("long"))).drop("_m_twice")
    base = base.withColumn("_m_key", F.coalesce("_m_named", F.lit(-(2**62)) - F.shiftrightunsigned(own, 2)))
    per = (removed_lines(base, id_col="_m_named", **threshold).groupBy(F.col("doc").alias("_m_doc"))
           .agg(F.collect_list("line").alias("_m_gone")))
    j = base.join(per, F.col("_m_key") == F.col("_m_doc"), "left")
    kept = F.expr("array_join(transform(filter(sequence(0, size(_m_parts) - 1), i -> NOT array_contains(_m_gone, i)), "
                  "i -> _m_parts[i]), '\n')")
    j = j.withColumn("_m_parts", F.split("text", "\n"))
    text = F.when(F.col("_m_gone").isNull(), F.col("text")).otherwise(kept)
    j = j.withColumn("_m_new", text)
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("_m_new").alias("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col("_m_gone").isNull(), F.col("n_chars")).otherwise(F.length("_m_new"))
                        .cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            cols.append(F.col(f"`{c}`"))
    return j.select(*cols)
