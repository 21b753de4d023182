"""Registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path
from . import chat, decontaminate, exact, lexical, lines, packing, quality, sharding, simhash, substrings, tokenfile, warc, whiten
from .common import cut, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and linked groups of all documents."""
    return simhash.simhash_groups(read(spark, sf_dir, "documents"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, symbol, line and repetition counts of all documents, and what the
    repetition rules keep."""
    return quality.quality(read(spark, sf_dir, "documents")).drop("covered_words", "longest_repeat")


# Positions in a repeat of at least 10 words are those in a 10-word window that
# occurs twice; a repeat of over k >= 10 words is a run of at least k - 8 positions
# whose 10-word windows occur again at one same distance; k is a tenth of the words,
# 200 at most.
ORACLE["op10_quality"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT r, ws, unnest(range(len(ws))) AS i FROM w),
c3 AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i + 1], ws[i + 2], ws[i + 3]) AS n FROM p WHERE i + 3 <= len(ws)),
rep3 AS (SELECT r, count(DISTINCT j) AS n_repeat_words
         FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM c3 WHERE n > 1) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines
        WHERE regexp_replace(l, '[ \t\n\v\f\r]+', '', 'g') <> '' GROUP BY r),
base AS (
  SELECT r, doc_id, len(ws) AS n_words,
         length(regexp_replace(text, '[ \t\n\v\f\r]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(ws) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(ws) AS base_failed
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep3 USING (r)),
g10 AS (SELECT r, i, list_aggregate(ws[i + 1:i + 10], 'string_agg', ' ') AS g
        FROM p JOIN base USING (r) WHERE NOT base_failed AND i + 10 <= len(ws)),
c10 AS (SELECT r, i, g FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM g10) WHERE n > 1),
cover AS (SELECT r, count(DISTINCT j) AS covered_words
          FROM (SELECT r, unnest(range(i, i + 10)) AS j FROM c10) GROUP BY r),
pair AS (SELECT a.r, b.i - a.i AS gap, a.i - row_number() OVER (PARTITION BY a.r, b.i - a.i ORDER BY a.i) AS run
         FROM c10 a JOIN c10 b ON a.r = b.r AND a.g = b.g AND a.i < b.i),
run AS (SELECT r, max(n) AS n FROM (SELECT r, count(*) AS n FROM pair GROUP BY r, gap, run) GROUP BY r),
long AS (SELECT r FROM run JOIN base USING (r) WHERE n >= greatest(1, least(200, n_words // 10) - 8))
SELECT base.* EXCLUDE (r),
       NOT base_failed AND 100 * coalesce(covered_words, 0) <= 20 * n_words AND long.r IS NULL AS kept
FROM base LEFT JOIN cover USING (r) LEFT JOIN long USING (r)
"""


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 80 % of a benchmark item's five-word
    shingles: one row per document and item."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = (r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '')")

ORACLE["op4_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
bs AS (SELECT DISTINCT item_id, list_aggregate(ws[i + 1:i + 5], 'string_agg', ' ') AS g
       FROM (SELECT item_id, ws, unnest(range(greatest(1, len(ws) - 4))) AS i FROM b WHERE len(ws) > 0)),
ds AS (SELECT DISTINCT r, doc_id, list_aggregate(ws[i + 1:i + 5], 'string_agg', ' ') AS g
       FROM (SELECT r, doc_id, ws, unnest(range(greatest(1, len(ws) - 4))) AS i FROM d WHERE len(ws) > 0)),
m AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
f AS (SELECT r, doc_id, item_id, count(*) AS n_found FROM ds JOIN bs USING (g) GROUP BY r, doc_id, item_id)
SELECT doc_id, item_id, n_shingles::INT AS n_shingles, n_found::INT AS n_found, n_found / n_shingles AS containment
FROM f JOIN m USING (item_id) WHERE n_found >= ceil(0.8 * n_shingles - 1e-9)
"""


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written as range-coded files and read back."""
    path = scratch_path(spark, "tokens")
    tokenfile.write_tokens(read(spark, sf_dir, "documents"), path)
    return tokenfile.document_digests(cut(tokenfile.read_tokens(spark, path)))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 token ids."""
    return packing.pack(read(spark, sf_dir, "documents"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives with revisits, read back and resolved."""
    path = scratch_path(spark, "warc")
    warc.write_archives(read(spark, sf_dir, "pages"), path)
    return warc.resolve(cut(warc.read_archives(spark, path)))


ORACLE["op7_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM q
"""


@query
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations in chat format, one row per turn."""
    return chat.render(read(spark, sf_dir, "conversations"))


ORACLE["op8_chat"] = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l
      FROM t GROUP BY conv_id),
k AS (SELECT conv_id, l FROM c WHERE NOT EXISTS (
        SELECT 1 FROM c o WHERE o.l[1] = c.l[1] AND o.conv_id <> c.conv_id AND len(o.l) >= len(c.l)
          AND o.l[1:len(c.l)] = c.l AND (len(o.l) > len(c.l) OR o.conv_id < c.conv_id))),
u AS (SELECT conv_id, len(l) AS n_turns, unnest(range(1, len(l) + 1)) AS position, l FROM k)
SELECT conv_id, position, n_turns, l[position].r AS role,
       '<|im_start|>' || coalesce(l[position].r, '') || chr(10) || coalesce(l[position].t, '') || '<|im_end|>' || chr(10) AS rendered
FROM u
"""


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of equal row counts, equal texts together
    as far as the counts allow."""
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


@query
def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without repeated strings of 100 bytes."""
    return substrings.dedup_substrings(read(spark, sf_dir, "documents"))


@query
def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that are at least 0.8 similar to an earlier line."""
    return lines.line_report(read(spark, sf_dir, "documents"))


# Pairs that share one of the prefix tokens in hash order are enough (any total
# order of the tokens gives an exact prefix filter).
ORACLE["op1_lines"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents),
t AS (SELECT doc_id, n, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[ \t\v\f\r]+'), lambda x: x <> ''))) AS w
      FROM l),
c AS (SELECT w, min((doc_id, n)) AS p FROM t WHERE len(w) > 0 GROUP BY w),
f AS (SELECT x, count(*) AS df FROM (SELECT unnest(w) AS x FROM c) GROUP BY x),
o AS (SELECT w, p, list(x ORDER BY df, x) AS s
      FROM (SELECT w, p, unnest(w) AS x FROM c) JOIN f USING (x) GROUP BY w, p),
px AS (SELECT w, p, unnest(s[1:len(s) - ((4 * len(s) + 4) // 5) + 1]) AS x FROM o),
near AS (SELECT DISTINCT a.p FROM px a JOIN px b ON a.x = b.x AND b.p < a.p
           AND 5 * len(a.w) >= 4 * len(b.w) AND 5 * len(b.w) >= 4 * len(a.w)
         WHERE 5 * len(list_intersect(a.w, b.w))
               >= 4 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))),
gone AS (SELECT doc_id, n FROM t JOIN c USING (w)
         WHERE len(w) > 0 AND (c.p <> (doc_id, n) OR c.p IN (SELECT p FROM near)))
SELECT d.doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n_lines, count(g.n) AS n_removed,
       coalesce(list(g.n::INT ORDER BY g.n) FILTER (WHERE g.n IS NOT NULL), []) AS removed_lines
FROM documents d LEFT JOIN gone g ON g.doc_id = d.doc_id GROUP BY d.doc_id, d.text
"""


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents, and the row that stays."""
    return exact.exact_groups(read(spark, sf_dir, "documents")).drop("n_chars")


ORACLE["op13_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size,
                  regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]+', '', 'g') AS k FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(k) AS text_sha256
FROM d WINDOW w AS (PARTITION BY k ORDER BY size DESC, doc_id NULLS LAST)
"""


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical.ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("n_matched", "mask_bound")


_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

ORACLE["op12_ranked_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*) AS nn, sum(len(ts))::BIGINT AS ll FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS x FROM benchmark),
tf AS (SELECT r, x, count(*) AS tf FROM (SELECT r, unnest(ts) AS x FROM d) WHERE x IN (SELECT x FROM q) GROUP BY r, x),
w AS (SELECT x, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY x, nn),
m AS (SELECT r, doc_id, 10 + (90 * len(ts)::BIGINT * nn) // ll AS m FROM d, s),
sc AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
       FROM tf JOIN q USING (x) JOIN w USING (x) JOIN m USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM sc WHERE score > 0)
WHERE rank <= 10
"""


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of all embeddings."""
    return whiten.whitened(read(spark, sf_dir, "embeddings"))
