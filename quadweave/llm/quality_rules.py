"""Quality rules: fixed rules, and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

The n-grams are all words of a text, and around each gap between words the last two characters before and the
first two after it, hashed into BUCKETS.
Two multinomials over the buckets are counted, of trusted documents (labelled good, all of them) and of all documents. A
document's score is the mean over its n-grams of log p - log q; it is kept if the score reaches THRESHOLD. The rule is
deterministic and judges every document. SMOOTH counts of every bucket are shared out in proportion, so that
an n-gram nobody trusted has seen weighs less than nothing however few documents are trusted.

No text is shuffled unless the trusted ids are too many to broadcast: counts are aggregated before the shuffle into
BUCKETS rows, their weights (whole thousandths, so that sums don't depend on order) become one array, and a document is
judged inside its row.

Defined results: null, empty and blank texts have no words and fail the base rules. Without
trusted documents every n-gram weighs 0 and the base rules alone decide. Repeated
rows are judged alike, each on its own. An empty table gives an empty result. Extra columns of any name pass through filter_documents().
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadweave.llm.common import documents, free_name, labels

#: A prime, so that all bits of a hash count.
BUCKETS = 262139
THRESHOLD = -0.25
SMOOTH = 20
MIN_WORDS, MAX_REPEAT_SHARE = 50, 0.5
#: Ids that may be broadcast (16 bytes each).
MAX_SENT = 1_000_000

_BLANK = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _BLANK), "")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _crc(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def hashes(words: Column) -> Column:
    """The CRC-32 of each word."""
    return F.transform(words, _crc)


def grams(words: Column, h: Column) -> Column:
    """Buckets of all words (of their hashes h), and of the four characters around each gap between words."""
    gaps = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: _crc(F.concat(F.substring(F.get(words, i), -2, 2), F.lit(" "), F.substring(w, 1, 2))) % BUCKETS)
    return F.concat(F.transform(h, lambda x: x % BUCKETS), gaps)


def n_repeat_words(words: Column, h: Column) -> Column:
    """Words inside a window of three that occurs twice or more in the array; h: the words' hashes.

    Each window becomes one number, its hash with the position in the low bits; sorted, equal windows are
    neighbours. The words of neighbours with one hash are compared.
    """
    n = F.size(words)
    bits = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(n, F.lit(2)))).cast("int") + 1)
    at = lambda i, k: F.get(h, i + k)

    def of_mask(high: Column) -> Column:
        low = F.bitwise_not(high)

        def hashed(i: Column) -> Column:
            return F.xxhash64(at(i, 0), at(i, 1), at(i, 2)).bitwiseAND(high).bitwiseOR(i.cast("long"))

        def repeated(s: Column) -> Column:
            def same(x: Column, y: Column) -> Column:
                i, j = x.bitwiseAND(low).cast("int"), y.bitwiseAND(low).cast("int")
                words_too = lambda: (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2))
                return F.when(x.bitwiseXOR(y).bitwiseAND(high) == 0, words_too()).otherwise(False)

            return F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))

        places = lambda s: F.sort_array(F.transform(repeated(s), lambda x: x.bitwiseAND(low)))
        return _bound(F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), hashed)), lambda s: _bound(places(s), covered))

    def covered(p: Column) -> Column:
        three = F.lit(3).cast("long")
        return F.aggregate(F.transform(p, lambda x, k: F.least(three, F.coalesce(F.get(p, k + 1) - x, three))), F.lit(0).cast("long"), lambda a, x: a + x)

    mask = F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(_bound(mask, of_mask))


def verdict(text: Column, weights: Column | None = None, threshold: float = THRESHOLD) -> Column:
    """One struct: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def weighed(w: Column, h: Column) -> Column:
        if weights is None:
            return F.lit(0.0)
        total = F.aggregate(grams(w, h), F.lit(0).cast("long"), lambda a, b: a + F.get(weights, b.cast("int")))
        return F.when(F.size(h) > 0, total / (1000.0 * (2 * F.size(h) - 1))).otherwise(0.0)

    def of_words(w: Column) -> Column:
        return _bound(hashes(w), lambda h: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), n_repeat_words(w, h).alias("n_repeat_words"), weighed(w, h).alias("llr")))

    def judged(x: Column) -> Column:
        failed = (x["n_words"] < MIN_WORDS) | (x["n_repeat_words"] * 100 > x["n_words"] * int(100 * MAX_REPEAT_SHARE))
        return F.struct(
            x["n_words"],
            x["word_chars"],
            F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            _bound(lines, lambda y: F.size(y) - F.size(F.array_distinct(y))).cast("long").alias("n_dup_lines"),
            x["n_repeat_words"],
            failed.alias("base_failed"),
            x["llr"],
            (~failed & (x["llr"] >= threshold)).alias("kept"),
        )

    return _bound(_bound(words_of(text), of_words), judged)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), one row per row."""
    return docs.select(F.col(id_col), verdict(F.col(text_col)).alias("__v")).select(id_col, *[f"__v.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


# ---------------------------------------------------------------- log-likelihood ratio


def trusted_ids(marks: DataFrame, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    return marks.where(F.col(label) == 1).select(F.col(id_col).alias("__id")).where("__id is not null").distinct()


def weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column | None:
    """Array of BUCKETS weights in thousandths: log p of the trusted documents less log q of all. None if nothing is trusted."""
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).where("__text is not null")
    ids = trusted.withColumn("__trusted", F.lit(1))
    ids = F.broadcast(ids) if trusted.count() <= MAX_SENT else ids
    flagged = own.join(ids, "__id", "left").select(F.coalesce("__trusted", F.lit(0)).alias("__trusted"), "__text")
    # outer: else a filter on the array's size would be inferred, and the array made twice
    buckets = flagged.select("__trusted", F.explode_outer(_bound(words_of(F.col("__text")), lambda w: grams(w, hashes(w)))).alias("__bucket")).where("__bucket is not null")
    counts = buckets.groupBy(F.col("__bucket").cast("int").alias("__bucket")).agg(F.count("*").alias("q"), F.sum("__trusted").alias("p"))
    chunks = counts.groupBy((F.col("__bucket") / 256).cast("int")).agg(F.collect_list(F.struct("__bucket", "q", "p")).alias("x"))
    totals = F.aggregate("x", F.struct(F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("p")), lambda a, y: F.struct((a["q"] + y["q"]).alias("q"), (a["p"] + y["p"]).alias("p")))
    # 1024 rows of counts: strings of numbers, as the driver needs no more
    rows = chunks.select(totals.alias("t"), *[F.array_join(F.transform(F.col(f"x.{c}"), lambda y: y.cast("string")), " ").alias(c) for c in ("__bucket", "q", "p")]).collect()
    total_q, total_p = sum(r["t"]["q"] for r in rows), sum(r["t"]["p"] for r in rows)
    if not total_p:
        return None
    import numpy as np

    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        k, q, p = (np.array(r[c].split(" "), np.int64) for c in ("__bucket", "q", "p"))
        out[k] = np.round(1000 * np.log((p * (total_q / total_p) + SMOOTH) / (q + SMOOTH)))
    return F.from_json(F.lit(json.dumps(out.tolist(), separators=(",", ":"))), "array<int>")


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id with all that verdict() has, one row per row of docs."""
    out = verdict(F.col("text"), weights(docs, trusted), threshold)
    return docs.select("doc_id", out.alias("__v")).select("doc_id", "__v.*")


def filter_documents(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that are not kept."""
    name = free_name(docs, "kept")
    out = verdict(F.col("text"), weights(docs, trusted), threshold)
    return docs.withColumn(name, out["kept"]).where(F.col(name)).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: rules and verdict for every document."""
    out = judge(documents(spark, sf_dir), trusted_ids(labels(spark, sf_dir)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same rows in DuckDB SQL.
ORACLE = r"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS l FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM {documents}),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(list_aggregate(ws, 'string_agg', ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
base AS (SELECT f.doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols,
                (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
         FROM f LEFT JOIN c USING (doc_id)),
g1 AS (SELECT doc_id, unnest(ws) AS g FROM w
       UNION ALL SELECT doc_id, right(ws[i], 2) || ' ' || left(ws[i + 1], 2) FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w)),
y AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM g1)),
h AS (SELECT g, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i : i + 1])::BIGINT)),
                                            lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1]))) AS h FROM y, crc),
b AS (SELECT doc_id, h % 262139 AS k FROM g1 JOIN h USING (g)),
q AS (SELECT k, count(*) AS q, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS p FROM b GROUP BY k),
t AS (SELECT sum(q) AS q, sum(p) AS p FROM q),
v AS (SELECT k, CASE WHEN t.p = 0 THEN 0 ELSE round(1000 * ln((q.p * (t.q / t.p) + 20) / (q.q + 20))) END AS weight FROM q, t),
s AS (SELECT doc_id, sum(weight) / (1000.0 * count(*)) AS llr FROM b JOIN v USING (k) GROUP BY doc_id),
j AS (SELECT base.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, coalesce(llr, 0) AS llr FROM base LEFT JOIN s USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND llr >= -0.25) AS kept FROM j
"""
