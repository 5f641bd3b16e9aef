"""Substring deduplication over a sparse token De Bruijn graph.

The graph's nodes are token k-mers, of which only anchors are taken: k-mers
whose hash is the least of some window of consecutive k-mers, as wide as a
repeat of SPAN words must hold. Equal spans therefore hold equal anchors. An edge
joins two anchors that follow each other in a text, and is the hash of all words from
the one to the other.

1. Every text becomes its anchors with the edges into and out of each (one Arrow pass).
2. Anchors are aggregated: smallest document, whether there is a second occurrence, and
   whether all occurrences have the same edge in, and out. Where they do, the path does not
   branch, and any text that holds the anchor holds the whole edge.
3. Repeated anchors are joined back to the texts. A window's lead is the anchor of its least
   k-mer, which its words alone determine. If the lead is not repeated, the window is not. If
   no anchor between the lead and the window's ends branches, the window is compacted: it
   occurs exactly where its lead occurs, and the lead's smallest document decides it.
4. The remaining windows, at branches, are verified one by one by their own
   hashes and source coordinates. A window is looked up if an earlier document has its lead, and is a
   source if a later one has it; texts that ask nothing and lose nothing go no further.
5. Words that a repeated window covers are removed.

Hashes have 64 bits and stand for word sequences; source words are not compared again.

Defined results: texts shorter than SPAN words lose nothing; null texts are empty;
rows with a null id neither lose words nor make others lose any; rows with one id are no
earlier copies of each other; an empty table gives an empty result; extra columns of any name pass through remove_repeats().
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quadweave.llm.common import documents, free_name, mix, powers, slices, text_buffers, windows, word_hashes
from quadweave.session import Table

SPAN, ANCHOR = 50, 16
REACH = SPAN - ANCHOR + 1
_BASE = np.uint64(0x9FB21C651E98DF25)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
#: Bits of what is known of a repeated anchor in a text: an earlier document has it, a later one has it, it has one edge in, one edge out.
_EARLIER, _LATER, _ONE_IN, _ONE_OUT = 8, 4, 2, 1
_START, _END = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over every window of width, by doubling."""
    done = 1
    out = x
    while done * 2 <= width:
        out = best(out[:-done], out[done:])
        done *= 2
    return best(out[: len(x) - width + 1], out[width - done : width - done + len(x) - width + 1]) if done < width else out


def anchors(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of k-mers that are the least of some REACH consecutive ones (all of them on ties), and those least values."""
    least = _slide(grams, REACH, np.minimum)
    pad = np.zeros(REACH - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([pad, least, pad]), REACH, np.maximum) == grams), least


class Words:
    """Word hashes of a slice of texts, with hashes of any span of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words, self.pointers = word_hashes(data, offsets[:-1], fold=False)
        self.grams = windows(self.words, ANCHOR)
        n = len(self.words)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * powers(n, _BASE), dtype=np.uint64)])
        self.back = powers(n + 1, _INVERSE)

    def span(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(np.uint64))

    def places(self, k: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        """First word, number of words, anchors (relative), and each window's least k-mer, of text k."""
        lo, hi = int(self.pointers[k]), int(self.pointers[k + 1])
        if hi - lo < SPAN:
            return lo, hi - lo, np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return lo, hi - lo, *anchors(self.grams[lo : hi - ANCHOR + 1])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("__th"), text.alias("text"))


def anchor_table(docs: DataFrame) -> DataFrame:
    """(doc_id, __th, n_words, sha256, anchor, edge) for every row; the last two are arrays: the edges into an anchor and out of it have its place and the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(batch.column(2))
            for lo, hi in slices(offsets):
                part = data[offsets[lo] : offsets[hi]]
                own = Words(part, offsets[lo : hi + 1] - offsets[lo])
                ids = batch.column(0).slice(lo, hi - lo)
                count, sha, ends = [], [], [0]
                found: list[list[np.ndarray]] = [[], []]
                edge_ends = [0]
                for k in range(hi - lo):
                    first, n, at, _ = own.places(k)
                    count.append(n)
                    sha.append(sha256(b" ".join(part[offsets[lo + k] - offsets[lo] : offsets[lo + k + 1] - offsets[lo]].tobytes().split())).hexdigest())
                    if len(at) and ids[k].is_valid:
                        edges = own.span(first + at[:-1], first + at[1:] + ANCHOR)
                        begin = own.span(np.array([first]), first + at[:1] + ANCHOR) ^ _START
                        end = own.span(first + at[-1:], np.array([first + n])) ^ _END
                        found[0].append(own.grams[first + at])
                        found[1].append(np.concatenate([begin, edges, end]))
                    else:
                        at = at[:0]
                    ends.append(ends[-1] + len(at))
                    edge_ends.append(edge_ends[-1] + len(at) + (len(at) > 0))
                lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array((np.concatenate(f) if f else np.zeros(0, np.uint64)).view(np.int64))) for e, f in zip((ends, edge_ends), found, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, batch.column(1).slice(lo, hi - lo), pa.array(count, pa.int64()), pa.array(sha), *lists], ["doc_id", "__th", "n_words", "sha256", "anchor", "edge"])

    return docs.mapInArrow(run, "doc_id long, __th long, n_words long, sha256 string, anchor array<long>, edge array<long>")


def _judge(rows: DataFrame) -> DataFrame:
    """(doc_id, __th, text, runs, open_at, open_hash): decided repeats as runs of window starts, and windows still open.

    open_at is four times a window's start, plus 2 if an earlier document has its lead, plus 1 if a later one has.
    text is null where there are neither runs nor windows to look up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(batch.column(2))
            for lo, hi in slices(offsets):
                own = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                spans = windows(own.words, SPAN)
                runs, at_, hash_ = [], [], []
                for k, info in enumerate(batch.column(3).slice(lo, hi - lo)):
                    first, n, at, least = own.places(k)
                    m = len(at)
                    flags = np.zeros(m, np.int64)
                    x = np.asarray(info.values)
                    flags[x >> 4] = x & 15
                    earlier, later, into, out = (flags & bit > 0 for bit in (_EARLIER, _LATER, _ONE_IN, _ONE_OUT))
                    p = np.arange(n - SPAN + 1)
                    c = np.searchsorted(at, p)
                    last = np.searchsorted(at, p + REACH - 1, side="right")
                    own_gram, lead = own.grams[first + at], c.copy()  # lead: the anchor that the window's least k-mer is
                    while (off := own_gram[lead] != least).any():
                        lead[off] += 1
                    fork_in = np.concatenate([[0], np.cumsum(~into)])
                    fork_out = np.concatenate([[0], np.cumsum(~out)])
                    whole = (earlier | later)[lead]
                    decided = (fork_in[lead + 1] == fork_in[c]) & (fork_out[last] == fork_out[lead])
                    hit = decided & earlier[lead]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                    runs.append(edge.tolist())
                    free = np.flatnonzero(whole & ~decided)
                    at_.append(free * 4 + earlier[lead[free]] * 2 + later[lead[free]])
                    hash_.append(spans[first + free])
                ends = pa.array(np.cumsum([0, *map(len, at_)]), pa.int32())
                flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(lo, hi - lo) for i in range(3)),
                        pa.array(runs, pa.list_(pa.int32())),
                        pa.ListArray.from_arrays(ends, pa.array(flat(at_, np.int64))),
                        pa.ListArray.from_arrays(ends, pa.array(flat(hash_, np.uint64).view(np.int64))),
                    ],
                    ["doc_id", "__th", "text", "runs", "open_at", "open_hash"],
                )

    judged = rows.mapInArrow(run, "doc_id long, __th long, text string, runs array<int>, open_at array<long>, open_hash array<long>")
    return judged.withColumn("text", F.expr("if(size(runs) > 0 or exists(open_at, x -> x & 2 > 0), text, null)"))


def _cut(rows: DataFrame) -> DataFrame:
    """(doc_id, __th, n_removed, sha256, kept) for texts with repeated windows: kept words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                removed, sha, kept = [], [], []
                for text, runs, more in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    words = text.encode().split()
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, np.array(runs[0::2], np.int64), 1)
                    np.add.at(step, np.array(runs[1::2], np.int64) + SPAN - 1, -1)
                    for p in more or ():
                        step[p] += 1
                        step[p + SPAN] -= 1
                    stays = np.cumsum(step)[:-1] == 0
                    left = b" ".join([words[i] for i in np.flatnonzero(stays)])
                    removed.append(int((~stays).sum()))
                    sha.append(sha256(left).hexdigest())
                    kept.append(left.decode())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(sha), pa.array(kept)], ["doc_id", "__th", "n_removed", "sha256", "kept"])

    return rows.mapInArrow(run, "doc_id long, __th long, n_removed long, sha256 string, kept string")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All rows with (doc_id, __th, n_words, sha256), and the changed texts as _cut() returns them."""
    keyed = _keyed(docs, id_col, text_col)
    table = Table(anchor_table(keyed)).df
    side = lambda at, name: F.slice("edge", at, F.size("anchor")).alias(name)
    each = table.select("doc_id", "anchor", side(1, "into"), side(2, "out")).select("doc_id", F.explode(F.arrays_zip("anchor", "into", "out")).alias("x")).select("doc_id", "x.anchor", "x.into", "x.out")
    nodes = (
        each.groupBy("anchor")
        .agg(
            F.min("doc_id").alias("low"),
            F.max("doc_id").alias("high"),
            (F.min("into") == F.max("into")).alias("one_in"),
            (F.min("out") == F.max("out")).alias("one_out"),
        )
        .where("low < high")
    )
    flags = F.expr(f"if(low < doc_id, {_EARLIER}, 0) | if(high > doc_id, {_LATER}, 0) | if(one_in, {_ONE_IN}, 0) | if(one_out, {_ONE_OUT}, 0)")
    info = (
        table.select("doc_id", "__th", F.posexplode("anchor").alias("ord", "anchor"))
        .join(nodes, "anchor")
        .groupBy("doc_id", "__th")
        .agg(F.collect_set(F.col("ord").cast("long") * 16 + flags).alias("info"))
    )
    judged = Table(_judge(keyed.join(info, ["doc_id", "__th"]).select("doc_id", "__th", "text", "info")).where("size(runs) > 0 or size(open_at) > 0")).df
    open_ = judged.select("doc_id", "__th", F.explode(F.arrays_zip("open_at", "open_hash")).alias("x")).select("doc_id", "__th", F.col("x.open_at").alias("at"), F.col("x.open_hash").alias("hash"))
    lows = open_.where("at & 1 > 0").groupBy("hash").agg(F.min("doc_id").alias("low"))
    asked = open_.where("at & 2 > 0").withColumn("at", F.shiftright("at", 2).cast("int"))
    more = asked.join(lows, "hash").where("doc_id > low").groupBy("doc_id", "__th").agg(F.collect_set("at").alias("more"))
    lost = judged.where("text is not null").select("doc_id", "__th", "text", "runs")
    changed = lost.join(more, ["doc_id", "__th"], "left").where("size(runs) > 0 or more is not null").dropDuplicates(["doc_id", "__th"])
    return table.select("doc_id", "__th", "n_words", "sha256"), _cut(changed.select("doc_id", "__th", "text", "runs", "more"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated words cut out of text; texts that lose nothing stay as they are."""
    _, cut = repeats(docs)
    id_, h, own, kept = (free_name(docs, x) for x in ("id", "h", "own", "kept"))
    new = cut.select(F.col("doc_id").alias(id_), F.col("__th").alias(h), F.col("kept").alias(kept))
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = docs.withColumn(own, th).join(new, (F.col("doc_id") == F.col(id_)) & (F.col(own) == F.col(h)), "left")
    return out.select(*[F.coalesce(kept, "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: what every document keeps when repeated spans of 50 words go."""
    rows, cut = repeats(documents(spark, sf_dir))
    cut = cut.select("doc_id", "__th", "n_removed", F.col("sha256").alias("__sha"))
    return rows.join(cut, ["doc_id", "__th"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("__sha", "sha256").alias("kept_sha256"))


#: The same rows in DuckDB SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM w) WHERE low < doc_id),
c AS (SELECT DISTINCT doc_id, i + k AS at FROM r, (SELECT unnest(range(0, 50)) AS k)),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS at FROM d),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.at) AS kept, count(*) AS n FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.at = p.at WHERE c.at IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
