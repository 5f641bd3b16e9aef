"""Near duplicates: an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Every text becomes its set of word shingles, a key of the whole set, and a
   MinHash signature (one Arrow pass, numpy). Texts with equal sets are one
   class from here on, so copies of any number cost one row.
2. The forest: TREES orders of the signature's places. Each order makes a label
   whose first ROOT places name a region; regions are hash-partitioned and
   sorted by the rest of the label. A region of up to WINDOW + 1 classes is taken whole; in a larger one
   the order goes on, and a class is compared with its neighbours on either side, those with the longest
   common prefixes, and with the region's smallest class. So each region is as deep as it needs.
3. A larger region is dense: there these pairs only bring likely links together. What
   they may miss is found exactly: the dense classes' shingles are put in order of rarity, and
   classes of different components are joined on the shingles of their prefixes, with
   length, positional and parity filters, seldom more than once for a pair. So no link between dense classes rests on the window.
4. Candidates are confirmed on the full sets. First each class is confirmed with its best
   partner; then, after components are formed, in ROUNDS rounds with one likely partner in
   another component; at last all candidates that still join two components,
   those of dense classes from step 3. What remains lies inside a
   component and cannot change the result.
5. Confirming streams a hub's set against its partners', hubs with
   many partners being split; components are found by star rounds.

Two classes of Jaccard J share a region in one order with probability J**ROOT;
at 0.85 all TREES orders miss with probability 2e-8.

Defined results: null and empty texts have an empty set and no links; a null id
keeps a null component and is kept; rows with one id share one node; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quadweave.graph import connected_components
from quadweave.llm.common import documents, free_name, mix, powers, slices, text_buffers, windows, word_hashes
from quadweave.session import Table

SHINGLE = 5
TREES, ROOT, DEPTH = 24, 4, 8
PLACES = TREES * ROOT
WINDOW = 16
#: Rounds in which each class may be linked with one likely partner in another component, before all that is left is tested.
ROUNDS = 2
HUB = 256
PARITY_BITS = 512
#: Shingles before one that are looked at to tell whether a pair has met before.
BEFORE = 4
#: Orders that a pair was met in to be tried before others.
LIKELY = 4
JACCARD = 0.85

_rng = np.random.Generator(np.random.PCG64(7))
_MULTIPLY = (_rng.integers(0, 2**32, PLACES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))
_ADD = _rng.integers(0, 2**32, PLACES, dtype=np.uint64).astype(np.uint32)
#: The order of places of each tree: its own ROOT places first, then others.
_ORDERS = np.array([np.concatenate([np.arange(t * ROOT, t * ROOT + ROOT), _rng.permutation(np.setdiff1d(np.arange(PLACES), np.arange(t * ROOT, t * ROOT + ROOT)))[: DEPTH - ROOT]]) for t in range(TREES)])


#: Rows of numbers that may be broadcast (at most 40 bytes each).
MAX_SENT = 1_000_000


def sent(df: DataFrame) -> DataFrame:
    """df (written), to be broadcast if it has few rows; above that the same join is shuffled."""
    return F.broadcast(df) if df.count() <= MAX_SENT else df


# ---------------------------------------------------------------- sets


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than width make one shingle."""
    words, pointers = word_hashes(data, offsets[:-1], fold=True)
    grams = windows(words, width)
    out = []
    for lo, hi in zip(pointers[:-1].tolist(), pointers[1:].tolist(), strict=True):
        n = hi - lo
        if n >= width:
            out.append(np.unique(grams[lo : hi - width + 1]))
        elif n:
            with np.errstate(over="ignore"):
                out.append(mix(np.array([(words[lo:hi] * powers(n + 1)[1:]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets, 16 bits a place."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), PLACES), np.uint16)
    with np.errstate(over="ignore"):
        for k in range(PLACES):
            least = np.minimum.reduceat(x * _MULTIPLY[k] + _ADD[k], starts)
            out[:, k] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    return out


def sets_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_key binary, sig binary, th); key and sig are null for empty sets; th is the text's hash."""
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long"), text, F.xxhash64(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(batch.column(1))
            for lo, hi in slices(offsets, 1_000_000):
                sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                full = [k for k, s in enumerate(sets) if len(s)]
                keys: list[bytes | None] = [None] * len(sets)
                sigs: list[bytes | None] = [None] * len(sets)
                if full:
                    for k, row in zip(full, signatures([sets[k] for k in full]), strict=True):
                        keys[k], sigs[k] = blake2b(sets[k].tobytes(), digest_size=16).digest(), row.tobytes()
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), sizes, pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), batch.column(2).slice(lo, hi - lo)], ["doc_id", "n_shingles", "set_key", "sig", "th"])

    return src.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary, th long")


# ---------------------------------------------------------------- forest


def labels(classes: DataFrame) -> DataFrame:
    """(region, deep, rep, n) for every class and tree: the label's root and its rest as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, PLACES)
                rep, n = np.asarray(part.column(0)), np.asarray(part.column(1))
                for t, order in enumerate(_ORDERS):
                    label = np.ascontiguousarray(sig[:, order]).byteswap().view(">u8").astype(np.uint64)
                    region = mix(label[:, 0] + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % 2**64))
                    yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), pa.array(label[:, 1].view(np.int64)), pa.array(rep), pa.array(n)], ["region", "deep", "rep", "n"])

    return classes.select("rep", "n", "sig").mapInArrow(run, "region long, deep long, rep long, n long")


def candidates(labelled: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """(a, b, hits), a < b: classes that are near in some tree, by how many trees.

    A region of up to WINDOW + 1 classes is taken whole. In a larger one each class is paired with its neighbours in order, as
    no others have a longer common prefix with it, and with the region's hub, its smallest class (of those a task has seen so
    far); and it has a row with a = b, which marks it as dense. Hubs are often the same in many trees, so that a group of near copies hangs together.
    Pairs whose sizes rule the similarity out are left out.
    """
    dealt = labelled.repartition("region").sortWithinPartitions("region", "deep", "rep")

    def pairs_of(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, dense: np.ndarray, hub: np.ndarray | None) -> np.ndarray:
        """starts, sizes and dense of each region; hub: the row of the first one's hub so far."""
        rep, n = rows[:, 2], rows[:, 3]
        first, thick = np.repeat(starts, sizes), np.repeat(dense, sizes)
        x, y = [rows[:0]], [rows[:0]]
        for step in range(1, min(WINDOW, len(rows) - 1) + 1):
            i = np.flatnonzero((first[step:] == first[:-step]) & ((step == 1) | ~thick[step:]))
            x.append(rows[i])
            y.append(rows[i + step])
        for k in np.flatnonzero(dense).tolist():
            own = rows[starts[k] : starts[k] + sizes[k]]
            least = own[own[:, 2].argmin()]
            if k == 0 and hub is not None and hub[2] < least[2]:
                least = hub
            x.append(own)
            y.append(np.broadcast_to(least, own.shape))
        x, y = np.concatenate(x), np.concatenate(y)
        fits = (np.minimum(x[:, 3], y[:, 3]) >= jaccard * np.maximum(x[:, 3], y[:, 3]) - 1e-9) & (x[:, 2] != y[:, 2])
        a, b = x[fits, 2], y[fits, 2]
        return np.concatenate([np.column_stack([rep[thick], rep[thick]]), np.column_stack([np.minimum(a, b), np.maximum(a, b)])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hub = np.zeros((0, 4), np.int64), None  # the region that may go on: whole, or the last row and the hub of a dense one
        for batch in chain(batches, [None]):
            rows = held if batch is None else np.concatenate([held, np.column_stack([np.asarray(batch.column(k)) for k in range(4)])])
            if not len(rows):
                continue
            starts = np.concatenate([[0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1])
            sizes = np.diff(np.append(starts, len(rows)))
            dense = sizes > WINDOW + 1
            dense[0] |= hub is not None
            before, hub, held = hub, None, rows[:0]
            if batch is not None:
                own = rows[starts[-1] :]
                if dense[-1]:
                    hub, held = own[own[:, 2].argmin()], own[-1:]
                    if len(starts) == 1 and before is not None and before[2] < hub[2]:
                        hub = before
                else:
                    held, rows, starts, sizes, dense = own, rows[: starts[-1]], starts[:-1], sizes[:-1], dense[:-1]
            if len(rows):
                found = pairs_of(rows, starts, sizes, dense, before)
                if len(found):
                    pairs, hits = np.unique(found, axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(hits.astype(np.int64))], ["a", "b", "hits"])

    return dealt.mapInArrow(run, "a long, b long, hits long").groupBy("a", "b").agg(F.sum("hits").alias("hits"))


# ---------------------------------------------------------------- dense regions


def gram_rows(texts: DataFrame) -> DataFrame:
    """(rep, component, n, gram): every shingle of texts (rep, component, text), and the size of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(batch.column(2))
            reps, components = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for lo, hi in slices(offsets, 1_000_000):
                sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                sizes = np.array([len(s) for s in sets])
                columns = [np.repeat(x, sizes) for x in (reps[lo:hi], components[lo:hi], sizes)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.concatenate(sets).view(np.int64))], ["rep", "component", "n", "gram"])

    return texts.select("rep", "component", "text").mapInArrow(run, "rep long, component long, n long, gram long")


def prefixes(texts: DataFrame, percent: int) -> DataFrame:
    """(rep, component, n, gram, at, most, b1, b2, ...): the shared shingles in the prefix of each text's set.

    Shingles stand in order of rarity among texts; those of one text alone come first, so at counts
    them too. most: shingles of the set that another text has. Only shingles found in two
    components are returned; b1, b2, ...: the BEFORE ones returned before it, null where there are fewer.
    """
    grams = gram_rows(texts)
    shared = grams.groupBy("gram").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("df > 1")
    own = Window.partitionBy("rep")
    ranked = (
        grams.join(shared, "gram")
        .withColumn("most", F.count("*").over(own))
        .withColumn("at", F.col("n") - F.col("most") + F.row_number().over(own.orderBy("df", "gram")))
    )
    # integers all through: a link needs ceil(percent * n / 100) shingles of either set
    kept = ranked.where(f"at <= n - ({percent} * n + 99) div 100 + 1 and lo <> hi")
    return kept.select("rep", "component", "n", "gram", "at", "most", *[F.lag("gram", k).over(own.orderBy("at")).alias(f"b{k}") for k in range(1, BEFORE + 1)])


def parities(texts: DataFrame) -> DataFrame:
    """(rep, p0, p1, ...): of each text's set, the parity of the number of shingles in each of PARITY_BITS hash buckets."""
    names = [f"p{k}" for k in range(PARITY_BITS // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(batch.column(1))
            for lo, hi in slices(offsets, 1_000_000):
                sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                odd = np.stack([np.bincount((s >> np.uint64(20)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1 for s in sets]).astype(np.uint8)
                words = np.packbits(odd, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(words[:, k].copy()) for k in range(len(names))]], ["rep", *names])

    return texts.select("rep", "text").mapInArrow(run, ", ".join(f"{c} long" for c in ["rep", *names]))


def dense_pairs(texts: DataFrame, percent: int) -> DataFrame:
    """(hub, leaf): a superset of all links between texts (rep, component, text) of two components."""
    spread = Table(prefixes(texts, percent).join(parities(texts), "rep")).df
    return met_pairs(spread, percent).distinct()


def met_pairs(spread: DataFrame, percent: int) -> DataFrame:
    """(hub, leaf): pairs that share a prefix shingle (of prefixes() and parities()) and may be linked; few come more than once.

    A link is made at its first common shingle at least. So a pair is left out at a shingle if one of the BEFORE ones before it is
    common too, and nothing before it counts for what the sets may have in common.
    Places where the parities of two sets differ are at most as many as shingles that one of them
    has alone, so that too many of them rule a link out.
    """
    bits = [c for c in spread.columns if c[0] == "p" and c[1:].isdigit()]
    before = [f"b{k}" for k in range(1, BEFORE + 1)]
    a, b = (spread.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "component", "n", "at", "most", *before, *bits)]) for s in "ab")
    # of the smaller set, fewer shingles need be looked at: a link has at least 2 * percent / (100 + percent) of it in common
    short = lambda x: f"at_{x} <= n_{x} - ({2 * percent} * n_{x} + {99 + percent}) div {100 + percent} + 1"
    differ = " + ".join(f"bit_count({c}_a ^ {c}_b)" for c in bits)
    again = " or ".join(f"{x}_a = {y}_b" for x in before for y in before)
    able = f"""rep_a < rep_b and component_a <> component_b
        and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)
        and if(n_a <= n_b, {short("a")}, {short("b")})
        and least(most_a, most_b, 1 + least(n_a - at_a, n_b - at_b)) * {100 + percent} >= {percent} * (n_a + n_b)
        and not coalesce({again}, false)
        and ({differ}) * {100 + percent} <= {100 - percent} * (n_a + n_b)"""
    return a.join(b, "gram").where(able).select(F.col("rep_a").alias("hub"), F.col("rep_b").alias("leaf"))


# ---------------------------------------------------------------- confirming


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = 85) -> DataFrame:
    """(a, b), written: pairs whose full sets have 100 * intersection >= percent * union.

    pairs: (hub, leaf); texts: (rep, text). Each hub's text goes once for up to
    HUB of its leaves, each leaf's once for each of its pairs.
    """
    degree = pairs.groupBy("hub").agg(F.count("*").alias("__d"))
    own = pairs.join(degree, "hub").withColumn("__salt", F.pmod(F.xxhash64("leaf"), F.ceil(F.col("__d") / HUB))).select("hub", "leaf", "__salt")
    asked = (
        own.select(F.col("hub").alias("rep"), "hub", "__salt", F.lit(0).alias("__tag"))
        .distinct()
        .unionByName(own.select(F.col("leaf").alias("rep"), "hub", "__salt", F.lit(1).alias("__tag")))
    )
    asked = Table(asked)
    rows = texts.join(sent(asked.df), "rep").repartition("hub", "__salt").sortWithinPartitions("hub", "__salt", "__tag").select("hub", "__tag", "rep", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_set = None
        for batch in batches:
            offsets, data = text_buffers(batch.column(3))
            hubs, tags, reps = (batch.column(k).to_pylist() for k in range(3))
            for lo, hi in slices(offsets, 1_000_000):
                sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                a, b = [], []
                for k, own_set in zip(range(lo, hi), sets, strict=True):
                    if tags[k] == 0:
                        hub_set = own_set
                        continue
                    both = len(np.intersect1d(hub_set, own_set, assume_unique=True))
                    if 100 * both >= percent * (len(hub_set) + len(own_set) - both):
                        a.append(hubs[k])
                        b.append(reps[k])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    links = Table(rows.mapInArrow(run, "a long, b long")).df
    asked.drop()
    return links


def _open(pairs: DataFrame, tested: DataFrame, found: DataFrame) -> DataFrame:
    """(hub, leaf, hits, other): untested candidates that join two components; other is the hub's."""
    left = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    right = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return (
        pairs.join(tested.select(F.col("hub").alias("a"), F.col("leaf").alias("b")), ["a", "b"], "left_anti")
        .join(left, "a", "left")
        .join(right, "b", "left")
        .where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        .select(F.col("a").alias("hub"), F.col("b").alias("leaf"), "hits", F.coalesce("ca", "a").alias("other"))
    )


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs, linked at percent / 100."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = Table(sets_table(docs)).df
    classes = sets.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.first("n_shingles").alias("n"), F.min_by("sig", "doc_id").alias("sig"))
    # a class has a number of its own, as one id may hold texts of several classes
    classes = Table(classes.select("set_key", F.xxhash64("set_key").alias("rep"), "first.*", "n", "sig")).df
    near = Table(candidates(labels(classes), percent / 100)).df

    met = near.select(F.col("a").alias("rep")).unionByName(near.select(F.col("b").alias("rep"))).distinct()
    named = Table(classes.join(met, "rep", "left_semi").select("doc_id", "th", "rep")).df
    own = docs.withColumn("th", F.xxhash64("text")).join(sent(named), ["doc_id", "th"]).select("rep", "text")
    if not sets.where("set_key is not null").groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        own = own.dropDuplicates(["rep"])  # rows that are repeated whole
    texts = Table(own).df

    pairs = near.where("a < b")
    dense = near.where("a = b").select(F.col("a").alias("rep"))
    dense_texts = Table(texts.join(dense, "rep", "left_semi")).df
    both = dense_texts.select("rep")
    best = (
        pairs.select(F.col("a").alias("leaf"), F.col("b").alias("hub"), "hits")
        .unionByName(pairs.select(F.col("b").alias("leaf"), F.col("a").alias("hub"), "hits"))
        .groupBy("leaf")
        .agg(F.max_by("hub", F.struct("hits", -F.col("hub"))).alias("hub"))
        .select(F.least("hub", "leaf").alias("hub"), F.greatest("hub", "leaf").alias("leaf"))
        .distinct()
    )
    same_id = sets.where("set_key is not null and doc_id is not null").select("doc_id", "set_key").distinct().join(classes.select("set_key", F.col("doc_id").alias("a")), "set_key").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    tested = Table(best).df
    links = confirm(tested, texts, percent)
    for _ in range(ROUNDS):  # large groups of near copies come together here
        open_ = _open(pairs, tested, connected_components(links, "a", "b"))
        more = Table(open_.groupBy("leaf").agg(F.min_by("hub", F.struct(F.col("hits") < LIKELY, "other", "hub")).alias("hub")).select("hub", "leaf")).df
        if more.isEmpty():
            break
        tested = tested.unionByName(more)
        links = links.unionByName(confirm(more, texts, percent))
    found = connected_components(links, "a", "b")
    sparse = pairs.join(both.toDF("a"), "a", "left_anti").unionByName(pairs.join(both.toDF("a"), "a", "left_semi").join(both.toDF("b"), "b", "left_anti"))
    exact = dense_pairs(dense_texts.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"), "text"), percent)
    more = _open(sparse, tested, found).select("hub", "leaf").unionByName(exact.join(tested, ["hub", "leaf"], "left_anti"))
    links = links.unionByName(confirm(Table(more).df, texts, percent))
    first = lambda c: classes.select(F.col("rep").alias(c), F.col("doc_id").alias(f"{c}_id"))
    links = links.join(first("a"), "a").join(first("b"), "b").where("a_id <> b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).unionByName(same_id)
    components = connected_components(links, "a", "b")
    out = sets.select("doc_id", "n_shingles").join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one row of every group of near duplicates: that of the smallest id, and of its rows the one with the smallest text.

    Rows with a null id belong to no group and stay, as do all rows without a word.
    """
    found = Table(cluster(docs, percent=percent)).df
    row, id_ = free_name(docs, "row"), free_name(docs, "id")
    gone = Table(found.where(~F.col("kept")).select(F.col("doc_id").alias(id_)).distinct()).df
    again = Table(found.where("n_shingles > 0 and kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_))).df
    same = F.col("doc_id").cast("long") == F.col(id_)
    out = docs.join(sent(gone), same, "left_anti")
    if not again.isEmpty():
        wordless = ~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
        twice = out.join(sent(again), same, "left_semi")
        one = twice.where(~wordless).withColumn(row, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(row) == 1).drop(row)
        out = out.join(sent(again), same, "left_anti").unionByName(one).unionByName(twice.where(wordless))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: near-duplicate groups of all documents."""
    return cluster(documents(spark, sf_dir))


#: The same rows in DuckDB SQL, with all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i : i + 4], ' ') ELSE array_to_string(ws, ' ') || ' #' END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, (m.c = d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.id = d.doc_id
"""
