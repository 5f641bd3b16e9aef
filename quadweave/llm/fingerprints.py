"""Document fingerprints: a Merkle tree over sections, paragraphs and their segments.

A text is cut at line feeds into paragraphs, paragraphs are grouped into
sections of SECTION, and a paragraph is cut into segments of SEGMENT words,
which are the leaves. Every node's hash is made of its children's hashes, so
equal roots mean equal texts, and differing branches locate an edit.

A fingerprint is "root|section=paragraph:leaf,leaf;paragraph:leaf,leaf/section=...". The likeness of two fingerprints is the share of leaves that
they have in common (Dice, leaves counted as often as they occur), and 1 for equal roots.

Defined results: null and empty texts share one fingerprint, without leaves; it is unlike all
others (0). Rows are ordered by id, nulls first, then text; repeated ids are neighbours. An empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quadweave.llm.common import documents, texts_of

SECTION, SEGMENT = 8, 8
LEAF_BYTES, ROOT_BYTES = 5, 16


def _hash(data: bytes, size: int) -> str:
    return blake2b(data, digest_size=size).hexdigest()


def tree(text: str) -> list[list[list[str]]]:
    """Sections of paragraphs of leaf hashes."""
    if not text:
        return []
    paragraphs = []
    for line in text.split("\n"):
        words = line.split(" ")
        paragraphs.append([blake2b(" ".join(words[i : i + SEGMENT]).encode(), digest_size=LEAF_BYTES).hexdigest() for i in range(0, len(words), SEGMENT)])
    return [paragraphs[i : i + SECTION] for i in range(0, len(paragraphs), SECTION)]


def fingerprint(text: str) -> str:
    """The tree as a string: root|section=paragraph:leaf,leaf;paragraph:...

    A paragraph's hash is made of its leaves, a section's of its paragraphs, and the root of the sections and a longer hash of the whole text.
    """
    sections = []
    for s in tree(text):
        paragraphs = [(_hash(joined.encode(), LEAF_BYTES), joined) for joined in map(",".join, s)]
        sections.append((_hash("".join(h for h, _ in paragraphs).encode(), LEAF_BYTES), ";".join(f"{h}:{x}" for h, x in paragraphs)))
    root = _hash("".join(h for h, _ in sections).encode() + blake2b(text.encode(), digest_size=ROOT_BYTES).digest(), ROOT_BYTES)
    return root + "|" + "/".join(f"{h}={x}" for h, x in sections)


def _sections(print_: str) -> list[tuple[str, list[str]]]:
    """(hash, paragraphs) of each section; a paragraph is its hash, a colon and its leaves."""
    return [(h, body.split(";")) for h, _, body in (s.partition("=") for s in print_.partition("|")[2].split("/") if s)]


def leaves(print_: str) -> list[str]:
    return [x for _, paragraphs in _sections(print_) for p in paragraphs for x in p.partition(":")[2].split(",")]


def _alike(a: str, b: str, leaves_a: list[str], leaves_b: list[str]) -> float:
    if a.partition("|")[0] == b.partition("|")[0]:
        return 1.0
    total = len(leaves_a) + len(leaves_b)
    if not total:
        return 0.0
    common = Counter(leaves_a) & Counter(leaves_b)
    return 2.0 * sum(common.values()) / total


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints alone."""
    return _alike(a, b, leaves(a), leaves(b))


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of every branch of b that differs from a's at the same place; equal branches are not entered."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return []
    one, out = _sections(a), []
    for i, (h, paragraphs) in enumerate(_sections(b)):
        other = one[i] if i < len(one) else ("", [])
        if h != other[0]:
            mine = [p.partition(":")[0] for p in other[1]]
            out += [(i, j) for j, p in enumerate(paragraphs) if j >= len(mine) or mine[j] != p.partition(":")[0]]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint) for every row."""
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t) for t in texts_of(part.column(1))])], [id_col, "fingerprint"])

    return src.mapInArrow(run, f"{id_col} {src.schema[id_col].dataType.simpleString()}, fingerprint string")


# ---------------------------------------------------------------- neighbours


def with_next(docs: DataFrame, work, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """work((id, text), next text) for each row, where next follows in the order of ids; after the last comes the first.

    Ids are dealt into ranges between quantiles of the ids themselves, which keeps
    ranges even for any ids; each range gets a copy of the next range's first
    row. Texts are shuffled once, and a task holds two of them at a time. The
    driver gets one number per range; ranges follow the number of shuffle partitions.
    """
    spark = docs.sparkSession
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col), F.lit(-(2**63)))
    src = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), key.alias("__key"))
    cuts = src.agg(F.percentile_approx("__key", [i / n for i in range(1, n)], 10_000).alias("q")).first()["q"]
    cuts = sorted(set(cuts or []))
    m = len(cuts)
    if m:
        bounds, steps = F.lit(cuts), [1 << i for i in range(m.bit_length() - 1, -1, -1)]
        go = lambda acc, s: F.when((acc + s <= m) & (F.get(bounds, acc + s - 1) <= F.col("__key")), acc + s).otherwise(acc)
        src = src.withColumn("__range", F.aggregate(F.lit(steps), F.lit(0), go))
    else:
        src = src.withColumn("__range", F.lit(0))
    firsts = sorted((r["__range"], r["k"]) for r in src.groupBy("__range").agg(F.min("__key").alias("k")).collect())
    if not firsts:
        return spark.createDataFrame([], schema)
    after = [(firsts[i][0], firsts[(i + 1) % len(firsts)][1]) for i in range(len(firsts))]
    heads = src.drop("__range").join(F.broadcast(spark.createDataFrame(after, "__range int, __key long")), "__key")
    rows = src.select("__range", F.lit(0).alias("__copy"), "__key", id_col, "text").unionByName(heads.select("__range", F.lit(1).alias("__copy"), "__key", id_col, "text"))
    dealt = rows.repartition("__range").sortWithinPartitions("__range", "__copy", "__key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None
        at = -1
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                done = []
                for r, copy, i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), texts_of(part.column(4)), strict=True):
                    if pending is not None and r == at:
                        done.append((pending, text))
                    pending = (i, text) if not copy else None
                    at = r
                if done:
                    yield work(done)

    return dealt.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: fingerprints of all texts and of their edited forms, with their likeness."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_branches"]
    last: dict[str, tuple[str, str, list[str]]] = {}

    def printed(text: str) -> tuple[str, list[str]]:
        if "x" not in last or last["x"][0] != text:  # the next row's text was just looked at
            p = fingerprint(text)
            last["x"] = (text, p, leaves(p))
        return last["x"][1:]

    def work(pairs):
        rows = []
        for (i, text), following in pairs:
            own, own_leaves = printed(text)
            n = len(text)
            edited = text[: n - n // 4] + following[: n // 4]
            other = fingerprint(edited)
            next_, next_leaves = printed(following)
            rows.append((i, n, sha256(edited.encode()).hexdigest(), own, other, _alike(own, other, own_leaves, leaves(other)), _alike(own, next_, own_leaves, next_leaves), len(differing(own, other))))
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return with_next(documents(spark, sf_dir), work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_branches long")
