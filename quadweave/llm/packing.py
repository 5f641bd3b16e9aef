"""Packing token pieces into fixed-length sequences by cutting-stock column generation.

1. Every document is tokenised, ended with one id, and cut at multiples of the
   sequence length; the remainders are the pieces to be packed.
2. The lengths, rounded up to UNIT tokens, make a histogram of at most
   length/UNIT classes. That is all the driver gets: its size is fixed.
3. The linear program over cutting patterns is solved by column generation: the
   duals of the current basis price the classes, and a knapsack dynamic program
   finds the best new pattern, until none improves.
4. Pattern counts are rounded down; what is left (less than one sequence for
   each pattern) is packed first-fit, longest first.
5. Documents are ranked within their class by salted windows plus offsets, and a
   rank is looked up in the intervals that the patterns reserve.

Defined results: null and empty texts are one piece of the end id alone; repeated
rows are packed once each; an empty table gives no pieces; extra columns are not read.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import filterfalse
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quadweave.llm.common import documents, slices, text_buffers, texts_of
from quadweave.session import Table

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 1
UNIT = 8
#: The linear program stops within this share of a lower bound of its value.
GAP = 0.001
KEPT_CHUNKS = 800_000
#: Letters before this one (Latin, Greek, Cyrillic) are letters in all versions of Unicode since 7.
OLD_LETTERS_END = "\u0530"
WORD_AND_SIGNS = re.compile(r"([^\W\d_]+)([.,!?;:|*#$%&]+)")

# ---------------------------------------------------------------- tokens


class ChunkTokenizer:
    """Ids by way of chunks between ASCII white space, each tokenised once and kept.

    The vocabulary's pre-tokenizer drops white space and never joins what stands
    on two sides of it, so a text's ids are its chunks' ids in a row. Strings of
    special tokens stand for them, as in a plain call of the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a search less; chunks that may hold their strings go to the plain one
        # words of a-z alone are their own normal form and one match of the pattern: for those neither is needed
        bare = json.loads(Path(path).read_text(encoding="utf-8")) | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {"": b""}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        collects = gc.isenabled()
        gc.disable()  # many strings and lists, no cycles
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = []
        for t in texts:
            for c in "\n\t\r\x0b\x0c":
                if c in t:
                    t = t.replace(c, " ")
            cut.append(t.split(" "))
        if len(self.kept) > KEPT_CHUNKS:
            self.kept = {"": b""}
        known = self.kept.__contains__
        new: set[str] = set()
        for chunks in cut:
            new.update(filterfalse(known, chunks))
        self._learn(new)
        get = self.kept.__getitem__
        return [b"".join(map(get, chunks)) for chunks in cut]

    def _learn(self, chunks: set[str]) -> None:
        """Words of letters alone are tokenised many at a time, those of ASCII letters once for all their cases; each ends with the first token that ends a word.

        A word with signs after it is the word and the signs, as the pre-tokenizer parts them. That holds for words whose normal
        form is letters alone by any version of Unicode: others go to the library with their signs.
        """
        letters, other, joined = set(), set(), []
        for c in chunks:
            if c.isalpha():
                letters.add(c)
            elif (m := WORD_AND_SIGNS.fullmatch(c)) and (m[1].isascii() or max(m[1]) < OLD_LETTERS_END and unicodedata.normalize("NFC", m[1]).lower().isalpha()):
                joined.append((c, m[1], m[2]))
                letters.add(m[1])
                other.add(m[2])
            else:
                other.add(c)
        words = letters.difference(self.kept)
        folded = {c: c.lower() for c in words if c.isascii()}
        other.update(self._learn_words(list({*folded.values()}.difference(self.kept)), self.bare))
        other.update(self._learn_words([c for c in words if c not in folded], self.tokenizer))
        self.kept.update((c, self.kept[low]) for c, low in folded.items() if low in self.kept)
        other.update(c for c in folded if c not in self.kept)
        rest = list(other.difference(self.kept))
        for own, part in ((self.tokenizer, [c for c in rest if "<|" not in c]), (self.plain, [c for c in rest if "<|" in c])):
            for lo in range(0, len(part), 20_000):
                for c, e in zip(part[lo : lo + 20_000], own.encode_batch_fast(part[lo : lo + 20_000], add_special_tokens=False), strict=True):
                    self.kept[c] = np.array(e.ids, "<u4").tobytes()
        for c, word, signs in joined:
            self.kept[c] = self.kept[word] + self.kept[signs]


    def _learn_words(self, words: list[str], own: "Tokenizer") -> list[str]:  # noqa: F821
        """Words with a letter that the vocabulary's library doesn't take for one may not be learnt: those are returned."""
        left = []
        for lo in range(0, len(words), 1_000):
            part = words[lo : lo + 1_000]
            ids = np.array(own.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
            if len(ends) == len(part):
                raw = ids.tobytes()
                self.kept.update(zip(part, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
            else:
                left += part
        return left


_loaded: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = ChunkTokenizer(path)
    return _loaded[path]


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens): each document's ids in pieces of at most capacity."""
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            for lo, hi in slices(text_buffers(batch.column(1))[0]):
                part = batch.slice(lo, hi - lo)
                row, start, length, crc, total = [], [], [], [], []
                for k, raw in enumerate(own.encode(texts_of(part.column(1)))):
                    raw += end
                    n = len(raw) // 4
                    for at in range(0, n, capacity):
                        piece = raw[at * 4 : (at + capacity) * 4]
                        row.append(k)
                        start.append(at)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *numbers], [id_col, "start", "length", "ids_crc32", "doc_tokens"])

    return src.mapInArrow(run, f"{id_col} {src.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


# ---------------------------------------------------------------- patterns


def _best_pattern(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming over the capacity."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    order = np.argsort(size, kind="stable")
    sizes, values = size[order], value[order]
    for c in range(1, capacity + 1):
        best[c], took[c] = best[c - 1], -2  # a class of no worth is left out
        n = int(np.searchsorted(sizes, c, side="right"))
        if n:
            gain = best[c - sizes[:n]] + values[:n]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], took[c] = gain[k], order[k]
    pattern, c = np.zeros(len(size)), capacity
    while c > 0:
        if took[c] == -2:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= int(size[took[c]])
    return float(best[capacity]), pattern


def column_generation(size: np.ndarray, demand: np.ndarray, capacity: int, max_rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each) of the linear program: least sequences for the demand."""
    m = len(size)
    fit = capacity // size
    basis = np.diag(fit.astype(float))
    times = demand / fit
    least = float((size * demand).sum() / capacity)
    for _ in range(max_rounds):
        dual = np.linalg.solve(basis.T, np.ones(m))
        worth, pattern = _best_pattern(np.maximum(dual, 0), size, capacity)
        if worth <= 1 + 1e-9 or times.sum() * (1 - GAP) <= max(times.sum() / worth, least):
            break
        direction = np.linalg.solve(basis, pattern)
        up = np.flatnonzero(direction > 1e-9)
        ratio = times[up] / direction[up]
        leave = up[int(ratio.argmin())]
        step = float(ratio.min())
        times = np.maximum(times - step * direction, 0)
        basis[:, leave] = pattern
        times[leave] = step
    return basis, np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Patterns (classes, how many of each, sequences) that hold every counted piece exactly once."""
    if not histogram:
        return []
    size = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[s] for s in size.tolist()], np.int64)
    basis, times = column_generation(size, left, capacity)
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    for k in np.argsort(-times, kind="stable"):
        pattern = basis[:, k].round().astype(np.int64)
        used = np.flatnonzero(pattern)
        n = min(int(times[k] + 1e-7), *(left[used] // pattern[used]).tolist())
        if n > 0:
            left -= n * pattern
            out.append((size[used], pattern[used], n))
    free: list[int] = []  # first fit, longest first, of what rounding left
    holds: list[dict[int, int]] = []
    for k in range(len(size) - 1, -1, -1):
        for _ in range(int(left[k])):
            at = next((i for i, room in enumerate(free) if room >= size[k]), None)
            if at is None:
                at = len(free)
                free.append(capacity)
                holds.append({})
            free[at] -= int(size[k])
            holds[at][int(size[k])] = holds[at].get(int(size[k]), 0) + 1
    for hold in holds:
        out.append((np.array(list(hold), np.int64), np.array(list(hold.values()), np.int64), 1))
    return out


def _intervals(patterns: list[tuple[np.ndarray, np.ndarray, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each class: first rank, pieces in a sequence, and first sequence of each pattern that uses it."""
    taken: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for classes, counts, n in patterns:
        for c, a in zip(classes.tolist(), counts.tolist(), strict=True):
            rows.setdefault(c, []).append((taken.get(c, 0), a, first))
            taken[c] = taken.get(c, 0) + a * n
        first += n
    return {c: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for c, r in rows.items()}  # type: ignore[misc]


def pack(pieces: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, keys: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """pieces with sequence_id and offset. pieces is read several times: give a written table."""
    spark = pieces.sparkSession
    salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = pieces.select(
        "*",
        F.ceil(F.col("length") / unit).cast("int").alias("__class"),
        F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int").alias("__salt"),
    )
    counts = ranked.groupBy("__class", "__salt").agg(F.count("*").alias("__n"))
    offsets = counts.select(
        "__class",
        "__salt",
        F.coalesce(F.sum("__n").over(Window.partitionBy("__class").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    histogram = {r["__class"]: r["n"] for r in counts.groupBy("__class").agg(F.sum("__n").alias("n")).collect()}
    where = _intervals(plan(histogram, capacity // unit))
    own = Window.partitionBy("__class", "__salt").orderBy(*keys, "length", "ids_crc32")
    placed = (
        ranked.withColumn("__rank", F.row_number().over(own) - 1)
        .join(offsets, ["__class", "__salt"])
        .select(*pieces.columns, "__class", (F.col("__rank") + F.col("__before")).cast("long").alias("__rank"))
    )
    names = [*pieces.columns, "sequence_id"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            kind, rank = np.asarray(batch.column(n - 2)), np.asarray(batch.column(n - 1))
            found = np.zeros(len(kind), np.int64)
            for c in np.unique(kind):
                rows = np.flatnonzero(kind == c)
                lows, per, first = where[int(c)]
                k = np.searchsorted(lows, rank[rows], side="right") - 1
                found[rows] = first[k] + (rank[rows] - lows[k]) // per[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], pa.array(found)], names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long"
    before = Window.partitionBy("sequence_id").orderBy(*keys, "length", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.mapInArrow(assign, schema).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack: one row per piece."""
    return pack(Table(cut_pieces(docs, path, capacity, end_id)).df, capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
