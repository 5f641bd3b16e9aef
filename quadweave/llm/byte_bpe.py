"""Byte-level BPE encoding and decoding in padded numpy matrices.

Pieces of text (matches of the tokenizer's pattern) that a worker has not met
yet are dealt into length buckets; each bucket is a padded matrix of token ids.
In every round each row merges its leftmost pair of least rank, is compacted by
one place, and looks up the two pairs that the merge made, in an open-addressed
hash table of (left id, right id). Rows without a pair leave the matrix.

A row longer than LONG_ROW would need one round per merge at a cost of its
whole width. Such a row merges all places of its least-rank pair in one round,
left to right without overlap, which gives the same ids as long as none of the
new pairs ranks below the merged one; where one does, only the leftmost place
is merged in that round.

Defined results: null and empty texts have no ids and decode to no bytes;
repeated rows are encoded alike; extra columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from quadweave.llm.common import documents, slices, text_buffers, texts_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
NONE = np.int32(2**31 - 1)
LONG_ROW = 512
#: Pieces that a worker keeps with their ids; beyond that the store starts anew.
KEPT_PIECES = 800_000


class PairTable:
    """Open-addressed hash table from pairs of ids to the id of their concatenation."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1), np.uint64)
        self.values = np.full(size, NONE, np.int32)
        key = self._key(left, right)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            take, where = np.unique(slot[todo[free]], return_index=True)
            chosen = todo[free][where]
            self.keys[take], self.values[take] = key[chosen], value[chosen]
            todo = np.setdiff1d(todo, chosen, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (size - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it is no pair. Negative ids are padding."""
        out = np.full(left.shape, NONE, np.int32)
        flat = out.reshape(-1)
        l, r = left.reshape(-1), right.reshape(-1)
        todo = np.flatnonzero((l >= 0) & (r >= 0))
        key = self._key(l[todo], r[todo])
        slot = self._slot(key)
        while len(todo):
            there = self.keys[slot]
            hit = there == key
            flat[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there != np.uint64(2**64 - 1))
            todo, key, slot = todo[on], key[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out


class ByteBPE:
    """Encoder and decoder for a rank file; ids are ranks."""

    def __init__(self, path: str, pattern: str):
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a = np.array(pairs, np.int64).reshape(-1, 3)
        self.pairs = PairTable(a[:, 0], a[:, 1], a[:, 2].astype(np.int32))
        top = max(ranks.values()) + 1
        self.size = np.zeros(top, np.int64)
        for t, r in ranks.items():
            self.size[r] = len(t)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        by_id = sorted((r, t) for t, r in ranks.items())
        self.bytes = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)
        self.space = regex.compile(r"\s").search
        self.store: dict[str, bytes] = {}
        self.heads: dict[str, bytes | None] = {}
        self.tails: dict[str, bytes | None] = {}

    # ------------------------------------------------------------ encoding

    def _matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (int32 bytes) of pieces of nearly one length, all rounds in one padded matrix."""
        width = max(map(len, pieces))
        ids = np.full((len(pieces), width + 1), -1, np.int32)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids[np.arange(width + 1)[None, :] < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        final = np.full(ids.shape, -1, np.int32)
        rows, column = np.arange(len(pieces)), np.arange(width + 1)
        while len(rows):
            place = rank.argmin(axis=1)  # the first of the least: the leftmost
            least = rank[np.arange(len(rows)), place]
            done = least == NONE
            if done.any():
                final[rows[done], : ids.shape[1]] = ids[done]
                on = ~done
                rows, ids, rank, place, least = rows[on], ids[on], rank[on], place[on], least[on]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            ids[each, place] = least
            move = np.minimum(column[None, :] + (column[None, :] > place[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, move, axis=1)
            ids[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(move[:, :-1], rank.shape[1] - 1), axis=1)
            rank[:, -1] = NONE
            rank[each, place] = self.pairs.find(ids[each, place], ids[each, np.minimum(place + 1, ids.shape[1] - 1)])
            has = np.flatnonzero(place > 0)
            rank[has, place[has] - 1] = self.pairs.find(ids[has, place[has] - 1], ids[has, place[has]])
        kept = final >= 0
        raw, ends = final[kept].tobytes(), np.cumsum(kept.sum(axis=1) * 4).tolist()
        return [raw[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]

    def _long(self, piece: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        while len(ids) > 1:
            rank = self.pairs.find(ids[:-1], ids[1:])
            least = rank.min()
            if least == NONE:
                break
            place = np.flatnonzero(rank == least)
            run = np.concatenate([[True], np.diff(place) > 1])  # overlapping places: every second of a run
            place = place[(place - place[run][np.cumsum(run) - 1]) % 2 == 0]
            merged = self._merge(ids, place, least)
            if len(place) > 1 and (self.pairs.find(merged[:-1], merged[1:]) < least).any():
                merged = self._merge(ids, place[:1], least)
            ids = merged
        return ids

    @staticmethod
    def _merge(ids: np.ndarray, place: np.ndarray, value: int) -> np.ndarray:
        out = ids.copy()
        out[place] = value
        return np.delete(out, place + 1)

    def _learn(self, pieces: Iterable[str]) -> None:
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.store[piece] = np.int32(whole).tobytes()
            elif len(raw) > LONG_ROW:
                self.store[piece] = self._long(raw).tobytes()
            else:
                buckets.setdefault(-(-len(raw) // 3), []).append((piece, raw))
        for bucket, group in buckets.items():
            step = max(1, 400_000 // (bucket * 3))
            for i in range(0, len(group), step):
                part = group[i : i + step]
                self.store.update(zip((piece for piece, _ in part), self._matrix([raw for _, raw in part]), strict=True))

    def _learn_chunks(self, chunks: set[str], store: dict[str, bytes | None], lead: str) -> None:
        """Ids of lead + chunk; None where the chunk has white space of its own or is empty."""
        split = {c: self.split(lead + c) if c and not self.space(c) else None for c in chunks.difference(store)}
        self._learn({p for pieces in split.values() if pieces for p in pieces}.difference(self.store))
        get = self.store.__getitem__
        for chunk, pieces in split.items():
            store[chunk] = None if pieces is None else b"".join(map(get, pieces))

    def _by_pattern(self, text: str) -> bytes:
        pieces = self.split(text)
        self._learn(set(pieces).difference(self.store))
        return b"".join(map(self.store.__getitem__, pieces))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as int32.

        A match of the pattern never reaches over a single space or line feed
        between two other characters: it ends before it, or starts with the
        space. So a text is cut there, and each chunk's ids are kept. A text
        with any other white space goes through the pattern as a whole.
        """
        out: list[np.ndarray] = []
        ends = np.cumsum([0, *map(len, texts)])
        for lo, hi in slices(ends):
            if len(self.store) + len(self.tails) > KEPT_PIECES:
                for store in (self.store, self.heads, self.tails):
                    store.clear()
            cut = [[line.split(" ") for line in t.split("\n")] for t in texts[lo:hi]]
            self._learn_chunks({parts[0] for lines in cut for parts in lines}, self.heads, "")
            tails: set[str] = set()
            for lines in cut:
                for parts in lines:
                    tails.update(parts[1:])
            self._learn_chunks(tails, self.tails, " ")
            head, tail, feed = self.heads.__getitem__, self.tails.__getitem__, self.byte_ids[10].tobytes()
            for text, lines in zip(texts[lo:hi], cut, strict=True):
                found: list[bytes | None] = []
                for parts in lines:
                    found.append(feed)
                    found.append(head(parts[0]))
                    found.extend(map(tail, parts[1:]))
                raw = self._by_pattern(text) if None in found else b"".join(found[1:])  # type: ignore[arg-type]
                out.append(np.frombuffer(raw, np.int32))
        return out

    # ------------------------------------------------------------ decoding

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, which need not be whole characters."""
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.at[ids] - (ends - size), size)].tobytes()


_loaded: dict[tuple[str, str], ByteBPE] = {}


def load(path: str, pattern: str) -> ByteBPE:
    """One table per worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) for every row; path is the rank file on the executors."""
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for lo, hi in slices(text_buffers(batch.column(1))[0]):
                part = batch.slice(lo, hi - lo)
                ids = bpe.encode(texts_of(part.column(1)))
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [id_col, "ids"])

    return src.mapInArrow(run, f"{id_col} {src.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, ids_col, and decoded (binary). Null ids decode to no bytes."""
    src = encoded.select(*keep, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column(part.num_columns - 1)
                flat = np.asarray(lists.flatten())
                ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]).astype(np.int64)
                raw = [bpe.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*part.schema.names, "decoded"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields)
    return src.mapInArrow(run, f"{fields}, decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every text encoded and decoded, as digests."""
    import public_tokenizers

    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    both = decode(encode(documents(spark, sf_dir), path, pattern), path, pattern)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
