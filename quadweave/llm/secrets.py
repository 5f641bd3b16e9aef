"""Secret scanning: fixed patterns, and character Markov models for the rest.

Two first-order Markov chains over characters are trained from labelled
samples, one on random strings and one on ordinary identifiers. A candidate (a
run of key characters with letters and digits) is a secret if its
log-likelihood ratio per character is above the threshold.

Defined results: null and empty texts have no spans; spans are code points with
an exclusive end; repeated rows are scanned alike; extra columns pass through
redact() and are not read by scan().
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quadweave.llm.common import documents, texts_of

#: The kinds of spans in their order.
KINDS = ("assign", "access", "hex", "markov")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
MIN_CANDIDATE, MIN_LETTERS, THRESHOLD = 16, 20, 0.35

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (MIN_ACCESS - 4))
HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CANDIDATE)

#: Parts of ordinary identifiers for the labelled samples.
IDENTIFIER_PARTS = (
    "account action address album amount array author backup batch before binary block body bucket buffer build cache callback camera cancel channel "
    "check class client color column commit compare config connect context control copy count current cursor database debug decode default delete depth "
    "device direct display document draft driver edge editor element email empty enable engine entry error event example export factory feature "
    "field file filter first folder format frame function gateway global graph group handler hash header height hidden history host http image import "
    "index input insert instance internal item iterator java job json keyboard keyword kernel key kit label language layer layout level library link list load local lock "
    "manager match memory method model module mutex name network node null number object offset option order output package page parse partition "
    "path payload pixel platform point policy prefix previous proxy query queue quick quorum quota random range record register remote request reset "
    "response role route schema scroll search server session shadow size socket source stack state stream string style sync table task "
    "template thread time toggle transform tree trigger type unique unit update upload user utility validate value vector vendor version view "
    "virtual volume wait web widget width window worker wrapper write xml yaml yield zone zoom zookeeper"
).split()
_ONSETS = "b c d f g h j k l m n p q r s t v w x y z bl br ch cl cr dr fl fr gl gr kn ph pl pr qu sc sh sk sl sm sn sp st str sw th tr tw wh wr".split()
_NUCLEI = "a e i o u ai au ea ee ie io oa oo ou y".split()
_CODAS = ["", "", "", *"b ck ct d f ft g k l ld ll m mp n nd ng nk nt p r rd rk rm rn rt s sh ss st t th v w x y z".split()]


# ---------------------------------------------------------------- model


def _class_of() -> np.ndarray:
    """Characters as states: letters without case are told from capitals; 0 is anything else."""
    out = np.zeros(128, np.int64)
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-", 1):
        out[ord(c)] = i
    return out


STATES = _class_of()
N_STATES = int(STATES.max()) + 1


def labelled_samples(n: int = 4000, seed: int = 11) -> list[tuple[str, int]]:
    """Samples that are labelled by how they were made: 1 random string, 0 ordinary identifier."""
    rng = random.Random(seed)
    alphabets = ("abcdefghijklmnopqrstuvwxyz0123456789", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
    out = [("".join(rng.choice(alphabets[i % len(alphabets)]) for _ in range(rng.randrange(MIN_CANDIDATE, 48))), 1) for i in range(n)]
    made = lambda: "".join(rng.choice(_ONSETS) + rng.choice(_NUCLEI) + rng.choice(_CODAS) for _ in range(rng.randrange(1, 4)))
    short = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 4)))
    for i in range(n):
        parts = []
        while len(parts) < 3 or len("".join(parts)) < MIN_CANDIDATE:
            x = rng.random()
            parts.append(rng.choice(IDENTIFIER_PARTS) if x < 0.6 else made() if x < 0.85 else short())
            if rng.random() < 0.15:
                parts[-1] += str(rng.randrange(0, 10 ** rng.randrange(1, 5)))
        if rng.random() < 0.4:
            parts.append(rng.choice(["", "v", "V"]) + str(rng.randrange(0, 10 ** rng.randrange(1, 5))))
        style = i % 6
        capital = "".join(p[:1].upper() + p[1:] for p in parts)
        out.append((["_".join(parts), "-".join(parts), "/".join(parts), parts[0] + capital[len(parts[0]) :], "_".join(parts).upper(), capital][style], 0))
    return out


def train(samples: list[tuple[str, int]], smooth: float = 0.5) -> np.ndarray:
    """Log-likelihood ratio of every transition: random strings against identifiers."""
    counts = np.full((2, N_STATES, N_STATES), smooth)
    for text, label in samples:
        states = np.concatenate([[0], _states(text)])
        np.add.at(counts[int(label)], (states[:-1], states[1:]), 1)
    log = np.log(counts) - np.log(counts.sum(axis=2, keepdims=True))
    return log[1] - log[0]


def _states(text: str) -> np.ndarray:
    return STATES[np.frombuffer(text.encode("ascii", "replace"), np.uint8) & 127]


def ratio(table: np.ndarray, text: str) -> float:
    """Log-likelihood ratio per character."""
    states = np.concatenate([[0], _states(text)])
    return float(table[states[:-1], states[1:]].sum() / max(1, len(text)))


# ---------------------------------------------------------------- spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "apikey" in low or "api_key" in low:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= MIN_ASSIGN:
                out.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def find_spans(text: str, table: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """All spans by start, then kind. The model judges what no fixed pattern covers."""
    spans = base_spans(text)
    base = list(spans)
    for m in CANDIDATE.finditer(text):
        word = m.group()
        if not any(c.isalpha() for c in word) or word.isalpha() and len(word) < MIN_LETTERS:
            continue
        if any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        if ratio(table, word) > threshold:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: list[tuple[str, int]] | None = None) -> DataFrame:
    """(id_col, spans array<struct<kind,start,end>>) for every row."""
    table = train(samples if samples is not None else labelled_samples())
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(t, table)] for t in texts_of(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], [id_col, "spans"])

    return src.mapInArrow(run, f"{id_col} {src.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", samples: list[tuple[str, int]] | None = None) -> DataFrame:
    """docs with every span of text_col replaced by mark; null stays null."""
    table = train(samples if samples is not None else labelled_samples())
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, last = [], 0
        for start, _, end in find_spans(text, table):
            if start >= last:
                out += [text[last:start], mark]
            last = max(last, end)
        return "".join([*out, text[last:]]) if last else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = pa.array([clean(t) for t in part.column(at).to_pylist()], part.column(at).type)
                yield pa.RecordBatch.from_arrays([*part.columns[:at], texts, *part.columns[at + 1 :]], schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: secrets in every text."""
    found = scan(documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] != "markov")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
