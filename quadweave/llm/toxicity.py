"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding disguises.

Texts are folded: lower case, homoglyphs to Latin letters, digits and signs that
stand for letters inside a word, everything that is no letter or digit to one
space. The lexicon is learnt from labelled rows: words and beginnings of words
that toxic documents hold far more often, weighted by their log-odds. Phrases
that hold a lexicon entry but occur in harmless documents only are exceptions:
what they cover is not counted. The weights found are normalised by length and
turned into a score by a logistic curve fitted on the same rows.

Only a bounded sample of labelled rows (MAX_LABELLED) is learnt from; every
document is scored on its whole text.

Defined results: null and empty texts get the score of a text without matches;
without any labelled row of both kinds the score is 0 and nothing is predicted;
repeated rows are scored alike; of several labels of one id the largest counts; entries of equal
chance are taken in alphabetical order; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quadweave.llm.common import documents, held_out, labels, texts_of

#: Bound of the sample that is fitted on; the driver holds so many texts.
MAX_LABELLED = 8_000
MAX_ENTRIES = 1_000

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans("авекмнорстухіјѕԁһԛԝαβεικνορτυχɡıⅼ", "abekmhopctyxijsdhqwabeikvoptuxgil")
#: Signs that stand for letters inside a word.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_SIGN = re.compile(r"(?<=[^\W\d_])[013457@$](?=[^\W\d_])")
_GAP = re.compile(r"[\W_]+")
_HAS_SIGN = re.compile(r"[^\W\d_][013457@$]|[013457@$][^\W\d_]")
_RUN = re.compile(r"[\w@$]+")
_LETTER = re.compile(r"[^\W\d_]")
_LETTERS = str.maketrans(SIGNS)
#: @ and $ that may be marks between words as well as letters.
_LOOSE = re.compile(r"^[@$]|[@$]$|[@$][\d@$]|\d[@$]")


def fold(text: str) -> str:
    """Folded text between two spaces.

    Signs stand for letters anywhere in a run that holds a letter. Where @ or $ may be a mark
    instead, the run stays as the mark has it and its reading as letters follows at the end.
    """
    text = text.lower()
    if not text.isascii():
        text = text.translate(HOMOGLYPHS)
    if _HAS_SIGN.search(text):
        more: list[str] = []

        def read(m: re.Match) -> str:
            run = m.group()
            full = run.translate(_LETTERS)
            if full == run or not _LETTER.search(run):
                return run
            if not _LOOSE.search(run):
                return full
            more.append(full)
            return _SIGN.sub(lambda m: SIGNS[m.group()], run)

        text = " ".join([_RUN.sub(read, text.replace("_", " ")), *more])
    return f" {_GAP.sub(' ', text).strip(' ')} "


# ---------------------------------------------------------------- model


class Lexicon:
    """Entries with weights, exception phrases, and the curve from weight to score."""

    def __init__(self, entries: dict[str, float], exceptions: tuple[str, ...] = (), curve: tuple[float, ...] = (-30.0, 0.0, 0.0)):
        self.entries, self.exceptions, self.curve = entries, tuple(exceptions), curve
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of every entry that no exception phrase covers."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.entries.items():
                self._automaton.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                self._automaton.add_word(phrase, (len(phrase), None))
            self._automaton.make_automaton()
        if not self.entries:
            return []
        found, free = [], []
        for end, (size, weight) in self._automaton.iter(folded):
            (free if weight is None else found).append((end + 1 - size, end + 1, weight))
        if free:  # the furthest end of the phrases that begin up to a place
            free.sort()
            starts = [a for a, _, _ in free]
            reach = list(accumulate((b for _, b, _ in free), max))
            found = [f for f in found if not ((k := bisect_right(starts, f[0])) and f[1] <= reach[k - 1])]
        return found

    def features(self, text: str) -> tuple[float, float]:
        """Weight found for a hundred words, and the weight of the strongest two entries.

        Of entries that begin at one place only the strongest counts.
        """
        folded = fold(text)
        best: dict[int, float] = {}
        for start, _, weight in self.matches(folded):
            best[start] = max(best.get(start, 0.0), weight)
        if not best:
            return 0.0, 0.0
        weights = sorted(best.values(), reverse=True)
        return 100.0 * sum(weights) / max(20, folded.count(" ") - 1), sum(weights[:2])

    def score(self, features: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.ones(len(features)), np.log1p(features[:, 0]), features[:, 1]])
        z = np.clip(x @ np.array(self.curve), -30, 30)
        return 1.0 / (1.0 + np.exp(-z))


def _candidates(folded: str) -> set[str]:
    """Whole words, and beginnings of words of four to eight letters."""
    words = set(folded.split(" "))
    words.discard("")
    out = {f" {w} " for w in words if len(w) > 1}
    for w in words:
        out.update(f" {w[:k]}" for k in range(4, min(9, len(w))))
    return out


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), np.log1p(x[:, 0]), x[:, 1]])
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.01, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def learn(rows: list[tuple[str, int]], exceptions: tuple[str, ...] = (), min_docs: int = 4, min_ratio: float = 1.5) -> Lexicon:
    """A lexicon from (text, toxic) rows."""
    y = np.array([int(bool(t)) for _, t in rows])
    n_toxic, n_clean = int(y.sum()), int(len(y) - y.sum())
    if not n_toxic or not n_clean:
        return Lexicon({})
    folded = [fold(text or "") for text, _ in rows]
    toxic: Counter[str] = Counter()
    for text, label in zip(folded, y, strict=True):
        if label:
            toxic.update(_candidates(text))
    toxic = Counter({c: n for c, n in toxic.items() if n >= min_docs})
    clean: Counter[str] = Counter()
    for text, label in zip(folded, y, strict=True):
        if not label:
            clean.update(c for c in _candidates(text) if c in toxic)
    ratio, chance = {}, {}
    for c, n in toxic.items():
        a, b = (n + 0.2) / (n_toxic + 1), (clean[c] + 0.2) / (n_clean + 1)
        ratio[c] = math.log(a / b)
        chance[c] = (n / n_toxic - clean[c] / n_clean) / math.sqrt((n + clean[c]) / len(rows) * (1 / n_toxic + 1 / n_clean))
    entries: dict[str, float] = {}
    for c in sorted((c for c in toxic if ratio[c] >= min_ratio and chance[c] >= 5), key=lambda c: (-chance[c], c)):
        if any(c.startswith(e.rstrip(" ")) and ratio[c] <= entries[e] + 1 for e in (c[:k] for k in range(5, len(c))) if e in entries):
            continue  # a beginning says as much already
        entries[c] = ratio[c]
        if len(entries) >= MAX_ENTRIES:
            break
    phrases: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    lexicon = Lexicon(entries, exceptions)
    for text, label in zip(folded, y, strict=True):
        near = set()
        for start, end, _ in lexicon.matches(text):
            stop = text.find(" ", max(end - 1, start + 1))
            before, after = text.rfind(" ", 0, start), text.find(" ", stop + 1)
            if before >= 0:
                near.add(text[before : stop + 1])
            if after >= 0:
                near.add(text[start : after + 1])
        phrases[int(label)].update(near)
    more = tuple(p for p, n in sorted(phrases[0].items(), key=lambda x: (-x[1], x[0])) if n >= 3 and not phrases[1][p])[:MAX_ENTRIES]
    lexicon = Lexicon(entries, (*exceptions, *more))
    x = np.array([lexicon.features(text) for text, _ in rows])
    lexicon.curve = _fit_curve(x, y)
    return lexicon


def labelled_rows(docs: DataFrame, marks: DataFrame, label: str, limit: int = MAX_LABELLED, id_col: str = "doc_id") -> DataFrame:
    """(__id, text, __label) of at most limit ids outside the held-out fold, the same ones each time.

    The sample is taken from the labels alone and is small, so it is
    broadcast to the documents and no text is shuffled. Of an id's labels the largest counts.
    """
    some = (
        marks.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__label"))
        .where("__id is not null and __label is not null")
        .where(~held_out("__id"))
        .groupBy("__id")
        .agg(F.max("__label").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(limit)
    )
    return docs.select(F.col(id_col).alias("__id"), "text").join(F.broadcast(some), "__id").select("__id", "text", "__label")


def labelled_sample(docs: DataFrame, marks: DataFrame, label: str, limit: int = MAX_LABELLED, id_col: str = "doc_id") -> list[tuple[str, int]]:
    """(text, label) of labelled_rows() on the driver, in order of id and text."""
    rows = labelled_rows(docs, marks, label, limit, id_col).collect()
    rows.sort(key=lambda r: (r["__id"], r["text"] or ""))
    return [(r["text"] or "", r["__label"]) for r in rows]


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for every row."""
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x = np.array([lexicon.features(t) for t in texts_of(part.column(1))]).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lexicon.score(x))], [id_col, "score"])

    return src.mapInArrow(run, f"{id_col} {src.schema[id_col].dataType.simpleString()}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: toxicity of every text."""
    docs = documents(spark, sf_dir)
    lexicon = learn(labelled_sample(docs, labels(spark, sf_dir), "toxic"))
    return score(docs, lexicon).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
