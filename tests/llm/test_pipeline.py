"""The pipeline's stages on a small table with a clashing extra column, and the whole of it against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
from test_operators import brute_lines, brute_quality, shingles

import corpus_pipeline
import public_tokenizers
from quadweave.llm import packing, secrets
from quadweave.session import Table


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = [a + b for a in ("stone", "river", "garden", "winter", "letter") for b in "abcdefghij"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    line = text(12)
    base = text(150)
    near = base.split()
    near[3] = "other"
    rows = [(i, text(90), "en", "s", 0, 7) for i in range(20)]
    rows += [
        (20, base, "en", "s", 0, 7),
        (21, " ".join(near[:75]) + "\n" + " ".join(near[75:]), "en", "s", 0, 7),
        (22, text(60) + "\n" + line, "en", "s", 0, 7),
        (23, text(60) + "\n" + line, "en", "s", 0, 7),
        (24, text(70) + " deadbeefdeadbeef01", "en", "s", 0, 7),
        (25, "short", "en", "s", 0, 7),
        (26, None, None, None, None, None),
    ]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(15)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = Table(stage(spark, docs, sf)).df
        if name != "packing":
            assert docs.columns == before
            seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(seen["quality_rules"]) == set(range(25))
    assert set(seen["line_dedup"]) == set(range(25))
    assert seen["line_dedup"][22].text.endswith(line) and not seen["line_dedup"][23].text.endswith(line)
    assert set(seen["near_dedup"]) == set(range(25)) - {21}
    assert "[SECRET]" in seen["secret_scans"][24].text and seen["secret_scans"][24].n_chars == len(seen["secret_scans"][24].text)
    assert {r.doc_id for r in docs.collect()} == set(range(25)) - {21}


def brute_run(rows, trusted):
    """(id, start, length, crc, tokens) of all pieces by plain loops, stage after stage."""
    from tokenizers import Tokenizer

    kept = Counter((i, k) for i, failed, k in brute_quality(rows, trusted).elements())
    docs = [(i, t) for i, t in rows if kept[i, True]]
    left = brute_lines(docs)
    docs = [(i, left[i, t]) for i, t in docs]
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = sorted((root(a), root(b)), key=lambda k: docs[k][0])
                parent[rb] = ra
    docs = [d for k, d in enumerate(docs) if root(k) == k]
    table, clean = secrets.train(secrets.labelled_samples()), []
    for i, t in docs:
        for start, _, end in reversed(secrets.find_spans(t, table)):
            t = t[:start] + "[SECRET]" + t[end:]
        clean.append((i, t))
    own, out = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY)), Counter()
    for i, t in clean:
        ids = [*own.encode(t, add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            part = np.array(ids[at : at + 2048], "<u4")
            out[i, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    return out


def _write(spark, sf, rows, trusted):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")


def test_run(spark, tmp_path):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice(["ba", "lo", "mi", "ter", "an", "so", "ku", "ri"]) for _ in range(rng.randrange(1, 4)))
    vocabulary = sorted({word() for _ in range(400)})
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [line(rng.randrange(8, 30)) for _ in range(6)]
    rows = []
    for i in range(60):
        body = [line(rng.randrange(10, 40)) for _ in range(rng.randrange(2, 6))]
        if i % 4 == 0:
            body.insert(rng.randrange(len(body)), rng.choice(shared))
        if i % 7 == 0:
            body.append("token = " + "a1b2" * 5)
        rows.append((i, "\n".join(body)))
    for i in range(60, 70):  # near copies of one text, lines cut at other places
        w = rows[i - 60][1].split()
        w[3] = f"changed{i}"
        rows.append((i, " ".join(w)))
    rows += [(70 + i, " ".join(w + "***" for w in line(80).split())) for i in range(12)]
    rows += [(90, None), (91, ""), (92, "a " * 300), (93, line(5000))]
    trusted = range(40)
    _write(spark, str(tmp_path), rows, trusted)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces) == brute_run(rows, set(trusted))
    held = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 2048


def test_run_of_an_empty_table(spark, tmp_path):
    _write(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
