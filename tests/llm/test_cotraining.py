"""Co-training against a plain loop, and fitted models on odd rows."""

import random
import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tracelens.llm import cotraining

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, kept string, words int, meta int"


def spark_hash(i: int) -> int:
    """xxhash64 of a long, as a signed number."""
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", i), 42)))[0]


def plain_loop(features: dict, truth: dict[int, int], rounds: int, exchanged: int) -> tuple[dict, list[int]]:
    """Scores of every document, and how many documents were handed over each time."""
    words, x = ({i: f[k] for i, f in features.items()} for k in (0, 1))
    order = sorted(truth, key=lambda i: zlib.crc32(b"%d" % i))
    held, own = order[: len(order) // 4], order[len(order) // 4 :]
    known = {"content": {i: truth[i] for i in own}, "meta": {i: truth[i] for i in own}}
    free = [i for i in features if i not in truth]
    given = {"content": set(), "meta": set()}
    sizes = []

    def trained():
        y = {v: np.array(list(known[v].values()), float) for v in known}
        content = cotraining.Content([words[i] for i in known["content"]], y["content"])
        meta = cotraining.Metadata(np.stack([x[i] for i in known["meta"]]), y["meta"])
        return cotraining.Model(content, meta, [words[i] for i in held], np.stack([x[i] for i in held]), np.array([truth[i] for i in held], float))

    model = trained()
    for _ in range(rounds):
        scores = model.predict([words[i] for i in free], np.stack([x[i] for i in free]), True)
        for by, to in ((scores[0], "meta"), (scores[1], "content")):
            for good in (1, 0):
                sure = [(-s if good else s, spark_hash(i), i) for s, i in zip(by, free) if (s >= 0.9 if good else s <= 0.1)]
                new = [i for _, _, i in sorted(sure) if i not in given[to]][:exchanged]
                sizes.append(len(new))
                known[to] |= {i: good for i in new}
                given[to] |= set(new)
        model = trained()
    ids = list(features)
    return dict(zip(ids, zip(*model.predict([words[i] for i in ids], np.stack([x[i] for i in ids]))))), sizes


@pytest.mark.parametrize("exchanged", [15, 400])
def test_exchange_equals_a_plain_loop(spark, exchanged):
    """A small number leaves some confident documents for the next round, a large one hands over all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = cotraining.labels_of(spark.read.parquet(f"{SF}/labels.parquet"))
    rows = cotraining.featurize(docs, {}).collect()
    features = {r.doc_id: (np.frombuffer(r.words, "<i4"), np.frombuffer(r.meta, np.float32).astype(float)) for r in rows}
    assert len(features) == len(rows) and max(len(f[0]) for f in features.values()) <= cotraining.WIDEST
    truth = {r.doc_id: int(r.good) for r in labels.collect() if r.good is not None and r.doc_id in features}
    want, sizes = plain_loop(features, truth, 2, exchanged)
    assert sum(sizes) > 0
    got = cotraining.classify(docs, labels, rounds=2, exchanged=exchanged).collect()
    assert len(got) == len(want)
    assert max(abs(a - b) for r in got for a, b in zip((r.content_score, r.metadata_score, r.score), want[r.doc_id])) < 1e-6
    assert all(r.kept == (r.score >= cotraining.THRESHOLD) for r in got)


def made(rng: random.Random) -> tuple[list, list]:
    """400 rows, the good ones prose of one vocabulary and the bad ones of another with symbols; labels of 200; odd rows."""
    prose, junk = ([f"{c}{k}" for k in range(60)] for c in ("gut", "zap"))
    rows, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        text = "\n".join(" ".join(rng.choices(prose if good else junk, k=12)) + ("." if good else " ###!!!") for _ in range(rng.randint(2, 6)))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        if i < 200:
            labels.append((i, good))
    good, bad = rows[1][1], rows[4][1]
    odd = [(None, good, "en", None, None), (None, bad, None, "s0", None), (1, good, "en", "s1", rows[1][4]), (1, bad, "en", "s1", len(bad)), (900, None, None, None, None), (901, "", "", "", 0), (902, " \n\t", "de", "s1", 3), (903, "gut1 " * 40_000, "en", "s1", 200_000)]
    labels += [(None, True), (250, None), (3, True), (999_999, False), (901, False)]
    return rows + odd + odd[:2], labels


def test_a_fitted_model_scores_every_row(spark):
    rows, labels = made(random.Random(4))
    docs = spark.createDataFrame([(*r, 7, "x", 1, 1) for r in rows], SCHEMA).repartition(5)
    truth = spark.createDataFrame(labels, "doc_id long, good boolean")
    got = cotraining.classify(docs, truth).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows) and all(0 <= r.score <= 1 for r in got)
    # rows of one id are scored by their own texts, repeated rows alike
    assert sorted(r.kept for r in got if r.doc_id == 1) == [False, True, True]
    assert Counter(round(r.score, 9) for r in got if r.doc_id is None).most_common()[-1][1] == 2
    fresh = [r for r in got if r.doc_id is not None and 200 <= r.doc_id < 400]
    assert sum(r.kept == (r.doc_id % 4 > 0) for r in fresh) >= 0.98 * len(fresh)
    kept = cotraining.keep_good(docs, truth)
    assert kept.schema == docs.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    again = cotraining.classify(docs.repartition(2), truth).collect()
    assert sorted((r.doc_id or -1, round(r.score, 6)) for r in again) == sorted((r.doc_id or -1, round(r.score, 6)) for r in got)


def test_a_fitted_stage_and_no_rows(spark, tmp_path):
    rows, labels = made(random.Random(9))
    docs = spark.createDataFrame([(*r, 7, "x", 1, 1) for r in rows], SCHEMA)
    spark.createDataFrame([(i, None if g is None else int(g), None if i == 5 else 0) for i, g in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)["quality classifier"]
    kept = stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    good = [r for r in kept.collect() if r.doc_id is not None and r.doc_id < 400]
    assert sum(r.doc_id % 4 > 0 for r in good) >= 0.98 * len(good) and len(good) >= 290
    assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_fitting_needs_little_beside_its_features(monkeypatch):
    """16 MB of features, odd rows among them: a fit takes 64 MB at most, and parts of any size give the same."""
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 30_000, n) ** 2 % cotraining.FEATURES).astype("<i4") for n in [0, 1, 0, *[2200] * 2000, 0]]
    y = (np.arange(len(rows)) % 3 > 0).astype(float)
    tracemalloc.start()
    try:
        whole = cotraining.Content(rows, y, steps=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(map(len, rows)) > 4_000_000 and peak < 64 << 20
    monkeypatch.setattr(cotraining, "FITTED_AT_ONCE", 1000)
    some = rows[:40] + rows[-1:]
    parts = cotraining.Content(some, y[:41], steps=5)
    monkeypatch.setattr(cotraining, "FITTED_AT_ONCE", 1 << 30)
    assert np.abs(parts.score(rows) - cotraining.Content(some, y[:41], steps=5).score(rows)).max() < 1e-6
    assert np.abs(whole.score(rows)).max() > 0
