"""A quality classifier by co-training two views of a document.

The content view holds the words of the text (a hashed bag of words and of their first letters, naive-Bayes
weighted logistic regression); the metadata view holds language, source, stated length and the layout of the
page (logistic regression).  Both start from labelled documents; over rounds, each scores all unlabelled ones
and hands the documents that it is surest of, with its label, to the other.  At the end both views are
calibrated on labelled documents kept back, and combined by a logistic regression of the calibrated scores.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, persist, slices

FEATURES = 1 << 20
#: At most so many labelled documents are fitted on, those with the lowest hashes of their ids, and of them
#: those with so many distinct words and word starts at most: 256 MB of features on the driver whatever the input.
LABELLED, WIDEST = 8_000, 8_192
#: Features that a step of fitting has in its arrays at once, beside those it is given.
FITTED_AT_ONCE = 1 << 18
#: Rounds of exchange, and how many documents of each class a view hands over in each.
ROUNDS, EXCHANGED = 2, 400
#: Share of the labelled documents that calibrates, and the least probability for a document to stay: a bad one
#: that stays does more harm than a good one that goes.
HELD_BACK, THRESHOLD = 0.25, 0.65
PREFIX = 4

ROWS = "doc_id long, words binary, meta binary"
META = 10 + 16 + 64
TABLES = [bytes(b for b in range(256) if b not in s) for s in (b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), b"!", b".,;:?\n")]


def word_features(words: list[bytes]) -> np.ndarray:
    """Sorted distinct feature numbers: words, and their first letters, each by a hash."""
    distinct = list(set(words))
    starts = list({b"\0" + w[:PREFIX].lower() for w in distinct})
    return np.unique(WORDS.of(distinct + starts) >> np.uint64(44)).astype("<i4")


def meta_features(text: bytes, words: list[bytes], lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Layout numbers (log counts, shares by kinds of characters), then one-hot hashes of language and source."""
    out = np.zeros(META, np.float32)
    size, n = max(len(text), 1), max(len(words), 1)
    kinds = [len(text.translate(None, t)) / size for t in TABLES]
    out[:10] = [np.log1p(max(n_chars or 0, 0)), np.log(n), len(text) / n, np.log1p(text.count(b"\n")), len(set(words)) / n, *np.log1p(50 * np.array(kinds))]
    # a column each that no language or source shares with null
    out[10 + (15 if lang is None else zlib.crc32(lang.encode()) % 15)] = 1
    out[26 + (63 if source is None else zlib.crc32(source.encode()) % 63)] = 1
    return out


def text_of(value: str | None) -> bytes:
    return value.encode() if value else b""


def featurize(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """doc_id, words, meta of every row."""

    def run(batches):
        for batch in slices(batches):
            ids, words, meta = [], [], []
            for i, t, lang, source, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang", "source", "n_chars"))):
                data = text_of(t)
                split = data.split()
                ids.append(i)
                words.append(word_features(split).tobytes())
                meta.append(meta_features(data, split, lang, source, n).tobytes())
                if len(ids) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.binary()), pa.array(meta, pa.binary())], names=["doc_id", "words", "meta"])
                    ids, words, meta = [], [], []
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.binary()), pa.array(meta, pa.binary())], names=["doc_id", "words", "meta"])

    return narrow(docs, columns).mapInArrow(run, ROWS)


def narrow(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    types = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*[F.col(columns.get(c, c)).cast(t).alias(c) for c, t in types.items()])


class Content:
    """Naive-Bayes weighted logistic regression over word features seen in three documents or more."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, steps: int = 60, rate: float = 0.05, penalty: float = 1e-3):
        sizes = np.array([len(r) for r in rows], np.int64)
        place, df = np.zeros(FEATURES, np.int32), np.zeros(FEATURES, np.int32)
        parts = self.parts(sizes)
        for a, b in parts:
            df += np.bincount(np.concatenate(rows[a:b]), minlength=FEATURES).astype(np.int32)
        used = np.flatnonzero(df >= 3)
        # 0 stands for all other features, whose weight stays 0
        place[used] = np.arange(1, len(used) + 1, dtype=np.int32)

        def columns(a: int, b: int) -> np.ndarray:
            return place[np.concatenate(rows[a:b])]

        def summed(each: np.ndarray) -> np.ndarray:
            """For every used feature the sum of ``each`` over the documents that have it."""
            out = np.zeros(len(used) + 1)
            for a, b in parts:
                out += np.bincount(columns(a, b), weights=np.repeat(each[a:b], sizes[a:b]), minlength=len(out))
            return out[1:]

        good, bad = summed(y) + 1, summed(1 - y) + 1
        ratio = np.log(good / (y.sum() + 2)) - np.log(bad / ((1 - y).sum() + 2))
        weight, bias = np.zeros(len(used)), 0.0
        m, s = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
        # both classes weigh the same
        each = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        for step in range(1, steps + 1):
            value, total, slope = np.append(0.0, ratio * weight), 0.0, np.zeros(len(used) + 1)
            for a, b in parts:
                col, owner = columns(a, b), np.repeat(np.arange(b - a), sizes[a:b])
                z = np.bincount(owner, weights=value[col], minlength=b - a) + bias
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[a:b]) * each[a:b]
                slope += np.bincount(col, weights=error[owner], minlength=len(slope))
                total += error.sum()
            grad = np.append(ratio * slope[1:] + penalty * weight, total)
            m = 0.9 * m + 0.1 * grad
            s = 0.99 * s + 0.01 * grad**2
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
            weight -= move[:-1]
            bias -= move[-1]
        self.weights = np.zeros(FEATURES, np.float32)
        self.weights[used] = weight * ratio
        self.bias = bias

    @staticmethod
    def parts(sizes: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of documents, of ``FITTED_AT_ONCE`` features at most or of one document."""
        out, at, n = [], 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > at and n + size > FITTED_AT_ONCE:
                out.append((at, i))
                at, n = i, 0
            n += size
        return out + [(at, len(sizes))] if len(sizes) else out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum(dtype=np.float64) for r in rows]) + self.bias


class Metadata:
    """Logistic regression by Newton steps on standardised numbers and their squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 12):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.weights = newton(self.expand(x), y, penalty, steps)

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.ones((len(z), 1)), z, z[:, :10] ** 2], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights


def newton(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression; both classes weigh the same."""
    w = np.zeros(x.shape[1])
    each = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (each * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty * np.eye(x.shape[1])
        w -= np.linalg.solve(h, x.T @ ((p - y) * each) + penalty * w)
    return w


class Model:
    """Both views, their calibrations and the combination; small enough to send to every task."""

    def __init__(self, content: Content, meta: Metadata, words: list[np.ndarray], x: np.ndarray, y: np.ndarray):
        self.content, self.meta = content, meta
        a, b = content.score(words), meta.score(x)
        self.platt = [newton(np.stack([np.ones(len(y)), s], 1), y, 1e-3) for s in (a, b)]
        self.mix = newton(np.stack([np.ones(len(y)), *self.calibrated(a, b)], 1), y, 1e-3)
        # fits weigh both classes the same; probabilities are for the classes as often as they are labelled
        self.prior = np.log(y.sum() / (1 - y).sum())

    def calibrated(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        return [np.clip(p[0] + p[1] * s, -12, 12) for p, s in zip(self.platt, (a, b))]

    def predict(self, words: list[np.ndarray], x: np.ndarray, even: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality by content, by metadata and by both; ``even``: if both classes were as frequent."""
        u, v = self.calibrated(self.content.score(words), self.meta.score(x))
        z = self.mix[0] + self.mix[1] * u + self.mix[2] * v
        return tuple(1 / (1 + np.exp(-np.clip(s + (0 if even else self.prior), -30, 30))) for s in (u, v, z))


def _matrix(meta: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(meta), np.float32).reshape(len(meta), META).astype(np.float64)


def _words(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The features of every row, in the column's own memory."""
    return [np.frombuffer(v.as_buffer(), "<i4") for v in column]


def _scored(rows: DataFrame, sent, even: bool = False) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                if part.num_rows:
                    got = sent.value.predict(_words(part.column("words")), _matrix(part.column("meta").to_pylist()), even)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(g, pa.float64()) for g in got]], names=["doc_id", "content_score", "metadata_score", "score"])

    return rows.mapInArrow(run, "doc_id long, content_score double, metadata_score double, score double")


def _chosen(rows: DataFrame, labels: DataFrame) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """Ids in an order of their own, features and labels of the documents in ``labels`` (bounded); an id on several
    rows counts once, with the same one of them however rows are split."""
    met = rows.filter(F.octet_length("words") <= 4 * WIDEST).join(F.broadcast(labels), "doc_id")
    one = met.groupBy("doc_id").agg(F.min("good").alias("good"), F.min_by(F.struct("words", "meta"), F.xxhash64("words", "meta")).alias("f"))
    found = one.select("doc_id", "good", "f.words", "f.meta").toArrow()
    ids, words = found.column("doc_id").to_pylist(), _words(found.column("words"))
    order = np.argsort([zlib.crc32(b"%d" % i) for i in ids], kind="stable")
    x, y = _matrix(found.column("meta").to_pylist()), np.array(found.column("good").to_pylist(), np.float64)
    return [ids[k] for k in order], [words[k] for k in order], x[order], y[order]


def fit(rows: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, exchanged: int = EXCHANGED) -> Model | None:
    """The co-trained model from feature ``rows`` and ``labels`` (doc_id, good), or None if a class is missing.

    Labels with nulls are left out; a document with contradicting labels counts as bad.
    """
    spark = rows.sparkSession
    truth = labels.filter("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min(F.col("good").cast("int")).alias("good"))
    some = truth.join(rows.select("doc_id").distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    some = persist(some, "labelled")
    ids, words, x, y = _chosen(rows, some)  # at most `labelled` documents
    back = int(len(ids) * HELD_BACK)
    if min(y[:back].sum(), (1 - y[:back]).sum(), y[back:].sum(), (1 - y[back:]).sum()) < 1:
        return None
    sets = {v: (words[back:], x[back:], y[back:]) for v in ("content", "meta")}

    def trained() -> Model:
        return Model(Content(sets["content"][0], sets["content"][2]), Metadata(sets["meta"][1], sets["meta"][2]), words[:back], x[:back], y[:back])

    model = trained()
    given: set[tuple[str, int]] = set()
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        # all documents are scored and labelled ones left out then, so that features stay where they are
        scores = persist(_scored(rows.filter("doc_id is not null"), sent, True).join(truth, "doc_id", "left_anti"), "scores")
        for by, to in (("content_score", "meta"), ("metadata_score", "content")):
            # the surest of all unlabelled documents, both ways, beyond what was handed over before
            sure = []
            for good, how in ((1, F.desc(by)), (0, F.asc(by))):
                confident = scores.filter(F.col(by) >= 0.9) if good else scores.filter(F.col(by) <= 0.1)
                sure += [(r.doc_id, good) for r in confident.orderBy(how, F.xxhash64("doc_id")).limit(2 * exchanged * rounds).collect() if (to, r.doc_id) not in given][:exchanged]
            given |= {(to, i) for i, _ in sure}
            if not sure:
                continue
            label = spark.createDataFrame(sure, "doc_id long, good int")
            _, new_words, new_x, new_y = _chosen(rows, label)
            w, m, t = sets[to]
            sets[to] = (w + new_words, np.concatenate([m, new_x]), np.append(t, new_y))
        model = trained()
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, columns: dict[str, str] | None = None, **settings) -> DataFrame:
    """One row per row of ``docs``: doc_id, content_score, metadata_score, score (calibrated, of good quality), kept.

    ``labels`` has doc_id and good (boolean).  Null and empty texts, ids, languages and sources are scored
    like any other; repeated rows get equal scores.  Where labels are missing or of one class only, scores
    are null and every document is kept.  An empty table gives no rows.
    """
    rows = persist(featurize(docs, columns or {}), "features")
    model = fit(rows, labels, **settings)
    if model is None:
        nothing = F.lit(None).cast("double")
        return rows.select("doc_id", nothing.alias("content_score"), nothing.alias("metadata_score"), nothing.alias("score"), F.lit(True).alias("kept"))
    scored = _scored(rows, docs.sparkSession.sparkContext.broadcast(model))
    return scored.withColumn("kept", F.col("score") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, columns: dict[str, str] | None = None, **settings) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns; no join brings them back."""
    named = {c: (columns or {}).get(c, c) for c in ("text", "lang", "source", "n_chars")}
    model = fit(persist(featurize(docs, columns or {}), "features"), labels, **settings)
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            words, meta = [], []
            for t, lang, source, n in zip(*(batch.column(named[c]).to_pylist() for c in ("text", "lang", "source", "n_chars"))):
                data = text_of(t)
                split = data.split()
                words.append(word_features(split))
                meta.append(meta_features(data, split, lang, source, n))
            if words:
                yield batch.filter(pa.array(sent.value.predict(words, np.stack(meta).astype(np.float64))[2] >= threshold))

    return docs.mapInArrow(run, docs.schema)


def labels_of(table: DataFrame) -> DataFrame:
    """doc_id, good: quality 1 and not toxic; null where quality is unknown."""
    return table.select(F.col("doc_id").cast("long").alias("doc_id"), ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("good"))
