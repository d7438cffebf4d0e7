"""The corpus operators against brute force, and with nulls, empty and repeated rows, empty tables, clashing columns."""

import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tracelens.llm import chunks, cotraining, lines, mixing, neighbours, outliers, packing, pitman_yor, queries, sharding, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, size string, score int"
ODD = [
    (1, None, None, None, None, 1, "a", 1), (2, "", "en", "s", 0, 1, "a", 1), (3, " \n\t\n", "en", None, 3, 1, "a", 1),
    (4, "one two three", "en", "s", 13, 1, "a", 1), (4, "one two three", "en", "s", 13, 1, "a", 1), (None, "no id here", None, "s", 10, 1, "a", 1),
    (5, "word " * 30_000, "en", "t", 150_000, 1, "a", 1), (6, "é$ ü# \x0b ok\nok\nok", "de", "t", 17, 1, "a", 1), (7, "one two three", "en", "t", 13, 1, "a", 1),
]
RUNS = {
    "op1": lambda d: outliers.robust_outliers(d), "op2": lambda d: cotraining.classify(d, d.sparkSession.createDataFrame([], "doc_id long, good boolean")),
    "op3": lambda d: packing.pack(d, queries.tokenizer()), "op4": lambda d: pitman_yor.score(d), "op6": lambda d: simhash.near_duplicates(d),
    "op7": lambda d: chunks.repeated_spans(d), "op8": lambda d: mixing.plan(d), "op9": lambda d: sharding.shard(d), "op10": lambda d: lines.duplicate_lines(d),
}
PER_ROW = ("op1", "op2", "op4", "op6", "op8", "op9")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_and_empty_tables(spark, odd, name):
    rows = RUNS[name](odd).collect()
    if name in PER_ROW:
        assert len(rows) == len(ODD)
    assert RUNS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_statistics_by_hand(spark):
    rep = "a b c d e f g h"
    rows = [(1, f"{rep} x {rep}\nL l\nL l\n\n", "en", "s"), (2, "a " * 9, "en", "s"), (3, "$# | <x>", "en", "s")]
    got = {r.doc_id: r for r in outliers.statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].n_dup_lines) == (21, 16, 1)
    assert (got[2].n_words, got[2].n_repeat_words) == (9, 9)
    assert (got[3].n_symbols, got[3].word_chars) == (5, 6)


def brute_mcd(x, coverage, factor, floors, rng):
    """Means and covariances of the closest share of rows: the least determinant over many random starts, run to the end."""
    n, p = x.shape
    h = int(np.ceil(n * coverage))
    best = (np.inf, None)
    for start in range(60):
        if start:
            some = x[rng.permutation(n)[: p + 1]]
            m, c = some.mean(0), np.cov(some.T, bias=True).reshape(p, p) + np.diag(floors**2)
        else:
            m, c = np.median(x, 0), np.diag(((np.quantile(x, 0.75, 0) - np.quantile(x, 0.25, 0)) / 1.349) ** 2 + floors**2)
        last = np.inf
        while True:
            d = ((x - m) @ np.linalg.inv(c) * (x - m)).sum(1)
            near = x[d <= np.sort(d)[h - 1] + 1e-12]
            m, raw = near.mean(0), np.cov(near.T, bias=True).reshape(p, p)
            c = raw * factor + np.diag(floors**2)
            det = np.linalg.slogdet(c)[1]
            if last - det < 1e-9:
                break
            last = det
        if det < best[0] - 1e-9:
            best = (det, (len(near), m, raw))
    return best[1]


def test_verdicts_against_brute_force_mcd(spark):
    """Whole operator on real statistics: every level's estimate, what is drawn towards what, and the verdicts."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in outliers.robust_outliers(table).collect()}
    stats = [r for r in outliers.statistics(table).collect() if not got[r.doc_id].base_failed]
    floors = np.array(list(outliers.VECTOR.values()))
    factor = outliers.consistency(outliers.COVERAGE, len(floors))
    x = np.array([[r[n] for n in outliers.VECTOR] for r in stats])
    lang, source = np.array([str(r.lang) for r in stats]), np.array([str(r.source) for r in stats])
    rng, w = np.random.default_rng(0), outliers.PRIOR_ROWS
    mixed = lambda own, prior: [(own[0] * a + w * b) / (own[0] + w) for a, b in zip(own[1:], prior)]
    everything = brute_mcd(x, outliers.COVERAGE, factor, floors, rng)[1:]
    same, close = 0, []
    for g in sorted(set(lang)):
        prior = mixed(brute_mcd(x[lang == g], outliers.COVERAGE, factor, floors, rng), everything)
        for k in sorted(set(source[lang == g])):
            at = np.flatnonzero((lang == g) & (source == k))
            m, c = mixed(brute_mcd(x[at], outliers.COVERAGE, factor, floors, rng), prior)
            d = ((x[at] - m) @ np.linalg.inv(c * factor + np.diag(floors**2)) * (x[at] - m)).sum(1)
            for i, own in zip(at, d):
                r = got[stats[i].doc_id]
                same += (own <= r.cut) == r.kept
                close.append(abs(r.distance - own) / (1 + own))
    assert same >= len(stats) - 2
    assert np.median(close) < 0.02 and np.quantile(close, 0.95) < 0.25


def test_planted_outliers_and_small_groups(spark):
    rng = np.random.default_rng(0)
    names = list(outliers.VECTOR)
    x = rng.normal(size=(400, 5)) @ np.diag([1, 2, 0.5, 1, 3])
    x[:60] += 30
    rows = [("g", i, *map(float, r)) for i, r in enumerate(x)] + [("alone", 1000, 1.0, 1.0, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, ", ".join(["g string, hash long", *[f"{n} double" for n in names]]))
    est = {r.g: r for r in outliers.estimates(frame, ["g"]).collect()}
    good = x[60:]
    assert np.allclose([est["g"][f"m_{i}"] for i in range(5)], good.mean(0), atol=0.15 * good.std(0).max())
    assert est["alone"].rows == 1 and est["g"].total == 400 and 300 <= est["g"].rows <= 310
    assert abs(outliers.chi_square_quantile(0.95, 5) - 11.0705) < 1e-3


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), cotraining.labels_of(spark.read.parquet(f"{sf}/labels.parquet"))
    fit, held = labels.filter("doc_id % 3 > 0"), labels.filter("doc_id % 3 = 0")
    got = cotraining.classify(table, fit).join(held, "doc_id").collect()
    assert sum(r.kept == r.good for r in got) / len(got) > 0.9
    assert sum(r.kept for r in got if r.good) / sum(r.good for r in got) > 0.9


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(queries.tokenizer())
    got = packing.pack(docs, queries.tokenizer()).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for r in docs.collect():
        ids = np.array([*tk.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, p in enumerate(sorted(by_doc[r.doc_id], key=lambda p: p.piece)):
            assert (p.piece, p.start) == (k, at) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(by_seq) <= 1.05 * sum(r.length for r in got) / packing.CAPACITY + 1


def test_words_are_encoded_once_in_any_dress(monkeypatch):
    """Whatever stands around a word and however it is spelled, the merge model sees it once; ids are the tokenizer's."""
    import tokenizers

    path, made = queries.tokenizer(), []
    whole = tokenizers.Tokenizer.from_file(path)

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            found = getattr(self.inner, name)
            if name == "model":
                return Counting(found)
            return (lambda *a, **k: made.append(a[0]) or found(*a, **k)) if name in ("encode", "tokenize") else found

    class Loader:
        from_file = staticmethod(lambda path: Counting(whole))

    monkeypatch.setattr(tokenizers, "Tokenizer", Loader)
    encode = packing.encoder.__wrapped__(path)
    ids = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    made.clear()
    text = " ".join(f"{w}{end}" for k in range(50) for w in (f"wort{'abcdefghij'[k // 10]}{'klmnopqrst'[k % 10]}", f"Wort{'abcdefghij'[k // 10]}{'klmnopqrst'[k % 10]}") for end in ("", ",", ".", "!", "###", "***"))
    assert encode(text) == ids(text) and len(made) <= 55
    # words in use stay when the others are let go
    monkeypatch.setattr(packing, "KEPT_WORDS", 100)
    rare = [f"zz{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    made.clear()
    text = " ".join(f"often {w}" for w in rare)
    assert encode(text) == ids(text) and made.count("often") == 1
    rng = random.Random(8)
    signs = [*map(chr, range(256)), *"abcdefghijklmnop'sStTmMdDrRvVlLeE0123456789 .,;!?\n\t " * 4]
    odd = [*signs, *["\u0300", "\u030c", "\u0307", "J", "\u0130", "\u1e9e", "\u2014", "\u4e2d", "\u00a0", "\u2028", "<|endoftext|>", "<|startoftext|>", "<|", "\u03a3", "\u212a"] * 8]
    for k in range(4000):
        text = "".join(rng.choices(odd if k % 2 else signs, k=rng.randint(0, 40)))
        assert encode(text) == ids(text), text


def test_packing_is_the_same_for_any_split(spark, docs):
    some = docs.limit(60).unionByName(docs.filter("doc_id < 3")).unionByName(docs.filter("doc_id < 3"))
    key = lambda r: tuple(r)
    one, many = (Counter(map(key, packing.pack(some.repartition(n), queries.tokenizer()).filter("length < 2048").collect())) for n in (1, 5))
    assert one == many


def test_sum_of_squares_step():
    """Each placement has the least sum of squares of all that are possible."""
    rng, cap = random.Random(1), 20
    sizes = np.array([rng.randint(1, 20) for _ in range(200)])
    sequence, _ = packing.place(sizes, cap)
    free: dict[int, int] = {}
    for s, q in zip(sizes.tolist(), sequence.tolist()):
        def cost(gaps):
            return sum(n * n for g, n in Counter(gaps).items() if g)

        options = [cost([*free.values(), cap - s])] + [cost([g - s if k == j else g for j, g in free.items()]) for k, g in free.items() if g >= s]
        free[q] = free.get(q, cap) - s
        assert cost(free.values()) == min(options)


def test_language_model(spark, docs):
    got = pitman_yor.score(docs).collect()
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in [*t, None])
    n, v = sum(counts.values()), len(counts)
    for r in got:
        tokens = [*texts[r.doc_id], None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert abs(r.base_score - sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)) < 1e-6
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def exact_tables(customers, fresh, discount):
    """Mean and deviation of the number of tables, by adding customers one at a time to all its values."""
    w = np.zeros(customers + 2)
    w[1] = 1.0
    t = np.arange(customers + 2)
    for i in range(1, customers):
        w = w * np.maximum(i - discount * t, 0) + np.append(0, w[:-1]) * fresh
        w /= w.sum()
    mean = (w * t).sum()
    return mean, np.sqrt((w * t * t).sum() - mean**2)


@pytest.mark.parametrize("customers", [2, 16, 17, 40, 200, 256, 257, 2000])
def test_seating_against_enumeration(customers):
    rng, n = np.random.default_rng(customers), 4000
    for discount in pitman_yor.DISCOUNTS:
        for fresh in (0.01, 0.3, 5.0, 40.0):
            drawn = pitman_yor.seat(np.full(n, customers), np.full(n, fresh), discount, rng)
            mean, deviation = exact_tables(customers, fresh, discount)
            assert drawn.min() >= 1 and drawn.max() <= customers
            assert abs(drawn.mean() - mean) < 5 * deviation / np.sqrt(n) + 0.005 * mean + 1e-9
            assert abs(drawn.std() - deviation) < 0.1 * deviation + 0.02
    assert pitman_yor.seat(np.array([0, 1]), np.array([0.5, 0.5]), 0.7, rng).tolist() == [0, 1]


def test_predictions_of_a_context_sum_to_one():
    """Two contexts with all words each, seen or not, and one unknown word, after some rounds of sampling."""
    rng = np.random.default_rng(3)
    words, contexts = np.sort(rng.integers(0, 1 << 48, 50).astype(np.uint64)), np.sort(rng.integers(0, 1 << 48, 2).astype(np.uint64))
    counts = rng.poisson(3, (2, 50)) * (rng.random((2, 50)) < 0.7)
    counts[:, :5] = 0
    counts[0, 10] = 900
    blank = {"doc_ids": None, "lengths": None, "index": None}
    block = {"block": 1, "bucket": 0, **blank, "contexts": pitman_yor.slim(contexts, 6), "runs": pitman_yor.slim(np.array([50, 50])), "words": pitman_yor.slim(np.tile(words, 2), 6), "counts": pitman_yor.slim(counts.ravel())}
    static = pitman_yor.gather((pa.scalar(0),), pa.Table.from_pylist([block]))
    asks = pa.Table.from_batches(list(pitman_yor.first_asks(1)(static.to_batches())))
    totals = None
    for turn in range(3):
        replies = pitman_yor.seat_root(totals, 1, turn)((pa.scalar(0),), asks).to_pylist()
        totals = next(r["totals"] for r in replies if r["bucket"] < 0)
        told = [{k: v for k, v in r.items() if k != "totals"} for r in replies if r["bucket"] >= 0]
        if turn:
            told += [r for r in made.to_pylist() if r["part"] < 0]
        told = pa.Table.from_pylist(told, pitman_yor.EMPTY.schema)
        own = pitman_yor.Bucket(static, told, pitman_yor.Root(totals))
        assert totals[3] == counts.sum() and totals[2] == (counts.sum(0) > 0).sum()
        p = own.predict().reshape(2, 50)
        seen = counts.sum(0) > 0
        # all words never seen are one word to the model
        assert np.allclose(p[:, seen].sum(1) + p[:, ~seen][:, 0], 1) and (own.tables <= own.counts).all()
        made = pitman_yor.seat_contexts(totals, 1, turn, 1)(static, told)
        asks = made.filter(pa.array([x >= 0 for x in made.column("part").to_pylist()]))


def test_neighbours_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    bad = spark.createDataFrame([(10_000, None, 0), (10_100, [0.0] * 64, 0), (10_200, [float("nan")] * 64, 0)], "vec_id long, embedding array<float>, label int")
    copies = rows.filter("vec_id < 30").withColumn("vec_id", F.lit(7).cast("long") + 20_000 + F.col("vec_id"))
    table = rows.unionByName(bad).unionByName(copies)
    got = neighbours.search(table, F.col("vec_id") % 100 == 0).collect()
    own = {r.vec_id: np.array(r.embedding, float) for r in rows.unionByName(copies).collect()}
    ids = np.array(sorted(own))
    x = np.stack([own[i] for i in ids])
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - own[q]) ** 2).sum(1))
        best = [i for i in ids[np.lexsort((ids, d))].tolist() if i != q][:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((own[i] - own[q]) ** 2).sum())) < 1e-12 for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & set(best))
        total += 10
    assert hits / total >= 0.9


def test_recall_on_the_larger_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = defaultdict(list)
    for r in neighbours.search(rows, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append(r.vec_id)
    own = {r.vec_id: np.array(r.embedding, float) for r in rows.collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding) and any(r.embedding)}
    ids = np.array(sorted(own))
    x = np.stack([own[i] for i in ids])
    hits = 0
    for q in got:
        d = np.sqrt(((x - own[q]) ** 2).sum(1))
        hits += len({i for i in ids[np.lexsort((ids, d))].tolist() if i != q} & set(got[q]) & set([i for i in ids[np.lexsort((ids, d))].tolist() if i != q][:10]))
    assert set(got) == {i for i in own if i % 50 == 0} and hits / (10 * len(got)) >= 0.9


def test_footrule_and_recall_of_a_full_block():
    """A block at full size of random vectors, which are harder than any with clusters, in the production settings."""
    n, k = neighbours.BLOCK, 10
    x = np.random.default_rng(4).normal(size=(n, 64))
    pivots = neighbours.pick_pivots(x[-4 * neighbours.PIVOTS :], neighbours.PIVOTS)
    length = neighbours.PREFIX
    perms = neighbours.nearest_pivots(x, pivots, length)
    place = np.full((n, len(pivots)), length)
    np.put_along_axis(place, perms, np.arange(length)[None], 1)
    queries = np.arange(60)
    files = []
    for p in range(len(pivots)):
        q, v = np.flatnonzero(place[queries, p] < length), np.flatnonzero(place[:, p] < length)
        files.append((q, place[q, p], v, place[v, p]))
    ranks = neighbours.footrule(len(queries), n, length, files)
    assert (ranks[:5] == np.abs(place[None, :] - place[:5, None]).sum(2)).all()
    most = int(np.ceil(n * neighbours.SHARE)) + neighbours.LEAST * (k + 1)
    hits = 0
    for q in queries:
        d = ((x - x[q]) ** 2).sum(1)
        hits += len(set(np.argpartition(ranks[q], most)[:most].tolist()) & set(np.argsort(d)[1 : k + 1].tolist()))
    assert hits / (k * len(queries)) >= 0.9


def test_neighbours_of_few_vectors_ties_and_none(spark):
    schema = "vec_id long, embedding array<double>, v string, ids string"
    rows = [(i, [float(i % 4), 1.0], "x", "y") for i in range(12)] + [(None, [1.0, 1.0], "x", "y"), (100, None, "x", "y"), (200, [], "x", "y")]
    got = neighbours.search(spark.createDataFrame(rows, schema), F.col("vec_id") % 4 == 0).collect()
    x = {i: i % 4 for i in range(12)}
    for q in (0, 4, 8):
        want = sorted((abs(x[i] - x[q]), i) for i in x if i != q)[:10]
        assert [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want
    assert neighbours.search(spark.createDataFrame([], schema), F.col("vec_id") % 4 == 0).collect() == []


def simple_fingerprint(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closed(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_components(spark, docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {r.doc_id: simple_fingerprint(r.text) for r in docs.collect()}
    assert all(got[i].fingerprint == f"{f:016x}" for i, f in fps.items())
    ids = sorted(fps)
    want = closed(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert {i: r.component_id for i, r in got.items()} == want


def simple_shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_copies_of_the_pipeline(spark, docs):
    """Against all pairs, with edited copies, nulls, repeated rows and one id on different texts."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=rng.randint(3, 8)))
    made = [(r.doc_id, r.text) for r in docs.collect()]
    for i in range(40):
        base = [word() for _ in range(rng.choice([8, 60, 300]))]
        for j in range(4):
            w = list(base)
            for at in rng.sample(range(len(w)), j * len(w) // 100 + (j == 1)):
                w[at] = word()
            made.append((10_000 + 10 * i + j, " ".join(w)))
    made += [(None, made[-1][1]), (None, "a text of its own without any id"), (10_000, "same id, other text than before"), *made[-3:], (None, None), (20_000, "")]
    schema = "doc_id long, text string"
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(made, schema), SF).select("doc_id", "text").collect())
    rows = sorted(made, key=lambda r: (r[0] is None, r[0] or 0))
    sets_ = [simple_shingles(t) for _, t in rows]
    near = lambda a, b: a == b or 10 * len(a & b) >= 8 * len(a | b)
    root = closed(range(len(rows)), [(x, y) for x, a in enumerate(sets_) for y, b in enumerate(sets_[:x]) if near(a, b)])
    assert got == Counter(rows[i] for i, r in root.items() if i == r)
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame([], schema), SF).collect() == []


def test_links_of_a_dense_group(monkeypatch):
    rng = random.Random(3)
    fps = sorted({rng.getrandbits(64) for _ in range(20)} | {sum(1 << b for b in rng.sample(range(14), rng.randint(0, 14))) for _ in range(300)})
    monkeypatch.setattr(simhash, "GROUP", 16)
    out = []
    simhash.union_stars(np.array(fps, np.uint64), 2, np.arange(64), out)
    assert all(a in set(fps) and b in set(fps) for a, b in out)
    want = closed(fps, [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 2])
    assert closed(fps, out) == want


def test_thresholds_add_up():
    rng = np.random.default_rng(0)
    parts = simhash.allocate(rng.integers(0, 50, (8, 256)).astype(float), 2, 10_000)
    skipped = {m: m - len(parts) for m in (2, 3)}
    assert any(sum(t for _, t in parts) - skipped[m] == 2 - m + 1 for m in skipped if skipped[m] >= 0)


def test_chunks_survive_insertion():
    rng = random.Random(0)
    text = b" ".join(bytes(rng.choices(b"abcdefgh", k=rng.randint(2, 9))) for _ in range(2000))
    split = lambda t: [t[a:b] for a, b in zip([0, *chunks.cuts(t).tolist()], chunks.cuts(t).tolist())]
    assert b"".join(split(text)) == text
    moved = split(b"xyz " + text[:5000] + b"inserted words " + text[5000:])
    assert len(set(split(text)) & set(moved)) > 0.97 * len(set(split(text)))


def test_planted_passage_is_found(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=rng.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    rows = [(i, f"{text(100)} {passage} {text(100)}" if i % 3 == 0 else text(200)) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    spans = chunks.repeated_spans(frame)
    got = spans.collect()
    assert {r.doc_id for r in got} == {i for i in range(30) if i % 3 == 0} - {0} and all(r.first_doc_id % 3 == 0 and r.first_doc_id < r.doc_id for r in got)
    cut = {r.doc_id: r.text for r in chunks.remove_spans(frame, spans).collect()}
    data = dict(rows)
    for r in got:
        raw = data[r.doc_id].encode()
        assert raw[r.start : r.end].decode().strip() in passage
        assert cut[r.doc_id].encode() == raw[: r.start] + raw[r.end :]


def brute_spans(rows, least):
    """(row, start, end) of runs of chunks that occurred before; rows are in order."""
    seen, out = set(), []
    for number, text in enumerate(rows):
        data, at, run = (text or "").encode(), 0, None
        for end in [*chunks.cuts(data).tolist(), None]:
            part = None if end is None else data[at:end].strip()
            if part == b"":
                at = end
                continue
            if part is not None and part in seen:
                run = (run[0] if run else at, end, (run[2] if run else 0) + len(part.split()))
            else:
                if run and run[2] >= least:
                    out.append((number, run[0], run[1], run[2]))
                run = None
                seen.add(part)
            at = end
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_spans_against_brute_force(spark, docs, parts):
    """Null and repeated ids with equal and other texts, for any split of the rows."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=rng.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    made = [(r.doc_id, r.text) for r in docs.filter("doc_id < 80").collect()]
    shared = text(90)
    made += [(None, shared), (None, shared), (None, text(40) + "\n\n" + shared), (500, shared), (500, text(30)), (500, text(30)), (501, None), (502, "")]
    made.sort(key=lambda r: -1 if r[0] is None else r[0])
    frame = spark.createDataFrame([(i, d, t, "c") for i, (d, t) in enumerate(made)], "row_number long, doc_id long, text string, chunk string").repartition(parts)
    spans = chunks.repeated_spans(frame, row_col="row_number")
    got = spans.collect()
    assert sorted((r.row, r.start, r.end, r.n_words) for r in got) == brute_spans([t for _, t in made], chunks.MIN_WORDS)
    without = chunks.repeated_spans(frame).collect()
    assert sum(r.n_words for r in without) == sum(r.n_words for r in got)
    cut = {r.row_number: r.text for r in chunks.remove_spans(frame.withColumn("_spans", F.lit(1)).withColumn("_own", F.lit(1)), spans, row_col="row_number").collect()}
    for number, (_, whole) in enumerate(made):
        raw, at, kept = (whole or "").encode(), 0, b""
        for r in sorted((r for r in got if r.row == number), key=lambda r: r.start):
            kept, at = kept + raw[at : r.start], r.end
        assert (cut[number] or "").encode() == kept + raw[at:]


def test_passages_over_fifty_words_are_found():
    """Of passages of 51 words between foreign ones, at most 2 in 100 have too few words in whole chunks."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=rng.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    found = 0
    for _ in range(400):
        passage = text(51)
        found += any(r[0] == 1 for r in brute_spans([f"{text(20)} {passage} {text(20)}", f"{text(20)} {passage} {text(20)}"], chunks.MIN_WORDS))
    assert found >= 392


def test_mix_meets_targets_and_reruns_agree(spark, docs):
    got = mixing.plan(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(docs.repartition(7)).collect()))
    size, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken <= 2 * r.size and len(r.positions) * r.size == r.taken and all(0 <= p <= 1 for p in r.positions)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    assert all(abs(taken[s] - target[s]) <= largest[s] and target[s] <= 2 * size[s] + 1e-9 for s in target)
    assert mixing.order(docs, mixing.plan(docs)).count() == sum(r.copies for r in got)


CLASH = "doc_id long, text string, lang string, source string, n_chars long, _row int, _own int, _gone int, _position int, row int, hash int"


def test_pipeline_on_odd_rows(spark, tmp_path):
    """All stages: null and repeated ids with other texts, empty and null texts, copies, and columns of our own names."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=rng.randint(3, 8)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    line, copy = text(1), text(6)
    rows = [(None, text(3)), (None, text(3)), (5, text(4)), (5, text(4)), (6, copy), (7, copy), (8, line + "\n" + text(2)), (9, text(2) + "\n" + line), (10, None), (11, "")]
    made = spark.createDataFrame([(i, t, "en", "s", 1, 1, 1, 1, 1, 1, 1) for i, t in rows], CLASH)
    made.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = made, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = [r.asDict() for r in docs.collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == made.columns
            docs = spark.createDataFrame(docs.collect(), made.schema)
    of = lambda name: Counter((r["doc_id"], r["text"]) for r in seen[name])
    assert of("quality classifier") == Counter(rows)
    # the copy loses all its lines, the shared line goes from the later document, everything else stays
    cleaned = Counter(rows[:5] + [(7, ""), rows[6], (9, rows[7][1].rsplit("\n", 1)[0]), *rows[8:]])
    assert of("line dedup") == cleaned
    empty = {r for r in cleaned if not r[1]}
    assert set(of("near dedup")) == {r for r in cleaned if r[1]} | {(7, "")} and len(empty) == 3
    mixed = of("source mixing")
    assert set(mixed) <= set(of("near dedup")) and max(mixed.values()) <= 2 and sum(mixed.values()) > len([r for r in cleaned if r[1]])
    assert Counter(r["doc_id"] for r in seen["sequence packing"] if r["piece"] == 0) == Counter(i for i, _ in mixed.elements())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["sequence packing"])


SAME = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"{chr(97 + i % 26)}{i} " * (i % 5 + 1), "en", "s" if i % 2 else None) for i in range(60)]


def test_mixing_stage_keeps_null_and_repeated_ids(spark):
    """Each row comes out as often as the plan takes it: two rows of one id don't take each other's positions."""
    rows = SAME + SAME[:2] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = Counter(tuple(r) for r in corpus_pipeline.source_mixing(spark, docs, SF).collect())
    plan = mixing.plan(docs).collect()
    assert sum(got.values()) == sum(r.copies for r in plan)
    for key in {(r.doc_id, r.source, r.size) for r in plan}:
        want = sum(r.copies for r in plan if (r.doc_id, r.source, r.size) == key)
        assert sum(n for (i, t, _, s), n in got.items() if (i, s, len(t.split())) == key) == want
    assert all(n <= 2 * rows.count(r) for r, n in got.items())


def test_line_stage_tells_rows_of_one_id_apart(spark):
    schema = "doc_id long, text string, lang string, source string"
    rows = [
        (None, "a b c d\nfirst own line", "en", "s"), (None, "second own text\na b c d", "en", "s"), (5, "e f g h i\none more here", "en", "s"),
        (5, "quite another text\ne f g h i", "en", "s"), (5, "quite another text\ne f g h i", "en", "s"), (6, None, "en", "s"),
    ]
    got = Counter(r.text for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, schema), SF).collect())
    assert got == Counter(["a b c d\nfirst own line", "second own text", "e f g h i\none more here", "quite another text", "", None])
    assert corpus_pipeline.line_dedup(spark, spark.createDataFrame([], schema), SF).collect() == []


def test_schedule_inverts():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    for s in mixing.SCHEDULES:
        for want in (0.0, 0.2, 0.5, 0.9):
            at = spark.range(1).select(mixing.invert(s, F.lit(want))).first()[0]
            t = np.linspace(0, 1, 100_001)
            w = np.interp(t, [k for k, _ in s], [v for _, v in s])
            assert abs(w[t <= at].sum() / w.sum() - want) < 1e-3


def test_slots_and_rebalancing(spark, docs):
    got = sharding.shard(docs, 8).collect()
    load = Counter()
    numbers = defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        numbers[r.shard].append(r.slot)
    assert max(load.values()) - min(load.values()) <= max(r.size for r in got)
    assert all(sorted(n) == list(range(len(n))) for n in numbers.values())
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.size == len(texts[r.doc_id]) + 1 for r in got)
    sizes = {s: 10 + s % 7 for s in range(256)}
    one = sharding.first_map(sizes, 4, 256)
    two = sharding.edit_map(one, sizes, 5)
    before, after = ({s: k for _, s, k in m} for m in (one, two))
    assert {v for v, _, _ in two} == {2} and all(after[s] in (before[s], 4) for s in before)
    loads = Counter({k: sum(sizes[s] for s in after if after[s] == k) for k in range(5)})
    assert max(loads.values()) - min(loads.values()) <= 16
    assert {k for _, _, k in sharding.edit_map(two, sizes, 3)} == {0, 1, 2}


def test_stored_maps(spark, docs, tmp_path):
    folder = str(tmp_path / "maps")
    first = sharding.shard(docs, 4, 64)
    sizes = sharding.slot_sizes(sharding.slot_table(sharding.with_slots(docs, 64)))
    sharding.store_map(spark, sharding.first_map(sizes, 4, 64), folder)
    assert {(r.doc_id, r.vslot, r.shard) for r in first.collect()} == {(r.doc_id, r.vslot, r.shard) for r in sharding.shard(docs, 4, 64, folder).collect()}
    edited = sharding.rebalance(docs, folder, 5, 64)
    assert sharding.load_map(spark, folder) == edited and {v for v, _, _ in edited} == {2}
    before = {s: k for _, s, k in sharding.load_map(spark, folder, 1)}
    assert {s for _, s, k in edited if k == 4} and sum(k != before[s] for _, s, k in edited) < 30
    got = sharding.shard(docs, 5, 64, folder).collect()
    assert {r.map_version for r in got} == {2} and all(dict((s, k) for _, s, k in edited)[r.vslot] == r.shard for r in got)
    with pytest.raises(Exception, match="already exists"):
        sharding.store_map(spark, edited, folder)
    many = spark.createDataFrame([(None, f"text {i}") for i in range(300)], "doc_id long, text string")
    assert len({r.vslot for r in sharding.shard(many, 4, 64).collect()}) > 50


def test_removing_lines_keeps_what_an_id_does_not_tell_apart(spark):
    schema = "doc_id long, text string, _own int, _gone int"
    rows = [(1, "a b c d e", 1, 1), (2, "a b c d e", 1, 1), (2, "quite unique text", 1, 1), (3, "own words\na b c d e\n\nmore", 1, 1), (None, "a b c d e\nx y z", 1, 1), (None, "k l m n o", 1, 1), (4, None, 1, 1)]
    frame = spark.createDataFrame(rows, schema)
    got = Counter(tuple(r) for r in lines.remove_lines(frame, lines.duplicate_lines(frame)).collect())
    # the null ids come first, so the line in document 1 is a later one
    want = [(1, "", 1, 1), *rows[1:3], (3, "own words\n\nmore", 1, 1), *rows[4:]]
    assert got == Counter(want)


def line_sets(rows):
    out = [((d, k), frozenset(line.encode().split())) for d, t in rows for k, line in enumerate((t or "").split("\n"))]
    return sorted((x for x in out if x[1]), key=lambda x: x[0])


@pytest.mark.parametrize("tight", [False, True])
def test_lines_against_all_pairs(spark, docs, tight, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [rng.choices(vocabulary, k=rng.randint(4, 25)) for _ in range(6)]
    made = []
    for i in range(80):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        made.append((1000 + i, " ".join(w) + "\n\nthe end"))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + made
    if tight:
        monkeypatch.setattr(lines, "PROPOSALS", 1)
        monkeypatch.setattr(lines, "FIRST", 1)
        rows = made
    got = lines.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = line_sets(rows)
    near = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    want = {k for i, (k, a) in enumerate(sets) if any(near(a, b) for _, b in sets[:i])}
    found = got.collect()
    assert {(r.doc_id, r.line) for r in found} == want
    of = dict(sets)
    assert all((r.match_doc_id, r.match_line) < (r.doc_id, r.line) and near(of[r.doc_id, r.line], of[r.match_doc_id, r.match_line]) for r in found)


def line_bucket(lists, each):
    """A bucket in which each line fits all others of its word's list; in rows of 5,000."""
    rng, total = np.random.default_rng(1), lists * each
    columns = [np.repeat(np.arange(lists), each).astype("<u4"), rng.permutation(total).astype("<i8"), np.zeros(total, "<u2"), rng.integers(8, 60, total).astype("<u2"), np.zeros(total, "<u2")]
    columns += [rng.integers(0, 8, total).astype("<u8"), rng.integers(0, 1 << 32, total).astype("<u4"), np.ones(total, "u1"), np.zeros(total, "<u8")]
    rows = [[c[at : at + 5000].tobytes() for c in columns] for at in range(0, total, 5000)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], names=lines.FIELDS)


def proposed(batch, most):
    return [tuple(r.values()) for b in lines.pairs_of(0.8, most)((pa.scalar(0),), iter([batch])) for r in b.to_pylist()]


def test_found_partners_of_lines_are_sorted_out_meanwhile(monkeypatch):
    """The same proposals however few partners are held at once, and memory for these, not for all that were found."""
    small = line_bucket(3, 90)
    for most in (4, None):
        whole = proposed(small, most)
        assert len(whole) > 500
        monkeypatch.setattr(lines, "HELD", 100)
        assert (sorted if most is None else list)(proposed(small, most)) == (sorted if most is None else list)(whole)
        monkeypatch.undo()
    # each of 130,000 lines finds 33 earlier ones at most; holding them all took 260 MB
    large = line_bucket(200, 650)
    tracemalloc.start()
    count = sum(b.num_rows for b in lines.pairs_of(0.8, 4)((pa.scalar(0),), iter([large])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count > 400_000 and peak < 120e6


def test_line_buckets_grow_in_number(spark, monkeypatch):
    """More prefix words make more buckets and no larger ones; lines are found all the same."""
    rng = random.Random(5)
    made = [(k, "\n".join(" ".join(rng.choices([f"w{i}" for i in range(300)], k=rng.randint(8, 30))) for _ in range(4))) for k in range(300)]
    made += [(1000 + k, t.replace(" w1 ", " v ")) for k, t in made]
    frame, seen, posts = spark.createDataFrame(made, "doc_id long, text string"), [], lines.posts
    want = sorted(map(tuple, lines.duplicate_lines(frame).collect()), key=repr)

    def watched(rows, buckets, similarity, only=None):
        out = posts(rows, buckets, similarity, only)
        seen.append((buckets, max(r.s for r in out.groupBy("bucket").agg((F.sum(F.length("word")) / 4).alias("s")).collect())))
        return out

    monkeypatch.setattr(lines, "BUCKET", 100)
    monkeypatch.setattr(lines, "GATHERED", 700)
    monkeypatch.setattr(lines, "PER_ROW", 1)
    monkeypatch.setattr(lines, "posts", watched)
    assert sorted(map(tuple, lines.duplicate_lines(frame).collect()), key=repr) == want and len(want) > 1000
    buckets, largest = seen[0]
    # 300 words in as many lists: a list lies whole in a bucket
    assert buckets >= 80 and largest < 1000


def test_mix_query_is_the_training_order(spark, tmp_path):
    """The rows of op8 come from the sorted mix: in the order of their first positions, with what it holds of each; rows of one id stay apart."""
    from tracelens.llm import queries

    rng = random.Random(8)
    made = [(k % 90 or None, "w " * rng.randint(0, 60) if k % 7 else None, rng.choice("abcd") if k % 5 else None) for k in range(400)]
    spark.createDataFrame(made, "doc_id long, text string, source string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_curriculum_mix(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "position", "position_again"]
    rows = got.collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d, len((t or "").split())) for d, t, _ in made)
    firsts = [2 if r.position is None else r.position for r in rows]
    assert firsts == sorted(firsts) and firsts[0] < firsts[-1] == 2
    assert all(r.taken == r.size * sum(p is not None for p in (r.position, r.position_again)) for r in rows)
    # once per reading: what is laid out row by row in the order is what is taken
    planned = mixing.plan(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in rows) == Counter((r.doc_id, r.size, r.taken) for r in planned)


def test_near_copies_come_by_fingerprints_first(spark, monkeypatch):
    """The stage's close copies are found by the pigeonhole search over fingerprints: without bands they go, and what is far stays."""
    from tracelens.llm import copies

    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=rng.randint(3, 8)))
    bases = [[word() for _ in range(2_000)] for _ in range(30)]
    edited = [[*b[:-1], word()] for b in bases]
    made = [(k, " ".join(w)) for k, w in enumerate(bases + edited)]
    prints = [int(copies.fingerprint(copies.shingles(t.encode()))) for _, t in made]
    want = {k for k in range(60) if k < 30 or (prints[k] ^ prints[k - 30]).bit_count() > copies.RADIUS}
    assert len(want) < 35
    docs = spark.createDataFrame(made, "doc_id long, text string")
    # sets without bands
    made_sets = [(k, k, int(xxhash.xxh3_64_intdigest(s.tobytes())) - (1 << 63), int(copies.fingerprint(s)), len(s), [], s.tobytes()) for k, t in made for s in [copies.shingles(t.encode())]]
    monkeypatch.setattr(copies, "sets", lambda *_: spark.createDataFrame(made_sets, copies.SETS))
    assert {r.row for r in copies.heads(docs, "doc_id").collect()} == want
