"""Source divergence, p-stable vector groups and ranked search: brute force, odd rows, hot groups, other block sizes."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracelens.llm import divergence, pstable, ranked, sharding, terms

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, item_id string, rank int, score string"
ODD = [
    (1, None, None, None, "x", 1, "a"), (2, "", "en", "s", "x", 1, "a"), (3, " \n\t\n123 _", "en", None, "x", 1, "a"), (4, "One two THREE", "en", "s", "x", 1, "a"),
    (4, "One two THREE", "en", "s", "x", 1, "a"), (None, "no id one", None, "s", "x", 1, "a"), (5, "word one " * 300_000, "en", "t", "x", 1, "a"),
    (6, "é$ ü# \x0b ok\nÉok one2", "de", "t", "x", 1, "a"), (7, "one two three", "en", "t", "x", 1, "a"), (8, "one two three", "en", "t", "x", 1, "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_words_of_a_long_text_are_whole(monkeypatch):
    table, text = terms.letters("0123456789abcdefghijklmnopqrstuvwxyz"), "Ab1 é中-x\x00y " * 500 + "z" * 100
    want = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
    for piece in (1 << 20, 64, 7):
        monkeypatch.setattr(terms, "PIECE", piece)
        assert [w.decode() for some in terms.words(text.encode(), table) for w in some] == want


def brute_audit(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for _, text, lang, source, *_ in rows]
    held, counted, out = Counter(), Counter(), []
    for lang, source, words in docs:
        held.update({(lang, w) for w in words})
        counted.update((lang, source, w) for w in words)
    for lang in {d[0] for d in docs}:
        kept = [w for (x, w), n in held.items() if x == lang and n >= least]
        sources = {d[1] for d in docs if d[0] == lang}
        size = {s: sum(counted[lang, s, w] for w in kept) for s in sources}
        p = {s: {w: 1 + 10**9 * (counted[lang, s, w] + 2) // (size[s] + 2 * len(kept)) for w in kept} for s in sources}
        q = {w: 1 + 10**9 * (sum(counted[lang, s, w] for s in sources) + 2) // (sum(size.values()) + 2 * len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in sources if o != s)
            own = sorted((-f(p[s][w], q[w]), w.encode()) for w in kept if counted[lang, s, w] and p[s][w] > q[w])[:top]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, some in (("pair", pairs), ("term", own)) for k, (v, i) in enumerate(some)]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 2, 99])
def test_divergence_of_odd_rows(spark, odd, least):
    got = sorted(tuple(r) for r in divergence.audit(odd, least).collect())
    assert got == brute_audit(ODD, least, divergence.TOP)


def test_divergence_of_whole_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in table.collect()]
    assert sorted(tuple(r) for r in divergence.audit(table).collect()) == brute_audit(rows, 10, 10)
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_divergence_evaluates_distinct_vectors(spark):
    """A thousand terms of the same counts are one vector."""
    text = " ".join("w" + "".join("abcdefghij"[int(c)] for c in str(k)) for k in range(1000))
    rows = [(k, text, "en", s) for s in "abc" for k in range(4)] + [(9, text + " rare rare", "en", "a")] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = divergence.vectors(divergence.kept_terms(divergence.counts(table), 3), 10).collect()
    assert sorted(r.n for r in found) == [1, 1000] and sorted(len(r.least) for r in found) == [1, 10]
    assert sorted(tuple(r) for r in divergence.audit(table, 3).collect()) == brute_audit(rows, 3, 10)


def brute_links(rows, cosine=0.95):
    fine = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    near = np.zeros((n, n), bool)
    for d in {len(v) for _, v in rows if fine(v)}:
        at = [i for i, (_, v) in enumerate(rows) if fine(v) and len(v) == d]
        u = np.array([rows[i][1] for i in at], float)
        u /= np.abs(u).max(1, keepdims=True)
        u /= np.linalg.norm(u, axis=1)[:, None]
        near[np.ix_(at, at)] = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    root = list(range(n))
    for i in range(n):
        stack, root_i = [i], root[i]
        if root_i != i:
            continue
        while stack:
            for j in np.flatnonzero(near[stack.pop()]):
                if root[j] != i and j != i:
                    root[j] = i
                    stack.append(j)
    ids = defaultdict(list)
    for i in range(n):
        ids[root[i]].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((rows[i][0], int(near[i].sum()), least[root[i]], rows[i][0] == least[root[i]]) for i in range(n)), key=str)


def groups_of_vectors(seed, spread):
    """Background, tight and wide groups, a chain, copies, multiples, and vectors that take no part."""
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(16) for _ in range(150)]
    for size, noise in ((120, 0.01), (80, spread), (40, 0.1)):
        centre = rng.standard_normal(16)
        out += [centre + noise * np.linalg.norm(centre) / 4 * rng.standard_normal(16) for _ in range(size)]
    a, b = rng.standard_normal(16), rng.standard_normal(16)
    b -= a * (a @ b) / (a @ a)
    b *= np.linalg.norm(a) / np.linalg.norm(b)
    out += [math.cos(t) * a + math.sin(t) * b for t in np.arange(0, 2, 0.1)]
    out += [out[0]] * 30 + [out[1] * 1e-200, out[1] * 1e200, -out[1], out[1].astype("f4").astype(float)]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(out)]
    whole = rows[0][1]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan"), *whole[1:]]), (1004, [float("inf"), *whole[1:]]), (1005, [None, *whole[1:]])]
    return rows + [(None, whole), (3, whole), (3, rows[3][1]), (1006, whole[:8]), (1007, whole[:8]), (None, rows[5][1][:5])]


@pytest.mark.parametrize(("seed", "spread", "block"), [(1, 0.05, 256), (2, 0.12, 16), (3, 0.2, 5)])
def test_vector_groups_equal_brute_force(spark, seed, spread, block):
    rows = groups_of_vectors(seed, spread)
    table = spark.createDataFrame([(*r, k, "k") for k, r in enumerate(rows)], "vec_id long, embedding array<double>, n int, component_id string")
    got = sorted((tuple(r) for r in pstable.near_duplicates(table, miss=1e-6, block=block).collect()), key=str)
    want = brute_links(rows)
    assert [(*r[:3], r[3] or r[0] is None) for r in got] == [(*r[:3], r[3] or r[0] is None) for r in want]


def test_tight_groups_are_few_balls(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    rows = [(k, (centre + 0.03 * rng.standard_normal(64)).tolist()) for k in range(900)] + [(1000 + k, rng.standard_normal(64).tolist()) for k in range(100)]
    classes = spark.createDataFrame(rows, "node long, v array<double>")
    owner, balls = pstable.gathered(classes, math.acos(0.95), pstable.STEP)
    assert balls.count() <= 100 + 90 and owner.count() == 1000
    at = {r.node: np.array(r.v) / np.linalg.norm(r.v) for r in classes.collect()}
    assert all(math.acos(min(1.0, at[r.node] @ at[r.ball])) <= r.radius + 1e-6 <= math.acos(0.95) / 2 + 1e-6 for r in owner.collect())


def test_tables_miss_few_pairs_and_empty_tables(spark):
    for n in (100, 10_000, 10**6, 10**9):
        width, tables = pstable.shape(n)
        assert (1 - pstable.collision(math.sqrt(0.1), pstable.STEP) ** width) ** tables <= pstable.MISS
        assert n * tables * pstable.collision(math.sqrt(2), pstable.STEP) ** width <= pstable.CHANCE
    rng = np.random.default_rng(0)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((4000, 64))
    b -= a * (a * b).sum(1)[:, None]
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1)[:, None]
    width, tables = pstable.shape(10_000)
    keys = [pstable.buckets(x, 1, width, tables, pstable.STEP) for x in (a, b)]
    assert (keys[0] == keys[1]).any(1).mean() >= 0.995
    assert pstable.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    alone = pstable.near_duplicates(spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted(tuple(r) for r in alone) == [(1, 0, 1, True), (2, 0, 2, True)]


def brute_search(rows, items, k):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    docs = [(d, Counter(find(t))) for d, t in rows]
    n, total = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in docs:
            m = 50 + (50 * c.total() * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(find(text)) if c[w])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


ITEMS = [(1, "one THREE three"), (2, None), (3, "nothing here at all"), (4, "é ok one2 word"), (4, "no id"), (None, "two"), (5, "")]


@pytest.mark.parametrize(("window", "postings", "block", "k"), [(8192, 4_000_000, 256, 50), (2, 4_000_000, 2, 3), (3, 4, 1, 1)])
def test_search_of_odd_rows(spark, odd, window, postings, block, k):
    items = spark.createDataFrame([(*r, 0) for r in ITEMS], "item_id long, text string, doc_id int")
    got = sorted((tuple(r) for r in ranked.search(odd, items, k, window, postings, block).collect()), key=str)
    assert got == brute_search([r[:2] for r in ODD], ITEMS, k)


def test_search_of_whole_documents(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 50)
    got = ranked.search(docs.repartition(5), items, window=64, block=7)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ranked.search(empty, items).collect() == [] and ranked.search(docs, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_heap_keeps_ties_by_least_id():
    best = ranked.Best(3)
    best.harvest(np.array([5, 5, 5, 5, 1]), np.array([9, 7, 8, 6, 1]))
    best.harvest(np.array([5, 6]), np.array([2, 99]))
    assert sorted((~d, s) for s, d in best.heap) == [(2, 5), (6, 5), (99, 6)]


@pytest.mark.parametrize("parts", [1, 7])
def test_shards_are_even_where_ids_and_records_repeat(spark, parts):
    """A third of the rows has one id, another third is one record; shards differ by less than 1 % in bytes."""
    rng = np.random.default_rng(1)
    size = rng.integers(1, 60, 30_000).tolist()
    made = [(k if k % 3 else 5, f"{k} " + "x" * size[k]) if k % 3 != 1 else (7, "the same text") for k in range(30_000)] + [(None, None)] * 50
    table = spark.createDataFrame(made, "doc_id long, text string").repartition(parts)
    got = sharding.shard(table).collect()
    load, numbers, slots = Counter(), defaultdict(list), Counter()
    for r in got:
        load[r.shard] += r.size
        numbers[r.shard].append(r.slot)
        slots[r.vslot] += 1
    assert len(got) == len(made) and max(load.values()) - min(load.values()) < 0.01 * sum(load.values()) / 8
    assert all(sorted(n) == list(range(len(n))) for n in numbers.values()) and max(slots.values()) < 40
    # the slots are those of the records, however the rows are dealt
    again = sharding.with_slots(table.repartition(3)).collect()
    assert sorted((str(r.doc_id), r.text_crc32, r.vslot) for r in again) == sorted((str(r.doc_id), r.text_crc32, r.vslot) for r in got)
