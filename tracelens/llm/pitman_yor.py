"""A hierarchical Pitman-Yor language model over words, sampled by Gibbs and shared out by context.

Every word that precedes another is a context with a restaurant of its own; the parent of all of them is the
restaurant of all words, whose base is uniform over the vocabulary and one unknown word.  A rare context has
few customers, so most of its prediction is the parent's.

Contexts fall into buckets by hash, so a restaurant lies whole in one bucket; words fall into buckets of their
own, where the root's dishes lie.  A round seats the contexts' customers given the root's probabilities, sends
the tables of every word to the root, seats those there, and sends the root's customers and tables back.
Given an auxiliary gamma variable per restaurant its dishes are independent, so all are seated at once and
exactly.  Between rounds everything lies in tables; counts are summed per block of documents before they travel.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, noted, persist, reclaim, release, text_bytes

BLOCK_TOKENS = 2_200_000
#: Rounds whose seatings aren't used, rounds that are averaged, and sweeps over the contexts in each.
BURN_IN, SAMPLES, SWEEPS = 1, 2, 2
#: Discount and strength of the contexts' restaurants and of the root.
DISCOUNTS, STRENGTHS = (0.8, 0.7), (1.0, 1.0)
#: Up to so many customers the number of tables is drawn from a table of Stirling numbers, beyond it by
#: Metropolis steps on the sizes of the tables; both for the same conditional distribution.
EXACT, STEPS = 256, 24


class Tokens(dict):
    """Word -> 48 bits of its hash, kept for recent words."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) >> 16
        return value


TOKENS = Tokens()
#: No word can hold a line break.
END = TOKENS[b"\n"]
START = TOKENS[b""]

BLOCKS = "block long, bucket long, doc_ids binary, lengths binary, index binary, contexts binary, runs binary, words binary, counts binary"
STORED = "block long, bucket long, doc_ids binary, lengths binary, index binary, words binary, place binary, runs binary, counts binary, blocks array<struct<block:long,n:int,index:binary>>, n_contexts long, n_keys long"
ROUND = "bucket long, part int, n int, a binary, b binary, c binary"
REPLIES = "bucket long, part int, n int, a binary, b binary, c binary, totals array<long>"
ANSWERS = "block long, bucket long, n int, logs binary, known binary"
#: Log probabilities travel as whole numbers of this unit, 3 bytes each down to 10**-16.
UNIT = 1e-6
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: int | None) -> bool:
    """Whether crc32 of the id as text leaves remainder 0 by 10; a null id counts as empty text, so it is held out."""
    return zlib.crc32(b"" if doc_id is None else b"%d" % doc_id) % 10 == 0


def share(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of ``parts`` that each hash falls into; parts follow the order of the hashes."""
    return ((hashes >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def slim(x: np.ndarray, least: int = 1) -> bytes:
    """Numbers in as few bytes each as the largest needs; the reader tells by the length."""
    bytes_ = max(least, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return np.ascontiguousarray(x.astype("<u8").view("u1").reshape(-1, 8)[:, :bytes_]).tobytes()


def wide(data: bytes, count: int, kind: str = "<i8") -> np.ndarray:
    out = np.zeros((count, 8), "u1")
    if count:
        out[:, : len(data) // count] = np.frombuffer(data, "u1").reshape(count, -1)
    return out.view(kind).ravel()


def hashes(data: bytes) -> np.ndarray:
    """What ``slim`` made of hashes in 6 bytes each."""
    return wide(data, len(data) // 6, "<u8")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def blocks(docs: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in blocks of about BLOCK_TOKENS tokens: a row with ids, lengths and every token's place among
    the block's distinct (context, word) keys, and a row per bucket with its keys and their training counts.
    The former has a negative bucket of its own.
    Keys are in the order of the hashes of context and word, as runs of words per context."""

    def run(batches):
        ids: list = []
        parts: list[np.ndarray] = []
        tokens, n = 0, 0
        start = np.array([START], np.uint64)
        task = TaskContext.get().partitionId() << 24

        def emit():
            lengths = np.array([len(p) - 1 for p in parts], np.int64)
            flat = np.concatenate(parts)
            parts.clear()
            distinct, place = np.unique(flat, return_inverse=True)
            del flat
            # every part begins with the start symbol, which precedes its first word
            ends = np.cumsum(lengths + 1)
            word = np.ones(len(place), bool)
            word[ends - lengths - 1] = False
            before = np.ones(len(place), bool)
            before[ends - 1] = False
            pair = place[before].astype(np.uint64) << np.uint64(32)
            pair |= place[word].astype(np.uint64)
            del place, before, word
            keys, index = np.unique(pair, return_inverse=True)
            del pair
            train = np.repeat(np.array([not held_out(i) for i in ids]), lengths)
            counts = np.bincount(index, weights=train, minlength=len(keys)).astype(np.int64)
            context, words = (keys >> np.uint64(32)).astype(np.int64), distinct[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
            runs = np.diff(np.append(first, len(keys)))
            contexts = distinct[context[first]]
            edges = np.searchsorted(share(contexts, buckets), np.arange(buckets + 1))
            at = np.append(first, len(keys))
            name = task + n
            # ids of null documents are marked by their length's sign
            known = np.array([0 if i is None else i for i in ids], "<i8")
            signed = np.where([i is None for i in ids], -lengths, lengths).astype("<i8")
            rows = [(name, -1 - name, known.tobytes(), signed.tobytes(), slim(index), None, None, None, None)]
            for b, (x, y) in enumerate(zip(edges, edges[1:])):
                if y > x:
                    own = slice(at[x], at[y])
                    rows.append((name, b, None, None, None, slim(contexts[x:y], 6), slim(runs[x:y]), slim(words[own], 6), slim(counts[own])))
            return _batch(rows, BLOCKS)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch)):
                words = text.lower().split()
                values = np.fromiter(map(TOKENS.__getitem__, words), np.uint64, len(words))
                parts.append(np.concatenate([start, values, np.array([END], np.uint64)]))
                ids.append(doc_id)
                tokens += len(values) + 1
                if tokens >= BLOCK_TOKENS:
                    yield emit()
                    ids, parts, tokens, n = [], [], 0, n + 1
        if ids:
            yield emit()

    return as_bytes(docs, id_col, text_col).mapInArrow(run, BLOCKS)


def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The restaurants of a bucket from what the blocks sent: distinct words, each key's word, keys per context,
    counts, and where each block's keys went (as steps, both being in the same order).  A block's own row stays."""
    own = ["block", "bucket", "doc_ids", "lengths", "index"]
    types = [pa.int64(), pa.int64(), *[pa.binary()] * 7, pa.list_(pa.struct([("block", pa.int64()), ("n", pa.int32()), ("index", pa.binary())])), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in STORED.replace("block:long,n:int,", "").split(", ")]
    if key[0].as_py() < 0:
        return pa.Table.from_arrays([table.column(n).combine_chunks() if n in own else pa.nulls(table.num_rows, t) for n, t in zip(names, types)], names=names)
    table = table.sort_by("block")
    contexts, words, counts, sizes = [], [], [], []
    for c, r, w, n in zip(*(table.column(f).to_pylist() for f in ("contexts", "runs", "words", "counts"))):
        here = hashes(c)
        contexts.append(np.repeat(here, wide(r, len(here))))
        words.append(hashes(w))
        sizes.append(len(words[-1]))
        counts.append(wide(n, sizes[-1]))
    _, of = np.unique(np.concatenate(contexts), return_inverse=True)
    distinct, place = np.unique(np.concatenate(words), return_inverse=True)
    keys, index = np.unique(of.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64), return_inverse=True)
    count = np.bincount(index, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)
    runs = np.bincount((keys >> np.uint64(32)).astype(np.int64))
    edges = np.cumsum([0, *sizes])
    steps = [{"block": b, "n": int(y - x), "index": slim(np.diff(index[x:y], prepend=0))} for b, x, y in zip(table.column("block").to_pylist(), edges, edges[1:])]
    row = [None, key[0].as_py(), None, None, None, slim(distinct, 6), slim(keys & np.uint64(0xFFFFFFFF)), slim(runs), slim(count), steps, len(runs), len(keys)]
    return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)


_stirling: dict[float, np.ndarray] = {}


def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """log of the generalised Stirling numbers: ways to seat c customers at t tables, weighted by discounts."""
    if discount not in _stirling:
        out = np.full((most + 1, most + 1), -np.inf)
        out[1, 1] = 0.0
        with np.errstate(divide="ignore"):
            for c in range(1, most):
                t = np.arange(1, c + 2)
                out[c + 1, 1 : c + 2] = np.logaddexp(out[c, t - 1], out[c, 1 : c + 2] + np.log(np.maximum(c - discount * t, 0.0)))
        _stirling[discount] = out
    return _stirling[discount]


def log_size(n: np.ndarray, discount: float) -> np.ndarray:
    """log probability of a table of size n among tables of a restaurant, up to a constant: gamma(n - d) / n!."""
    n = np.asarray(n, np.float64)
    # by Stirling's series from n + 8 on and the recursion below it
    low = np.zeros_like(n)
    for k in range(8):
        low += np.log(n + k - discount) - np.log(n + k + 1)
    a, b = n + 8 - discount, n + 9
    series = lambda x: (x - 0.5) * np.log(x) - x + 1 / (12 * x) - 1 / (360 * x**3)
    return series(a) - series(b) - low


def draw_sizes(count: int, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Sizes of ``count`` tables when nothing is known of their sum: geometric with a beta success rate."""
    p = np.maximum(rng.beta(discount, 1 - discount, count), 1e-15)
    return np.minimum(np.ceil(np.log(np.maximum(rng.random(count), 1e-300)) / np.log1p(-np.minimum(p, 1 - 1e-15))), 1e15).astype(np.int64).clip(1)


def tilt(customers: np.ndarray, rate: np.ndarray, discount: float) -> np.ndarray:
    """log r at which tables of rate rate * r**size hold nearly all customers on average; 0 where few do anyway."""
    low, high = np.full(len(customers), -40.0), np.zeros(len(customers))  # log(1 - r)
    for _ in range(50):
        mid = (low + high) / 2
        above = np.log(np.maximum(rate * discount, 1e-300)) + np.log1p(-np.exp(mid)) - (1 - discount) * mid > np.log(0.9 * customers)
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return np.log1p(-np.exp(low))


def seat_many(customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Like ``seat``, for any number of customers, by Metropolis steps on the seating itself.

    Without its largest table, a dish's tables are a Poisson process of rate fresh / discount, weighted by
    the probability of the largest table's size; sizes are tilted so that their sum comes near the number of
    customers, and the largest table's size makes up for it.  A step thins the process, adds new tables in
    proportion and is taken by the ratio of the weights, so the conditional distribution of the seating stays.
    Where most customers sit at small tables steps are small, and there are more of them.
    """
    rate = fresh / discount
    log_r = tilt(customers, rate, discount)
    thin = np.minimum(1.0, 0.5 * customers**discount / np.maximum(rate, 1e-300))
    thin = np.where(log_r < -0.05, np.minimum(thin, 4 / np.maximum(rate, 1e-300)), thin)
    turns = np.exp2(np.ceil(np.log2(np.clip(8 / thin, STEPS, 256)))).astype(np.int64)
    out = np.empty(len(customers), np.int64)
    for k in np.unique(turns).tolist():
        at = np.flatnonzero(turns == k)
        out[at] = _metropolis(customers[at], rate[at], log_r[at], thin[at], discount, rng, k)
    return out


def _metropolis(customers, rate, log_r, thin, discount: float, rng: np.random.Generator, steps: int) -> np.ndarray:
    n = len(customers)
    owner, sizes = np.empty(0, np.int64), np.empty(0, np.int64)
    weight = lambda large, ties: log_size(large, discount) + large * log_r - np.log1p(ties)
    large = customers.copy()
    now = weight(large, np.zeros(n))
    for _ in range(steps):
        stay = rng.random(len(owner)) >= thin[owner]
        new = np.repeat(np.arange(n), rng.poisson(thin * rate * np.exp(log_r)))
        drawn = draw_sizes(len(new), discount, rng)
        few = np.log(np.maximum(rng.random(len(new)), 1e-300)) < (drawn - 1) * log_r[new]
        who = np.concatenate([owner[stay], new[few]])
        size = np.concatenate([sizes[stay], drawn[few]])
        most = np.zeros(n, np.int64)
        np.maximum.at(most, who, size)
        left = (customers - np.bincount(who, weights=size.astype(np.float64), minlength=n)).astype(np.int64)
        can = left >= np.maximum(most, 1)
        # the largest may have equals, any of which could be called the largest
        then = weight(np.where(can, left, 1), np.bincount(who, weights=size == left[who], minlength=n))
        take = can & (np.log(np.maximum(rng.random(n), 1e-300)) < then - now)
        large, now = np.where(take, left, large), np.where(take, then, now)
        old, fine = ~take[owner], take[who]
        owner, sizes = np.concatenate([owner[old], who[fine]]), np.concatenate([sizes[old], size[fine]])
    return np.bincount(owner, minlength=n) + 1


def seat(customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers t of tables for dishes with ``customers``, drawn in proportion to stirling(customers, t) * fresh**t."""
    tables = np.minimum(customers, 1).astype(np.int64)
    logs = stirling(discount)
    log_fresh = np.log(np.maximum(fresh, 1e-300))
    order = np.argsort(customers, kind="stable")
    edges = np.searchsorted(customers[order], np.arange(2, EXACT + 2))
    for c, (x, y) in enumerate(zip(edges, edges[1:]), 2):
        for low in range(x, y, 1 << 16):
            at = order[low : min(low + (1 << 16), y)]
            weight = logs[c, 1 : c + 1][None, :] + np.arange(1, c + 1)[None, :] * log_fresh[at][:, None]
            np.exp(weight - weight.max(1, keepdims=True), out=weight)
            np.cumsum(weight, axis=1, out=weight)
            tables[at] = (weight < (rng.random(len(at)) * weight[:, -1])[:, None]).sum(1) + 1
    at = order[edges[-1] :]
    if len(at):
        tables[at] = seat_many(customers[at].astype(np.int64), fresh[at], discount, rng)
    return tables


class Root:
    """The root's share of the prediction, from its customers and tables of words and its totals."""

    def __init__(self, totals: list[int]):
        self.customers, self.tables, self.vocabulary, self.tokens = totals

    def predict(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        d, s = DISCOUNTS[1], STRENGTHS[1]
        return (customers - d * tables + (s + d * self.tables) / (self.vocabulary + 1)) / (s + self.customers)


class Bucket:
    """The contexts of a bucket, and what the root has told about their words."""

    def __init__(self, static: pa.Table, replies: pa.Table, root: Root):
        row = static.to_pylist()[0]
        self.name, self.blocks = row["bucket"], row.get("blocks")
        self.words = hashes(row["words"]) if row.get("words") else None
        self.place = wide(row["place"], row["n_keys"])
        self.runs = wide(row["runs"], row["n_contexts"])
        self.counts = wide(row["counts"], row["n_keys"])
        self.starts = np.cumsum(self.runs) - self.runs
        self.tables = np.minimum(self.counts, 1)
        self.customers_of = np.repeat(self.total(self.counts), self.runs)
        self.hear(replies.to_pylist(), root)

    def hear(self, replies: list[dict], root: Root) -> None:
        """Take in the root's replies, and the seating that they were asked with."""
        seen = sorted(replies, key=lambda r: r["part"])
        if seen and seen[0]["part"] < 0:
            self.tables = wide(seen.pop(0)["a"], len(self.counts))
        if seen:
            customers, tables, self.known = (np.concatenate([wide(r[c], r["n"]) for r in seen]) for c in "abc")
            self.base = root.predict(customers, tables)[self.place]

    def total(self, x: np.ndarray) -> np.ndarray:
        """Sums per context."""
        return np.add.reduceat(x, self.starts)

    def predict(self) -> np.ndarray:
        d, s = DISCOUNTS[0], STRENGTHS[0]
        tables_of = np.repeat(self.total(self.tables), self.runs)
        return (self.counts - d * self.tables + (s + d * tables_of) * self.base) / (s + self.customers_of)

    def seat(self, rng: np.random.Generator) -> None:
        d, s = DISCOUNTS[0], STRENGTHS[0]
        more = np.flatnonzero(self.counts > 1)
        of = np.repeat(np.arange(len(self.runs)), self.runs)[more]
        for _ in range(SWEEPS):
            weight = rng.gamma(s / d + self.total(self.tables))
            self.tables[more] = seat(self.counts[more], d * weight[of] * self.base[more], d, rng)

    def asks(self, parts: int) -> list[tuple]:
        """A row per part of the words: hashes, tables of all contexts here, training count."""
        tables, counts = (np.bincount(self.place, weights=x, minlength=len(self.words)).astype(np.int64) for x in (self.tables, self.counts))
        edges = np.searchsorted(share(self.words, parts), np.arange(parts + 1)).tolist()
        return [(self.name, k, y - x, slim(self.words[x:y], 6), slim(tables[x:y]), slim(counts[x:y])) for k, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]


def first_asks(parts: int):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                own = pa.Table.from_batches([batch.slice(k, 1)])
                yield _batch(Bucket(own, EMPTY, Root([0, 0, 0, 0])).asks(parts), ROUND)

    return run


EMPTY = pa.table({"bucket": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "n": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in "abc"}})


def seat_root(before: list[int] | None, seed: int, turn: int):
    """applyInArrow over a part of the words: the root's customers and tables, told to every bucket that asked.

    ``before`` holds the totals of the round before; without them every word has one table.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        rng = np.random.default_rng([seed, turn, 1, part])
        table = table.sort_by("bucket")
        sizes = table.column("n").to_pylist()
        asked = [hashes(b) for b in table.column("a").to_pylist()]
        words, index = np.unique(np.concatenate(asked), return_inverse=True)
        add = lambda c: np.bincount(index, weights=np.concatenate([wide(b, n) for b, n in zip(table.column(c).to_pylist(), sizes)]), minlength=len(words)).astype(np.int64)
        customers, known = add("b"), add("c")
        tables = np.minimum(customers, 1)
        if before is not None:
            d, s = DISCOUNTS[1], STRENGTHS[1]
            weight = np.random.default_rng([seed, turn]).gamma(s / d + before[1])  # one draw that all parts share
            tables = seat(customers, np.full(len(words), d * weight / (before[2] + 1)), d, rng)
        edges = np.cumsum([0, *sizes]).tolist()
        rows = [(b, part, j - i, *[slim(x[index[i:j]]) for x in (customers, tables, known)], None) for b, i, j in zip(table.column("bucket").to_pylist(), edges, edges[1:])]
        rows.append((-1, part, 0, None, None, None, [int(customers.sum()), int(tables.sum()), int((known > 0).sum()), int(known.sum())]))
        return pa.Table.from_batches([_batch(rows, REPLIES)])

    return run


def seat_contexts(totals: list[int], seed: int, turn: int, parts: int):
    """cogroup of a bucket with the root's replies: seat its customers, keep the seating, and ask again."""

    def run(static: pa.Table, replies: pa.Table) -> pa.Table:
        own = Bucket(static, replies, Root(totals))
        own.seat(np.random.default_rng([seed, turn, 0, own.name]))
        return pa.Table.from_batches([_batch([(own.name, -1, len(own.counts), slim(own.tables), None, None), *own.asks(parts)], ROUND)])

    return run


def answers(totals: dict[int, list[int]]):
    """cogroup of a bucket with the replies of all rounds that count: averaged log10 probabilities and word counts, by block."""

    def run(static: pa.Table, replies: pa.Table) -> pa.Table:
        own = Bucket(static, EMPTY, Root([0, 0, 0, 0]))
        found = replies.to_pylist()
        p = np.zeros(len(own.counts))
        for turn, sums in totals.items():
            own.hear([r for r in found if r["turn"] == turn], Root(sums))
            p += own.predict()
        logs = np.rint(-np.log10(p / len(totals)) / UNIT).astype(np.int64)
        known = own.known[own.place]
        rows = []
        for b in own.blocks:
            at = np.cumsum(wide(b["index"], b["n"]))
            rows.append((b["block"], own.name, b["n"], slim(logs[at]), slim(known[at])))
        return pa.Table.from_batches([_batch(rows, ANSWERS)])

    return run


def score_block(n: int, v: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("bucket")
        counts = found.column("n").to_pylist()
        known, logs = (np.concatenate([wide(b, k) for b, k in zip(found.column(c).to_pylist(), counts)]) for c in ("known", "logs"))
        logs = logs * -UNIT
        base = np.log10((known + 0.1) / (n + 0.1 * (v + 1)))
        ids = np.frombuffer(docs.column("doc_ids")[0].as_py(), "<i8")
        signed = np.frombuffer(docs.column("lengths")[0].as_py(), "<i8")
        lengths = np.abs(signed)
        index = wide(docs.column("index")[0].as_py(), int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        names = [None if s < 0 else i for i, s in zip(ids.tolist(), signed.tolist())]
        total = lambda x: np.add.reduceat(x, starts)
        columns = [
            pa.array(names, pa.int64()), pa.array([held_out(i) for i in names]), pa.array(lengths), pa.array(total((known > 0)[index].astype(np.int64))),
            pa.array(np.full(len(ids), n)), pa.array(total(base[index])), pa.array(total(logs[index])),
        ]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, buckets: int | None = None, seed: int = 1, burn_in: int = BURN_IN, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the lower-cased (A-Z) words of the whole text and one end token; a null text is empty and has
    the end token alone.  Training takes the documents whose crc32(doc_id as text) mod 10 is not 0.  Repeated
    rows count as often as they occur.  Without training documents every token has the base probability.
    An empty table gives no rows.  Words are told apart by 64 bits of their hash.
    """
    spark = docs.sparkSession
    # as many buckets as the input has; a block writes a row to each in which it has a key
    buckets = buckets or max(32, 4 * docs.rdd.getNumPartitions())
    parts = max(12, buckets // 4)
    written, asked_by, told_by = [], [], []
    with noted(written):
        made = blocks(docs, buckets, id_col, text_col).groupBy("bucket").applyInArrow(gather, STORED)
        stored = persist(made.withColumn("restaurants", F.col("bucket") >= 0), "restaurants", "restaurants")
    release(spark)
    static = stored.filter("restaurants").drop("block", "doc_ids", "lengths", "index", "restaurants")
    lean = static.drop("blocks")
    with noted(asked_by):
        asks = persist(lean.mapInArrow(first_asks(parts), ROUND), "asks")
    seats, counted, totals, sums = None, None, {}, None
    for turn in range(burn_in + samples + 1):
        with noted(told_by):
            replies = persist(asks.groupBy("part").applyInArrow(seat_root(sums, seed, turn), REPLIES), "replies")
        reclaim(spark, asked_by)
        summed = replies.filter("bucket < 0").select(F.posexplode("totals").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
        if not summed:
            return spark.createDataFrame([], SCORES)
        sums = [int(r.x) for r in summed]
        told = replies.filter("bucket >= 0").drop("totals")
        told = told if seats is None else told.unionByName(seats)
        if turn > burn_in:
            totals[turn] = sums
            own = told.withColumn("turn", F.lit(turn))
            counted = own if counted is None else counted.unionByName(own)
        if turn < burn_in + samples:
            made = lean.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(seat_contexts(sums, seed, turn, parts), ROUND)
            with noted(asked_by):
                both = persist(made.withColumn("asks", F.col("part") >= 0), "seated", "asks")
            asked_by = [f"{p}/asks=true" for p in asked_by]
            if turn <= burn_in:
                reclaim(spark, told_by)  # replies of later rounds are needed at the end
            told_by = []
            release(spark)
            asks, seats = both.filter("asks").drop("asks"), both.filter("not asks").drop("asks")
    logs = persist(static.drop("words").groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(answers(totals), ANSWERS), "answers")
    reclaim(spark, [f"{p}/restaurants=true" for p in written])
    release(spark)
    own = stored.filter("not restaurants").select("block", "doc_ids", "lengths", "index")
    return own.groupBy("block").cogroup(logs.groupBy("block")).applyInArrow(score_block(sums[3], sums[2]), SCORES)
