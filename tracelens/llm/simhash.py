"""SimHash near-dedup with the generalised pigeonhole principle.

Fingerprints within ``radius`` bits of each other are found by parts of their bits: with part thresholds
t_1..t_m that add up to radius - m + 1, two fingerprints that close differ in at most t_i bits of some part i
(a threshold of -1 skips a part).  Correlated bits share a part, and thresholds are dealt by dynamic
programming on candidate counts estimated from all fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, persist, split_join, text_bytes

BITS, BLOCKS, WIDTH = 64, 8, 8
SHINGLE, RADIUS, SEED = 3, 2, 42
#: A group of fingerprints above this size is split by further bits before it is compared.
GROUP = 2_000


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Bits set in over half the XXH64 values of all shingles, repeats included; no words: 0."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle or None], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return int(majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], "<u8")))


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed number) of lower-cased (A-Z) whole texts; null: 0."""

    def run(batches):
        for batch in batches:
            made = np.array([fingerprint(t.lower().split(), shingle) for t in text_bytes(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return as_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def spread(fps: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones per fingerprint, lowest bit first."""
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(classes: DataFrame) -> np.ndarray:
    """How often each two bits are set together, over all distinct fingerprints: 64 rows a task travel."""

    def run(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            x = spread(batch.column("fp").to_numpy(zero_copy_only=False)).astype(np.float32)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), pa.array(total.astype(np.int64).tolist(), pa.list_(pa.int64()))], names=["bit", "both"])

    rows = classes.select("fp").mapInArrow(run, "bit int, both array<long>").select("bit", F.posexplode("both").alias("other", "n")).groupBy("bit", "other").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((BITS, BITS))
    for r in rows:
        out[r.bit, r.other] = r.n
    return out


def correlated_blocks(both: np.ndarray, n: int, blocks: int = BLOCKS) -> list[list[int]]:
    """Bits in ``blocks`` groups of equal size: each grows from the lowest free bit by the one most correlated to it."""
    p = np.diag(both) / max(n, 1)
    deviation = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(deviation, deviation)
    free, out = list(range(BITS)), []
    for _ in range(blocks):
        group = [free.pop(0)]
        while len(group) < BITS // blocks:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        out.append(sorted(group))
    return out


def block_values(fps: np.ndarray, blocks: list[list[int]]) -> np.ndarray:
    """The value of every block, a column each."""
    x = spread(fps)
    return np.stack([np.packbits(x[:, b], axis=1, bitorder="little")[:, 0] for b in blocks], axis=1)


def block_histograms(classes: DataFrame, blocks: list[list[int]]) -> np.ndarray:
    """How many distinct fingerprints have each value of each block (8 x 256 numbers)."""

    def run(batches):
        total = np.zeros((len(blocks), 256), np.int64)
        for batch in batches:
            values = block_values(batch.column("fp").to_numpy(zero_copy_only=False), blocks)
            for i in range(len(blocks)):
                total[i] += np.bincount(values[:, i], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["block", "n"])

    rows = classes.select("fp").mapInArrow(run, "block int, n array<long>").select("block", F.posexplode("n").alias("value", "n")).groupBy("block", "value").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((len(blocks), 256))
    for r in rows:
        out[r.block, r.value] = r.n
    return out


def distances(histogram: np.ndarray) -> np.ndarray:
    """Share of random pairs at each Hamming distance 0..8 of a block, from its histogram."""
    p = histogram / max(histogram.sum(), 1)
    apart = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
    return np.bincount(apart.ravel(), weights=np.outer(p, p).ravel(), minlength=9)


def allocate(histograms: np.ndarray, radius: int, n: int) -> list[tuple[list[int], int]]:
    """Parts (lists of block numbers) with their thresholds, of the cheapest allocation.

    For each number of parts m, blocks are dealt in order to m parts; the cost of threshold t for a part is
    the rows that probing writes plus the pairs expected within t bits there (blocks taken as independent),
    and dynamic programming over parts and threshold sums finds thresholds that add up to radius - m + 1.
    """
    pmf = [distances(h) for h in histograms]
    best: tuple[float, list[tuple[list[int], int]]] = (np.inf, [])
    for m in range(2, radius + 2):
        parts = [list(range(len(pmf) * i // m, len(pmf) * (i + 1) // m)) for i in range(m)]
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part in parts:
            within = np.array([1.0])
            for b in part:
                within = np.convolve(within, pmf[b])
            width = WIDTH * len(part)
            costs = {-1: 0.0}
            for t in range(radius + 1):
                probes = sum(len(list(combinations(range(width), j))) for j in range(t + 1))
                costs[t] = n * probes * 4 + within[: t + 1].sum() * n * n / 2
            step: dict[int, tuple[float, list[int]]] = {}
            for total, (cost, chosen) in table.items():
                for t, c in costs.items():
                    if cost + c < step.get(total + t, (np.inf, []))[0]:
                        step[total + t] = (cost + c, [*chosen, t])
            table = step
        cost, chosen = table.get(radius - m + 1, (np.inf, []))
        if cost < best[0]:
            best = (cost, [(p, t) for p, t in zip(parts, chosen) if t >= 0])
    return best[1]


def union_stars(fps: np.ndarray, radius: int, free: np.ndarray, out: list[tuple[int, int]]) -> None:
    """Append (fp, least fp) stars that connect what is within ``radius`` bits among ``fps`` (distinct, sorted).

    Small groups are compared in full.  Larger ones split by pigeonhole over the bits that still vary: two
    close fingerprints agree in one of radius + 1 parts of them.  When no more than ``radius`` bits vary, all
    are close.
    """
    n = len(fps)
    if n < 2:
        return
    vary = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [b for b in free.tolist() if vary >> b & 1]
    if len(bits) <= radius:
        out.extend((int(f), int(fps[0])) for f in fps[1:])
        return
    if n <= GROUP:
        label = np.arange(n)
        for i in range(n - 1):
            near = label[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius]
            if (near != label[i]).any():
                merged = np.unique(np.append(near, label[i]))
                label[np.isin(label, merged)] = merged[0]
        out.extend((int(fps[i]), int(fps[label[i]])) for i in np.flatnonzero(label != np.arange(n)).tolist())
        return
    for k in range(radius + 1):
        mask = np.uint64(sum(1 << b for b in bits[k :: radius + 1]))
        key = fps & mask
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.diff(key[order])) + 1
        rest = np.array([b for b in bits if not int(mask) >> b & 1])
        for part in np.split(order, edges):
            union_stars(np.sort(fps[part]), radius, rest, out)


def probe_rows(classes: DataFrame, blocks: list[list[int]], parts: list[tuple[list[int], int]]) -> DataFrame:
    """part, key, fp: each fingerprint's bits of a part, and all keys within the part's threshold of them."""
    masks = [sum(1 << b for i in part for b in blocks[i]) for part, _ in parts]
    flips = []
    for (part, t), _mask in zip(parts, masks):
        own = [b for i in part for b in blocks[i]]
        flips.append(np.array([sum(1 << b for b in c) for j in range(t + 1) for c in combinations(own, j)], np.uint64))

    def run(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for number, (mask, flip) in enumerate(zip(masks, flips)):
                for at in range(0, len(fps), 4096):
                    own = fps[at : at + 4096]
                    keys = ((own & np.uint64(mask))[:, None] ^ flip[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number, np.int32)), pa.array(keys.view(np.int64)), pa.array(np.repeat(own, len(flip)).view(np.int64))], names=["part", "key", "fp"])

    return classes.select("fp").mapInArrow(run, "part int, key long, fp long")


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: pairs of fingerprints that connect all those within ``radius`` bits, not every close pair."""
    classes = classes.select("fp")
    n = classes.count()
    both = bit_counts(classes)
    blocks = correlated_blocks(both, n)
    parts = allocate(block_histograms(classes, blocks), radius, n)
    rows = probe_rows(classes, blocks, parts)
    used = [np.array(sorted(set(range(BITS)) - {b for i in part for b in blocks[i]} | ({b for i in part for b in blocks[i]} if t else set()))) for part, t in parts]

    sizes = rows.groupBy("part", "key").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = persist(sizes.withColumn("pk", F.xxhash64("part", "key")), "keys")
    joined = split_join(rows.withColumn("pk", F.xxhash64("part", "key")), sizes.select("pk", "n", F.col("n").alias("members")), "pk", "n")
    # groups too large for one task are dealt by further bits: radius + 1 ways, one of which any close pair shares
    whole = joined.filter(F.col("members") <= GROUP * 50).select("part", "key", F.lit(-1).alias("way"), F.lit(0).cast("long").alias("sub"), "fp")
    large = joined.filter(F.col("members") > GROUP * 50)
    ways = [F.struct(F.lit(k).alias("way"), F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in range(BITS) if b % (radius + 1) == k)))).alias("sub")) for k in range(radius + 1)]
    dealt = large.select("part", "key", F.explode(F.array(*ways)).alias("w"), "fp").select("part", "key", "w.way", "w.sub", "fp")

    def star(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        fps = np.unique(table.column("fp").to_numpy().view(np.uint64))
        out: list[tuple[int, int]] = []
        union_stars(fps, radius, used[part] if table.column("way")[0].as_py() < 0 else np.arange(BITS), out)
        pairs = np.array(out, np.uint64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0].copy().view(np.int64), "b": pairs[:, 1].copy().view(np.int64)})

    def stars(batches):
        """Groups lie together, sorted; one Arrow call serves all groups of a task."""
        held, last = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "key", "way", "sub")], 1)
            edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), len(keys)] if len(keys) else [0]
            results = []
            for a, b in zip(edges, edges[1:]):
                here = tuple(keys[a].tolist())
                if last is not None and here != last:
                    results.append(star(pa.Table.from_batches(held)))
                    held = []
                held.append(batch.slice(a, b - a))
                last = here
            for r in results:
                yield from r.to_batches()
        if held:
            yield from star(pa.Table.from_batches(held)).to_batches()

    return whole.unionByName(dealt).repartition("part", "key", "way", "sub").sortWithinPartitions("part", "key", "way", "sub").mapInArrow(stars, "a long, b long").distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (its component's least node) of every node in ``pairs`` (a, b) with a neighbour.

    Large-star and small-star rounds over tables in the shared folder until nothing changes; each node sends
    its neighbours to the least of them, so no group is expanded and edges never grow in number.
    """
    edges = persist(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    sign = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        # large star: larger neighbours of every node go to its least neighbour
        grown = split_join(both, persist(least, "least"), "a", "n").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        grown = persist(grown.filter("a <> b").distinct(), "large")
        # small star: a node and its smaller neighbours go to the least of them
        small = grown.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = persist(small, "small")
        moved = split_join(grown, small, "a", "n").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = persist(moved.unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == sign:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        sign = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, the least doc_id reachable.

    Documents link when their fingerprints differ in at most ``radius`` bits.  Texts without words have
    fingerprint 0 and link like any other; null texts too.  Documents of one fingerprint are one class from
    the start, so copies never meet each other.  An empty table gives no rows; repeated rows are kept.
    """
    made = persist(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = persist(made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    rooted = components(links(classes, radius))
    joined = classes.join(rooted, classes["fp"] == rooted["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    per_class = persist(joined.join(least, "root").select("fp", "n", "component_id"), "components")
    out = split_join(made, per_class, "fp", "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
