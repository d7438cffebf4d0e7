"""Fixed virtual slots: records hash into thousands of slots, a versioned map puts slots on shards.

``slot_table`` aggregates rows and bytes per slot, ``first_map`` makes version 1 of the map and ``edit_map``
the next version when shards are added, removed or out of balance.  Only the slots that an edit names move.
``store_map`` keeps every version in a folder, ``load_map`` reads the newest or a given one, and ``rebalance``
does both.  The map has ``slots`` rows whatever the data, so it may be held by the driver and broadcast.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import persist, work_dir

SLOTS = 4096


def with_slots(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, null none, plus 1), text_crc32, vslot.

    Null texts have the check sum of empty text.  A record's slot comes from its id and text, so rows that share an id
    spread; of equal records the first has that slot, and the others have slots by their number among them.  Equal
    records are numbered part by part of the input, as it is stored, and no task holds more of them than a
    part; which of them has which number makes no difference.  Columns besides id and text are left behind.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.col(id_col).cast("long"), text).alias("_record"),
        F.spark_partition_id().alias("_part"),
    )
    rows = persist(rows, "records")
    before = Window.partitionBy("_record").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_record", "_part").agg(F.count("*").alias("_c"))
    starts = counts.select("_record", "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_record", "_part").orderBy("doc_id")) - 1
    numbered = rows.withColumn("_own", own).join(starts, ["_record", "_part"])
    slot = F.pmod(F.xxhash64("_record", F.col("_start") + F.col("_own")), F.lit(slots)).cast("int")
    return numbered.select("doc_id", "size", "text_crc32", slot.alias("vslot"))


def slot_table(rows: DataFrame) -> DataFrame:
    """vslot, n_rows, n_bytes: at most one row per virtual slot; partial sums travel, never rows."""
    return rows.groupBy("vslot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))


def first_map(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> list[tuple[int, int, int]]:
    """Version 1, (version, vslot, shard): slots by falling bytes, each onto the lightest shard."""
    load = [0] * shards
    out = []
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        shard = min(range(shards), key=lambda k: (load[k], k))
        load[shard] += sizes.get(slot, 0)
        out.append((1, slot, shard))
    return sorted(out)


def edit_map(old: list[tuple[int, int, int]], sizes: dict[int, int], shards: int) -> list[tuple[int, int, int]]:
    """The next version for ``shards`` shards, moving few slots.

    Slots of removed shards go to the lightest shard left.  Then, while it narrows the gap between the
    heaviest and the lightest shard, the largest slot that fits moves from one to the other; with one more
    shard and even loads before, slots therefore move only into the new one.
    """
    version = max(v for v, _, _ in old) + 1
    shard_of = {slot: shard for _, slot, shard in old}
    load = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in shard_of.items():
        if shard < shards:
            load[shard] += sizes.get(slot, 0)
            held[shard].append(slot)
    for slot in sorted((s for s, k in shard_of.items() if k >= shards), key=lambda s: (-sizes.get(s, 0), s)):
        k = min(range(shards), key=lambda j: (load[j], j))
        load[k] += sizes.get(slot, 0)
        held[k].append(slot)
        shard_of[slot] = k
    for slots_here in held:
        slots_here.sort(key=lambda s: (sizes.get(s, 0), s))
    for _ in range(len(shard_of)):
        high = max(range(shards), key=lambda k: (load[k], -k))
        low = min(range(shards), key=lambda k: (load[k], k))
        gap = load[high] - load[low]
        fits = [s for s in held[high] if 0 < 2 * sizes.get(s, 0) <= gap]
        if not fits:
            break
        slot = fits[-1]
        held[high].remove(slot)
        held[low].append(slot)
        held[low].sort(key=lambda s: (sizes.get(s, 0), s))
        load[high] -= sizes[slot]
        load[low] += sizes[slot]
        shard_of[slot] = low
    return sorted((version, slot, shard) for slot, shard in shard_of.items())


def store_map(spark: SparkSession, entries: list[tuple[int, int, int]], folder: str) -> None:
    """Add a version of the map to ``folder``, a path that all executors share; a version is written once."""
    version = max(v for v, _, _ in entries)
    made = spark.createDataFrame([(s, k) for _, s, k in entries], "vslot int, shard int")
    made.coalesce(1).write.parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> list[tuple[int, int, int]]:
    """The entries (version, vslot, shard) of a stored version, the newest if none is named."""
    found = spark.read.schema("vslot int, shard int, version int").parquet(folder)
    version = version or found.agg(F.max("version")).first()[0]
    return sorted((r.version, r.vslot, r.shard) for r in found.filter(F.col("version") == version).collect())


def slot_sizes(table: DataFrame) -> dict[int, int]:
    """Bytes by slot: at most as many as there are slots."""
    return {r.vslot: r.n_bytes for r in table.collect()}


def rebalance(docs: DataFrame, folder: str, shards: int, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int, int]]:
    """Edit the newest stored map for ``shards`` shards and the present bytes per slot, and store the edit."""
    edited = edit_map(load_map(docs.sparkSession, folder), slot_sizes(slot_table(with_slots(docs, slots, id_col, text_col))), shards)
    store_map(docs.sparkSession, edited, folder)
    return edited


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, slot (row number in its shard, gapless from 0), map_version.

    ``folder`` holds the stored maps, the newest of which counts; without a folder, version 1 is made from
    the bytes per slot and stored in the work folder.  Rows of a shard are numbered by
    virtual slot, then id: a window per virtual slot (1 of ``slots`` of the rows) plus the sum of the slots
    before it.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = persist(with_slots(docs, slots, id_col, text_col), "slots")
    table = slot_table(rows)
    if folder is None:
        folder = f"{work_dir(spark)}/tracelens/slot-map-{uuid.uuid4().hex}"
        store_map(spark, first_map(slot_sizes(table), shards, slots), folder)
    version = spark.createDataFrame(load_map(spark, folder), "version int, vslot int, shard int")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        table.join(F.broadcast(version), "vslot")
        .withColumn("before", F.coalesce(F.sum("n_rows").over(before), F.lit(0)))
        .select("vslot", "shard", "before", F.col("version").alias("map_version"))
    )
    number = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("_n", F.row_number().over(number) - 1)
        .join(F.broadcast(placed), "vslot")
        .select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("_n") + F.col("before")).cast("long").alias("slot"), "map_version")
    )
