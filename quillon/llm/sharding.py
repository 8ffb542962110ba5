"""3. Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Every row has a place on a ring of 2**32 points, from md5 of its id, size and checksum. Each shard owns ``vnodes`` points
of the ring; a row belongs to the next owned point clockwise. A shard takes at most its capacity, and what overflows
continues clockwise to the next point whose shard has room. Capacities differ by one at most and add up to the number
of rows, so the law ``rows`` holds: counts are at most one apart.

The walk around the ring needs only row counts in ``cells`` equal stretches of the ring, so the driver sees a table of
fixed size, whatever the input: it turns the counts into ranges of ranks, each with a shard and its first slot. Rows
then need just their rank within their cell (one window over evenly hashed cells) and a join with those ranges, at most
``cells + 2 * shards * vnodes + shards`` of them, which is why they are broadcast.

Edge cases: a null text has size 1 and checksum 0; null ids are allowed (the checksum spreads them); identical rows are
interchangeable and get different slots; an empty table gives no rows; fewer rows than shards leave shards empty. Extra
columns stay; ``size text_crc32 shard slot`` overwrite columns of these names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARDS = 8
VNODES = 64
CELL_BITS = 14
RING_BITS = 32


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place on the ring, shard), in ring order."""
    place = lambda s, v: int(hashlib.md5(f"shard-{s}/{v}".encode()).hexdigest()[:8], 16)
    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


def allocate(counts: dict[int, int], shards: int, vnodes: int, cell_bits: int = CELL_BITS) -> list[tuple[int, int, int, int, int]]:
    """(cell, from rank, to rank, shard, first slot) for rows that are ranked within each cell from 0.

    Points are rounded up to cell edges, so a whole cell belongs to one point. In a first round each point hands its own
    shard as many of its rows as fit, in ring order; in a second round what is left continues clockwise.
    """
    n = sum(counts.values())
    points = ring_points(shards, vnodes)
    shift = RING_BITS - cell_bits
    edges = [(p + (1 << shift) - 1) >> shift for p, _ in points]
    first_shards = list(dict.fromkeys(s for _, s in points))
    room = dict.fromkeys(range(shards), n // shards)
    for s in first_shards[: n % shards]:
        room[s] += 1
    used = dict.fromkeys(range(shards), 0)
    out: list[tuple[int, int, int, int, int]] = []

    def give(cell: int, lo: int, hi: int, shard: int) -> int:
        k = min(hi - lo, room[shard] - used[shard])
        if k > 0:
            out.append((cell, lo, lo + k, shard, used[shard]))
            used[shard] += k
        return lo + max(k, 0)

    left = []
    at = 0
    for cell in sorted(counts):
        while at < len(edges) and edges[at] <= cell:
            at += 1
        point = at % len(points)
        lo = give(cell, 0, counts[cell], points[point][1])
        if lo < counts[cell]:
            left.append((cell, lo, point))
    for cell, lo, point in left:
        step = point
        while lo < counts[cell]:
            step = (step + 1) % len(points)
            lo = give(cell, lo, counts[cell], points[step][1])
    return out


def with_size(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with size (UTF-8 bytes plus 1) and text_crc32."""
    raw = F.col(text_col).cast("binary")
    return docs.withColumns({"size": F.coalesce(F.octet_length(raw), F.lit(0)).cast("long") + 1, "text_crc32": F.coalesce(F.crc32(raw), F.lit(0).cast("long"))})


def shard_sized(sized: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, id_col: str = "doc_id") -> DataFrame:
    """Rows that have size and text_crc32, with shard and slot."""
    step = 1 << (RING_BITS - CELL_BITS)
    key = F.md5(F.concat_ws("/", F.coalesce(F.col(id_col).cast("string"), F.lit("")), "size", "text_crc32").cast("binary"))
    placed = sized.drop("shard", "slot").withColumn("_key", key)
    placed = placed.withColumn("_cell", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") / step).cast("int"))
    counts = {r[0]: r[1] for r in placed.groupBy("_cell").count().collect()}  # at most 2**CELL_BITS rows
    ranges = sized.sparkSession.createDataFrame(allocate(counts, shards, vnodes), "_cell int, _lo long, _hi long, shard int, _slot long")
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy("_key")).cast("long") - 1)
    out = ranked.join(F.broadcast(ranges), ["_cell"]).where("_lo <= _rank AND _rank < _hi")
    return out.withColumn("slot", F.col("_slot") + F.col("_rank") - F.col("_lo")).drop("_cell", "_key", "_lo", "_hi", "_slot", "_rank")


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with size, text_crc32, shard and slot."""
    return shard_sized(with_size(docs, text_col), shards, vnodes, id_col)


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    small = with_size(docs).drop("text")
    out = shard_sized(small, SHARDS, VNODES)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op3_shard": (op3_shard, None)}
