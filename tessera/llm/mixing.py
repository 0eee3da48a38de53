"""Mixing sources to target weights by Pfair scheduling of document blocks."""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import packed_row, row_hash


def pfair_slots(tickets: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period of sum(tickets) slots.

    Block b of a source with a of L tickets is released at floor(b * L / a)
    and due at ceil((b + 1) * L / a). In every slot the released block with
    the earliest deadline runs (ties: the smaller name). As the weights a / L
    add up to one, no block is late, so after any number of slots each source
    has had its weighted share to within less than one block.
    """
    period = sum(tickets.values())
    ready: list[tuple[int, str]] = []
    waiting = [(0, name) for name in sorted(tickets)]
    heapq.heapify(waiting)
    slots: dict[str, list[int]] = {name: [] for name in tickets}
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, name = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[name]) + 1) * period // tickets[name]), name))
        _, name = heapq.heappop(ready)
        slots[name].append(slot)
        heapq.heappush(waiting, (len(slots[name]) * period // tickets[name], name))
    return slots


def exact_tickets(weights: dict[str, int | float | Fraction], max_slots: int) -> dict[str, int]:
    """The smallest whole numbers in the exact ratio of the weights (floats count as the decimals they print as)."""
    exact = {k: Fraction(str(w)) for k, w in weights.items()}
    if bad := sorted(k for k, w in exact.items() if w <= 0):
        raise ValueError(f"target weights must be positive: {bad[:5]}")
    scale = math.lcm(*(w.denominator for w in exact.values()))
    tickets = {k: int(w * scale) for k, w in exact.items()}
    common = math.gcd(*tickets.values()) or 1
    tickets = {k: a // common for k, a in tickets.items()}
    if sum(tickets.values()) > max_slots:
        raise ValueError(f"the target weights have no common period of at most {max_slots} slots; give simpler fractions")
    return tickets


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str | None, int | float | Fraction] | None = None,
    resolution: int = 64,
    block_docs: int = 4,
    bucket_rows: int = 20_000,
    max_sources: int = 100_000,
    max_slots: int = 1_000_000,
) -> DataFrame:
    """Every input row as ``row`` (a struct) with its place in the mixture.

    Columns: doc_id, source_key, block, block_offset, slot, release, deadline
    and mix_order (slot * block_docs + block_offset; sort by it to read the
    mixture). Rows of a source are put into the order of md5(id), then id, and
    cut into blocks of ``block_docs`` rows; block slots come from pfair_slots.
    A source that runs out leaves its later slots empty; no row is dropped or
    repeated.

    weights: target weight by source name (None for the null source), as
    numbers or Fractions; they are met exactly: after any number of slots each
    source is less than one block off its share. ValueError is raised unless
    every source has a positive weight and the period, the sum of the weights
    as smallest whole numbers, is at most ``max_slots``.

    By default weights go with the square root of a source's rows, rounded
    down to one part in ``resolution`` of the largest, at least one part; here
    the bound of one block holds for the rounded weights.

    ValueError is raised beyond ``max_sources`` sources, since the period is
    laid out on the driver.

    The rank inside a source needs no window over a whole source: rows fall
    into md5-prefix buckets of about ``bucket_rows``, ranks are taken per
    bucket and offset by the bucket counts before it. Null sources form a
    source of their own; null ids rank first; repeated rows get one place each,
    in the order of a hash of the row. Rows that share an id are ranked by one
    task.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    counts = {r["k"]: r["n"] for r in docs.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect()}
    if len(counts) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    if weights is None:
        share = {k: math.sqrt(n) for k, n in counts.items()}
        top = max(share.values(), default=1.0)
        tickets = {k: max(1, math.floor(resolution * w / top)) for k, w in share.items()}
    else:
        given = {"n" if k is None else "s" + k: w for k, w in weights.items()}
        if missing := sorted(set(counts) - set(given)):
            raise ValueError(f"no target weight for sources {missing[:5]}")
        tickets = exact_tickets({k: given[k] for k in counts}, max_slots)
    period = sum(tickets.values())
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(k, tickets[k], places) for k, places in pfair_slots(tickets).items()],
        "source_key string, tickets long, places array<long>",
    )

    largest = max(counts.values(), default=1)
    digits = max(1, math.ceil(math.log(max(largest / bucket_rows, 1), 16)))
    mark = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(
        packed_row(docs).alias("row"), F.col(id_col).alias("doc_id"), key.alias("source_key"), mark.alias("mark"), row_hash(docs).alias("tie")
    ).withColumn("bucket", F.substring("mark", 1, digits))
    sizes = rows.groupBy("source_key", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("source_key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("mark", "doc_id", "tie")
    ranked = (
        rows.withColumn("rank", F.row_number().over(inside) - 1)
        .join(offsets, ["source_key", "bucket"])
        .join(F.broadcast(plan), "source_key")  # at most max_sources rows
        .withColumn("at", F.col("base") + F.col("rank"))
        .withColumn("block", F.expr(f"at div {block_docs}"))
        .withColumn("block_offset", F.expr(f"at % {block_docs}"))
        .withColumn("slot", F.expr(f"(block div tickets) * {period} + get(places, cast(block % tickets as int))"))
    )
    return ranked.select(
        "row",
        "doc_id",
        "source_key",
        "block",
        "block_offset",
        "slot",
        F.expr(f"(block * {period}) div tickets").alias("release"),
        F.expr(f"((block + 1) * {period} + tickets - 1) div tickets").alias("deadline"),
        F.expr(f"slot * {block_docs} + block_offset").alias("mix_order"),
    )
