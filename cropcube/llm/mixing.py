"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share the corpus' words; a target stops at REPEATS times
its source's words and the excess is shared again. Words go to sources by highest quotients (target / (2 seats + 1)), then each
source's words go to its shards the same way, by the shards' words, so every quota is a whole number: first in equal blocks, then what is
left in shorter last blocks, so sources of any size come to their target. A shard's documents lie on a ring in a seeded order, and its blocks are cut from the ring, one behind the other, from
a seeded place on; a shard with more blocks than words goes round again. So words are repeated evenly, and no document beyond
REPEATS times.

A source has up to SHARDS shards, so its shards fit one task, and the driver sees one row for each source (a mix is declared
by source). Documents are never gathered by source. Null and blank texts have size 0 and are never taken, texts of any length count
whole, and an empty table gives no rows. Rows of one seeded hash follow by id, size and hash of the text; rows that are equal in
all of these are mixed one by one, and it does not matter which of them is which. So reruns agree.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cropcube.llm.shared import Scratch
from cropcube.session import ship

WEIGHTS = (5, 2, 1)
REPEATS = 3
SHARD_DOCS = 500
SHARDS = 4096
#: Sources up to which the table of sources is broadcast.
SMALL_SOURCES = 10_000
SEED = 17


def targets_of(sizes: Sequence[int], weights: Sequence[float], repeats: int = REPEATS) -> list[float]:
    """Shares of all sizes by weight; those above ``repeats`` times their size stop there, the rest is shared again."""
    out = [0.0] * len(sizes)
    free, left = list(range(len(sizes))), float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > repeats * sizes[i]]
        for i in full or free:
            out[i] = float(repeats * sizes[i]) if full else unit * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return out


def sainte_lague(shares: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients share / (2 seats + 1), none above ``most``; ties go to the first.

    The quotients above a common divisor are counted at once, and only the last few seats are given one by one.
    """
    shares, most = np.asarray(shares, float), np.asarray(most, np.int64)
    seats = int(min(seats, most[shares > 0].sum()))
    got = np.zeros(len(shares), np.int64)
    if seats <= 0:
        return got
    low, high = 0.0, 4 * shares.max() + 1.0  # divisors: at low everyone is full, at high none has a seat
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if np.minimum(most, np.floor(shares / mid + 0.5)).sum() > seats:
            low = mid
        else:
            high = mid
    got = np.minimum(most, np.floor(shares / high + 0.5)).astype(np.int64)
    queue = [(-shares[i] / (2 * got[i] + 1), i) for i in range(len(shares)) if got[i] < most[i] and shares[i] > 0]
    heapq.heapify(queue)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(queue, (-shares[i] / (2 * got[i] + 1), i))
    return got


def block_size(total: int, sources: int) -> int:
    """Words of a block: a thousandth of a source's even share, from 8 to 256."""
    return int(min(256, max(8, total // (1000 * max(1, sources)))))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    repeats: int = REPEATS,
    seed: int = SEED,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs``' columns ``keep`` (all if None) and ``size``, ``source_size``, ``target``, ``taken``; columns of these names are replaced."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "mixing")
    named = ["size", "source_size", "target", "taken"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in named]
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    src = F.when(F.col(source_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source_col).cast("string")))
    rows = docs.select(
        *[F.col(c) for c in keep], src.alias("cc_src"), size.alias("size"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("cc_h"), F.col(id_col).alias("cc_id"), F.xxhash64(F.col(text_col)).alias("cc_t")
    )
    rows = scratch.table(rows)

    totals = rows.groupBy("cc_src").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    totals.sort(key=lambda r: (r.cc_src == "0", r.cc_src))
    sizes = [r["size"] for r in totals]
    wanted = targets_of(sizes, [weights[i % len(weights)] for i in range(len(totals))], repeats)
    block = block_size(sum(sizes), len(sizes))
    quota = sainte_lague(np.array(wanted), sum(sizes), np.array([repeats * s for s in sizes], np.int64)) if totals else []
    seats = {r.cc_src: int(q) for r, q in zip(totals, quota, strict=True)}

    plan = [(r.cc_src, s, t, min(SHARDS, -(-r.n // SHARD_DOCS))) for r, s, t in zip(totals, sizes, wanted, strict=True)]
    sources = spark.createDataFrame(plan, "cc_src string, source_size long, target double, cc_shards int")
    if len(plan) <= SMALL_SOURCES:
        sources = F.broadcast(sources)
    dealt = rows.join(sources, "cc_src").withColumn("cc_shard", F.pmod(F.shiftright("cc_h", 20), "cc_shards").cast("int"))

    def quotas(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cc_shard").reset_index(drop=True)
        words = pdf["cc_words"].to_numpy(np.int64)
        taken = sainte_lague(words.astype(float), seats[key[0]] // block, repeats * words // block) * block
        pdf["cc_taken"] = taken + sainte_lague(words.astype(float), seats[key[0]] - int(taken.sum()), repeats * words - taken)
        return pdf

    shards = dealt.groupBy("cc_src", "cc_shard").agg(F.sum("size").alias("cc_words"))
    shards = shards.groupBy("cc_src").applyInPandas(quotas, "cc_src string, cc_shard int, cc_words long, cc_taken long")

    ring = Window.partitionBy("cc_src", "cc_shard").orderBy("cc_h", "cc_id", "size", "cc_t").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(shards, ["cc_src", "cc_shard"]).withColumn("cc_end", F.sum("size").over(ring)).withColumn("cc_start", F.col("cc_end") - F.col("size"))
    out = out.withColumn("cc_off", F.when(F.col("cc_words") > 0, F.pmod(F.xxhash64(F.lit(seed), "cc_src", "cc_shard"), "cc_words")).otherwise(0))
    out = out.withColumn("cc_rest", F.when(F.col("cc_words") > 0, F.pmod("cc_taken", "cc_words")).otherwise(0))
    rounds = F.when(F.col("cc_words") > 0, F.expr("cc_taken div cc_words")).otherwise(0)
    part = F.expr("greatest(0L, least(cc_end, least(cc_off + cc_rest, cc_words)) - greatest(cc_start, cc_off))")
    over = F.expr("greatest(0L, least(cc_end, cc_off + cc_rest - cc_words) - cc_start)")
    return out.select(*keep, "size", "source_size", "target", (rounds * F.col("size") + part + over).alias("taken"))
