"""Sharding by vector bin packing.

Rows are packed into shards so that bytes, words and rows come out even at once.
The unit that is placed is a group of rows of equal text. Groups are placed by
falling size, each into the shard where the dot product of its vector with the
shard's residual capacity is highest among the shards that it fits.

Only a group above an even shard in some dimension is cut, by a hash of its rows'
ids, and its pieces are placed one by one; every other group has one home.

The driver packs a number of items that the data's size does not change. A group
that is more than 1 / (shards * parts) of the whole in any dimension stands for
itself: there are at most 3 * shards * parts of those, and at most 3 * shards that
are cut. All other groups are dealt by hash into shards * parts bundles, and a
bundle is one item.

Defined cases: a null text has no bytes, counts as the empty text in its CRC and
is a group with empty texts; rows that repeat are separate rows of one group; items
of equal vectors are placed in the order of their hashes, and of shards that are as
good the first one is taken; with fewer rows than shards some shards stay empty; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm._graph import cut


#: Pieces of a group that is cut.
PIECES = 2048


def pack(vectors: np.ndarray, shards: int, slack: float = 1.002) -> np.ndarray:
    """Shard of each item (row of vectors, in any units)."""
    total = vectors.sum(0).astype(float)
    share = vectors / np.where(total > 0, total, 1) * shards  # of an even shard, in each dimension
    left = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int64)
    # the first dimension decides ties, as its law is promised
    for i in np.lexsort((np.arange(len(vectors)), -share[:, 0], -share.max(1))):
        item = share[i]
        fits = (left[:, 0] + (slack - 1) >= item[0]) & (left > -0.05).all(1)
        score = left @ item
        k = int(np.argmax(np.where(fits, score, -np.inf))) if fits.any() else int(np.argmax(left[:, 0]))
        left[k] -= item
        out[i] = k
    return out


def assign_shards(docs: DataFrame, shards: int = 40, parts: int = 256, rows_per_run: int = 50_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
            F.xxhash64(text).alias("g1"),
            F.xxhash64(text, F.lit(1)).alias("g2"),
        )
    )
    group = ["g1", "g2", "size", "text_crc32"]
    total = rows.agg(F.sum("size"), F.sum("words"), F.count("*")).first()
    whole = [max(1, x or 0) for x in total]
    share = F.greatest(F.col("n") * F.col("size") / whole[0], F.col("n") * F.col("words") / whole[1], F.col("n") / whole[2])
    groups = rows.groupBy(*group, "words").agg(F.count("*").alias("n")).withColumn("share", share)
    own = F.col("share") * shards * parts > 1
    bundle = F.pmod("g1", F.lit(shards * parts))
    sums = [F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum(F.col("n") * F.col("words")).alias("words"), F.sum("n").alias("n")]
    # at most shards * parts bundles, and 3 * shards * parts groups that stand for themselves
    light = groups.where(~own).groupBy(bundle.alias("bundle")).agg(*sums).orderBy("bundle").collect()
    heavy = groups.where(own).orderBy("g1", "g2", "size", "text_crc32").collect()
    spark = docs.sparkSession
    kinds = "g1 long, g2 long, size long, text_crc32 long"
    deal = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(PIECES)).cast("int")
    large = [tuple(r[c] for c in group) for r in heavy if r["share"] * shards > 1]
    pieces = []
    if large:  # at most PIECES for each of 3 * shards groups
        cut_up = rows.join(F.broadcast(spark.createDataFrame(large, kinds)), group, "left_semi").groupBy(*group, "words", deal.alias("piece")).agg(F.count("*").alias("n"))
        pieces = cut_up.orderBy(*group, "piece").collect()
    items = [(None, r["bundle"], r["bytes"], r["words"], r["n"]) for r in light]
    items += [(key, 0, r["n"] * r["size"], r["n"] * r["words"], r["n"]) for r in heavy if (key := tuple(r[c] for c in group)) not in set(large)]
    items += [(tuple(r[c] for c in group), r["piece"], r["n"] * r["size"], r["n"] * r["words"], r["n"]) for r in pieces]
    chosen = pack(np.array([x[2:] for x in items], float).reshape(-1, 3), shards).tolist()
    of_bundle, of_group = [0] * (shards * parts), {}
    for (key, piece, *_), k in zip(items, chosen, strict=True):
        if key is None:
            of_bundle[piece] = k
        else:
            of_group.setdefault(key, {})[piece] = k
    plan = [(*key, [own.get(i, 0) for i in range(PIECES)] if key in set(large) else [own[0]]) for key, own in of_group.items()]
    # as many rows as groups that stand for themselves, which are bounded
    placed = rows.join(F.broadcast(spark.createDataFrame(plan, f"{kinds}, homes array<int>")), group, "left")
    bundles = F.broadcast(spark.createDataFrame([(of_bundle,)], "bundles array<int>"))
    home = F.coalesce(F.element_at("homes", F.pmod(deal, F.size("homes")) + 1), F.element_at("bundles", bundle.cast("int") + 1))
    placed = placed.join(bundles).select("doc_id", "size", "text_crc32", home.alias("shard"))
    # slots: rows are numbered within runs of a shard, and a run starts where the one before it ends
    runs = max(1, -(-int(total[2] or 0) // (shards * rows_per_run)))
    placed = placed.withColumn("run", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(runs)).cast("int"))
    counts = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("shard", "run", F.coalesce("before", F.lit(0)).alias("before"))
    numbered = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")) - 1)
    return numbered.join(before, ["shard", "run"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
