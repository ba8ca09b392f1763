"""Sharding by sampled splitters: near-equal bytes, gapless slots.

Records are ordered by a key that puts equal texts side by side. A size-weighted sample of keys gives quantile
boundaries for many small ranges, which are summed exactly; ranges with too many rows are cut again at quantiles of
their own. Their number is bounded, so ranges grow with the table, and a task sorts one of them. Sums before each range place every record on the line of all bytes, and shards are equal lengths of it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, stage

#: Rows of a range, unless there would be more than MAX_RANGES of them; then their share of all rows.
RANGE_ROWS, MAX_RANGES = 10_000, 20_000
#: Keys drawn for each range, and parts that an overfull range is cut into.
SAMPLES_A_RANGE, CUTS = 32, 16
#: Bits of a key that spread the ids of equal texts, and the rows of equal ids.
ID_BITS, ROW_BITS = 20, 11


def _range_of(bounds: np.ndarray):
    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right").astype("int32"))

    return place


def _splitters(rows: DataFrame, n: int, total: int, range_rows: int, max_ranges: int) -> tuple[np.ndarray, list]:
    """Boundaries of ranges, and (range, rows, bytes) of each that has rows.

    There are max_ranges at first, at most; a range of more than twice its share of rows is cut again, all such ranges in
    one grouped query, and there can be no more of those than half of all. So what the driver holds is bounded.
    """
    parts = int(max(1, min(max_ranges, -(-n // range_rows))))
    most = 2 * max(range_rows, -(-n // parts))
    chance = F.lit(float(SAMPLES_A_RANGE * parts)) * F.col("size") / float(total)
    keys = [r.key for r in rows.where(F.pmod(F.xxhash64("key", "rid", F.lit(7)), F.lit(2**52)) / float(2**52) < chance).select("key").collect()] if parts > 1 else []
    bounds = np.unique(np.quantile(np.array(keys, dtype="int64"), [i / parts for i in range(1, parts)], method="lower")) if keys else np.array([], dtype="int64")
    while True:
        placed = rows.withColumn("rng", _range_of(bounds)("key"))
        sums = placed.groupBy("rng").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        over = [r for r in sums if r.n > most and r.low < r.high]
        if not over:
            return bounds, sorted((r.rng, r.n, r["size"]) for r in sums)
        again = placed.join(F.broadcast(rows.sparkSession.createDataFrame([(r.rng,) for r in over], "rng int")), "rng")
        cut = again.groupBy("rng").agg(F.percentile_approx("key", [i / CUTS for i in range(1, CUTS)], 1000).alias("at")).collect()
        more = [k for r in cut for k in r["at"]] + [k for r in over for k in (r.low + 1, r.high)]
        bounds = np.unique(np.concatenate([bounds, np.array(more, dtype="int64")]))


def shards(docs: DataFrame, count: int = 8, range_rows: int = RANGE_ROWS, max_ranges: int = MAX_RANGES) -> DataFrame:
    """For each row: doc_id, size, text_crc32, law, shard, slot, grown_shard, by the law `bytes`.

    size is the text's UTF-8 bytes plus 1 (a null text has none). Shards are cut where the running sum of sizes passes
    equal steps, so their sizes differ from the mean by less than the largest record's. Slots run from 0 in key order:
    CRC-32 of the text, then a hash of doc_id, then one of the row, so that equal texts stand together and a large group
    of them, be it of one doc_id or of none, is cut like any other. grown_shard is null. Repeated rows each get a
    slot; an empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = stage(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc")).withColumn("rid", F.monotonically_increasing_id()), "sharding-rows")
    bits = lambda c, n: F.pmod(F.xxhash64(c, F.lit(13)), F.lit(1 << n))
    rows = own.withColumn("key", F.shiftleft("crc", ID_BITS + ROW_BITS) + F.shiftleft(bits("doc_id", ID_BITS), ROW_BITS) + bits("rid", ROW_BITS))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(1))).first()
    bounds, sums = _splitters(rows, n, total, range_rows, max_ranges)
    before, at, sized = [], 0, 0
    for rng, many, size in sums:
        before.append((rng, at, sized))
        at, sized = at + many, sized + size
    offsets = docs.sparkSession.createDataFrame(before or [(0, 0, 0)], "rng int, rows_before long, bytes_before long")
    order = W.partitionBy("rng").orderBy("key", "rid")
    run = order.rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("rng", _range_of(bounds)("key")).withColumns({"nth": F.row_number().over(order), "upto": F.sum("size").over(run)})
    middle = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")
    lined = placed.join(F.broadcast(offsets), "rng").select("doc_id", "size", "crc", (F.col("rows_before") + F.col("nth") - 1).alias("rank"), F.least(F.lit(count - 1), F.floor(middle * F.lit(count) / F.lit(2 * total))).cast("int").alias("shard"))
    lined = stage(lined, "sharding-line")
    discard(own)
    firsts = lined.groupBy("shard").agg(F.min("rank").alias("first"))
    return lined.join(F.broadcast(firsts), "shard").select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
