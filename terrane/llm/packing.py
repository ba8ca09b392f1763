"""Conflict-constrained best-fit packing.

Pieces go, longest first, to the fullest bin that still holds them and that has neither a document of their source nor
one of their duplicate cluster. Bins stand in a tree over their residual space; each node keeps the bits that all bins
below it have, so the search for the successor of a length skips what cannot be compatible, however many bins a common
source has filled, and continues until the tightest compatible bin is found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import stage

CAPACITY = 2048
#: Documents that are packed together; groups are dealt by a hash of doc_id.
GROUP_DOCS = 16_384


class Bins:
    """Bins of one capacity by residual; masks are integers with a bit for each source and duplicate cluster."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.common = [-1] * (2 * self.leaves)  # bits of all bins below; none below: all bits
        self.at: list[dict[int, list[int]]] = [{} for _ in range(self.leaves)]  # residual: mask: bins

    def _lift(self, leaf: int) -> None:
        bits = -1
        for mask in self.at[leaf]:
            bits &= mask
        node = leaf + self.leaves
        while node and self.common[node] != bits:
            self.common[node] = bits
            node >>= 1
            if node:
                bits = self.common[2 * node] & self.common[2 * node + 1]

    def add(self, bin_: int, residual: int, mask: int) -> None:
        same = self.at[residual].setdefault(mask, [])
        same.append(bin_)
        if len(same) == 1:
            self._lift(residual)

    def take(self, need: int, mask: int) -> tuple[int, int, int] | None:
        """Remove and return (bin, residual, mask) of least residual >= need whose mask shares no bit with mask."""
        node, todo = 1, []
        low, high = 0, self.leaves
        todo.append((node, low, high))
        while todo:
            node, low, high = todo.pop()
            if high <= need or self.common[node] & mask:
                continue
            if node >= self.leaves:
                for held in self.at[low]:
                    if not held & mask:
                        bins = self.at[low][held]
                        bin_ = bins.pop()
                        if not bins:
                            del self.at[low][held]
                            self._lift(low)
                        return bin_, low, held
                continue
            mid = (low + high) // 2
            todo.append((2 * node + 1, mid, high))
            todo.append((2 * node, low, mid))
        return None


def pack(lengths: list[int], sources: list[str], clusters: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, piece, bin, offset, length) of every piece; a document over the capacity is cut into whole bins and a rest.

    Documents of no length have no piece. Ties are taken in the order given.
    """
    out, pieces, bins, new = [], [], Bins(capacity), 0
    source_bit = {s: i for i, s in enumerate(dict.fromkeys(sources))}
    seen: dict[int, int] = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    cluster_bit = {c: len(source_bit) + i for i, c in enumerate(c for c, n in seen.items() if n > 1)}
    for d, n in enumerate(lengths):
        full, rest = divmod(n, capacity)
        for p in range(full):
            out.append((d, p, new, 0, capacity))
            new += 1
        if rest:
            pieces.append((rest, d, full))
    pieces.sort(key=lambda x: -x[0])
    for n, d, p in pieces:
        mask = 1 << source_bit[sources[d]]
        if clusters[d] in cluster_bit:
            mask |= 1 << cluster_bit[clusters[d]]
        if got := bins.take(n, mask):
            bin_, residual, held = got
        else:
            bin_, residual, held, new = new, capacity, 0, new + 1
        out.append((d, p, bin_, capacity - residual, n))
        if residual > n:
            bins.add(bin_, residual - n, held | mask)
    return out


def _lengths(docs: DataFrame, group) -> DataFrame:
    """Staged rows (doc_id, source, cluster, row, n): a hash of the column group, the row's number where doc_id is null, the words between white space."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", source.alias("source"), F.xxhash64(group).alias("cluster"), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("row"), F.col("text").cast("binary").alias("text"))

    def count(batches):
        for b in batches:
            n = [len(t.split()) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "n"])

    return stage(rows.mapInArrow(count, rows.drop("text").schema.add("n", "long")), "packing-lengths")


def best_fit(docs: DataFrame, capacity: int = CAPACITY, cluster: str | None = None, group_docs: int = GROUP_DOCS) -> DataFrame:
    """(doc_id, source, cluster, piece, bin_id, bin_offset, n_words): where each piece of each document goes.

    Lengths are words between white space. cluster names a column of duplicate clusters; without it texts that are
    equal form one. Documents are dealt to groups of about group_docs by a hash of doc_id, or of the row's
    number where it is null, each packed by itself, so bins never span groups. A document without words has one row without a bin. A null source counts as a source of
    its own; repeated rows are documents of their own; empty docs give an empty result.
    """
    rows = _lengths(docs, F.col(cluster).cast("string") if cluster else F.coalesce(F.col("text"), F.lit("")))
    return _packed(rows, max(1, -(-rows.count() // group_docs)), capacity)


def _packed(rows: DataFrame, groups: int, capacity: int) -> DataFrame:
    """best_fit of rows (doc_id, source, cluster, row, n) in so many groups."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "cluster", "n"], kind="stable")
        ids, lengths, clusters = pdf["doc_id"].tolist(), pdf["n"].tolist(), pdf["cluster"].tolist()
        sources = [s if isinstance(s, str) else None for s in pdf["source"]]
        base = int(pdf["grp"].iloc[0]) << 32
        got = pack(lengths, sources, clusters, capacity)
        out = pd.DataFrame([(ids[d], sources[d], clusters[d], p, base + b, o, n) for d, p, b, o, n in got] + [(i, s, c, 0, None, None, 0) for i, s, c, n in zip(ids, sources, clusters, lengths) if not n], columns=["doc_id", "source", "cluster", "piece", "bin_id", "bin_offset", "n_words"])
        for c in ("doc_id", "bin_id", "bin_offset"):
            out[c] = out[c].astype("Int64")
        return out

    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.lit(11), "row"), F.lit(groups))).drop("row")
    return dealt.groupBy("grp").applyInPandas(run, "doc_id long, source string, cluster long, piece long, bin_id long, bin_offset long, n_words long")


def of_copies(docs: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """best_fit with the groups of exact and near copies as clusters; a row without doc_id is in a cluster of its own text."""
    roots = simhash.copies(docs).withColumnsRenamed({"doc_id": "copy_id", "root": "copy_root"})
    own = _lengths(docs, F.concat(F.lit("text "), F.coalesce(F.col("text"), F.lit(""))))
    grouped = F.coalesce(F.when(F.col("copy_root").isNotNull(), F.xxhash64(F.concat(F.lit("root "), F.col("copy_root").cast("string")))), F.col("cluster"))
    rows = own.join(roots, F.col("doc_id") == F.col("copy_id"), "left").withColumn("cluster", grouped)
    return _packed(rows, max(1, -(-own.count() // group_docs)), capacity)
