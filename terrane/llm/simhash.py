"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has 64 bits, cut into three ring segments. Two fingerprints at most two bits apart have, by the strong
pigeonring principle, a segment from which every run of l consecutive segments differs in at most 2*l/3 bits: the first
is equal, the first two differ in at most one bit, all three in at most two. An equi-join on segments finds the starts,
the chain's budgets prune, the full Hamming distance decides.

Near copies of a Jaccard similarity of 0.8 lie about ten of 64 bits apart, which no budget that prunes can promise to
catch. So `copies` takes the pigeonring's links first, on fingerprints of five-word shingles and each checked by the
similarity of the texts, which joins the closest copies at little cost, and then finds all that is left by prefix
filtering, which is exact: in any common order of shingles, two texts of similarity 0.8 share one among the first fifth
of each. Only shingles that stand in texts of several components are looked at. Every pair is checked once.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, forest, release, stage

SEGMENTS = ((0, 21), (21, 21), (42, 22))
MAX_BITS = 2
#: A segment value with more fingerprints than this is linked by masked keys instead of pairs.
HOT_SEGMENT = 1024

#: Near copies share this much of their distinct shingles of so many words; in ninths, 9 * shared >= 4 * (both sizes).
SIMILARITY, VERIFIED_SHINGLE = 0.8, 5
#: Texts that share a shingle are paired off up to so many; more are compared in blocks of so many texts, all with all.
PAIRED, BLOCK = 32, 512
#: Shingles that come last in the order of the prefix filter: so many at most, the most common ones of so many texts.
COMMON_MOST, COMMON_TEXTS = 1 << 16, 5000
#: Shingles of prefixes that a task sends on at once; words of a text hashed at once; shingles compared at once in a block.
PREFIX_ROWS, PIECE_WORDS, COLUMNS = 1 << 18, 1 << 15, 1 << 13
#: Bytes of short texts hashed at once, and texts a task holds the shingles of meanwhile. Prefixes are dealt by shingle to so many parts at least, one for so many bytes of text.
TOGETHER, HELD, PARTS, PART_BYTES = 1 << 17, 256, 32, 1 << 25
#: Rows that Python functions get at once while copies are sought: what a task holds of texts on both sides doesn't grow with its partition.
BATCH_ROWS = 2048
#: Columns of a part of the prefixes: its shingles with their places in the prefix; of its texts the nodes, keys, sizes and counts of shingles.
DEALT = ("vals", "places", "nodes", "keys", "sizes", "counts")
#: Longs of the bitmap of a text's shingles, a power of two (texts with more shingles than half its bits have a wide one too); sets of shingles that a task keeps while it checks pairs.
BITMAP_WORDS, KEPT_SETS = 16, 512
# Rolling hashes of byte ranges: a number for each byte, an odd base and its inverse modulo 2**64; and what mixes them.
BYTES = np.random.default_rng(20240301).integers(0, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: A-Z lower-cased, the blanks that part words made spaces.
FOLD = bytes(32 if c in b"\t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, k: int) -> list[int]:
    """XXH64 (seed 42) of the k-word shingles, repeats included, words lower-cased in A-Z; fewer words: one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [h(b" ".join(words), 42)] if words else []
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return [h(joined[s:e], 42) for s, e in zip(starts, ends[k - 1 :])]


def fingerprint(hashes: list[int]) -> int:
    """As a signed long: a bit is 1 if it is set in over half the hashes; no hashes: zero."""
    if not hashes:
        return 0
    votes, per = np.zeros(64, dtype=np.int64), 1 << 16
    for i in range(0, len(hashes), per):
        part = np.array(hashes[i : i + per], dtype="<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp): one row per input row. Null or blank text: fingerprint zero."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.array([fingerprint(shingle_hashes(t, k)) for t in b["text"]], dtype="int64")})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fp long")


def _segment(fp, i: int):
    at, width = SEGMENTS[i]
    return F.shiftright(fp, at).bitwiseAND((1 << width) - 1)


def _segments(fps: DataFrame) -> DataFrame:
    return fps.select("fp", F.posexplode(F.array(*[_segment(F.col("fp"), i) for i in range(len(SEGMENTS))])).alias("seg", "val"))


def masked_links(members: DataFrame) -> DataFrame:
    """Links within hot segment values, (seg, val, fp) to edges (a, b), without pairs.

    Fingerprints of equal masked value, two bits outside the shared segment being cleared, differ in those two at
    most, so each is linked to the least of its key; any pair at most two bits apart shares a key. Rows are linear in
    the members: one for each choice of two of the 42 or 43 other bits.
    """
    masks = []
    for at, width in SEGMENTS:
        free = [b for b in range(64) if not at <= b < at + width]
        masks.append(np.array([~((1 << x) | (1 << y)) & (2**64 - 1) for i, x in enumerate(free) for y in free[i + 1 :]], dtype=np.uint64).view(np.int64))

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 200):
                part = b.iloc[i : i + 200]
                for seg, g in part.groupby("seg"):
                    m, fp = masks[seg], g["fp"].to_numpy()
                    yield pd.DataFrame({"mask": np.tile(m, len(fp)), "key": (fp[:, None] & m[None, :]).ravel(), "fp": np.repeat(fp, len(m))})

    keyed = members.select("seg", "fp").mapInPandas(run, "mask long, key long, fp long")
    least = keyed.groupBy("mask", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("mask", "key", "a")
    return keyed.join(least, ["mask", "key"]).where("fp > a").select("a", F.col("fp").alias("b"))


def _sized(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys others have too, with their number n."""
    return rows.join(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), keys)


def _pairs(rows: DataFrame, keys: list[str], chain) -> DataFrame:
    """Pairs (a, b) of fingerprints with equal keys whose chain is within its budgets, and then all their bits."""
    a, b = rows.select(*keys, F.col("fp").alias("a")), rows.select(*keys, F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    return a.join(b, keys).where(F.col("a") < F.col("b")).where(chain(x)).where(F.bit_count(x) <= MAX_BITS).select("a", "b")


def links(fps: DataFrame, hot: int = HOT_SEGMENT) -> DataFrame:
    """Edges (a, b) that link the same distinct fingerprints as all pairs of at most MAX_BITS differing bits.

    Segments that more than `hot` fingerprints share are joined on the chain's next step too: the following segment with
    one bit cleared, 21 or 22 rows a fingerprint; what is as crowded even there is linked by masked keys.
    """
    one = 2 * MAX_BITS // len(SEGMENTS)

    def by_seg(of):
        return F.when(F.col("seg") == 0, of(0)).when(F.col("seg") == 1, of(1)).otherwise(of(2))

    following = lambda v: by_seg(lambda i: _segment(v, (i + 1) % len(SEGMENTS)))
    keyed = stage(_sized(_segments(fps), ["seg", "val"]), "simhash-segments")
    pairs = _pairs(keyed.where(F.col("n") <= hot), ["seg", "val"], lambda x: F.bit_count(following(x)) <= one)
    bits = F.sequence(F.lit(0), by_seg(lambda i: F.lit(SEGMENTS[(i + 1) % len(SEGMENTS)][1] - 1)))
    chained = keyed.where(F.col("n") > hot).select("seg", "val", "fp", F.explode(bits).alias("bit"))
    chained = chained.withColumn("then", following(F.col("fp")).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")))))
    chained = stage(_sized(chained, ["seg", "val", "bit", "then"]), "simhash-chains")
    pairs = pairs.unionByName(_pairs(chained.where(F.col("n") <= hot), ["seg", "val", "bit", "then"], lambda x: F.lit(True)))
    return pairs.unionByName(masked_links(chained.where(F.col("n") > hot).select("seg", "val", "fp").distinct())).distinct()


def near_duplicates(docs: DataFrame, k: int = 3, hot: int = HOT_SEGMENT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    component_id is the smallest doc_id reachable over fingerprints at most two bits apart, the row's own included.
    Null and blank texts have fingerprint zero and link like any other; repeated rows each give a row; a null doc_id
    counts in no minimum; an empty table gives an empty result; other columns are not read.
    """
    own = stage(fingerprints(docs, k), "simhash-fps")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), hot), "simhash-links")
    marked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = marked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = marked.join(least, "root").select("fp", "component_id")
    return own.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as far as they have been asked for."""

    def __init__(self):
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def to(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(n - 1, base, dtype=np.uint64)), dtype=np.uint64) for base in (BASE, pow(BASE, -1, 2**64)))


def folded(text: str | None) -> bytes:
    """The words of a text, lower-cased in A-Z, one space between two."""
    out = (text or "").encode("utf-8", "replace").translate(FOLD)
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out.strip(b" ")


def freed(df: DataFrame, label: str) -> DataFrame:
    """df staged, and the shuffle files that went into it released."""
    out = stage(df, label)
    release(df.sparkSession)
    return out


@contextmanager
def in_batches(spark, rows: int = BATCH_ROWS):
    """Meanwhile Python functions get so many rows at once, or fewer if the session has it so."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shingle_set(words: bytes, powers: Powers) -> np.ndarray:
    """Ascending distinct hashes, as signed longs, of the shingles of VERIFIED_SHINGLE words of a folded text; fewer words: the whole; none: none."""
    if not words:
        return np.zeros(0, dtype=np.int64)
    data = np.frombuffer(words, dtype=np.uint8)
    gaps = np.flatnonzero(data == 32)
    k = min(VERIFIED_SHINGLE, len(gaps) + 1)
    starts, ends = np.append(0, gaps + 1)[: len(gaps) + 2 - k], np.append(gaps, len(data))[k - 1 :]
    out = []
    for i in range(0, len(starts), PIECE_WORDS):
        s, e = starts[i : i + PIECE_WORDS], ends[i : i + PIECE_WORDS]
        first = s[0]
        powers.to(int(e[-1] - first))
        sums = np.cumsum(BYTES[data[first : e[-1]]] * powers.up[: e[-1] - first], dtype=np.uint64)
        s, e = s - first, e - first
        x = (sums[e - 1] - np.where(s > 0, sums[s - 1], np.uint64(0))) * powers.down[s]
        x = (x ^ (x >> np.uint64(30))) * MIX[0]
        x = (x ^ (x >> np.uint64(27))) * MIX[1]
        out.append(x ^ (x >> np.uint64(31)))
    return np.unique(np.concatenate(out).view(np.int64))


def shingle_sets(texts: list[bytes], powers: Powers) -> list[np.ndarray]:
    """The shingle_set of each folded text; short texts are hashed together, up to TOGETHER bytes at once."""
    out, group, held = [], [], 0
    for i, t in enumerate(texts):
        alone = not t or len(t) > TOGETHER // 2
        out.append(shingle_set(t, powers) if alone else None)
        if not alone:
            group.append(i)
            held += len(t) + 1
        if group and (held > TOGETHER // 2 or i + 1 == len(texts)):
            _hash_together(texts, group, powers, out)
            group, held = [], 0
    if group:
        _hash_together(texts, group, powers, out)
    return out


def _hash_together(texts: list[bytes], group: list[int], powers: Powers, out: list) -> None:
    """Put the shingle_set of the texts of the group, none of them empty, into out."""
    k, data = VERIFIED_SHINGLE, np.frombuffer(b" ".join([texts[i] for i in group]), dtype=np.uint8)
    powers.to(len(data) + 1)
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTES[data] * powers.up[: len(data)], dtype=np.uint64, out=sums[1:])
    s, e = starts[: max(0, len(starts) + 1 - k)], ends[k - 1 :]
    x = (sums[e] - sums[s]) * powers.down[s]
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    x = (x ^ (x >> np.uint64(31))).view(np.int64)
    first = np.searchsorted(starts, np.cumsum([0, *[len(texts[i]) + 1 for i in group[:-1]]])).tolist()
    for i, a, z in zip(group, first, [*first[1:], len(starts)]):
        if z - a < k:
            out[i] = shingle_set(texts[i], powers)
            continue
        h = np.sort(x[a : z - k + 1])
        new = h[1:] != h[:-1]
        out[i] = h if new.all() else h[np.append(True, new)]


def set_fingerprint(shingles: np.ndarray) -> int:
    """The 64-bit SimHash of distinct hashes: votes of each eighth bit are counted in the bytes of a long, 255 hashes at once."""
    if not len(shingles):
        return 0
    eighths = (shingles.view(np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(0x0101010101010101)
    sums = np.add.reduceat(eighths, np.arange(0, len(shingles), 255), axis=0)
    votes = sums.view(np.uint8).reshape(-1, 8, 8).sum(0, dtype=np.int64).T.reshape(64)
    return int(np.packbits(2 * votes > len(shingles), bitorder="little").view("<i8")[0])


def set_bits(shingles: np.ndarray, longs: int = BITMAP_WORDS) -> np.ndarray:
    """So many longs, a power of two, with a bit for each hash: what sets no bit of another text's cannot be shared with it."""
    bits = np.zeros(64 * longs, dtype=bool)
    bits[shingles & (64 * longs - 1)] = True
    return np.packbits(bits, bitorder="little").view("<i8")


def wide_bits(shingles: np.ndarray) -> np.ndarray | None:
    """A bitmap of two to four bits a shingle, where the one of BITMAP_WORDS longs has fewer: that would be too full to rule out much."""
    longs = 1 << max(0, -(-2 * len(shingles) // 64) - 1).bit_length()
    return set_bits(shingles, longs) if longs > BITMAP_WORDS else None


def _dealt(sets: list[np.ndarray], texts: list[tuple[int, int, int]], parts: int) -> pd.DataFrame:
    """Prefixes, and node, key and size of their texts, as bytes: a row for each part that a shingle falls in.

    A part's shingles stand text by text: nodes, keys, sizes and counts have an entry for each of its texts.
    """
    counts = [len(x) for x in sets]
    val, text = np.concatenate(sets), np.repeat(np.arange(len(sets)), counts)
    place = np.arange(len(val), dtype=np.int32) - np.repeat(np.cumsum([0, *counts[:-1]], dtype=np.int32), counts)
    part = (val.view(np.uint64) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    val, text, place, part = val[order], text[order], place[order], part[order]
    run = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (part[1:] != part[:-1])))
    of = np.array(texts, dtype=np.int64)[text[run]]
    size, count = of[:, 2].astype(np.int32), np.diff(np.append(run, len(val))).astype(np.int32)
    out, used = [], np.unique(part)
    ends = np.searchsorted(part, used, "right").tolist()
    for p, a, z in zip(used.tolist(), [0, *ends[:-1]], ends):
        i, j = np.searchsorted(run, [a, z])
        out.append((p, val[a:z].tobytes(), place[a:z].tobytes(), of[i:j, 0].tobytes(), of[i:j, 1].tobytes(), size[i:j].tobytes(), count[i:j].tobytes()))
    return pd.DataFrame(out, columns=["pos", *DEALT])


def sketches(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], parts: int = PARTS) -> DataFrame:
    """Of each text (node, text) a row (node, size, words, fp, bits, wide) with pos -1, and its prefix's shingles, dealt to parts as bytes, with the part as pos; in one table.

    words is a hash of the word sequence, equal for exact copies. The prefix is the first floor(size / 5) + 1 of its size
    shingles, those not common first, then by hash. Texts of similarity 0.8 share at least four fifths of the larger
    set, so neither prefix can miss all they share.
    """
    sent = texts.sparkSession.sparkContext.broadcast(common)  # 1 MB at most
    marked, filled = ["node", "size", "words", "fp", "bits", "wide"], 1 << 20

    def frame(df: pd.DataFrame, **more) -> pd.DataFrame:
        return df.assign(**more)[[*marked, "pos", *DEALT]]

    def read(b: pd.DataFrame, powers: Powers):
        for i in range(0, len(b), HELD):
            own = [folded(t) for t in b["text"].iloc[i : i + HELD]]
            yield from zip(b["node"].iloc[i : i + HELD].tolist(), own, shingle_sets(own, powers))

    def run(batches):
        (vals, counts), powers = sent.value, Powers()
        maybe = np.zeros(filled, dtype=bool)
        maybe[vals & (filled - 1)] = True
        for b in batches:
            out, prefixes, named, rows = [], [], [], 0
            for node, t, h in read(b, powers):
                n, digest = min(len(h), len(h) // 5 + 1), xxhash.xxh128_digest(t)
                out.append((node, len(h), digest.hex(), set_fingerprint(h), set_bits(h), wide_bits(h)))
                if n and len(vals):
                    at = np.flatnonzero(maybe[h & (filled - 1)])
                    found = np.minimum(np.searchsorted(vals, h[at]), len(vals) - 1)
                    rank = np.zeros(len(h), dtype=np.int64)
                    rank[at] = np.where(vals[found] == h[at], counts[found], 0)
                    rare = np.flatnonzero(rank == 0)
                    h = h[rare[:n]] if len(rare) >= n else h[np.argsort(rank, kind="stable")]
                if n:
                    prefixes.append(h[:n])
                    named.append((node, int.from_bytes(digest[:8], "little", signed=True), out[-1][1]))
                    rows += n
                if rows > PREFIX_ROWS:
                    yield frame(_dealt(prefixes, named, parts), node=0, size=0, words=None, fp=0, bits=None, wide=None)
                    prefixes, named, rows = [], [], 0
            if prefixes:
                yield frame(_dealt(prefixes, named, parts), node=0, size=0, words=None, fp=0, bits=None, wide=None)
            yield frame(pd.DataFrame(out, columns=marked), pos=-1, **dict.fromkeys(DEALT))

    schema = "node long, size int, words string, fp long, bits array<long>, wide array<long>, pos int, "
    return texts.select("node", "text").mapInPandas(run, schema + ", ".join(f"{c} binary" for c in DEALT))


def _bitmap(wanted: DataFrame):
    """A table of one row at most, to be broadcast, with a bitmap (longs) of 16 bits or more for each wanted node (node), repeated or not; and whether it shows a row's node, which it does for all wanted ones and few others."""
    bits = 1 << min(31, max(10, (16 * wanted.count() - 1).bit_length()))

    def run(batches):
        longs = np.zeros(bits // 64, dtype=np.uint64)
        for b in batches:
            h = b["h"].to_numpy().view(np.uint64)
            for at in (h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)):
                np.bitwise_or.at(longs, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        yield pd.DataFrame({"longs": [longs.view(np.int64)]})

    filled = wanted.select(F.xxhash64("node").alias("h")).coalesce(1).mapInPandas(run, "longs array<long>")
    h = F.xxhash64("node")
    may = [F.call_function("shiftright", F.get("longs", F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1 for at in (h.bitwiseAND(bits - 1), F.shiftrightunsigned(h, 32).bitwiseAND(bits - 1))]
    return F.broadcast(filled), may[0] & may[1]


def fetched(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows (node, ...) whose node is among the wanted ones (node), repeated or not.

    A bitmap of the wanted nodes is broadcast first, so that few other rows are shuffled.
    """
    filled, may = _bitmap(wanted)
    return rows.join(filled, may).drop("longs").join(wanted.distinct(), "node", "left_semi")


def without(rows: DataFrame, gone: DataFrame, others: DataFrame) -> DataFrame:
    """The rows (node, ...) whose node is not among those gone (node); others (node) are all the other nodes, and rows without a node stay.

    What a bitmap of those gone does not show stays where it is. The few others that it shows are fetched, so that
    hardly a row is shuffled, however many go or stay.
    """
    filled, may = _bitmap(gone)
    shown = freed(others.join(filled, may).select("node"), "simhash-shown")
    stay = rows.join(filled, F.lit(True), "left").where(F.col("node").isNull() | ~F.coalesce(may, F.lit(False))).drop("longs")
    return stay.unionByName(fetched(rows, shown))


def _pair(x, y, where):
    """The pair (a, b) of nodes x and y in order."""
    return where.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _bits_allow(x_size: str, x_bits: str, y_size: str, y_bits: str):
    """Whether the bits of two texts leave room for the similarity: a bit that one has alone stands for a shingle not shared."""
    alone = lambda x, y: sum((F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(BITMAP_WORDS)), F.lit(0))
    most = F.least(F.col(x_size) - alone(x_bits, y_bits), F.col(y_size) - alone(y_bits, x_bits))
    return 9 * most >= 4 * (F.col(x_size) + F.col(y_size))


def _wide_allow():
    """_bits_allow by the wide bitmaps of a and b, the longer one folded to the length of the other; a pair without both is allowed."""
    n = F.least(F.size("a_wide"), F.size("b_wide"))
    fold = lambda x: F.when(F.size(x) == n, F.col(x)).otherwise(F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseOR(q)))
    alone = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, c: s + c)
    x, y = fold("a_wide"), fold("b_wide")
    most = F.least(F.col("a_size") - alone(x, y), F.col("b_size") - alone(y, x))
    return F.coalesce(9 * most >= 4 * (F.col("a_size") + F.col("b_size")), F.lit(True))


def similar(pairs: DataFrame, marks: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes, each looked at once, those whose texts (node, text) are of SIMILARITY or more.

    marks (node, size, bits, wide) rule out first what their bits show to share too little; then the whole texts decide.
    """
    side = lambda k: marks.select(F.col("node").alias(k), F.col("size").alias(f"{k}_size"), F.col("bits").alias(f"{k}_bits"))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    sizes = (5 * F.col("a_size") >= 4 * F.col("b_size")) & (5 * F.col("b_size") >= 4 * F.col("a_size"))
    left = freed(both.where(sizes & _bits_allow("a_size", "a_bits", "b_size", "b_bits")).select("a", "b"), "simhash-candidates")
    wide = lambda k: marks.where("wide is not null").select(F.col("node").alias(k), F.col("size").alias(f"{k}_size"), F.col("wide").alias(f"{k}_wide"))
    left = freed(left.join(wide("a"), "a", "left").join(wide("b"), "b", "left").where(_wide_allow()).select("a", "b"), "simhash-allowed")

    def check(batches):
        powers, known = Powers(), {}

        def shingles(node: int, text: str | None) -> np.ndarray:
            if node not in known:
                if len(known) >= KEPT_SETS:
                    known.clear()
                known[node] = shingle_set(folded(text), powers)
            return known[node]

        for b in batches:
            ok = []
            for a, z, s, t in zip(b["a"], b["b"], b["s"], b["t"]):
                x, y = shingles(a, s), shingles(z, t)
                ok.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
            yield b.loc[ok, ["a", "b"]]

    content = fetched(texts, left.select(F.explode(F.array("a", "b")).alias("node")))
    of = lambda k, t: content.select(F.col("node").alias(k), F.col("text").alias(t))
    return left.join(of("a", "s"), "a").join(of("b", "t"), "b").mapInPandas(check, "a long, b long")


def ring_pairs(texts: DataFrame, hot: int = HOT_SEGMENT) -> DataFrame:
    """Pairs (a, b) of texts (node, fp) that the pigeonring gives: the least texts of linked fingerprints, and each text with the least of its own."""
    least = texts.groupBy("fp").agg(F.min("node").alias("least"))
    of = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_node"))
    between = links(least.select("fp"), hot).join(of("a"), "a").join(of("b"), "b").select("a_node", "b_node")
    return _pair("a_node", "b_node", between).unionByName(_pair("least", "node", texts.select("node", "fp").join(least, "fp").where("node <> least")))


def common_shingles(texts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, ascending, that several texts of a sample of all, of which there are so many, have, and how many. Whatever they are, the order they give is right; these keep crowds out of prefixes."""
    chance = min(1.0, COMMON_TEXTS / max(1, total))

    def run(batches):
        powers = Powers()
        for b in batches:
            for i in range(0, len(b), HELD):
                yield pd.DataFrame({"val": np.concatenate(shingle_sets([folded(t) for t in b["text"].iloc[i : i + HELD]], powers))})

    sample = texts.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(2**52)) / float(2**52) <= chance)
    counts = sample.select("text").mapInPandas(run, "val long").groupBy("val").agg(F.count("*").alias("n")).where("n > 1")
    found = np.array(sorted((r.val, r.n) for r in counts.orderBy(F.desc("n"), "val").limit(COMMON_MOST).collect()), dtype=np.int64).reshape(-1, 2)
    return found[:, 0].copy(), found[:, 1].copy()


def _may_be_near(x: str, y: str):
    """Whether the sizes of two texts, and what follows a shingle if it is the first they share, allow the similarity."""
    c = lambda side, name: F.col(f"{side}.{name}")
    small, large = F.least(c(x, "size"), c(y, "size")), F.greatest(c(x, "size"), c(y, "size"))
    rest = F.least(c(x, "size") - c(x, "pos"), c(y, "size") - c(y, "pos"))
    return (c(x, "root") != c(y, "root")) & (5 * small >= 4 * large) & (9 * rest >= 4 * (small + large))


def _open(shared: DataFrame) -> DataFrame:
    """shared (val, node, root, size, pos) where a shingle's texts lie in several components; with their number n and the least text's row."""
    row = F.struct("node", "root", "size", "pos")
    by = shared.groupBy("val").agg(F.count("*").alias("n"), F.min(row).alias("first"), F.min("root").alias("low"), F.max("root").alias("high"))
    return shared.join(by.where("low < high").select("val", "n", "first"), "val")


def _rerooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (node, root, ...) with the roots of their nodes put anew, where they have one."""
    return rows.select(*[c for c in rows.columns if c != "root"]).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """A forest (a, b) of links between the open texts of one block and all of another that lie in different components.

    All pairs of the two blocks meet in one product of matrices: shared shingles are counted over those that several texts have.
    """
    node, root, opened = pdf["node"].to_numpy(), pdf["root"].tolist(), np.flatnonzero(pdf["open"].to_numpy())
    powers = Powers()
    sets = [shingle_set(folded(t), powers) for t in pdf["text"]]
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(size)), size)
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = (np.cumsum(n > 1) - 1)[at]
    keep = n[at] > 1
    row, column = row[keep], column[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(opened), len(size)), dtype=np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        x = np.zeros((len(size), COLUMNS), dtype=np.float32)
        x[row[a:b], column[a:b] - first] = 1
        both += x[opened] @ x.T
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(9 * both >= 4 * (size[opened][:, None] + size[None, :]))):
        x, y = find(root[opened[i]]), find(root[j])
        if x != y:
            parent[x] = y
            out.append((node[opened[i]], node[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _shared_bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits each row of x shares with each row of y, by products of matrices."""
    out, per = np.zeros((len(x), len(y)), dtype=np.float32), COLUMNS // 64
    ones = lambda m, i: np.unpackbits(np.ascontiguousarray(m[:, i : i + per]).view(np.uint8), axis=1).astype(np.float32)
    for i in range(0, x.shape[1], per):
        out += ones(x, i) @ ones(y, i).T
    return out


def _block_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of two blocks that have a partner in another component which sizes and bits allow: no other can be linked.

    Of bitmaps of two lengths the longer is folded to the shorter; texts of one with over twice the other's bits are too
    far apart in size.
    """
    size, root, is_open = pdf["size"].to_numpy(dtype=np.int64), pdf["root"].to_numpy(), pdf["open"].to_numpy(dtype=bool)
    longs = np.array([len(x) for x in pdf["bits"]])
    rows = {n: np.flatnonzero(longs == n) for n in np.unique(longs).tolist()}
    bits = {n: np.stack(pdf["bits"].iloc[at].to_list()).astype(np.int64).view(np.uint64) for n, at in rows.items()}
    keep = np.zeros(len(pdf), dtype=bool)
    for n in rows:
        own = rows[n][is_open[rows[n]]]
        for m in (m for m in rows if len(own) and m <= 2 * n and n <= 2 * m):
            x, y = (np.bitwise_or.reduce(b.reshape(len(b), -1, min(n, m)), axis=1) for b in (bits[n][is_open[rows[n]]], bits[m]))
            both, of_x, of_y = _shared_bits(x, y), np.bitwise_count(x).sum(1, dtype=np.int64), np.bitwise_count(y).sum(1, dtype=np.int64)
            s, t = size[own][:, None], size[rows[m]][None, :]
            near = 9 * (np.minimum(s - of_x[:, None], t - of_y[None, :]) + both) >= 4 * (s + t)
            near &= root[own][:, None] != root[rows[m]][None, :]
            keep[own[near.any(1)]] = True
            keep[rows[m][near.any(0)]] = True
    return pdf.loc[keep, ["val", "op", "mp", "node", "root", "open"]]


def crowd_links(crowd: DataFrame, marks: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all near copies among the texts (val, node, root, n, first) of each shingle.

    The texts outside the component of a shingle's first text are held against all of its texts, block by block: a
    task sees two blocks. Bitmaps, and wide ones after them, say first which rows of two blocks can have a partner; the
    texts of those follow, and a forest comes back.
    """
    part = F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("n") / block))
    members = freed(crowd.withColumn("part", part).withColumn("outside", F.col("root") != F.col("first.root")).select("val", "node", "root", "part", "outside"), "simhash-crowds")
    opened = members.where("outside")
    parts = lambda df, c: df.select("val", F.col("part").alias(c)).distinct()
    left = opened.withColumnRenamed("part", "op").join(parts(members, "mp"), "val").withColumn("open", F.lit(True))
    right = members.withColumnRenamed("part", "mp").join(parts(opened, "op"), "val").withColumn("open", F.lit(False))
    columns = ["val", "op", "mp", "node", "root", "open"]
    able = left.select(*columns).unionByName(right.select(*columns))
    for bits in ("bits", F.coalesce("wide", "bits").alias("bits")):
        rows = able.join(marks.select("node", "size", bits), "node")
        able = freed(rows.groupBy("val", "op", "mp").applyInPandas(_block_rows, "val long, op long, mp long, node long, root long, open boolean"), "simhash-blocks")
    return able.join(fetched(texts, able.select("node")), "node").groupBy("val", "op", "mp").applyInPandas(_block_links, "a long, b long")


def missed_links(rows: DataFrame, marks: DataFrame, texts: DataFrame, roots: DataFrame, paired: int = PAIRED, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all near copies among texts (node, text) that lie in different components, given as (node, root) of those of more than one text.

    rows (val, node, size, pos) are the prefixes' shingles that several texts have. Of shingles that the same texts have, the first in the common
    order stands for all. Each first links its texts to the least of them. Where they still lie in several components, all pairs across components follow, which sizes and places in the prefix may
    rule out; shingles of more than `paired` texts get the same by blocks. Whichever way a pair comes, the similarity of
    its texts decides.
    """
    sets = rows.groupBy("val").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("set"), F.min(F.struct("node", "pos")).alias("first"))
    once = sets.groupBy("n", "set", "first.node").agg(F.min_by("val", "first.pos").alias("val")).select("val")
    shared = freed(_open(_rerooted(rows.join(once, "val", "left_semi"), roots)), "simhash-shared")
    discard(rows)
    stars = shared.alias("y").where(F.col("node") != F.col("first.node")).select("first", F.struct("node", "root", "size", "pos").alias("y"))
    found = freed(similar(_pair("first.node", "y.node", stars.where(_may_be_near("first", "y"))), marks, texts), "simhash-stars")

    now = components(_settled(roots).unionByName(found), "simhash-star-roots")
    left = freed(_open(_rerooted(shared.drop("n", "first"), now)), "simhash-left")
    side = left.where(F.col("n") <= paired).withColumn("first", F.col("first.node")).join(marks.select("node", "bits"), "node")
    x, y = side.alias("x"), side.drop("n", "first").alias("y")
    allowed = _may_be_near("x", "y") & _bits_allow("x.size", "x.bits", "y.size", "y.bits")
    across = x.join(y, F.col("x.val") == F.col("y.val")).where((F.col("x.node") < F.col("y.node")) & (F.col("x.node") != F.col("x.first")) & allowed)
    more = freed(found.unionByName(similar(across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), marks, texts)), "simhash-missed")

    if not left.where(F.col("n") > paired).limit(1).count():
        return more
    now = components(_settled(now).unionByName(more), "simhash-missed-roots")
    crowd = freed(_open(_rerooted(left.where(F.col("n") > paired).drop("n", "first"), now)), "simhash-crowd")
    return more.unionByName(forest(crowd_links(crowd, marks, texts, block)))


def several_texts(dealt: DataFrame) -> DataFrame:
    """Of the prefixes' shingles, as `sketches` deals them, those that several texts have: (val, node, size, pos), of exact copies only the least node's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        val, pos, node, key, size, count = (np.frombuffer(b"".join(pdf[c]), dtype=kind) for c, kind in zip(DEALT, ("<i8", "<i4", "<i8", "<i8", "<i4", "<i4")))
        run = np.repeat(np.arange(len(count)), count)
        order = np.argsort(val)
        twice = np.diff(val[order]) == 0
        order = order[np.append(twice, False) | np.append(False, twice)]
        val, pos, run = val[order], pos[order], run[order]
        order = np.lexsort((node[run], key[run], val))
        val, pos, run = val[order], pos[order], run[order]
        new = np.append(True, np.diff(val) != 0)[: len(val)]
        keep = new | np.append(True, np.diff(key[run]) != 0)[: len(val)]
        val, pos, run = val[keep], pos[keep], run[keep]
        twice = np.diff(val) == 0
        keep = (np.append(twice, False) | np.append(False, twice))[: len(val)]
        return pd.DataFrame({"val": val[keep], "node": node[run[keep]], "size": size[run[keep]], "pos": pos[keep]})

    return freed(dealt.groupBy("part").applyInPandas(run, "val long, node long, size int, pos int"), "simhash-several")


def _settled(roots: DataFrame) -> DataFrame:
    return roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))


def copies(docs: DataFrame, paired: int = PAIRED, block: int = BLOCK) -> DataFrame:
    """(doc_id, root) for each doc_id: root is the least doc_id reachable over exact and near copies, itself included.

    Texts of equal words are exact copies; near copies share SIMILARITY of their distinct shingles of VERIFIED_SHINGLE
    words (with fewer words: the whole). Null and blank texts are copies of each other; rows of one doc_id are one
    document; rows without doc_id are left out; an empty table gives an empty result; other columns are not read. docs is
    read several times: stage it first if it is dear to make.
    """
    with in_batches(docs.sparkSession):
        return _copies(docs, paired, block)


def _copies(docs: DataFrame, paired: int, block: int) -> DataFrame:
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    texts = docs.withColumnRenamed("doc_id", "node")
    total = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    told = freed(sketches(texts, common_shingles(texts, total.n), max(PARTS, total.bytes // PART_BYTES)), "simhash-sketches")
    own = stage(told.where("pos < 0").select(F.col("node").alias("doc_id"), "words"), "simhash-words")
    least = stage(own.groupBy("words").agg(F.min("doc_id").alias("node")), "simhash-least")
    marks = stage(told.where("pos < 0").join(least, ["words", "node"], "left_semi").select("node", "size", "fp", "bits", "wide"), "simhash-marks")
    rows = several_texts(told.where("pos >= 0").select(F.col("pos").alias("part"), *DEALT))
    discard(told)
    ring = components(similar(ring_pairs(marks), marks, texts), "simhash-ring")
    release(docs.sparkSession)
    near = _settled(ring).unionByName(missed_links(rows, marks, texts, ring, paired, block))
    same = own.join(least, "words").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    roots = components(near.unionByName(same), "simhash-copies")
    out = stage(own.select("doc_id").distinct().join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("root")), "simhash-roots")
    discard(own, least, marks)
    release(docs.sparkSession)
    return out


def deduplicated(docs: DataFrame, paired: int = PAIRED, block: int = BLOCK) -> DataFrame:
    """docs with their columns, one document, that of least doc_id, of each group of copies; rows of one doc_id stay together, rows without one stay.

    Null and blank texts are one group; very long texts are compared whole; an empty table stays empty; a column of any
    other name passes through as it is.
    """
    found = copies(docs, paired, block).withColumnRenamed("doc_id", "node")
    rows = docs.select(F.col("doc_id").alias("node"), F.struct("*").alias("row"))
    return without(rows, found.where("node <> root").select("node"), found.where("node = root").select("node")).select("row.*")
