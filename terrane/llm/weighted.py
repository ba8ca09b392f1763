"""Document fingerprints by consistent weighted sampling; DataFrame functions only.

Terms are the words of a lower-cased text, weighted by their counts. For each sample every term draws r and c from
Gamma(2, 1) and beta from U(0, 1), all hashed from the term, so equal weights draw equally in any document; the term of
least c / (y * e^r), together with its quantised weight, is the sample. Two documents' samples agree with the
probability of their generalised Jaccard similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, stage

SAMPLES = 32
#: Samples drawn in one aggregate; more would make code that the JVM does not compile.
BLOCK = 4
#: Rows of a range, within which rows (ids and hashes, no texts) are put in order; with more than MAX_RANGES ranges, ranges grow instead.
RANGE_ROWS, MAX_RANGES = 50_000, 20_000
BLANKS = " \t\n\x0b\x0c\r"


def _uniform(h: Column, shift: int) -> Column:
    return (F.shiftrightunsigned(h, shift).bitwiseAND(0xFFFFFFFF) + F.lit(0.5)) / F.lit(2.0**32)


def _sample(k: Column) -> Column:
    """Of a row (term hash, ln weight) and sample k: the sort key of ln a in the upper half, the sampled (term, t) in the lower."""
    h1 = F.xxhash64("term", k)
    h2 = F.xxhash64(h1)
    r = -F.ln(_uniform(h1, 0) * _uniform(h1, 32))
    ln_c = F.ln(-F.ln(_uniform(h2, 0) * _uniform(h2, 32)))
    beta = _uniform(F.xxhash64(h2), 0)
    t = F.floor(F.col("ln_w") / r + beta)
    ln_a = ln_c - r * (t - beta + 1)
    order = F.least(F.greatest(((ln_a + 600.0) * 2.0**20).cast("long"), F.lit(0)), F.lit(2**31 - 1))
    return F.shiftleft(order, 32).bitwiseOR(F.xxhash64("term", t, k).bitwiseAND(0xFFFFFFFF))


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, sig): the fingerprint, eight hex digits a sample, of each row's text; keys must tell the rows apart.

    A text without words has the empty word as its only term, so such texts have one common fingerprint.
    """
    words = F.split(F.btrim(F.lower("text"), F.lit(BLANKS)), f"[{BLANKS}]+")
    hashed = texts.select(*keys, F.sort_array(F.transform(words, lambda w: F.xxhash64(w))).alias("h"))
    at = F.sequence(F.lit(1), F.size("h"))
    runs = hashed.select(*keys, "h", F.filter(at, lambda i: (i == 1) | (F.element_at("h", i) != F.element_at("h", F.greatest(i - 1, F.lit(1))))).alias("begin"))
    end = lambda i: F.coalesce(F.get("begin", i + 1), F.size("h") + 1)
    counts = F.transform("begin", lambda p, i: F.struct(F.element_at("h", p).alias("term"), (end(i) - p).alias("n")))
    terms = runs.select(*keys, F.inline(counts)).withColumn("ln_w", F.ln(F.col("n").cast("double")))
    blocks = terms.select("*", F.explode(F.array(*[F.lit(k) for k in range(0, samples, BLOCK)])).alias("k"))
    least = blocks.groupBy(*keys, "k").agg(*[F.min(_sample(F.col("k") + F.lit(i))).alias(f"s{i}") for i in range(BLOCK)])
    digits = F.concat(*[F.lpad(F.hex(F.col(f"s{i}").bitwiseAND(0xFFFFFFFF)), 8, "0") for i in range(BLOCK)])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", digits.alias("d")))), lambda x: x["d"]), "")
    return least.groupBy(*keys).agg(F.lower(joined).alias("sig"))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples that agree."""
    samples = F.length(a) / 8
    same = F.aggregate(F.sequence(F.lit(0), (samples - 1).cast("int")), F.lit(0), lambda n, k: n + F.when(F.substr(a, k * 8 + 1, F.lit(8)) == F.substr(b, k * 8 + 1, F.lit(8)), 1).otherwise(0))
    return same / samples


def _order(own: DataFrame, range_rows: int, max_ranges: int) -> DataFrame:
    """(rid, doc_id, next_rid, prev_rid, prev_chars) of rows (rid, doc_id, text): the circle by descending doc_id, nulls last, then by the text's hash, then by rid.

    Sampled ranges put the rows in order by all three, so rows of one doc_id or of none spread over ranges like any other.
    What meets on the driver are the ends of at most max_ranges ranges.
    """
    spark = own.sparkSession
    keys = [F.desc_nulls_last("doc_id"), F.desc("hash"), F.asc("rid")]
    narrow = own.select("rid", "doc_id", F.xxhash64("text").alias("hash"), F.char_length("text").alias("chars"))
    parts = int(max(1, min(max_ranges, -(-own.count() // range_rows))))
    dealt = stage(narrow.repartitionByRange(parts, *keys).withColumn("rng", F.spark_partition_id()), "weighted-order")
    row = F.struct(F.col("doc_id").isNull(), F.bitwise_not("doc_id"), F.bitwise_not("hash"), "rid", "chars")  # ascending in the order of the keys
    ends = sorted((r.rng, r.a["rid"], r.z["rid"], r.z["chars"]) for r in dealt.groupBy("rng").agg(F.min(row).alias("a"), F.max(row).alias("z")).collect())
    around = [(rng, ends[(i + 1) % len(ends)][1], *ends[i - 1][2:]) for i, (rng, *_) in enumerate(ends)]
    outer = spark.createDataFrame(around, "rng int, after long, before long, before_chars int")
    w = W.partitionBy("rng").orderBy(*keys)
    linked = dealt.select("rid", "doc_id", "rng", F.lead("rid").over(w).alias("next"), F.lag("rid").over(w).alias("prev"), F.lag("chars").over(w).alias("chars"))
    linked = linked.join(F.broadcast(outer), "rng")
    out = stage(linked.select("rid", "doc_id", F.coalesce("next", "after").alias("next_rid"), F.coalesce("prev", "before").alias("prev_rid"), F.coalesce("chars", "before_chars").alias("prev_chars")), "weighted-links")
    discard(dealt)
    return out


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, range_rows: int = RANGE_ROWS, max_ranges: int = MAX_RANGES) -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars/3) code points replaced by the first as many of the next document, by
    descending doc_id, the first following the last. A null text counts as empty; null ids come last; rows of one
    doc_id are ordered by descending XXH64 of the text, as a signed number; a single row is its own next; texts are taken
    whole, however long; an empty table gives an empty result. Other columns are not read. All joins are by the row's number.
    """
    own = stage(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", F.monotonically_increasing_id()), "weighted-texts")
    order = _order(own, range_rows, max_ranges)
    placed = own.select("rid", "text").join(order, "rid")  # texts are shuffled once, for both uses
    third = lambda n: F.floor(n / 3).cast("int")
    heads = placed.select(F.col("prev_rid").alias("rid"), F.substr("text", F.lit(1), third(F.col("prev_chars"))).alias("head"))
    n = F.char_length("text")
    edited = F.concat(F.substr("text", F.lit(1), n - third(n)), "head")
    rows = placed.join(heads, "rid").select("rid", "next_rid", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = F.array(F.struct(F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("sha"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.unhex(F.sha2("edited", 256)).alias("sha"), F.col("edited").alias("text")))
    keys = ["rid", "next_rid", "doc_id", "n_chars"]
    signed = signatures(rows.select(*keys, F.inline(both)), [*keys, "kind", "sha"], samples)
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    table = stage(signed.groupBy(*keys).agg(of(0, "sig").alias("fp"), of(1, "sig").alias("efp"), F.lower(F.hex(of(1, "sha"))).alias("sha")), "weighted-fps")
    discard(own, order)
    following = table.select(F.col("rid").alias("next_rid"), F.col("fp").alias("next_fp"))
    return (
        table.join(following, "next_rid")
        .select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
    )
