"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

Candidates are found by pattern, their values hashed, and each hash counted over distinct owners and repositories: a
value that several owners carry is a copied example, one that a single owner carries and that looks random is live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

# Kinds in their order, each with its pattern, the group that is the credential, and its least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # the runs of [0-9a-f]+ that are long enough
    ("forge", r"gh[oprsu]_[A-Za-z0-9]{30,}", 0, 34),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 30),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?", 0, 20),
)
BASE = 3
#: A value is a copied example from so many owners on, or from so many repositories of two owners.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 6
#: A value of one owner looks live in so many of its repositories at most, with so many different letters and so long.
LIVE_REPOSITORIES, LIVE_LETTERS, LIVE_LENGTH = 3, 8, 12


def _matches(text: Column, number: int) -> Column:
    """Of one kind: array of (kind, pre, len, ok, value), pre being the code points since the match before."""
    _, pattern, group, least = KINDS[number]
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))

    def one(x):
        found = x["0"]
        value = F.regexp_extract(found, pattern, group) if group else found
        return F.struct(
            F.lit(number).alias("kind"), F.char_length(x["1"]).alias("pre"), F.char_length(found).alias("len"),
            (F.char_length(value) >= least).alias("ok"), F.sha2(value, 256).alias("hash"),
            ((F.size(F.array_distinct(F.split(value, ""))) >= LIVE_LETTERS) & (F.char_length(value) >= LIVE_LENGTH)).alias("lively"),
        )

    some = F.filter(zipped, lambda x: x["0"].isNotNull())
    return F.when(text.rlike(pattern), F.transform(some, one)).otherwise(F.array().cast("array<struct<kind:int,pre:int,len:int,ok:boolean,hash:string,lively:boolean>>"))


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """For each row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_example, n_live.

    spans are kind:start:end in code points, by start and then kind; the base kinds come from their fixed patterns,
    the others are added. n_example counts spans whose value EXAMPLE_OWNERS owners carry, or two in EXAMPLE_REPOSITORIES
    repositories; n_live those that look random and that one owner carries, in LIVE_REPOSITORIES of its repositories at most. Null and empty texts: no spans. A null owner counts as one more owner. Repeated rows
    each give a row. A column that an owner or repository names and that docs lacks counts as null.
    """
    have = set(docs.columns)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = stage(
        docs.select(
            "doc_id", named(owner).alias("owner"), F.xxhash64(*[named(c) for c in repository]).alias("repo"),
            F.concat(*[_matches(text, i) for i in range(len(KINDS))]).alias("found"),
        ).withColumn("rid", F.monotonically_increasing_id()),
        "secrets-found",
    )
    one = found.select("rid", "owner", "repo", F.posexplode("found").alias("at", "m")).select("rid", "owner", "repo", "at", "m.*")
    upto = W.partitionBy("rid", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    spans = one.withColumn("end", F.sum(F.col("pre") + F.col("len")).over(upto)).where("ok").withColumn("start", F.col("end") - F.col("len"))
    carried = one.where("ok").groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    owners = carried.groupBy("hash", "owner").agg(F.count("*").alias("repos")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    kind = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind") + 1)
    told = spans.join(owners, "hash").withColumn("span", F.concat_ws(":", kind, F.col("start").cast("string"), F.col("end").cast("string")))
    by_row = told.groupBy("rid").agg(
        *[F.count_if(F.col("kind") == i).alias(f"n_{KINDS[i][0]}") for i in range(BASE)],
        F.array_sort(F.collect_list(F.struct("start", "kind", "span"))).alias("all"),
        F.count_if((F.col("owners") >= EXAMPLE_OWNERS) | ((F.col("owners") > 1) & (F.col("repos") >= EXAMPLE_REPOSITORIES))).alias("n_example"),
        F.count_if((F.col("owners") == 1) & (F.col("repos") <= LIVE_REPOSITORIES) & F.col("lively")).alias("n_live"),
    )
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["span"]), ",")
    out = found.select("rid", "doc_id").join(by_row, "rid", "left")
    rows = F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,span:string>>"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(
        "doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"),
        F.sha2(joined(F.filter(rows, lambda x: x["kind"] < BASE)), 256).alias("base_sha256"), joined(rows).alias("spans"), zero("n_example"), zero("n_live"),
    )
