"""WARC archives and their merged index.

Pages are written as WARC records by Spark's own text writer, whose line separator is the blank line that ends a record,
so archives can lie in any store Spark writes to. Reading back parses each archive by content lengths and gives a
run of captures sorted by URL key and time; runs meet in key ranges, where a loser tree merges them k ways.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, stage

#: Payload bytes of an archive at the mean record size, and at most if all its records had the largest size.
ARCHIVE_BYTES, ARCHIVE_MOST = 32 << 20, 256 << 20
RANGE_ROWS = 20_000
# Digits in base 32 of Java's number format and of RFC 4648; the profile of an identical payload.
DIGITS_JAVA, DIGITS_RFC = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "2020-01-01 00:00:00"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1, ten hex digits giving eight."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), DIGITS_JAVA, DIGITS_RFC)


def url_key(url: Column) -> Column:
    """The host's labels in reverse, a bracket, then path and query, lower-cased: com,example)/path?query."""
    rest = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    host = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*", 0), r"^(www\d*\.)|:\d+$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1))


def write(pages: DataFrame, path: str) -> None:
    """A record for each row (page_id, url, html) into archives under path.

    Of records with equal payloads the one with the least page_id is a response, the others are revisits that refer to
    it; a null html is an empty payload, a null url an empty one; of repeated rows with the least page_id each is a
    response; if all page_ids of a payload are null, all are responses.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    known = pages.select("page_id", F.col("url").alias("uri"), html.alias("html"), F.octet_length(html).cast("long").alias("size"), sha1_base32(html).alias("digest"))
    narrow = stage(known.select("page_id", "digest", "size"), "warc-digests")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"))
    roles = narrow.select("page_id", "digest").distinct().join(first, "digest").select(F.col("page_id").alias("of_id"), F.col("digest").alias("of_digest"), "first")
    mean, most = narrow.agg(F.avg("size"), F.max("size")).first()
    records = max(1, int(min(ARCHIVE_BYTES / max(mean or 1, 1), ARCHIVE_MOST / max(most or 1, 1))))
    rows = known.join(roles, F.col("page_id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest")))
    again = ~F.col("page_id").eqNullSafe(F.col("first"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    uri = F.regexp_replace(F.coalesce("uri", F.lit("")), r"[\x00-\x20]", "%20")
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, "html"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        line("WARC-Target-URI", uri), line("WARC-Date", date), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), line("X-Payload-Length", F.col("size").cast("string")),
        line("X-URL-Key", url_key(uri)),
        F.when(again, F.concat(line("WARC-Profile", F.lit(IDENTICAL)), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("first").cast("string"), F.lit("")), F.lit(">"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    rows.select(F.concat(header, block).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive, by content length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no record at {at}: {version[:40]!r}")
        head = dict(x.split(": ", 1) for x in lines)
        size = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _page(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and len(urn) > 11 else None


def capture(head: dict[str, str], block: bytes) -> tuple:
    """One capture: page, length and digest of the payload, type, reference, URL key, time. A response's payload is digested anew."""
    _, _, payload = block.partition(b"\r\n\r\n")
    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
    if head["WARC-Type"] == "response":
        size, own = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if own != digest:
            raise ValueError(f"payload of {head['WARC-Record-ID']} has digest {own}, not {digest}")
    return _page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], _page(head.get("WARC-Refers-To")), head["X-URL-Key"], head["WARC-Date"]


CAPTURE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, capture_ts string"
_NAMES = [x.split()[0] for x in CAPTURE.split(", ")]


def _order(row: tuple) -> tuple:
    return row[5], row[6], -1 if row[0] is None else row[0]


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    for c in ("page_id", "refers_to"):
        out[c] = out[c].astype("Int64")
    return out


def read(spark, path: str) -> DataFrame:
    """The captures of every archive under path, as runs: each archive's rows sorted by URL key, time and page.

    A record of an empty payload and repeated records are captures like any other; a record without a page id has none; no
    archives give an empty result; a payload that does not fit its digest is an error.
    """

    def run(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                rows = sorted((capture(*r) for r in records(gzip.decompress(content))), key=_order)
                yield _frame(rows, _NAMES).assign(run=name)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("path", "content")
    return files.mapInPandas(run, f"{CAPTURE}, run string")


class LoserTree:
    """k-way merge: inner nodes hold the losers of their matches, so the next row costs one path of log k comparisons."""

    def __init__(self, runs: list[Iterator[tuple]], key: Callable[[tuple], tuple]):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [0] * max(1, self.k)
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.heads[a][0] <= self.heads[b][0] else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _next(self, i: int) -> tuple:
        row = next(self.runs[i], None)
        return ((1,), None) if row is None else ((0, self.key(row), i), row)

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (row := self.heads[self.winner][1]) is not None:
            yield row
            i = self.winner
            self.heads[i] = self._next(i)
            node = (i + self.k) // 2
            while node:
                if self.heads[self.losers[node]][0] < self.heads[i][0]:
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.winner = i


def merge(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Runs merged into capture histories: by (history_range, history_slot) all captures stand in order of URL key, time, page.

    Rows are dealt to key ranges by all three, so a common URL key spreads over ranges of its own. What a range gets of a run
    comes in the run's order, block by block; every ascending piece is a leaf of the tree, so nothing is sorted again.
    An empty table gives an empty result; repeated captures each stay.
    """
    parts = max(1, -(-runs.count() // range_rows))

    def run(batches):
        pieces: list[list[tuple]] = []
        last = None
        for b in batches:
            b = b.astype(object).where(b.notna(), None)
            for *row, name in b.itertuples(index=False, name=None):
                at = (name, _order(row))
                if last is None or last[0] != name or at[1] < last[1]:
                    pieces.append([])
                pieces[-1].append(tuple(row))
                last = at
        part, rows = TaskContext.get().partitionId(), []
        for slot, row in enumerate(LoserTree([iter(p) for p in pieces], _order)):
            rows.append((*row, part, slot))
        if rows:
            yield _frame(rows, [*_NAMES, "history_range", "history_slot"])

    dealt = runs.repartitionByRange(parts, "url_key", "capture_ts", "page_id")
    return dealt.mapInPandas(run, f"{CAPTURE}, history_range int, history_slot long")


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back, and return the merged captures, a row for each page, repeated ones included.

    A null html is an empty payload; nulls in page_id and url stay apart as `write` says; very long payloads are digested
    whole; an empty table gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path)
    return merge(stage(read(spark, path), "warc-runs"))
