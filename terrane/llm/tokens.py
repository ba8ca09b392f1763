"""Token counts by offset-mapped attribution.

A document is encoded once, whole. Lengths of its tokens give their byte spans, which are joined to the spans of its
sections by binary search; a token that crosses a boundary belongs, by the rule given, to the section of its first or
of its last byte.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level vocabulary of that file splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(data: np.ndarray, token_lengths: np.ndarray, rule: str) -> tuple[np.ndarray, ...]:
    """Sections of a text's bytes, each ending after a line break: first byte, end, tokens, and tokens that cross out of it."""
    starts = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    if len(starts) > 1 and starts[-1] == len(data):
        starts = starts[:-1]
    ends = np.append(starts[1:], len(data))
    last = np.cumsum(token_lengths) - 1
    first = last - token_lengths + 1
    a = np.searchsorted(starts, first, side="right") - 1
    b = np.searchsorted(starts, last, side="right") - 1
    n = len(starts)
    return starts, ends, np.bincount(a if rule == "first" else b, minlength=n), np.bincount(a[a != b], minlength=n)


def section_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN, rule: str = "first") -> DataFrame:
    """(doc_id, section, start_char, end_char, n_tokens, n_crossing, doc_tokens): a row for each line of each document.

    Sections cover the text, in code points, each with the line break that ends it. n_tokens adds up to doc_tokens.
    rule `first` gives a crossing token to the section of its first byte, `last` to that of its last; n_crossing
    counts tokens that begin in a section and end in a later one. Null and empty texts have one empty section;
    repeated rows each give theirs; texts are encoded whole, however long; an empty table gives an empty result; other
    columns are not read.
    """
    if rule not in ("first", "last"):
        raise ValueError(rule)
    with open(tokenizer, "rb") as f:  # a vocabulary: under 1 MB, whatever the corpus
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        enc, lengths = encoding(vocabulary.value, pattern)
        names = ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"]
        for b in batches:
            for i in range(0, len(b), 500):
                columns: list[list[np.ndarray]] = [[] for _ in names]
                ids = []
                for doc, text in zip(b["doc_id"].iloc[i : i + 500], b["text"].iloc[i : i + 500]):
                    text = text or ""
                    data = np.frombuffer(text.encode(), dtype=np.uint8)
                    tokens = lengths[enc.encode_to_numpy(text, disallowed_special=())] if text else np.zeros(0, dtype=np.int64)
                    starts, ends, counts, crossing = attribute(data, tokens, rule)
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    ids += [doc] * len(starts)
                    for column, values in zip(columns[1:], (np.arange(len(starts)), chars[starts], chars[ends], counts, crossing, np.full(len(starts), len(tokens)))):
                        column.append(values)
                out = pd.DataFrame({n: np.concatenate(c).astype("int64") for n, c in zip(names[1:], columns[1:])} if ids else {n: [] for n in names[1:]})
                out.insert(0, "doc_id", pd.array(ids, dtype="Int64") if any(pd.isna(x) for x in ids) else np.array(ids, dtype="int64"))
                yield out

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, section long, start_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long")
