"""Language ID by a byte convolutional network, trained in numpy on a bounded labelled sample.

A lower-cased text's UTF-8 bytes become 64 symbols, cut into fixed-length windows. Filters of widths 2, 3 and 4 respond
to every position; a window's features are each filter's largest response; softmax over languages follows. Since a
filter of width w sees one of 64**w symbol strings, its responses are tabled once, and applying it is a lookup.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import opened, sent

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 8, 256
#: Bounds of the training sample: documents, windows of each, and code points of a window's excerpt.
SAMPLE_DOCS, SAMPLE_WINDOWS, EXCERPT = 3000, 3, 400
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.01, 20240229
UNKNOWN = "und"
#: A text is of a learned script if this share of its letters is; a letter is learned if this share of all documents that may be learned from has it.
KNOWN_LETTERS, LETTER_DOCS = 0.5, 0.001


def has_letter(text: str) -> bool:
    """Whether the whole text has a letter; numerals, superscripts and circled digits are none."""
    return any(map(str.isalpha, text))


def symbol_table() -> np.ndarray:
    """Byte to symbol: letters, digits, blanks, other ASCII, kinds of lead bytes, low bits of continuation bytes."""
    t = np.full(256, 28, dtype=np.uint8)
    t[ord("a") : ord("z") + 1] = np.arange(26)
    t[ord("0") : ord("9") + 1] = 26
    t[:33] = 27
    t[0x80:0xC0] = 32 + (np.arange(0x80, 0xC0) & 31)
    t[0xC0:0xE0], t[0xC3], t[0xE0:] = 30, 29, 31
    return t


def windows(text: str, symbols: np.ndarray) -> np.ndarray:
    """(n, WINDOW + 3) symbols; every byte begins a position of one window, and windows see three bytes into the next."""
    data = symbols[np.frombuffer(text.lower().encode(), dtype=np.uint8)]
    n = max(1, -(-len(data) // WINDOW))
    padded = np.full(n * WINDOW + 3, 27, dtype=np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 3)[::WINDOW]


class Network:
    """Weights: for each width an array (width, 64, FILTERS), biases, and the softmax layer."""

    def __init__(self, langs: list[str]):
        rng = np.random.default_rng(SEED)
        self.langs = langs
        self.letters = ""
        self.p = {f"w{w}": rng.normal(0, 0.3, (w, 64, FILTERS)).astype("float32") for w in WIDTHS}
        self.p |= {f"b{w}": np.zeros(FILTERS, dtype="float32") for w in WIDTHS}
        n = FILTERS * len(WIDTHS)
        self.p |= {"out": rng.normal(0, 0.1, (n, len(langs))).astype("float32"), "bias": np.zeros(len(langs), dtype="float32")}

    def responses(self, x: np.ndarray, w: int) -> np.ndarray:
        k = self.p[f"w{w}"]
        return sum(k[j][x[:, j : j + WINDOW]] for j in range(w)) + self.p[f"b{w}"]

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        rows, feats, where = np.arange(len(x)), [], {}
        for w in WIDTHS:
            r = self.responses(x, w)
            where[w] = r.argmax(1)
            feats.append(np.take_along_axis(r, where[w][:, None, :], 1)[:, 0])
        f = np.concatenate(feats, 1)
        active = np.maximum(f, 0)
        z = active @ self.p["out"] + self.p["bias"]
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[rows, y] -= 1
        q *= (weight / len(x))[:, None]
        g = {"out": active.T @ q, "bias": q.sum(0)}
        back = (q @ self.p["out"].T) * (f > 0)
        for i, w in enumerate(WIDTHS):
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"b{w}"], gk = part.sum(0), np.zeros_like(self.p[f"w{w}"])
            for j in range(w):
                np.add.at(gk[j], (x[rows[:, None], where[w] + j], np.arange(FILTERS)[None, :]), part)
            g[f"w{w}"] = gk
        return g

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam over shuffled batches, classes weighted alike."""
        rng = np.random.default_rng(SEED)
        share = np.bincount(y, minlength=len(self.langs)) / len(y)
        weight = (1 / np.maximum(share, 1e-9) / len(self.langs))[y].astype("float32")
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            rate = RATE * (1 - epoch / EPOCHS)
            for i in range(0, len(x), BATCH):
                b, step = order[i : i + BATCH], step + 1
                for k, g in self.gradients(x[b], y[b], weight[b]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype("float32")

    def tables(self) -> dict[int, np.ndarray]:
        """Responses before the bias to every symbol pair, triple, and first and second half of four."""
        k2, k3, k4 = (self.p[f"w{w}"] for w in WIDTHS)
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)
        return {2: pair(k2[0], k2[1]), 3: (pair(k3[0], k3[1])[:, None, :] + k3[2][None, :, :]).reshape(-1, FILTERS), 4: pair(k4[0], k4[1]), 5: pair(k4[2], k4[3])}

    def predict(self, x: np.ndarray, tables: dict[int, np.ndarray], most: int = 512) -> np.ndarray:
        """Probabilities (n, languages) of windows."""
        out = []
        for i in range(0, len(x), most):
            s = x[i : i + most].astype(np.int32)
            two = (s[:, :-1] << 6) | s[:, 1:]
            three = (two[:, :WINDOW] << 6) | s[:, 2 : WINDOW + 2]
            feats = []
            for r in (tables[2].take(two[:, :WINDOW], 0), tables[3].take(three, 0), tables[4].take(two[:, :WINDOW], 0) + tables[5].take(two[:, 2:], 0)):
                while (n := r.shape[1]) > 1:
                    r = np.maximum(r[:, : n // 2], r[:, n // 2 :])
                feats.append(r[:, 0])
            f = np.maximum(np.concatenate(feats, 1) + np.concatenate([self.p[f"b{w}"] for w in WIDTHS]), 0)
            z = f @ self.p["out"] + self.p["bias"]
            q = np.exp(z - z.max(1, keepdims=True))
            out.append(q / q.sum(1, keepdims=True))
        return np.concatenate(out)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learned_letters(docs: DataFrame) -> str:
    """The lower-case letters that at least LETTER_DOCS of docs have anywhere in their text: every document counts, each once for a letter."""

    def run(batches):
        n, seen = 0, Counter()
        for b in batches:
            n += len(b)
            for t in b["text"]:
                seen.update(filter(str.isalpha, set(t.lower())))
        yield pd.DataFrame({"letter": ["", *seen], "n": [n, *seen.values()]})

    rows = docs.select("text").mapInPandas(run, "letter string, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()  # no more than Unicode has letters
    n = {r.letter: r.n for r in rows}
    return "".join(sorted(c for c in n if c and n[c] >= LETTER_DOCS * n[""]))


def train(docs: DataFrame, scripts: bool = True) -> Network | None:
    """A network whose weights come from about SAMPLE_DOCS documents, chosen by a hash of doc_id, that have an id, text and lang and are not held out; None without any.

    The chance of being chosen falls with their number, so what comes to the driver doesn't grow with the input. Its
    letters, which only the filter by scripts needs, are counted over all these documents.
    """
    learn = docs.where("doc_id is not null and text is not null and lang is not null").where(~held_out())
    chance = min(1.0, SAMPLE_DOCS / max(1, learn.count()))
    usable = learn.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**52)) / float(2**52) <= chance)
    n = F.greatest(F.char_length("text") - EXCERPT, F.lit(0)) + 1
    cuts = F.array(*[F.substr("text", (1 + F.pmod(F.xxhash64("doc_id", F.lit(i)), n)).cast("int"), F.lit(EXCERPT)) for i in range(SAMPLE_WINDOWS)])
    rows = usable.select("lang", cuts.alias("cuts"), F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id", "cuts").limit(2 * SAMPLE_DOCS).collect()
    langs = sorted({r.lang for r in rows})
    if not langs:
        return None
    symbols, at = symbol_table(), {lang: i for i, lang in enumerate(langs)}
    kept = [(windows(c, symbols)[0], at[r.lang]) for r in rows for c in r.cuts if has_letter(c)]
    if not kept:
        return None
    net = Network(langs)
    net.letters = learned_letters(learn) if scripts else ""
    net.train(np.stack([x for x, _ in kept]), np.array([y for _, y in kept]))
    return net


def letter_tables(letters: str) -> np.ndarray:
    """By code point: 0 no letter, 1 a letter, 2 one of letters."""
    t = np.array([chr(c).isalpha() for c in range(0x110000)], dtype=np.uint8)
    t[[ord(c) for c in letters]] = 2
    return t


def familiar(text: str, table: np.ndarray) -> bool:
    """Whether KNOWN_LETTERS of the letters of the whole text are learned ones."""
    n = np.bincount(table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")], minlength=3)
    return n[2] >= KNOWN_LETTERS * (n[1] + n[2])


def predicted(docs: DataFrame, net: Network | None, keep: list[str], scripts: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns keep of docs, and the language and its score under the names given: the mean over all windows of a text, each by its share of letters.

    A text that is null or has no letters gets `und` with score 0, as does every text without a network
    and, with scripts, every text that is not familiar.
    """
    network = sent(docs.sparkSession, net)  # under 100 kB

    def run(batches):
        net, symbols = opened(network), symbol_table()
        tables = net.tables() if net else None
        known = letter_tables(net.letters) if net and scripts else None
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.iloc[i : i + 256]
                texts = [t if net and t and has_letter(t) and (known is None or familiar(t, known)) else None for t in part["text"]]
                lang, score = np.full(len(part), UNKNOWN, dtype=object), np.zeros(len(part))
                if has := [k for k, t in enumerate(texts) if t]:
                    cut = [windows(texts[k], symbols) for k in has]
                    x = np.concatenate(cut)
                    share = ((x[:, :WINDOW] < 26) | (x[:, :WINDOW] >= 29)).sum(1) + 1e-3
                    starts = np.cumsum([0, *(len(c) for c in cut[:-1])])
                    mean = np.add.reduceat(net.predict(x, tables) * share[:, None], starts) / np.add.reduceat(share, starts)[:, None]
                    lang[has] = np.array(net.langs, dtype=object)[mean.argmax(1)]
                    score[has] = np.minimum(mean.max(1), 1.0)
                yield part[keep].assign(**{names[0]: lang, names[1]: score})

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInPandas(run, docs.select(*keep).withColumns({names[0]: F.lit(""), names[1]: F.lit(0.0)}).schema)


def identify(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, held_out, lang_pred, score. Repeated rows each give a row; an empty table gives none; a null doc_id is neither held out nor learned from."""
    return predicted(docs, train(docs, scripts=False), ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def least_score(docs: DataFrame, net: Network | None) -> float:
    """Half way from chance to the lowest score of a rightly predicted document, of all labelled ones held out; 0 without any."""
    if net is None:
        return 0.0
    tested = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null").where(held_out())
    low = predicted(tested, net, ["lang"], scripts=True).where("lang_pred = lang").agg(F.min("score")).first()[0]
    return 0.0 if low is None else 0.999 * min(low, (low + 1 / len(net.langs)) / 2)


def accepted(docs: DataFrame, least: float | None = None) -> DataFrame:
    """docs with their columns, without those of unknown language, of a script not learned, or of a score below least, by default least_score.

    Null and empty texts and those without letters go; repeated rows each stay or go alike; very long texts are read
    whole; an empty table stays empty; columns of any other name pass through as they are.
    """
    net = train(docs)
    least = least_score(docs, net) if least is None else least
    lang, score = (next(n for i in range(len(docs.columns) + 1) if (n := f"{name}_{i}").lower() not in {c.lower() for c in docs.columns}) for name in ("lang_pred", "score"))
    told = predicted(docs, net, docs.columns, scripts=True, names=(lang, score))
    return told.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score)
