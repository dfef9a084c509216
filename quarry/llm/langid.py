"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows,
each filter's largest response over the window (max pooling, ReLU) feeds a
softmax over the learned languages.  A text is cut into windows from its first
byte to its last; its probabilities are the windows' mean, weighted by their
bytes.  The network is trained in numpy on a bounded sample of labelled rows.

Cases: null text, or text without any letter, is ``und`` with score 0; so is
everything when no labelled row exists.  Rows with null lang or null text are
not learned from.  Repeated rows get equal results; an empty table gives an
empty result.  Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from quarry.llm.common import kept, prepare

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
#: The training sample: so many documents of each language at most, all together
#: at most (but one of each language), windows taken from each one.
DOCS_PER_LANG = 800
MAX_DOCS = 12_000
WINDOWS_PER_DOC = 2
EPOCHS = 4
RATE = 0.01
#: Windows pushed through the network at once.
STEP = 64


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray
    filters: dict[int, np.ndarray] = field(default_factory=dict)
    out: np.ndarray | None = None

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        f32 = np.float32
        embed = rng.normal(0, 0.5, (256, EMBED)).astype(f32)
        filters = {w: (rng.normal(0, 1, (w * EMBED + 1, FILTERS)) / np.sqrt(w * EMBED)).astype(f32) for w in WIDTHS}
        out = (rng.normal(0, 1, (len(WIDTHS) * FILTERS + 1, len(langs))) / np.sqrt(len(WIDTHS) * FILTERS)).astype(f32)
        return cls(langs, embed, filters, out)

    def _slide(self, x: np.ndarray, w: int) -> np.ndarray:
        """(n, positions, w*EMBED) neighbourhoods of embedded bytes."""
        n, length, e = x.shape
        s0, s1, s2 = x.strides
        view = np.lib.stride_tricks.as_strided(x, (n, length - w + 1, w * e), (s0, s1, s2))
        return np.ascontiguousarray(view)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        x = self.embed[windows]
        parts = []
        for w in WIDTHS:
            near = self._slide(x, w)
            n, positions, _ = near.shape
            f = self.filters[w]
            parts.append((near.reshape(n * positions, -1) @ f[:-1]).reshape(n, positions, FILTERS).max(1) + f[-1])
        return np.maximum(np.concatenate(parts, 1), 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = np.concatenate([self.pooled(windows[i:i + STEP]) for i in range(0, len(windows), STEP)])
        z = z @ self.out[:-1] + self.out[-1]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, windows: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, seed: int = 2) -> None:
        """Softmax cross-entropy by Adam; a max pool passes its gradient to the winning place."""
        rng = np.random.default_rng(seed)
        params = [self.embed, *(self.filters[w] for w in WIDTHS), self.out]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), STEP):
                part = order[i:i + STEP]
                grads = self._gradients(windows[part], target[part])
                t += 1
                for p, g, a, b in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= RATE * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-8)

    def _gradients(self, windows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        n = len(windows)
        x = self.embed[windows]
        who = np.arange(n)
        seen, parts = [], []
        for w in WIDTHS:
            near = self._slide(x, w)
            y = (near.reshape(-1, near.shape[2]) @ self.filters[w][:-1]).reshape(n, -1, FILTERS)
            at = y.argmax(1)
            parts.append(np.take_along_axis(y, at[:, None], 1)[:, 0] + self.filters[w][-1])
            seen.append((near, at))
        h = np.concatenate(parts, 1)
        a = np.maximum(h, 0)
        z = a @ self.out[:-1] + self.out[-1]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[who, target] -= 1
        p /= n
        g_out = np.concatenate([a.T @ p, p.sum(0, keepdims=True)])
        back = (p @ self.out[:-1].T) * (h > 0)
        g_embed, g_filters = np.zeros_like(self.embed), []
        for k, w in enumerate(WIDTHS):
            near, at = seen[k]
            d = back[:, k * FILTERS:(k + 1) * FILTERS]
            won = near[who[:, None], at]  # (n, FILTERS, w*EMBED)
            g = np.empty_like(self.filters[w])
            g[:-1] = np.einsum("nf,nfe->ef", d, won)
            g[-1] = d.sum(0)
            g_filters.append(g)
            to_bytes = d[:, :, None] * self.filters[w][:-1].T[None]
            for j in range(w):
                np.add.at(g_embed, windows[who[:, None], at + j].ravel(),
                          to_bytes[:, :, j * EMBED:(j + 1) * EMBED].reshape(-1, EMBED))
        return [g_embed, *g_filters, g_out]


def windows_of(raw: bytes) -> np.ndarray:
    """The whole text as zero-padded windows."""
    count = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(count * WINDOW, np.uint8)
    out[:len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(count, WINDOW)


def train(documents: DataFrame, eligible: Column, text: str = "text", lang: str = "lang",
          key: str = "doc_id") -> Network | None:
    """Fit on a sample of rows that are ``eligible`` and have text and lang.
    Which rows is decided by a hash of ``key``; each language gives about
    ``DOCS_PER_LANG`` documents, or all it has, and one at least."""
    rows = documents.filter(eligible & F.col(lang).isNotNull() & F.col(text).isNotNull())
    scale = 1 << 40
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(scale))
    sizes = rows.groupBy(lang).agg(F.count("*").alias("n"), F.min(draw).alias("least")).collect()
    if not sizes:
        return None
    per_lang = min(DOCS_PER_LANG, max(1, MAX_DOCS // len(sizes)))
    # draws up to this one are in the sample
    last = [(r[0], max(r["least"], min(scale, scale * per_lang // r["n"]) - 1)) for r in sizes]
    share = F.broadcast(rows.sparkSession.createDataFrame(last, "__lang string, __last long"))
    # windows spread evenly over each sampled text, cut before they leave the executors
    room = F.greatest(F.length(text) - WINDOW, F.lit(0))
    cuts = F.array(*(F.substr(F.col(text), F.floor(room * (k / max(1, WINDOWS_PER_DOC - 1))).cast("int") + 1, F.lit(WINDOW))
                     for k in range(WINDOWS_PER_DOC)))
    sample = (rows.join(share, F.col(lang) == F.col("__lang")).filter(draw <= F.col("__last")).select(F.col(lang).alias("lang"), cuts.alias("cuts"), draw.alias("draw"))
              .orderBy("draw").limit(2 * (MAX_DOCS + len(sizes))).toPandas())
    langs = sorted(r[0] for r in sizes)
    number = {x: i for i, x in enumerate(langs)}
    data = [(c, number[x]) for x, cuts in zip(sample["lang"], sample["cuts"], strict=True) for c in dict.fromkeys(cuts) if c]
    if not data:
        return None
    net = Network.fresh(langs)
    net.fit(np.concatenate([windows_of(c.encode()[:WINDOW]) for c, _ in data]), np.array([y for _, y in data]))
    return net


PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(net: Network | None, text: Column) -> Column:
    """struct(lang_pred, score) of a text column."""

    @F.pandas_udf(PREDICTION)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        kept("langid")
        for texts in batches:
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if net is not None and t is not None and any(map(str.isalpha, t))]
            waiting, size = [], 0
            for i in known:
                waiting.append((i, windows_of(texts.iloc[i].encode("utf-8", "surrogatepass"))))
                size += len(waiting[-1][1])
                if size >= 4 * STEP or i == known[-1]:
                    p = net.probabilities(np.concatenate([w for _, w in waiting]))
                    weight = np.concatenate([np.maximum((w != 0).sum(1), 1) for _, w in waiting]).astype(np.float64)
                    starts = np.cumsum([0, *(len(w) for _, w in waiting)])[:-1]
                    mean = np.add.reduceat(p * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
                    for (j, _), q in zip(waiting, mean, strict=True):
                        best = int(q.argmax())
                        lang[j], score[j] = net.langs[best], min(1.0, float(q[best]))
                    waiting, size = [], 0
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return run(text)


def held_out(key: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """True where crc32 of the key's text leaves that remainder; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts == part


def classify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    prepare(documents.sparkSession)
    net = train(documents, ~held_out())
    return (documents.select("doc_id", held_out().alias("held_out"), predict(net, F.col("text")).alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score"))
