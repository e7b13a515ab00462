"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of its bytes. Learned
filters slide over each chunk; a filter's value at a place is a sum of one
table entry for each byte under it. The maxima of a chunk go through a small
dense layer to the chunk's logit, and the mean of the logits of all chunks is
the text's logit. Training needs the gradient only where a maximum was taken.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fold, quoted, utf8, with_columns

CHUNK = 256


@dataclass(frozen=True)
class Training:
    """``rows``: labelled documents that the fit reads at most, half for each
    label; their texts are read whole."""
    rows: int = 4000
    filters: int = 24
    width: int = 6
    embedding: int = 8
    hidden: int = 12
    epochs: int = 12
    batch: int = 256
    rate: float = 0.01
    seed: int = 7


class ByteNet:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.tables = tables(weights)  # (width, 256, filters)
        self.width, _, self.filters = self.tables.shape
        self.step = CHUNK - self.width + 1  # chunks share width - 1 bytes

    def dense(self, pooled: np.ndarray) -> np.ndarray:
        h = np.tanh(pooled @ self.w["d1"] + self.w["b1"])
        return h @ self.w["d2"] + self.w["b2"][0]

    def responses(self, x: np.ndarray) -> np.ndarray:
        """(places, filters) for a run of bytes."""
        n = len(x) - self.width + 1
        y = self.tables[0][x[:n]]
        for j in range(1, self.width):
            y += self.tables[j][x[j:n + j]]
        return y

    def logits(self, texts: list[bytes | None], block: int = 1 << 17) -> np.ndarray:
        """The mean chunk logit of each text; null counts as empty. A text is
        padded with zero bytes to whole chunks, at least one."""
        step, pad = self.step, self.width - 1
        n_chunks = [max(1, -(-(len(t or b"") - pad) // step)) for t in texts]
        out, parts, count = [], [], 0

        def flush():
            nonlocal parts, count
            x = np.frombuffer(b"".join(parts) + b"\0" * pad, np.uint8)
            y = self.responses(x)
            out.append(y.reshape(count, step, self.filters).max(axis=1))
            parts, count = [], 0

        # every text owns n * step places; the last width - 1 bytes of a chunk
        # are the first of the next, and after a text's end they are zero
        for t, n in zip(texts, n_chunks):
            t = (t or b"").ljust(n * step + pad, b"\0")
            if n * step > block:
                if count:
                    flush()
                for i in range(0, n, block // step):
                    k = min(n - i, block // step)
                    x = np.frombuffer(t[i * step:(i + k) * step + pad], np.uint8)
                    out.append(self.responses(x).reshape(k, step, self.filters).max(axis=1))
                continue
            # pad - places between two texts see both: they are cut out by
            # giving each text one more zero-filled stretch of a whole chunk
            parts.append(t[:n * step + pad].ljust((n + 1) * step, b"\0"))
            count += n + 1
            if count * step >= block:
                flush()
        if count:
            flush()
        pooled = np.concatenate(out) if out else np.zeros((0, self.filters), np.float32)
        z = np.clip(self.dense(pooled), -8, 8)
        means, at = np.empty(len(texts)), 0
        for i, n in enumerate(n_chunks):
            means[i] = z[at:at + n].mean()
            at += n + (n * step <= block)
        return means

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(texts)))


def tables(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.einsum("bd,jdf->jbf", w["e"], w["k"]).astype(np.float32)


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The logistic loss of (n, CHUNK) bytes with 0/1 labels, each with its
    share, and its gradient. A filter's maximum passes it on to the place where
    it was taken."""
    tab = tables(w)
    width, _, filters = tab.shape
    n = CHUNK - width + 1
    a = tab[0][x[:, :n]]
    for j in range(1, width):
        a += tab[j][x[:, j:n + j]]
    place = a.argmax(axis=1)  # (chunks, filters)
    pooled = np.take_along_axis(a, place[:, None], 1)[:, 0].astype(np.float64)
    h = np.tanh(pooled @ w["d1"] + w["b1"])
    z = h @ w["d2"] + w["b2"][0]
    loss = float((share * (np.logaddexp(0, z) - y * z)).sum())
    dz = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
    dh = dz[:, None] * w["d2"] * (1 - h * h)
    g = {"d2": h.T @ dz, "b2": np.array([dz.sum()]), "d1": pooled.T @ dh, "b1": dh.sum(0),
         "e": np.zeros_like(w["e"]), "k": np.zeros_like(w["k"])}
    da = dh @ w["d1"].T
    for j in range(width):
        under = x[np.arange(len(x))[:, None], place + j]
        gt = np.zeros((256, filters))
        np.add.at(gt, (under, np.arange(filters)[None, :]), da)
        g["e"] += gt @ w["k"][j].T
        g["k"][j] = w["e"].T @ gt
    return loss, g


def fit(chunks: np.ndarray, labels: np.ndarray, share: np.ndarray, t: Training = Training()) -> ByteNet:
    """Train on (n, CHUNK) bytes with one 0/1 label and one share each (a
    document's chunks share its weight), by Adam on the logistic loss; each label
    has half of the weight."""
    r = np.random.default_rng(t.seed)
    w = {"e": r.normal(0, .5, (256, t.embedding)), "k": r.normal(0, .35, (t.width, t.embedding, t.filters)),
         "d1": r.normal(0, .3, (t.filters, t.hidden)), "b1": np.zeros(t.hidden),
         "d2": r.normal(0, .3, t.hidden), "b2": np.zeros(1)}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    total = {y: max(share[labels == y].sum(), 1e-9) for y in (0, 1)}
    n, steps = len(chunks), 0
    weight = share * np.where(labels == 1, .5 / total[1], .5 / total[0]) * n  # 1 on average
    all_steps = max(1, t.epochs * -(-n // t.batch))
    for _ in range(t.epochs):
        order = r.permutation(n)
        for i in range(0, n, t.batch):
            pick = order[i:i + t.batch]
            _, g = gradients(w, chunks[pick], labels[pick], weight[pick] / len(pick))
            steps += 1
            rate = t.rate * (1 - .9 * steps / all_steps)
            for k in w:
                m[k] = .9 * m[k] + .1 * g[k]
                v[k] = .999 * v[k] + .001 * g[k] ** 2
                w[k] = w[k] - rate * (m[k] / (1 - .9 ** steps)) / (np.sqrt(v[k] / (1 - .999 ** steps)) + 1e-8)
    return ByteNet({k: x.astype(np.float32) for k, x in w.items()})


def training_chunks(text: bytes | None) -> list[bytes]:
    """Chunks that cover the whole text."""
    t = text or b""
    return [t[i:i + CHUNK].ljust(CHUNK, b"\0") for i in range(0, max(1, len(t)), CHUNK)]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", parts: int = 3, held: int = 1,
          settings: Training = Training()) -> ByteNet | None:
    """Fit on labelled rows outside the held-out fold (crc32 of the id as text,
    modulo ``parts``, is ``held``). At most ``settings.rows`` ids, half for
    each label and in the order of a hash, go to the driver with their whole
    texts; of rows with one id that with the smallest hash of its text is read.
    None if either label is missing."""
    lab = (labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).alias("y"))
           .where("id is not null and y in (0, 1)").where(fold("id", parts) != held)
           .groupBy("id").agg(F.max("y").alias("y")))
    half = settings.rows // 2
    picked = None
    for y in (0, 1):
        one = lab.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(half)
        picked = one if picked is None else picked.unionByName(one)
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("t")).where("t is not null")
    rows = rows.join(F.broadcast(picked), "id")  # at most settings.rows ids
    got = rows.groupBy("id", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t")).orderBy(F.xxhash64("id"), "id").collect()
    cut = [(training_chunks(r["t"].encode()), r["y"]) for r in got]
    y = np.array([v for c, v in cut for _ in c], np.float64)
    if len(set(y.tolist())) < 2:
        return None
    share = np.array([1 / len(c) for c, _ in cut for _ in c])
    data = np.frombuffer(b"".join(x for c, _ in cut for x in c), np.uint8).reshape(-1, CHUNK)
    return fit(data, y, share, settings)


def score_quality(docs: DataFrame, net: ByteNet | None, text_col: str = "text",
                  keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1
    from 0.5 on) in one pass without a shuffle; every byte of every text
    counts. Cases: null and empty texts score as one chunk of zero bytes;
    without a network (no labels to learn from) every score is 0.5. Repeated
    rows score alike. An input column named like an output gives way to it.
    """
    weights = docs.sparkSession.sparkContext.broadcast(net.w if net else None)

    def start():
        model = ByteNet(weights.value) if weights.value else None

        def f(col):
            texts = utf8(col)
            s = model.scores(texts) if model else np.full(len(texts), .5)
            return [pa.array(s, pa.float64()), pa.array((s >= .5).astype(np.int32))]
        return f
    return with_columns(docs, [text_col], "score double, predicted int", start, keep)


def in_fold(value: object, parts: int, held: int) -> bool:
    """The same fold in Python."""
    return zlib.crc32(str(value).encode()) % parts == held
