"""Language identification by a convolutional network over bytes, trained and applied in numpy.

A window has 256 bytes. Each byte pair and byte triple around a position is an input of filters of
widths 2, 3 and 4: a filter of width w is a table per offset, so its response is a sum of table rows;
max pooling over the window and a softmax layer follow. The filters, pooling and softmax are trained
by Adam on windows of labelled texts; a text's prediction is the mean over all its windows of the
class probabilities, so whole texts are read however long they are.

Training uses a bounded sample: TRAIN_DOCS documents that have a lang and whose crc32(doc_id as text)
mod 4 is not 2, those of least hash, and of each one window at a place given by the hash. lang,
source and doc_id are never inputs of a prediction.

Defined cases: a null text, or one without letters (fractions and numerals are none), is `und` with score
0; a text of any length is read whole, window by window; equal probabilities give the
lang that sorts first; with no labelled text every prediction is `und`; a lang that the sample does not
hold is never predicted; repeated rows each give a row; other columns are ignored by `predict`, kept by
`keep_known`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from pagequarry.llm.common import tidy

#: Documents in the training sample, and characters of the part that is kept of each.
TRAIN_DOCS, TRAIN_CHARS = 6000, 320
LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: A document whose best language has less probability than this is rejected by `keep_known`.
LEAST_SCORE = 0.35
UNKNOWN = "und"

#: A letter; digits of any script, fractions and Roman numerals are none.
_LETTER = regex.compile(r"\p{L}")


# ---------------------------------------------------------------- the network
class Network:
    """params: per width a table (w, 256, FILTERS) of byte responses, then softmax weights and bias."""

    def __init__(self, langs: list[str], params: dict[str, np.ndarray]):
        self.langs, self.params = langs, params

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        params = {f"t{w}": rng.normal(0, 0.5 / w, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        params |= {f"b{w}": np.zeros(FILTERS, np.float32) for w in WIDTHS}
        params["out"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        params["bias"] = np.zeros(len(langs), np.float32)
        return cls(langs, params)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Windows of bytes (n, LENGTH) -> max of each filter, and where it was."""
        tops, places = [], []
        for w in WIDTHS:
            t = self.params[f"t{w}"]
            n = x.shape[1] - w + 1
            z = t[0][x[:, :n]]
            for i in range(1, w):
                z += t[i][x[:, i : i + n]]
            at = z.argmax(1)
            places.append(at)
            tops.append(np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0] + self.params[f"b{w}"], 0))
        return np.concatenate(tops, 1), places

    def softmax(self, tops: np.ndarray) -> np.ndarray:
        z = tops @ self.params["out"] + self.params["bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        tops, places = self.pooled(x)
        d = self.softmax(tops)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"out": tops.T @ d, "bias": d.sum(0)}
        back = (d @ self.params["out"].T) * (tops > 0)
        cols = np.arange(FILTERS)
        for k, w in enumerate(WIDTHS):
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"b{w}"] = part.sum(0)
            t = np.zeros_like(self.params[f"t{w}"])
            for i in range(w):
                bytes_at = np.take_along_axis(x, places[k] + i, 1)
                np.add.at(t[i], (bytes_at, np.broadcast_to(cols, bytes_at.shape)), part)
            g[f"t{w}"] = t
        return g


def train(langs: list[str], x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    net = Network.fresh(langs, seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.params.items()}
    second = {k: np.zeros_like(v) for k, v in net.params.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            step += 1
            for k, g in net.gradients(x[pick], y[pick]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                net.params[k] = (net.params[k] - RATE * move).astype(np.float32)
    return net


class Fast:
    """The same responses with two bytes looked up at once: three table rows for 2, 3 and 4 bytes each."""

    def __init__(self, net: Network):
        self.net = net
        p = net.params
        two = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.t2 = two(p["t2"][0], p["t2"][1])
        self.t3 = (two(p["t3"][0], p["t3"][1]), p["t3"][2])
        self.t4 = (two(p["t4"][0], p["t4"][1]), two(p["t4"][2], p["t4"][3]))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        tops = []
        for w, z in (
            (2, self.t2.take(pairs, 0)),
            (3, self.t3[0].take(pairs[:, :-1], 0) + self.t3[1].take(x[:, 2:], 0)),
            (4, self.t4[0].take(pairs[:, :-2], 0) + self.t4[1].take(pairs[:, 2:], 0)),
        ):
            tops.append(np.maximum(z.max(1) + self.net.params[f"b{w}"], 0))
        return self.net.softmax(np.concatenate(tops, 1))


def windows(raw: bytes) -> np.ndarray:
    """The text's bytes as windows of LENGTH without overlap; the last is filled up with spaces."""
    n = max(1, -(-len(raw) // LENGTH))
    return np.frombuffer(raw.ljust(n * LENGTH), np.uint8).reshape(n, LENGTH)


# ---------------------------------------------------------------- fitting
def held_out():
    """crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame) -> list:
    """lang and part of the TRAIN_DOCS labelled rows of least hash.

    Only rows under a bound on the hash, set from a count that reads no texts, may reach the driver, so
    what all tasks send together stays near TRAIN_DOCS. The bound rises until enough rows come or it
    lets all through; the rows that are chosen don't depend on it.
    """
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out())
    share = 1.5 * TRAIN_DOCS / max(1, labelled.count())
    chosen = labelled.where(F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"),
        F.xxhash64(F.col("doc_id"), F.lit(3)).alias("h"),
        F.expr(f"substring(text, 1 + CAST(pmod(xxhash64(doc_id, 4), greatest(1, length(text) - {TRAIN_CHARS})) AS INT), {TRAIN_CHARS})").alias("part"),
    )
    while True:
        under = chosen if share >= 1 else chosen.where(F.col("h") < int(share * (1 << 64)) - (1 << 63))
        rows = under.orderBy("h", "lang", "part").limit(TRAIN_DOCS).collect()
        if len(rows) == TRAIN_DOCS or share >= 1:
            return rows
        share *= 4


def fit(docs: DataFrame) -> Network:
    """Train on the driver, from TRAIN_DOCS texts' parts of TRAIN_CHARS characters at most."""
    rows = _sample(docs)
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return Network.fresh([UNKNOWN])
    index = {x: i for i, x in enumerate(langs)}
    x = np.concatenate([windows(r["part"].encode())[:1] for r in rows])
    y = np.array([index[r["lang"]] for r in rows])
    return train(langs, x, y)


# ---------------------------------------------------------------- prediction
_FAST: dict[str, Fast] = {}
#: Windows that go through the tables at once.
AT_ONCE = 256


def _predict(texts: list[str | None], fast: Fast) -> tuple[list[str], list[float]]:
    raws = [t.encode() if t and _LETTER.search(t) else b"" for t in texts]
    counts = np.array([max(1, -(-len(r) // LENGTH)) for r in raws])
    owner = np.repeat(np.arange(len(raws)), counts)
    sums = np.zeros((len(raws), len(fast.net.langs)))
    held: list[np.ndarray] = []
    size = at = 0

    def flush():
        nonlocal held, size, at
        if size:
            x = np.concatenate(held)
            for i in range(0, len(x), AT_ONCE):
                part = fast.probabilities(x[i : i + AT_ONCE])
                np.add.at(sums, owner[at : at + len(part)], part)
                at += len(part)
        held, size = [], 0

    for r in raws:
        held.append(windows(r))
        size += len(held[-1])
        if size >= 8192:
            flush()
    flush()
    mean = sums / counts[:, None]
    best = mean.argmax(1)
    langs = [fast.net.langs[b] if r else UNKNOWN for b, r in zip(best, raws)]
    return langs, [float(min(1.0, m[b])) if r else 0.0 for m, b, r in zip(mean, best, raws)]


def _fast(net: Network, key: str) -> Fast:
    if key not in _FAST:
        _FAST.clear()
        _FAST[key] = Fast(net)
    return _FAST[key]


def _predictor(langs: list[str], params: dict[str, np.ndarray], key: str):
    def run(batches):
        fast = _fast(Network(langs, params), key)
        for b in batches:
            pred, score = _predict(b.column("text").to_pylist(), fast)
            arrays = [b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "lang_pred", "score"])

    return tidy(run)


def _key(net: Network) -> str:
    return f"{net.langs}{float(sum(float(np.abs(v).sum()) for v in net.params.values())):.9g}"


def predict(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    net = net or fit(docs)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    out = "doc_id long, held_out boolean, lang_pred string, score double"
    return narrow.mapInArrow(_predictor(net.langs, net.params, _key(net)), out)


def keep_known(docs: DataFrame, net: Network | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """docs that have a language with a score of `least` or more, all columns kept."""
    net = net or fit(docs)
    langs, params, key = net.langs, net.params, _key(net)

    def run(batches):
        fast = _fast(Network(langs, params), key)
        for b in batches:
            pred, score = _predict(b.column("text").to_pylist(), fast)
            yield b.filter(pa.array([p != UNKNOWN and s >= least for p, s in zip(pred, score)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
