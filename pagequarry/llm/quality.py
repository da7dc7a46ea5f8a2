"""Quality rules as a short-circuit cascade.

Every text gets its base measures; a text that passes the base test meets the rules one after another
until one rejects it. What a rule costs and how many it rejects is estimated on a bounded sample, and
rules run in falling order of rejection per cost, where a rule's rejections count among the texts that
the rules before it let pass. The order changes the time only, never a verdict.

Defined cases: a null text has no words and fails the base test; a null doc_id and repeated rows each
give a row; texts of any length are read whole; rules that tie in rejection per cost keep the cheaper one
first; an empty table gives an empty table (the rules then
keep their given order); other columns are ignored by `measures`, kept by `keep_good`.
"""

from __future__ import annotations

import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pagequarry.llm.common import SPACE, TextWords, multipliers, tidy, window_hashes

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Texts in the sample from which costs and rejections are estimated; what its texts may sum up to is
#: bounded by the part of each that the sample keeps.
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 20_000

_COEF = multipliers(WINDOW, 21)


# ---------------------------------------------------------------- base measures
class Measured:
    """A text, its words and base measures; rules read these and add their own."""

    __slots__ = ("raw", "words", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

    def __init__(self, text: str | None, may_repeat: bool = True):
        text = text or ""
        self.raw = raw = text.encode()
        self.words = raw.split()
        self.n_words = len(self.words)
        self.word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
        self.n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
        self.n_lines = len(lines)
        self.n_dup_lines = len(lines) - len(set(lines))
        self.n_repeat_words = repeat_words(self.words) if may_repeat else 0

    @property
    def base_failed(self) -> bool:
        return self.n_words < 10 or 100 * self.n_repeat_words > 20 * self.n_words


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 5-word window which the text holds twice or more."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    count = Counter(windows)
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered[i : i + WINDOW] = b"\1" * WINDOW
    return sum(covered)


def may_repeat(texts: pa.Array) -> np.ndarray:
    """Which texts hold two windows of equal hash: all that repeat one, and almost no others."""
    w = TextWords(texts)
    counts = w.counts()
    owner = np.repeat(np.arange(len(counts)), counts)
    n = max(0, len(owner) - WINDOW + 1)
    at = np.flatnonzero(owner[:n] == owner[len(owner) - n :])
    doc = owner[at]
    h = window_hashes(w.hashes(5), WINDOW, _COEF)[at] + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(h)
    h, doc = h[order], doc[order]
    out = np.zeros(len(counts), bool)
    out[doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])]] = True
    return out


#: Bytes of text, and texts, whose windows are hashed together.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 4096


def measured(texts: pa.Array):
    """A Measured for each text, in order."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = int(sizes[at - 1]) if at else 0
        end = min(at + SLICE_ROWS, max(at + 1, int(np.searchsorted(sizes, base + SLICE_BYTES))))
        part = texts.slice(at, end - at)
        for text, maybe in zip(part.to_pylist(), may_repeat(part).tolist()):
            yield Measured(text, maybe)
        at = end


# ---------------------------------------------------------------- the rules
_LETTERS = re.compile(r"[^\W\d_]")


def many_symbols(m: Measured) -> bool:
    """More symbols than a tenth of the words."""
    return 10 * m.n_symbols > m.n_words


def many_equal_lines(m: Measured) -> bool:
    """Over three tenths of the lines repeat an earlier one."""
    return 10 * m.n_dup_lines > 3 * m.n_lines


def odd_word_length(m: Measured) -> bool:
    """The mean word has under 2 or over 15 characters."""
    return m.word_chars < 2 * m.n_words or m.word_chars > 15 * m.n_words


def one_word_rules(m: Measured) -> bool:
    """One word is over three tenths of all."""
    return 10 * max(Counter(m.words).values()) > 3 * m.n_words


def shouting(m: Measured) -> bool:
    """Over half of the words have A-Z and no a-z."""
    upper = sum(1 for w in m.words if w.upper() == w and w.lower() != w)
    return 2 * upper > m.n_words


def exclaiming(m: Measured) -> bool:
    """Over three tenths of the words end in two exclamation or question marks."""
    return 10 * sum(1 for w in m.words if w.endswith((b"!!", b"??", b"!?", b"?!"))) > 3 * m.n_words


def few_letters(m: Measured) -> bool:
    """Over half of the words have neither a letter of A-Z or a-z nor a character beyond ASCII."""
    plain = b"".join(m.words).translate(None, b"0123456789")
    if len(plain) * 4 > 3 * sum(map(len, m.words)) and plain.isalpha():
        return False
    none = sum(1 for w in m.words if w.isascii() and not _LETTERS.search(w.decode()))
    return 2 * none > m.n_words


RULES = {f.__name__: f for f in (many_symbols, many_equal_lines, odd_word_length, one_word_rules, shouting, exclaiming, few_letters)}


# ---------------------------------------------------------------- the cascade
def _tried(batches):
    """Each sampled text that passes the base test under every rule: verdict bits and seconds by rule."""
    seconds = np.zeros(len(RULES))
    masks: Counter = Counter()
    for b in batches:
        for m in measured(b.column(0)):
            if m.base_failed:
                continue
            mask = 0
            for i, rule in enumerate(RULES.values()):
                began = time.perf_counter()
                mask |= rule(m) << i
                seconds[i] += time.perf_counter() - began
            masks[mask] += 1
    rows = list(masks.items())
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([seconds.tolist()] * len(rows), pa.list_(pa.float64()))],
        names=["mask", "n", "seconds"],
    )


def order_rules(masks: dict[int, int], seconds: list[float]) -> list[str]:
    """Rules by falling rejection per cost, each judged on what the ones before it let pass."""
    left, order = dict(masks), []
    names = list(RULES)
    rest = list(range(len(names)))
    while rest:
        gain = lambda i: sum(n for m, n in left.items() if m >> i & 1) / max(seconds[i], 1e-9)
        best = max(rest, key=lambda i: (gain(i), -seconds[i]))
        rest.remove(best)
        order.append(names[best])
        left = {m: n for m, n in left.items() if not m >> best & 1}
    return order


def _sample(docs: DataFrame) -> DataFrame:
    """The starts of SAMPLE_ROWS texts, those of least hash.

    Only rows under a bound on the hash, set from a count that reads no texts, leave their task, so what
    all tasks send together stays near SAMPLE_ROWS.
    """
    share = 2 * SAMPLE_ROWS / max(1, docs.count())
    key = F.xxhash64("doc_id", F.lit(5))
    rows = docs.select(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(key).alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    under = rows if share >= 1 else rows.where(F.col("h") < int(share * (1 << 64)) - (1 << 63))
    return under.orderBy("h", "text").limit(SAMPLE_ROWS).select("text")


def fit(docs: DataFrame) -> list[str]:
    """The rules in the order in which the cascade runs them, from SAMPLE_ROWS texts."""
    rows = _sample(docs).mapInArrow(_tried, "mask long, n long, seconds array<double>").collect()
    if not rows:
        return list(RULES)
    masks: Counter = Counter()
    seconds = np.zeros(len(RULES))
    for r in rows:
        masks[r["mask"]] += r["n"]
        seconds = np.maximum(seconds, r["seconds"])
    return order_rules(masks, seconds.tolist())


def verdict(m: Measured, order: list[str]) -> str | None:
    """The first rule that rejects, or None."""
    return next((name for name in order if RULES[name](m)), None)


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judged(order: list[str]):
    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(len(_LONGS) + 2)]
            for m in measured(b.column(1)):
                failed = m.base_failed
                for c, name in zip(cols, _LONGS):
                    c.append(getattr(m, name))
                cols[-2].append(failed)
                cols[-1].append(not failed and verdict(m, order) is None)
            arrays = [pa.array(c, pa.int64()) for c in cols[:-2]] + [pa.array(c, pa.bool_()) for c in cols[-2:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["doc_id", *_LONGS, "base_failed", "kept"])

    return tidy(run)


def measures(docs: DataFrame) -> DataFrame:
    """One row per document with its base measures, base_failed and kept."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(_judged(fit(narrow)), _OUT)


def _passed(order: list[str]):
    def run(batches):
        for b in batches:
            ok = []
            for m in measured(b.column("text")):
                ok.append(not m.base_failed and verdict(m, order) is None)
            yield b.filter(pa.array(ok, pa.bool_()))

    return tidy(run)


def keep_good(docs: DataFrame) -> DataFrame:
    """docs that pass the base test and every rule, all columns kept."""
    return docs.mapInArrow(_passed(fit(docs)), docs.schema)
