"""Fill-in-the-middle transformation by a table-driven byte DFA.

A text is cut into units, white space with the word after it or white space at the end, by one scan of
its UTF-8 bytes. The automaton's classes are white space, the bytes of a sentinel, continuation bytes,
other bytes and the end of a text; its states say whether a word is open and how much of a sentinel has
been read. A transition may emit: the end of a unit, a code point, a sentinel. The counts of what a text
emits give its units and whether it holds a sentinel; a second pass over the transitions finds the places
of the two cuts that were drawn.

The scan runs the same table over many lanes of a batch at once. What a state is after LOOKBACK bytes does
not depend on the state before them (that is read off the table), so a lane starts with the bytes before it.

Defined cases: a null text counts as empty; an empty text, one with a sentinel and one that is not drawn
are left plain; a cut may fall at either end, and both cuts may tie, which leaves a part empty; a null
doc_id draws by the empty text in its place; repeated rows each give a row; a text of any length is one
scan; an empty table gives an empty table; columns beyond doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagequarry.llm.common import SPACE, segments, tidy

#: Classes of bytes; END stands between texts.
BLANK, LESS, LETTER, GREATER, CONTINUED, OTHER, END = range(7)
CLASSES = 7
#: States: a text's start, in white space, in a word, and there after `<`, after its letter, after a sentinel.
START, GAP, WORD, OPENED, NAMED, CLOSED = range(6)
STATES = 6
#: The letters of the sentinels <P>, <S> and <M>.
LETTERS = b"PSM"
#: Bytes of text that are scanned together, and lanes they are cut into.
SEGMENT, LANES = 4 << 20, 4096


def _class_table() -> np.ndarray:
    of = np.full(256, OTHER, np.uint8)
    of[0x80:0xC0] = CONTINUED
    of[list(SPACE)] = BLANK
    of[list(LETTERS)] = LETTER
    of[ord("<")], of[ord(">")] = LESS, GREATER
    return of


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Next state, and whether a transition ends a unit, begins a code point, completes a sentinel."""
    nxt = np.full((STATES, CLASSES), WORD, np.uint8)
    nxt[:, BLANK], nxt[:, LESS], nxt[:, END] = GAP, OPENED, START
    nxt[OPENED, LETTER] = NAMED
    nxt[NAMED, GREATER] = CLOSED
    unit, point, mark = (np.zeros((STATES, CLASSES), bool) for _ in range(3))
    unit[WORD:, [BLANK, END]] = True
    unit[GAP, END] = True
    point[:, [BLANK, LESS, LETTER, GREATER, OTHER]] = True
    mark[NAMED, GREATER] = True
    return nxt.ravel(), unit.ravel(), point.ravel(), mark.ravel()


CLASS = _class_table()
NEXT, UNIT, POINT, MARK = _tables()


def _lookback() -> int:
    """The number of bytes after which all states have become one, whatever the bytes."""
    for k in itertools.count(1):
        if all(len({_after(s, seq) for s in range(STATES)}) == 1 for seq in itertools.product(range(CLASSES), repeat=k)):
            return k


def _after(state: int, classes) -> int:
    for c in classes:
        state = int(NEXT[state * CLASSES + c])
    return state


LOOKBACK = _lookback()


# ---------------------------------------------------------------- first pass
def transitions(classes: np.ndarray) -> np.ndarray:
    """The transition (state x class) taken at each symbol of a stream that begins with a text."""
    n = len(classes)
    width = max(LOOKBACK, -(-n // LANES))
    lanes = -(-n // width)
    padded = np.full(LOOKBACK + lanes * width, END, np.uint8)
    padded[LOOKBACK : LOOKBACK + n] = classes
    state = np.full(lanes, START, np.uint8)
    for k in range(LOOKBACK):  # what stands before each lane
        state = NEXT[state * CLASSES + padded[k : k + lanes * width : width]]
    columns = np.ascontiguousarray(padded[LOOKBACK:].reshape(lanes, width).T)
    for step in columns:
        step += state * CLASSES
        state = NEXT[step]
    return np.ascontiguousarray(columns.T).ravel()[:n]


def scanned(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, where each begins, the transitions of their stream and where each text begins there."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    begins = at + np.arange(len(at))  # an END after each text
    inside = np.ones(begins[-1], bool)
    inside[begins[1:] - 1] = False
    stream = np.full(begins[-1], END, np.uint8)
    stream[inside] = CLASS[raw]
    return raw.tobytes(), at, transitions(stream), begins


def _sums(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many flags are set from each start up to the next one; starts ascend and may repeat."""
    edges = np.concatenate((starts, [len(flags)]))
    out = np.zeros(len(starts), np.int64)
    some = np.flatnonzero(np.diff(edges))
    if len(some):
        out[some] = np.add.reduceat(flags.view(np.uint8), starts[some], dtype=np.int64)
    return out


# ---------------------------------------------------------------- second pass
def _drawn(doc_id, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def _transformed(seed: int, rate: int, suffix_first: int):
    def run(batches):
        for b in segments(batches, 1, SEGMENT):
            ids = b.column(0).to_pylist()
            raw, at, taken, begins = scanned(b.column(1))
            first = begins[:-1]
            n, marks = _sums(UNIT[taken], first), _sums(MARK[taken], first)
            draws = [_drawn(i, seed) for i in ids]
            two = np.array([sorted((d[0] % (k + 1), d[1] % (k + 1))) for d, k in zip(draws, n.tolist())], np.int64).reshape(-1, 2)
            ends = np.append(np.flatnonzero(UNIT[taken]), 0)  # unit j of a text ends before symbol ends[base + j]
            base = np.cumsum(n) - n
            cuts = np.where(two > 0, ends[base[:, None] + np.maximum(two, 1) - 1], first[:, None])
            points = _sums(POINT[taken], np.concatenate((first[:, None], cuts), axis=1).ravel()).reshape(-1, 3)
            cuts -= np.arange(len(ids))[:, None]  # places in the texts' bytes
            rows = []
            for i, d in enumerate(draws):
                low, high = int(at[i]), int(at[i + 1])
                if low == high or marks[i] or d[2] % 100 >= rate:
                    rows.append(("plain", None, None, raw[low:high]))
                    continue
                p, m, s = raw[low : cuts[i, 0]], raw[cuts[i, 0] : cuts[i, 1]], raw[cuts[i, 1] : high]
                if d[3] % 100 < suffix_first:
                    rows.append(("spm", points[i, 0], points[i, 1], b"".join((b"<S>", s, b"<P>", p, b"<M>", m))))
                else:
                    rows.append(("psm", points[i, 0], points[i, 1], b"".join((b"<P>", p, b"<S>", s, b"<M>", m))))
            form, prefix, middle, out = zip(*rows) if rows else ((), (), (), ())
            counts = [pa.array([None if x is None else int(x) for x in c], pa.int64()) for c in (prefix, middle)]
            columns = [b.column(0), pa.array(n), pa.array(form, pa.string()), *counts, pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return tidy(run)


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output of each document.

    rate: of a hundred documents, those that are cut; suffix_first: of a hundred of these, those whose suffix leads.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return narrow.mapInArrow(_transformed(seed, rate, suffix_first), out)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text that is cut holds no sentinel, so that the output has its own three only."""
    parts = F.split(output, "<[PSM]>", -1)
    p, s, m = (F.when(form == "psm", parts[i]).otherwise(parts[j]) for i, j in ((1, 2), (2, 1), (3, 3)))
    return F.when(form == "plain", output).otherwise(F.concat(p, m, s))
