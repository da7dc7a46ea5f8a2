"""Grouping of spelling variants by an even-partition pigeonhole join.

Words are maximal runs of Latin letters, A-Z lower-cased. Two are near if one inserted, deleted or replaced
code point makes one of the other. A word of length l is cut into two segments, of l // 2 code points and
the rest; one edit leaves one of them whole. Each word is indexed under both, with its length; a word probes
the index of its own length and of the length one shorter, with the substrings that stand where a whole
segment would: the first at the start, the second at the end, so shifted by one in a longer word. A pair
found under both segments counts under the first; candidates are verified by their edit distance.

A segment that many words share is split by the same principle: within it the edit lies in the rest of the
word, and one half of that rest is whole. The join is on equal keys, its result is the near pairs alone, and
adaptive execution may split what is left of a hot key.

A word's form is its near word of the largest count if that is FORM_RATIO times its own. Counts grow by that
factor along a chain of forms, so its length is bounded by a logarithm of the largest count, and the last of a
chain is found by that many doublings.

Defined cases: a null or empty text has no words; texts and words of any length are read whole; near words
that tie in count are ordered by code points; a word without a near word has n_near 0 and is its own root;
repeated rows count each, null doc_ids draw by the empty text; an empty table gives an empty table; columns
beyond doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pagequarry.llm.common import scope, segments, stored, tidy

#: A run of a document whose hash this number divides loses a code point.
TYPO_EVERY = 199
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 6, 5, 5
#: Words under one segment from which it is split.
HOT = 128
#: Bytes up to which words are compared by the edit distance function.
SHORT = 64
#: Bytes of text counted together, and bytes of one text that become objects at a time.
SEGMENT, PART = 16 << 20, 1 << 20


# ---------------------------------------------------------------- words
def letters_only(text: bytes) -> bytes:
    """UTF-8 text, lower-cased in A-Z, with a space for all that is no letter of [A-Za-z\\u00C0-\\u00FF].

    The letters from U+00C0 on are the byte C3 and its continuation.
    """
    raw = np.frombuffer(text.lower(), np.uint8)
    keep = _ASCII_LETTER[raw]
    lead = np.flatnonzero(raw == 0xC3)
    keep[lead] = True
    keep[lead[lead + 1 < len(raw)] + 1] = True
    return np.where(keep, raw, 32).astype(np.uint8).tobytes()


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[ord("a") : ord("z") + 1] = True


def typo(word: bytes, h: int) -> bytes:
    """The word without its code point number h % length."""
    s = word.decode()
    at = h % len(s)
    return (s[:at] + s[at + 1 :]).encode()


def _runs(text: bytes) -> Counter:
    shown = letters_only(text)
    found: Counter = Counter()
    at = 0
    while at < len(shown):
        end = shown.find(b" ", at + PART)
        end = len(shown) if end < 0 else end
        found.update(shown[at:end].split())
        at = end
    return found


def _counted(typo_every: int):
    def run(batches):
        for b in segments(batches, 1, SEGMENT):
            total: Counter = Counter()
            texts = b.column(1).cast(pa.large_binary())
            for doc_id, text in zip(b.column(0).to_pylist(), texts):
                if not text.is_valid:
                    continue
                start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for word, n in _runs(text.as_py()).items():
                    h = zlib.crc32(word, start)
                    if h % typo_every == 0:
                        word = typo(word, h)
                    total[word] += n
            words = pa.array(list(total), pa.binary()).cast(pa.string())
            counts = pa.array(list(total.values()), pa.int64())
            long = pc.greater_equal(pc.utf8_length(words), LEAST_LENGTH)
            yield pa.RecordBatch.from_arrays([words.filter(long), counts.filter(long)], names=["word", "n"])

    return tidy(run)


def word_counts(docs: DataFrame, typo_every: int = TYPO_EVERY, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: the distinct words of at least six code points that occur often enough."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    each = narrow.mapInArrow(_counted(typo_every), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---------------------------------------------------------------- near words
def _parts(word: Column, length: Column, longer: int) -> Column:
    """The two segments, as structs of number, segment and the rest, that a word has in the index for `length`.

    longer: how much longer the word is than the words of that index.
    """
    half = F.floor(length / 2).cast("int")
    cut = half + longer
    first = F.struct(F.lit(1).alias("i"), F.substring(word, F.lit(1), half).alias("segment"), F.substring(word, half + 1, F.char_length(word)).alias("rest"))
    second = F.struct(F.lit(2).alias("i"), F.substring(word, cut + 1, F.char_length(word)).alias("segment"), F.substring(word, F.lit(1), cut).alias("rest"))
    return F.array(first, second)


def _halves(rest: Column, longer: Column) -> Column:
    """The halves of the rest, as structs of number and half, that take the segment's place once more."""
    size = F.char_length(rest) - longer
    half = F.floor(size / 2).cast("int")
    first = F.struct(F.lit(1).alias("j"), F.substring(rest, F.lit(1), half).alias("half"))
    second = F.struct(F.lit(2).alias("j"), F.substring(rest, half + longer + 1, F.char_length(rest)).alias("half"))
    return F.array(first, second)


_KEY = ["length", "i", "segment"]


def _keyed(words: DataFrame, longer: tuple[int, ...]) -> DataFrame:
    out = None
    for d in longer:
        length = F.char_length("word") - d
        one = words.where(length > 0).select("word", "n", length.alias("length"), F.lit(d).alias("longer"), F.inline(_parts(F.col("word"), length, d)))
        out = one if out is None else out.unionByName(one)
    return out


def _split(keyed: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of hot segments once for each half of the rest, the others as they are (j 0)."""
    marked = keyed.join(hot, _KEY, "left")
    whole = F.array(F.struct(F.lit(0).alias("j"), F.lit("").alias("half")))
    return marked.select(*keyed.columns, F.inline(F.when(F.col("hot"), _halves(F.col("rest"), F.col("longer"))).otherwise(whole)))


def _one_edit(a: Column, b: Column) -> Column:
    """Whether one edit makes b, which is as long as a or longer by one, of a.

    Long words are compared at the end of what they begin with alike, which is found by halving: the edit
    distance function takes time in the square of their length.
    """

    def longer(same: Column, step: Column) -> Column:
        more = same + step
        return F.when((more <= F.char_length(a)) & (F.substring(a, F.lit(1), more) == F.substring(b, F.lit(1), more)), more).otherwise(same)

    same = F.aggregate(F.array(*[F.lit(1 << k) for k in range(29, -1, -1)]), F.lit(0), longer)
    after = F.substring(b, same + 2, F.char_length(b))
    halved = F.when(F.char_length(a) == F.char_length(b), (same < F.char_length(a)) & (F.substring(a, same + 2, F.char_length(a)) == after))
    halved = halved.otherwise(F.substring(a, same + 1, F.char_length(a)) == after)
    return F.when(F.octet_length(b) <= SHORT, F.levenshtein(a, b, 1) == 1).otherwise(halved)


def near_pairs(words: DataFrame, hot_from: int = HOT) -> DataFrame:
    """a, na, b, nb: each pair of near words once; words (word, n) must be distinct and a stored table."""
    index = _keyed(words, (0,))
    hot = index.groupBy(*_KEY).agg(F.count("*").alias("size")).where(F.col("size") > hot_from).select(*_KEY, F.lit(True).alias("hot"))
    hot = stored(hot, "hot-segments")
    left = _split(index, hot).drop("longer").withColumnsRenamed({"word": "a", "n": "na", "rest": "ra"})
    right = _split(_keyed(words, (0, 1)), hot).withColumnsRenamed({"word": "b", "n": "nb", "rest": "rb"})
    keys = [*_KEY, "j", "half"]
    both = left.alias("l").join(right.alias("r"), [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys])
    half = F.floor(F.col("l.length") / 2).cast("int")
    # The rest of a pair found under the second segment begins with the first one; that of a pair found under the second half, with the first half.
    first_too = F.substring("a", F.lit(1), half) == F.substring("b", F.lit(1), half)
    quarter = F.floor(F.char_length("ra") / 2).cast("int")
    half_too = F.substring("ra", F.lit(1), quarter) == F.substring("rb", F.lit(1), quarter)
    once = ((F.col("l.i") == 1) | ~first_too) & ((F.col("l.j") < 2) | ~half_too)
    order = (F.col("longer") == 1) | (F.col("a") < F.col("b"))
    return both.where(order & once & _one_edit(F.col("ra"), F.col("rb"))).select("a", "na", "b", "nb")


# ---------------------------------------------------------------- forms
def variants(words: DataFrame, ratio: int = FORM_RATIO, hot_from: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word (word, n)."""
    keep: list[DataFrame] = []
    with scope(keep):
        words = stored(words, "words")
        pairs = stored(near_pairs(words, hot_from), "near-words")
        both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("other_n"))
        both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("other_n")))
        best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("least"), "other")).alias("best"))
        told = words.join(best, "word", "left")
        formed = -F.col("best.least") >= ratio * F.col("n")
        told = told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.least")).alias("form_n"))
        told = stored(told, "forms")
        chain = stored(_last(told.where("form is not null").select("word", F.col("form").alias("root")), words.agg(F.max("n")).first()[0] or 1, ratio), "roots")
        keep += [told, chain]
    out = told.join(chain, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _last(chain: DataFrame, largest: int, ratio: int) -> DataFrame:
    """word, root: root moved on to the last of the word's chain. A chain of k forms takes counts up by ratio ** k."""
    longest = math.floor(math.log(largest, ratio) + 1e-9)
    for _ in range(max(0, math.ceil(math.log2(max(1, longest))))):
        chain = stored(chain, "chain")
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chain = chain.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return chain
