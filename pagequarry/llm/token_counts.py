"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is a word [^\\x20\\x09-\\x0D]+ with the word mark in front. Its segmentation is the one of the
highest total score; of equal scores, the one with fewer tokens. The pieces come from a public
vocabulary, and a piece's score falls with its rank as in Zipf's law, -log(rank + 2), since that file
holds ranks and no probabilities. A character that no piece covers becomes its bytes, one token each,
at a score below all pieces'.

A task inserts its distinct pre-tokens in a trie. A node is a prefix, and the best score and count of a
prefix depend on nothing that follows: they are computed once, when the node is made, from the nodes
above it. The count at a pre-token's last node is kept for the pre-token.

Defined cases: a null or empty text has no words and no tokens; a text of any length is read whole; of
segmentations that tie in score and count any gives the same count; repeated rows and null doc_ids each
give a row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pagequarry.llm.common import segments, starts_of, tidy

MARK = "▁"
#: Nodes after which a task's trie starts anew.
NODES = 400_000
#: Bytes of text whose distinct words are inserted together.
SEGMENT = 16 << 20


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_pieces(path: str) -> dict[str, float]:
    """Piece -> score. Control pieces, byte pieces and pieces of marks only are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or (len(p) > 1 and not p.strip(MARK))):
            scores[p] = -math.log(len(scores) + 2)
    return scores


class Trie:
    """Prefixes with their best score and token count."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str] | int, int] = {}
        self.score, self.count = [0.0], [0]

    def insert(self, word: str) -> int:
        """The token count of the word."""
        if len(self.score) > NODES:
            self.clear()
        path = [0]
        node = 0
        child, score, count = self.child, self.score, self.count
        for end in range(1, len(word) + 1):
            key = node << 21 | ord(word[end - 1])
            node = child.get(key, -1)
            if node < 0:
                node = child[key] = len(score)
                best, fewest = self._forward(word, end, path)
                score.append(best)
                count.append(fewest)
            path.append(node)
        return count[node]

    def _forward(self, word: str, end: int, path: list[int]) -> tuple[float, int]:
        last = word[end - 1]
        at = path[end - 1]
        scores = self.scores
        if last in scores:
            best, fewest = self.score[at] + scores[last], self.count[at] + 1
        else:
            best, fewest = self.score[at] + self.unknown, self.count[at] + len(last.encode())
        for start in range(max(0, end - self.longest), end - 1):
            s = scores.get(word[start:end])
            if s is not None:
                at = path[start]
                s += self.score[at]
                if s > best or (s == best and self.count[at] + 1 < fewest):
                    best, fewest = s, self.count[at] + 1
        return best, fewest


_SCORES: dict[str, dict[str, float]] = {}


def _counted(path: str):
    def run(batches):
        if path not in _SCORES:
            _SCORES[path] = read_pieces(path)
        trie = Trie(_SCORES[path])
        for b in segments(batches, 1, SEGMENT):
            words = pc.ascii_split_whitespace(b.column(1).fill_null(""))
            coded = words.flatten().dictionary_encode()
            known = coded.dictionary.to_pylist()
            count = np.fromiter((trie.insert(MARK + w) if w else 0 for w in known), np.int64, len(known))
            some = np.fromiter(map(bool, known), bool, len(known))  # white space at an end leaves an empty word
            index, cuts = coded.indices.to_numpy(), starts_of(words.value_lengths().to_numpy(zero_copy_only=False))
            sums = [np.diff(starts_of(x[index])[cuts]) for x in (some, count)]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, sums)], names=["doc_id", "n_words", "n_tokens"])

    return tidy(run)


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(_counted(path or vocabulary_path()), "doc_id long, n_words long, n_tokens long")
