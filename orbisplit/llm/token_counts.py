"""Token counts under a unigram vocabulary, by dynamic programming over a trie of distinct pre-tokens.

The best score of a prefix doesn't depend on what follows it, so words that share a prefix share its forward scores. Each
task inserts the distinct pre-tokens of its rows in a trie that stays over all its batches: a node holds the best score of the
prefix it stands for, which is computed when the node is made and never again, and where a word ends, the token count of its
best segmentation is stored. Texts are then sums of look-ups of terminal counts.

Scores are whole numbers, so that sums are exact; of equal scores the segmentation with fewer tokens wins. A code point that
no piece covers costs its UTF-8 bytes as one token each.

Defined cases: a null or blank text has no tokens; a word is segmented whole whatever its length, its prefix beyond
``DEPTH`` code points outside the trie with the scores of the last few prefixes alone; a null key is carried through; repeated rows
are counted each; an empty table gives an empty one; further columns, whatever their names, are ignored. The trie is emptied when it
has ``NODES`` nodes or terminals, so memory is bounded.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbisplit.llm.common import bounded_batches

#: Nodes, or words, at which a trie is emptied; and its depth.
NODES, DEPTH = 1_200_000, 128
#: The mark that stands before a word in the vocabulary.
MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    scores: dict[str, int]
    byte_score: int
    longest: int


def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    """The pieces of a sentencepiece file. Scores of a unigram model are log-probabilities; those of a BPE model are ranks
    and become the log-probabilities of Zipf's law. Read on the driver: the vocabulary has a fixed size and is broadcast."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ranked = any(s <= -1000 for _, s in raw)
    scores = {p: round(-1000 * math.log(2 - s)) if ranked else round(1000 * s) for p, s in raw}
    return Vocabulary(scores, min(scores.values()) - 1000, max(map(len, scores)))


class Trie:
    """Prefixes of words with their best scores, and token counts where words end."""

    def __init__(self, v: Vocabulary, nodes: int = NODES) -> None:
        self.v, self.nodes = v, nodes
        #: (node << 21 | code point) to the node one code point on; node 0 is the root.
        self.edges: dict[int, int] = {}
        self.scores, self.minus = array("q", [0]), array("q", [0])
        #: Words that end at a node, with the count that is stored there.
        self.terminals: dict[str, int] = {}

    def clear(self) -> None:
        self.edges.clear()
        self.terminals.clear()
        del self.scores[1:], self.minus[1:]

    def _step(self, word: str, end: int, before: list[tuple[int, int]]) -> tuple[int, int]:
        """(score, minus tokens) of word[:end], from those of the prefixes that end just before, the last one last."""
        n = len(word[end - 1].encode())
        score, minus = before[-1]
        best = (score + n * self.v.byte_score, minus - n)
        first = end - len(before)
        pieces = self.v.scores
        for start in range(max(first, end - self.v.longest), end):
            own = pieces.get(word[start:end])
            if own is not None:
                score, minus = before[start - first]
                best = max(best, (score + own, minus - 1))
        return best

    def insert(self, word: str) -> int:
        """The tokens of a word."""
        if max(len(self.scores), len(self.terminals)) >= self.nodes:
            self.clear()
        marked = MARK + word
        node, way = 0, [(0, 0)]
        for end in range(1, len(marked) + 1):
            if end <= DEPTH:
                key = node << 21 | ord(marked[end - 1])
                known = self.edges.get(key)
                if known is None:
                    score, minus = self._step(marked, end, way)
                    known = self.edges[key] = len(self.scores)
                    self.scores.append(score)
                    self.minus.append(minus)
                node = known
                way.append((self.scores[node], self.minus[node]))
            else:
                way.append(self._step(marked, end, way))
                if len(way) > 8 * self.v.longest + DEPTH:
                    del way[: -self.v.longest]
        tokens = self.terminals[word] = -way[-1][1]
        return tokens

    def count(self, words: list[str]) -> int:
        """The tokens of all words."""
        known = self.terminals
        return sum(known[w] if w in known else self.insert(w) for w in words)


def count(docs: DataFrame, model: str = DEFAULT_MODEL, key: str = "doc_id", text: str = "text", nodes: int = NODES) -> DataFrame:
    """key, n_pretokens, n_tokens of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    narrow = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value, nodes)
        for b in batches:
            texts = [[w.decode() for w in t.encode().split()] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(list(map(trie.count, texts)), pa.int64())],
                ["k", "n_pretokens", "n_tokens"],
            )

    kind = narrow.schema["k"].dataType.simpleString()
    return narrow.mapInArrow(run, f"k {kind}, n_pretokens long, n_tokens long").withColumnRenamed("k", key)
