"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary's trie gets failure links (LinMaxMatch, Song et al. 2021). Where a
word's next character has no arc, the longest piece matched so far is popped and
the automaton goes on from the state of what is left. What a state pops before
that is known beforehand, and for counting only its number is needed, so a word
is counted in one pass over its characters and no piece is ever built.

Pieces that begin a word carry the model's word mark (▁), others continue one,
as in a word-piece vocabulary with marked continuations. A word with a place
where no piece matches is one unknown token as a whole.

Defined cases: a null or empty text has no words and no tokens; every input row
gives a row; extra columns are not looked at; an empty table gives an empty
result; words of any length are counted whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, chunks, column_of, text_or_empty, tokenizer_path, words_of, worker_cache

MARK = "▁"
#: Words in each generation of a worker's cache.
KEPT_WORDS = 200_000


class LinearMatcher:
    """Trie of the pieces, with each state's failure link and the number of pieces that it pops."""

    def __init__(self, pieces: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        depth_first: list[tuple[int, int, str]] = []
        for piece in pieces:
            node = 0
            for c in piece:
                child = self.arcs[node].get(c)
                if child is None:
                    child = self.arcs[node][c] = len(self.arcs)
                    self.arcs.append({})
                    self.final.append(False)
                    depth_first.append((child, node, c))
                node = child
            if piece:
                self.final[node] = True
        n = len(self.arcs)
        self.fail, self.pops = [-1] * n, [0] * n
        order, level = [], [0]
        while level:  # parents before children
            order += level
            level = [child for node in level for child in self.arcs[node].values()]
        came = {child: (node, c) for child, node, c in depth_first}
        for state in order[1:]:
            if self.final[state]:
                self.fail[state], self.pops[state] = 0, 1
                continue
            node, c = came[state]
            at, popped = self.fail[node], self.pops[node]
            while at >= 0 and c not in self.arcs[at]:
                popped += self.pops[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[state], self.pops[state] = self.arcs[at][c], popped

    def count(self, word: str) -> int:
        """Pieces of the greedy longest match of the whole word, or -1 if it has none."""
        arcs, fail, pops = self.arcs, self.fail, self.pops
        state = total = 0
        for c in word:
            while (to := arcs[state].get(c)) is None:
                total += pops[state]
                state = fail[state]
                if state < 0:
                    return -1
            state = to
        while state > 0:
            total += pops[state]
            state = fail[state]
        return -1 if state < 0 else total


def pieces_of(path: str | None) -> list[str]:
    """The ordinary pieces of a SentencePiece model file, which mark the beginning of a word."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path or tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    return [p.piece for p in proto.pieces if p.type == 1]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pieces: list[str] | None = None) -> DataFrame:
    """One row for each document: id, n_words, n_tokens, and n_unknown (words that are one unknown token)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(pieces if pieces is not None else pieces_of(None))  # a vocabulary, of fixed size
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        cache = worker_cache("word pieces")
        key = hash(tuple(sent.value))
        if key not in cache:
            cache[key] = (LinearMatcher(sent.value), Kept(KEPT_WORDS))
        matcher, known = cache[key]
        for batch in chunks(batches):
            words, codes, offsets = words_of(column_of(batch, "text"))
            counts = []
            for w in words.to_pylist():
                n = known.get(w)
                if n is None:
                    n = matcher.count(MARK + w)
                    known.put(w, n)
                counts.append(n)
            each = np.array(counts, np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
            sums = np.concatenate([[0], np.cumsum(np.where(each < 0, 1, each))])
            unknown = np.concatenate([[0], np.cumsum(each < 0)])
            values = [np.diff(offsets), np.diff(sums[offsets]), np.diff(unknown[offsets])]
            yield pa.RecordBatch.from_arrays([column_of(batch, "id"), *(pa.array(v, pa.int64()) for v in values)], ["id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_col)
