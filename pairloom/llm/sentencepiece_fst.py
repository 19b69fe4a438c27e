"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into three parts. The normaliser is a transducer of few
states: it escapes blanks, writes the dummy prefix, and drops blanks that stand
too many where the model says so. The piece transducer is a trie whose arcs, put
end to end, read the normalised text and write piece ids. The byte fallback reads
any character that no piece covers and writes the ids of its UTF-8 bytes. A text
is composed with them into a lattice, whose shortest path in the tropical
semiring (least sum of weights) is the encoding.

Weights depend on the model's kind. A unigram piece weighs minus its score. In a
BPE model an arc weighs the number of its characters, and infinity after a piece
that merging by score would join or change together with it: the paths of finite
weight are those whose neighbours stay apart, which leaves one for each place of
the text, and it is what merging gives. Whether two pieces stay apart follows
from the order in which each of them is merged on its own.

For a BPE model a text is cut where no piece can reach across (derived from the
vocabulary), so each piece of work is short, and results are kept by segment in a
bounded cache. For a unigram model the whole text is one lattice, as the library
rounds sums over the whole of it, and that decides between paths of equal weight.

Models with a character map, user-defined pieces or unescaped blanks are refused:
no public vocabulary at hand has them, so they couldn't be held against the library.

Defined cases: a null or empty text gives no ids; every input row gives a row;
extra columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RunCache, chunks, column_of, forget_caches, gather, text_or_empty, tokenizer_path, worker_cache

ESCAPE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
#: Segments in each generation of a worker's cache, and pairs of pieces of which is known whether they stay apart.
KEPT_SEGMENTS, KEPT_PAIRS = 150_000, 200_000
#: Bytes of text that are cut into segments at a time: each segment is a string of its own, many times its size.
CUT_BYTES = 1 << 18
INFINITE = float("inf")


class Normaliser:
    """What a model does to a text before it is cut, as a transducer.

    States are the text's start, within it, and after a blank that is still to be
    written. Where blanks all stay, it has one state after the prefix, whose only
    arc that changes a character is the blank's.
    """

    START, WITHIN, BLANK = range(3)

    def __init__(self, prefix: str, single_blanks: bool):
        self.prefix = prefix
        self.always = (" ", ESCAPE)
        # (state, whether a blank is read): (written before it, written for it, next state); None: the character itself
        self.arcs = {
            (self.START, True): ("", "", self.START), (self.START, False): (prefix, None, self.WITHIN),
            (self.WITHIN, True): ("", "", self.BLANK), (self.WITHIN, False): ("", None, self.WITHIN),
            (self.BLANK, True): ("", "", self.BLANK), (self.BLANK, False): (ESCAPE, None, self.WITHIN),
        } if single_blanks else None

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if self.arcs is None:
            return self.prefix + text.replace(*self.always)
        out, state = [], self.START
        for run in re.findall(" +|[^ ]+", text):  # a run of one kind takes its first arc, and then one that stays
            before, written_, state = self.arcs[state, run[0] == " "]
            out += [before, run if written_ is None else written_]
        return "".join(out).rstrip(ESCAPE)


class Transducer:
    """A compiled model. It needs no library at run time."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are compiled")
        if proto.normalizer_spec.precompiled_charsmap or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError("only normalisers without a character map and with escaped blanks are compiled")
        if any(p.type == USER for p in proto.pieces):
            raise ValueError("user-defined pieces are not compiled")
        self.prefix = ESCAPE if proto.normalizer_spec.add_dummy_prefix else ""
        self.normalise = Normaliser(self.prefix, proto.normalizer_spec.remove_extra_whitespaces)
        self.text = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN), 0)
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type in (CONTROL, UNKNOWN)}
        self.longest = max(map(len, self.ids), default=1)
        self.trie: dict = {}
        for piece in self.ids:
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece
        if self.kind == UNIGRAM:  # sums of weights are rounded as the library rounds them, which decides between equal ones
            self.score = {p: np.float32(s) for p, s in self.score.items()}
        self.unknown_weight = np.float32(10) - min(self.score.values(), default=np.float32(0))
        self.apart: dict[tuple[str, str], bool] = {}
        self.made: dict[str, tuple | None] = {}
        # what each id writes when decoded
        self.written = [b"" if i in self.silent else bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(ESCAPE, " ").encode() for i, p in enumerate(self.text)]
        # a blank can only begin a piece (or stand among blanks), and these characters are in no piece
        letters = {c for piece in self.ids for c in piece}
        alone = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in letters)
        if self.kind == UNIGRAM:  # the library's sums are rounded over the whole text
            self.segments = re.compile(r"(?s).+")
        elif any(re.search(f"[^{ESCAPE}]{ESCAPE}", piece) for piece in self.ids):
            self.segments = re.compile(f"[^{alone}]+|[{alone}]" if alone else r"(?s).+")
        else:
            self.segments = re.compile(f"{ESCAPE}*[^{ESCAPE}{alone}]+|{ESCAPE}+" + (f"|[{alone}]" if alone else ""))

    # -- which pieces may follow each other in a BPE model

    def merge(self, text: str, order: list | None = None) -> list[str]:
        """Merging by score, the leftmost first among equals: what defines a BPE model. `order` gets (score, first and last part after it)."""
        parts, score = list(text), self.score.get
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(-s, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (s := score(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        end = len(parts) - 1
        while heap:
            s, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if j == end:
                end = i
            if after[i] < len(parts):
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(parts) and (w := score(parts[left] + parts[right])) is not None:
                    heapq.heappush(heap, (-w, left, parts[left], parts[right]))
            if order is not None:
                order.append((-s, parts[0], parts[end]))
        return [p for p in parts if p is not None]

    def making(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """(scores of the merges that make a piece, its first and its last part before each and at the end); None if merging its text doesn't give it."""
        got = self.made.get(piece, ())
        if got == ():
            order: list = []
            whole = self.merge(piece, order) == [piece]
            got = self.made[piece] = ([x for x, _, _ in order], [piece[0], *(x for _, x, _ in order)], [piece[-1], *(x for _, _, x in order)]) if whole else None
        return got

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether merging a and b put together gives just the two: the merges of either, and those across them, in the order of their scores."""
        got = self.apart.get((a, b))
        if got is not None:
            return got
        if not (self.making(a) and self.making(b)):
            return False
        (own, _, lasts), (other, firsts, _) = self.making(a), self.making(b)
        i = j = 0
        across = self.score.get(lasts[0] + firsts[0], -INFINITE)
        while True:
            left = own[i] if i < len(own) else -INFINITE
            right = other[j] if j < len(other) else -INFINITE
            if across > left and across >= right:
                got = False
                break
            if left >= right:
                if i == len(own):
                    got = True
                    break
                i += 1
            else:
                j += 1
            across = self.score.get(lasts[i] + firsts[j], -INFINITE)
        if len(self.apart) > KEPT_PAIRS:
            self.apart.clear()
        self.apart[a, b] = got
        return got

    # -- composition with an input, and its shortest path

    def arcs(self, text: str, at: int) -> list[str]:
        """Pieces that the text has at a place, the longest last; a character that is no piece is an arc to the byte fallback."""
        found, node = [], self.trie
        try:
            for c in text[at : at + self.longest]:
                node = node[c]
                if "" in node:
                    found.append(node[""])
        except KeyError:
            pass
        if not found or len(found[0]) > 1:
            found.insert(0, text[at])
        return found

    def write(self, piece: str) -> tuple[int, ...]:
        known = self.ids.get(piece)
        if known is not None:
            return (known,)
        if self.bytes:
            return tuple(self.bytes[b] for b in piece.encode("utf-8", "surrogatepass"))
        return (self.unknown,)

    def shortest_unigram(self, text: str) -> list[str]:
        """The pieces of the shortest path through the lattice of a text: places are relaxed from left to right."""
        best: list[float] = [np.float32(0)] + [INFINITE] * len(text)
        come = [""] * (len(text) + 1)  # the piece by which the least weight is reached
        for at in range(len(text)):
            for piece in self.arcs(text, at):
                weight = best[at] + (-self.score[piece] if piece in self.score else self.unknown_weight)
                if weight < best[at + len(piece)]:
                    best[at + len(piece)], come[at + len(piece)] = weight, piece
        return _way_back(come, len(text))

    def shortest_bpe(self, text: str) -> list[str]:
        """The same where what is left of a text weighs as many as it has characters on any finite path: the place that
        lies furthest is opened first, its longest arc first, and a place that is reached has its least weight."""
        come, open_ = {0: ""}, [(0, self.arcs(text, 0))]
        apart, end = self.apart, len(text)
        while open_:
            at, arcs = open_[-1]
            if not arcs:
                open_.pop()
                continue
            piece = arcs.pop()
            to = at + len(piece)
            if to in come:
                continue
            if at:
                finite = apart.get((come[at], piece))
                if finite is None:
                    finite = self.stay_apart(come[at], piece)
            else:
                finite = self.making(piece)
            if finite:
                come[to] = piece
                if to == end:
                    return _way_back(come, to)
                open_.append((to, self.arcs(text, to)))
        return self.merge(text)  # equal scores can leave no path; the definition then decides

    def encode_segment(self, segment: str) -> list[int]:
        return [i for p in (self.shortest_bpe if self.kind == BPE else self.shortest_unigram)(segment) for i in self.write(p)]

    def encode_all(self, texts: list[str], known: RunCache) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text)."""
        segments, counts = [], [0]
        for text in texts:
            segments += self.segments.findall(self.normalise(text))
            counts.append(len(segments))
        data, starts, sizes = known.runs_of(segments, lambda new: list(map(self.encode_segment, new)))
        ids = data[gather(starts, sizes)] if segments else np.zeros(0, np.uint32)
        return ids.astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])[counts]

    def encode(self, text: str, known: RunCache) -> list[int]:
        return self.encode_all([text], known)[0].tolist()

    # -- decoding

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of the text of each run of ids: blanks unescaped, the dummy prefix taken off."""
        pieces = pa.array(self.written, pa.binary()).take(pa.array(ids))
        whole = pa.compute.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pieces), b"")
        return _without_blank(whole) if self.prefix else whole

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0].as_py().decode("utf-8", "replace")


def _way_back(come, at: int) -> list[str]:
    """The pieces of the path that ends at a place, given the last piece of each place's."""
    out = []
    while at:
        out.append(come[at])
        at -= len(come[at])
    return out[::-1]


def _without_blank(texts: pa.Array) -> pa.Array:
    """Binary texts without a blank at their begin."""
    first = pa.compute.starts_with(texts, b" ")
    return pa.compute.if_else(first, pa.compute.binary_replace_slice(texts, 0, 1, b""), texts)


def compiled(model: bytes) -> tuple[Transducer, RunCache]:
    """The transducer and the segment cache of this worker."""
    cache = worker_cache("sentencepiece")
    key = zlib.crc32(model)
    if key not in cache:
        cache[key] = (Transducer(model), RunCache(KEPT_SEGMENTS))
    return cache[key]


def model_bytes(path: str | None) -> bytes:
    with open(path or tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """One row for each document: id, ids (array of int), n_ids, n_byte_ids, ids_crc32, and whether decoding gives the text back."""
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))  # a vocabulary file, of fixed size
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        forget_caches(but="sentencepiece")
        fst, known = compiled(model.value)
        is_byte = np.zeros(len(fst.text), bool)
        is_byte[list(fst.byte_of)] = True
        for batch in chunks(batches, limit=CUT_BYTES):
            texts = column_of(batch, "text")
            ids, offsets = fst.encode_all(texts.to_pylist(), known)
            bytes_before = np.concatenate([[0], np.cumsum(is_byte[ids])])
            plain = ids.astype("<u4")
            sums = [zlib.crc32(plain[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
            same = pa.compute.equal(fst.decode_all(ids, offsets), texts.cast(pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)), pa.array(np.diff(offsets)), pa.array(np.diff(bytes_before[offsets])), pa.array(sums, pa.int64()), same],
                ["id", "ids", "n_ids", "n_byte_ids", "ids_crc32", "round_trip"],
            )

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    found = rows.mapInArrow(run, f"id {id_type}, ids array<int>, n_ids long, n_byte_ids long, ids_crc32 long, round_trip boolean")
    return found.withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """One row for each row of ids: id and text. Null ids are no ids."""
    model = encoded.sparkSession.sparkContext.broadcast(model_bytes(model_path))
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        fst, _ = compiled(model.value)
        for batch in batches:
            lists = column_of(batch, "ids")
            sizes = np.asarray(pa.compute.list_value_length(lists).fill_null(0))
            found = fst.decode_all(np.asarray(lists.flatten(), np.int64), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
            texts = [x.decode("utf-8", "replace") for x in found.to_pylist()]
            yield pa.RecordBatch.from_arrays([column_of(batch, "id"), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {id_type}, text string").withColumnRenamed("id", id_col)
