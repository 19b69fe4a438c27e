"""SimHash near-duplicate groups by a binary trie self-join.

A document's fingerprint has a bit set if more than half of its shingles' XXH64
values (seed 42) have it. Copies of one fingerprint count as one leaf. To join
fingerprints within `errors` bits, the 64 bits are cut into blocks; two such
fingerprints agree on some combination of blocks, so each combination is a table
whose rows with equal blocks meet. There, the remaining bits form a binary trie,
and node pairs are descended together: the bits in which their known prefixes
differ are added up, and a pair over the budget is dropped with all below it.
Pairs of subtrees already known to be one group are dropped too, so a large
group of near copies costs no quadratic work and emits a spanning star only.
With more fingerprints, more and narrower combinations are used; every size
gives the same links.

Defined cases: a null or empty text has fingerprint 0 and links like any other;
a text of fewer words than a shingle is one shingle; repeated rows are returned
each; a null id doesn't become a component's id unless no other is there; an
empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bottom_k
from .common import chunks, column_of, forget_caches, give_back, numbered, picked, text_or_empty, written
from .components import components
from .shingles import majority_bits, shingle_hashes

BITS = 64
#: Node pairs that are descended at a time, and fingerprints of a table that a task holds at a time, about.
STEP, HELD = 1 << 16, 1 << 18


def fingerprints_of(texts: pa.Array, width: int) -> np.ndarray:
    """The fingerprint of each text."""
    hashes, offsets = shingle_hashes(texts, width)
    return np.array([majority_bits(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp) of each document; fp is the unsigned fingerprint's bits as a long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in chunks(batches):
            found = fingerprints_of(column_of(batch, "text"), width)
            yield pa.RecordBatch.from_arrays([column_of(batch, "id"), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {id_type}, fp long")


def layout(n: int, errors: int, bucket: int = 256) -> tuple[list[int], list[tuple[int, ...]]]:
    """(first bit of each block and the end, combinations of blocks): about `bucket` fingerprints or fewer of n agree on a combination."""
    blocks = errors + 1
    while blocks < errors + 4 and n >> (BITS * (blocks - errors) // blocks) > bucket:
        blocks += 1
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return cuts, list(combinations(range(blocks), blocks - errors))


def permuted(fps: np.ndarray, cuts: list[int], chosen: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """Fingerprints with the chosen blocks' bits first, and the number of those bits."""
    out, used = np.zeros(len(fps), np.uint64), 0
    order = [*chosen, *(b for b in range(len(cuts) - 1) if b not in chosen)]
    for b in order:
        width = cuts[b + 1] - cuts[b]
        part = (fps >> np.uint64(BITS - cuts[b + 1])) & np.uint64((1 << width) - 1)
        used += width
        out |= part << np.uint64(BITS - used)
    return out, sum(cuts[b + 1] - cuts[b] for b in chosen)


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray, joined: list | None = None) -> np.ndarray:
    """Labels after linking a[i] with b[i]: each group has its least member. joined takes the links by which groups became one."""
    while len(a):
        ra, rb = label[a], label[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        lower, upper = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(label, upper, lower)
        if joined is not None:
            won = np.flatnonzero(label[upper] == lower)
            won = won[np.unique(upper[won], return_index=True)[1]]
            joined.append((a[won], b[won]))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def trie_groups(keys: np.ndarray, fixed: int, errors: int, joined: list | None = None) -> np.ndarray:
    """Group label of each of the sorted distinct keys; keys are linked if the first `fixed` bits agree and `errors` others at most differ.

    A trie node is a range lo..hi of the sorted keys; its branch bit is the first in which its ends differ.
    joined takes arrays (i, j) of the places of linked keys, by which each group hangs together.
    """
    n = len(keys)
    label = np.arange(n)
    if n < 2:
        return label

    def known(lo, hi):
        """Bits that all keys of the range share."""
        differ = keys[lo] ^ keys[hi - 1]
        upper = differ >> np.uint64(32)
        length = np.frexp(np.where(upper > 0, upper, differ).astype(np.float64))[1]  # exact: under 2 ** 32
        return BITS - length - 32 * (upper > 0)

    def halves(lo, hi, bits):
        """Where the upper child of each range begins."""
        shift = np.maximum(BITS - 1 - bits, 0).astype(np.uint64)
        return np.where(bits == BITS, (lo + hi) // 2, np.searchsorted(keys, (keys[hi - 1] >> shift) << shift))

    top = keys >> np.uint64(BITS - fixed)
    begin = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
    end = np.append(begin[1:], n)
    many = end - begin > 1
    stack = [("own", np.stack([begin[many], end[many]]))]
    changes = np.arange(n)  # equal at both ends of a range whose labels are all one
    while stack:
        kind, work = stack.pop()
        if work.shape[1] > STEP:
            stack.append((kind, work[:, STEP:]))
            work = work[:, :STEP]
        if kind == "own":
            lo, hi = work
            mixed = changes[hi - 1] != changes[lo]
            lo, hi = lo[mixed], hi[mixed]
            if not len(lo):
                continue
            mid = halves(lo, hi, known(lo, hi))
            stack.append(("pair", np.stack([lo, mid, mid, hi])))
            children = np.concatenate([np.stack([lo, mid]), np.stack([mid, hi])], axis=1)
            children = children[:, children[1] - children[0] > 1]
            if children.shape[1]:
                stack.append(("own", children))
            continue
        a, b, c, d = work
        apart = ~((changes[b - 1] == changes[a]) & (changes[d - 1] == changes[c]) & (label[a] == label[c]))
        a, b, c, d = a[apart], b[apart], c[apart], d[apart]
        bits_a, bits_c = known(a, b), known(c, d)
        shared = np.minimum(bits_a, bits_c)
        near = np.bitwise_count((keys[a] ^ keys[c]) >> (BITS - shared).astype(np.uint64)) <= errors
        a, b, c, d, bits_a, bits_c = a[near], b[near], c[near], d[near], bits_a[near], bits_c[near]
        leaves = (b - a == 1) & (d - c == 1)
        if leaves.any():
            label = _settle(label, a[leaves], c[leaves], joined)
            changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        a, b, c, d, bits_a, bits_c = a[~leaves], b[~leaves], c[~leaves], d[~leaves], bits_a[~leaves], bits_c[~leaves]
        if len(a):
            swap = (b - a == 1) | ((d - c > 1) & (bits_a > bits_c))  # open the node of which less is known, never a leaf
            a, b, c, d = np.where(swap, c, a), np.where(swap, d, b), np.where(swap, a, c), np.where(swap, b, d)
            mid = halves(a, b, np.where(swap, bits_c, bits_a))
            stack.append(("pair", np.concatenate([np.stack([a, mid, c, d]), np.stack([mid, b, c, d])], axis=1)))
    return label


def spanning_links(distinct: DataFrame, n: int, errors: int, held: int = HELD, stars: bool = True) -> DataFrame:
    """Links (u, v) between the distinct fingerprints fp that span every group of fingerprints within `errors` bits.

    A meeting's group is given as a star around its least fingerprint, or else by links that are within `errors` bits themselves.
    """
    cuts, tables = layout(n, errors)
    block = [F.shiftrightunsigned("fp", BITS - cuts[b + 1]).bitwiseAND(F.lit((1 << (cuts[b + 1] - cuts[b])) - 1)) for b in range(len(cuts) - 1)]
    rows = [F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *(block[b] for b in chosen)).alias("meet")) for t, chosen in enumerate(tables)]
    dealt = distinct.select("fp", F.inline(F.array(*rows))).repartition("t", "meet").sortWithinPartitions("t", "meet")

    def linked(t, own):
        keys, fixed = permuted(own, cuts, tables[t])
        order = np.argsort(keys)
        keys, own = keys[order], own[order].view(np.int64)
        joined = None if stars else [(np.zeros(0, np.int64),) * 2]
        label = trie_groups(keys, fixed, errors, joined)
        member = np.flatnonzero(label != np.arange(len(label)))
        a, b = (member, label[member]) if stars else map(np.concatenate, zip(*joined, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(own[b])], ["u", "v"])

    def run(batches):
        """Fingerprints that meet follow each other, so about `held` of one table are in memory, or one meeting of more."""
        forget_caches()
        own, size, last = [], 0, None
        for batch in batches:
            t, meet, fps = np.asarray(column_of(batch, "t")), np.asarray(column_of(batch, "meet")), np.asarray(column_of(batch, "fp")).view(np.uint64)
            cuts_at = [0, *(np.flatnonzero((t[1:] != t[:-1]) | (meet[1:] != meet[:-1])) + 1).tolist(), len(t)]
            for lo, hi in zip(cuts_at[:-1], cuts_at[1:], strict=True):
                if hi > lo:
                    if own and (last[0] != t[lo] or (size >= held and last[1] != meet[lo])):
                        yield linked(last[0], np.concatenate(own))
                        own, size = [], 0
                    own.append(fps[lo:hi])
                    size, last = size + hi - lo, (t[lo], meet[lo])
        if own:
            yield linked(last[0], np.concatenate(own))
        give_back()

    return dealt.select("fp", "t", "meet").mapInArrow(run, "u long, v long")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, errors: int = 4) -> DataFrame:
    """One row for each document: id, fingerprint (16 hexadecimal digits) and component_id, the least id reachable."""
    marked = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(spanning_links(distinct.select("fp"), distinct.count(), errors))
    grouped = written(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "grouped")
    least = written(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = written(grouped.join(least, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_pairs(sets: DataFrame, errors: int) -> DataFrame:
    """(u, v) of sets (key, fp): pairs within `errors` bits that span every group of sets whose fingerprints are."""
    marked = written(sets.select("key", "fp"), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    links = written(spanning_links(distinct.select("fp"), distinct.count(), errors, stars=False).distinct(), "links")
    ends = distinct.select(F.col("fp").alias("u"), F.col("least").alias("a")), distinct.select(F.col("fp").alias("v"), F.col("least").alias("b"))
    between = links.join(ends[0], "u").join(ends[1], "v")
    within = marked.join(distinct, "fp").filter(F.col("key") != F.col("least")).select(F.col("least").alias("a"), F.col("key").alias("b"))
    return between.select("a", "b").union(within).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, errors: int = 4) -> DataFrame:
    """docs without near duplicates: one row of each group stays, that with the least id; all columns stay.

    Texts are alike if the sets of their shingles (of `width` words) have that Jaccard similarity or more, and a group
    is all that is reached by such links. Sets whose fingerprints the trie join finds within `errors` bits are compared
    first, on the whole sets; what it joins is one group from then on. Alike texts further apart in bits are found by
    inverted lists of their rarest shingles, so that `errors` changes the work only and never the result.

    Defined cases: a null text is an empty one; texts without a word are alike to each other and to no other; a text of
    fewer words than a shingle is one shingle; null ids come after all others, and of equal ids the first row in the
    order of files stays; of repeated rows one stays; an empty table gives an empty result; other columns are carried
    along whatever their names.
    """
    names, rows = docs.columns, numbered(docs)  # (_doc, _key): the row and its key, the same however often they are read
    grouped = bottom_k.similar_groups(rows, id_col, text_col, width, similarity, empty_alike=True, early=lambda sets: near_pairs(sets, errors))
    dropped = written(grouped.filter(F.col("key") != F.col("least.r")).select(F.col("key").alias("_key")), "dropped")
    return rows.join(picked(dropped)[1], "_key", "left_anti").select(*(F.col("_doc")[n].alias(n) for n in names))
