"""Interaction audit of five filters: what each removes at each step of each order, and what it alone catches.

Four filters look at a text alone; the fifth removes a text that a smaller id
has. For that, documents are routed by the xxhash of their text. A task keeps
chains of texts with equal fingerprints, each with its full text and the least
id that has it, and passes on the ids that aren't least, so of many copies in one
task one goes to the shuffle; the chains of all tasks then meet, sorted by
fingerprint, one at a time. What comes out is thin: id, part and a mask of failed
filters. Masks are counted by part in vectors (all, good, toxic) that tasks merge
before and after a shuffle, and every order and step is a sum over the 32 masks.

Defined cases: a null text is an empty one and a null lang an empty part; rows
equal in id and text are each counted and aren't copies of one another; a null id
is no smaller or larger than any, so such a row isn't a copy and has no labels; a
document has a label if any of its label rows has it; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, partitions, picked, text_or_empty, written

FILTERS = "ABCDE"
COPY = 16
#: Failure conditions of A to C: fewer words, distinct words in 100 words, capitals in 100 characters; characters that fail D.
WORDS, DISTINCT, CAPITALS, MARKS = 100, 80, 10, b"#$%&*|"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes of texts that a task's chains hold before they are passed on.
HELD = 1 << 26
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failed(text: str) -> int:
    """Mask of the filters A to D that a text fails."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at ASCII blanks
    capitals = len(data) - len(data.translate(None, _UPPER))
    return (len(words) < WORDS) | (100 * len(set(words)) < DISTINCT * len(words)) << 1 | (100 * capitals > CAPITALS * len(text)) << 2 | any(c in data for c in MARKS) << 3


class Chains:
    """Texts by fingerprint: [text, mask, least id, how many rows of each part have that id]."""

    def __init__(self):
        self.held, self.bytes = {}, 0

    def add(self, fingerprint: int, text: str, mask: int, doc_id, parts: Counter):
        """Takes rows with a text; gives (id, part, mask, rows) of those of which the id isn't the least."""
        chain = self.held.setdefault(fingerprint, [])
        own = next((x for x in chain if x[0] == text), None)
        if own is None:
            chain.append([text, mask, doc_id, parts])
            self.bytes += len(text)
            return
        if doc_id == own[2]:
            own[3] = own[3] + parts
            return
        gone, gone_parts = doc_id, parts
        if doc_id < own[2]:
            gone, gone_parts, own[2], own[3] = own[2], own[3], doc_id, parts
        for part, n in gone_parts.items():
            yield gone, part, mask | COPY, n

    def emptied(self):
        """All (fingerprint, entry), which are held no longer."""
        held, self.held, self.bytes = self.held, {}, 0
        for fingerprint, chain in held.items():
            for entry in chain:
                yield fingerprint, entry


def _spread(doc_id) -> int:
    return xxhash.xxh64_intdigest(str(doc_id))


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", held: int = HELD) -> DataFrame:
    """(id, part, mask, n): for each document, the filters that it fails; n rows are equal in that."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(part_col).alias("part"), text_or_empty(text_col).alias("text"))

    def near(rows):
        """What one task sees: (fingerprint, one row for each text), and (anywhere, a row that is settled)."""
        chains = Chains()
        for doc_id, part, text in rows:
            mask = failed(text)
            if doc_id is None:
                yield _spread(part), (None, None, part, mask, 1)
                continue
            for gone, its_part, its_mask, n in chains.add(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")), text, mask, doc_id, Counter([part])):
                yield _spread(gone), (None, gone, its_part, its_mask, n)
            if chains.bytes > held:
                for fingerprint, entry in chains.emptied():
                    yield fingerprint, (entry[0], entry[2], entry[3], entry[1], None)
        for fingerprint, entry in chains.emptied():
            yield fingerprint, (entry[0], entry[2], entry[3], entry[1], None)
        give_back()

    def far(routed):
        """The same among all tasks; rows come sorted by fingerprint, so one chain is held at a time."""
        chains, last = Chains(), None
        for fingerprint, (text, doc_id, part, mask, n) in routed:
            if text is None:
                yield doc_id, part, mask, n
                continue
            if fingerprint != last:
                yield from _least(chains)
                last = fingerprint
            yield from chains.add(fingerprint, text, mask, doc_id, part)
        yield from _least(chains)
        give_back()

    routed = rows.rdd.mapPartitions(near).repartitionAndSortWithinPartitions(partitions(docs), lambda fingerprint: fingerprint)
    return docs.sparkSession.createDataFrame(routed.mapPartitions(far), f"id {kind}, part string, mask int, n long", verifySchema=False)


def _least(chains: Chains):
    for _, (_, mask, doc_id, parts) in chains.emptied():
        for part, n in parts.items():
            yield doc_id, part, mask, n


def tables(part: str, counts: np.ndarray) -> list[tuple]:
    """The rows (part, filter_order, step, counts...) of each order and step, from counts (all, good, toxic) by mask."""
    every = np.arange(len(counts))
    sizes = np.bitwise_count(every)
    n = counts[:, 0]
    # a filter comes first of those that a document fails in one of so many orders, of 120
    shapley = [sum(int(n[m]) * 120 // int(sizes[m]) for m in every[(every & (1 << f)) > 0]) for f in range(len(FILTERS))]
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            own, name = (every & (1 << f)) > 0, "".join(FILTERS[x] for x in order)
            here, again = own & (every & before == 0), own & (every & before > 0)
            before |= 1 << f
            rows.append((part, name, step, int(n[every & before == 0].sum()), int(n[here].sum()), int(n[again].sum()), int(n[1 << f]), int(counts[here, 1].sum()), int(counts[here, 2].sum()), shapley[f]))
    return rows


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", held: int = HELD) -> DataFrame:
    """One row for each part, order of the filters and step."""
    spark = docs.sparkSession
    told = written(labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic"))), "labels")
    thin = masks(docs, id_col, text_col, part_col, held).join(picked(told)[1], "id", "left").select("part", "mask", "n", F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def begun(row):
        return more(np.zeros((1 << len(FILTERS), 3), np.int64), row)

    def more(counts, row):
        mask, n, good, toxic = row
        counts[mask] += np.array((n, n * good, n * toxic))
        return counts

    counted = thin.rdd.map(lambda r: (r[0], r[1:])).combineByKey(begun, more, lambda a, b: a + b, partitions(docs), lambda part: xxhash.xxh64_intdigest(part))
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return spark.createDataFrame(counted.flatMap(lambda x: tables(*x)), schema, verifySchema=False)


_LETTERS = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(FILTERS))
_FIVE = [f"l{i}" for i in range(len(FILTERS))]
_APART = " AND ".join(f"{a}.x <> {b}.x" for i, a in enumerate(_FIVE) for b in _FIVE[i + 1 :])
ORACLE_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
q AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, (len(w) < {WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {DISTINCT} * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITALS} * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > least, FALSE)::INT AS m, quality, toxic FROM w LEFT JOIN q ON w.doc_id = q.doc_id),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS bad FROM f GROUP BY ALL),
l AS (SELECT * FROM (VALUES {_LETTERS}) v(x, b)),
o AS (SELECT {" || ".join(f"{a}.x" for a in _FIVE)} AS filter_order, [{", ".join(f"{a}.b" for a in _FIVE)}] AS bits FROM {", ".join(f"l {a}" for a in _FIVE)} WHERE {_APART}),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS b, list_sum(bits[:step]) - bits[step] AS seen FROM o, range(1, 6) r(step))
SELECT part, filter_order, step, coalesce(sum(n) FILTER (m & (seen::INT | b) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (m & b > 0 AND m & seen::INT = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (m & b > 0 AND m & seen::INT > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (m = b), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (m & b > 0 AND m & seen::INT = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(bad) FILTER (m & b > 0 AND m & seen::INT = 0), 0)::BIGINT AS toxic_lost, coalesce(sum(n * 120 // greatest(bit_count(m), 1)) FILTER (m & b > 0), 0)::BIGINT AS shapley FROM c, s GROUP BY part, filter_order, step"""
