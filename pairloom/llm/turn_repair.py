"""Repair of damaged conversations by a rank-compressed dynamic programme.

Rows are brought into the form of `(s?(ua)+)?` (role initials) at the least cost
by keeping (0), rerolling to user or assistant (3), deleting (4) and inserting
empty turns (3); a truncated row that stays costs 3 more, and blank or repeated
rows must go. Of equally cheap repairs the one whose audit string (the edits'
initials in order) is least is taken.

A layer of the programme is a row. Its macro edits are a run of insertions and
what becomes of the row: D, ID, IID, IIK, IIR, IK, IR, K, R in order. No code
begins another, so equally long sequences of codes compare as their strings do,
and a string is known by its rank in the layer: the next rank follows from the
rank before and the code, and strings are spelt out only at the end, along the
parent pointers. A longer run of insertions comes back to a state that a shorter
one has, at a higher cost.

Rows are dealt by ranges of (conversation, turn, ...), so a conversation may be
spread over tasks. Each task folds its part of a conversation into a block: cost
and rank from each of the four states to each. A conversation that a task holds
whole is done there. For the others the blocks, a few numbers each, are chained
in order, which tells each block where it begins and ends; the blocks then spell
their part, and the digest is taken over the parts in order, one at a time.

Defined cases: nulls in key, role and text are one space (a null conv_id is a
conversation of its own); rows of one turn come by role, then by the SHA-256 of
their text, and equal rows are one the repetition of the other; a conversation of
which no row is left, or whose rows must all go, has an empty repair; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, give_back, numbered, partitions, picked, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Macro edits in the order of their strings.
CODES = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn; the state that a user or assistant turn leads to.
STATES, NEXT = 4, (2, 2, 3, 2)
INITIALS = {"s": 1, "u": 2, "a": 3}
FAR = 1 << 40
#: Rows of a block at most, and rows and bytes of text that are folded at a time, about.
BLOCK, ROWS, BYTES = 1 << 9, 1 << 14, 1 << 23
BLANKS = " \t\n\x0b\x0c\r"


def _edges() -> list[tuple[int, int, str]]:
    """(state before, insertions, state after them): no more insertions than bring a new state."""
    found = []
    for state in range(STATES):
        at, seen, run = state, [], 0
        while at not in seen:
            found.append((state, run, at))
            seen.append(at)
            at, run = NEXT[at], run + 1
    return found


EDGES = _edges()


# -- damage


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, key, copy, digest, gone, fault) of each row after damage; a dropped one is marked as gone.

    fault: 0 none, 1 blank, 3 truncated (repetitions are found later).
    """
    space = F.lit(" ")
    plain = lambda c: F.coalesce(F.col(f"_doc.{c}").cast("string"), space)
    kind = F.pmod(F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    made = numbered(rows).withColumn("kind", kind).select(
        F.col("_doc.conv_id").alias("conv_id"), F.col("_doc.turn").alias("turn"), F.when(F.col("kind") == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text"), F.col("_key").alias("key"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"), (F.col("kind") == 0).alias("gone"),
    )
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(last == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    return made.withColumn("digest", F.sha2("text", 256)).withColumn("fault", F.when(F.col("gone"), 0).otherwise(fault).cast("int"))


def repeated(rows: DataFrame) -> DataFrame:
    """(key, copy) of the rows whose role and text came earlier in their conversation.

    Only numbers and digests move, and the first of each text is an aggregate, so a text that many rows have isn't gathered.
    """
    same = ["conv_id", "role", "digest"]
    thin = rows.filter("not gone").select(*same, F.struct(F.col("turn").isNotNull().alias("n"), "turn", "key", "copy").alias("at"))
    several = written(thin.groupBy(*same).agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "repeated")
    r, s = thin.alias("r"), picked(several)[1].alias("s")
    on = F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("r.role") == F.col("s.role")) & (F.col("r.digest") == F.col("s.digest"))
    return r.join(s, on).filter(F.col("r.at") != F.col("s.first")).select("r.at.key", "r.at.copy")


# -- the programme


def dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each item among the distinct ones of its row."""
    order = np.argsort(keys, axis=1, kind="stable")
    held = np.take_along_axis(keys, order, axis=1)
    steps = np.concatenate([np.zeros((len(keys), 1), np.int64), np.cumsum(held[:, 1:] != held[:, :-1], axis=1)], axis=1)
    ranks = np.empty_like(steps)
    np.put_along_axis(ranks, order, steps, axis=1)
    return ranks


def folded(initial: np.ndarray, fault: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cost, rank, pointers): of each segment start..end of the rows, the cheapest way from each state to each, the rank of
    its string among the 16, and for each row, state at the segment's beginning and state after the row: state before * 16 + code.

    initial: 1 s, 2 u, 3 a, 0 another; fault: 0 none, 1 blank, 2 repeated, 3 truncated. Layers of all segments go together.
    """
    n = len(starts)
    cost = np.where(np.eye(STATES, dtype=bool), 0, FAR)[None].repeat(n, axis=0)
    rank = np.zeros((n, STATES, STATES), np.int64)
    pointers = np.zeros((len(initial), STATES, STATES), np.uint8)
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    for layer in range(int(length.max(initial=0))):
        live = order[: int(np.searchsorted(-length[order], -layer, side="left"))]
        row = starts[live] + layer
        own, must = initial[row][:, None], np.isin(fault[row], (1, 2))[:, None]
        more = np.where(fault[row] == 3, TRUNCATED, 0)[:, None]
        at, by = cost[live], rank[live]
        best = np.full((len(live), STATES, STATES), np.iinfo(np.int64).max)
        came = np.zeros((len(live), STATES, STATES), np.uint8)

        def offer(before, run, after, edit, allowed, price):
            code = CODES.index("I" * run + edit)
            key = np.where(allowed & (at[:, :, before] < FAR), ((at[:, :, before] + run * INSERT + price) << 8) | (by[:, :, before] << 4) | code, np.iinfo(np.int64).max)
            better = key < best[:, :, after]
            best[:, :, after] = np.where(better, key, best[:, :, after])
            came[:, :, after] = np.where(better, before * 16 + code, came[:, :, after])

        for before, run, state in EDGES:
            offer(before, run, state, "D", True, DELETE)
            offer(before, run, NEXT[state], "K", ~must & (own == NEXT[state]), KEEP + more)
            offer(before, run, NEXT[state], "R", ~must, REROLE + more)
            if state == 0:
                offer(before, run, 1, "K", ~must & (own == 1), KEEP + more)
        there = best < np.iinfo(np.int64).max
        cost[live] = np.where(there, best >> 8, FAR)
        rank[live] = dense(np.where(there, best & 255, 256).reshape(len(live), -1)).reshape(best.shape)
        pointers[row] = came
    return cost, rank, pointers


def closed(cost, rank) -> tuple[int, int, int]:
    """(cost, last state, insertions after it) of the cheapest way to a complete sequence, of costs and ranks by state."""
    ends = [(0, 0)] + [(state, run) for state, run, at in EDGES if at == 3]
    total, _, run, state = min((int(cost[s]) + run * INSERT, int(rank[s]), run, s) for s, run in ends)
    return total, state, run


def inserted(state: int, run: int) -> tuple[list[str], int]:
    """(the turns that so many insertions add after a state, the state after them)."""
    turns = []
    for _ in range(run):
        state = NEXT[state]
        turns.append("user:" if state == 2 else "assistant:")
    return turns, state


def spelt(pointers: np.ndarray, entry: int, leave: int, roles: list[str], texts: list[str]) -> tuple[str, list[str]]:
    """(audit, repaired turns) of a segment, along its pointers from the last row to the first."""
    codes, state = [""] * len(roles), leave
    for i in range(len(roles) - 1, -1, -1):
        at = int(pointers[i, entry, state])
        codes[i], state = CODES[at & 15], at >> 4
    turns, state = [], entry
    for code, role, text in zip(codes, roles, texts, strict=True):
        new, state = inserted(state, len(code) - 1)
        turns += new
        if code[-1] == "K":
            state = 1 if role[:1] == "s" else NEXT[state]
            turns.append(f"{role}:{text}")
        elif code[-1] == "R":
            state = NEXT[state]
            turns.append(f"{'user' if state == 2 else 'assistant'}:{text}")
    return "".join(codes), turns


def legal(a: int, b: int) -> bool:
    return (a, b) in ((1, 2), (2, 3), (3, 2))


# -- blocks of the sorted rows

RESULT = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}
COUNTED = {"blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "turns": "long", "low": "long", "high": "long", "first": "int", "last": "int"}
PLACE = {"part": "int", "seq": "long"}
MATRIX = {"costs": "array<long>", "ranks": "array<long>"}
TEXTS = {"pointers": "binary", "roles": "array<string>", "texts": "array<string>"}
TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _ddl(conv: str, fields: dict[str, str]) -> str:
    return ", ".join([f"conv_id {conv}", *(f"{c} {t}" for c, t in fields.items())])


def _batch(rows: list[dict], conv: pa.DataType, fields: dict[str, str]) -> pa.RecordBatch:
    arrays = [pa.array([r["conv_id"] for r in rows], conv), *(pa.array([r.get(c) for r in rows], TYPES[t]) for c, t in fields.items())]
    return pa.RecordBatch.from_arrays(arrays, ["conv_id", *fields])


def _pieces(batches, columns: list[str], block: int, most: int):
    """Lists of rows in order, about `most` rows or BYTES of text each, cut between conversations unless the last is longer than `block` rows."""
    held, size = {c: [] for c in columns}, 0
    for batch in batches:
        for at in range(0, batch.num_rows, block):
            part = batch.slice(at, block)
            for c in columns:
                held[c] += column_of(part, c).to_pylist()
            size += int(pa.compute.sum(pa.compute.binary_length(column_of(part, "text"))).as_py() or 0)
            n = len(held["conv_id"])
            if n >= most or size >= BYTES:
                cut = n
                while n - cut < block and cut and held["conv_id"][cut - 1] == held["conv_id"][-1]:
                    cut -= 1
                cut = n if n - cut >= block or not cut else cut
                yield {c: v[:cut] for c, v in held.items()}
                held, size = {c: v[cut:] for c, v in held.items()}, 0
    if held["conv_id"]:
        yield held


def _segments(piece: dict, block: int):
    """(first row, end, whether this is all of its conversation here, facts) of each run of rows of one conversation, or of `block` rows of it."""
    conv, n = piece["conv_id"], len(piece["conv_id"])
    bounds = [0, *(i for i in range(1, n) if conv[i] != conv[i - 1]), n]
    here = np.flatnonzero(~np.array(piece["gone"], bool))  # rows that weren't dropped
    initial = np.array([INITIALS.get(piece["role"][i][:1], 0) for i in here], np.int64)
    fault = np.array([piece["fault"][i] for i in here], np.int64)
    cuts = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        a, b = np.searchsorted(here, [lo, hi]).tolist()
        at = [*range(a, b, block), b] if b > a else [a, b]
        cuts += [(lo, hi, x, y, len(at) == 2) for x, y in zip(at[:-1], at[1:], strict=True)]
    cost, rank, pointers = folded(initial, fault, np.array([c[2] for c in cuts], np.int64), np.array([c[3] for c in cuts], np.int64))
    for k, (lo, hi, x, y, alone) in enumerate(cuts):
        turns = [t for t in (piece["turn"][i] for i in here[x:y]) if t is not None]
        own = initial[x:y].tolist()
        yield lo, hi, alone, {
            "conv_id": conv[lo], **{name: int((fault[x:y] == f).sum()) for f, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))}, "illegal": sum(not legal(a, b) for a, b in zip(own[:-1], own[1:], strict=True)),
            "turns": len(set(turns)), "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "first": own[0] if own else None, "last": own[-1] if own else None,
            "cost": cost[k], "rank": rank[k], "pointers": pointers[x:y], "roles": [piece["role"][i] for i in here[x:y]], "texts": [piece["text"][i] for i in here[x:y]],
        }


def _gaps(facts: dict) -> int:
    return facts["high"] - facts["low"] + 1 - facts["turns"] if facts["turns"] else 0


def blocks(rows: DataFrame, block: int, most: int) -> DataFrame:
    """Sorted rows folded: results of conversations that a task holds whole, and blocks (part isn't null) of those that may go on in another one."""
    kind, columns = rows.schema["conv_id"].dataType.simpleString(), ["conv_id", "turn", "role", "text", "gone", "fault"]
    fields = RESULT | COUNTED | PLACE | MATRIX | TEXTS

    def run(batches):
        part, seq, conv_type = TaskContext.get().partitionId(), 0, None

        def typed():
            nonlocal conv_type
            for batch in batches:
                conv_type = column_of(batch, "conv_id").type
                yield batch

        before, pieces = None, _pieces(typed(), columns, block, most)
        piece = next(pieces, None)
        while piece is not None:
            after, made = next(pieces, None), []
            n, conv = len(piece["conv_id"]), piece["conv_id"]
            begun = before is None or before[0] == conv[0]  # what an earlier task holds isn't known here
            goes_on = after is None or after["conv_id"][0] == conv[-1]
            for lo, hi, alone, facts in _segments(piece, block):
                if alone and not (lo == 0 and begun) and not (hi == n and goes_on):
                    total, leave, tail = closed(facts["cost"][0], facts["rank"][0])
                    audit, turns = spelt(facts["pointers"], 0, leave, facts["roles"], facts["texts"])
                    digest = hashlib.sha256("\n".join(turns + inserted(leave, tail)[0]).encode()).hexdigest()
                    made.append({c: facts[c] for c in ("conv_id", "blank", "duplicate", "truncated", "illegal")} | {"gaps": _gaps(facts), "cost": total, "audit": audit + "I" * tail, "repaired_sha256": digest})
                else:
                    costs, ranks = facts["cost"].ravel().tolist(), facts["rank"].ravel().tolist()
                    made.append({c: facts[c] for c in ("conv_id", *COUNTED, "roles", "texts")} | {"part": part, "seq": seq, "costs": costs, "ranks": ranks, "pointers": facts["pointers"].tobytes()})
                    seq += 1
            yield _batch(made, conv_type, fields)
            before, piece = (conv[-1],), after
        give_back()

    return rows.select(*columns).mapInArrow(run, _ddl(kind, fields))


# -- conversations that more than one block holds


def _by_conversation(batches, columns: list[str]):
    """(conv_id, its rows one by one) of rows sorted by conversation."""

    def rows():
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                yield from batch.slice(at, BLOCK).select(columns).to_pylist()

    return groupby(rows(), key=lambda r: r["conv_id"])


def chained(open_blocks: DataFrame) -> DataFrame:
    """(part, seq, entry, leave, tail) of each block, and on the last one of a conversation its results but for the texts.

    A conversation's blocks go by in order, and 16 numbers of each are kept until its end: some bytes for BLOCK rows.
    """
    kind = open_blocks.schema["conv_id"].dataType.simpleString()
    fields = PLACE | {"entry": "int", "leave": "int", "tail": "int"} | {c: t for c, t in RESULT.items() if t == "long"}
    columns = ["conv_id", *PLACE, *COUNTED, *MATRIX]

    def chain(batches):
        conv_type = None

        def typed():
            nonlocal conv_type
            for batch in batches:
                conv_type = column_of(batch, "conv_id").type
                yield batch

        for conv, own in _by_conversation(typed(), columns):
            cost, rank, back, total = [0] + [FAR] * (STATES - 1), [0] * STATES, [], None
            for b in own:
                ways = [min((min(FAR, cost[s] + b["costs"][s * STATES + t]), rank[s], b["ranks"][s * STATES + t], s) for s in range(STATES)) for t in range(STATES)]
                order = sorted({w[1:3] for w in ways if w[0] < FAR})
                cost, rank = [w[0] for w in ways], [order.index(w[1:3]) if w[0] < FAR else 0 for w in ways]
                back.append((b["part"], b["seq"], [w[3] for w in ways]))
                total = _joined_facts(total, b)
            cheapest, leave, tail = closed(cost, rank)
            made = []
            for k, (part, seq, came) in enumerate(reversed(back)):
                made.append({"conv_id": conv, "part": part, "seq": seq, "entry": came[leave], "leave": leave, "tail": 0 if k else tail})
                leave = came[leave]
            made[0] |= {c: total[c] for c in ("blank", "duplicate", "truncated", "illegal")} | {"gaps": _gaps(total), "cost": cheapest}
            yield _batch(made, conv_type, fields)

    thin = open_blocks.select(*columns).repartition(partitions(open_blocks), "conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return thin.mapInArrow(chain, _ddl(kind, fields))


def _joined_facts(a: dict | None, b: dict) -> dict:
    """Counts of rows that follow each other; turns that both have are the last of one and the first of the other."""
    if a is None:
        return dict(b)
    out = {c: a[c] + b[c] for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += a["last"] is not None and b["first"] is not None and not legal(a["last"], b["first"])
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    out["low"], out["high"] = (x if x is not None else y for x, y in ((a["low"], b["low"]), (b["high"], a["high"])))
    out["first"], out["last"] = (x if x is not None else y for x, y in ((a["first"], b["first"]), (b["last"], a["last"])))
    return out


def finished(open_blocks: DataFrame) -> DataFrame:
    """Results of conversations in several blocks: each block spells its part, and the parts go by in order."""
    kind = open_blocks.schema["conv_id"].dataType.simpleString()
    numbers = [c for c, t in RESULT.items() if t == "long"]
    told = written(chained(open_blocks).drop("conv_id"), "chained")
    spelling = PLACE | {c: "long" for c in numbers} | {"audit": "string", "turns": "array<string>"}

    def spell(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8):
                part = batch.slice(at, 8)
                made = []
                for r in part.to_pylist():
                    pointers = np.frombuffer(r["pointers"], np.uint8).reshape(-1, STATES, STATES)
                    audit, turns = spelt(pointers, r["entry"], r["leave"], r["roles"], r["texts"])
                    made.append({**{c: r[c] for c in ("conv_id", *PLACE, *numbers)}, "audit": audit + "I" * r["tail"], "turns": turns + inserted(r["leave"], r["tail"])[0]})
                yield _batch(made, column_of(part, "conv_id").type, spelling)

    def digest(batches):
        conv_type = None

        def typed():
            nonlocal conv_type
            for batch in batches:
                conv_type = column_of(batch, "conv_id").type
                yield batch

        for conv, own in _by_conversation(typed(), ["conv_id", *spelling]):
            sha, audit, first, last = hashlib.sha256(), [], True, None
            for last in own:
                audit.append(last["audit"])
                for turn in last["turns"]:
                    sha.update((turn if first else "\n" + turn).encode())
                    first = False
            yield _batch([{"conv_id": conv, **{c: last[c] for c in numbers}, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], conv_type, RESULT)

    parts = open_blocks.select("conv_id", *PLACE, *TEXTS).join(picked(told)[1], [*PLACE]).mapInArrow(spell, _ddl(kind, spelling))
    return parts.repartition(partitions(open_blocks), "conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(digest, _ddl(kind, RESULT))


def repaired(conversations: DataFrame, block: int = BLOCK, most: int = ROWS) -> DataFrame:
    """One row for each conv_id: faults after damage, the cheapest repair's cost and audit string, and the SHA-256 of the repaired turns."""
    rows = damaged(conversations)
    later = written(repeated(rows), "repeats").withColumn("_again", F.lit(True))
    marked = rows.join(picked(later)[1], ["key", "copy"], "left").withColumn("fault", F.when(F.col("_again") & (F.col("fault") != 1), 2).otherwise(F.col("fault")))
    order = ["conv_id", "turn", "role", "digest", "key", "copy"]  # nulls come first
    dealt = marked.select(*order, "text", "gone", "fault").repartitionByRange(partitions(conversations), *order).sortWithinPartitions(*order)
    made = written(blocks(dealt, block, most), "blocks")
    return made.filter("part is null").select("conv_id", *RESULT).unionByName(finished(made.filter("part is not null")))


_ENTRIES = ", ".join(f"({before}, {run}, {after})" for before, run, after in EDGES)
_TURNS = "list_transform(range(e.run), lambda k: CASE WHEN (CASE WHEN k = 0 THEN {next} WHEN {next} = 2 THEN 3 ELSE 2 END) = 2 THEN 'user:' ELSE 'assistant:' END)"
_NEXT = "(CASE WHEN {0} = 2 THEN 3 ELSE 2 END)"
ORACLE_SQL = rf"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
h AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM h, crc),
b AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM g WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM b),
f AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS own FROM o),
e AS (SELECT * FROM (VALUES {_ENTRIES}) v(was, run, now)),
ways AS (SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS made FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL
  SELECT conv_id, i, state, cost, audit, made FROM (SELECT w.conv_id, f.i, CASE c.edit WHEN 'D' THEN e.now WHEN 'S' THEN 1 ELSE {_NEXT.format("e.now")} END AS state,
    w.cost + {INSERT} * e.run + CASE c.edit WHEN 'D' THEN {DELETE} WHEN 'R' THEN {REROLE} ELSE {KEEP} END + CASE WHEN c.edit <> 'D' AND f.fault = 3 THEN {TRUNCATED} ELSE 0 END AS cost,
    w.audit || repeat('I', e.run) || CASE c.edit WHEN 'S' THEN 'K' ELSE c.edit END AS audit,
    w.made || {_TURNS.format(next=_NEXT.format("w.state"))} || CASE c.edit WHEN 'D' THEN [] WHEN 'R' THEN [CASE WHEN {_NEXT.format("e.now")} = 2 THEN 'user:' ELSE 'assistant:' END || f.text] ELSE [f.role || ':' || f.text] END AS made
    FROM ways w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN e ON e.was = w.state JOIN (VALUES ('D'), ('K'), ('R'), ('S')) c(edit)
      ON c.edit = 'D' OR f.fault NOT IN (1, 2) AND (c.edit = 'R' OR c.edit = 'K' AND f.own = {_NEXT.format("e.now")} OR c.edit = 'S' AND f.own = 1 AND e.now = 0)) QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
n AS (SELECT w.conv_id, w.cost + {INSERT} * e.run AS cost, w.audit || repeat('I', e.run) AS audit, w.made || {_TURNS.format(next=_NEXT.format("w.state"))} AS made FROM ways w JOIN e ON e.was = w.state AND (e.now = 3 OR e.now = 0 AND e.run = 0)
  WHERE w.i = (SELECT count(*) FROM f WHERE f.conv_id IS NOT DISTINCT FROM w.conv_id) QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + {INSERT} * e.run, w.audit || repeat('I', e.run)) = 1),
a AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (before IS NOT NULL AND (before, own) NOT IN ((1, 2), (2, 3), (3, 2))) AS illegal FROM (SELECT *, lag(own) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f) GROUP BY conv_id)
SELECT n.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, n.cost::BIGINT AS cost, n.audit, sha256(array_to_string(n.made, chr(10))) AS repaired_sha256
FROM n LEFT JOIN a ON n.conv_id IS NOT DISTINCT FROM a.conv_id"""
