"""Deduplication of pairs by function: equal hashes, then conflicting variants.

A group is the variants of one function in one commit, so its rows are compared
with each other in one task; rows that are equal in all but their place are
brought down to one before. The outcome depends on the order of rows, which
`ordinal` states.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.diff import lines_changed, more_similar, normal_lines
from ..schemas import A, B, C

#: Sources by whose row stays.
ROWS_FIRST = {B: 0, C: 1, A: 2}
SIMILAR, GROWN = 0.7, 2.0
NULLS, NO_DESCRIPTION = ("none", "null", ""), ("none", "null", "na", "n/a", "")


def tidy(items) -> list[str]:
    return [x for x in (str(i).strip() for i in (items if items is not None else ()) if i) if x.lower() not in NULLS]


def described(row: dict) -> bool:
    return bool(row["cve_desc"]) and str(row["cve_desc"]).strip().lower() not in NO_DESCRIPTION


def compatible(a: set, b: set) -> bool:
    """Whether one set of CVEs holds the other; an empty one fits any."""
    return a <= b or b <= a


def fill(winner: dict, loser: dict) -> dict:
    """Fills what the winner lacks. A description comes only with compatible CVEs; of messages the longer stays."""
    for name in ("cve", "cwe"):
        if not tidy(winner[name]) and (other := tidy(loser[name])):
            winner[name] = sorted(set(other))
    if not described(winner) and described(loser) and compatible(set(tidy(winner["cve"])), set(tidy(loser["cve"]))):
        winner["cve_desc"] = loser["cve_desc"]
    if len(loser["commit_message"] or "") > len(winner["commit_message"] or ""):
        winner["commit_message"] = loser["commit_message"]
    return winner


def standing(row: dict) -> tuple[bool, int]:
    """Lower is better: real pairs first, then by source."""
    return row["vuln_func"] == row["patched_func"], ROWS_FIRST.get(row["source"], 99)


def best_of(rows: list[dict]) -> dict:
    """The best row, with the gaps filled that the others can fill, in their order."""
    best = rows[0]
    for row in rows[1:]:
        best = fill(row, best) if standing(row) < standing(best) else fill(best, row)
    return best


def different_files(a: dict, b: dict) -> bool:
    x, y = (p if p and p != "None" else "" for p in (a["filepath"], b["filepath"]))
    if not x or not y:
        return False
    if "/" not in x or "/" not in y:
        return x.rsplit("/", 1)[-1] != y.rsplit("/", 1)[-1]
    forked = a["project"] and b["project"] and a["project"] != b["project"]
    return x != y or bool(forked)


def collapsed(short: dict, long: dict) -> dict | None:
    """The winner of two variants of one function, or None if both stay."""
    if different_files(short, long):
        return None
    left, right = normal_lines(short["vuln_func"]), normal_lines(long["vuln_func"])
    added, removed = lines_changed(left, right)
    if removed and added / removed < GROWN and not more_similar(left, right, SIMILAR):
        return None
    if not removed or added > removed:
        return fill(long, short)
    for has in (described, lambda r: bool((r["commit_message"] or "").strip())):
        if has(short) != has(long):
            return fill(short, long) if has(short) else fill(long, short)
    if ROWS_FIRST.get(short["source"], 99) <= ROWS_FIRST.get(long["source"], 99):
        return fill(short, long)
    return fill(long, short)


def settle(variants: list[dict], carry_swap: bool = False) -> tuple[list[dict], int]:
    """Variants collapsed pair by pair until none can be, and the number of collapses.

    carry_swap: the left side of a comparison stays swapped for the next one, as older data were made.
    """
    size = lambda r: len(r["vuln_func"].splitlines())
    collapses, again = 0, True
    while again and len(variants) > 1:
        again, gone, kept = False, set(), []
        for i, own in enumerate(variants):
            if i in gone:
                continue
            left = own
            for j in range(i + 1, len(variants)):
                if j in gone:
                    continue
                short, long = (left, variants[j]) if size(left) <= size(variants[j]) else (variants[j], left)
                winner = collapsed(short, long)
                if winner is not None:
                    kept.append(winner)
                    gone |= {i, j}
                    collapses += 1
                    again = True
                    break
                if carry_swap:
                    left = short
            if i not in gone:
                kept.append(own)
        variants = kept
    return variants, collapses


def share(variants: list[dict]) -> None:
    """Kept variants fill each other's gaps, in order, under the same rules for CVEs."""
    for i, own in enumerate(variants):
        cves, cwes, has = set(tidy(own["cve"])), set(tidy(own["cwe"])), described(own)
        for j, other in enumerate(variants):
            if i == j:
                continue
            theirs = set(tidy(other["cve"]))
            fits = compatible(cves, theirs)
            if not cves and theirs:
                cves, own["cve"] = theirs, sorted(theirs)
            if not cwes and (more := set(tidy(other["cwe"]))):
                cwes, own["cwe"] = more, sorted(more)
            if not has and fits and described(other):
                has, own["cve_desc"] = True, other["cve_desc"]


def resolve(rows: list[dict], carry_swap: bool = False) -> tuple[list[dict], dict[str, int]]:
    """The rows that stay of one function's, and counts of what happened."""
    by_hash: dict[str, list[dict]] = {}
    for row in rows:
        by_hash.setdefault(row["vuln_hash"], []).append(row)
    variants = [best_of(same) for same in by_hash.values()]
    if len(variants) == 1:
        return variants, {"same_hash_dedup": len(rows) - 1}
    variants, collapses = settle(variants, carry_swap)
    if len(variants) > 1:
        share(variants)
    return variants, {"conflicts_collapsed": collapses, "conflicts_kept_both": len(variants)}


#: What resolve() looks at, and of this what it may fill.
READ = ("vuln_hash", "vuln_func", "patched_func", "source", "filepath", "project", "cve", "cwe", "cve_desc", "commit_message")
FILLED = ("cve", "cwe", "cve_desc", "commit_message")


def _functions(pairs: DataFrame, ordinal: str) -> DataFrame:
    """The pairs without repeats, those of one commit and function name after one another in a task, in `ordinal` order."""
    keyed = without_repeats(pairs, ordinal).withColumns({"_commit": F.lower("commit_id"), "_function": F.col("func_name")})
    return keyed.repartition("_commit", "_function").sortWithinPartitions("_commit", "_function", ordinal)


def _resolved(batches, carry_swap: bool):
    """(rows, what resolve() keeps of each function, its counts) of batches in that order; a kept row has its place in `rows` as _at."""

    def done(parts):
        rows = pa.Table.from_batches(parts).combine_chunks()
        read = rows.select(READ).to_pylist()
        for at, row in enumerate(read):
            row["_at"] = at
        ends = [*_begins(rows), len(read)]
        return rows, [resolve(read[a:b], carry_swap) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    held: list = []
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            begins = _begins(part)
            if held and _key(held[-1], -1) != _key(part, 0):
                yield done(held)
                held = []
            if len(begins) > 1:  # the last function may go on
                yield done([*held, part.slice(0, begins[-1])])
                held, part = [], part.slice(begins[-1])
            held.append(part)
    if held and sum(h.num_rows for h in held):
        yield done(held)


def _key(rows, at: int):
    at %= rows.num_rows
    return rows.column("_commit")[at].as_py(), rows.column("_function")[at].as_py()


def _begins(rows) -> list[int]:
    """Where each function's rows begin."""
    keys = list(zip(rows.column("_commit").to_pylist(), rows.column("_function").to_pylist(), strict=True))
    return [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]


def deduplicate(pairs: DataFrame, ordinal: str = "ordinal", carry_swap: bool = False) -> DataFrame:
    """The pairs that stay, of each commit (in lower case) and function name, in `ordinal` order within a group."""
    names = pairs.columns

    def run(batches):
        for rows, found in _resolved(batches, carry_swap):
            kept = [row for some, _ in found for row in some]
            made = rows.select(names).take(pa.array([row["_at"] for row in kept], pa.int64()))
            for name in FILLED:
                made = made.set_column(names.index(name), name, pa.array([row[name] for row in kept], made.schema.field(name).type))
            yield from made.combine_chunks().to_batches()

    return _functions(pairs, ordinal).mapInArrow(run, pairs.schema)


def without_repeats(pairs: DataFrame, ordinal: str) -> DataFrame:
    """Of rows that are equal in all but their place, the first; rows are known by a digest of their content."""
    content = F.sha2(F.to_json(F.struct(*(c for c in pairs.columns if c != ordinal)), {"ignoreNullFields": "false"}), 256)
    first = F.min_by(F.struct(*pairs.columns), F.col(ordinal)).alias("_first")
    return pairs.groupBy(content.alias("_content")).agg(first).select("_first.*")


def deduplication_statistics(pairs: DataFrame, ordinal: str = "ordinal", carry_swap: bool = False) -> DataFrame:
    """(statistic, n) of what deduplicate() does."""

    def run(batches):
        for _, found in _resolved(batches, carry_swap):
            said = [item for _, counts in found for item in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in said], pa.string()), pa.array([n for _, n in said], pa.int64())], ["statistic", "n"])

    return _functions(pairs, ordinal).mapInArrow(run, "statistic string, n long").groupBy("statistic").agg(F.sum("n").alias("n"))


def best_by_hash(rows: DataFrame, key: list[str], source: str, order: tuple[str, ...], ordinal: str) -> DataFrame:
    """One row for each key: of the best source, the first of it. Without metadata to fill this is an aggregate, not a fold."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(source))
    rank = F.when(rank > 0, rank).otherwise(99)
    rest = [c for c in rows.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(rank, F.col(ordinal)))
    return rows.groupBy(*key).agg(best.alias("_best"), F.count("*").alias("n_copies")).select(*key, "_best.*", "n_copies")
