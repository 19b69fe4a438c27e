"""Diffs and similarity. The measure is the standard library's sequence matcher, so these are Arrow UDFs."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher, unified_diff

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import kind
from .text import lines, misplaced, strip

CHANGE = "struct<line_no:int,char_start:int,char_end:int,text:string>"


def normal_lines(code: str) -> list[str]:
    return "\n".join(x for x in (line.strip() for line in code.splitlines()) if x).lower().splitlines()


def lines_changed(left: list[str], right: list[str]) -> tuple[int, int]:
    """(lines added, lines removed) from one list of lines to another."""
    if left == right:
        return 0, 0
    body = list(unified_diff(left, right, lineterm=""))[2:]  # after the two file headers
    signs = Counter(line[:1] for line in body if not line.startswith(("+++", "---")))
    return signs["+"], signs["-"]


def measured(a: str, b: str) -> tuple[int, int, float]:
    """(lines added, lines removed, character similarity) from a to b, both normalised."""
    left, right = normal_lines(a), normal_lines(b)
    return *lines_changed(left, right), 1.0 if left == right else SequenceMatcher(None, "\n".join(left), "\n".join(right)).ratio()


def more_similar(left: list[str], right: list[str], bound: float) -> bool:
    """Whether the character similarity of normalised lines is over a bound; what is never under it and costs less is asked first."""
    matcher = SequenceMatcher(None, "\n".join(left), "\n".join(right))
    return matcher.real_quick_ratio() > bound and matcher.quick_ratio() > bound and matcher.ratio() > bound


def line_changes(before: str, after: str) -> tuple[list[dict], list[dict]]:
    """Lines deleted from the one and added in the other, with their numbers."""
    old, new = before.splitlines(), after.splitlines()
    gone, come = [], []
    for tag, i, j, k, m in SequenceMatcher(None, old, new).get_opcodes():
        if tag != "equal":
            gone += [{"line_no": n + 1, "char_start": None, "char_end": None, "text": old[n]} for n in range(i, j)]
            come += [{"line_no": n + 1, "char_start": None, "char_end": None, "text": new[n]} for n in range(k, m)]
    return gone, come


@F.pandas_udf(kind("double"))
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else 1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(kind("struct<added:int,removed:int,similarity:double>"))
def _measured(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measured(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["added", "removed", "similarity"])


@F.arrow_udf(kind(f"struct<deleted:array<{CHANGE}>,added:array<{CHANGE}>>"))
def _line_changes(a: pa.Array, b: pa.Array) -> pa.Array:
    """Changes as columns, some rows at a time: a batch's lines are never all Python objects at once."""
    done = []
    for at in range(0, len(a), 256):
        found = [line_changes(x or "", y or "") for x, y in zip(a.slice(at, 256).to_pylist(), b.slice(at, 256).to_pylist(), strict=True)]
        done.append(pa.StructArray.from_arrays([_changes([gone for gone, _ in found]), _changes([come for _, come in found])], ["deleted", "added"]))
    return pa.concat_arrays(done) if done else pa.array([], pa.struct([("deleted", _CHANGES), ("added", _CHANGES)]))


_CHANGES = pa.list_(pa.struct([("line_no", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("text", pa.string())]))


def _changes(rows: list[list[dict]]) -> pa.Array:
    return pa.array(rows, _CHANGES)


def similarity(a: Column, b: Column) -> Column:
    """Character similarity of the texts as they are; the order of arguments matters."""
    return _similarity(a, b)


def normalized_diff(a: Column, b: Column) -> Column:
    return _measured(a, b)


def changed_lines(before: Column, after: Column) -> Column:
    return _line_changes(before, after)


def changed_lines_text(after: Column, before: Column) -> Column:
    """'Lines: 1, 2': the lines of `before` that differ, or null."""
    numbers = F.transform(_line_changes(before, after)["deleted"], lambda c: c["line_no"].cast("string"))
    return F.when(F.size(numbers) > 0, F.concat(F.lit("Lines: "), F.array_join(numbers, ", ")))


def let(value: Column, of) -> Column:
    """of(value), where value is worked out once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def placed_by_text(changes: Column, code_lines: Column) -> Column:
    """Changes with the numbers of the lines (stripped ones are given) that have their texts; a number is null if a text has no line, or several but not as many as changes.

    Changes without text are left out. Several changes with one text take its lines in order.
    """

    def placed(named: Column) -> Column:
        def number(c: Column, i: Column) -> Column:
            same = F.filter(named, lambda x: x["text"] == c["text"])
            before = F.size(F.filter(F.slice(named, F.lit(1), i), lambda x: x["text"] == c["text"]))
            at = F.filter(F.transform(code_lines, lambda line, k: F.when(line == c["text"], k + 1)), lambda k: k.isNotNull())
            return let(at, lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))).when(F.size(a) == F.size(same), F.get(a, before)))

        return F.transform(named, lambda c, i: F.struct(number(c, i).alias("line_no"), c["char_start"].alias("char_start"), c["char_end"].alias("char_end"), c["text"].alias("text")))

    return let(F.filter(changes, lambda c: F.coalesce(c["text"], F.lit("")) != ""), placed)


def with_repair(df: DataFrame, name: str, changes: Column, code: Column, other: Column, is_old: bool) -> DataFrame:
    """df with `name`, struct(changes, method), of changes in `code`, the older text or the newer: as they are if they fit, else
    placed by their texts, else from the diff. Only texts that need a diff go to Python."""
    given, own, against = F.coalesce(changes, F.array().cast(f"array<{CHANGE}>")), F.coalesce(code, F.lit("")), F.coalesce(other, F.lit(""))
    df = df.withColumn("_given", given).withColumn("_fits", (F.size("_given") > 0) & ~F.coalesce(misplaced(F.col("_given"), own), F.lit(False)))
    df = df.withColumn("_by_text", F.when((F.size("_given") > 0) & ~F.col("_fits"), placed_by_text(F.col("_given"), F.transform(lines(own), strip))))
    df = df.withColumn("_found", F.coalesce(F.forall("_by_text", lambda c: c["line_no"].isNotNull()), F.lit(False)))
    needed = ~F.col("_fits") & ~F.col("_found")
    before, after = (own, against) if is_old else (against, own)
    df = df.withColumn("_made", _line_changes(F.when(needed, before), F.when(needed, after))["deleted" if is_old else "added"])
    method = F.when(F.col("_fits") | ((F.size("_given") == 0) & (F.size("_made") == 0)), "native").when(F.col("_found"), "text_reindex").otherwise("difflib")
    found = F.when(F.col("_fits"), F.col("_given")).when(F.col("_found"), F.col("_by_text")).otherwise(F.col("_made"))
    return df.withColumn(name, F.struct(found.alias("changes"), method.alias("method"))).drop("_given", "_fits", "_by_text", "_found", "_made")
