"""Parsing of model responses: classification, important lines and a status."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PARSED, kind
from .text import strip

THINK_END = "</think>"
VULNERABLE, NOT_VULNERABLE = "VULNERABLE", "NOT_VULNERABLE"
# Statuses, and the patterns that salvage broken JSON.
STATUSES = ("EMPTY", "API_ERROR", "SKIPPED", "NO_JSON", "INCOMPLETE", "INVALID_CLASSIFICATION", "REGEX_FALLBACK", "VALID")
LOOSE_CLASS = re.compile(r'"classification"\s*:\s*"([^"]+)"', re.IGNORECASE)
LOOSE_LINES = re.compile(r'"important_lines"\s*:\s*\[([\d,\s]*)\]')


def answer_object(text: str) -> dict | None:
    """Of the JSON objects in a text, the first that classifies, else the first."""
    first, at, decode = None, text.find("{"), json.JSONDecoder().raw_decode
    while at >= 0:
        try:
            found, end = decode(text, at)
        except (ValueError, RecursionError):
            end = at + 1
        else:
            if "classification" in found:
                return found
            first = found if first is None else first
        at = text.find("{", end)
    return first


def verdict(value) -> str | None:
    """The class that a value names; one that isn't text names none."""
    name = value.upper().strip() if isinstance(value, str) else ""
    if "NOT_VULNERABLE" in name or "NOT VULNERABLE" in name:
        return NOT_VULNERABLE
    return VULNERABLE if "VULNERABLE" in name else None


def whole_numbers(items) -> list[int]:
    """Numbers and texts of digits as integers; anything else, and numbers out of range, are left out."""
    out = []
    for x in items if isinstance(items, list) else ():
        if isinstance(x, (int, float)) and math.isfinite(x) and abs(x) < 1 << 63:
            out.append(int(x))
        elif isinstance(x, str) and x.isdecimal() and int(x) < 1 << 63:
            out.append(int(x))
    return out


def parse_one(response: str | None) -> tuple[str | None, list[int], str]:
    """(classification, lines, status); the first rule that applies decides."""
    if not response:
        return None, [], "EMPTY"
    for prefix, status in (("ERROR:", "API_ERROR"), ("SKIPPED:", "SKIPPED")):
        if response.startswith(prefix):
            return None, [], status
    _, ended, answer = response.partition(THINK_END)
    if not ended:
        return None, [], "NO_JSON" if THINK_END in response.lower() else "INCOMPLETE"
    found, status = answer_object(answer.strip()), "VALID"
    if found is None:
        loose = LOOSE_CLASS.search(answer)
        if not loose:
            return None, [], "NO_JSON"
        numbers = LOOSE_LINES.search(answer)
        found = {"classification": loose[1], "important_lines": [x.strip() for x in numbers[1].split(",")] if numbers else []}
        status = "REGEX_FALLBACK"
    kind = verdict(found.get("classification", ""))
    if kind is None:
        return None, [], "INVALID_CLASSIFICATION"
    return kind, whole_numbers(found.get("important_lines", [])), status


@F.pandas_udf(PARSED)
def _parse(responses: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_one(r) for r in responses], columns=["classification", "lines", "status"])


def parse(response: Column) -> Column:
    """struct(classification, lines, status) of a response. JSON within free text has no native scanner, so this is an Arrow UDF."""
    return _parse(response)


@F.pandas_udf(kind("array<bigint>"))
def _aliased_lines(responses: pd.Series) -> pd.Series:
    found = []
    for r in responses:
        answer = answer_object((r or "").partition(THINK_END)[2]) or {}
        found.append(whole_numbers(answer.get("important_lines", answer.get("vulnerable_lines", []))))
    return pd.Series(found)


def aliased_lines(response: Column) -> Column:
    """The lines that an answer gives under either of their names."""
    return _aliased_lines(response)


def after_thinking(response: Column) -> Column:
    """The text after the first end of thinking; null if there is none."""
    at = F.instr(response, THINK_END)
    return F.when(at > 0, strip(response.substr(at + len(THINK_END), F.length(response))))


def for_reward(parsed: Column) -> tuple[Column, Column]:
    """(classification, lines), only of VALID answers."""
    valid = parsed["status"] == "VALID"
    return F.when(valid, parsed["classification"]), F.when(valid, parsed["lines"]).otherwise(F.array().cast("array<bigint>"))


def for_metrics(parsed: Column) -> tuple[Column, Column]:
    """(1, 0 or null; lines or null), only of VALID answers."""
    valid = parsed["status"] == "VALID"
    return F.when(valid, (parsed["classification"] == VULNERABLE).cast("int")), F.when(valid, parsed["lines"])


def yes_no(response: Column) -> Column:
    """1, 0 or null: the first pattern that a yes-or-no answer has, after the thinking if there is any."""
    low = strip(F.lower(response))
    at = F.instr(low, THINK_END)
    answer = F.when(at > 0, low.substr(at + len(THINK_END), F.length(low))).otherwise(low)
    ruled_out = response.isNull() | (response == "") | response.startswith("ERROR:")
    found = F.when(answer.contains("(1) yes"), 1).when(answer.contains("(2) no"), 0).when(answer.contains("yes"), 1).when(answer.contains("no"), 0)
    return F.when(~ruled_out, found)


def encode_truth(is_vulnerable: Column, numbers: Column) -> Column:
    """Ground truth as JSON text with the usual spacing."""
    return F.concat(F.lit('{"is_vulnerable": '), is_vulnerable.cast("string"), F.lit(', "ground_truth_lines": ['), F.array_join(numbers.cast("array<string>"), ", "), F.lit("]}"))


def decode_truth(text: Column) -> Column:
    """struct(is_vulnerable, ground_truth_lines); what can't be read is (true, [])."""
    schema = "struct<is_vulnerable:boolean,ground_truth_lines:array<int>>"
    got = F.from_json(text, schema)
    bad = got.isNull() | got["is_vulnerable"].isNull()
    return F.struct(F.when(bad, True).otherwise(got["is_vulnerable"]).alias("is_vulnerable"), F.coalesce(F.when(~bad, got["ground_truth_lines"]), F.array().cast("array<int>")).alias("ground_truth_lines"))


def tolerant_truth(text: Column) -> Column:
    """As decode_truth, but also of Python's own notation (True, single quotes)."""
    python = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("'"), F.lit('"')), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    readable = F.get_json_object(text, "$.is_vulnerable").isNotNull()
    return decode_truth(F.when(readable, text).otherwise(python))
