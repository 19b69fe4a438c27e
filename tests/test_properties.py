"""Invariants over generated inputs."""

import pytest

hypothesis = pytest.importorskip("hypothesis")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pairloom.functions import diff, responses  # noqa: E402
from pairloom.operators import dedup, pairing  # noqa: E402
from pairloom.schemas import A, B, C  # noqa: E402

LINE = st.sampled_from(["a;", "b;", "c;", "", "  a;", "if (x)"])
CODE = st.lists(LINE, max_size=8).map("\n".join)
META = st.lists(st.sampled_from(["X", "Y", "none", ""]), max_size=2)


@given(st.one_of(st.text(), st.lists(st.sampled_from(["<think>", "</think>", "{", "}", '"classification"', ":", '"VULNERABLE"', '"important_lines": [1, "2"', "]", ",", "x"])).map("".join)))
def test_parsing_never_fails(text):
    kind, lines, status = responses.parse_one(text)
    assert status in responses.STATUSES and (kind is None or status in ("VALID", "REGEX_FALLBACK")) and all(isinstance(n, int) for n in lines)


@given(CODE, CODE)
@settings(deadline=None)
def test_diffs_are_consistent(a, b):
    gone, come = diff.line_changes(a, b)
    old, new = a.splitlines(), b.splitlines()
    assert all(old[c["line_no"] - 1] == c["text"] for c in gone) and all(new[c["line_no"] - 1] == c["text"] for c in come)
    assert [x for i, x in enumerate(old, 1) if i not in {c["line_no"] for c in gone}] == [x for i, x in enumerate(new, 1) if i not in {c["line_no"] for c in come}]
    assert 0 <= diff.measured(a, b)[2] <= 1


@given(st.lists(st.tuples(st.lists(st.tuples(st.integers(-2, 12), LINE.map(str.strip)), max_size=5), CODE), min_size=20, max_size=60))
@settings(deadline=None, max_examples=5)
def test_repaired_lines_fit_or_come_from_the_diff(spark, rows):
    made = [([(n, None, None, t) for n, t in changes], code) for changes, code in rows]
    table = spark.createDataFrame(made, "changes array<struct<line_no:int,char_start:int,char_end:int,text:string>>, code string")
    for r in diff.with_repair(table, "r", F.col("changes"), F.col("code"), F.col("code"), True).collect():
        lines = r.code.splitlines()
        if r.r.method != "difflib":
            assert all(1 <= c.line_no <= len(lines) and (not c.text or c.text == lines[c.line_no - 1].strip()) for c in r.r.changes)


@given(st.lists(CODE, max_size=4), st.lists(CODE, max_size=4))
@settings(deadline=None)
def test_matches_are_one_to_one(old, new):
    found = pairing.greedy_matches(old, new)
    assert len(found) == min(len(old), len(new)) == len({i for i, _ in found}) == len({j for _, j in found})


@given(st.lists(st.tuples(st.sampled_from([A, B, C, "other"]), CODE, META, META, st.sampled_from([None, "N/A", "long text"]), st.sampled_from(["", "m", "mm"]), st.sampled_from(["", "x.c", "d/x.c", "e/x.c"])), min_size=1, max_size=5))
@settings(deadline=None, max_examples=60)
def test_deduplication_settles(rows):
    made = [dict(source=s, vuln_hash="\n".join(diff.normal_lines(code)), vuln_func=code, patched_func="p", cve=cve, cwe=cwe, cve_desc=d, commit_message=m, filepath=f, project="q") for s, code, cve, cwe, d, m, f in rows]
    kept, _ = dedup.resolve([dict(r) for r in made])
    again, _ = dedup.resolve([dict(r) for r in kept])
    assert len(again) == len(kept) <= len({r["vuln_hash"] for r in made})
    assert max(len(r["commit_message"]) for r in kept) == max(len(r["commit_message"]) for r in made)
    for r in kept:
        assert set(dedup.tidy(r["cve"])) <= {x for m in made for x in dedup.tidy(m["cve"])}
