"""Every registered query against its SQL, and the others for rows."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from pairloom.plans import catalog, pipelines  # noqa: F401  (registers its queries)


def plain(value):
    return (None if math.isnan(value) else round(value, 6)) if isinstance(value, float) else value


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.fixture(scope="module")
def database(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, database, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    if name in catalog.SQL:
        result = database.execute(catalog.SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        want = [tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()]
        assert ordered(rows) == ordered(want)


def test_sequence_matcher_queries_are_plain_loops(spark, sf_dir):
    """line_diff, code_similarity and greedy_pairing, for which there is no SQL, against difflib itself."""
    from difflib import SequenceMatcher

    pairs = {r.pair_id: (r.vuln_func, r.patched_func) for r in catalog.code_pairs(spark, sf_dir).select("pair_id", "vuln_func", "patched_func").collect()}
    for r in catalog.line_diff(spark, sf_dir).collect():
        a, b = (x.splitlines() for x in pairs[r.pair_id])
        changed = [x for x in SequenceMatcher(None, a, b).get_opcodes() if x[0] != "equal"]
        assert r.deleted == [n + 1 for x in changed for n in range(x[1], x[2])] and r.added == [n + 1 for x in changed for n in range(x[3], x[4])]
    for r in catalog.code_similarity(spark, sf_dir).collect():
        assert r.ratio == SequenceMatcher(None, *pairs[r.pair_id]).ratio()
    groups = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("text is not null").orderBy("conv_id", "turn").collect():
        groups.setdefault(r.conv_id, ([], []))[r.role != "user"].append((r.turn, r.text))
    want = set()
    for conv, (old, new) in groups.items():
        left = list(new)
        for turn, text in old:
            if left:
                best = max(left, key=lambda x: SequenceMatcher(None, text, x[1]).ratio())  # the first among equals
                left.remove(best)
                want.add((conv, turn, best[0]))
    assert {(r.conv_id, r.old, r.new) for r in catalog.greedy_pairing(spark, sf_dir).collect()} == want


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
