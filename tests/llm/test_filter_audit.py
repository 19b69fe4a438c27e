"""The filter audit against plain sets of failures, order by order."""

import re
from collections import defaultdict
from itertools import permutations

import pytest

from pairloom.llm import filter_audit

SCHEMA = "text string, doc_id long, lang string, part string, n int, mask string, source string"
LABELS = "doc_id long, quality int, toxic int, part string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


TEXTS = [None, "", " \n", "one", prose(99), prose(100), prose(100), prose(100) + " #", "A " * 120, "WORD " + prose(130), prose(60) + " " + prose(60), prose(20000), "é" * 5 + "ABC", "\x85x " * 100, prose(101).upper(), "\x1cA|"]


def rows():
    """Texts in copies, with null and repeated ids, in several languages."""
    made = []
    for i, text in enumerate(TEXTS):
        made += [(text, 3 * i + k, ("en", "fr", None, "")[(i + k) % 4], "clash", 1, "m", "s") for k in range(3)]
    made += [(prose(100), None, "en", "clash", 1, "m", "s"), (prose(100), None, "fr", "clash", 1, "m", "s"), made[16], (made[17][0], made[16][1], "de", "c", 1, "m", "s"), (prose(100), 2, "en", "c", 1, "m", "s")]
    return made


def plain_failures(text):
    words = WORD.findall(text)
    found = {"A"} if len(words) < 100 else set()
    found |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
    found |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
    return found | ({"D"} if re.search(r"[#$%&*|]", text) else set())


def plain_audit(rows, labels):
    good, bad = ({d for d, q, t, _ in labels if (q, t)[k] == 1} for k in (0, 1))
    own = defaultdict(list)
    for text, doc, lang, *_ in rows:
        copy = any((t or "") == (text or "") and d is not None and doc is not None and d < doc for t, d, *_ in rows)
        own[lang or ""].append((doc, plain_failures(text or "") | ({"E"} if copy else set())))
    found = {}
    for part, docs in own.items():
        removed_at = defaultdict(int)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removed_at[f] += len(here)
                fails = sum(f in x[1] for x in docs)
                found[part, "".join(order), step] = [len(left), len(here), fails - len(here), sum(x[1] == {f} for x in docs), sum(x[0] in good for x in here), sum(x[0] in bad for x in here), f]
        for key in [k for k in found if k[0] == part]:
            found[key][-1] = removed_at[found[key][-1]]
    return {k: tuple(v) for k, v in found.items()}


def got_of(spark, rows, labels, parts=3, **sizes):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS), **sizes).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(found) == len(got)
    return found


LABEL_ROWS = [(i, i % 2, i % 3 % 2, "x") for i in range(0, 48, 2)] + [(4, 1, 1, "x"), (4, 0, None, "x"), (None, 1, 1, "x"), (999, 1, 1, "x")]


@pytest.mark.parametrize("held", [1, filter_audit.HELD])
def test_audit_is_the_plain_one(spark, held):
    """Nulls, empty and long texts, copies over several tasks, repeated rows; with chains passed on at once, and held."""
    assert got_of(spark, rows(), LABEL_ROWS, held=held) == plain_audit(rows(), LABEL_ROWS)


def test_one_fingerprint_for_all(spark):
    """Texts that collide in their fingerprint stay apart by their full text."""
    chains, gone = filter_audit.Chains(), []
    for doc, text in ((5, "x"), (3, "y"), (4, "x"), (7, "y"), (4, "x")):
        gone += list(chains.add(1, text, 0, doc, filter_audit.Counter(["en"])))
    assert gone == [(5, "en", 16, 1), (7, "en", 16, 1)]
    assert sorted((e[0], e[2], dict(e[3])) for _, e in chains.emptied()) == [("x", 4, {"en": 2}), ("y", 3, {"en": 1})]


def test_merged_labels_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "picked", lambda keys: (False, keys.hint("merge")))
    assert got_of(spark, rows(), LABEL_ROWS) == plain_audit(rows(), LABEL_ROWS)


def test_empty_tables(spark):
    assert got_of(spark, [], LABEL_ROWS) == {}
    assert got_of(spark, rows(), []) == plain_audit(rows(), [])
