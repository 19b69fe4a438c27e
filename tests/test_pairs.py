import json

import pytest
from pyspark.sql import functions as F

from pairloom.functions import diff as D
from pairloom.operators import audit, dedup, lookups, ordinals, pairing, pooling
from pairloom.plans import datasets
from pairloom.schemas import PAIR, SOURCE_A, SOURCE_B, SOURCE_C, A, B, C
from pairloom.sources import readers, sinks


def row(source, code, patched="fixed", commit="AB", name="f", at=0, **more):
    base = dict(source=source, pair_id=f"{source}{at}", commit_id=commit, project="p", project_url="", func_name=name, filepath="d/a.c", vuln_hash=str(hash(code)), vuln_func=code, patched_func=patched, cve=[], cwe=[], cve_desc=None, commit_message="", deleted_lines=[], added_lines=[], source_row_idx=at)
    return {**base, **more}


def pairs(spark, *rows):
    return spark.createDataFrame([tuple(r[c] for c in PAIR.names) for r in rows], PAIR)


def with_at(df):
    return df.withColumn("ordinal", F.col("source_row_idx"))


LONG = "int f() {\n a = 1;\n b = 2;\n c = 3;\n return a + b;\n}"


def test_equal_hashes_keep_the_best_source_and_fill_gaps(spark):
    a = row(A, LONG, cve=["CVE-1"], cve_desc="a long description", at=0, vuln_hash="h")
    b = row(B, LONG, commit="ab", at=1, vuln_hash="h", commit_message="m")
    got = dedup.deduplicate(with_at(pairs(spark, a, b))).collect()
    assert len(got) == 1 and got[0].source == B and got[0].cve == ["CVE-1"] and got[0].cve_desc == "a long description" and got[0].commit_message == "m"


def test_a_pair_beats_a_no_op(spark):
    got = dedup.deduplicate(with_at(pairs(spark, row(B, LONG, patched=LONG, vuln_hash="h"), row(A, LONG, vuln_hash="h", at=1)))).collect()
    assert [r.source for r in got] == [A]


@pytest.mark.parametrize(
    ("other", "more", "left"),
    [
        (LONG + "\n more;", {}, 1),  # one holds the other
        (LONG.replace("c = 3", "c = 4"), {}, 1),  # much alike
        (LONG.replace("c = 3", "c = 4"), {"filepath": "e/a.c"}, 2),  # another file
        (LONG.replace("c = 3", "c = 4"), {"project": "q"}, 2),  # a fork
        ("void zzz\nqqq\nxxx\nwww\nvvv\nuuu", {}, 2),  # nothing alike
    ],
)
def test_conflicts(spark, other, more, left):
    assert dedup.deduplicate(with_at(pairs(spark, row(A, LONG), row(C, other, at=1, **more)))).count() == left


def test_the_longer_variant_stays_and_swap_is_not_carried():
    long, short, middle = ("\n".join(f"line {i};" for i in range(n)) for n in (9, 3, 5))
    kept, n = dedup.settle([row(A, t, at=i) for i, t in enumerate((long, short, middle))])
    assert [r["vuln_func"] for r in kept] == [long] and n == 2


def test_kept_variants_share_metadata_only_with_compatible_cves():
    a, b, c = row(A, "1", cve=["X"]), row(A, "2", cve=["Y"], cve_desc="about y"), row(A, "3")
    dedup.share([a, b, c])
    assert a["cve_desc"] is None and c["cve"] == ["X"]


def test_deduplication_is_idempotent(spark):
    once = dedup.deduplicate(with_at(pairs(spark, row(A, LONG), row(B, LONG + "\n x", at=1), row(C, "zzz\nyyy", at=2))))
    assert dedup.deduplicate(once).count() == once.count()


def test_empty_tables(spark):
    none = with_at(pairs(spark))
    assert dedup.deduplicate(none).count() == 0 and pooling.enrich(none, pooling.pool(none)).count() == 0 and audit.line_issues(none).count() == 0


def test_heterogeneous_commits_give_their_message_alone(spark):
    rows = with_at(pairs(spark, row(A, "1", cve=["X"], at=0), row(A, "2", name="g", cve=["Y"], commit_message="why", at=1), row(A, "3", name="h", at=2)))
    got = {r.func_name: r for r in pooling.enrich(rows, pooling.pool(rows)).collect()}
    assert got["h"].cve == [] and got["h"].commit_message == "why"


def test_pool_prefers_sources_for_descriptions(spark):
    rows = with_at(pairs(spark, row(B, "1", cve_desc="from source b", at=0), row(C, "2", cve_desc="from source c", at=1), row(A, "3", cve_desc="short", at=2)))
    assert pooling.pool(rows).first().cve_desc == "from source c"


def test_line_changes_and_repair():
    assert D.line_changes("a\nb\nc", "a\nx\nc")[0] == [{"line_no": 2, "char_start": None, "char_end": None, "text": "b"}]
    assert D.line_changes("a\nb", "a\nb") == ([], [])


def plain_repair(changes, code, other, is_old):
    """(numbers and texts, method), step by step."""
    lines, made = code.splitlines(), D.line_changes(code, other)[0] if is_old else D.line_changes(other, code)[1]
    made = [(c["line_no"], c["text"]) for c in made]
    if not changes:
        return made, "difflib" if made else "native"
    if all(1 <= n <= len(lines) and (not t or t == lines[n - 1].strip()) for n, t in changes):
        return changes, "native"
    places, named, left, got = {}, [t for _, t in changes if t], {}, []
    for n, line in enumerate(lines, 1):
        places.setdefault(line.strip(), []).append(n)
    for t in named:
        found = places.get(t, [])
        if len(found) not in (1, named.count(t)) or not found:
            return made, "difflib"
        got.append((found[0] if len(found) == 1 else found[left.setdefault(t, 0)], t))
        left[t] = left.get(t, 0) + 1
    return got, "text_reindex"


def test_repairs_are_the_plain_ones(spark):
    import random

    r, pieces, rows = random.Random(2), ["x;", "  y;", "", "z", "x; ", "{", "}"], []
    for i in range(600):
        code, other = ("\n".join(r.choice(pieces) for _ in range(r.randint(0, 6))) for _ in range(2))
        own = [(n + 1, t.strip()) for n, t in enumerate(code.splitlines())]
        changes = [(n if r.random() < 0.4 else r.randint(-1, 9), t if r.random() < 0.8 else r.choice(["y;", "", "no"])) for n, t in r.sample(own, r.randint(0, len(own)))]
        rows.append((i, [(n, None, None, t) for n, t in changes], code, other))
    table = spark.createDataFrame(rows, "i int, changes array<struct<line_no:int,char_start:int,char_end:int,text:string>>, code string, other string")
    for is_old in (True, False):
        got = D.with_repair(table, "r", F.col("changes"), F.col("code"), F.col("other"), is_old).collect()
        assert len({x.r.method for x in got}) == 3
        for x in got:
            _, changes, code, other = rows[x.i]
            assert ([(c.line_no, c.text) for c in x.r.changes], x.r.method) == plain_repair([(c[0], c[3]) for c in changes], code, other, is_old), rows[x.i]


def test_greedy_matches_take_the_first_best():
    assert pairing.greedy_matches(["abc", "abd"], ["abd", "abc", "abc"]) == [(0, 1), (1, 0)]
    assert pairing.greedy_matches(["a", "b"], ["a"]) == [(0, 0)]


def test_sources(spark, tmp_path):
    a = [("k1", 1, "int f(int a) {\n bad;\n}", "p", "u", "a.c", "none", "CVE-1", "text", '["CWE-1"]', 1), ("k1", 0, "int f(int a) {\n good;\n}", "p", "u", "a.c", "none", None, None, None, 2), ("k2", 1, "int g() {}", "p", "u", "a.c", "m", None, None, None, 3)]
    got = pairing.pairs_a(spark.createDataFrame(a, SOURCE_A).withColumn("ordinal", F.col("idx"))).collect()
    assert len(got) == 1 and got[0].func_name == "f" and got[0].cwe == ["CWE-1"] and got[0].commit_message == "" and got[0].deleted_lines[0].line_no == 2
    b = [("https://github.com/o/r/commit/abc", "f", "a.c", "cwe-79", "x", "y", ([(1, 0, 1, "x\n")], None))]
    got = pairing.pairs_b(spark.createDataFrame(b, SOURCE_B)).first()
    assert (got.project, got.commit_id, got.cwe, got.deleted_lines[0].text, got.added_lines) == ("o/r", "abc", ["CWE-79"], "x", [])
    c = [(1, True, 2.0, '[[50, "bad;"]]', "f() {\n bad;\n}", "f", "a.c", "p", "u", "k", ["CVE-1"], None, (["why it", "is bad"],), "NULL"), (2, False, None, "[]", "f() {\n good;\n}", "f", "a.c", "p", "u", "k", [], [], None, None), (3, True, 3.0, None, "x", "f", "a.c", "p", "u", "k", [], [], None, None)]
    got = pairing.pairs_c(spark.createDataFrame(c, SOURCE_C).withColumn("_file", F.lit("one"))).collect()
    assert len(got) == 1 and got[0].deleted_lines[0].line_no == 2 and got[0].reindex_method == "text_reindex" and got[0].cve_desc == "why it is bad" and got[0].commit_message == "" and got[0].cwe == []


def test_merged_and_files(spark, tmp_path):
    made = datasets.merged(pairs(spark, row(A, LONG), row(A, "x ", patched="x", name="noop", at=1)), pairs(spark, row(B, LONG, vuln_hash="other"))).persist()
    assert sorted(made.columns) == sorted(PAIR.names) and {r.func_name for r in made.collect()} == {"f"}
    sinks.json_lines(made, str(tmp_path / "out"))
    assert readers.json_lines(spark, str(tmp_path / "out"), PAIR).count() == made.count()


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.IntegerType())])
    with pytest.raises(Exception):
        readers.json_lines(spark, str(path), schema).collect()
    assert readers.json_lines_lenient(spark, str(path), schema).count() == 2
    rows, skipped = readers.json_lines_counted(spark, str(path), schema)
    assert rows.count() == 2 and skipped.first().skipped_errors == 1
    assert [(r.a, r._line_number) for r in readers.numbered_lines(spark, str(path), schema).orderBy("_line_number").collect()] == [(1, 1), (2, 4)]


def test_metric_documents_and_rollouts(spark, tmp_path):
    for run in ("sft_base_run1", "grpo_x"):
        (tmp_path / run / "metrics_temp0p2").mkdir(parents=True)
        (tmp_path / run / "metrics_temp0p2" / "metrics_combined_training.json").write_text(json.dumps({"standard_metrics": {"accuracy": 0.5}}))
    got = readers.metric_documents(spark, str(tmp_path))
    assert sorted((r.run, r.temperature) for r in got.collect()) == [("grpo_x", "temp0p2"), ("sft_base_run1", "temp0p2")]
    (tmp_path / "r").mkdir()
    for name in ("3.jsonl", "last.jsonl"):
        (tmp_path / "r" / name).write_text('{"output": "x", "gts": "{}", "score": 1.0}\n')
    from pairloom.schemas import ROLLOUT

    rolled = readers.rollout_files(spark, str(tmp_path / "r"), ROLLOUT)
    assert sorted(r.step for r in rolled.collect()) == [-1, 3] and readers.latest_files(rolled, 1).count() == 1


def test_rl_audit(spark):
    code = "```c\n1: a;\n2: b;\n3: c;\n4: d;\n```"
    truth = lambda v, *n: json.dumps({"is_vulnerable": v, "ground_truth_lines": list(n)})
    rows = [
        ("p1", code + " This code contains a security vulnerability", truth(True, 2), True), ("p2", code, truth(True, 9), True), ("p3", "```c\n1: a;\n```", truth(True), True),
        ("p4", code + " This code contains a security vulnerability", truth(False), False), ("p5", code + " the patched (non-vulnerable) version", truth(True, 1), True),
    ]
    df = spark.createDataFrame([([("user", prompt)], (t,), (i, n, v)) for n, (i, prompt, t, v) in enumerate(rows)], "prompt array<struct<role:string,content:string>>, reward_model struct<ground_truth:string>, extra_info struct<pair_id:string,idx:int,is_vulnerable:boolean>")
    known = pairs(spark, row(A, "x", pair_id="p1", deleted_lines=[(2, None, None, "zzz")]), row(B, "x", pair_id="p5", deleted_lines=[(1, None, None, "a;")]))
    names = ("oob", "misindexed", "vulnerable_without_lines", "tiny", "hint_conflict", "patched_hint_conflict")
    got = {r.pair_id: [n for n in names if r[n]] for r in audit.rl_flags(df, known).collect()}
    assert got == {"p1": ["misindexed"], "p2": ["oob"], "p3": ["vulnerable_without_lines", "tiny"], "p4": ["hint_conflict"], "p5": ["patched_hint_conflict"]}
    assert {r.source: r.total for r in audit.rl_report(audit.rl_flags(df, known), "source").collect()} == {A: 1, B: 1, "Unknown": 3}


def test_unique_index_and_ordinals(spark):
    with pytest.raises(lookups.DuplicateKeys):
        lookups.unique_index(spark.createDataFrame([(1,), (1,)], "k int"), "k")
    n = 1003
    split = ordinals.tail_split(spark.range(n).repartition(7), "id").collect()
    assert sorted(r.id for r in split if r.is_validation) == list(range(n - 50, n))
    assert {r.id: r.ordinal for r in ordinals.with_ordinal(spark.range(50).repartition(3), F.desc("id")).collect()} == {i: 49 - i for i in range(50)}


def test_line_issues(spark):
    at = lambda n, t: (n, None, None, t)
    r = row(A, "one\ntwo\n\nfour", deleted_lines=[at(2, "two"), at(9, "x"), at(1, "zzz"), at(1, "on"), at(3, "any")], added_lines=[at(0, "")])
    assert sorted((i.field, i.line_no, i.type) for i in audit.line_issues(pairs(spark, r)).collect()) == [("added_lines", 0, "oob"), ("deleted_lines", 1, "misindexed"), ("deleted_lines", 9, "oob")]


def test_sft_and_rl_rows(spark):
    done = "<think>t</think>{}"
    teacher = [("p1", "k", True, "pr", done, [1, 2, 3], "VULNERABLE"), ("p2", "k", False, "pr", "ERROR_SGLANG_CALL: x", [], None), ("p3", "k", True, "pr", "no end", [], "VULNERABLE"), ("nope", "k", True, "pr", done, [], "VULNERABLE")]
    rows = spark.createDataFrame(teacher, "pair_id string, commit_id string, is_vulnerable boolean, prompt string, generated_response string, ground_truth_lines array<int>, parsed_classification string")
    known = pairs(spark, row(A, "code1", pair_id="p1"))
    assert {r.pair_id: r.reason for r in datasets.sft_reasons(rows, known).collect()} == {"p1": None, "p2": "no_response", "p3": "incomplete", "nope": "no_pair"}
    sft = datasets.sft_rows(rows, known).collect()
    assert len(sft) == 1 and "1: code1" in sft[0].prompt and not sft[0].is_validation
    at = [(7, None, None, "t")]
    patched = pairs(spark, row(A, "x", pair_id="p2", added_lines=at))
    truth = lambda **k: {r.extra_info.pair_id: json.loads(r.reward_model.ground_truth)["ground_truth_lines"] for r in datasets.rl_rows(rows, **k).collect()}
    assert truth() == {"p1": [1, 2, 3], "p2": [], "p3": [], "nope": []}
    assert truth(pairs=patched, score_patched=True)["p2"] == [7]
    assert truth(most_lines=2)["p1"] == [] and truth(percentile=50)["p1"] == [1, 2, 3]
