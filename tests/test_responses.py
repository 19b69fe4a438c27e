import pytest
from pyspark.sql import functions as F

from pairloom.functions import responses as R
from pairloom.functions import reward as W

T = "<think>x</think>"
CASES = [
    ("<think>bounds are never checked</think>\n" + '{"classification": "VULNERABLE", "important_lines": [12, 31], "reasoning_summary": "see {i} in a[i}"}', "VULNERABLE", [12, 31], "VALID"),
    ("<think></think>" + '{"important_lines": [], "classification": " not_vulnerable "}', "NOT_VULNERABLE", [], "VALID"),
    ("<think>free of locks, so VULNERABLE</think> I give no object.", None, [], "NO_JSON"),
    ('no thinking here {"classification": "NOT_VULNERABLE"}', None, [], "INCOMPLETE"),
    ("", None, [], "EMPTY"),
    (None, None, [], "EMPTY"),
    ("ERROR: 502", None, [], "API_ERROR"),
    ("SKIPPED: prompt_too_long:30001_tokens", None, [], "SKIPPED"),
    (T + '[{"n": {"m": 0}}] {"classification":"VULNERABLE","important_lines":["08",2.7,false,"-3",null]}', "VULNERABLE", [8, 2, 0], "VALID"),
    (T + '{"verdict":"VULNERABLE"}', None, [], "INVALID_CLASSIFICATION"),
    (T + '{"Classification" : "Vulnerable?", "important_lines": [4 , 6], "x": "', "VULNERABLE", [4, 6], "REGEX_FALLBACK"),
    (T + '{"classification":"it is NOT VULNERABLE"}', "NOT_VULNERABLE", [], "VALID"),
    (T + '{"classification":"unsure"}', None, [], "INVALID_CLASSIFICATION"),
    (T + '{"classification":null}', None, [], "INVALID_CLASSIFICATION"),
    ('<think>x</Think>{"classification":"NOT_VULNERABLE"}', None, [], "NO_JSON"),
    ("ERROR_NO_SERVER 1", None, [], "INCOMPLETE"),
    (T + '{"classification":"VULNERABLE","important_lines":[-Infinity, "¼", 1e400]}', "VULNERABLE", [], "VALID"),
]


def test_parse(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, r string").orderBy("i").select(R.parse(F.col("r")).alias("p")).collect()
    assert [(r.p.classification, list(r.p.lines), r.p.status) for r in rows] == [c[1:] for c in CASES]


ANSWER = T + '{{"classification": "{}", "important_lines": {}}}'
# (class, lines, label, truth, spray threshold, reward), one for each rule
REWARDS = [
    ("VULNERABLE", [2, 9, 14, 20], True, [9, 14, 40, 41], 0, 1.0),  # right, half of the truth
    ("VULNERABLE", [9], True, [9, 14, 40], 0, 0.75),  # right, a third
    ("NOT_VULNERABLE", [], False, [], 3, 1.0),  # nothing to find and nothing given
    ("NOT_VULNERABLE", [3], False, [], 0, 0.75),  # nothing to find but a line given
    ("NOT_VULNERABLE", [40], True, [9, 40], 0, 0.3),  # wrong, with a true line
    ("NOT_VULNERABLE", [1], True, [9, 40], 0, 0.1),  # wrong throughout
    ("VULNERABLE", [11, 12, 13], True, [12], 3, 1.0), ("VULNERABLE", [11, 12, 13, 14], True, [12], 3, 0.75),  # up to the threshold, and over it
    ("VULNERABLE", [11, 12, 13, 14], False, [12], 3, 0.1), ("VULNERABLE", [], False, [], 0, 0.3),  # wrong: over the threshold; without lines on either side
    ("perhaps", [9], True, [9], 0, 0.1), ("VULNERABLE", [6], True, [6, 6, 8, 8, 8], 0, 0.75),  # no class; truth counts its entries
]


@pytest.mark.parametrize("case", REWARDS)
def test_reward(spark, case):
    kind, lines, label, truth, threshold, want = case
    row = spark.createDataFrame([(ANSWER.format(kind, lines), label, truth)], "c string, v boolean, t array<int>")
    assert W.score_completions(row, "c", "v", "t", spray_threshold=threshold).first().reward == want


def test_reward_of_json_truth_and_of_unfinished_thinking(spark):
    rows = spark.createDataFrame([(ANSWER.format("VULNERABLE", [5, 7]), '{"is_vulnerable": true, "ground_truth_lines": [5, 7]}'), ("<think>on and on", "{}"), (ANSWER.format("VULNERABLE", []), "bad")], "completion string, g string")
    assert [r.reward for r in W.score_completions(rows, ground_truth="g").collect()] == [1.0, 0.0, 1.0]


def test_truth_text_has_pythons_spacing(spark):
    assert spark.range(1).select(R.encode_truth(F.lit(True), F.array(F.lit(1), F.lit(2)))).first()[0] == '{"is_vulnerable": true, "ground_truth_lines": [1, 2]}'
    told = spark.createDataFrame([("{'is_vulnerable': False, 'ground_truth_lines': [3]}",)], "t string").select(R.tolerant_truth(F.col("t")).alias("x")).first().x
    assert (told.is_vulnerable, told.ground_truth_lines) == (False, [3])


def test_yes_no(spark):
    cases = [(None, None), ("", None), ("ERROR: x", None), ("(1) YES, no", 1), ("<think>yes</think> (2) No", 0), ("Yes", 1), ("unknown", 0), ("<think>yes</think>", None), ("maybe", None)]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, r string").orderBy("i").select(R.yes_no(F.col("r"))).collect()
    assert [r[0] for r in rows] == [c[1] for c in cases]


def test_line_scores(spark):
    row = spark.createDataFrame([([1, 2, 2], [2, 3]), ([1], []), ([], [1])], "t array<int>, p array<int>").select(W.line_scores(F.col("t"), F.col("p")).alias("s")).collect()
    assert tuple(row[0].s) == (0.5, 0.5, 0.5) and tuple(row[1].s) == (0.0, 0.0, 0.0) and row[2].s is None


def test_graded_reward(spark):
    rows = spark.createDataFrame([("VULNERABLE", [1], "VALID", True, [1, 2]), ("NOT_VULNERABLE", [], "VALID", False, [4]), (None, [], "NO_JSON", True, [])], "c string, p array<bigint>, s string, v boolean, t array<int>")
    graded = lambda **k: [round(r[0], 6) for r in rows.select(W.graded_reward(*map(F.col, "cpsvt"), **k)).collect()]
    assert graded() == [round(0.75 + 0.5 * (0.5 / 0.75), 6), 0.75, 0.0]
    assert graded(ignore_patched_truth=True)[1] == 1.25
