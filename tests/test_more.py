import json

import pytest
from pyspark.sql import functions as F

from pairloom import cli, schemas
from pairloom.functions import prompts, responses, reward
from pairloom.functions.text import code_hash
from pairloom.operators import metrics, runs


def test_first_generation_prompt(spark):
    rows = spark.createDataFrame([("a\nb", "N/A", True, "1, 2"), ("\n".join("x" * 21), "why", False, None)], "c string, d string, v boolean, l string")
    one, two = (r[0] for r in rows.select(prompts.first_generation_prompt(*map(F.col, "cdvl"))).collect())
    assert "```\na\nb\n```" in one and "considered vulnerable.\nThe changed lines that might be related to the vulnerability are: 1, 2.\n\nTask" in one and "CVE" not in one
    assert "21: x\n```" in two and "description is: why\n\n" in two and "not vulnerable.\nThis code snippet is the non-vulnerable version.\n\nTask" in two


def test_aliases_and_thinking(spark):
    rows = spark.createDataFrame([('<think></think>{"vulnerable_lines": [4]}',), ("no",), (None,), ("a</think> b</think>",)], "r string")
    assert [r[0] for r in rows.select(responses.aliased_lines(F.col("r"))).collect()] == [[4], [], [], []]
    assert [r[0] for r in rows.select(responses.after_thinking(F.col("r"))).collect()] == ['{"vulnerable_lines": [4]}', None, None, "b</think>"]


def test_prompt_types(spark):
    rows = spark.createDataFrame([("a",), (None,)], "prompt_type string")
    assert metrics.of_prompt_type(rows, "unknown").count() == 1


def test_rollout_scores(spark):
    answer = '<think></think>{{"classification": "{}", "important_lines": [1]}}'
    rows = spark.createDataFrame([(answer.format("VULNERABLE"), "{'is_vulnerable': True, 'ground_truth_lines': [1]}", 1.0), (answer.format("VULNERABLE"), '{"is_vulnerable": false, "ground_truth_lines": []}', 0.1)], schemas.ROLLOUT)
    got = {(r.is_total, r.is_vulnerable): r for r in runs.rollout_scores(runs.rollouts_with_rewards(rows)).collect()}
    assert got[False, True].mean_new_score == 1.25 and got[False, False].mean_new_score == 0.15 and got[True, None].n == 2


def test_custom_reward(spark, tmp_path):
    (tmp_path / "r.py").write_text("import json\ndef f(source, solution, truth, extra):\n    return len(solution) + json.loads(truth)['x']\n")
    reward.registered_reward(spark, str(tmp_path / "r.py"), "f", "my_reward")
    assert spark.sql("select my_reward('s', 'abc', '{\"x\": 2}', null)").first()[0] == 5.0


def test_tokens(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import tempfile

    from pairloom.functions import tokens

    library = tokenizers.Tokenizer(tokenizers.models.WordLevel({"a": 0, "b": 1, "[UNK]": 2}, unk_token="[UNK]"))
    library.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    with tempfile.NamedTemporaryFile(suffix=".json") as f:
        library.save(f.name)
        count, cut = tokens.counter(f.name), tokens.truncator(f.name)
        rows = spark.createDataFrame([("a b a",), ("",), (None,)], "t string")
        assert [tuple(r) for r in rows.select(count(F.col("t")), cut(F.col("t"), 2)).collect()] == [(3, "a b..."), (0, None), (0, None)]


def test_command_line(spark, tmp_path, capsys):
    a = [{"commit_id": "k", "target": t, "func": f"int f(int a) {{\n {w};\n}}", "project": "p", "project_url": "u", "file_name": "a.c", "commit_message": "m", "cve": "CVE-1", "cve_desc": "long text", "idx": t} for t, w in ((1, "bad"), (0, "good"))]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, a)))
    spark.createDataFrame([], schemas.SOURCE_B).write.parquet(str(tmp_path / "b"))
    spark.createDataFrame([], schemas.SOURCE_C).write.parquet(str(tmp_path / "c"))
    out = str(tmp_path / "pairs")
    assert cli.main(["merge", str(tmp_path / "a.jsonl"), str(tmp_path / "b"), str(tmp_path / "c"), out], spark) == 0
    pair = spark.read.schema(schemas.PAIR).json(out).first()
    assert pair.deleted_lines[0].line_no == 2 and pair.vuln_hash == spark.createDataFrame([(a[0]["func"],)], "t string").select(code_hash(F.col("t"))).first()[0]
    assert cli.main(["verify", out], spark) == 0
    teacher = {"pair_id": pair.pair_id, "commit_id": "k", "is_vulnerable": True, "prompt": "x", "generated_response": "<think></think>{}", "ground_truth_lines": [2], "parsed_classification": "VULNERABLE"}
    (tmp_path / "t.jsonl").write_text(json.dumps(teacher))
    assert cli.main(["sft", str(tmp_path / "t.jsonl"), str(tmp_path / "sft"), "--merged", out], spark) == 0
    assert spark.read.json(str(tmp_path / "sft_train.jsonl")).count() == 1
    assert cli.main(["rl", str(tmp_path / "t.jsonl"), str(tmp_path / "rl")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "rl/train.parquet")).first().reward_model.ground_truth == '{"is_vulnerable": true, "ground_truth_lines": [2]}'
