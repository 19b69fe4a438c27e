import datetime as dt

import pytest
from pyspark.sql import functions as F

from pairloom.functions.prompts import eval_requests, requests
from pairloom.operators import metrics, rollout, runs, stats
from pairloom.plans import generation
from pairloom.streaming import logs

START = dt.datetime(2024, 1, 1)


def log(spark, seconds, run="r"):
    rows = [(run, START + dt.timedelta(seconds=s), i, 10 * (i + 1), float(i)) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "run string, ts timestamp_ntz, id int, size int, value double")


def test_gaps_of_exactly_thirty_seconds_join(spark):
    got = rollout.gap_sessions(log(spark, [0, 30, 61, 62]), "run", "ts", "id").orderBy("id").collect()
    assert [r.batch for r in got] == [0, 0, 1, 1]
    sessions = logs.sessions(log(spark, [0, 30, 61, 62]), "run", "ts", "size", "value")
    assert sorted(r["size"] for r in sessions.collect()) == [2, 2]


def test_gaps_of_a_microsecond_more_part(spark):
    sessions = logs.sessions(log(spark, [0, 30.000001, 60.000001, 90.0005, 120.0005]), "run", "ts", "size", "value")
    assert sorted(r["size"] for r in sessions.collect()) == [1, 2, 2]


def test_batch_facts(spark):
    facts = rollout.batch_facts(log(spark, [0, 10, 400, 401]), "run", "ts", "id", "size", "value").orderBy("batch").collect()
    assert [(f["size"], f.duration, f.is_slow) for f in facts] == [(2, 10.0, False), (2, 391.0, True)]
    assert facts[1].tokens_per_second == pytest.approx(40 / 4.5 / 391) and facts[1].is_anomalous
    one = rollout.batch_facts(log(spark, [5]), "run", "ts", "id", "size", "value").first()
    assert one.duration == 0 and one.tokens_per_second == float("inf")


def test_blocks_change_nothing(spark):
    """Runs longer than a block, one of them holding most rows, give what plain loops do."""
    rows = [("long", START + dt.timedelta(seconds=(i * 37) % 11 + i * 13), i, 10 * i % 70, float(i * i % 17)) for i in range(150)] + [(None, START + dt.timedelta(seconds=40 * i), i, 5, float(i)) for i in range(30)]
    table = spark.createDataFrame(rows, "run string, ts timestamp_ntz, id int, size int, value double")
    keys = ("run", "ts", "id")
    for run in ("long", None):
        own = sorted((r for r in rows if r[0] == run), key=lambda r: (r[1], r[2]))
        of_run = lambda df: {r.id: r for r in df.collect() if r.run == run}
        rates, gaps, batches = (of_run(x) for x in (rollout.completion_rate(table, *keys, size=7, block=16), rollout.inter_arrival(table, *keys, block=16), rollout.gap_sessions(table, *keys, gap=14, block=16)))
        medians, means, thirds = (of_run(x) for x in (rollout.rolling_median(table, *keys, "value", 9, block=16), rollout.moving_average(table, *keys, "value", 5, block=16), rollout.rolling_median(table, *keys, "value", 20, part=3, block=32)))
        batch = 0
        for i, r in enumerate(own):
            back = own[max(0, i - 9) : i + 1]
            values = sorted(x[4] for x in back)
            assert medians[r[2]].rolling_median == (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
            win = min(20, len(own) // 3)
            values = sorted(x[4] for x in own[max(0, i - win) : i + 1])
            assert thirds[r[2]].rolling_median == (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
            if i:
                passed = (r[1] - own[i - 1][1]).total_seconds()
                batch += passed > 14
                assert gaps[r[2]].delta_seconds == passed
            assert (batches[r[2]].batch, gaps[r[2]].completed, gaps[r[2]].elapsed_minutes) == (batch, i + 1, (r[1] - own[0][1]).total_seconds() / 60)
            assert (r[2] in means) == (i >= 4) and (r[2] in rates) == (i >= 7)
            if i >= 4:
                assert means[r[2]].moving_average == pytest.approx(sum(x[4] for x in own[i - 4 : i + 1]) / 5)
            if i >= 7:
                assert rates[r[2]].rate == pytest.approx(7 / ((r[1] - own[i - 7][1]).total_seconds() / 60))


def test_rates_and_trends(spark):
    rates = rollout.completion_rate(log(spark, list(range(30))), "run", "ts", "id", size=20).collect()
    assert len(rates) == 10 and rates[0].rate == pytest.approx(60.0)
    same = rollout.completion_rate(log(spark, [0] * 21), "run", "ts", "id").first()
    assert same.rate == float("inf")
    trend = rollout.quartile_trend(log(spark, range(21)), "run", ["ts", "id"], "value").first()
    assert trend.first_quarter == 2.0 and trend.last_quarter == 17.5 and trend.trend == "up"
    assert rollout.quartile_trend(log(spark, range(19)), "run", ["ts", "id"], "value").count() == 0
    assert [r.place for r in rollout.trajectory(log(spark, range(8)), "run", ["ts"], "value").orderBy("place").collect()] == [0, 1, 2, 4, 6, 7]


def test_diagnostics(spark):
    rows = [(i, 0.001, 0.5 if i < 15 else 0.9, 1.0 - i / 25) for i in range(20)]
    history = spark.createDataFrame(rows, ["training/global_step", rollout.CLIP, rollout.SCORE, rollout.ENTROPY])
    assert {(r.series, r.finding) for r in rollout.diagnostics(history).collect()} == {(rollout.CLIP, "clip fraction very low"), (rollout.SCORE, "reward up"), (rollout.ENTROPY, "entropy collapsed")}


def test_metrics_document(spark):
    answer = '<think>t</think>{{"classification": "{}", "important_lines": [{}]}}'
    truth = [(1, None, None, "x"), (2, None, None, "y")]
    rows = [("a", "k", "primevul_test", True, 1, "training", answer.format("VULNERABLE", 1), truth), ("a", "k", "primevul_test", False, 0, "training", answer.format("NOT_VULNERABLE", ""), []), ("b", "k", "sven_val", True, 1, "training", "ERROR: x", truth), ("b", "k", "sven_val", False, 0, "training", answer.format("VULNERABLE", ""), []), ("c", "k", "sven_val", True, 1, "std_cls", "(1) yes", truth)]
    df = spark.createDataFrame(rows, "pair_id string, commit_id string, split string, is_vulnerable boolean, target int, prompt_type string, response string, ground_truth_lines array<struct<line_no:int,char_start:int,char_end:int,text:string>>")
    got = {(r.subset, r.prompt_type): r for r in metrics.reports(df).collect()}
    all_ = got["combined", "training"]
    assert (all_.total_samples, all_.parseable_samples, all_.pairwise_metrics["total_valid_pairs"], all_.pairwise_metrics["P-C_count"]) == (4, 3, 1, 1)
    assert all_.standard_metrics.accuracy == pytest.approx(2 / 3) and all_.standard_metrics.precision == 0.5 and all_.standard_metrics.recall == 1.0
    assert (all_.line_localization_metrics.num_samples, all_.line_localization_metrics.avg_recall) == (1, 0.5)
    assert got["combined", "std_cls"].line_localization_metrics is None and ("primevul_test", "std_cls") not in got


def test_pair_outcomes_add_up(spark):
    rows = spark.createDataFrame([(p, v, (p >> (0 if v else 1)) & 1) for p in range(4) for v in (True, False)], "pair int, v boolean, predicted int")
    assert sorted(r.outcome for r in metrics.pair_outcomes(rows, [], "pair", "v", "predicted").collect()) == ["P-B", "P-C", "P-R", "P-V"]


def test_runs(spark):
    rows = spark.createDataFrame([("m_run1", "0.2", 0.5), ("m_run2_concur32", "0.2", 0.7), ("m", "0.2", None)], "run string, temperature string, Acc double")
    got = runs.by_series(rows, ("Acc",)).first()
    assert (got.series, got.run_count, got.Acc_mean, got.runs) == ("m", 3, pytest.approx(0.6), ["m", "m_run1", "m_run2_concur32"])
    assert [r[0] for r in runs.table(spark.createDataFrame([("a", "3/5"), ("b", None), ("c", "1/5")], "run string, x string"), "x", True).collect()] == ["a", "c", "b"]


def test_stats(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(10)], "name int, v int")
    assert {r.v: r.samples for r in stats.frequencies(rows, "v", "name", above=0).collect()} == {0: None, 1: [1, 4, 7], 2: [2, 5, 8]}
    assert stats.cap_threshold(rows, "v", 50, 2).first().threshold == 3
    assert sum(r.n for r in stats.histogram(rows, "name", 3).collect()) == 10 and stats.histogram(rows.filter("v > 5"), "name").count() == 0
    same = stats.histogram(spark.createDataFrame([(1,), (1,)], "x int"), "x").collect()
    assert [(r.bin, r.n) for r in same] == [(0, 2)]


def sample_pairs(spark):
    return spark.createDataFrame([("p", "k", "f", "h", "s", "a\nb", "a\nc", ["CVE-1"], [], None, "the message", [(2, None, None, "b")], [(2, None, None, "c")])], "pair_id string, commit_id string, func_name string, vuln_hash string, source string, vuln_func string, patched_func string, cve array<string>, cwe array<string>, cve_desc string, commit_message string, deleted_lines array<struct<line_no:int,char_start:int,char_end:int,text:string>>, added_lines array<struct<line_no:int,char_start:int,char_end:int,text:string>>")


def test_requests_and_provider(spark):
    made = requests(sample_pairs(spark))
    prompts = {r.is_vulnerable: r for r in made.collect()}
    assert "lines that might be related to the vulnerability are: 2." in prompts[True].prompt and "fix was applied are: 2." in prompts[False].prompt
    assert "Context:\n- CVE: CVE-1\n- Commit message: the message\n\nHint" in prompts[True].prompt and prompts[True].api_max_tokens == 32768 - prompts[True].prompt_tokens

    def answer(prompt, most):
        if "patched (non" in prompt:
            raise RuntimeError("boom")
        return '<think>t</think>{"classification": "VULNERABLE", "important_lines": [2]}'

    got = {r.is_vulnerable: r for r in generation.teacher_rows(made, generation.FixedProvider(answer)).collect()}
    assert got[True].parsed_important_lines == [2] and got[False].generated_response == "ERROR_SGLANG_CALL: boom"
    done = spark.createDataFrame([("k", "h", True)], "commit_id string, vuln_hash string, is_vulnerable boolean")
    assert generation.teacher_rows(made, generation.FixedProvider(answer), done=done).count() == 1
    evaluated = generation.eval_rows(eval_requests(sample_pairs(spark)), generation.FixedProvider(lambda p, m: "(1) YES"))
    assert evaluated.count() == 4 and evaluated.filter("response = '(1) YES'").count() == 4


def test_streamed_sessions_equal_batches(spark, tmp_path):
    rows = log(spark, [0, 10, 100, 101, 500])
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    stream = logs.sessions(logs.completion_log(spark, str(tmp_path / "in"), rows.schema), "run", "ts", "size", "value")
    logs.drain(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["size"] for r in got.collect()) == [2, 2]  # the last session is still open


def test_append_new(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    write = logs.append_new(lambda df: df.write.mode("append").json(path), ["k"], path, rows.schema)
    write(rows, 0)
    write(rows.union(spark.createDataFrame([(3, "d")], rows.schema)), 1)
    assert sorted(r.k for r in spark.read.schema(rows.schema).json(path).collect()) == [1, 2, 3]
