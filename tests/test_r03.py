"""What round 3 found: functions come to Python in batches, keys of a stream in groups, and ties of rates stay whole."""

import datetime as dt
import re

from pyspark.sql import functions as F

from pairloom.llm import common
from pairloom.operators import dedup
from pairloom.plans import expected
from pairloom.streaming import state


def test_functions_are_resolved_in_batches(spark, sf_dir):
    """known_collapses, conflict_collapse, merged_pairs, collapse_statistics: no call for each function, the same rows, over the ends of batches too."""
    rows = expected.variants(spark, sf_dir).withColumn("commit_id", F.when(F.col("ordinal") % 17 > 8, F.col("commit_id"))).cache()  # a group of nulls is large
    rows = rows.unionByName(rows.limit(40).withColumn("ordinal", F.col("ordinal") + 100000)).withColumn("func_name", F.when(F.col("commit_id").isNull(), (F.col("ordinal") % 50).cast("string")).otherwise(F.col("func_name")))
    held = [r.asDict(recursive=True) for r in dedup.without_repeats(rows, "ordinal").collect()]
    groups: dict = {}
    for r in sorted(held, key=lambda r: r["ordinal"]):
        groups.setdefault(((r["commit_id"] or "").lower(), r["func_name"]), []).append(r)
    want = [r for some in groups.values() for r in dedup.resolve(some)[0]]
    made = dedup.deduplicate(rows)
    assert "FlatMapGroups" not in made._jdf.queryExecution().toString()
    shown = lambda r: (r["pair_id"], r["ordinal"], r["cve"], r["cve_desc"], r["commit_message"], r["vuln_func"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(str, map(shown, made.collect()))) == sorted(map(str, map(shown, want)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_keys_come_in_groups(spark, tmp_path, monkeypatch):
    """resume_from_state: rows of many keys come to Python together."""
    assert state.GROUPS > 3
    monkeypatch.setattr(state, "GROUPS", 3)
    rows = spark.createDataFrame([(None if i == 0 else i % 40, float(i)) for i in range(120)], "k long, v double")
    done = spark.createDataFrame([(k, 0.0) for k in (3, 4, 77)], "k long, v double")
    for part in (F.col("v") < 70, F.col("v") >= 50):
        rows.filter(part).write.mode("append").parquet(f"{tmp_path}/in")
        state.drained(state.not_done(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), ["k"], done), f"{tmp_path}/out", f"{tmp_path}/mark")
    got = [r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got, key=lambda k: -1 if k is None else k) == [None, *(k for k in range(40) if k not in (3, 4))]


def test_rates_keep_large_ties(spark, tmp_path):
    """rates_of_a_stream: a row without a tie in the batch doesn't round the ties of others."""
    big, start = 2**53 + 1, dt.datetime(2024, 1, 1)
    rows = [("r", start + dt.timedelta(seconds=i), big + 2 * i) for i in range(5)] + [("r", dt.datetime(2030, 1, 1), None)]
    log = spark.createDataFrame(rows, "run string, ts timestamp, id long")
    log.coalesce(1).write.parquet(f"{tmp_path}/in")
    state.drained(state.stream_rates(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in"), "run", "ts", "id", "1 day", size=2), f"{tmp_path}/out", f"{tmp_path}/mark")
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("completed").collect()
    assert [(r.id, r.completed, r.rate, r.delta_seconds) for r in got] == [(big + 2 * i, i + 1, 60.0 if i >= 2 else None, 1.0 if i else None) for i in range(5)]


def test_tasks_give_back_all_but_their_own_cache():
    """pipeline, encoding: what other stages left in a worker goes, cycles without a cache too, and the segments stay."""
    import gc
    import weakref

    class Left:
        pass

    left = Left()
    left.self, gone = left, weakref.ref(left)
    del left
    common.worker_cache("other")["a"], common.worker_cache("mine")["b"] = 1, 2
    gc.disable()
    try:
        common.forget_caches(but="mine")
        assert gone() is None and common.worker_cache("mine") == {"b": 2} and common.worker_cache("other") == {}
    finally:
        gc.enable()
        common.forget_caches()


def test_line_changes_are_made_some_rows_at_a_time(monkeypatch):
    """line_diff: the changed lines of a whole batch are never Python objects at once."""
    import pyarrow as pa

    from pairloom.functions import diff

    held, plain = [], diff._changes
    monkeypatch.setattr(diff, "_changes", lambda rows: held.append(len(rows)) or plain(rows))
    olds, news = [None, *(f"a\n{i}" for i in range(1000))], ["b", *(f"a\n{i + 1}" for i in range(1000))]
    made = diff._line_changes.func(pa.array(olds), pa.array(news))
    assert max(held) <= 256 and made.to_pylist() == [dict(zip(("deleted", "added"), diff.line_changes(a or "", b), strict=True)) for a, b in zip(olds, news, strict=True)]
    assert len(diff._line_changes.func(pa.array([], pa.string()), pa.array([], pa.string()))) == 0


def test_a_message_is_split_once_and_tokens_are_those_of_the_prompt(spark):
    """cut_messages: whole, cut, described and missing messages around the bound, with and without other context."""
    from pairloom.functions import prompts
    from pairloom.functions.text import token_count

    room = prompts.CAPACITY - prompts.RESERVED
    n_base = len(prompts.OPENING.split()) + len(prompts.ANALYZE.split()) + 2 + 2 + len(prompts.VULNERABLE_HINT.split()) + len(prompts.TASK.split())
    rows, texts = [], [None, "", " none ", "a message", "\u3000 a\u2003b\u00a0c\x1cd "]
    texts += [" ".join(f"w{k}" for k in range(room - n_base + more)) for more in (-9, -5, -4, -3, -1, 0, 1, 9)]
    for message in texts:
        for cve, description in (([], None), (["CVE-1", ""], None), ([], "told"), (["CVE-1"], " N/A ")):
            rows += [(len(rows), "int a;", "b", cve, [], description, message), (len(rows) + 1, "x " * (room - n_base - 60), "b", cve, [], description, message)]
    pairs = spark.createDataFrame(rows, "id int, vuln_func string, patched_func string, cve array<string>, cwe array<string>, cve_desc string, commit_message string")
    pairs = pairs.withColumn("deleted_lines", F.array().cast(expected.CHANGE)).withColumn("added_lines", F.array().cast(expected.CHANGE))
    for drop in (True, False):
        made = prompts.requests(pairs, drop_message_with_description=drop)
        assert made._jdf.queryExecution().optimizedPlan().toString().count("split(trim(_message") == 1
        got = made.withColumn("counted", token_count(F.col("prompt"))).collect()
        assert len(got) == 2 * len(rows) and all(r.prompt_tokens == r.counted and r.api_max_tokens == prompts.CAPACITY - r.counted for r in got)
        cut = [r for r in got if re.search(r"w\d+\.\.\.", r.prompt)]
        assert cut and all(("Description: " in r.prompt) is False for r in cut)
        for r in got:
            words = (r.commit_message or "").split()
            said = "Commit message: " in r.prompt
            if not words or words == ["none"] or (drop and r.cve_desc == "told"):
                assert not said
            elif r not in cut and said:
                assert r.commit_message.strip() in r.prompt


def test_long_texts_are_parted_at_the_same_blanks(spark):
    from pairloom.functions import text as X

    every = spark.range(0x10000).filter("id < 55296 OR id > 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    parting = every.filter(F.size(F.split(F.concat(F.lit("a"), "c", F.lit("b")), X.BLANK_IN_JAVA)) == 2).collect()
    assert {r.c for r in parting} == set(X.BLANKS) and all(ord(r.c) == r.id for r in parting)


def test_stages_send_texts_to_python_in_small_batches(spark):
    import pyarrow as pa

    import corpus_pipeline

    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(bound, None)
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('a word ', 300)").alias("text"))  # 12 MB
    try:
        spark.conf.unset(bound)
        encoded = corpus_pipeline.encode(spark, docs, None)
        sizes = docs.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"size": [b.nbytes]}) for b in batches), "size long")
        assert common.BATCH_BYTES / 2 < sizes.agg(F.max("size")).first()[0] < 2 * common.BATCH_BYTES
        assert encoded.filter("round_trip").count() == 6000
        spark.conf.set(bound, "1m")  # what a session was given stays
        corpus_pipeline.encode(spark, docs, None)
        assert spark.conf.get(bound) == "1m"
    finally:
        spark.conf.unset(bound)
        if before is not None:
            spark.conf.set(bound, before)
