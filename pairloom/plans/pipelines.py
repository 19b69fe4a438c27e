"""Queries of readers, writers, loaders, prompts, audits and streams, with the SQL that states the same.

They go through files in the shared folder where the operator reads or writes files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import prompts as P
from ..functions import responses as R
from ..functions import text as X
from ..functions.reward import graded_reward, score_completions
from ..operators import audit, metrics, ordinals, pairing, rollout, runs
from ..schemas import PAIR_COLUMNS, B
from ..sources import readers, sinks
from ..streaming.logs import append_new, completion_log
from ..streaming.state import completion_rows, drained, not_done, numbered_calls, stream_rates
from .catalog import ACCURACY_SQL, EVENTS, SEC, NORMAL_SQL, PARSED_SQL, REWARD_SQL, answers, code_pairs, query, table
from .datasets import in_order

#: Pairs of code_pairs(): a turn of a conversation (v) and the next one (p).
LINK_SQL = """t AS (SELECT a.conv_id, a.turn, a.role, 'p_' || a.conv_id::VARCHAR || '_' || a.turn::VARCHAR AS pair_id, coalesce(a.text, '') AS v, coalesce(b.text, '') AS p FROM conversations a
  JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role) AS n FROM conversations) WHERE n = 1) b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)"""
SPLIT_SQL = r"regexp_split_to_array({0}, '\r\n|\n|\r')"
LINES_SQL = "(CASE WHEN {0}[-1] = '' THEN {0}[:-2] ELSE {0} END)"
NUMBERED_SQL = "coalesce(array_to_string(list_transform({0}, lambda x, i: i::VARCHAR || ': ' || x), chr(10)), '')"
TOKENS_SQL = r"len(regexp_split_to_array(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+'))"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{ordinals.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# -- files


@query("SELECT doc_id, lang, source, n_chars, md5(coalesce(text, '-')) AS text_md5 FROM documents")
def json_lines_strict(spark, sf_dir):
    path, docs = scratch(spark, "lines"), table(spark, sf_dir, "documents")
    sinks.json_lines(docs.filter("doc_id % 2 = 0"), path)
    sinks.json_lines(docs.filter("doc_id % 2 = 1"), path, append=True)
    back = readers.json_lines(spark, path, docs.schema)
    return back.select("doc_id", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit("-")).cast("binary")).alias("text_md5"))


def spoilt_lines(spark, sf_dir) -> str:
    """A folder of text lines: documents as JSON, of which some are cut off or blank."""
    path = scratch(spark, "spoilt")
    whole = F.to_json(F.struct("doc_id", "lang", "text"))
    k = F.col("doc_id") % 5
    table(spark, sf_dir, "documents").select(F.when(k == 0, F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"))).when(k == 1, "  ").otherwise(whole).alias("value")).write.text(path)
    return path


DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("text", T.StringType())])


@query("SELECT doc_id, lang, length(text) AS size FROM documents WHERE doc_id % 5 > 1")
def json_lines_lenient(spark, sf_dir):
    return readers.json_lines_lenient(spark, spoilt_lines(spark, sf_dir), DOCUMENT).select("doc_id", "lang", F.length("text").cast("long").alias("size"))


@query("SELECT count(*) FILTER (doc_id % 5 > 1) AS n, count(*) FILTER (doc_id % 5 = 0) AS skipped_errors FROM documents")
def json_lines_counted(spark, sf_dir):
    rows, skipped = readers.json_lines_counted(spark, spoilt_lines(spark, sf_dir), DOCUMENT)
    return rows.agg(F.count("*").alias("n")).join(F.broadcast(skipped))  # a row each


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS line_number FROM documents QUALIFY doc_id % 5 > 1")
def json_lines_numbered(spark, sf_dir):
    path = scratch(spark, "numbered")
    whole, k = F.to_json(F.struct("doc_id", "lang")), F.col("doc_id") % 5
    table(spark, sf_dir, "documents").coalesce(1).sortWithinPartitions("doc_id").select(F.when(k == 0, "[").when(k == 1, "").otherwise(whole).alias("value")).write.text(path)
    return readers.numbered_lines(spark, path, DOCUMENT).select("doc_id", F.col("_line_number").alias("line_number"))


@query("SELECT lang AS part, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def parquet_files(spark, sf_dir):
    path = scratch(spark, "parts")
    table(spark, sf_dir, "documents").filter("lang is not null").withColumn("part", F.col("lang")).write.partitionBy("part").parquet(path)
    read = readers.parquet_files(spark, f"{path}/part=*")
    part = F.regexp_extract("_file", "part=([^/]*)/", 1)
    return read.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id % 2 = 0 AS is_validation, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def train_and_validation_files(spark, sf_dir):
    path, docs = scratch(spark, "split"), table(spark, sf_dir, "documents")
    sinks.train_and_validation(docs.withColumn("is_validation", F.col("doc_id") % 2 == 0), path)
    both = [readers.json_lines(spark, f"{path}_{name}.jsonl", docs.schema).withColumn("is_validation", F.lit(flag)) for name, flag in (("train", False), ("val", True))]
    return both[0].unionByName(both[1]).groupBy("is_validation").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT conv_id, list(turn ORDER BY turn)::VARCHAR AS turns, count(*) AS n FROM conversations GROUP BY conv_id")
def nested_parquet(spark, sf_dir):
    path = scratch(spark, "nested")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"))
    sinks.nested_parquet(turns, path)
    back = spark.read.parquet(path)
    return back.select("conv_id", F.concat(F.lit("["), F.array_join(F.transform("m", lambda x: x["turn"].cast("string")), ", "), F.lit("]")).alias("turns"), F.size("m").cast("long").alias("n"))


@query(f"WITH {PARSED_SQL} SELECT doc_id, status AS _parse_status, doc_id + 1 AS _line_number FROM r WHERE status <> 'VALID'")
def not_valid_rows(spark, sf_dir):
    path = scratch(spark, "invalid")
    parsed = answers(spark, sf_dir).withColumn("_p", R.parse(F.col("response"))).select("doc_id", "response", "_p.*", (F.col("doc_id") + 1).alias("_line_number"))
    sinks.write_not_valid(parsed, path)
    return spark.read.schema("doc_id long, _parse_status string, _line_number long").json(path)


@query("SELECT doc_id % 4 AS step, count(*) AS n, max(doc_id) AS last FROM documents WHERE doc_id % 6 IN (1, 4, 5) GROUP BY ALL")
def latest_rollout_files(spark, sf_dir):
    path = scratch(spark, "rollouts")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("output"), F.lit("{}").alias("gts"), F.lit(0.5).alias("score"), (F.col("doc_id") % 4).alias("step"))
    rows.filter("output % 6 in (1, 4, 5)").repartition("step").write.partitionBy("step").json(path)
    read = readers.rollout_files(spark, f"{path}/step=*", T.StructType([T.StructField("output", T.StringType()), T.StructField("gts", T.StringType()), T.StructField("score", T.DoubleType())]))
    newest = readers.latest_files(read.withColumn("step", F.regexp_extract("file", "step=([0-9]+)/", 1).cast("int")), 1000)
    return newest.groupBy(F.col("step").cast("long").alias("step")).agg(F.count("*").alias("n"), F.max(F.col("output").cast("long")).alias("last"))


# -- loaders and pairs


@query(f"""WITH {LINK_SQL}, b AS (SELECT *, turn % 3 = 0 AS odd, CASE WHEN turn % 3 = 0 THEN 'somewhere' ELSE 'ab' || (conv_id % 10)::VARCHAR END AS commit_id, CASE WHEN turn % 3 = 0 THEN '' ELSE 'o' || (conv_id % 5)::VARCHAR || '/r' END AS project, sha256({NORMAL_SQL.replace('(text,', '(v,')}) AS h FROM t)
SELECT '{B}_' || project || '_' || commit_id || '_' || role || '_' || h AS pair_id, commit_id, project, CASE WHEN NOT odd THEN 'https://github.com/' || project END AS project_url, h AS vuln_hash,
  CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN 'CWE-7' ELSE '' END AS cwe, length(v) AS before, length(p) AS after, v AS line, '{B}' AS source FROM b""")
def loader_b(spark, sf_dir):
    link = F.when(F.col("turn") % 3 == 0, "somewhere").otherwise(F.concat(F.lit("github.com/o"), (F.col("conv_id") % 5).cast("string"), F.lit("/r/commit/ab"), (F.col("conv_id") % 10).cast("string")))
    rows = pairing.self_linked(table(spark, sf_dir, "conversations").withColumn("_next", F.col("turn") + 1), "_next", "turn", ["conv_id"], "role", ["text"])
    before = F.coalesce("text", F.lit(""))
    change = lambda text: F.array(F.struct(F.lit(1).alias("line_no"), F.lit(0).alias("char_start"), F.lit(5).alias("char_end"), F.concat(text, F.lit("\r\n")).alias("line")))
    made = pairing.pairs_b(rows.select(link.alias("commit_link"), F.col("role").alias("func_name"), F.lit("x.c").alias("file_name"), F.when(F.col("turn") % 4 == 1, "cwe-7").when(F.col("turn") % 4 == 2, "").alias("vul_type"), before.alias("func_src_before"), F.coalesce("to_text", F.lit("")).alias("func_src_after"), F.struct(change(before).alias("deleted"), F.array().cast("array<struct<line_no:int,char_start:int,char_end:int,line:string>>").alias("added")).alias("line_changes")))
    return made.select("pair_id", "commit_id", "project", "project_url", "vuln_hash", F.array_join("cwe", ",").alias("cwe"), F.length("vuln_func").cast("long").alias("before"), F.length("patched_func").cast("long").alias("after"), F.element_at("deleted_lines", 1)["text"].alias("line"), "source")


@query(f"""WITH {LINK_SQL}, c AS (SELECT *, {LINES_SQL.format('s')} AS l FROM (SELECT *, {SPLIT_SQL.format('v')} AS s FROM t WHERE turn % 2 = 0))
SELECT 'secvuleval_proj_K' || conv_id::VARCHAR || '_' || role || '_' || sha256({NORMAL_SQL.replace('(text,', '(v,')}) AS pair_id, conv_id * 1000 + turn AS source_row_idx, len(l) > 0 AND trim(l[1]) <> '' AS has_line,
  CASE WHEN len(l) > 0 AND regexp_replace(l[1], '^\\s+|\\s+$', '', 'g') <> '' THEN 1 END AS line_no, 'native' AS reindex_method, length(p) AS after FROM c WHERE len(l) > 0 AND regexp_replace(l[1], '^\\s+|\\s+$', '', 'g') <> ''""")
def loader_c(spark, sf_dir):
    """Functions linked to their fixes by id, with line changes that fit."""
    t = table(spark, sf_dir, "conversations")
    first = t.withColumn("_n", F.row_number().over(pairing.Window.partitionBy("conv_id", "turn").orderBy("role"))).withColumn("_all", F.col("conv_id") * 1000 + F.col("turn"))
    code = F.coalesce("text", F.lit(""))
    line = X.strip(F.coalesce(F.get(X.lines(code), F.lit(0)), F.lit("")))
    encoded = F.to_json(F.array(F.array(F.lit("1"), line)))
    rows = first.select(
        F.col("_all").alias("idx"), (F.col("turn") % 2 == 0).alias("is_vulnerable"), (F.col("_all") + 1).cast("double").alias("fixed_func_idx"), encoded.alias("changed_lines"), code.alias("func_body"), F.col("role").alias("func_name"), F.lit("x.c").alias("filepath"), F.lit("proj").alias("project"),
        F.lit(None).cast("string").alias("project_url"), F.concat(F.lit("K"), "conv_id").alias("commit_id"), F.array().cast("array<string>").alias("cve_list"), F.array().cast("array<string>").alias("cwe_list"), F.struct(F.array(F.lit("why")).alias("Explanation")).alias("context"), F.lit(None).cast("string").alias("commit_message"), "_n", F.lit("f").alias("_file"), line.alias("_line"),
    )
    made = pairing.pairs_c(rows.filter("_line <> ''").unionByName(rows.filter("_line = ''").withColumn("is_vulnerable", F.lit(False))).withColumn("changed_lines", F.when(F.col("is_vulnerable"), F.col("changed_lines")).otherwise("none")), ordinal="_n")
    number = F.element_at("deleted_lines", 1)["line_no"]
    return made.select("pair_id", "source_row_idx", F.lit(True).alias("has_line"), number.alias("line_no"), "reindex_method", F.length("patched_func").cast("long").alias("after"))


@query(f"""WITH {LINK_SQL} SELECT pair_id FROM t WHERE array_to_string(list_transform({SPLIT_SQL.format('v')}, lambda x: rtrim(x, ' ')), chr(10)) <> array_to_string(list_transform({SPLIT_SQL.format('p')}, lambda x: rtrim(x, ' ')), chr(10))""")
def pairs_without_no_ops(spark, sf_dir):
    return pairing.without_no_ops(code_pairs(spark, sf_dir)).select("pair_id")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'user') AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant')")
def groups_with_both_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("target", F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 0))
    return pairing.both_labels(rows, "conv_id").select("conv_id", "turn", "role")


@query(f"""WITH {LINK_SQL}, x AS (SELECT conv_id, turn, pair_id, role, v FROM t),
o AS (SELECT *, row_number() OVER (ORDER BY k, turn, pair_id, h) - 1 AS ordinal FROM (SELECT 0 AS k, *, sha256({NORMAL_SQL.replace('(text,', '(v,')}) AS h FROM x WHERE turn % 2 = 0 UNION ALL SELECT 1, *, sha256({NORMAL_SQL.replace('(text,', '(v,')}) FROM x WHERE turn % 2 = 1))
SELECT pair_id, ordinal FROM o""")
def ordered_union(spark, sf_dir):
    pairs = code_pairs(spark, sf_dir).select(*PAIR_COLUMNS)
    return in_order(pairs.filter("source_row_idx % 2 = 0"), pairs.filter("source_row_idx % 2 = 1")).select("pair_id", "ordinal")


@query(f"""WITH {LINK_SQL}, n AS (SELECT *, {SPLIT_SQL.format('v')} AS s FROM t), c AS (SELECT *, CASE WHEN s[-1] = '' THEN len(s) - 1 ELSE len(s) END AS k FROM n)
SELECT CASE turn % 3 WHEN 0 THEN 'primevul' WHEN 1 THEN 'sven' ELSE 'secvuleval' END AS source, 'oob' AS type, count(*) AS n, count(DISTINCT pair_id) AS pairs FROM c WHERE v <> '' AND greatest(k, 1) > k GROUP BY ALL""")
def issue_counts(spark, sf_dir):
    return audit.issue_counts(audit.line_issues(code_pairs(spark, sf_dir)).filter("field = 'deleted_lines'"))


# -- texts and prompts


@query(r"""WITH l AS (SELECT doc_id, doc_id % 4 AS k, regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '^\s+|\s+$', '', 'g') AS first FROM documents),
b AS (SELECT doc_id, CASE k WHEN 0 THEN 'static inline const char *f' || doc_id::VARCHAR || '(int a)' WHEN 1 THEN first || ' g (x)' WHEN 2 THEN 'if (' || first || ')' ELSE first END AS line FROM l),
n AS (SELECT *, regexp_extract(line, '^(?:[\pL\pM\pN_]+[\s*]+)*([\pL\pM\pN_]+)\s*\(', 1) AS name FROM b)
SELECT doc_id, CASE WHEN name <> '' AND name NOT IN ('if', 'else', 'while', 'for', 'switch', 'return', 'sizeof', 'typeof', 'do') THEN name ELSE left(line, 40) END AS name FROM n""")
def function_names(spark, sf_dir):
    k, text = F.col("doc_id") % 4, F.coalesce("text", F.lit(""))
    first = X.strip(F.substring_index(text, "\n", 1))
    body = (
        F.when(k == 0, F.concat(F.lit("static inline const char *f"), F.col("doc_id").cast("string"), F.lit("(int a)\n{ g(); }"))).when(k == 1, F.concat(first, F.lit(" g (x)\nint h(y)")))
        .when(k == 2, F.concat(F.lit("if ("), first, F.lit(")"))).otherwise(text)
    )
    return table(spark, sf_dir, "documents").select("doc_id", X.function_name(body).alias("name"))


@query(r"""WITH n AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') AS w, text FROM documents)
SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN NULL WHEN len(w) <= 20 OR regexp_replace(text, '\s', '', 'g') = '' THEN text ELSE array_to_string(w[1:20], ' ') || '...' END AS cut, (CASE WHEN doc_id % 3 = 0 THEN 'src2_' WHEN doc_id % 3 = 1 THEN 'None_' ELSE '_' END) || doc_id::VARCHAR AS key,
  CASE doc_id % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'temp0p2' ELSE 'multi' END AS temperature, CASE doc_id % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'c' ELSE '' END AS filled, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a b' WHEN 2 THEN NULL ELSE 'nil' END AS message FROM n""")
def text_pieces(spark, sf_dir):
    d = F.col("doc_id")
    first = F.when(d % 3 == 0, "src2").when(d % 3 == 2, "")
    folder = F.when(d % 3 == 0, "metrics").when(d % 3 == 1, "metrics_temp0p2").otherwise("metrics_multi")
    filled = X.first_filled(F.when(d % 3 == 0, "b").otherwise(""), F.when(d % 3 == 1, "c"))
    message = F.when(d % 4 == 0, " None ").when(d % 4 == 1, " a b\n").when(d % 4 == 3, "nil")
    key = F.concat_ws("_", F.element_at(F.split(X.pair_id(first, *[F.col("doc_id")] * 4), "_"), 1), F.element_at(F.split(X.pair_id(first, *[F.col("doc_id")] * 4), "_"), -1))
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate_tokens(F.col("text"), 20).alias("cut"), key.alias("key"), X.temperature_label(folder).alias("temperature"), filled.alias("filled"), X.present(message).alias("message"))


@query(r"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '3:x,4:y z' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN '7:' ELSE (doc_id % 100)::VARCHAR || ':' || source END AS changes,
  CASE doc_id % 5 WHEN 0 THEN '3,4' WHEN 4 THEN (doc_id % 100)::VARCHAR ELSE '' END AS numbers, CASE doc_id % 5 WHEN 0 THEN TRUE WHEN 4 THEN doc_id % 100 NOT IN (1) OR source <> 'line' WHEN 3 THEN TRUE ELSE FALSE END AS misplaced FROM documents WHERE source IS NOT NULL""")
def line_changes_decoded(spark, sf_dir):
    d = F.col("doc_id")
    text = F.when(d % 5 == 0, '[[3, " x "], ["4", "y z", 9]]').when(d % 5 == 1, '[[1, "a"], ["b", "c"]]').when(d % 5 == 2, "nothing").when(d % 5 == 3, "[[7, null]]").otherwise(F.concat(F.lit("[["), (d % 100).cast("string"), F.lit(', "'), F.col("source"), F.lit('"]]')))
    rows = table(spark, sf_dir, "documents").filter("source is not null").select("doc_id", X.encoded_changes(text).alias("c"))
    shown = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["line_no"].cast("string"), x["text"])), ",")
    return rows.select("doc_id", shown.alias("changes"), F.array_join(X.line_numbers(F.col("c")).cast("array<string>"), ",").alias("numbers"), X.misplaced(F.col("c"), F.lit("line\n")).alias("misplaced"))


PROMPT_HEAD = f"'{P.OPENING}' || chr(10) || chr(10) || '{P.ANALYZE}' || chr(10) || chr(10) || '```' || chr(10)"
SIDES_SQL = f"""{LINK_SQL}, s AS (SELECT conv_id, turn, pair_id, v, unnest([TRUE, FALSE]) AS is_vulnerable, unnest([v, p]) AS code FROM t),
l AS (SELECT *, {SPLIT_SQL.format('code')} AS c, {SPLIT_SQL.format('v')} AS o FROM s), n AS (SELECT *, {LINES_SQL.format('c')} AS b, {LINES_SQL.format('o')} AS w FROM l)"""


@query(f"""WITH {SIDES_SQL}, y AS (SELECT pair_id, is_vulnerable, 'std_cls' AS prompt_type, '{P.YES_NO_HEAD}' || code || '{P.YES_NO_TAIL}' AS q FROM n
  UNION ALL SELECT pair_id, is_vulnerable, 'training', {PROMPT_HEAD} || {NUMBERED_SQL.format('b')} || chr(10) || '```' || chr(10) || chr(10) || '{P.TASK}' FROM n)
SELECT pair_id, is_vulnerable, prompt_type, is_vulnerable::INT AS target, CASE WHEN {TOKENS_SQL.format('q')} > {P.CAPACITY - P.RESERVED} THEN 'SKIPPED: prompt_too_long:' || {TOKENS_SQL.format('q')}::VARCHAR || '_tokens' END AS response, md5(q) AS prompt_md5 FROM y""")
def evaluation_requests(spark, sf_dir):
    return P.eval_requests(code_pairs(spark, sf_dir)).select("pair_id", "is_vulnerable", "prompt_type", "target", "response", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query(f"""WITH {SIDES_SQL},
k AS (SELECT *, CASE WHEN turn = 0 THEN '- CVE: CVE-2020-1' WHEN turn = 1 THEN '- Commit message: fix' ELSE '- Description: known weakness' END AS known, regexp_replace(list_extract(string_split(v, chr(10)), -1), '^\\s+|\\s+$', '', 'g') <> '' AS has_line, greatest(len(w), 1) AS number FROM n),
q AS (SELECT *, {PROMPT_HEAD} || {NUMBERED_SQL.format('b')} || chr(10) || '```' || chr(10) || chr(10) || 'Context:' || chr(10) || known || chr(10) || chr(10)
  || CASE WHEN is_vulnerable THEN '{P.VULNERABLE_HINT}' || CASE WHEN has_line THEN chr(10) || '{P.VULNERABLE_LINES}' || number::VARCHAR || '.' ELSE '' END ELSE '{P.PATCHED_HINT}' END || chr(10) || chr(10) || '{P.TASK}' AS prompt FROM k)
SELECT pair_id, is_vulnerable, md5(prompt) AS prompt_md5, {TOKENS_SQL.format('prompt')} AS prompt_tokens, least({P.CAPACITY}, {P.CAPACITY} - {TOKENS_SQL.format('prompt')}) AS api_max_tokens FROM q WHERE {TOKENS_SQL.format('prompt')} <= {P.CAPACITY - P.RESERVED}""")
def teacher_requests(spark, sf_dir):
    made = P.requests(code_pairs(spark, sf_dir))
    return made.select("pair_id", "is_vulnerable", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), F.col("prompt_tokens").cast("long").alias("prompt_tokens"), F.col("api_max_tokens").cast("long").alias("api_max_tokens"))


@query(r"""WITH n AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS l FROM documents WHERE text NOT LIKE '%```%'))
SELECT doc_id, len(l) AS last, coalesce(array_to_string(list_transform(l, lambda x, i: i::VARCHAR || ': ' || x), chr(10)), '') AS code FROM n WHERE len(l) > 0""")
def code_of_prompts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter("text not like '%```%'").filter(F.size(X.lines(F.col("text"))) > 0)
    whole = X.prompt_text(F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("see\n```c\n"), X.numbered(F.col("text")), F.lit("\n```\nend")).alias("content"))))
    code = X.code_in_prompt(whole)
    return rows.select("doc_id", X.last_line_number(code).alias("last"), F.regexp_replace(code, "\n$", "").alias("code"))


# -- answers, rewards, reports


@query(f"""WITH {PARSED_SQL} SELECT doc_id, CASE WHEN status = 'VALID' THEN (classification = 'VULNERABLE')::INT END AS predicted, CASE WHEN status = 'VALID' THEN array_to_string(lines, ',') END AS lines, CASE WHEN k >= 7 THEN array_to_string(lines, ',') ELSE '' END AS aliased,
  {REWARD_SQL.format(acc=ACCURACY_SQL)} AS reward, CASE WHEN doc_id % 3 = 2 THEN TRUE ELSE is_vulnerable END AS told, CASE WHEN doc_id % 3 = 2 THEN '' ELSE array_to_string(truth, ',') END AS told_lines FROM r""")
def answers_by_all_readers(spark, sf_dir):
    """What metrics, alias readers and rewards by JSON truth take from the same answers."""
    rows = answers(spark, sf_dir).withColumn("g", R.encode_truth(F.col("is_vulnerable"), F.col("truth")))
    scored = score_completions(rows, "response", ground_truth="g")
    said, lines = R.for_metrics(F.col("parsed"))
    python = F.when(F.col("doc_id") % 3 == 0, F.col("g")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("{'is_vulnerable': "), F.initcap(F.col("is_vulnerable").cast("string")), F.lit(", 'ground_truth_lines': ["), F.array_join(F.col("truth").cast("array<string>"), ", "), F.lit("]}"))).otherwise("none of it")
    told = R.tolerant_truth(python)
    return scored.select("doc_id", said.alias("predicted"), F.array_join(lines.cast("array<string>"), ",").alias("lines"), F.array_join(R.aliased_lines(F.col("response")).cast("array<string>"), ",").alias("aliased"), "reward", told["is_vulnerable"].alias("told"), F.array_join(told["ground_truth_lines"].cast("array<string>"), ",").alias("told_lines"))


@query(f"""WITH {PARSED_SQL}, e AS (SELECT *, CASE WHEN is_vulnerable THEN len(truth) ELSE 0 END AS nt, CASE WHEN is_vulnerable THEN len(list_intersect(lines, truth)) ELSE 0 END AS hits FROM r)
SELECT doc_id, round(CASE WHEN status NOT IN ('VALID', 'INVALID_CLASSIFICATION') THEN 0.0 WHEN classification IS NULL THEN 0.15 WHEN (classification = 'VULNERABLE') <> is_vulnerable THEN 0.15
  WHEN nt = 0 THEN CASE WHEN len(lines) = 0 THEN 1.25 ELSE 0.75 END ELSE 0.75 + 0.5 * least(1.0, hits / nt / 0.75) END::DOUBLE, 9) AS reward FROM e""")
def graded_reward_of_vulnerable(spark, sf_dir):
    parsed = answers(spark, sf_dir).withColumn("p", R.parse(F.col("response")))
    return parsed.select("doc_id", F.round(graded_reward(F.col("p.classification"), F.col("p.lines"), F.col("p.status"), F.col("is_vulnerable"), F.col("truth"), True), 9).alias("reward"))


@query(f"""WITH {PARSED_SQL}, e AS (SELECT *, (doc_id % 10) / 10.0::DOUBLE AS score, CASE WHEN status = 'VALID' THEN len(lines) ELSE 0 END AS n_lines, CASE WHEN status NOT IN ('VALID', 'INVALID_CLASSIFICATION') THEN 0.0 WHEN classification IS NULL THEN 0.15
  WHEN (classification = 'VULNERABLE') = is_vulnerable THEN 0.75 + 0.5 * least(1.0, {ACCURACY_SQL} / 0.75) ELSE 0.15 END::DOUBLE AS new_score FROM r),
p AS (SELECT quantile_cont(n_lines, 0.99) AS p99 FROM e)
SELECT is_vulnerable, grouping(is_vulnerable) = 1 AS is_total, count(*) AS n, round(avg(score), 9) AS mean_score, round(avg(new_score), 9) AS mean_new_score, round(stddev_pop(score), 9) AS std_score, round(stddev_pop(new_score), 9) AS std_new_score, round(avg((n_lines > p99)::INT), 9) AS spray_rate
FROM e, p GROUP BY GROUPING SETS ((is_vulnerable), ())""")
def rollout_score_report(spark, sf_dir):
    rows = answers(spark, sf_dir).select(F.col("response").alias("output"), R.encode_truth(F.col("is_vulnerable"), F.col("truth")).alias("gts"), (F.col("doc_id") % 10 / F.lit(10.0)).alias("score"))
    report = runs.rollout_scores(runs.rollouts_with_rewards(rows))
    return report.withColumns({c: F.round(c, 9) for c in ("mean_score", "mean_new_score", "std_score", "std_new_score", "spray_rate")})


METRIC_SQL = f"""WITH {PARSED_SQL}, m AS (SELECT doc_id // 2 AS pair, CASE WHEN doc_id % 3 = 0 THEN 'primevul_test' ELSE 'sven_val' END AS split, is_vulnerable, CASE WHEN doc_id % 4 < 2 THEN 'training' ELSE 'std_cls' END AS prompt_type, truth, lines,
    CASE WHEN doc_id % 4 < 2 THEN CASE WHEN status = 'VALID' THEN (classification = 'VULNERABLE')::INT END WHEN k IN (4, 7) THEN 0 END AS predicted FROM r),
u AS (SELECT 'primevul_test' AS subset, * FROM m WHERE split = 'primevul_test' UNION ALL SELECT 'combined', * FROM m),
g AS (SELECT *, CASE WHEN prompt_type = 'training' AND is_vulnerable AND predicted = 1 THEN len(list_intersect(list_distinct(lines), truth)) END AS hit, len(list_distinct(lines)) AS said, len(truth) AS wanted FROM u),
s AS (SELECT subset, prompt_type, count(*) AS total_samples, count(predicted) AS parseable_samples, count(*) FILTER (predicted IS NOT NULL AND predicted = is_vulnerable::INT) AS ok, count(*) FILTER (predicted = 1 AND is_vulnerable) AS tp,
    count(*) FILTER (predicted = 1) AS ps, count(*) FILTER (predicted IS NOT NULL AND is_vulnerable) AS ts, count(hit) AS line_samples, avg(hit / wanted) AS line_recall, avg(hit / said) AS line_precision FROM g GROUP BY ALL),
o AS (SELECT subset, prompt_type, pair, max(predicted) FILTER (is_vulnerable) AS pv, max(predicted) FILTER (NOT is_vulnerable) AS pp FROM u WHERE predicted IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (is_vulnerable) = 1 AND count(*) FILTER (NOT is_vulnerable) = 1),
c AS (SELECT subset, prompt_type, count(*) AS n, count(*) FILTER (pv = 1 AND pp = 0) AS pc, count(*) FILTER (pv = 1 AND pp = 1) AS pvv, count(*) FILTER (pv = 0 AND pp = 0) AS pb, count(*) FILTER (pv = 0 AND pp = 1) AS pr FROM o GROUP BY ALL)
SELECT s.subset, s.prompt_type, total_samples, parseable_samples, total_samples - parseable_samples AS unparseable_samples, round(CASE WHEN parseable_samples > 0 THEN ok / parseable_samples ELSE 0 END, 9) AS accuracy, round(CASE WHEN ps > 0 THEN tp / ps ELSE 0 END, 9) AS "precision", round(CASE WHEN ts > 0 THEN tp / ts ELSE 0 END, 9) AS recall,
  round(CASE WHEN ps + ts > 0 THEN 2 * tp / (ps + ts) ELSE 0 END, 9) AS f1_score, coalesce(n, 0) AS total_valid_pairs, coalesce(pc, 0) AS pc, coalesce(pvv, 0) AS pv, coalesce(pb, 0) AS pb, coalesce(pr, 0) AS pr, CASE WHEN s.prompt_type = 'training' THEN line_samples END AS line_samples,
  round(CASE WHEN s.prompt_type = 'training' THEN line_precision END, 9) AS line_precision, round(CASE WHEN s.prompt_type = 'training' THEN line_recall END, 9) AS line_recall FROM s LEFT JOIN c ON s.subset = c.subset AND s.prompt_type = c.prompt_type"""


@query(METRIC_SQL)
def metrics_documents(spark, sf_dir):
    empty = F.lit(None).cast("int")
    rows = answers(spark, sf_dir).withColumn("ground_truth_lines", F.transform("truth", lambda n: F.struct(n.alias("line_no"), empty.alias("char_start"), empty.alias("char_end"), F.lit("x").alias("text"))))
    rows = rows.select(F.concat(F.lit("p"), F.floor(F.col("doc_id") / 2)).alias("pair_id"), F.lit("c").alias("commit_id"), F.when(F.col("doc_id") % 3 == 0, "primevul_test").otherwise("sven_val").alias("split"), "is_vulnerable", F.col("is_vulnerable").cast("int").alias("target"), F.when(F.col("doc_id") % 4 < 2, "training").otherwise("std_cls").alias("prompt_type"), "response", "ground_truth_lines")
    path = scratch(spark, "metrics")
    sinks.metric_files(metrics.reports(rows), path)
    found = spark.read.json(f"{path}/metrics_*.json")
    s, p, l = "standard_metrics", "pairwise_metrics", "line_localization_metrics"
    return found.select(
        "subset", "prompt_type", "total_samples", "parseable_samples", "unparseable_samples", *(F.round(f"{s}.{k}", 9).alias(k) for k in ("accuracy", "precision", "recall", "f1_score")), F.col(f"{p}.total_valid_pairs").alias("total_valid_pairs"),
        *(F.col(p).getField(f"{k}_count").alias(k.lower().replace("-", "")) for k in metrics.OUTCOMES), F.col(f"{l}.num_samples").alias("line_samples"), F.round(f"{l}.avg_precision", 9).alias("line_precision"), F.round(f"{l}.avg_recall", 9).alias("line_recall"),
    )


@query(f"WITH {PARSED_SQL}, n AS (SELECT status, doc_id, row_number() OVER (PARTITION BY status ORDER BY doc_id) AS n FROM r) SELECT status, doc_id FROM n WHERE n <= 3")
def status_samples(spark, sf_dir):
    parsed = answers(spark, sf_dir).withColumn("status", R.parse(F.col("response"))["status"])
    return metrics.status_samples(parsed, "response", "doc_id").select("status", "doc_id")


@query(f"""WITH {LINK_SQL} SELECT count(*) AS total, count(*) FILTER (v = p) AS identical, 0 AS no_deleted_lines, 0 AS cve_description_mismatch, count(*) FILTER (turn = 0) AS with_cve, 0 AS with_cwe, count(*) FILTER (turn > 1) AS with_description,
count(*) FILTER (turn = 1) AS with_message, count(*) AS with_project, count(*) FILTER (coalesce(role, '') <> '') AS with_func_name, count(*) FILTER (role IS NOT NULL) AS with_filepath FROM t""")
def pair_audit(spark, sf_dir):
    return audit.pair_report(code_pairs(spark, sf_dir))


@query(r"""WITH n AS (SELECT doc_id, source, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, source, regexp_split_to_array(text, '\r\n|\n|\r') AS l FROM documents WHERE text NOT LIKE '%```%')),
f AS (SELECT source, doc_id % 2 = 0 AS v, len(l) AS k, doc_id % 5 = 0 AND doc_id % 7 <> 0 AS oob, doc_id % 3 = 0 AND doc_id % 7 <> 0 AND regexp_replace(l[1], '^\s+|\s+$', '', 'g') <> 'ZZZ' AND NOT contains(l[1], 'ZZZ') AND NOT contains('ZZZ', regexp_replace(l[1], '^\s+|\s+$', '', 'g')) AS mis, doc_id % 7 = 0 AS bare, doc_id % 11 = 0 AS hint FROM n WHERE len(l) > 0)
SELECT coalesce(source, 'Unknown') AS source, count(*) AS total, count(*) FILTER (oob) AS oob, count(*) FILTER (mis) AS misindexed, count(*) FILTER (v AND bare) AS vulnerable_without_lines, count(*) FILTER (k <= 3) AS tiny, count(*) FILTER (hint AND NOT v) AS hint_conflict, 0 AS patched_hint_conflict FROM f GROUP BY ALL""")
def rl_audit(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").filter("text not like '%```%'").withColumn("_k", F.size(X.lines(F.col("text")))).filter("_k > 0")
    numbers = F.when(d % 7 == 0, F.array().cast("array<int>")).when(d % 5 == 0, F.array(F.lit(1), F.col("_k") + 1)).otherwise(F.array(F.lit(1)))
    prompt = F.concat(F.when(d % 11 == 0, P.VULNERABLE_HINT).otherwise(""), F.lit("\n```\n"), X.numbered(F.col("text")), F.lit("\n```"))
    none = F.lit(None).cast("int")
    pairs = rows.select(d.cast("string").alias("pair_id"), "source", F.when(d % 3 == 0, F.array(F.struct(F.lit(1).alias("line_no"), none.alias("char_start"), none.alias("char_end"), F.lit("ZZZ").alias("text")))).alias("deleted_lines"))
    made = rows.select(F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("prompt"), F.struct(R.encode_truth(d % 2 == 0, numbers).alias("ground_truth")).alias("reward_model"), F.struct(d.cast("string").alias("pair_id"), d.alias("idx")).alias("extra_info"))
    return audit.rl_report(audit.rl_flags(made, pairs), "source")


@query("""WITH h AS (SELECT event_id, value / 1e6 AS clip, value AS score, 1 / (1 + event_id)::DOUBLE AS entropy, event_id::DOUBLE AS len, value AS val FROM events),
e AS (SELECT avg(clip) AS m, arg_min(entropy, event_id) AS e0, arg_max(entropy, event_id) AS e1, min(len) AS l0, max(len) AS l1, arg_min(val, event_id) AS v0, arg_max(val, event_id) AS v1, count(*) AS n FROM h),
r AS (SELECT score, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM h), q AS (SELECT avg(score) FILTER (i >= n - ceil(n / 4)) - avg(score) FILTER (i < n // 4) AS d FROM r)
SELECT 'actor/pg_clipfrac' AS series, CASE WHEN m < 0.01 THEN 'clip fraction very low' WHEN m > 0.2 THEN 'clip fraction high' END AS finding, round(m, 6) AS value FROM e WHERE m < 0.01 OR m > 0.2
UNION ALL SELECT 'actor/entropy', CASE WHEN e1 < e0 * 0.5 THEN 'entropy collapsed' ELSE 'entropy decreased' END, round(e1 / e0, 6) FROM e WHERE e1 < e0 * 0.8
UNION ALL SELECT 'response_length/mean', CASE WHEN l1 - l0 < -500 THEN 'responses shorter' ELSE 'responses longer' END, round(l1 - l0, 6) FROM e WHERE abs(l1 - l0) > 500
UNION ALL SELECT 'val-core/vulnerability_detection/acc/mean@1', 'validation accuracy changed', round(v1 - v0, 6) FROM e
UNION ALL SELECT 'critic/score/mean', 'reward ' || CASE WHEN abs(d) < 0.02 THEN 'flat' WHEN d > 0 THEN 'up' ELSE 'down' END, round(d, 6) FROM q""")
def training_diagnostics(spark, sf_dir):
    e, v = F.col("event_id"), F.col("value")
    history = table(spark, sf_dir, "events").select(e.alias("training/global_step"), (v / 1e6).alias(rollout.CLIP), v.alias(rollout.SCORE), (1 / (1 + e).cast("double")).alias(rollout.ENTROPY), e.cast("double").alias(rollout.RESPONSE_LENGTH), v.alias(rollout.VALIDATION))
    return rollout.diagnostics(history).withColumn("value", F.round("value", 6))


@query("SELECT doc_id, lang, NULL::BIGINT AS n_chars FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL, n_chars FROM documents WHERE doc_id % 2 = 1")
def union_missing_cols(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return readers.histories([d.filter("doc_id % 2 = 0").select("doc_id", "lang"), d.filter("doc_id % 2 = 1").select("doc_id", "n_chars")], by="doc_id")


@query("SELECT row_number() OVER (ORDER BY n DESC, lang) AS place, lang, n FROM (SELECT coalesce(lang, '-') AS lang, count(*) AS n FROM documents GROUP BY ALL) QUALIFY place <= 3")
def sorted_run_table(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("-")).alias("lang")).agg(F.count("*").alias("n"))
    shown = counts.withColumn("x", F.concat(F.col("n").cast("string"), F.lit("/9")))
    top = runs.table(shown, "x", descending=True, limit=3)
    return ordinals.with_ordinal(top, F.desc("n"), "lang", name="place").select((F.col("place") + 1).alias("place"), "lang", "n")


# -- streams


@query("SELECT event_type, count(*) AS n, sum(value) > 0 AS positive, max(event_id) AS last FROM events GROUP BY event_type")
def stream_resume(spark, sf_dir):
    """Events come as files into a stream that is stopped and begun again; each is written once."""
    log, out, mark = (scratch(spark, n) for n in ("log", "out", "mark"))
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    write = append_new(lambda rows: sinks.json_lines(rows, out, append=True), ["event_id"], out, events.schema)
    for part in (F.col("event_id") % 3 < 2, F.col("event_id") % 3 > 0):  # the second files repeat some of the first
        sinks.json_lines(events.filter(part), log, append=True)
        stream = spark.readStream.schema(events.schema).json(log)
        stream.writeStream.foreachBatch(write).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(events.schema).json(out)
    return done.groupBy("event_type").agg(F.count("*").alias("n"), (F.sum("value") > 0).alias("positive"), F.max("event_id").alias("last"))


@query(f"WITH {PARSED_SQL} SELECT doc_id % 3 + 1 AS step, count(*) AS n, count(DISTINCT doc_id) - 1 AS last_idx, round(sum({REWARD_SQL.format(acc=ACCURACY_SQL)}), 6) AS reward FROM r GROUP BY ALL")
def completion_log_steps(spark, sf_dir):
    """Three calls of the reward, each logged under its own step."""
    path, scored = scratch(spark, "steps"), score_completions(answers(spark, sf_dir), "response", "is_vulnerable", "truth")
    rows = scored.select("doc_id", "is_vulnerable", F.col("truth").alias("ground_truth_lines"), F.col("response").alias("completion"), "reward")
    for step in (1, 2, 3):
        sinks.completion_log(rows.filter(F.col("doc_id") % 3 == step - 1), path, step, ("doc_id",))
    log = spark.read.schema("step long, idx long, reward double, timestamp timestamp").json(path)
    return log.filter("timestamp is not null").groupBy("step").agg(F.count("*").alias("n"), F.max("idx").alias("last_idx"), F.round(F.sum("reward"), 6).alias("reward"))


LATE_SQL = "(event_id % 13 = 0 AND day(ts) <= 8)"


@query(f"""SELECT event_id, round(CASE WHEN {SEC.format('b', 'ts')} > 0 THEN 20 / ({SEC.format('b', 'ts')} / 60) WHEN b IS NOT NULL THEN 'inf'::DOUBLE END, 6) AS rate, round({SEC.format('a', 'ts')}, 6) AS delta_seconds, round({SEC.format('f', 'ts')} / 60, 4) AS elapsed_minutes, completed
FROM (SELECT event_id, ts, lag(ts, 20) OVER w AS b, lag(ts) OVER w AS a, first_value(ts) OVER w AS f, row_number() OVER w AS completed FROM events WHERE NOT {LATE_SQL} WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))""")
def rates_of_a_stream(spark, sf_dir):
    """Ten days of events a round: some come a round later but within the delay, others so late that they are left out; the stream is stopped after each round."""
    log, out, mark = (scratch(spark, n) for n in ("events", "rates", "mark"))
    events = table(spark, sf_dir, "events").select(*EVENTS)
    day, hour = F.day("ts"), F.hour("ts")
    due = F.least(F.floor((day - 1) / 10), F.lit(2))
    due = F.when((F.col("event_id") % 13 == 0) & (day <= 8), 2).when((F.col("event_id") % 11 == 0) & (day % 10 == 0) & (hour >= 6), F.least(due + 1, F.lit(2))).otherwise(due)
    end = events.select("event_type").distinct().select("event_type", F.lit("2200-01-01").cast(events.schema["ts"].dataType).alias("ts"), F.lit(None).cast("long").alias("event_id"))
    for rows in (*(events.filter(due == k) for k in range(3)), end):
        rows.write.mode("append").parquet(log)
        drained(stream_rates(spark.readStream.schema(events.schema).parquet(log), *EVENTS, "1 day"), out, mark)
    found = spark.read.parquet(out)
    return found.select(F.col("id").alias("event_id"), F.round("rate", 6).alias("rate"), F.round("delta_seconds", 6).alias("delta_seconds"), F.round("elapsed_minutes", 4).alias("elapsed_minutes"), "completed")


@query(f"""WITH {PARSED_SQL}, c AS (SELECT doc_id // 4 AS call, (doc_id // 4) % 3 AS k, lang, count(*) AS size, sum({REWARD_SQL.format(acc=ACCURACY_SQL)}) AS reward FROM r JOIN (SELECT doc_id, coalesce(lang, '') AS lang FROM documents) USING (doc_id) GROUP BY ALL),
t AS (SELECT lang, k, count(*) AS calls, sum(size)::BIGINT AS n, round(sum(reward), 6) AS reward FROM c GROUP BY lang, k)
SELECT lang AS log, k AS round, calls, calls AS steps, (1 + sum(calls) OVER w - calls)::BIGINT AS first, (sum(calls) OVER w)::BIGINT AS last, n, reward FROM t WINDOW w AS (PARTITION BY lang ORDER BY k)""")
def steps_of_calls(spark, sf_dir):
    """Calls of the reward by language, in three rounds, after each of which the stream is stopped: the numbers go on without a gap or repeat."""
    log, out, mark = (scratch(spark, n) for n in ("calls", "steps", "mark"))
    scored = score_completions(answers(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("log")), "doc_id"), "response", "is_vulnerable", "truth")
    one = F.struct("doc_id", "is_vulnerable", F.col("truth").alias("ground_truth_lines"), F.col("response").alias("completion"), "reward")
    calls = scored.groupBy("log", F.floor(F.col("doc_id") / 4).alias("call")).agg(F.array_sort(F.collect_list(one)).alias("completions"))
    for k in range(3):
        sinks.json_lines(calls.filter(F.col("call") % 3 == k), log, append=True)
        drained(completion_rows(numbered_calls(completion_log(spark, log, calls.schema), "log")), out, mark)
    rows = spark.read.parquet(out)
    steps = rows.groupBy("log", (F.col("call") % 3).alias("round"), "call", "step").agg(F.count("*").alias("n"), F.sum("reward").alias("reward"))
    return steps.groupBy("log", "round").agg(F.count_distinct("call").alias("calls"), F.count_distinct("step").alias("steps"), F.min("step").alias("first"), F.max("step").alias("last"), F.sum("n").alias("n"), F.round(F.sum("reward"), 6).alias("reward"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS keys, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def resume_from_state(spark, sf_dir):
    """A fifth of the events is done before; the rest comes twice into a stream that is stopped between, and each is written once."""
    log, out, mark = (scratch(spark, n) for n in ("again", "once", "state"))
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    done = events.filter("event_id % 5 = 0")
    for part in (F.col("event_id") % 3 < 2, F.col("event_id") % 3 > 0):
        sinks.json_lines(events.filter(part), log, append=True)
        drained(not_done(completion_log(spark, log, events.schema), ["event_id"], done), out, mark)
    both = spark.read.parquet(out).unionByName(done)
    return both.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("keys"), F.sum("event_id").alias("ids"))
