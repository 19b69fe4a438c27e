"""Queries over the test tables, one for each operator, with the SQL that states the same.

The tables hold no code pairs, so pairs, responses and logs are derived from
their columns by rules that SQL can repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import responses as R
from ..functions import reward as W
from ..functions import text as X
from ..functions.diff import changed_lines, normalized_diff, similarity
from ..functions.prompts import training_prompt
from ..operators import audit, dedup, lookups, metrics, ordinals, pairing, pooling, rollout, runs, stats
from ..schemas import A, B, C
from ..streaming.logs import sessions
from .datasets import rl_rows, sft_reasons

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- derived inputs

NORMAL_SQL = r"""lower(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)))"""
PAIRS_SQL = f"""SELECT doc_id AS ordinal, 'c' || (doc_id % 97)::VARCHAR AS commit_id, lang AS func_name,
    CASE doc_id % 3 WHEN 0 THEN '{A}' WHEN 1 THEN '{B}' ELSE '{C}' END AS source,
    CASE WHEN doc_id % 4 = 0 THEN ['CVE-2020-' || (doc_id % 7 + 1000)::VARCHAR] ELSE []::VARCHAR[] END AS cve,
    CASE WHEN doc_id % 5 = 0 THEN ['CWE-' || (doc_id % 2)::VARCHAR, 'NVD-CWE-Other'] WHEN doc_id % 5 = 1 THEN [' none '] ELSE []::VARCHAR[] END AS cwe,
    CASE WHEN doc_id % 6 = 0 THEN 'about ' || (doc_id % 194)::VARCHAR WHEN doc_id % 6 = 1 THEN 'N/A' END AS cve_desc,
    CASE WHEN doc_id % 3 = 0 THEN repeat('m', (doc_id % 11)::INT) ELSE '' END AS commit_message FROM documents"""


def metadata_rows(spark, sf_dir) -> DataFrame:
    """Metadata of code pairs, made of document ids."""
    d = F.col("doc_id")
    empty = F.array().cast("array<string>")
    return table(spark, sf_dir, "documents").select(
        d.alias("ordinal"), F.concat(F.lit("c"), (d % 97).cast("string")).alias("commit_id"), F.col("lang").alias("func_name"),
        F.when(d % 3 == 0, A).when(d % 3 == 1, B).otherwise(C).alias("source"),
        F.when(d % 4 == 0, F.array(F.concat(F.lit("CVE-2020-"), (d % 7 + 1000).cast("string")))).otherwise(empty).alias("cve"),
        F.when(d % 5 == 0, F.array(F.concat(F.lit("CWE-"), (d % 2).cast("string")), F.lit("NVD-CWE-Other"))).when(d % 5 == 1, F.array(F.lit(" none "))).otherwise(empty).alias("cwe"),
        F.when(d % 6 == 0, F.concat(F.lit("about "), (d % 194).cast("string"))).when(d % 6 == 1, "N/A").alias("cve_desc"),
        F.when(d % 3 == 0, F.repeat(F.lit("m"), (d % 11).cast("int"))).otherwise("").alias("commit_message"),
    )


POOL_SQL = f"""p AS ({PAIRS_SQL}),
f AS (SELECT commit_id, func_name, min(ordinal) AS pos,
    list_sort(list_distinct(flatten(list(cve)))) AS cves,
    list_sort(list_distinct(list_filter(flatten(list(list_transform(cwe, lambda x: trim(x)))), lambda x: x NOT IN ('none', 'NVD-CWE-Other')))) AS cwes,
    min(CASE WHEN cve_desc LIKE 'about%' THEN lpad((CASE source WHEN '{A}' THEN 0 WHEN '{C}' THEN 1 ELSE 2 END)::VARCHAR, 2, '0') || lpad(ordinal::VARCHAR, 12, '0') || cve_desc END) AS d,
    max(commit_message) AS msg FROM p GROUP BY ALL),
c AS (SELECT commit_id AS commit, list_sort(list_distinct(flatten(list(cves)))) AS cve, list_sort(list_distinct(flatten(list(cwes)))) AS cwe,
    substr(min(CASE WHEN d IS NOT NULL THEN substr(d, 1, 2) || lpad(pos::VARCHAR, 12, '0') || substr(d, 15) END), 15) AS cve_desc, max(msg) AS commit_message,
    (count(DISTINCT CASE WHEN len(cves) > 0 THEN cves END) > 1 OR count(DISTINCT CASE WHEN len(cwes) > 0 THEN cwes END) > 1 OR count(DISTINCT substr(d, 15)) > 1) AS is_heterogeneous
  FROM f GROUP BY commit_id)"""


def code_pairs(spark, sf_dir) -> DataFrame:
    """Pairs in the unified schema, of turns of conversations: the code before is a turn, the code after the next one."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    linked = pairing.self_linked(t.withColumn("_next", F.col("turn") + 1), "_next", "turn", ["conv_id"], "role", ["text"])
    code, after = F.coalesce("text", F.lit("")), F.coalesce("to_text", F.lit(""))
    made = linked.withColumn("vuln_func", code).withColumn("patched_func", after)
    none, lines = F.array().cast("array<string>"), "array<struct<line_no:int,char_start:int,char_end:int,text:string>>"
    number = F.greatest(F.size(X.lines(F.col("vuln_func"))), F.lit(1))
    one = lambda n, text: F.array(F.struct(n.cast("int").alias("line_no"), F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"), text.alias("text"))).cast(lines)
    return made.select(
        F.when(F.col("turn") % 3 == 0, A).when(F.col("turn") % 3 == 1, B).otherwise(C).alias("source"), F.concat_ws("_", F.lit("p"), "conv_id", "turn").alias("pair_id"),
        F.concat(F.lit("K"), "conv_id").alias("commit_id"), F.lit("proj").alias("project"), F.lit(None).cast("string").alias("project_url"), F.col("role").alias("func_name"), F.concat(F.lit("src/"), "role", F.lit(".c")).alias("filepath"),
        X.code_hash(F.col("vuln_func")).alias("vuln_hash"), "vuln_func", "patched_func", F.when(F.col("turn") == 0, F.array(F.lit("CVE-2020-1"))).otherwise(none).alias("cve"), none.alias("cwe"),
        F.when(F.col("turn") > 1, "known weakness").alias("cve_desc"), F.when(F.col("turn") == 1, "fix").otherwise("").alias("commit_message"),
        one(number, X.strip(F.element_at(F.split("vuln_func", "\n"), -1))).alias("deleted_lines"), one(F.lit(1), F.lit("")).alias("added_lines"), F.col("turn").cast("long").alias("source_row_idx"),
        (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("ordinal"),
    )


def answers(spark, sf_dir) -> DataFrame:
    """Model responses of each kind, by document id."""
    d = F.col("doc_id")
    k = d % 10
    number = (d % 5 + 1).cast("string")
    text = (
        F.when(k == 0, "").when(k == 1, "ERROR: timeout").when(k == 2, "SKIPPED: prompt_too_long").when(k == 3, F.lit('{"classification": "VULNERABLE"}')).when(k == 4, "<think>x</think> nothing")
        .when(k == 5, F.lit('<think>x</think>{"classification": "maybe"}')).when(k == 6, F.concat(F.lit('<think>x</think>{"classification": "vulnerable", "important_lines": ['), number, F.lit("], ")))
        .when(k == 7, F.concat(F.lit('<think>x</think> so {"a": {}} {"classification": "NOT_VULNERABLE", "important_lines": ['), number, F.lit("]}")))
        .otherwise(F.concat(F.lit('<think>x</think>{"classification": "VULNERABLE", "important_lines": ["'), number, F.lit('", 7, true]}')))
    )
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("response"), (d % 2 == 0).alias("is_vulnerable"), F.sequence(F.lit(1), (d % 4).cast("int") + 1).alias("truth"))


PARSED_SQL = """a AS (SELECT doc_id, doc_id % 10 AS k, doc_id % 5 + 1 AS n, doc_id % 2 = 0 AS is_vulnerable, range(1, doc_id % 4 + 2) AS truth FROM documents),
r AS (SELECT *, CASE k WHEN 0 THEN 'EMPTY' WHEN 1 THEN 'API_ERROR' WHEN 2 THEN 'SKIPPED' WHEN 3 THEN 'INCOMPLETE' WHEN 4 THEN 'NO_JSON' WHEN 5 THEN 'INVALID_CLASSIFICATION' WHEN 6 THEN 'REGEX_FALLBACK' ELSE 'VALID' END AS status,
    CASE WHEN k = 7 THEN 'NOT_VULNERABLE' WHEN k = 6 OR k > 7 THEN 'VULNERABLE' END AS classification,
    CASE WHEN k IN (6, 7) THEN [n] WHEN k > 7 THEN [n, 7, 1] ELSE []::BIGINT[] END AS lines FROM a)"""


# -- text, hashes, keys


@query(f"SELECT doc_id, sha256({NORMAL_SQL}) AS code_hash FROM documents")
def normalize_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.code_hash(F.col("text")).alias("code_hash"))


@query(f"""WITH h AS (SELECT doc_id, source, sha256({NORMAL_SQL}) AS code_hash FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY code_hash ORDER BY CASE source WHEN 'src2' THEN 1 WHEN 'src1' THEN 2 WHEN 'src0' THEN 3 ELSE 99 END, doc_id) AS n, count(*) OVER (PARTITION BY code_hash) AS n_copies FROM h)
SELECT code_hash, doc_id, source, n_copies FROM r WHERE n = 1""")
def hash_dedup_pick_best(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", X.code_hash(F.col("text")).alias("code_hash"))
    return dedup.best_by_hash(rows.select("doc_id", "source", "code_hash", F.col("doc_id").alias("at")), ["code_hash"], "source", ("src2", "src1", "src0"), "at").drop("at")


@query(f"SELECT lang, sha256({NORMAL_SQL}) AS code_hash, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return lookups.duplicate_keys(table(spark, sf_dir, "documents"), "lang", X.code_hash(F.col("text")).alias("code_hash"))


@query("""SELECT count(*) AS total, count(*) FILTER (coalesce(text, '') <> '') AS with_text, count(*) FILTER (coalesce(lang, '') <> '') AS with_lang, count(*) FILTER (quality IS NOT NULL) AS with_quality,
count(*) FILTER (toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)""")
def field_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return stats.coverage(rows, {"with_text": filled("text"), "with_lang": filled("lang"), "with_quality": F.col("quality").isNotNull(), "toxic": F.col("toxic") == 1})


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def category_counts(spark, sf_dir):
    return stats.counts_by(table(spark, sf_dir, "documents"), "lang", "source")


@query("SELECT doc_id, len(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS tokens, regexp_replace('run' || (doc_id % 3)::VARCHAR || '_run' || (doc_id % 9)::VARCHAR || '_worse', '_run[0-9]+(_evenworse|_worse|_concur[0-9]+)?', '') AS series FROM documents WHERE trim(text, ' \n\t\r') <> ''")
def text_functions(spark, sf_dir):
    run = F.concat(F.lit("run"), (F.col("doc_id") % 3).cast("string"), F.lit("_run"), (F.col("doc_id") % 9).cast("string"), F.lit("_worse"))
    rows = table(spark, sf_dir, "documents").filter(X.strip(F.col("text")) != "")
    return rows.select("doc_id", X.token_count(F.col("text")).cast("long").alias("tokens"), X.series_name(run).alias("series"))


@query("""WITH l AS (SELECT doc_id, 'github.com/o' || (doc_id % 5)::VARCHAR || '/r/commit/' || CASE WHEN doc_id % 3 = 0 THEN 'XYZ' ELSE 'ab' || (doc_id % 10)::VARCHAR END AS link FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'o' || (doc_id % 5)::VARCHAR || '/r' END AS project, CASE WHEN doc_id % 3 = 0 THEN link ELSE 'ab' || (doc_id % 10)::VARCHAR END AS commit_id, 'https://' || split_part(link, '/commit/', 1) AS project_url FROM l""")
def commit_links(spark, sf_dir):
    d = F.col("doc_id")
    link = F.concat(F.lit("github.com/o"), (d % 5).cast("string"), F.lit("/r/commit/"), F.when(d % 3 == 0, "XYZ").otherwise(F.concat(F.lit("ab"), (d % 10).cast("string"))))
    project, commit, url = X.commit_link_parts(F.col("link"))
    return table(spark, sf_dir, "documents").select("doc_id", link.alias("link")).select("doc_id", project.alias("project"), commit.alias("commit_id"), url.alias("project_url"))


@query("""WITH f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a.c' WHEN 2 THEN 'x/a.c' ELSE 'y/b.c' END AS a, CASE doc_id % 5 WHEN 0 THEN 'None' WHEN 1 THEN 'b.c' WHEN 2 THEN 'x/a.c' ELSE 'y/a.c' END AS b, CASE WHEN doc_id % 7 = 0 THEN 'p' ELSE '' END AS q FROM documents)
SELECT doc_id, CASE WHEN a IS NULL OR b = 'None' THEN FALSE WHEN NOT contains(a, '/') OR NOT contains(b, '/') THEN split_part(a, '/', -1) <> split_part(b, '/', -1) WHEN a = b AND q = 'p' THEN TRUE ELSE a <> b END AS is_different FROM f""")
def file_difference(spark, sf_dir):
    d = F.col("doc_id")
    a = F.when(d % 4 == 1, "a.c").when(d % 4 == 2, "x/a.c").when(d % 4 == 3, "y/b.c")
    b = F.when(d % 5 == 0, "None").when(d % 5 == 1, "b.c").when(d % 5 == 2, "x/a.c").otherwise("y/a.c")
    return table(spark, sf_dir, "documents").select("doc_id", X.different_file(a, b, F.when(d % 7 == 0, "p").otherwise(""), F.lit("other")).alias("is_different"))


@query("""WITH d AS (SELECT doc_id, 'see CVE-2021-' || (doc_id % 4 + 1000)::VARCHAR || ' and CVE-1999-12' AS t, CASE WHEN doc_id % 3 = 0 THEN []::VARCHAR[] ELSE ['CVE-2021-' || (doc_id % 3 + 1000)::VARCHAR] END AS c FROM documents)
SELECT doc_id, (len(c) > 0 AND NOT list_has_any(c, regexp_extract_all(t, 'CVE-[0-9]{4}-[0-9]+'))) AS is_mismatch FROM d""")
def cve_mismatch(spark, sf_dir):
    d = F.col("doc_id")
    text = F.concat(F.lit("see CVE-2021-"), (d % 4 + 1000).cast("string"), F.lit(" and CVE-1999-12"))
    cves = F.when(d % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("CVE-2021-"), (d % 3 + 1000).cast("string"))))
    return table(spark, sf_dir, "documents").select("doc_id", X.mismatched_cves(cves, text).alias("is_mismatch"))


# -- pools, joins


@query(f"WITH {POOL_SQL} SELECT commit, array_to_string(cve, ',') AS cve, array_to_string(cwe, ',') AS cwe, cve_desc, commit_message, is_heterogeneous FROM c")
def metadata_pool(spark, sf_dir):
    p = pooling.pool(metadata_rows(spark, sf_dir))
    return p.select("commit", F.array_join("cve", ",").alias("cve"), F.array_join("cwe", ",").alias("cwe"), "cve_desc", "commit_message", "is_heterogeneous")


@query(f"WITH {POOL_SQL} SELECT commit FROM c WHERE is_heterogeneous")
def heterogeneous_groups(spark, sf_dir):
    return pooling.pool(metadata_rows(spark, sf_dir)).filter("is_heterogeneous").select("commit")


@query(f"""WITH {POOL_SQL},
q AS (SELECT p.ordinal, p.cve, list_sort(list_distinct(list_filter(list_transform(p.cwe, lambda x: trim(x)), lambda x: x <> 'none'))) AS cwe, p.cve_desc, p.commit_message, c.cve AS c1, c.cwe AS c2, c.cve_desc AS c3, c.commit_message AS c4, c.is_heterogeneous AS h
  FROM p JOIN c ON p.commit_id = c.commit)
SELECT ordinal, array_to_string(CASE WHEN len(cve) = 0 AND NOT h THEN c1 ELSE cve END, ',') AS cve, array_to_string(CASE WHEN len(cwe) = 0 AND NOT h THEN c2 ELSE cwe END, ',') AS cwe,
  CASE WHEN (cve_desc IS NULL OR cve_desc = 'N/A') AND NOT h AND c3 IS NOT NULL THEN c3 ELSE cve_desc END AS cve_desc, CASE WHEN length(c4) > length(commit_message) THEN c4 ELSE commit_message END AS commit_message FROM q""")
def enrich_fill_only(spark, sf_dir):
    rows = metadata_rows(spark, sf_dir)
    e = pooling.enrich(rows, pooling.pool(rows))
    return e.select("ordinal", F.array_join("cve", ",").alias("cve"), F.array_join("cwe", ",").alias("cwe"), "cve_desc", "commit_message")


@query("SELECT a.conv_id, a.turn, length(b.text) AS next_length FROM conversations a JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role) AS n FROM conversations) WHERE n = 1) b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn")
def self_link_pairs(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("_next", F.col("turn") + 1)
    linked = pairing.self_linked(t, "_next", "turn", ["conv_id"], "role", ["text"])
    return linked.select("conv_id", "turn", F.length("to_text").cast("long").alias("next_length"))


@query("SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS is_found FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def pair_lookup_left(spark, sf_dir):
    return lookups.looked_up(table(spark, sf_dir, "documents").select("doc_id"), lookups.unique_index(table(spark, sf_dir, "labels"), "doc_id"), "doc_id", ["quality"])


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def pair_lookup_inner(spark, sf_dir):
    found = lookups.looked_up(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", ["quality"])
    return found.filter("is_found").drop("is_found")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pair_lookup_anti(spark, sf_dir):
    return lookups.not_done(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""SELECT d.doc_id, array_to_string(CASE WHEN d.doc_id % 2 = 1 AND d.doc_id % 3 = 0 AND l.doc_id IS NOT NULL THEN [l.quality, l.toxic] WHEN d.doc_id % 3 = 0 THEN [] ELSE [7] END, ',') AS lines FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def lookup_with_fallback(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(7))).alias("lines"))
    index = table(spark, sf_dir, "labels").select("doc_id", F.array("quality", "toxic").cast("array<int>").alias("other"))
    return lookups.with_fallback(rows, index, "doc_id", "lines", "other", F.col("doc_id") % 2 == 1).select("doc_id", F.array_join("lines", ",").alias("lines"))


@query("SELECT lang, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY lang")
def last_row_by_key(spark, sf_dir):
    return lookups.last_by_key(table(spark, sf_dir, "documents").select("lang", "doc_id", "source", F.col("doc_id").alias("at")), "lang", "at").drop("at")


@query("SELECT conv_id, text, role FROM (SELECT *, count(*) OVER w AS n, count(*) FILTER (role = 'user') OVER w AS u, count(*) FILTER (role = 'assistant') OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id)) WHERE n = 2 AND u = 1 AND a = 1")
def strict_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("target", F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 0))
    return pairing.exactly_one_each(rows, "conv_id").select("conv_id", "text", "role")


@query("SELECT doc_id, unnest([TRUE, FALSE]) AS is_vulnerable, length(text) AS size FROM documents")
def label_explode(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("vuln_func"), F.col("text").alias("patched_func"))
    return pairing.labelled(rows).select("doc_id", "is_vulnerable", F.length("code").cast("long").alias("size"))


# -- prompts


@query(r"""WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS p FROM documents),
n AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM l)
SELECT doc_id, md5('You are a security expert analyzing code for vulnerabilities.' || chr(10) || chr(10) || 'Analyze the following code snippet:' || chr(10) || chr(10) || '```' || chr(10)
 || coalesce(array_to_string(list_transform(p, lambda x, i: i::VARCHAR || ': ' || x), chr(10)), '') || chr(10) || '```' || chr(10) || chr(10)
 || 'Task: After your reasoning, provide your analysis in JSON format: {"classification": "VULNERABLE" or "NOT_VULNERABLE", "important_lines": [...], "reasoning_summary": "..."}') AS prompt_md5 FROM n""")
def line_numbering_prompt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(training_prompt(F.col("text")).cast("binary")).alias("prompt_md5"))


@query("SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS chat FROM conversations GROUP BY conv_id")
def chat_render(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return turns.select("conv_id", X.chat(F.col("m")).alias("chat"))


# -- responses, rewards, metrics


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_field_parse(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT doc_id, doc_id % 2 = 0 AND doc_id % 5 <> 0 OR doc_id % 5 = 0 AS is_vulnerable, CASE WHEN doc_id % 5 = 0 THEN '' ELSE array_to_string(range(1, doc_id % 4 + 1), ',') END AS lines FROM documents""")
def truth_codec(spark, sf_dir):
    d = F.col("doc_id")
    numbers = F.when(d % 4 > 0, F.sequence(F.lit(1), F.greatest(d % 4, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))
    text = F.when(d % 5 == 0, "not json").otherwise(R.encode_truth(d % 2 == 0, numbers))
    told = table(spark, sf_dir, "documents").select("doc_id", R.decode_truth(text).alias("t"))
    return told.select("doc_id", "t.is_vulnerable", F.array_join("t.ground_truth_lines", ",").alias("lines"))


@query(f"WITH {PARSED_SQL} SELECT doc_id, status, classification, array_to_string(lines, ',') AS lines FROM r")
def response_parse_status(spark, sf_dir):
    parsed = answers(spark, sf_dir).select("doc_id", R.parse(F.col("response")).alias("p"))
    return parsed.select("doc_id", "p.status", "p.classification", F.array_join("p.lines", ",").alias("lines"))


@query(f"WITH {PARSED_SQL}, s AS (SELECT is_vulnerable, status, count(*) AS n FROM r GROUP BY ALL) SELECT is_vulnerable, status, n, round(100.0 * n / sum(n) OVER (PARTITION BY is_vulnerable), 2)::DOUBLE AS percent FROM s")
def status_report(spark, sf_dir):
    parsed = answers(spark, sf_dir).select("is_vulnerable", R.parse(F.col("response"))["status"].alias("status"))
    return metrics.status_distribution(parsed, ("is_vulnerable",))


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'ERROR: x' WHEN 2 THEN 'so (1) YES: it is' WHEN 3 THEN '<think>yes</think> (2) NO' WHEN 4 THEN 'certainly yes' ELSE 'I know' END AS r FROM documents)
SELECT doc_id, CASE WHEN r IS NULL OR r LIKE 'ERROR:%' THEN NULL WHEN doc_id % 6 IN (2, 4) THEN 1 ELSE 0 END AS predicted FROM t""")
def std_cls_parse(spark, sf_dir):
    k = F.col("doc_id") % 6
    text = F.when(k == 1, "ERROR: x").when(k == 2, "so (1) YES: it is").when(k == 3, "<think>yes</think> (2) NO").when(k == 4, "certainly yes").when(k == 5, "I know")
    return table(spark, sf_dir, "documents").select("doc_id", R.yes_no(text).alias("predicted"))


REWARD_SQL = """CASE WHEN status NOT IN ('VALID', 'INVALID_CLASSIFICATION') THEN 0.0 WHEN classification IS NULL THEN 0.1
  WHEN (classification = 'VULNERABLE') = is_vulnerable THEN CASE WHEN {acc} >= 0.5 THEN 1.0 ELSE 0.75 END WHEN {acc} > 0 THEN 0.3 ELSE 0.1 END::DOUBLE"""
ACCURACY_SQL = "(len(list_intersect(lines, truth)) / len(truth))"


@query(f"WITH {PARSED_SQL} SELECT doc_id, {REWARD_SQL.format(acc=ACCURACY_SQL)} AS reward FROM r")
def reward_tiers(spark, sf_dir):
    return W.score_completions(answers(spark, sf_dir), "response", "is_vulnerable", "truth").select("doc_id", "reward")


@query(f"WITH {PARSED_SQL} SELECT doc_id, {REWARD_SQL.format(acc=f'(CASE WHEN len(lines) > 2 THEN 0 ELSE {ACCURACY_SQL} END)')} AS reward FROM r")
def spray_guard(spark, sf_dir):
    return W.score_completions(answers(spark, sf_dir), "response", "is_vulnerable", "truth", spray_threshold=2).select("doc_id", "reward")


@query(f"""WITH {PARSED_SQL} SELECT doc_id, round(CASE WHEN status NOT IN ('VALID', 'INVALID_CLASSIFICATION') THEN 0.0 WHEN classification IS NULL THEN 0.15
  WHEN (classification = 'VULNERABLE') = is_vulnerable THEN 0.75 + 0.5 * least(1.0, {ACCURACY_SQL} / 0.75) ELSE 0.15 END::DOUBLE, 9) AS reward FROM r""")
def graded_reward(spark, sf_dir):
    parsed = answers(spark, sf_dir).withColumn("p", R.parse(F.col("response")))
    return parsed.select("doc_id", F.round(W.graded_reward(F.col("p.classification"), F.col("p.lines"), F.col("p.status"), F.col("is_vulnerable"), F.col("truth")), 9).alias("reward"))


@query("""WITH t AS (SELECT d.lang, l.quality AS target, 1 - l.toxic AS predicted FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT lang, count(*) AS n, count(*) FILTER (target = 1 AND predicted = 1) AS tp, count(*) FILTER (target = predicted) AS ok, count(*) FILTER (predicted = 1) AS said, count(*) FILTER (target = 1) AS tr FROM t GROUP BY lang)
SELECT lang, round(ok / n, 9) AS accuracy, round(CASE WHEN said > 0 THEN tp / said ELSE 0 END, 9) AS "precision", round(CASE WHEN tr > 0 THEN tp / tr ELSE 0 END, 9) AS recall, round(CASE WHEN said + tr > 0 THEN 2 * tp / (said + tr) ELSE 0 END, 9) AS f1_score FROM c""")
def classification_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("lang").agg(*(F.round(c, 9).alias(k) for k, c in metrics.classification(F.col("quality"), 1 - F.col("toxic")).items()))


@query("""WITH s AS (SELECT conv_id, count(*) FILTER (role = 'user') AS v, count(*) FILTER (role <> 'user') AS p, max(length(text) % 2) FILTER (role = 'user') AS pv, max(length(text) % 2) FILTER (role <> 'user') AS pp FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN pv = 1 AND pp = 0 THEN 'P-C' WHEN pv = 1 THEN 'P-V' WHEN pp = 0 THEN 'P-B' ELSE 'P-R' END AS outcome FROM s WHERE v = 1 AND p = 1""")
def pairwise_outcomes(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.col("role") == "user").alias("is_vulnerable"), (F.length("text") % 2).alias("predicted"))
    return metrics.pair_outcomes(rows, [], "conv_id", "is_vulnerable", "predicted")


@query(f"""WITH {PARSED_SQL}, s AS (SELECT len(list_intersect(lines, truth)) AS h, len(list_distinct(lines)) AS p, len(truth) AS t FROM r WHERE status = 'VALID'),
m AS (SELECT h / p AS a, h / t AS b, CASE WHEN h = 0 THEN 0 ELSE 2 * (h / p) * (h / t) / (h / p + h / t) END AS c FROM s)
SELECT count(*) AS n, round(avg(a), 9) AS "precision", round(avg(b), 9) AS recall, round(avg(c), 9) AS f1 FROM m""")
def line_localization(spark, sf_dir):
    parsed = answers(spark, sf_dir).withColumn("p", R.parse(F.col("response"))).filter("p.status = 'VALID'")
    scored = parsed.select(W.line_scores(F.col("truth"), F.col("p.lines")).alias("s"))
    return scored.agg(F.count("s").alias("n"), *(F.round(F.avg(f"s.{k}"), 9).alias(k) for k in ("precision", "recall", "f1")))


# -- counts and caps

ORDER_LINES = "SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey"


def order_lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))


@query(f"WITH c AS ({ORDER_LINES}) SELECT ceil(quantile_cont(n_lines, 0.9))::BIGINT AS threshold FROM c")
def gt_cap_percentile(spark, sf_dir):
    return stats.cap_threshold(order_lines(spark, sf_dir), "n_lines", 90)


@query(f"""WITH c AS ({ORDER_LINES}), t AS (SELECT DISTINCT unnest([floor(quantile_cont(n_lines, 0.75))::BIGINT, floor(quantile_cont(n_lines, 0.95))::BIGINT, floor(quantile_cont(n_lines, 0.99))::BIGINT, 50, 75, 100]) AS cap FROM c)
SELECT cap, (SELECT count(*) FROM c WHERE n_lines > cap) AS lost, round(100.0 * (SELECT count(*) FROM c WHERE n_lines > cap) / (SELECT count(*) FROM c), 9)::DOUBLE AS percent FROM t""")
def loss_if_capped(spark, sf_dir):
    return stats.loss_if_capped(order_lines(spark, sf_dir), "n_lines").withColumn("percent", F.round("percent", 9))


@query(f"WITH c AS ({ORDER_LINES}), s AS (SELECT *, row_number() OVER (PARTITION BY n_lines ORDER BY l_orderkey) AS r FROM c) SELECT n_lines, count(*) AS n, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey) FILTER (r <= 3 AND n_lines > 2) AS samples FROM s GROUP BY n_lines")
def freq_distribution(spark, sf_dir):
    f = stats.frequencies(order_lines(spark, sf_dir), "n_lines", "l_orderkey", above=2)
    return f.select("n_lines", "n", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


@query("""SELECT lang, count(n_chars) AS n, min(n_chars) AS min, max(n_chars) AS max, round(avg(n_chars), 6) AS mean, quantile_cont(n_chars, 0.5) AS median, round(stddev_pop(n_chars), 6) AS std_pop, round(stddev_samp(n_chars), 6) AS std,
round(quantile_cont(n_chars, 0.75), 6) AS p75, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(quantile_cont(n_chars, 0.99), 6) AS p99 FROM documents GROUP BY lang""")
def length_summary(spark, sf_dir):
    s = stats.summary(table(spark, sf_dir, "documents"), "n_chars", ["lang"])
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "std_pop", "std", "p75", "p90", "p95", "p99")})


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS t FROM events), b AS (SELECT least(floor((value - lo) / ((hi - lo) / 30)), 29)::INT AS bin, lo, hi, t FROM events, e)
SELECT bin, count(*) AS n, round(count(*) / t / ((hi - lo) / 30), 9) AS density FROM b GROUP BY bin, lo, hi, t""")
def value_histogram(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "events"), "value").withColumn("density", F.round("density", 9))


@query("SELECT toxic, grouping(toxic) = 1 AS is_total, count(*) AS n, round(avg(quality), 9) AS mean_quality FROM labels GROUP BY GROUPING SETS ((toxic), ())")
def means_with_total(spark, sf_dir):
    return stats.with_total(table(spark, sf_dir, "labels"), "toxic", n=F.count("*"), mean_quality=F.round(F.avg("quality"), 9))


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, i >= n - floor(n * 0.05) AS is_validation FROM r")
def tail_split(spark, sf_dir):
    return ordinals.tail_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n <= 3")
def first_by_category(spark, sf_dir):
    return ordinals.first_by_category(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], 3, "doc_id")


# -- logs

EVENTS = ("event_type", "ts", "event_id")
SEC = "(date_diff('microsecond', {}, {}) / 1e6)"


@query(f"""WITH l AS (SELECT event_id, ts, lag(ts, 20) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM events)
SELECT event_id, round(CASE WHEN {SEC.format('b', 'ts')} > 0 THEN 20 / ({SEC.format('b', 'ts')} / 60) ELSE 'inf'::DOUBLE END, 6) AS rate FROM l WHERE b IS NOT NULL""")
def rollout_rate(spark, sf_dir):
    return rollout.completion_rate(table(spark, sf_dir, "events"), *EVENTS).select("event_id", F.round("rate", 6).alias("rate"))


@query(f"""SELECT event_id, round({SEC.format('lag(ts) OVER w', 'ts')}, 6) AS delta_seconds, round({SEC.format('first_value(ts) OVER w', 'ts')} / 60, 4) AS elapsed_minutes, row_number() OVER w AS completed
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def inter_arrival(spark, sf_dir):
    made = rollout.inter_arrival(table(spark, sf_dir, "events"), *EVENTS)
    return made.select("event_id", F.round("delta_seconds", 6).alias("delta_seconds"), F.round("elapsed_minutes", 4).alias("elapsed_minutes"), F.col("completed").cast("long").alias("completed"))


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, greatest(count(*) OVER (PARTITION BY event_type) // 10, 1) AS s FROM events),
b AS (SELECT event_type, i // s AS bucket, count(*) AS n, {SEC.format('min(ts)', 'max(ts)')} / 60 AS m, avg(value) AS v FROM r GROUP BY ALL)
SELECT event_type, bucket, n, round(m, 6) AS minutes, round(CASE WHEN m > 0 THEN n / m ELSE 'inf'::DOUBLE END, 6) AS rate, round(v, 6) AS avg_value FROM b""")
def decile_buckets(spark, sf_dir):
    b = rollout.ordinal_buckets(table(spark, sf_dir, "events"), *EVENTS, ("value",))
    return b.select("event_type", "bucket", "n", *(F.round(c, 6).alias(c) for c in ("minutes", "rate", "avg_value")))


SESSION_SQL = f"""g AS (SELECT *, coalesce({SEC.format('lag(ts) OVER w', 'ts')} > 30, FALSE)::INT AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS batch FROM g)"""


@query(f"WITH {SESSION_SQL} SELECT event_id, batch FROM s")
def gap_sessions(spark, sf_dir):
    return rollout.gap_sessions(table(spark, sf_dir, "events"), *EVENTS).select("event_id", F.col("batch").cast("long").alias("batch"))


FACTS_SQL = f"""{SESSION_SQL}, b AS (SELECT event_type, batch, count(*) AS size, min(ts) AS f, max(ts) AS l, max(user_id) AS max_length, avg(value) AS v FROM s GROUP BY ALL),
d AS (SELECT *, {SEC.format('coalesce(lag(l) OVER (PARTITION BY event_type ORDER BY batch), f)', 'l')} AS duration FROM b),
t AS (SELECT *, CASE WHEN duration > 0 THEN max_length / 4.5::DOUBLE / duration ELSE 'inf'::DOUBLE END AS tps FROM d)"""


@query(f"WITH {FACTS_SQL} SELECT event_type, batch, size, round(duration, 6) AS duration, max_length, round(tps, 6) AS tokens_per_second, round(v, 6) AS avg_value, duration > 300 AS is_slow, tps < 5 AS is_anomalous FROM t")
def batch_facts(spark, sf_dir):
    f = rollout.batch_facts(table(spark, sf_dir, "events"), *EVENTS, "user_id", "value")
    return f.select("event_type", F.col("batch").cast("long").alias("batch"), "size", F.round("duration", 6).alias("duration"), "max_length", F.round("tokens_per_second", 6).alias("tokens_per_second"), F.round("avg_value", 6).alias("avg_value"), "is_slow", "is_anomalous")


@query(f"""WITH {FACTS_SQL} SELECT event_type, count(*) AS batches, round(quantile_cont(duration, 0.5), 6) AS median_duration, round(avg(duration), 6) AS mean_duration, round(max(duration), 6) AS max_duration, count(*) FILTER (duration > 300) AS slow, count(*) FILTER (tps < 5) AS anomalous,
round(100 * coalesce(sum(duration) FILTER (duration > 300), 0) / sum(duration), 6) AS slow_percent, round(100 * coalesce(sum(duration) FILTER (tps < 5), 0) / sum(duration), 6) AS anomalous_percent FROM t GROUP BY event_type""")
def batch_summary(spark, sf_dir):
    s = rollout.batch_summary(rollout.batch_facts(table(spark, sf_dir, "events"), *EVENTS, "user_id", "value"), "event_type")
    return s.withColumns({c: F.round(c, 6) for c in ("median_duration", "mean_duration", "max_duration", "slow_percent", "anomalous_percent")})


@query("SELECT event_id, round(median(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), 6) AS rolling_median FROM events")
def rolling_median(spark, sf_dir):
    return rollout.rolling_median(table(spark, sf_dir, "events"), *EVENTS, "value").select("event_id", F.round("rolling_median", 6).alias("rolling_median"))


@query("SELECT event_id, m AS moving_average FROM (SELECT event_id, round(avg(value) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS m, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) WHERE n >= 20")
def moving_average(spark, sf_dir):
    return rollout.moving_average(table(spark, sf_dir, "events"), *EVENTS, "value").select("event_id", F.round("moving_average", 6).alias("moving_average"))


@query(f"""WITH l AS (SELECT event_type, event_id, ts, lag(ts, 20) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM events),
r AS (SELECT event_type, 20 / ({SEC.format('b', 'ts')} / 60) AS rate, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM l WHERE b IS NOT NULL),
h AS (SELECT *, avg(CASE WHEN i < greatest(n // 10, 1) THEN rate END) OVER (PARTITION BY event_type) AS base FROM r)
SELECT event_type, min(CASE WHEN rate < 0.3 * base THEN i END) AS onset FROM h GROUP BY event_type""")
def slowdown_onset(spark, sf_dir):
    return rollout.slowdown_onset(rollout.completion_rate(table(spark, sf_dir, "events"), *EVENTS), *EVENTS)


@query("SELECT source, count(*) FILTER (n_chars > 30000) AS over_30k, count(*) FILTER (n_chars > 50000) AS over_50k FROM documents GROUP BY source")
def long_rows(spark, sf_dir):
    return rollout.long_rows(table(spark, sf_dir, "documents"), "source", "n_chars")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, i AS place, value FROM r WHERE n >= 6 AND i IN (0, 1, n // 4, n // 2, 3 * n // 4, n - 2, n - 1)""")
def trajectory(spark, sf_dir):
    return rollout.trajectory(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value")


@query("SELECT event_type, count(value) AS points, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY event_type")
def series_summary(spark, sf_dir):
    return rollout.first_to_last(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
q AS (SELECT user_id, avg(value) FILTER (i < n // 4) AS a, avg(value) FILTER (i >= n - ceil(n / 4)) AS b FROM r WHERE n >= 20 GROUP BY user_id)
SELECT user_id, round(a, 6) AS first_quarter, round(b, 6) AS last_quarter, round(b - a, 6) AS delta, CASE WHEN abs(b - a) < 0.02 THEN 'flat' WHEN b > a THEN 'up' ELSE 'down' END AS trend FROM q""")
def trend_quartile(spark, sf_dir):
    t = rollout.quartile_trend(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return t.withColumns({c: F.round(c, 6) for c in ("first_quarter", "last_quarter", "delta")})


@query("""WITH r AS (SELECT 'm' || (user_id % 5)::VARCHAR AS series, event_type AS temperature, avg(value) AS "Acc" FROM events GROUP BY user_id, event_type)
SELECT series, temperature, count(*) AS run_count, round(avg("Acc"), 6) AS "Acc_mean", round(max("Acc"), 6) AS "Acc_max", round(min("Acc"), 6) AS "Acc_min", round(max("Acc") - min("Acc"), 6) AS "Acc_max_spread" FROM r GROUP BY series, temperature""")
def series_aggregate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("temperature")).agg(F.avg("value").alias("Acc"))
    rows = rows.select(F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string"), F.lit("_run"), "user_id").alias("run"), "temperature", "Acc")
    return runs.by_series(rows, ("Acc",)).drop("runs").withColumns({f"Acc_{k}": F.round(f"Acc_{k}", 6) for k in ("mean", "max", "min", "max_spread")})


@query(f"WITH {SESSION_SQL} SELECT event_type, count(*) AS size, max(user_id) AS max_length, round(avg(value), 6) AS avg_value, min(ts) AS started FROM s GROUP BY event_type, batch")
def stream_sessions(spark, sf_dir):
    found = sessions(table(spark, sf_dir, "events"), "event_type", "ts", "user_id", "value")
    return found.select("event_type", "size", "max_length", F.round("avg_value", 6).alias("avg_value"), F.col("session.start").alias("started"))


# -- code pairs (no SQL has the sequence matcher)


@query()
def line_diff(spark, sf_dir):
    rows = code_pairs(spark, sf_dir)
    d = changed_lines(F.col("vuln_func"), F.col("patched_func"))
    return rows.select("pair_id", d.alias("d")).select("pair_id", F.transform("d.deleted", lambda c: c["line_no"]).alias("deleted"), F.transform("d.added", lambda c: c["line_no"]).alias("added"))


@query()
def code_similarity(spark, sf_dir):
    rows = code_pairs(spark, sf_dir)
    return rows.select("pair_id", similarity(F.col("vuln_func"), F.col("patched_func")).alias("ratio"), normalized_diff(F.col("vuln_func"), F.col("patched_func")).alias("d")).select("pair_id", "ratio", "d.*")


@query()
def greedy_pairing(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "text", F.when(F.col("role") == "user", 1).otherwise(0).alias("label"), F.col("turn").cast("long").alias("turn"))
    return pairing.similarity_pairs(rows, ["conv_id"], "text", "label", "turn")


@query()
def conflict_collapse(spark, sf_dir):
    return dedup.deduplicate(code_pairs(spark, sf_dir)).select("pair_id", "vuln_hash", "source", "cve", "cve_desc", "commit_message")


@query(r"""WITH t AS (SELECT a.conv_id, a.turn, a.text AS code, regexp_split_to_array(a.text, '\n') AS p FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
n AS (SELECT *, CASE WHEN p[-1] = '' THEN len(p) - 1 ELSE len(p) END AS k FROM t)
SELECT 'p_' || conv_id::VARCHAR || '_' || turn::VARCHAR AS pair_id, 'deleted_lines' AS field, greatest(k, 1) AS line_no, 'oob' AS type FROM n WHERE code <> '' AND greatest(k, 1) > k""")
def line_verify(spark, sf_dir):
    return audit.line_issues(code_pairs(spark, sf_dir)).filter("field = 'deleted_lines'").select("pair_id", "field", F.col("line_no").cast("long").alias("line_no"), "type")


@query(f"""WITH {PARSED_SQL} SELECT CASE WHEN k = 0 THEN 'no_response' WHEN k IN (1, 2, 3) OR classification IS NULL THEN 'incomplete' END AS reason, count(*) AS n FROM r GROUP BY ALL""")
def sft_filter_reasons(spark, sf_dir):
    rows = answers(spark, sf_dir).withColumn("p", R.parse(F.col("response"))).select(F.col("response").alias("generated_response"), F.col("p.classification").alias("parsed_classification"))
    return sft_reasons(rows, None).groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT 'p' || lpad((doc_id // 2)::VARCHAR, 9, '0') AS pair_id, doc_id % 2 = 0 AS v, CASE WHEN doc_id % 2 = 0 THEN doc_id % 4 + 1 ELSE 0 END AS k FROM documents),
c AS (SELECT *, (SELECT ceil(quantile_cont(k, 0.5)) FROM s WHERE k > 0) AS t, row_number() OVER (ORDER BY pair_id, v DESC) - 1 AS idx, count(*) OVER () AS n FROM s)
SELECT pair_id, idx, v AS is_vulnerable, '{"is_vulnerable": ' || v::VARCHAR || ', "ground_truth_lines": [' || CASE WHEN k > t THEN '' ELSE array_to_string(range(1, k + 1), ', ') END || ']}' AS ground_truth, idx >= n - floor(n * 0.05) AS is_validation FROM c""")
def rl_dataset(spark, sf_dir):
    d = F.col("doc_id")
    rows = answers(spark, sf_dir).select(F.concat(F.lit("p"), F.lpad(F.floor(d / 2).cast("string"), 9, "0")).alias("pair_id"), F.lit("c").alias("commit_id"), "is_vulnerable", F.col("truth").alias("ground_truth_lines"), F.lit("code").alias("prompt"))
    made = rl_rows(rows.withColumn("ground_truth_lines", F.when(F.col("is_vulnerable"), F.col("ground_truth_lines")).otherwise(F.array().cast("array<int>"))), percentile=50)
    return made.select("extra_info.pair_id", "extra_info.idx", "extra_info.is_vulnerable", "reward_model.ground_truth", "is_validation")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools, deduplicates and enriches the test tables' code pairs, and reports their coverage."""
    rows = code_pairs(spark, sf_dir)
    kept = pairing.without_no_ops(pooling.enrich(dedup.deduplicate(rows), pooling.pool(rows)))
    return audit.pair_report(kept)


@query()
def merged_pairs(spark, sf_dir):
    return flagship(spark, sf_dir)
