"""Queries whose rows are made so that SQL can tell the outcome of what has no SQL of its own: similarity, diffs, collapses, repairs, loaders.

Texts come from the documents' first lines; what is added to them decides how they are alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import prompts as P
from ..functions import responses as R
from ..functions import text as X
from ..functions.diff import changed_lines, changed_lines_text, normalized_diff, similarity
from ..operators import audit, dedup, metrics, ordinals, pairing
from ..schemas import A, C, kind
from ..sources import readers, sinks
from ..sources.named import write_named
from ..streaming.logs import completion_log, drain, sessions
from .catalog import NORMAL_SQL, PARSED_SQL, SESSION_SQL, answers, query, table
from .datasets import sft_rows
from .pipelines import LINES_SQL, NUMBERED_SQL, SPLIT_SQL, scratch

NORMAL = NORMAL_SQL.replace("(text,", "({0},")
CHANGE = kind("array<struct<line_no:int,char_start:int,char_end:int,text:string>>")
#: The first line of a text, without the letters that are put behind it.
FIRST_SQL = r"left(trim(regexp_replace(regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '[^ -~]', '', 'g'), '[ZQzq]', '', 'g')), 40)"


def first_lines(spark, sf_dir):
    """(doc_id, x): the first 40 ASCII characters of each text's first line, without Z and Q."""
    line = F.regexp_replace(F.regexp_replace(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), "[^ -~]", ""), "[ZQzq]", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.left(F.trim(line), F.lit(40)).alias("x"))


def changes(*items):
    """An array of line changes of (number, text)."""
    return F.array(*(F.struct(n.cast("int").alias("line_no"), F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"), text.alias("text")) for n, text in items)).cast(CHANGE)


# -- diffs and similarity


@query(f"""WITH f AS (SELECT doc_id, trim({FIRST_SQL}) AS x, doc_id % 7 AS m, doc_id % 5 AS k FROM documents), n AS (SELECT *, length(x) AS l FROM f),
h AS (SELECT *, CASE WHEN l + m > 0 THEN 5 + l + m ELSE 4 END + 5 AS a, CASE WHEN l + k > 0 THEN 5 + l + k ELSE 4 END + 5 AS b FROM n)
SELECT doc_id, round(CASE WHEN l + l + m + k = 0 THEN 1.0 ELSE 2 * l / (2 * l + m + k) END::DOUBLE, 9) AS ratio, CASE WHEN m + k > 0 THEN '2' ELSE '' END AS deleted, CASE WHEN m + k > 0 THEN '2' ELSE '' END AS added, CASE WHEN m + k > 0 THEN 'Lines: 2' END AS told,
  CASE WHEN m + k = 0 OR l + k = 0 THEN 0 ELSE 1 END AS n_added, CASE WHEN m + k = 0 OR l + m = 0 THEN 0 ELSE 1 END AS n_removed,
  round(CASE WHEN m + k = 0 THEN 1.0 ELSE 2 * (5 + l + 5 - (CASE WHEN l + least(m, k) = 0 THEN 1 ELSE 0 END)) / (a + b) END::DOUBLE, 9) AS alike FROM h""")
def known_diffs(spark, sf_dir):
    """Texts that are alike but for what stands behind them: the ratio, the changed lines, and the normalised diff follow from lengths."""
    d = F.col("doc_id")
    rows = first_lines(spark, sf_dir).withColumn("x", F.trim("x")).withColumn("a", F.concat("x", F.repeat(F.lit("Z"), (d % 7).cast("int")))).withColumn("b", F.concat("x", F.repeat(F.lit("Q"), (d % 5).cast("int"))))
    old, new = (F.concat(F.lit("head\n"), F.col(c), F.lit("\ntail")) for c in ("a", "b"))
    made = rows.withColumns({"old": old, "new": new}).withColumn("c", changed_lines(F.col("old"), F.col("new"))).withColumn("n", normalized_diff(F.col("old"), F.col("new")))
    numbers = lambda side: F.array_join(F.transform(f"c.{side}", lambda x: x["line_no"].cast("string")), ",")
    return made.select(
        "doc_id", F.round(similarity(F.col("a"), F.col("b")), 9).alias("ratio"), numbers("deleted").alias("deleted"), numbers("added").alias("added"), changed_lines_text(F.col("new"), F.col("old")).alias("told"),
        F.col("n.added").alias("n_added"), F.col("n.removed").alias("n_removed"), F.round("n.similarity", 9).alias("alike"),
    )


# -- loaders, collapses, statistics

_FUNC_SQL = "'int f' || doc_id::VARCHAR || '(int a) {{' || chr(10) || {0} || chr(10) || '}}'"


@query(f"""WITH x AS (SELECT doc_id, {FIRST_SQL} AS x FROM documents WHERE doc_id % 3 <> 2),
p AS (SELECT doc_id, 0 AS k, {_FUNC_SQL.format("'a: ' || x")} AS v, {_FUNC_SQL.format("'b: ' || x || ';'")} AS p, x FROM x UNION ALL SELECT doc_id, 1, {_FUNC_SQL.format("repeat('q', 40)")}, {_FUNC_SQL.format("repeat('q', 40)")}, x FROM x WHERE doc_id % 5 = 0),
h AS (SELECT *, sha256({NORMAL.format('v')}) AS h FROM p)
SELECT '{A}_proj_k' || doc_id::VARCHAR || '_f' || doc_id::VARCHAR || '_' || h AS pair_id, doc_id * 4 + 2 * k AS source_row_idx, 'f' || doc_id::VARCHAR AS func_name, CASE doc_id % 2 WHEN 0 THEN 'CWE-1,CWE-2' ELSE 'CWE-9' END AS cwe,
  CASE doc_id % 4 WHEN 0 THEN '' ELSE 'CVE-' || doc_id::VARCHAR END AS cve, CASE WHEN doc_id % 6 = 0 THEN '' ELSE ' why ' END AS commit_message, CASE k WHEN 0 THEN '2:a: ' || x ELSE '' END AS deleted, CASE k WHEN 0 THEN '2:b: ' || x || ';' ELSE '' END AS added, length(p) AS after FROM h""")
def loader_a(spark, sf_dir):
    """Functions of one commit and name: the first old one finds the new one that is most like it, the second its equal; commits of one label go."""
    d, x = F.col("doc_id"), F.col("x")
    body = lambda text: F.concat(F.lit("int f"), d.cast("string"), F.lit("(int a) {\n"), text, F.lit("\n}"))
    other = F.repeat(F.lit("q"), F.lit(40))
    each = lambda k, target, text: F.struct((d * 4 + k).alias("idx"), F.lit(target).alias("target"), body(text).alias("func"))
    one, two = [each(0, 1, F.concat(F.lit("a: "), x)), each(1, 0, F.concat(F.lit("b: "), x, F.lit(";")))], [each(2, 1, other), each(3, 0, other)]
    rows = first_lines(spark, sf_dir).select(d, F.inline(F.when(d % 3 == 2, F.array(one[0], two[0])).when(d % 5 == 0, F.array(*one, *two)).otherwise(F.array(*one))))
    made = pairing.pairs_a(
        rows.select(
            F.concat(F.lit("k"), d).alias("commit_id"), "target", "func", F.lit("proj").alias("project"), F.lit("u").alias("project_url"), F.lit("x.c").alias("file_name"), F.when(d % 6 == 0, " None ").otherwise(" why ").alias("commit_message"),
            F.when(d % 4 == 0, "none").otherwise(F.concat(F.lit("CVE-"), d)).alias("cve"), F.lit(None).cast("string").alias("cve_desc"), F.when(d % 2 == 0, '["CWE-1", "None", " CWE-2"]').otherwise("CWE-9").alias("cwe"), "idx",
        ), ordinal="idx",
    )
    shown = lambda c: F.array_join(F.transform(c, lambda l: F.concat_ws(":", l["line_no"].cast("string"), l["text"])), ",")
    return made.select("pair_id", "source_row_idx", "func_name", F.array_join("cwe", ",").alias("cwe"), F.array_join("cve", ",").alias("cve"), "commit_message", shown("deleted_lines").alias("deleted"), shown("added_lines").alias("added"), F.length("patched_func").cast("long").alias("after"))


def variants(spark, sf_dir):
    """Variants of one function for each document: the text, the text with a line more, the same in another file, and a copy of the first."""
    d, x = F.col("doc_id"), F.concat(F.lit("start "), F.col("x"))
    none = F.array().cast("array<string>")
    one = lambda k, source, code, path, cve, desc, message: F.struct(F.lit(k).alias("k"), F.lit(source).alias("source"), code.alias("vuln_func"), F.lit(path).alias("filepath"), cve.alias("cve"), desc.alias("cve_desc"), F.lit(message).alias("commit_message"))
    nothing, longer = F.lit(None).cast("string"), F.concat(x, F.lit("\nand more;"))
    all_of = [
        one(0, A, x, "d/a.c", F.array(F.lit("CVE-1")), F.lit("about it"), "m"), one(1, C, longer, "d/a.c", none, nothing, "longer"),
        one(2, A, F.concat(F.lit("other "), x), "e/b.c", none, nothing, ""), one(3, C, x, "d/a.c", none, nothing, "copy"),
    ]
    rows = first_lines(spark, sf_dir).select(d, F.inline(F.when(d % 4 == 0, F.array(all_of[0], all_of[3])).when(d % 4 == 1, F.array(*all_of[:2])).when(d % 4 == 2, F.array(*all_of[:3])).otherwise(F.array(*all_of))))
    return rows.select(
        "source", F.concat_ws("_", F.lit("v"), d, "k").alias("pair_id"), F.concat(F.lit("K"), d).alias("commit_id"), F.lit("proj").alias("project"), F.lit(None).cast("string").alias("project_url"), F.lit("f").alias("func_name"), "filepath",
        X.code_hash(F.col("vuln_func")).alias("vuln_hash"), "vuln_func", F.lit("fixed").alias("patched_func"), "cve", none.alias("cwe"), "cve_desc", "commit_message", F.array().cast(CHANGE).alias("deleted_lines"), F.array().cast(CHANGE).alias("added_lines"),
        (d * 4 + F.col("k")).alias("source_row_idx"), (d * 4 + F.col("k")).alias("ordinal"),
    )


@query(f"""WITH x AS (SELECT doc_id, doc_id % 4 AS k, 'start ' || {FIRST_SQL} AS x FROM documents)
SELECT 'v_' || doc_id::VARCHAR || CASE k WHEN 0 THEN '_3' ELSE '_1' END AS pair_id, '{C}' AS source, 'CVE-1' AS cve, 'about it' AS cve_desc, CASE k WHEN 0 THEN 'copy' ELSE 'longer' END AS commit_message, length(x) + CASE k WHEN 0 THEN 0 ELSE 10 END AS size FROM x
UNION ALL SELECT 'v_' || doc_id::VARCHAR || '_2', '{A}', 'CVE-1', 'about it', '', length(x) + 6 FROM x WHERE k > 1""")
def known_collapses(spark, sf_dir):
    """Equal texts are one, the longer of two stays with what the other knows, another file stays and shares what is known."""
    made = dedup.deduplicate(variants(spark, sf_dir))
    return made.select("pair_id", "source", F.array_join("cve", ",").alias("cve"), "cve_desc", "commit_message", F.length("vuln_func").cast("long").alias("size"))


@query("""WITH c AS (SELECT doc_id % 4 AS k FROM documents)
SELECT statistic, sum(n)::BIGINT AS n FROM (SELECT 'same_hash_dedup' AS statistic, CASE WHEN k = 0 THEN 1 END AS n FROM c UNION ALL SELECT 'conflicts_collapsed', CASE WHEN k > 0 THEN 1 END FROM c UNION ALL SELECT 'conflicts_kept_both', CASE WHEN k > 1 THEN 2 WHEN k = 1 THEN 1 END FROM c) WHERE n IS NOT NULL GROUP BY statistic""")
def collapse_statistics(spark, sf_dir):
    return dedup.deduplication_statistics(variants(spark, sf_dir))


@query(f"""WITH x AS (SELECT doc_id, 'at ' || {FIRST_SQL} AS x FROM documents), k AS (SELECT *, doc_id % 5 AS k FROM x)
SELECT doc_id * 2 AS idx, CASE k WHEN 0 THEN 'native' WHEN 1 THEN 'text_reindex' WHEN 2 THEN 'text_reindex' WHEN 3 THEN 'difflib' ELSE 'difflib' END AS reindex_method,
  CASE k WHEN 0 THEN '2:' || trim(x) WHEN 1 THEN '2:' || trim(x) WHEN 2 THEN '3:same,4:same' ELSE '2:' || x END AS deleted, 'difflib' AS added_method FROM k""")
def repaired_lines(spark, sf_dir):
    """Line changes that fit, are found by their text (one line, or as many lines as changes), or come from a diff as the text is nowhere or none is given."""
    d, x = F.col("doc_id"), F.concat(F.lit("at "), F.col("x"))
    line = X.strip(x)
    given = lambda *items: F.to_json(F.array(*(F.array(F.lit(str(n)), text) for n, text in items)))
    said = F.when(d % 5 == 0, given((2, line))).when(d % 5 == 1, given((90, line))).when(d % 5 == 2, given((70, F.lit("same")), (1, F.lit("same")))).when(d % 5 == 3, given((1, F.lit("nowhere")))).otherwise("[]")
    code, fixed = F.concat(F.lit("f() {\n"), x, F.lit("\nsame\nsame\n}")), F.lit("f() {\nnew line\nsame\nsame\n}")
    each = F.array(
        F.struct((d * 2).alias("idx"), F.lit(True).alias("is_vulnerable"), (d * 2 + 1).cast("double").alias("fixed_func_idx"), said.alias("changed_lines"), code.alias("func_body")),
        F.struct((d * 2 + 1).alias("idx"), F.lit(False).alias("is_vulnerable"), F.lit(None).cast("double").alias("fixed_func_idx"), F.lit(None).cast("string").alias("changed_lines"), fixed.alias("func_body")),
    )
    empty, text = F.array().cast("array<string>"), F.lit(None).cast("string")
    rows = first_lines(spark, sf_dir).select(d, "x").select(F.inline(each)).select(
        "*", F.lit("f").alias("func_name"), F.lit("x.c").alias("filepath"), F.lit("p").alias("project"), text.alias("project_url"), F.lit("K").alias("commit_id"), empty.alias("cve_list"), empty.alias("cwe_list"), F.struct(empty.alias("Explanation")).alias("context"), text.alias("commit_message"), F.lit("file").alias("_file"),
    )
    made = pairing.pairs_c(rows)
    shown = F.array_join(F.transform("deleted_lines", lambda l: F.concat_ws(":", l["line_no"].cast("string"), l["text"])), ",")
    return made.select(F.col("source_row_idx").alias("idx"), "reindex_method", shown.alias("deleted"), "added_method")


@query("""WITH k AS (SELECT CASE doc_id % 5 WHEN 0 THEN 'native' WHEN 1 THEN 'text_reindex' WHEN 2 THEN 'text_reindex' ELSE 'difflib' END AS m FROM documents)
SELECT 'deleted' AS side, m AS method, count(*) AS n FROM k GROUP BY m UNION ALL SELECT 'added', 'difflib', count(*) FROM k""")
def repair_statistics(spark, sf_dir):
    made = repaired_lines(spark, sf_dir)
    return pairing.reindex_statistics(made)


# -- line issues

_ISSUES_SQL = f"""n AS (SELECT doc_id, text, {LINES_SQL.format('s')} AS l FROM (SELECT doc_id, text, {SPLIT_SQL.format('text')} AS s FROM documents WHERE coalesce(text, '') <> '')),
c AS (SELECT *, regexp_replace(coalesce(l[1], ''), '^\\s+|\\s+$', '', 'g') AS first FROM n),
i AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'primevul' ELSE 'sven' END AS source, 'deleted_lines' AS field, CASE doc_id % 4 WHEN 1 THEN len(l) + 3 WHEN 3 THEN 0 ELSE 1 END AS line_no,
    CASE WHEN doc_id % 4 IN (1, 3) OR len(l) < 1 THEN 'oob' WHEN doc_id % 4 = 2 AND first <> '' AND NOT contains('~no such line~', first) THEN 'misindexed' END AS type FROM c
  UNION ALL SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'primevul' ELSE 'sven' END, 'added_lines', CASE WHEN doc_id % 3 = 0 THEN len(l) + 9 ELSE 1 END, CASE WHEN doc_id % 3 = 0 OR len(l) < 1 THEN 'oob' END FROM c)"""


def spoilt_pairs(spark, sf_dir):
    """Pairs of documents' texts with line changes that fit, lie outside, or have another text than their line."""
    d, code = F.col("doc_id"), F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", code.alias("code")).withColumn("size", F.size(X.lines(F.col("code"))))
    first = X.strip(F.coalesce(F.get(X.lines(F.col("code")), F.lit(0)), F.lit("")))
    deleted = F.when(d % 4 == 1, changes((F.col("size") + 3, F.lit("x")))).when(d % 4 == 3, changes((F.lit(0), F.lit("")))).when(d % 4 == 2, changes((F.lit(1), F.lit("~no such line~")))).otherwise(changes((F.lit(1), first)))
    added = F.when(d % 3 == 0, changes((F.col("size") + 9, first))).otherwise(changes((F.lit(1), F.left(first, F.lit(5)))))
    return rows.select(F.concat(F.lit("p"), d).alias("pair_id"), F.when(d % 3 == 0, "primevul").otherwise("sven").alias("source"), F.lit("k").alias("commit_id"), F.col("code").alias("vuln_func"), F.col("code").alias("patched_func"), deleted.alias("deleted_lines"), added.alias("added_lines"))


@query(f"WITH {_ISSUES_SQL} SELECT 'p' || doc_id::VARCHAR AS pair_id, field, line_no, type FROM i WHERE type IS NOT NULL")
def line_issues_found(spark, sf_dir):
    return audit.line_issues(spoilt_pairs(spark, sf_dir)).select("pair_id", "field", F.col("line_no").cast("long").alias("line_no"), "type")


@query(f"WITH {_ISSUES_SQL} SELECT source, type, count(*) AS n, count(DISTINCT doc_id) AS pairs FROM i WHERE type IS NOT NULL GROUP BY ALL")
def issue_totals(spark, sf_dir):
    return audit.issue_counts(audit.line_issues(spoilt_pairs(spark, sf_dir)))


# -- prompts


@query(f"""WITH n AS (SELECT doc_id, coalesce(text, '') AS t, {LINES_SQL.format('s')} AS l FROM (SELECT doc_id, text, {SPLIT_SQL.format("coalesce(text, '')")} AS s FROM documents))
SELECT doc_id, md5('Please analyze the following code snippet:' || chr(10) || chr(10) || '```' || chr(10) || CASE WHEN len(l) > 20 THEN {NUMBERED_SQL.format('l')} ELSE t END || chr(10) || '```' || chr(10) || chr(10)
  || CASE WHEN doc_id % 3 = 0 THEN 'The associated CVE description is: about ' || doc_id::VARCHAR || chr(10) || chr(10) ELSE '' END
  || 'Hint: According to the ground truth, this code snippet is considered ' || CASE WHEN doc_id % 2 = 0 THEN 'vulnerable' ELSE 'not vulnerable' END || '.' || chr(10)
  || CASE WHEN doc_id % 2 = 1 THEN 'This code snippet is the non-vulnerable version.' || chr(10) WHEN doc_id % 4 = 0 THEN '{P.VULNERABLE_LINES}' || '1, 2.' || chr(10) ELSE '' END || chr(10) || 'Task: {P.YES_NO_TASK.replace("'", "''")}') AS prompt_md5 FROM n""")
def first_generation_prompts(spark, sf_dir):
    d = F.col("doc_id")
    prompt = P.first_generation_prompt(F.coalesce("text", F.lit("")), F.when(d % 3 == 0, F.concat(F.lit(" about "), d.cast("string"))).when(d % 3 == 1, "N/A"), d % 2 == 0, F.when(d % 4 == 0, "1, 2").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(prompt.cast("binary")).alias("prompt_md5"))


_ROOM = P.CAPACITY - P.RESERVED
_WORDS_SQL = r"regexp_split_to_array(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+')"


@query(f"""WITH m AS (SELECT doc_id, trim(repeat('word ' || doc_id::VARCHAR || ' ', CASE WHEN doc_id % 50 = 0 THEN 14400 ELSE 5 END::INT)) AS message, {FIRST_SQL} AS x FROM documents),
s AS (SELECT doc_id, message, unnest([TRUE, FALSE]) AS is_vulnerable, unnest(['a ' || x, 'b']) AS code FROM m),
h AS (SELECT *, '{P.OPENING}' || chr(10) || chr(10) || '{P.ANALYZE}' || chr(10) || chr(10) || '```' || chr(10) || '1: ' || code || chr(10) || '```' || chr(10) || chr(10) AS head, CASE WHEN is_vulnerable THEN '{P.VULNERABLE_HINT}' ELSE '{P.PATCHED_HINT}' END || chr(10) || chr(10) || '{P.TASK}' AS tail FROM s),
b AS (SELECT *, len({_WORDS_SQL.format("(head || tail)")}) AS base, len(string_split(message, ' ')) AS n FROM h),
c AS (SELECT *, CASE WHEN base + 4 + n <= {_ROOM} THEN message ELSE array_to_string(string_split(message, ' ')[1:{_ROOM} - base], ' ') || '...' END AS words FROM b),
p AS (SELECT doc_id, is_vulnerable, head || 'Context:' || chr(10) || '- Commit message: ' || words || chr(10) || chr(10) || tail AS prompt, base + 4 + least(n, CASE WHEN base + 4 + n <= {_ROOM} THEN n ELSE {_ROOM} - base END) AS tokens FROM c)
SELECT doc_id, is_vulnerable, md5(prompt) AS prompt_md5, tokens AS prompt_tokens, least({P.CAPACITY}, {P.CAPACITY} - tokens) AS api_max_tokens FROM p""")
def cut_messages(spark, sf_dir):
    """Commit messages that are longer than the room that a prompt leaves are cut to it."""
    d, none = F.col("doc_id"), F.array().cast("array<string>")
    message = F.trim(F.repeat(F.concat(F.lit("word "), d.cast("string"), F.lit(" ")), F.when(d % 50 == 0, 14400).otherwise(5)))
    rows = first_lines(spark, sf_dir).select(d, F.concat(F.lit("a "), F.col("x")).alias("vuln_func"), F.lit("b").alias("patched_func"), none.alias("cve"), none.alias("cwe"), F.lit(None).cast("string").alias("cve_desc"), message.alias("commit_message"), F.array().cast(CHANGE).alias("deleted_lines"), F.array().cast(CHANGE).alias("added_lines"))
    return P.requests(rows).select("doc_id", "is_vulnerable", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), F.col("prompt_tokens").cast("long").alias("prompt_tokens"), F.col("api_max_tokens").cast("long").alias("api_max_tokens"))


# -- orders, reports, files, streams


@query("SELECT doc_id, place FROM (SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN lower(trim(coalesce(source, ''))) IN ('src1', 'src2') THEN 0 ELSE 1 END, doc_id) AS place FROM documents)")
def described_come_first(spark, sf_dir):
    """All rows in the order that puts the described ones first, with their places as written."""
    path = scratch(spark, "ordered")
    flag = F.coalesce(F.col("source").isin("src1", "src2"), F.lit(False))
    ordinals.described_first(table(spark, sf_dir, "documents").select("doc_id", "source"), flag, "doc_id").write.parquet(path)
    back = spark.read.parquet(path).withColumn("_f", F.col("_metadata.file_name")).withColumn("_r", F.col("_metadata.row_index"))
    return ordinals.with_ordinal(back, "_f", "_r", name="place").select("doc_id", (F.col("place") + 1).alias("place"))


@query("""WITH r AS (SELECT coalesce(lang, '') AS lang, count(*) AS n, avg(n_chars) AS mean FROM documents GROUP BY 1)
SELECT '| lang | n | mean |' || chr(10) || '| - | - | - |' || chr(10) || string_agg('| ' || lang || ' | ' || n::VARCHAR || ' | ' || printf('%.4f', mean) || ' |', chr(10) ORDER BY lang) AS report FROM r""")
def markdown_report(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean")).orderBy("lang")
    return spark.createDataFrame([(sinks.markdown_table(rows),)], "report string")


@query(f"WITH {PARSED_SQL} SELECT doc_id, status FROM r WHERE status NOT IN ('VALID', 'SKIPPED')")
def not_valid_columns(spark, sf_dir):
    """The extraction of chosen columns, without the skipped rows."""
    path = scratch(spark, "columns")
    parsed = answers(spark, sf_dir).withColumn("_p", R.parse(F.col("response"))).select("doc_id", "response", "_p.*", F.col("doc_id").alias("_line_number"))
    sinks.write_not_valid(parsed, path, columns=("doc_id", "response"), also_skipped=False)
    return spark.read.schema("doc_id long, status string").json(path)


@query("""WITH f AS (SELECT coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, count(*) AS n, count(*) FILTER (n_chars > 1000) / count(*) AS acc FROM documents GROUP BY ALL)
SELECT CASE WHEN n % 2 = 0 THEN 'sft_' ELSE 'grpo_' END || lang || '_' || source AS run, CASE WHEN lang = 'en' THEN 'default' ELSE 'temp0p2' END AS temperature, round(acc, 9) AS accuracy FROM f WHERE source LIKE '%1%' AND source <> 'src13'""")
def metric_documents_read(spark, sf_dir):
    """Metric documents of runs, written by name into folders, read back by kind and by a filter of names; one can't be read, and other runs aren't asked for."""
    base = scratch(spark, "runs")
    facts = table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"), F.avg((F.col("n_chars") > 1000).cast("double")).alias("acc"))
    run = F.concat(F.when(F.col("n") % 2 == 0, "sft_").otherwise("grpo_"), "lang", F.lit("_"), "source")
    folder = F.when(F.col("lang") == "en", "/metrics").otherwise("/metrics_temp0p2")
    document = F.when(F.col("source") == "src13", '{"standard_metrics": {').otherwise(F.to_json(F.struct(F.struct(F.col("acc").alias("accuracy")).alias("standard_metrics"))))
    at = lambda run, folder: F.concat(run, folder, F.lit("/metrics_combined_training.json")).alias("name")
    files = facts.select(F.inline(F.array(F.struct(at(run, folder), document.alias("content")), F.struct(at(F.concat(F.lit("other_"), run), F.lit("/metrics")), F.lit("{}").alias("content")))))
    write_named(files, base)
    read = readers.metric_documents(spark, base, name_filter="1")
    return read.filter(~F.col("run").startswith("other")).select("run", "temperature", F.round("standard_metrics.accuracy", 9).alias("accuracy"))


@query("SELECT 'p' || lpad(doc_id::VARCHAR, 9, '0') AS pair_id FROM documents WHERE doc_id % 10 > 6 ORDER BY doc_id LIMIT 20")
def early_stop(spark, sf_dir):
    """The first rows of the SFT data in the order of their pairs."""
    rows = answers(spark, sf_dir).withColumn("p", R.parse(F.col("response"))).select(
        F.concat(F.lit("p"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("pair_id"), F.lit("k").alias("commit_id"), "is_vulnerable", F.lit("q").alias("prompt"), F.when(F.col("doc_id") % 10 > 6, F.col("response")).otherwise("").alias("generated_response"),
        F.col("truth").alias("ground_truth_lines"), F.col("p.classification").alias("parsed_classification"),
    )
    return sft_rows(rows, most=20).select("pair_id")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'training' WHEN 1 THEN 'unknown' END AS asked FROM documents WHERE doc_id % 3 < 2")
def prompt_types(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "training").when(F.col("doc_id") % 3 == 2, "std_cls").alias("prompt_type"))
    return metrics.of_prompt_type(rows, "training").select("doc_id", F.lit("training").alias("asked")).unionByName(metrics.of_prompt_type(rows, "unknown").select("doc_id", F.lit("unknown").alias("asked")))


@query(f"WITH {SESSION_SQL} SELECT event_type, count(*) AS size, max(user_id) AS max_length, round(avg(value), 6) AS avg_value, min(ts) AS started FROM s GROUP BY event_type, batch")
def sessions_of_a_stream(spark, sf_dir):
    """Sessions on a stream that is stopped after each third of the events; the watermark closes them."""
    log, out, mark = (scratch(spark, n) for n in ("log", "sessions", "mark"))
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "user_id", "value")
    part = F.least(F.floor((F.day("ts") - 1) / 10), F.lit(2))
    end = events.select("event_type").distinct().select(F.lit(None).cast("long").alias("event_id"), "event_type", F.lit("2200-01-01").cast(events.schema["ts"].dataType).alias("ts"), F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("double").alias("value"))
    for rows in (*(events.filter(part == k) for k in range(3)), end):
        sinks.json_lines(rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")), log, append=True)
        text = T.StructType([T.StructField(f.name, T.StringType() if f.name == "ts" else f.dataType) for f in events.schema.fields])
        stream = completion_log(spark, log, text).withColumn("ts", F.col("ts").cast("timestamp"))
        drain(sessions(stream, "event_type", "ts", "user_id", "value"), out, mark)
    found = spark.read.parquet(out).filter(F.year("session.start") < 2200)
    return found.select("event_type", "size", "max_length", F.round("avg_value", 6).alias("avg_value"), F.col("session.start").cast("timestamp_ntz").alias("started"))


# -- responses around texts

_SAID_SQL = f"""x AS (SELECT doc_id, {FIRST_SQL} AS x, doc_id % 5 AS k FROM documents)"""


@query(f"""WITH {_SAID_SQL}
SELECT doc_id, CASE WHEN k = 4 THEN 'NO_JSON' ELSE 'VALID' END AS status, CASE WHEN k = 4 THEN NULL WHEN doc_id % 2 = 0 THEN 'VULNERABLE' ELSE 'NOT_VULNERABLE' END AS classification, CASE WHEN k = 4 THEN '' ELSE length(x)::VARCHAR || ',' || (length(x) + 2)::VARCHAR END AS lines FROM x""")
def responses_with_texts(spark, sf_dir):
    """Answers that speak of a text: as thought, as prose before the object, within its strings (with braces, quotes and breaks), in a fence, and with an object that says nothing."""
    d, x = F.col("doc_id"), F.col("x")
    k, prose = d % 5, F.translate("x", '{}[]"\\<>', "")
    said = F.when(d % 2 == 0, "VULNERABLE").otherwise("not_vulnerable")
    summary = F.when(k == 1, F.concat(F.lit('if (a) { "b" }\n'), x)).when(k == 2, F.concat(x, F.lit("}} {"))).otherwise(x)
    told = F.to_json(F.struct(summary.alias("reasoning_summary"), said.alias("classification"), F.array(F.length("x"), F.length("x") + 2).alias("important_lines")))
    rest = F.when(k == 4, F.concat(prose, F.lit(" and no more"))).when(k == 3, F.concat(F.lit('{"note": {"a": 1}} ```json\n'), told, F.lit("\n```"))).otherwise(F.concat(prose, F.lit(" "), told, F.lit(" end")))
    response = F.concat(F.lit("<think>"), prose, F.lit("</think>\n"), rest)
    parsed = first_lines(spark, sf_dir).select("doc_id", R.parse(response).alias("p"))
    return parsed.select("doc_id", "p.status", "p.classification", F.array_join("p.lines", ",").alias("lines"))
