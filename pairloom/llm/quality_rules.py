"""Quality rules with cutoffs that adapt to each language and source.

Features of every whole text are measured once. Each rule is a ratio of them,
taken as an integer, and goes into a relative-error quantile sketch (DDSketch:
counts by logarithmic bin) for each language and source. A sketch is merged by
adding the counts of equal bins, so Spark builds it with partial aggregation;
no group's rows meet in one task. Documents that fail the base rules aren't
counted, as they are dropped anyway. The fence of a rule is set by the sketch's
own quantiles alone (upper: the UPPER quantile):

    fence = median + SPREAD * (upper - median)

Where both are 0, most documents have no such event, and to have any is odd: the
fence is the LOWER quantile of those that have some, i.e. of the sketch without
its bin of 0. A group with fewer than
MIN_GROUP counted documents takes its language's sketch instead, and below that
the sketch of all; the same for the documents that have any event. Fences are joined back, and a document
breaks a rule if it has more events (symbols, repeated words, ...) than the fence
grants to its size, and a few more (the rule's ALLOWANCE), as a single event makes
a large ratio in a short text. Documents that break a rule, or fail the base
rules, aren't kept.

Defined cases: a null text has no words and fails the base rules; null lang or
source are groups of their own; repeated rows count each; an empty table gives
an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import chunks, column_of, text_or_empty, words_of, written

#: Bins of a sketch by doubling of the value: values in a bin differ by 2 ** (1 / BINS) at most.
BINS = 16
#: The upper and the lower quantile (as fractions), the spread, and the least documents of a group's own sketch.
UPPER, LOWER, SPREAD, MIN_GROUP = (9, 10), (1, 10), 3, 50
#: Rules: events, size, scale of their ratio as an integer, and the events that are granted beside the fence's share.
RULES = {
    "symbols_per_mille": ("n_symbols", "word_chars", 1000, 5),
    "repeat_per_mille": ("n_repeat_words", "n_words", 1000, 12),
    "dup_lines_per_mille": ("n_dup_lines", "n_lines", 1000, 2),
    "word_length_tenths": ("word_chars", "n_words", 10, 50),
}
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
BLANKS = " \t\n\x0b\x0c\r"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS.encode())] = True


def repeated_words(codes: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more in this sequence of word codes."""
    if len(codes) < 4:
        return 0
    top = int(codes.max()) + 1
    if top < 1 << 21:
        windows = (codes[:-2] * top + codes[1:-1]) * top + codes[2:]
    else:
        pairs = np.unique(codes[:-1] * top + codes[1:], return_inverse=True)[1]
        windows = pairs[:-1] * top + codes[2:]
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.isin(windows, twice)
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[k : k + len(starts)] |= starts
    return int(covered.sum())


def byte_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points that aren't ASCII blanks, symbols) of each string."""
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]

    def each(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    return each(((data & 0xC0) != 0x80) & ~_IS_BLANK[data]), each(_IS_SYMBOL[data])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Features of each whole text, beside the id and the columns in `keep`."""
    kept = [id_col, *keep]
    source = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(kept)), text_or_empty(text_col).alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def run(batches):
        for batch in chunks(batches):
            texts = column_of(batch, "text")
            _, codes, offsets = words_of(texts)
            chars, symbols = byte_counts(texts)
            repeats = [repeated_words(codes[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
            lines, doubles = [], []
            for text in texts.to_pylist():
                full = [x for x in text.split("\n") if x.strip(BLANKS)]
                lines.append(len(full))
                doubles.append(len(full) - len(set(full)))
            values = [np.diff(offsets), chars, symbols, doubles, repeats, lines]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(v, pa.int64()) for v in values)], [*batch.schema.names[:-1], *names])

    schema = ", ".join([f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)] + [f"{n} long" for n in names])
    found = source.mapInArrow(run, schema)
    return found.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(kept)), *names)


def bin_of(value: Column) -> Column:
    """Sketch bin of a non-negative integer; 0 has a bin of its own. Powers of two are exact despite the logarithm's rounding."""
    return F.when(value <= 0, F.lit(-1)).otherwise(F.floor(F.log2(value) * BINS + F.lit(1e-9))).cast("int")


def top_of(bin_: Column) -> Column:
    """Largest integer of a bin."""
    return F.when(bin_ < 0, F.lit(0)).otherwise(F.ceil(F.pow(F.lit(2.0), (bin_ + 1) / F.lit(float(BINS))) - F.lit(1e-9)) - 1).cast("long")


def sketches(measured: DataFrame, group: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Rows (group, rule, bin, n): the quantile sketch of each rule for each group, of documents that pass the base rules."""
    rules = F.array(*(F.struct(F.lit(k).alias("rule"), bin_of(F.expr(f"{scale} * {events} div greatest({size}, 1)")).alias("bin")) for k, (events, size, scale, _) in RULES.items()))
    return measured.filter(f"not ({BASE_FAILED})").select(*group, F.inline(rules)).groupBy(*group, "rule", "bin").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, group: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """One row for each group with the fence of each rule; sketches of thin groups are replaced by merged ones."""
    lang, source = group
    # a rule's name with a plus is its sketch without the bin of 0
    sketch = sketch.unionByName(sketch.filter("bin >= 0").withColumn("rule", F.concat("rule", F.lit("+"))))

    def quantiles(df: DataFrame, *by: str) -> DataFrame:
        merged = df.groupBy(*by, "rule", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*by, "rule")
        ranked = merged.select(*by, "rule", "bin", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("total"))
        at = lambda part, whole: F.min(F.when(F.col("upto") * whole >= F.col("total") * part, F.col("bin")))
        cut = ranked.groupBy(*by, "rule").agg(at(1, 2).alias("mid"), at(*UPPER).alias("high"), at(*LOWER).alias("low"), F.max("total").alias("total"))
        cut = cut.select(*by, "rule", "total", *(top_of(F.col(c)).alias(c) for c in ("mid", "high", "low")))
        return cut.select(*by, "rule", "total", F.when(F.col("rule").endswith("+"), F.col("low")).otherwise(F.col("mid") + (F.col("high") - F.col("mid")) * SPREAD).alias("fence"))

    own, of_lang, of_all = quantiles(sketch, lang, source), quantiles(sketch, lang), quantiles(sketch)
    a, b, c = own.alias("a"), of_lang.alias("b"), of_all.alias("c")
    joined = a.join(b, F.col(f"a.{lang}").eqNullSafe(F.col(f"b.{lang}")) & (F.col("a.rule") == F.col("b.rule"))).join(c, F.col("a.rule") == F.col("c.rule"))
    fence = F.when(F.col("a.total") >= MIN_GROUP, F.col("a.fence")).when(F.col("b.total") >= MIN_GROUP, F.col("b.fence")).otherwise(F.col("c.fence"))
    one = joined.select(F.col(f"a.{lang}").alias(lang), F.col(f"a.{source}").alias(source), F.col("a.rule").alias("rule"), fence.alias("fence"))
    of = lambda k: F.max(F.when(F.col("rule") == k, F.col("fence")))
    return one.groupBy(lang, source).agg(*(F.coalesce(F.nullif(of(k), F.lit(0)), of(f"{k}+"), F.lit(0)).alias(f"fence_{k}") for k in RULES))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """One row for each document: its features, base_failed, kept, and the rules that it breaks."""
    measured = written(measure(docs, id_col, text_col, group), "features")
    cuts = written(fences(sketches(measured, group), group), "fences")
    lang, source = group
    m, c = measured.alias("m"), cuts.alias("c")
    both = m.join(c, F.col(f"m.{lang}").eqNullSafe(F.col(f"c.{lang}")) & F.col(f"m.{source}").eqNullSafe(F.col(f"c.{source}")), "left")
    over = lambda k: F.expr("{2} * ({0} - {3}) > fence_{4} * {1}".format(*RULES[k], k))
    broken = F.array_compact(F.array(*(F.when(over(k), F.lit(k)) for k in RULES)))
    failed = F.expr(BASE_FAILED)
    return both.select(
        F.col(f"m.{id_col}").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.size(broken) == 0)).alias("kept"), F.array_join(broken, ",").alias("broken_rules"),
    )


def _rule_rows() -> str:
    return " UNION ALL ".join(f"SELECT rid, lang, source, '{k}' AS rule, {scale} * {events} // greatest({size}, 1) AS v, {scale} * ({events} - {allowed}) AS events, {size} AS size FROM m WHERE NOT ({BASE_FAILED})" for k, (events, size, scale, allowed) in RULES.items())


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, lang, source, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (
  SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(w[1:len(w) - 2]) AS a, unnest(w[2:len(w) - 1]) AS b, unnest(w[3:len(w)]) AS c
  FROM w WHERE len(w) >= 4),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines
  FROM w LEFT JOIN r ON w.rid = r.rid),
x AS ({_rule_rows()}),
z AS (SELECT lang, source, rule, CASE WHEN v <= 0 THEN -1 ELSE floor(log2(v) * {BINS} + 1e-9)::INT END AS bin, count(*) AS n FROM x GROUP BY ALL),
s AS (SELECT * FROM z UNION ALL SELECT lang, source, rule || '+', bin, n FROM z WHERE bin >= 0),
k AS (
  SELECT 'own' AS level, * FROM s
  UNION ALL SELECT 'lang', lang, NULL, rule, bin, sum(n) FROM s GROUP BY ALL
  UNION ALL SELECT 'all', NULL, NULL, rule, bin, sum(n) FROM s GROUP BY ALL),
u AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rule) AS total FROM k),
q AS (
  SELECT level, lang, source, rule, max(total) AS total, min(CASE WHEN 2 * upto >= total THEN bin END) AS a, min(CASE WHEN {UPPER[1]} * upto >= {UPPER[0]} * total THEN bin END) AS b,
    min(CASE WHEN {LOWER[1]} * upto >= {LOWER[0]} * total THEN bin END) AS c
  FROM u GROUP BY ALL),
t AS (
  SELECT *, CASE WHEN a < 0 THEN 0 ELSE ceil(pow(2.0, (a + 1) / {BINS}.0) - 1e-9) - 1 END AS mid,
    CASE WHEN b < 0 THEN 0 ELSE ceil(pow(2.0, (b + 1) / {BINS}.0) - 1e-9) - 1 END AS high,
    CASE WHEN c < 0 THEN 0 ELSE ceil(pow(2.0, (c + 1) / {BINS}.0) - 1e-9) - 1 END AS low FROM q),
f AS (SELECT level, lang, source, rule, total, CASE WHEN rule LIKE '%+' THEN low ELSE mid + (high - mid) * {SPREAD} END AS fence FROM t),
c AS (
  SELECT o.lang, o.source, o.rule, CASE WHEN o.total >= {MIN_GROUP} THEN o.fence WHEN l.total >= {MIN_GROUP} THEN l.fence ELSE e.fence END AS fence
  FROM f o JOIN f l ON l.level = 'lang' AND l.rule = o.rule AND l.lang IS NOT DISTINCT FROM o.lang JOIN f e ON e.level = 'all' AND e.rule = o.rule WHERE o.level = 'own'),
v AS (
  SELECT x.rid, bool_or(x.events > x.size * coalesce(nullif(c.fence, 0), p.fence, 0)) AS broken
  FROM x
  JOIN c ON c.rule = x.rule AND c.lang IS NOT DISTINCT FROM x.lang AND c.source IS NOT DISTINCT FROM x.source
  LEFT JOIN c p ON p.rule = x.rule || '+' AND p.lang IS NOT DISTINCT FROM x.lang AND p.source IS NOT DISTINCT FROM x.source
  GROUP BY x.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({BASE_FAILED}) AS base_failed, NOT ({BASE_FAILED}) AND NOT broken AS kept
FROM m LEFT JOIN v ON m.rid = v.rid
"""
