"""Mixing of sources to target weights by weighted sampling without replacement.

Each document gets an exponential key, -ln(u) / weight, where u comes from a
hash of its id (so reruns agree) and weight is its quality. In key order within
its source, documents are taken until the source's token budget is met; a budget
of more than the whole source takes complete epochs first.

The order within a source is never sorted as a whole: keys fall into BINS
ordered bins, whose sizes are summed with partial aggregation. A bin below the
budget is taken whole and one above not at all; only the bin in which the budget
ends is sorted, so a hot source doesn't meet in one task.

Defined cases: a null text has size 0 and takes 0; a null source is a source of
its own, after all others; repeated rows are mixed one by one (equal keys follow
id, size and a hash of the text; of rows equal in all four, as many are taken as
bring the total nearest to the target); a document straddling the budget's end is
taken if that brings the total nearer; a source of size 0 has target 0; an empty
table gives an empty result; extra columns are not looked at.

The plan of the sources' targets is a window over one row for each source, which
is meant for up to some hundred thousand sources; documents never meet in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORD, text_or_empty, written

#: Ordered bins of the key for each source.
BINS = 4096
#: Weights by the source's place in code-point order, repeating; share of all sizes that is mixed; epochs at most.
WEIGHTS, SHARE, MOST_EPOCHS = (3, 1, 2), 1.5, 2
SEED = "mix-1"
#: A document's place in the order of its source.
PLACE = ("key", "id", "size", "print")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def quality_weight(text: Column) -> Column:
    """1 for prose, less the more of the text is made of symbols."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return 1.0 / (1.0 + 10.0 * symbols / F.greatest(F.length(text), F.lit(1)))


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, weight: Column | None, *columns: str) -> DataFrame:
    """(id, src, size, print, key, bin) of each document, and `columns`."""
    text = text_or_empty(text_col)
    thin = docs.select(*columns, F.col(id_col).alias("id"), F.col(source_col).alias("src"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("print"), (quality_weight(text) if weight is None else weight).alias("weight"))
    keyed = thin.select(*columns, "id", "src", "size", "print", (-F.ln(uniform(F.col("id"), seed)) / F.col("weight")).alias("key"))
    return keyed.withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("key"))) * BINS), F.lit(BINS - 1)).cast("int"))


def plan(by_bin: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """One row for each source: its size, target, epochs, the rest, and the bin in which the rest ends.

    Targets rise together, in proportion to the weights, until each stops at `most` times its source's size.
    In order of size / weight, sources stop one after the other; the level is where the budget is used up.
    """
    sources = by_bin.groupBy("src").agg(F.sum("size").alias("source_size"))
    everyone = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("place", F.row_number().over(everyone.orderBy(F.col("src").asc_nulls_last())) - 1)
    ranked = ranked.select("src", "source_size", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int")).alias("w"), "place")
    capped = ranked.withColumn("cap", F.col("source_size") * float(most)).withColumn("stop", F.col("cap") / F.col("w"))
    before = everyone.orderBy("stop", "place").rowsBetween(Window.unboundedPreceding, -1)
    level = capped.select(
        "src", "source_size", "w", "cap", "stop",
        (F.sum("source_size").over(everyone) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left_budget"),
        (F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("left_weight"),
    )
    # the level if all before have stopped; the first source that it does not stop sets it, which is the largest of such levels
    level = level.withColumn("level", F.col("left_budget") / F.col("left_weight"))
    level = level.withColumn("level", F.max(F.when(F.col("level") <= F.col("stop"), F.col("level"))).over(everyone))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.col("level")))
    aimed = level.select("src", "source_size", target.alias("target"))
    aimed = aimed.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    aimed = aimed.withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))

    upto = Window.partitionBy("src").orderBy("bin")
    cumulated = by_bin.select("src", "bin", (F.sum("size").over(upto) - F.col("size")).alias("before"), F.sum("size").over(upto).alias("after"))
    a, c = aimed.alias("a"), cumulated.alias("c")
    ends = a.join(c, F.col("a.src").eqNullSafe(F.col("c.src")))
    over = F.col("after") > F.col("rest")
    return ends.groupBy(F.col("a.src").alias("src"), "source_size", "target", "epochs", "rest").agg(
        F.coalesce(F.min(F.when(over, F.col("bin"))), F.lit(BINS)).alias("end_bin"), F.coalesce(F.min(F.when(over, F.col("before"))), F.lit(0)).alias("end_before")
    )


def cutoffs(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """The plan with `last`: the last place of the end bin of which the rest takes any, and how many of its equal rows; null where it takes none.

    Only the bin in which the rest ends is sorted, by place, so that many equal rows are one.
    """
    s, p = sized.alias("s"), planned.alias("p")
    last = s.join(p, F.col("s.src").eqNullSafe(F.col("p.src")) & (F.col("s.bin") == F.col("p.end_bin")))
    tied = last.groupBy(F.col("s.src").alias("src"), "rest", "end_before", *PLACE).agg(F.count("*").alias("n"))
    order = Window.partitionBy("src").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, -1)
    tied = tied.withColumn("upto", F.col("end_before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0)))
    some = F.floor((2 * F.col("rest") - (2 * F.col("upto") + F.col("size"))) / (2 * F.col("size"))) + 1
    taken = tied.withColumn("m", F.when(F.col("size") > 0, F.least(some, F.col("n"))).when(F.col("upto") <= F.col("rest"), F.col("n")).otherwise(0)).filter("m > 0")
    ends = taken.groupBy("src").agg(F.max(F.struct(F.struct(*PLACE).alias("place"), "n", "m")).alias("last"))
    e = ends.alias("e")
    return planned.alias("p").join(e, F.col("p.src").eqNullSafe(F.col("e.src")), "left").select("p.*", "e.last")


def decided(sized: DataFrame, ends: DataFrame, *columns: str) -> DataFrame:
    """sized with source_size, target, epochs and taken, by each row's own place alone; `columns` are kept.

    Rows at the last place count as taken here, though the rest may take only some of them: partly_taken() has those.
    """
    s, p = sized.alias("s"), ends.alias("p")
    both = s.join(p, F.col("s.src").eqNullSafe(F.col("p.src")))
    within = (F.col("bin") < F.col("end_bin")) | ((F.col("bin") == F.col("end_bin")) & F.col("last").isNotNull() & (F.struct(*PLACE) <= F.col("last.place")))
    taken = F.col("size") * F.col("epochs") + F.when(within, F.col("size")).otherwise(0)
    partly = F.col("last").isNotNull() & (F.struct(*PLACE) == F.col("last.place")) & (F.col("last.m") < F.col("last.n"))
    return both.select(*(F.col(f"s.{c}").alias(c) for c in columns), F.col("s.src").alias("_src"), "size", "source_size", "target", "epochs", taken.alias("taken"), partly.alias("_partly"), F.col("last.m").alias("_m"))


def partly_taken(rows: DataFrame) -> DataFrame:
    """Rows of decided() at a last place of which not all are taken: the first _m in the order of files and their rows are.

    The rows are written first. A file's rows are numbered within it and the files by their counts, so that a row that
    is repeated very often doesn't meet in one task.
    """
    held = written(rows.filter("_partly"), "mix-last").select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    counts = written(held.groupBy("_src", "_file").agg(F.count("*").alias("_n")), "mix-files")
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_src").orderBy("_file")) - F.col("_n"))
    h, b = held.alias("h"), before.alias("b")
    both = h.join(b, F.col("h._src").eqNullSafe(F.col("b._src")) & (F.col("h._file") == F.col("b._file"))).select("h.*", "b._before")
    nth = F.col("_before") + F.row_number().over(Window.partitionBy("_src", "_file").orderBy("_at"))
    return both.withColumn("_nth", nth).withColumn("taken", F.col("size") * (F.col("epochs") + (F.col("_nth") <= F.col("_m")).cast("long"))).select(*rows.columns)


def planned_ends(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    by_bin = written(sized.groupBy("src", "bin").agg(F.sum("size").alias("size")), "bins")
    planned = written(plan(by_bin, weights, share, most), "mix-plan")
    return written(cutoffs(sized, planned), "mix-ends")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: str = SEED, weight: Column | None = None,
) -> DataFrame:
    """One row for each document: id, size, source_size, target, epochs of its source, and words taken."""
    sized = written(sizes(docs, id_col, text_col, source_col, seed, weight), "sizes")
    found = decided(sized, planned_ends(sized, weights, share, most), "id")
    found = found.filter("not _partly").unionByName(partly_taken(found))
    return found.select(F.col("id").alias(id_col), F.col("_src").alias(source_col), "size", "source_size", "target", "epochs", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **how) -> DataFrame:
    """docs as the mix takes them: a row for each time that it is taken whole, none if it isn't; columns stay.

    An empty document goes with its source's complete epochs. Texts aren't shuffled: what a source's plan says of a
    place in the order decides each row where it is.
    """
    names = docs.columns
    ends = planned_ends(written(sizes(docs, id_col, text_col, source_col, seed, None), "sizes"), **how)
    row = docs.select(F.struct(*names).alias("_row"), F.col(id_col), F.col(text_col), F.col(source_col))
    # only rows of a partly taken place are looked for, by id, before sizes are made again
    p = ends.filter("last.m < last.n").select(F.col("src").alias("_s"), F.col("last.place.id").alias("_i"))
    asked = row.join(p, F.col(source_col).eqNullSafe(F.col("_s")) & F.col(id_col).eqNullSafe(F.col("_i")), "left_semi")
    mixed = [decided(sizes(rows, id_col, text_col, source_col, seed, None, "_row"), ends, "_row") for rows in (row, asked)]
    sized = mixed[0].filter("not _partly").unionByName(partly_taken(mixed[1]))
    times = F.when(F.col("size") > 0, F.col("taken") / F.greatest(F.col("size"), F.lit(1))).otherwise(F.col("epochs")).cast("int")
    counted = sized.withColumn("_times", times).filter("_times > 0")
    return counted.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select("_row.*")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT doc_id, source, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / (1.0 / (1.0 + 10.0::DOUBLE * (length(t) - length(translate(t, '#*$%&|<>', ''))) / greatest(length(t), 1))) AS key
  FROM d),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
r AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS place FROM g),
c AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM r),
l AS (
  SELECT *, cap / w AS stop,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev
  FROM c WINDOW b AS (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, max(CASE WHEN lev <= stop THEN lev END) OVER () AS level FROM l),
a AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, w * level) END AS target FROM m),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM a),
f AS (
  SELECT s.doc_id, s.size, e.source_size, e.target, e.epochs, s.source,
    greatest(e.target - e.epochs * e.source_size, 0) AS rest,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through
  FROM s JOIN e ON s.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  (size * epochs + CASE WHEN 2 * through - size <= 2 * rest THEN size ELSE 0 END)::BIGINT AS taken
FROM f
"""
