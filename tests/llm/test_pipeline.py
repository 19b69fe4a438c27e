import random
from collections import Counter

import corpus_pipeline
from pairloom.llm import mixing, queries, secret_scan, sentencepiece_fst, toxicity

from test_ops import brute_kept, brute_score, near_copies, prose


def test_stages_and_registration(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "secrets", "mixing", "encoding"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == docs.columns and {r.doc_id for r in after.select("doc_id").collect()} <= ids
        assert stage(spark, before.limit(0), sf_dir).count() == 0
        before = after
    encoded = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r.doc_id for r in encoded.select("doc_id").collect()) == sorted(r.doc_id for r in before.select("doc_id").collect())
    assert encoded.filter("not round_trip").count() == 0


def test_each_stage_against_a_plain_version(spark, tmp_path):
    """Nulls in every column, ties, repeated rows, empty texts and columns whose names the operators use themselves."""
    import sentencepiece

    r = random.Random(8)
    texts = [*near_copies(5, 25), None, "", "  \n", "one two", "ONE two", prose(30, 1) + " token = abcdef12 " + prose(5, 2), prose(30, 1) + " token = abcdef12 " + prose(5, 2)]
    for i in range(260):
        words = prose(r.randint(8, 40), 9000 + i).split()
        if i % 4 == 0:
            for _ in range(2):
                words.insert(r.randint(0, len(words)), r.choice(["grompel", "snarkish", "blattered", "gromple", "grompell"]))
        texts.append(" ".join(words))
    toxic = [int(any(w in (t or "") for w in ("gromp", "snark", "blatt"))) for t in texts]
    names = "doc_id text lang source n_chars _row _words _key _doc _partly print key size id shingle label v".split()
    rows = [(None if i == 7 else i, t, [None, "en", "de"][i % 3], [None, "a", "b", "a"][i % 4], None if t is None else len(t), *["clash"] * 12) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[len(texts) - 1], (5, "another text of an id that is there already", None, None, None, *["clash"] * 12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names[5:])).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, toxic[i]) for i in range(len(texts)) if i % 5] + [(3, None, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    content = lambda df: Counter((x.doc_id, x.text) for x in df.collect())

    lexicon = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert {"grompel", "snarkish", "blattered"} <= set(lexicon.terms)
    stages = dict(corpus_pipeline.STAGES)
    clean = corpus_pipeline.written(stages["toxicity"](spark, docs, str(tmp_path)), "test")
    assert content(clean) == Counter((x.doc_id, x.text) for x in docs.collect() if brute_score(lexicon, x.text) < toxicity.THRESHOLD)
    ones = corpus_pipeline.written(stages["near duplicates"](spark, clean, str(tmp_path)), "test")
    held = sorted(clean.collect(), key=lambda x: (x.doc_id is None, x.doc_id or 0))
    kept = brute_kept([x.text for x in held])
    assert sorted((x.doc_id for x in ones.collect()), key=lambda x: (x is None, x)) == [held[i].doc_id for i in kept]
    bare = corpus_pipeline.written(stages["secrets"](spark, ones, str(tmp_path)), "test")
    redacted = lambda t: t if not t or not secret_scan.spans_of(t)[1] else secret_scan.redact(t, secret_scan.spans_of(t)[1])
    assert content(bare) == Counter((x.doc_id, redacted(x.text)) for x in ones.collect()) and any("removed]" in (x.text or "") for x in bare.collect())
    mixed = corpus_pipeline.written(stages["mixing"](spark, bare, str(tmp_path)), "test")
    taken = Counter()
    for x in mixing.mix(bare).collect():
        taken[x.doc_id] += x.taken // x.size if x.size else x.epochs
    assert Counter(x.doc_id for x in mixed.collect()) == +taken
    for stage in (clean, ones, bare, mixed):
        assert stage.columns == names and {x.print for x in stage.collect()} == {"clash"}
    library = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_fst.model_bytes(None))
    encoded = stages["encoding"](spark, mixed, str(tmp_path))
    assert Counter((x.doc_id, tuple(x.ids)) for x in encoded.collect()) == Counter((x.doc_id, tuple(library.encode(x.text or ""))) for x in mixed.collect())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(x.doc_id for x in whole.collect()) == Counter(x.doc_id for x in encoded.collect())


def test_each_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings", "labels", "conversations"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, sf_dir)
        result = con.execute(sql)
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, result.fetchall())), name
