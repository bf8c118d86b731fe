"""The corpus pipeline: stages take effect, keep the columns, leave clean documents alone, and equal brute force."""

import corpus_pipeline
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from test_text_operators import brute_contamination, brute_lines, similarity

from textloom.llm import bpe_codec, line_dedup

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "benchmarks", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SF)
        assert made.columns == columns
        made.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert 0 < docs.count() <= before
        before = docs.count()
    assert docs.where("char_length(text) <> n_chars").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == before and last.where("NOT round_trip").count() == 0


def test_run_and_odd_documents(spark, tmp_path):
    source = pd.read_parquet(f"{SF}/documents.parquet")
    odd = pd.DataFrame({"doc_id": [10_001, 10_002, 10_003, 10_003], "text": [None, "", "123", "123"], "lang": [None] * 4, "source": ["x"] * 4, "n_chars": [0, 0, 3, 3]})
    pd.concat([source, odd]).to_parquet(tmp_path / "documents.parquet")
    pd.read_parquet(f"{SF}/benchmark.parquet").to_parquet(tmp_path / "benchmark.parquet")
    rows = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    kept = {r.doc_id for r in rows}
    assert kept and not kept & set(odd.doc_id) and all(r.round_trip for r in rows)


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spoken = corpus_pipeline.language(spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in spoken.collect()]
    assert len({i for i, _ in rows}) == len(rows)

    lines, gone = brute_lines(rows, line_dedup.MIN_WORDS)
    texts = {}
    for r in rows:
        out, k = [], 0
        for x in r[1].split("\n"):
            filled = bool(x.strip(" "))
            if not filled or k not in gone[r]:
                out.append(x)
            k += filled
        if not gone[r] or len(gone[r]) < len(lines[r]):
            texts[r[0]] = "\n".join(out)

    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    sizes = {i: len(t.split()) for i, t in texts.items()}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if min(sizes[i], sizes[j]) >= 0.5 * max(sizes[i], sizes[j]) and (texts[i] == texts[j] or similarity(texts[i], texts[j]) >= 0.8):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    kept = {i: t for i, t in texts.items() if root(i) == i}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {key[0] for key in brute_contamination(list(kept.items()), items) if key[-1]}
    expected = {i: bpe_codec.encode_text(bpe_codec.default_ranks(), t).tolist() for i, t in kept.items() if i not in dirty}
    found = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert found == expected


def test_stages_take_columns_of_any_name_and_long_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for name in ("key", "row", "doc", "ids", "own_key", "score", "part", "n", "node", "hot", "salt", "decoded"):
        docs = docs.withColumn(name, F.lit(name))
    long = docs.limit(1).withColumn("doc_id", F.lit(9_000_001).cast("long")).withColumn("text", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.concat(F.lit("word"), i.cast("string")))))
    docs = docs.unionByName(long)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SF)
        assert made.columns == docs.columns
        assert made.where("doc_id = 9000001").select("key", "row", "salt").collect() == [("key", "row", "salt")]
    assert corpus_pipeline.tokens(spark, docs, SF).where("round_trip AND doc_id = 9000001").count() == 1


def test_batches_of_python_stages_are_small(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab c"), 1000).alias("text"), F.lit("en").alias("lang"), F.lit("x").alias("source"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    for name, stage in corpus_pipeline.STAGES:
        if name in ("language", "near_copies", "tokens"):
            spark.conf.unset(key)
            try:
                stage(spark, docs.limit(0), SF)
                assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 3_000_000
            finally:
                spark.conf.unset(key)
