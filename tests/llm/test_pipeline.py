"""The pipeline against its stages written plainly."""

import collections

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cueline.llm import quality_vote, simhash, toxicity
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    machine = toxicity.fit(docs, labels)
    left = [(i, t) for i, t in rows if toxicity.Scorer(machine)([t])[0] < 0.7]
    kept = spark.createDataFrame(left, "doc_id long, text string")
    voters, features = quality_vote.fit(kept, labels), quality_vote.Features()
    left = [(i, t) for i, t in left if voters.vote(voters.latent([features(t)]))[0] >= 0.7]
    assert 0.5 * len(rows) < len(left) < len(rows)
    group = brute.components(left)
    left = [(i, t) for i, t in left if group[i] == i]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    cut = brute.kept_words(left)
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == {i for i, _ in left}
    want = collections.Counter(
        (i, *p) for i, t in left if not cut[i][1] for p in brute.cut_pieces([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    )
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got if not cut[r.doc_id][1]) == want


def test_stages_take_odd_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(30).withColumns(
        {"score": F.lit("s"), "kept": F.lit("k"), "n_words": F.lit(1), "a.b": F.lit(2), "__keys": F.lit(1), "row": F.lit(1), "cut_kept": F.lit("c"), "salt": F.lit(0)}
    )
    nothing = docs.select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]).limit(2)
    long = docs.limit(1).withColumns({"doc_id": F.lit(-5).cast("long"), "text": F.repeat(F.lit("word and more "), 20_000)})
    docs = docs.unionByName(long).unionByName(nothing).unionByName(docs.limit(2))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        if k < 4:
            made = stage(spark, docs, DATA)
            assert made.columns == docs.columns
            made.write.parquet(str(tmp_path / str(k)))
            docs = spark.read.parquet(str(tmp_path / str(k)))
            assert {(r["score"], r["a.b"], r["cut_kept"]) for r in docs.collect()} <= {("s", 2, "c"), (None, None, None)}
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
