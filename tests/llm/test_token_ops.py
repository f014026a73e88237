"""Packing, token counts and sampled pieces."""

import collections
import math
import pathlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cueline.llm import bpe, packing, piece_sampling, queries, token_counts
from tests.llm import brute

TEXTS = [
    (1, "Hello world, it's a test.\nNew line  two blanks\n\n\nand\ttabs "), (2, None), (3, ""), (4, " leading"), (5, "trailing "), (6, "a b 　c"),
    (7, "words and more words " * 2000), (8, "日本語 text ▁ with ▁▁ marks \x00 and <|endoftext|>"), (9, "x" * 5000), (None, "no id"), (1, "again"), (10, "a \nb"), (11, "é\x85f\x1cg"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, -1, 0.0) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, length long, sequence_id double").repartition(3)


@pytest.fixture(scope="module")
def reference():
    """Ids of the given tokenizers file at its default settings, without special tokens around."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def plain_reference():
    """As ``reference``, with strings of added tokens as ordinary text, which op8's separators ask for."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


END = "<|endoftext|>"
WITH_END = [f"a {END} b", END, END * 3, f"x\n{END}\n\ny ", f" {END}  z", f"no{END}gap", "<|endoftext", f"{END[:-1]}{END}"]


def test_ids_equal_the_reference_tokenizer(spark, reference, plain_reference):
    plain, full = bpe.Encoder(bpe.default_path()), bpe.Encoder(bpe.default_path(), bpe.added_tokens())
    texts = [t for _, t in TEXTS] + WITH_END + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in texts:
        assert np.frombuffer(plain.encode(t), "<u4").tolist() == plain_reference(t)
        assert np.frombuffer(full.encode(t), "<u4").tolist() == reference(t)
    assert reference(f"a {END} b") == [64, 220, 50256, 275]


def test_a_text_is_one_call_of_the_tokenizer(monkeypatch, reference):
    calls = []
    for name in ("encode_ordinary", "encode_to_numpy"):
        whole = getattr(tiktoken.Encoding, name)
        monkeypatch.setattr(tiktoken.Encoding, name, lambda *a, whole=whole, **k: calls.append(1) or whole(*a, **k))
    text = "\n".join(f"rare{n}{END if n % 100 == 50 else ' '}word{n} é{n}" for n in range(2000))
    full = bpe.Encoder(bpe.default_path(), bpe.added_tokens())
    calls.clear()
    assert np.frombuffer(full.encode(text), "<u4").tolist() == reference(text)
    assert len(calls) == text.count(END) + 1


def test_packing_query_has_the_ids_of_the_tokenizer(spark, reference, tmp_path):
    texts = [t for _, t in TEXTS] + WITH_END
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = collections.Counter((i, *p) for i, t in enumerate(texts) for p in brute.cut_pieces([*reference(t), 0]))
    rows = queries.op5_best_fit_packing(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want


def _gapless(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by)


def test_packing_documents(docs, reference):
    rows = packing.pack_documents(docs, added=bpe.added_tokens()).collect()
    want = collections.Counter((i, *p) for i, t in TEXTS for p in brute.cut_pieces([*reference(t), 0]))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert _gapless(rows) >= math.ceil(sum(r.length for r in rows) / 2048)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_packing_is_tight(spark):
    rows = packing.pack_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert _gapless(rows) <= 1.01 * math.ceil(sum(r.length for r in rows) / 2048) + 1


def test_patterns_pack_most_pieces(spark):
    parts = packing.pieces(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    h = np.zeros(2049, np.int64)
    for r in parts.groupBy("length").count().collect():
        h[r["length"]] = r["count"]
    for times in (1, 50):
        some = h * times
        made = packing.plan(some)
        bound = math.ceil((some * np.arange(2049)).sum() / 2048)
        assert sum(n for _, n in made) <= 1.0005 * bound
        full = sum(len(p) * n for p, n in made if 1 < len(p) < 4 and sum(p) == 2048)
        assert full > 0.7 * some[:2048].sum()


def test_columns_of_pieces_may_have_any_name(spark):
    parts = spark.createDataFrame([(1, 0, 0, 2000, 5, 1, 2, 3), (2, 0, 0, 48, 6, 1, 2, 3), (None, 0, 0, 2048, 7, 1, 2, 3)], packing.PIECES + ", salt int, `a.b` int, sequence_id int")
    made = packing.pack(parts)
    assert made.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "salt", "a.b", "sequence_id", "offset"]
    assert _gapless(made.collect()) == 2
    with pytest.raises(ValueError):
        packing.pack(parts.withColumn("length", F.lit(2049).cast("long")))


def test_a_hot_length_is_spread(spark):
    parts = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
        F.when(F.col("id") % 3 == 0, 1500).otherwise(F.col("id") % 500 + 1).cast("long").alias("length"), F.col("id").alias("ids_crc32"),
    )
    assert _gapless(packing.pack(parts).collect()) == 10_000  # no two of the hot length share a sequence


@pytest.mark.parametrize("capacity", [8, 64])
def test_plans_use_up_every_histogram(capacity):
    rng = np.random.default_rng(capacity)
    for _ in range(20):
        h = np.concatenate(([0], rng.integers(0, 30, capacity) * (rng.random(capacity) < rng.random())))
        used = np.zeros(capacity + 1, int)
        for pattern, times in packing.plan(h, capacity):
            assert sum(pattern) <= capacity and times > 0
            for v in pattern:
                used[v] += times
        assert (used == h).all()


def test_token_counts(docs, plain_reference):
    got = token_counts.count_tokens(docs).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == collections.Counter((i, len(plain_reference(t))) for i, t in TEXTS)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_boundaries_of_blocks_are_stitched(docs, plain_reference, block):
    few = [(i, t) for i, t in TEXTS if i not in (7, 9)]
    got = token_counts.count_tokens(docs.where("doc_id is null or doc_id not in (7, 9)"), block=block).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == collections.Counter((i, len(plain_reference(t))) for i, t in few)


@pytest.mark.parametrize("group", [1, 3, 4096])
def test_flat_files(spark, tmp_path, group):
    rng = np.random.default_rng(4)
    want = []
    for k in range(4):
        lengths = rng.integers(0, 40, 50)
        ids = np.concatenate([np.append(rng.integers(0, 100, n), 999) for n in lengths] + [np.arange(5 * k)]).astype("<u4")
        (tmp_path / f"{k}.bin").write_bytes(ids.tobytes())
        starts = np.concatenate(([0], np.cumsum(lengths + 1)))
        want += [(f"{k}.bin", i, int(starts[i]), int(n), True) for i, n in enumerate(lengths)]
        want += [(f"{k}.bin", 50, int(starts[50]), 5 * k, False)] * (k > 0)
    (tmp_path / "empty.bin").write_bytes(b"")
    blocks = token_counts.blocks_of(spark, str(tmp_path), width=4, block=16)
    got = token_counts.scan(blocks.union(blocks), end_id=999, width=4, block=16, group=group).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.ordinal, r.start, r.n_tokens, r.ended) for r in got) == sorted(want)
    assert token_counts.scan(blocks.limit(0), end_id=999, width=4, block=16).count() == 0


def test_flat_files_are_flat_and_deleted(spark, docs, plain_reference, tmp_path):
    named = token_counts.write_flat_files(docs.withColumn("a.b", F.lit(1)), str(tmp_path / "flat")).collect()
    files = {int(f.stem): np.fromfile(f, "<u2") for f in (tmp_path / "flat").glob("*.bin")}
    texts = collections.defaultdict(list)
    for r in sorted(named, key=lambda r: (r.file, r.ordinal)):
        texts[r.file].append(r.doc_id)
    known = {i: t for i, t in TEXTS if i not in (None, 1)}
    for file, ids in texts.items():
        stops = np.flatnonzero(files[file] == token_counts.END_OF_DOCUMENT)
        assert len(stops) == len(ids)
        for i, a, b in zip(ids, [0, *(stops[:-1] + 1)], stops):
            if i in known:
                assert files[file][a:b].tolist() == plain_reference(known[i])
    (tmp_path / "flat" / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole identifiers"):
        token_counts.scan(token_counts.blocks_of(spark, str(tmp_path / "flat"))).collect()
    with pytest.raises(ValueError, match="fit"):
        token_counts.write_flat_files(docs, str(tmp_path / "x"), end_id=1 << 16)
    token_counts.count_tokens(docs)
    from cueline.llm._common import shared_folder

    assert not list(pathlib.Path(shared_folder(spark).removeprefix("file:")).glob("flat-*"))


def test_sampled_pieces_decode_to_the_text(spark, docs):
    cut = piece_sampling.encode(docs, name="length").select("doc_id", "text", "length", piece_sampling.decode(F.col("length")).alias("back"))
    assert all(r.back == (r.text or "") for r in cut.collect())
    again = piece_sampling.encode(docs.repartition(2), name="length")
    first = collections.Counter((r.doc_id, r.text, tuple(r.length)) for r in cut.collect())
    assert first == collections.Counter((r.doc_id, r.text, tuple(r.length)) for r in again.collect())
    assert piece_sampling.encode(docs.limit(0)).count() == 0
    odd = piece_sampling.encode(docs.withColumns({"a.b": F.lit(1), "Piece_IDs": F.lit("x")}))
    assert odd.columns == [*docs.columns, "a.b", "piece_ids"] and {r["a.b"] for r in odd.collect()} == {1}
    assert [list(piece_sampling.together(s, 5)) for s in ([], [9], [2, 3, 1, 9, 9, 0])] == [[], [(0, 1)], [(0, 2), (2, 3), (3, 4), (4, 5), (5, 6)]]


def test_samples_follow_the_weights_of_all_segmentations():
    pieces = piece_sampling.Pieces(piece_sampling.default_path(), alpha=0.3)
    sampler, word = piece_sampling.Sampler(pieces), " thing"

    def every(rest):
        if not rest:
            yield (), 1.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in pieces.weights:
                i, w = pieces.weights[rest[:k]]
                for tail, share in every(rest[k:]):
                    yield (i, *tail), w * share

    shares = dict(every(word))
    total = sum(shares.values())
    n = 20_000
    got = collections.Counter(tuple(x.tolist()) for x in sampler.encode([word] * n, list(range(n))))
    assert set(got) <= set(shares) and len(got) > 5
    for seg, share in shares.items():
        assert abs(got[seg] / n - share / total) < 0.02


@pytest.mark.parametrize("text", ["Donaudampfschifffahrtsgesellschaftskapitaen", "if x:\n        return    y;\r\n  ", "x" * 80, "ab  日本語のテキスト" + "/path" * 9])
def test_no_cut_bars_a_piece(text):
    """Each place ends a piece as often as over all segmentations of the whole text."""
    pieces = piece_sampling.Pieces(piece_sampling.default_path(), alpha=0.5)
    sampler, n, size = piece_sampling.Sampler(pieces), 4000, len(text)
    weight = lambda a, b: pieces.weights[text[a:b]][1] if text[a:b] in pieces.weights else pieces.spelt * (b == a + 1)
    ahead, behind = [1.0] + [0.0] * size, [0.0] * size + [1.0]
    for k in range(1, size + 1):
        ahead[k] = sum(ahead[a] * weight(a, k) for a in range(max(0, k - pieces.longest), k))
        behind[size - k] = sum(behind[b] * weight(size - k, b) for b in range(size - k + 1, min(size, size - k + pieces.longest) + 1))
    got = np.zeros(size + 1)
    for ids in sampler.encode([text] * n, list(range(n))):
        assert pieces.decode(ids.tolist()) == text
        data = [pieces.table[i] for i in ids.tolist()]
        ends = np.cumsum([0, *map(len, data)])
        places = np.cumsum([0, *(len(c.encode()) for c in text)])
        got[np.isin(places, ends)] += 1
    want = np.array(ahead) * np.array(behind) / ahead[-1]
    assert np.abs(got / n - want).max() < 0.04


def test_a_seed_changes_the_cut():
    pieces = piece_sampling.Pieces(piece_sampling.default_path(), alpha=0.2)
    text = "several different words that can be cut in many ways " * 5
    one, two = (piece_sampling.Sampler(pieces, s).encode([text], ["k"])[0].tolist() for s in (1, 2))
    assert one != two and pieces.decode(one) == pieces.decode(two) == text


def test_stores_as_spark_names_them(tmp_path):
    """Schemes that pyarrow doesn't know stand for those that it has."""
    from pyarrow import fs

    for scheme in ("s3", "s3a", "s3n"):
        store, where = token_counts._store(f"{scheme}://bucket/a/b.bin")
        assert isinstance(store, fs.S3FileSystem) and where == "bucket/a/b.bin"
    (tmp_path / "x y").write_bytes(b"12")
    for path in (f"{tmp_path}/x y", f"file:{tmp_path}/x y", f"file://{tmp_path}/x y"):
        store, where = token_counts._store(path)
        assert store.open_input_file(where).read() == b"12"


def test_flat_files_go_even_if_a_scan_fails(spark, monkeypatch):
    import glob

    from cueline.llm._common import shared_folder

    def broken(*_, **__):
        raise RuntimeError("broken")

    monkeypatch.setattr(token_counts, "scan", broken)
    with pytest.raises(RuntimeError):
        token_counts.count_tokens(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert not glob.glob(shared_folder(spark).removeprefix("file:") + "/flat-*")
