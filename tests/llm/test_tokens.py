import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecsmith.llm.packing import hilbert_keys, pack
from vecsmith.llm.token_counts import chars_within, prefix_counts, running, token_prefixes, tokens_at
from vecsmith.llm.token_files import decode_ranks, encode_ranks, read_token_files, write_token_files


def ids_of(path, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_files(spark, docs, docs_rows, tokenizer, name, clashing):
    ids = ids_of(tokenizer(name), [r[1] for r in docs_rows])
    tie = {r["text"]: r["tie"] for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()}
    order = sorted(range(len(docs_rows)), key=lambda i: (docs_rows[i][0] is not None, docs_rows[i][0] or 0, tie[docs_rows[i][1]]))
    want, at = [], 0
    for i in order:
        own = np.array([*ids[i], 0], "<u4")
        want.append((docs_rows[i][0], at, len(own), zlib.crc32(own.tobytes())))
        at += len(own)
    for df in (docs, clashing):
        got = read_token_files(spark, write_token_files(df, tokenizer(name), file_bytes=3000)).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_files_empty(spark, empty, tokenizer):
    assert read_token_files(spark, write_token_files(empty, tokenizer("byte_bpe_50k.json"))).count() == 0


@pytest.mark.parametrize("ranks", [[], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], list(range(1000))])
def test_codes(ranks):
    ranks = np.array(ranks, np.uint32)
    control, data = encode_ranks(ranks)
    assert (decode_ranks(control, data, len(ranks)) == ranks).all() and len(control) == -(-len(ranks) // 4)


def test_pack(docs, docs_rows, tokenizer, clashing, empty):
    path = tokenizer("byte_bpe_50k.json")
    ids = [[*x, 1] for x in ids_of(path, [r[1] for r in docs_rows])]
    for df in (docs, clashing):
        rows = df and pack(df, path).collect()
        assert sum(r.length for r in rows) == sum(map(len, ids))
        whole = collections.Counter()
        pieces = collections.defaultdict(list)
        for r in rows:
            own = np.frombuffer(r.ids, "<u4")
            assert len(own) == r.length > 0
            pieces[r.sequence_id].append(r)
            if r.length == r.doc_tokens:
                whole[(r.doc_id, tuple(own))] += 1
        want = collections.Counter((d[0], tuple(x)) for d, x in zip(docs_rows, ids, strict=True))
        assert whole <= want
        for own in pieces.values():
            own.sort(key=lambda r: r.offset)
            total = sum(r.length for r in own)
            assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
            assert total <= 2048 and total & (total - 1) == 0
        long = sorted((r for r in rows if r.doc_id == 98), key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in long]).tolist() == ids[next(i for i, d in enumerate(docs_rows) if d[0] == 98)]
    assert pack(empty, path).count() == 0


def test_hilbert():
    """Every cell once, and neighbours on the curve are neighbours in space."""
    for dims, bits in ((2, 3), (3, 2), (3, 3)):
        grid = np.stack(np.meshgrid(*[range(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        order = np.argsort(hilbert_keys(grid, bits))
        assert sorted(hilbert_keys(grid, bits)) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_prefix_counts(docs, docs_rows, tokenizer, clashing, empty):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = collections.Counter((r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or ""))) for r in docs_rows)
    for df in (docs, clashing):
        got = token_prefixes(df, path).collect()
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 4096) for r in got) and any(r.over_limit for r in got)
    assert token_prefixes(empty, path).count() == 0
    for text in ["", " ", "  two  spaces ", "naïve ünïcode 漢字\n\ttab ;\r\n▁x <s> unk: 🙂", (docs_rows[0][1])[:200], docs_rows[70][1][:200]]:
        ((steps, n),) = prefix_counts(path)([text])
        assert running(steps) == [len(sp.encode(text[:i])) for i in range(len(text) + 1)] and n == len(sp.encode(text))


def test_budgets(docs, tokenizer):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = token_prefixes(docs.where("doc_id between 0 and 9"), path).join(docs.select("doc_id", "text").distinct(), "doc_id")
    for r in rows.select("text", tokens_at(F.col("steps"), F.lit(40)).alias("at"), chars_within(F.col("steps"), F.lit(12)).alias("fit")).collect():
        assert r["at"] == len(sp.encode(r.text[:40]))
        assert len(sp.encode(r.text[: r.fit])) <= 12 and all(len(sp.encode(r.text[:i])) > 12 for i in range(r.fit + 1, min(len(r.text), r.fit + 30) + 1))


def test_budgets_of_nulls(spark, tokenizer):
    rows = token_prefixes(spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string"), tokenizer("piece_bpe_32k.model"))
    null = F.lit(None).cast("binary")
    got = rows.select("doc_id", tokens_at(F.col("steps"), F.when(F.col("doc_id") == 2, 3)).alias("a"), chars_within(F.col("steps"), F.lit(None).cast("long")).alias("b"), tokens_at(null, F.lit(1)).alias("c"), chars_within(null, F.lit(1)).alias("d"), tokens_at(F.col("steps"), F.lit(-4)).alias("e"), chars_within(F.col("steps"), F.lit(-1)).alias("f")).collect()
    assert sorted((r.doc_id, r.a, r.b, r.c, r.d, r.e, r.f) for r in got) == [(1, None, None, None, None, 0, 0), (2, 0, None, None, None, 0, 0)]


ODD = ["a", "B", "é", "\n", " ", "  ", "\t", "\u00a0", "'s", "1", "²", "!", "...", "漢", "\0", "<|endoftext|>", "\r\n", "x1y", "-_", "😀", "ß", "İ", "\x1c", "\x85", " \n", "\n ", ".", ",", "word", " word."]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_as_the_library(tokenizer, name):
    """Ids by piece are the library's; files with another pre-tokenizer or a normalizer go through it whole."""
    import random

    from tokenizers import Tokenizer

    from vecsmith.llm import tokenizing

    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(14))) for _ in range(4000)] + [None, "", "Plain words, twice. Plain words, twice.\nAnd on."]
    encode = tokenizing.SegmentIds(tokenizer(name))
    assert encode.cuts == (name == "byte_bpe_50k.json")
    library = Tokenizer.from_file(tokenizer(name))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, encode.dtype).tolist() for x in encode(texts)] == want
    assert [np.frombuffer(x, encode.dtype).tolist() for x in encode(texts[::-1])] == want[::-1]


def test_pieces_forgotten(tokenizer, monkeypatch):
    from vecsmith.llm import tokenizing

    path = tokenizer("byte_bpe_50k.json")
    texts = [f"alpha{i % 7} beta{i}, gamma{i % 3}." for i in range(300)]
    want = tokenizing.SegmentIds(path)(texts)
    monkeypatch.setattr(tokenizing, "_KEPT", 50)
    monkeypatch.setattr(tokenizing, "_AT_ONCE", 7)
    encode = tokenizing.SegmentIds(path)
    assert [x for at in range(0, 300, 20) for x in encode(texts[at : at + 20])] == want


def test_very_long_texts(spark, tokenizer):
    """Texts of some megabytes, one of them without any space."""
    import sentencepiece

    from tests.llm.conftest import prose
    import random

    rng = random.Random(8)
    texts = [prose(rng, 400_000), "x" * 300_000 + "yz" * 1000, "z\n" * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = ids_of(tokenizer("byte_bpe_50k.json"), texts)
    got = {r.doc_id: r for r in read_token_files(spark, write_token_files(docs, tokenizer("byte_bpe_50k.json"))).collect()}
    assert all(np.frombuffer(got[i].ids, "<u4").tolist() == [*x, 0] for i, x in enumerate(ids))
    packed = collections.Counter()
    for r in pack(docs, tokenizer("byte_bpe_50k.json")).collect():
        packed[r.doc_id] += r.length
    assert packed == {i: len(x) + 1 for i, x in enumerate(ids)}
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    counts = {r.doc_id: r.n_tokens for r in token_prefixes(docs, tokenizer("piece_bpe_32k.model")).select("doc_id", "n_tokens").collect()}
    assert counts[0] == len(sp.encode(texts[0])) and counts[2] == len(sp.encode(texts[2]))


def test_pack_little_at_once(tokenizer, monkeypatch):
    """A packing task encodes a few MB of text at once, however much one batch holds, and each document's ids stay the same."""
    import pyarrow as pa

    from vecsmith.llm import packing, tokenizing

    path = tokenizer("byte_bpe_50k.json")
    text = [f"{i} " + "some words " * 900 for i in range(900)]  # 9 MB
    held, real = [], tokenizing.SegmentIds.ids
    monkeypatch.setattr(tokenizing.SegmentIds, "ids", lambda self, texts: held.append(sum(len(t) for t in texts.to_pylist())) or real(self, texts))
    batches = [pa.record_batch({"doc_id": pa.array([i for i in range(at, at + 100)], pa.int64()), "text": text[at : at + 100]}) for at in range(0, 900, 100)]
    got = pa.Table.from_batches(packing._tokenized(iter(batches), path, 3, 10))
    assert got["doc_id"].to_pylist() == list(range(900)) and sum(held) == sum(map(len, text))
    assert max(held) <= 4 << 20
    assert got["ids"].to_pylist()[::300] == tokenizing.segment_ids(path)(text[::300])
