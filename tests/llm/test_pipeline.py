import collections

import corpus_pipeline as P
from tests.llm.conftest import SCHEMA
from tests.llm.test_dedup import groups_want, lower

STAGE = dict(P.STAGES)


def rows(df):
    return collections.Counter(map(tuple, df.collect()))


def test_stages(spark, docs, docs_rows, clashing, empty):
    names = [n for n, _ in P.STAGES]
    assert names == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing", "packing"]
    for df in (docs, clashing):
        for name, stage in P.STAGES[:-1]:
            assert stage(spark, df, "").columns == df.columns, name
    for name, stage in P.STAGES:
        assert stage(spark, empty, "").count() == 0, name


def test_language(spark, docs, docs_rows):
    got = STAGE["language ID"](spark, docs, "")
    letters = [r for r in docs_rows if any(c.isalpha() for c in r[1] or "")]
    assert rows(got.drop("lang")) == collections.Counter((r[0], r[1], r[3], r[4]) for r in letters)
    assert got.where("lang is null").count() == 0


def test_exact(spark, docs, docs_rows):
    got = STAGE["exact dedup"](spark, docs, "")
    best = {}
    for r in docs_rows:
        k = lower(r[1])
        if k not in best or (r[0] is not None and (best[k] is None or r[0] > best[k])):
            best[k] = r[0]
    assert rows(got) == collections.Counter(r for r in docs_rows if best[lower(r[1])] == r[0])


def test_near(spark, docs, docs_rows):
    got = STAGE["n-gram Jaccard join"](spark, docs, "")
    stays = {i for i, _, c in groups_want(docs_rows, 5, 80) if i == c}
    assert rows(got) == collections.Counter(r for r in docs_rows if r[0] in stays or r[0] is None)


def taken(rows_, share=1.5, cap=2.0):
    """Words wanted of each source, by filling up in plain Python."""
    size = collections.Counter()
    for r in rows_:
        size[r[3]] += len((r[1] or "").encode().split())
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, share * sum(size.values())
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(cap * size[s], mid * weight[s]) for s in order) < share * sum(size.values()) else (low, mid)
    return {s: min(cap * size[s], high * weight[s]) for s in order}


def test_mixing(spark, docs, docs_rows, clashing):
    """Whole copies of whole rows, twice at most, near each source's target; every row without words stays once."""
    for df in (docs, clashing):
        got = rows(STAGE["mixing"](spark, df, "").select(*docs.columns))
        given = collections.Counter(docs_rows)
        assert set(got) <= set(given) and all(n <= 2 * given[r] for r, n in got.items())
        assert all(got[r] == n for r, n in given.items() if not (r[1] or "").split())
        want = taken(docs_rows)
        for s, t in want.items():
            own = sum(n * len((r[1] or "").encode().split()) for r, n in got.items() if r[3] == s)
            longest = max(len((r[1] or "").encode().split()) for r in docs_rows if r[3] == s)
            assert abs(own - t) <= max(3 * longest, 0.1 * t), (s, own, t)


def test_mixing_ids(spark):
    """One id with several texts, and several rows without an id, are documents of their own."""
    text = lambda i: " ".join([f"w{i}"] * 40)
    given = [(7, text(i), "en", "a", 0) for i in range(200)] + [(None, text(1000 + i), "en", "b", 0) for i in range(200)]
    got = rows(STAGE["mixing"](spark, spark.createDataFrame(given, SCHEMA), ""))
    want = taken(given)
    for s in "ab":
        own = [got[r] for r in given if r[3] == s]
        assert abs(40 * sum(own) - want[s]) <= 200 and max(own) <= 2
    assert len({got[r] for r in given}) > 1


def packed_texts(pieces):
    """The ids of each document by its pieces; sequences have no gaps and no padding."""
    import numpy as np

    sequences = collections.defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        total = sum(r.length for r in own)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and total <= 2048 and total & (total - 1) == 0
    found, open_ = [], collections.defaultdict(list)
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):  # a partition's pieces of one document follow each other
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert len(own) == r.length
        open_[r.doc_id, r.doc_tokens].append((r.start, own))
    for (doc, n), parts in open_.items():
        whole = []
        for start, own in parts:
            if start == 0:
                whole.append([])
            (whole[-1] if len(whole) == 1 else next(w for w in reversed(whole) if len(w) == start)).extend(own)
        assert all(len(w) == n for w in whole), (doc, n, [len(w) for w in whole])
        found += [(doc, tuple(w)) for w in whole]
    return collections.Counter(found)


def library_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    return [tuple([*e.ids, 1]) for e in Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_packing(spark, docs_rows):
    """Piece by piece: every row's ids once, each in one place."""
    unique = {r[0]: r for r in docs_rows if r[0] is not None}
    given = list(unique.values())
    got = STAGE["packing"](spark, spark.createDataFrame(given, SCHEMA).repartition(4), "").collect()
    assert packed_texts(got) == collections.Counter((r[0], x) for r, x in zip(given, library_ids([r[1] for r in given]), strict=True))


def test_run(spark, tmp_path, docs_rows):
    """All stages against the same steps in plain Python: what is packed are whole copies of the documents that should be left."""
    from vecsmith.llm.language_id import identify, train

    given = [r for r in {r[0]: r for r in docs_rows if r[0] is not None}.values()]
    spark.createDataFrame(given, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    left = [r for r in given if any(c.isalpha() for c in r[1] or "")]
    best = {}
    for r in left:
        best[lower(r[1])] = max(best.get(lower(r[1]), r[0]), r[0])
    left = [r for r in left if best[lower(r[1])] == r[0]]
    stays = {i for i, _, c in groups_want(left, 5, 80) if i == c}
    left = [r for r in left if r[0] in stays]
    ids = {r[0]: x for r, x in zip(left, library_ids([r[1] for r in left]), strict=True)}
    tokens, firsts = collections.Counter(), collections.Counter()
    for r in got:
        assert r.doc_id in ids and r.doc_tokens == len(ids[r.doc_id])
        assert r.start + r.length <= r.doc_tokens and tuple(__import__("numpy").frombuffer(r.ids, "<u4").tolist()) == ids[r.doc_id][r.start : r.start + r.length]
        tokens[r.doc_id] += r.length
        firsts[r.doc_id] += r.start == 0
    assert all(tokens[i] == firsts[i] * len(ids[i]) and firsts[i] <= 2 for i in ids)
    for s, t in taken(left).items():
        own = [r for r in left if r[3] == s]
        longest = max(len(r[1].encode().split()) for r in own)
        assert abs(sum(firsts[r[0]] * len(r[1].encode().split()) for r in own) - t) <= max(3 * longest, 0.1 * t)
    model = train(spark.createDataFrame(given, SCHEMA))
    assert {r.doc_id for r in identify(spark.createDataFrame(given, SCHEMA), model).collect() if r.lang_pred == "und"} == {r[0] for r in given if not any(c.isalpha() for c in r[1] or "")}
