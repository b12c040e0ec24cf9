import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, prose
from vecsmith.llm.language_id import Model, identify, train, viterbi
from vecsmith.llm.mixing import mix, shared_targets
from vecsmith.llm.queries import ORACLES, QUERIES
from vecsmith.llm.topk_search import topk_search

DATA = "/root/testdata/sf0.001"


def test_language(spark, docs, docs_rows, clashing, empty):
    model = train(docs)
    assert model.languages == ["de", "el", "en"]
    for df in (docs, clashing):
        got = identify(df, model).collect()
        assert len(got) == len(docs_rows)
        by_id = {r.doc_id: r for r in got}
        assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 and not by_id[i].spans for i in (92, 93, 94, 97))
        assert by_id[98].lang_pred == "en" and by_id[98].score > 0.9
        greek = [r for r in docs_rows if r[1] and r[0] is not None and r[0] < 60 and r[1][0] > "ʹ"]
        assert all(by_id[r[0]].lang_pred == "el" for r in greek)
        assert all(0 <= r.score <= 1 for r in got)
    assert identify(empty, model).count() == 0
    none = train(empty)
    assert {r.lang_pred for r in identify(docs, none).collect()} == {"und"}
    assert train(docs.where("lang is null")).languages == []


def test_spans(spark, docs):
    import random

    rng = random.Random(5)
    a, b = prose(rng, 40, "en"), prose(rng, 40, "el")
    df = spark.createDataFrame([(1, f"{a}. {b}!", None, None, 0)], SCHEMA)
    r = identify(df, train(docs)).first()
    assert [s.lang for s in r.spans] == ["en", "el"] and r.spans[0].end <= len(a) and r.spans[1].start == len(a) + 2


def test_viterbi_against_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    counts = np.array([4, 0, 6, 1, 3])
    scores = rng.normal(size=(counts.sum(), 3)).astype(np.float32)
    got, at = viterbi(scores, counts, 0.7), 0
    for n in counts:
        paths = list(itertools.product(range(3), repeat=int(n)))
        value = lambda p: sum(scores[at + i, s] for i, s in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:], strict=False))  # noqa: B023
        assert np.isclose(value(tuple(got[at : at + n])), max(map(value, paths)), atol=1e-4)
        at += n


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_model_without_letters():
    assert Model([], np.zeros((0, 3, 8)), np.zeros((0, 4))).languages == []


def test_targets():
    assert shared_targets([100, 100, 100], [5, 2, 1], 450, 2) == [200, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert shared_targets([], [], 0, 2) == []
    assert sum(shared_targets([1, 1000, 3], [5, 2, 1], 1506, 2)) == pytest.approx(1506)


def test_mix(docs, docs_rows, clashing, empty):
    runs = [sorted(map(repr, mix(df).drop("rate").collect())) for df in (docs, docs.repartition(3), clashing)]
    assert runs[0] == runs[1] == runs[2]
    got = mix(docs).collect()
    size = lambda t: len((t or "").encode().split())
    assert collections.Counter((r.doc_id, r.source, r.size) for r in got) == collections.Counter((r[0], r[3], size(r[1])) for r in docs_rows)
    sources = sorted({r[3] for r in docs_rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(size(r[1]) for r in docs_rows if r[3] == s) for s in sources]
    want = shared_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))], 1.5 * sum(sizes), 2)
    for s, n, t in zip(sources, sizes, want, strict=True):
        own = [r for r in got if r.source == s]
        assert all(r.source_size == n and r.target == pytest.approx(t) for r in own)
        assert abs(sum(r.taken for r in own) - t) <= 1
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert mix(empty).count() == 0
    assert all(r.taken == r.copies * r.size for r in mix(docs, trim=False).collect())


def test_mix_cut_copies(spark):
    """A cap that is no whole number: a source of many documents gets its target by cut copies."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 4 == 0]) for i in range(4000)], "doc_id long, text string, source string")
    for share in (1.2, 1.5):
        got = mix(docs, weights=(3.0, 1.0), share=share, cap=1.5).collect()
        assert all(0 <= r.taken == r.copies * r.size + r.part <= 1.5 * r.size for r in got)
        for s in "ab":
            own = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in own) - min(own[0].target, sum(int(1.5 * r.size) for r in own))) <= 1
    with pytest.raises(ValueError):
        mix(docs, cap=1.5, trim=False)


VECTORS = "vec_id long, embedding array<float>, q string, rank int"


def topk_want(rows, k, asked):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, v in ok:
        if asked(i):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in ok if j != i)
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("scale", [1.0, 1e4])
def test_topk(spark, scale):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=10) * scale).astype(np.float32).tolist(), "q", 1) for i in range(300)]
    rows += [(400, [1.0] * 10, "q", 1), (401, [1.0] * 10, "q", 1), (402, None, "q", 1), (403, [float("nan")] * 10, "q", 1), (404, [None] + [1.0] * 9, "q", 1), (405, [float("inf")] * 10, "q", 1), (None, [1.0] * 10, "q", 1), (450, [0.5] * 4, "q", 1), (500, [], "q", 1)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    for block in (2048, 2):
        got = topk_search(df, df.where("vec_id % 50 = 0"), query_block=block)
        assert {tuple(r) for r in got.collect()} == topk_want(rows, 5, lambda i: i % 50 == 0)


def test_topk_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], "", 0), (50, [1.0, 1.0], "", 0)], VECTORS)
    assert {tuple(r) for r in topk_search(df, df).select("query_id", "vec_id").collect()} == {(0, 50), (50, 0)}
    assert topk_search(df.limit(1), df.limit(1)).count() == 0
    none = df.where("vec_id < 0")
    assert topk_search(none, none).count() == 0


def test_topk_repeated_queries(spark):
    """Rows that repeat a query id are queries of their own, in one block or several."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist(), "", 0) for i in range(60)]
    twice = [(50, rng.normal(size=6).astype(np.float32).tolist(), "", 0), (50, rows[50][1], "", 0)]
    df = spark.createDataFrame(rows + twice, VECTORS).repartition(3)
    want = collections.Counter()
    every = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v, *_ in rows + twice]
    for i, v in every:
        if i == 50:
            scored = sorted((-int(v @ w), j) for j, w in every if j != i)
            want.update((i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:5]))
    for block in (2048, 2, 1):
        got = topk_search(df, df.where("vec_id = 50"), query_block=block)
        assert collections.Counter(tuple(r) for r in got.collect()) == want


def test_topk_norms(spark):
    """Rows too short to reach any cutoff are passed over; the answers are those of brute force."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8) * (0.01 if i % 3 else 1)).astype(np.float32).tolist(), "", 0) for i in range(400)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = topk_search(df, df.where("vec_id % 50 = 0"))
    assert {tuple(r) for r in got.collect()} == topk_want(rows, 5, lambda i: i % 50 == 0)


def dual(sizes, target, cap=2.0):
    """The tilt by bisection, in plain Python: rates exp(l * size / mean) up to the cap add up to the target."""
    import math

    mean = sum(sizes) / len(sizes)
    rate = lambda tilt, s: min(cap, math.exp(min(tilt * s / mean, 50.0))) if s else 1.0
    low, high = -1000.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(s * rate(mid, s) for s in sizes) < target else (low, mid)
    return [rate(high, s) for s in sizes]


def test_tilts_and_copies_against_bisection(spark):
    """Rates by an independent solution of the dual; copies are those rates rounded within classes of size."""
    import random

    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), "abcd"[min(3, int(rng.expovariate(1)))]) for i in range(3000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6), trim=False).collect()
    sources = sorted({r[2] for r in rows})
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in sources}
    total = 1.5 * sum(sizes.values())
    weight = dict(zip(sources, (5, 2, 1, 5), strict=True))
    # water filling by bisection on the level
    low, high = 0.0, total
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[s], mid * weight[s]) for s in sources) < total else (low, mid)
    for s in sources:
        own = [r for r in got if r.source == s]
        target = min(2 * sizes[s], high * weight[s])
        assert own[0].target == pytest.approx(target, rel=1e-6)
        rates = dual([r.size for r in own], target)
        bands = collections.defaultdict(lambda: [0.0, 0])
        for r, rate in zip(own, rates, strict=True):
            if r.size:
                band = bands[int(np.floor(np.log2(r.size + 1) * 2))]
                band[0] += rate
                band[1] += r.copies
                assert np.floor(rate - 1e-6) <= r.copies <= np.ceil(rate + 1e-6)
        assert all(abs(a - b) <= 1.0 for a, b in bands.values())


def test_mix_misses_of_any_size(spark, monkeypatch):
    """However much rounding has missed, and with one row a cell or all rows in one, targets are met to the word."""
    from vecsmith.llm import mixing

    docs = spark.createDataFrame([(i, "w " * (1 + (i * 37) % 90), "ab"[i % 5 == 0]) for i in range(2000)], "doc_id long, text string, source string")
    for cells, rows in ((1, 10**9), (256, 1)):
        monkeypatch.setattr(mixing, "_CELLS", cells)
        monkeypatch.setattr(mixing, "_CELL_ROWS", rows)
        monkeypatch.setattr(mixing, "_UNIT", 2)  # coarse rates: large misses
        got = mix(docs).collect()
        for s in "ab":
            own = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert all(0 <= r.taken <= 2 * r.size for r in got) and len(got) == 2000


def test_tilts_do_not_end_early(spark):
    from vecsmith.llm.mixing import tilts

    histogram = spark.createDataFrame([(0, s, 3) for s in range(1, 50)], "sid int, size long, n long")
    source = [{"sid": 0, "size": 3 * sum(range(1, 50)), "rows": 147, "target": 5000.0}]
    with pytest.raises(RuntimeError):
        tilts(histogram, source, most=1)


def test_word_scores_by_hand(spark):
    """Scores from n-grams counted in plain Python, with the languages that a word's script leaves."""
    from vecsmith.llm import language_id as L

    texts = {"en": ["the cat and the hat", "that then"], "de": ["der hut und die katze", "dann"], "el": ["και το", "των"]}
    rows = [(i, t, x, None, 0) for i, (x, t) in enumerate((x, t) for x, own in texts.items() for t in own)]
    model = train(spark.createDataFrame(rows, SCHEMA))
    languages = sorted(texts)

    def grams(word):
        w = "\0" + word + "\0"
        for order, n in enumerate(L.ORDERS):
            for i in range(len(w) - n + 1):
                if n == 1 and w[i] == "\0":
                    continue
                h = n
                for c in w[i : i + n]:
                    h = (h * 0x100000001B3 + ord(c)) & (2**64 - 1)
                yield order, int(L.mix(np.array([h], np.uint64))[0]) & (L.BUCKETS - 1)

    counts = {x: collections.Counter(g for t in own for w in t.split() for g in grams(w)) for x, own in texts.items()}
    log = lambda x, g: np.log((counts[x][g] + 0.5) / (sum(n for (o, _), n in counts[x].items() if o == g[0]) + 0.5 * L.BUCKETS))
    for word in ("then", "katze", "hut", "το"):
        want = np.array([sum(log(x, g) for g in grams(word)) for x in languages])
        greek = word == "το"
        allowed = np.array([(x == "el") == greek for x in languages])
        best = want.argmax()
        got = model.word_scores(L._Words([word]))[0]
        assert np.allclose(got[allowed], (want - want[best])[allowed], atol=1e-3) and (got[~allowed] < -1e3).all()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    show = lambda f: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)))
    assert show(got) == show(want.astype(got.dtypes.to_dict()))
