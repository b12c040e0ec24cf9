import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from vecsmith.llm.components import components
from vecsmith.llm.exact_dedup import exact_dedup
from vecsmith.llm.jaccard_join import jaccard_join
from vecsmith.llm.substring_dedup import difference_cover, substring_dedup


def lower(t):
    return (t or "").encode().lower()


def exact_want(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    out = []
    for r in rows:
        g = groups[lower(r[1])]
        keep = max((i for i in g if i is not None), default=None)
        out.append((r[0], keep, len(g), r[0] == keep, hashlib.sha256(lower(r[1])).hexdigest()))
    return collections.Counter(out)


def test_exact(docs, docs_rows, clashing, empty):
    want = exact_want(docs_rows)
    for df in (docs, clashing):
        assert collections.Counter(map(tuple, exact_dedup(df).collect())) == want
    # identifiers that collide are told apart
    assert collections.Counter(map(tuple, exact_dedup(docs, identify=lambda c: F.xxhash64(c) % 3).collect())) == want
    assert exact_dedup(empty).count() == 0


def spans_want(rows, width):
    count, words = collections.Counter(), []
    for r in rows:
        w = tuple((r[1] or "").encode().split())
        words.append(w)
        count.update(w[i : i + width] for i in range(len(w) - width + 1))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[w[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        out.append((r[0], len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return collections.Counter(out)


@pytest.mark.parametrize("width,period", [(35, 21), (35, 7), (5, 3), (1, 1), (21, 21)])
def test_substrings(docs, docs_rows, width, period):
    got = substring_dedup(docs, width=width, period=period).drop("removed").collect()
    assert collections.Counter(map(tuple, got)) == spans_want(docs_rows, width)


def test_substrings_more(clashing, docs_rows, empty):
    got = substring_dedup(clashing)
    assert collections.Counter(map(tuple, got.drop("removed").collect())) == spans_want(docs_rows, 35)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got.collect())
    assert substring_dedup(empty).count() == 0


@pytest.mark.parametrize("period", [1, 2, 5, 13, 20, 21, 22, 50])
def test_cover(period):
    d = difference_cover(period)
    assert {(a - b) % period for a in d for b in d} == set(range(period))


def shingles(text, width):
    w = tuple(lower(text).split())
    return frozenset([w]) if 0 < len(w) < width else frozenset(w[i : i + width] for i in range(len(w) - width + 1))


def groups_want(rows, width, percent):
    sets = [shingles(r[1], width) for r in rows]
    root = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return collections.Counter((r[0], len(s), None if r[0] is None else find(r[0])) for r, s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (1, 50), (2, 95)])
def test_jaccard(docs, docs_rows, width, percent):
    assert collections.Counter(map(tuple, jaccard_join(docs, width=width, percent=percent).collect())) == groups_want(docs_rows, width, percent)


def test_jaccard_large_group(spark):
    """Near copies on either side of the threshold, linked with the original or only with each other."""
    import random

    rng = random.Random(3)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        w = list(rng.choice(rows)[1].split()) if rng.random() < 0.3 else list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(3)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert collections.Counter(map(tuple, jaccard_join(df).collect())) == groups_want(rows, 4, 85)


def test_jaccard_more(clashing, docs_rows, empty):
    assert collections.Counter(map(tuple, jaccard_join(clashing).collect())) == groups_want(docs_rows, 4, 85)
    assert jaccard_join(empty).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (5, 5), (50, 41), (41, 40), (98, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(42), 50]}, 98: 98, 99: 98, 100: 98}


def near_copies(n, seed=3):
    import random

    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        w = list(rng.choice(rows)[1].split()) if rng.random() < 0.3 else list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(3)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_jaccard_dealt(spark, monkeypatch, width, percent):
    """A large group and long lists, dealt over many small cells."""
    from vecsmith.llm import jaccard_join as J

    monkeypatch.setattr(J, "_CELL", 20)
    monkeypatch.setattr(J, "_LIST", 12)
    rows = near_copies(260, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert collections.Counter(map(tuple, jaccard_join(df, width=width, percent=percent).collect())) == groups_want(rows, width, percent)


def test_jaccard_pairs_stay_few(spark, monkeypatch):
    """What is emitted grows with the rows of a group, not with their square."""
    from vecsmith.llm import jaccard_join as J

    seen = []
    whole = J._answers
    monkeypatch.setattr(J, "_answers", lambda pairs, *a: (seen.append(pairs.count()), whole(pairs, *a))[1])
    rows = near_copies(400, 6)
    J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), width=5, percent=80).count()
    assert seen[0] < 4 * len(rows)


def test_very_long_texts(spark):
    """Texts of some megabytes, two of them alike but for a few words, with a shared passage."""
    import random

    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    other = list(words)
    for _ in range(50):
        other[rng.randrange(len(other))] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[1000:1050])), (4, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in jaccard_join(df).collect()} == set(groups_want(rows, 4, 85))
    got = substring_dedup(df).drop("removed").collect()
    assert collections.Counter(map(tuple, got)) == spans_want(rows, 35)
    assert collections.Counter(map(tuple, exact_dedup(df).collect())) == exact_want(rows)
