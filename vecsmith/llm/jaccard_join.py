"""N-gram Jaccard join by set relations: skipping in index lists and between answers.

Documents with equal shingle sets form one class. Classes are listed under the
rarest shingles of their sets (a prefix that two sets of the needed overlap must
share). A list is not paired out. Every class joins the group of the set, of those in its
lists, that resembles most others, and a group has a pivot: what most of its sets
hold (in a small group, that set itself). Answers within a group are derived from
each set's answer about the pivot, the more alike the more of them:

* With overlaps o and p with the pivot P, two sets overlap by o + p - |P| at least.
  The member that this favours most links all that any such bound links.
* For the others the exact overlap is o + p - |P| and what their differences to P have
  in common. Differences are short; sets are compared by them in cells of bounded size,
  where a set skips its own component and all that the overlaps with P rule out. A
  cell tells which components it joins, so its answers grow with its rows.

The first lists skip all pairs of a group's near members, by block, and those of one component. What is
left is compared one by one, skipping by size and by position in the list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsmith.llm.common import batches_of_rows, mix, scratch_removed, signed, stored, task, window_hashes, word_hashes
from vecsmith.llm.components import components

WORDS, PERCENT = 4, 85
_BLOOM = 1 << 26
#: Groups of so many sets have a pivot by majority; smaller ones take the set they asked.
_LARGE = 8
_JUMPS = 2
#: Rows of a group, and of a list, that one cell holds; more are dealt to cells of two blocks.
_CELL, _LIST = 2048, 16_384


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of the whole, if it has fewer words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    if len(words) < width:
        return window_hashes(hashes, len(words)) ^ np.uint64(mix(np.array([len(words)], np.uint64))[0])
    return np.unique(window_hashes(hashes, width))


def needed(size: int, percent: int) -> int:
    """The least overlap of a set of this size with any set it links with."""
    return -(-percent * size // 100)


def _class_key(hashes: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(hashes.tobytes())
    a, b = np.frombuffer(d, np.int64)
    return int(a), int(b)


def _parts(percent: int) -> int:
    """Into how many parts the hash range goes: the first holds the prefix of most sets, with room to choose rare shingles."""
    return max(1, min(256, 60 // max(100 - percent, 1)))


def _listed(hashes: np.ndarray, percent: int) -> tuple[int, bool]:
    """How many of the sorted hashes a class is listed under at most, and whether these go beyond the first part.

    Shingles are ordered by part of the hash range, then by frequency. The
    listed ones are whole parts, enough to hold the prefix.
    """
    prefix = len(hashes) - needed(len(hashes), percent) + 1
    part = ((hashes >> np.uint64(56)).astype(np.int64) * _parts(percent)) >> 8
    last = int(part[min(prefix, len(hashes)) - 1])
    return int(np.searchsorted(part, last, side="right")), last > 0


_SETS = "doc_id long, c1 long, c2 long, n long, listed long, wide boolean, hashes array<long>"


@task
def _sets(batches, width, percent):
    """Size and class of each document's set; for the first document of a class in a batch also what it is listed under."""
    for batch in batches_of_rows(batches):
        seen, rows = set(), []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            h = shingle_hashes(text, width)
            key, (listed, wide) = _class_key(h), _listed(h, percent) if len(h) else (0, False)
            rows.append((doc, *key, len(h), listed, wide, signed(h[:listed]) if listed and key not in seen else None))
            seen.add(key)
        kinds = (*(pa.int64(),) * 5, pa.bool_(), pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "c1", "c2", "n", "listed", "wide", "hashes"])


@task
def _wanted_sets(batches, width, bits):
    """The whole sets of the documents that the filter lets through, once for each class of a batch."""
    bits = bits.value
    for batch in batches_of_rows(batches):
        at = batch.column("doc_id").to_numpy(zero_copy_only=False) & (_BLOOM - 1)
        batch = batch.filter(pa.array((bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
        seen, rows = set(), []
        for text in batch.column("text").to_pylist():
            h = shingle_hashes(text, width)
            if len(h) and (key := _class_key(h)) not in seen:
                seen.add(key)
                rows.append((*key, signed(h)))
        if rows:
            yield pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["c1", "c2", "shingles"])


def _filter_bits(wanted: DataFrame) -> np.ndarray:
    """A bit for each node, at its id modulo a fixed number: at most 8 MB, whatever the input."""
    at = F.col("node").bitwiseAND(F.lit(_BLOOM - 1))
    words = wanted.select(F.shiftright(at, 6).alias("w"), F.expr("shiftleft(1L, cast(node & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(_BLOOM >> 6, np.uint64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _answers(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b), those whose sets link."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").withColumn("overlap", F.size(F.array_intersect("_a", "_b")))
    return both.where(F.lit(100) * F.col("overlap") >= F.lit(percent) * (F.size("_a") + F.size("_b") - F.col("overlap"))).select("a", "b")


_ROW = ("node", "n", "pos", "alone", "root", "asked", "overlap", "near")
_CORE = 1 << 60


def _least(n, m, percent):
    """The least overlap at which sets of these sizes link."""
    return -(-percent * (n + m) // (100 + percent))


def _of_list(t, percent):
    """Pairs of one list (rows in order of size) that may still link.

    Near members of one group skip each other, and so do sets of one component;
    other members of a group are bounded by their overlaps with its pivot.
    ``alone`` counts shingles at the list's beginning that no other set has: they
    cannot be common.
    """
    n, pos, alone, root, asked, overlap, near, node, side = (t[c] for c in (*_ROW[1:], "node", "side"))
    whole = side[0] < 0
    for i in range(len(n)) if not whole else range(1, len(n)):
        if whole:
            lo, hi = int(np.searchsorted(n[:i], -(-percent * n[i] // 100))), i
        elif side[i]:
            continue
        else:
            lo, hi = int(np.searchsorted(n, -(-percent * n[i] // 100))), int(np.searchsorted(n, 100 * n[i] // percent, side="right"))
        k = slice(lo, hi)
        ok = root[k] != root[i]
        if not whole:
            ok &= side[k] > 0
        if not ok.any():
            continue
        least, together = _least(n[k], n[i], percent), (asked[k] == asked[i]) & (asked[i] >= 0)
        rest = 1 + np.minimum(n[k] - pos[k] - 1, n[i] - pos[i] - 1) + np.minimum(pos[k] - alone[k], pos[i] - alone[i])
        some = np.minimum(n[k] - alone[k], n[i] - alone[i])
        by_pivot = np.minimum(overlap[k], overlap[i]) + np.minimum(n[k] - overlap[k], n[i] - overlap[i])
        ok &= (rest >= least) & (some >= least) & ~(together & ((near[k] & near[i]) | (by_pivot < least)))
        if ok.any():
            other = node[k][ok]
            yield np.minimum(other, node[i]), np.maximum(other, node[i])


def _of_cell(t, percent):
    """Links that join the components of one cell of a group: exact answers from the differences to the pivot.

    With r shingles of the pivot P missing, two sets overlap by |P| - r1 - r2 and
    what their differences have in common. Sets that no bound rules out are counted in
    the lists of the cell's differences; what joins one component is skipped after.
    """
    n, over, pivot, root, node, side = (t[c] for c in ("n", "overlap", "pivot", "root", "node", "side"))
    root, missing, whole = root.copy(), pivot - over, side[0] < 0
    owner = np.repeat(np.arange(len(n)), t["sizes"])
    _, which, times = np.unique(t["diff"], return_inverse=True, return_counts=True)
    several = times[which] > 1
    owner, which = owner[several], which[several]
    shared = np.bincount(owner, minlength=len(n))
    edge = np.concatenate([[0], np.cumsum(shared)])  # rows of ``which`` lie by owner
    lists = owner[np.argsort(which, kind="stable")]
    upto = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(times)))])
    for i in range(len(n)):
        k = np.arange(i) if whole else np.flatnonzero(side > 0) if not side[i] else np.empty(0, np.int64)
        k = k[(root[k] != root[i]) & (100 * np.minimum(n[k], n[i]) >= percent * np.maximum(n[k], n[i]))]
        if not len(k):
            continue
        least, apart = _least(n[k], n[i], percent), pivot[i] - missing[i] - missing[k]
        most = np.minimum(apart + np.minimum(shared[k], shared[i]), np.minimum(over[k], over[i]) + np.minimum(n[k] - over[k], n[i] - over[i]))
        ok = most >= least
        if not ok.any():
            continue
        own = which[edge[i] : edge[i + 1]]
        common = np.bincount(np.concatenate([lists[upto[e] : upto[e + 1]] for e in own]), minlength=len(n)) if len(own) else np.zeros(len(n), np.int64)
        hit = k[ok & (apart + common[k] >= least)]
        if len(hit):
            joined, at = np.unique(root[hit], return_index=True)
            root[np.isin(root, joined)] = root[i]
            yield np.full(len(joined), node[i]), node[hit[at]]


def _by_key(batches, keys, columns, of):
    """``of`` for the rows of each key: rows come sorted by ``keys``, and those of one may go over batches."""
    held, last = [], None

    def columns_of(batch):
        t = {}
        for c in columns:
            if pa.types.is_list(batch.column(c).type):
                t["sizes"], t[c] = batch.column(c).value_lengths().to_numpy(zero_copy_only=False), batch.column(c).flatten().to_numpy(zero_copy_only=False)
            else:
                t[c] = batch.column(c).to_numpy(zero_copy_only=False)
        return t

    def out():
        parts = [columns_of(b) for b in held]
        t = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        if len(t["node"]) > 1:
            for a, b in of(t):
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in key:
            new[1:] |= c[1:] != c[:-1]
        edge = [0, *np.flatnonzero(new), batch.num_rows]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            this = tuple(int(c[a]) for c in key)
            if held and this != last:
                yield from out()
                held = []
            held.append(batch.slice(a, b - a))
            last = this
    if held:
        yield from out()


def _merged(batches):
    """Small results of one task as few batches."""
    waiting, rows = [], 0
    for b in batches:
        waiting.append(b)
        rows += b.num_rows
        if rows >= 10_000 or len(waiting) >= 1000:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, rows = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


@task
def _list_pairs(batches, percent):
    yield from _merged(_by_key(batches, ("h", "cell"), (*_ROW, "side"), lambda t: _of_list(t, percent)))


@task
def _cell_links(batches, percent):
    columns = ("node", "n", "overlap", "pivot", "root", "side", "diff")
    yield from _merged(_by_key(batches, ("asked", "cell"), columns, lambda t: _of_cell(t, percent)))


def _dealt(rows: DataFrame, keys: list[str], order: list[str], core, at_most: int) -> DataFrame:
    """Rows with ``cell`` and ``side``, dealt so that all rows of a key that fit one cell meet there.

    Larger keys are cut into blocks by a hash of the node; a cell holds one block (side -1) or two (0
    and 1). ``core`` rows have one component; their blocks meet only those of the others. ``m`` and ``m_core``
    count a key's rows.
    """
    rest, small = F.col("m") - F.col("m_core"), F.col("m") <= at_most
    blocks = lambda c: F.ceil(c / F.lit(at_most // 2)).cast("long")
    gs, gc = blocks(rest), blocks(F.col("m_core"))
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.when(core, gc).otherwise(gs))
    to = lambda low, high, side: F.struct((F.shiftleft(low, 24) + high).alias("cell"), side.cast("int").alias("side"))
    each = lambda g, f: F.when(g > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(g, F.lit(1)) - 1), f))
    others = each(gs, lambda b: to(F.least(F.col("_own"), b), F.greatest(F.col("_own"), b), F.when(b == F.col("_own"), -1).otherwise((F.col("_own") > b).cast("int"))))
    with_core = F.coalesce(each(gc, lambda c: to(F.col("_own"), c + F.lit(_CORE), F.lit(0))), F.array().cast("array<struct<cell:bigint,side:int>>"))
    of_core = F.coalesce(each(gs, lambda b: to(b, F.col("_own") + F.lit(_CORE), F.lit(1))), F.array().cast("array<struct<cell:bigint,side:int>>"))
    one = F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.lit(-1).alias("side")))
    cells = F.when(small, one).when(core, of_core).otherwise(F.concat(others, with_core))
    dealt = rows.withColumn("_own", own).withColumn("_to", F.explode(cells)).select("*", "_to.cell", "_to.side").drop("_to", "_own", "m", "m_core")
    return dealt.repartition(*keys, "cell").sortWithinPartitions(*keys, "cell", *order)


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n, node) and links (a, b) that connect each component's nodes.

    A node is the smallest id of the documents with one set; documents without
    words, and those with a null id, have none.
    """
    spark = docs.sparkSession
    parts = _parts(percent)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = stored(slim.mapInArrow(lambda it: _sets(it, width, percent), _SETS), "known", "lz4")
    nodes = stored(known.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("listed").alias("listed"), F.first("wide").alias("wide")).where("node is not null"), "nodes")

    entries = known.where("hashes is not null").select(F.explode("hashes").alias("h"), "c1", "c2")
    # shingles of one class only need no list
    several = entries.select("h", F.col("c1").bitwiseXOR(F.col("c2")).alias("c")).groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count(F.lit(1)).alias("df")).where("x <> y").select("h", "df")
    several = stored(several, "several")
    part = F.shiftright(F.expr("shiftrightunsigned(h, 56)") * parts, 8)
    shared = entries.join(several, "h").groupBy("c1", "c2").agg(F.collect_set(F.struct(part.alias("part"), "df", "h")).alias("shared"))
    # rank in the order (part, frequency, hash); shingles of one class only come before
    alone = F.col("listed") - F.size("shared")
    prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / F.lit(100)).cast("long") + 1
    take = F.when(F.col("wide"), F.size("shared")).otherwise(F.greatest(F.lit(0), F.least(F.size("shared").cast("long"), prefix - alone))).cast("int")
    ranked = shared.join(nodes, ["c1", "c2"]).select(
        "node", "c1", "c2", "n", (F.aggregate("shared", F.lit(0.0), lambda s, x: s + x["df"]) / F.col("listed")).alias("resembled"), F.when(F.col("wide"), F.lit(0)).otherwise(alone).alias("alone"),
        F.slice(F.array_sort("shared"), F.lit(1), take).alias("list"),
    ).where("size(list) > 0")
    ranked = stored(ranked, "ranked")
    lists = ranked.select("node", "n", "resembled", "alone", F.posexplode("list").alias("i", "s")).select("node", "n", "resembled", F.col("alone").cast("long").alias("alone"), (F.col("alone") + F.col("i")).cast("long").alias("pos"), F.col("s.h").alias("h"))
    # the set of each list that most sets resemble
    best = lists.groupBy("h").agg(F.max(F.struct("resembled", "node", "n")).alias("best"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    lists = stored(lists.join(best, "h"), "lists")

    wanted = stored(lists.select("node").distinct().join(ranked.select("node", "c1", "c2"), "node"), "wanted")
    bits = spark.sparkContext.broadcast(_filter_bits(wanted))
    sets = slim.where("doc_id is not null").mapInArrow(lambda it: _wanted_sets(it, width, bits), "c1 long, c2 long, shingles array<long>")
    sets = stored(sets.join(wanted, ["c1", "c2"]).groupBy("node", "c1").agg(F.first("shingles").alias("shingles")).select("node", "shingles"), "sets", "lz4")

    groups = stored(_groups(lists, sets, percent), "groups", "lz4")
    # the member by which the bound o + p - |P| links most, and what it links
    worth = F.lit(100 + percent) * F.col("overlap") - F.lit(percent) * F.col("n")
    first = groups.where("near").groupBy("asked").agg(F.max(F.struct(worth.alias("worth"), "node")).alias("first"))
    sure = F.col("near") & (worth + F.col("first.worth") >= F.lit(100 + percent) * F.col("pivot")) | (F.col("node") == F.col("first.node"))
    rooted = groups.join(first, "asked", "left").withColumn("core", F.coalesce(sure, F.lit(False))).withColumn("root", F.when(F.col("core"), F.col("first.node")).otherwise(F.col("node"))).drop("first")
    counts = rooted.where("near").groupBy("asked").agg(F.count(F.lit(1)).alias("m"), F.count_if("core").alias("m_core")).where("m > m_core")
    cells = _dealt(rooted.where("near").join(counts, "asked").select("asked", "node", "n", "overlap", "pivot", "root", "diff", "core", "m", "m_core"), ["asked"], [], F.col("core"), _CELL)
    found = cells.drop("core").mapInArrow(lambda it: _cell_links(it, percent), "a long, b long")
    links = stored(rooted.where("root <> node").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(found), "links")
    roots = components(links)

    facts = groups.select("node", "asked", "overlap", "near").join(roots, "node", "full").select("node", F.coalesce("asked", F.lit(-1)).alias("asked"), F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"), F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("root", "node").alias("root"))
    rows = lists.select("h", "node", "n", "pos", "alone").join(facts, "node", "left").withColumns({"asked": F.coalesce("asked", F.lit(-1).cast("long")), "overlap": F.coalesce("overlap", F.lit(0).cast("long")), "near": F.coalesce("near", F.lit(False)), "root": F.coalesce("root", "node")})
    # lists of one component, or of one group's near members, are skipped whole
    at = F.when(F.col("near"), F.col("asked")).otherwise(-1 - F.col("node"))
    open_ = rows.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min(at).alias("v"), F.max(at).alias("w"), F.count(F.lit(1)).alias("m")).where("x <> y and v <> w").select("h", "m", F.lit(0).cast("long").alias("m_core"))
    pairs = _dealt(rows.join(open_, "h"), ["h"], ["n", "pos"], F.lit(False), _LIST).mapInArrow(lambda it: _list_pairs(it, percent), "a long, b long")
    last = stored(_answers(pairs.distinct(), sets, percent), "last")
    return known.join(nodes.select("c1", "c2", "node"), ["c1", "c2"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")), links.unionByName(last)


def _groups(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, asked, n, overlap, pivot, near, diff): each listed set's group and how it differs from the pivot.

    ``pivot`` is the pivot's size. Sets that resemble the pivot at half of the threshold are near: ``diff`` has
    what they hold beyond it and what they lack of it.
    """
    fits = F.lit(100) * F.least("n", "best.n") >= F.lit(percent) * F.greatest("n", "best.n")
    asks = lists.where(fits & (F.col("best.node") != F.col("node"))).groupBy("node").agg(F.max(F.struct("best.resembled", "best.node")).alias("ask")).select("node", F.col("ask.node").alias("asked"))
    asks = stored(asks, "asks")
    for _ in range(_JUMPS):  # those that ask in turn take along who asks them
        up = asks.select(F.col("node").alias("_at"), F.col("asked").alias("_up"))
        asks = stored(asks.join(up, F.col("asked") == F.col("_at"), "left").select("node", F.coalesce("_up", "asked").alias("asked")), "asks")
    heads = asks.select(F.col("asked").alias("node")).distinct()
    members = asks.unionByName(heads.join(asks, "node", "left_anti").select("node", F.col("node").alias("asked")))
    members = stored(members.join(sets, "node").select("node", "asked", "shingles"), "members", "lz4")
    count = members.groupBy("asked").agg(F.count(F.lit(1)).alias("m"))
    large = stored(count.where(F.col("m") >= _LARGE), "large")
    votes = members.join(large, "asked").select("asked", "m", F.explode("shingles").alias("h")).groupBy("asked", "m", "h").agg(F.count(F.lit(1)).alias("k"))
    pivots = votes.where("2 * k > m").groupBy("asked").agg(F.collect_list("h").alias("pivot"))
    own = members.where("node = asked").join(large, "asked", "left_anti").select("asked", F.col("shingles").alias("pivot"))
    pivots = stored(own.unionByName(pivots), "pivots", "lz4")
    both = members.join(pivots, "asked").withColumns({"n": F.size("shingles").cast("long"), "pivoted": F.size("pivot").cast("long"), "overlap": F.size(F.array_intersect("shingles", "pivot")).cast("long")})
    near = F.lit(200) * F.col("overlap") >= F.lit(percent) * (F.col("n") + F.col("pivoted") - F.col("overlap"))
    diff = F.concat(F.array_except("shingles", "pivot"), F.array_except("pivot", "shingles"))
    return both.select("node", "asked", "n", "overlap", F.col("pivoted").alias("pivot"), near.alias("near"), F.when(near, diff).alias("diff"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``.

    Sets hold the distinct ``width``-word shingles after lower-casing A-Z; of a
    shorter text, all its words as one. Two documents link when the Jaccard
    similarity is ``percent`` / 100 or more, in integers. ``component_id`` is the smallest id
    reachable. Null, empty and wordless texts have an empty set and only
    themselves. Rows with a null id link with nothing (component null); rows
    that repeat an id are one document; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with scratch_removed(spark) as keep:
        known, links = jaccard_links(docs, id_col, text, width, percent)
        found = components(links)
        known = stored(known, "nodes")
        keep += [known, found]
    out = known.join(found, "node", "left")
    root = F.coalesce("root", "node", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), root).alias("component_id"))
