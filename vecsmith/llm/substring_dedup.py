"""Repeated word windows, found by difference-cover anchors.

With a difference cover of a period, any two equal windows have a common offset
at which both positions (modulo the period) lie in the cover. So only short
anchor windows at cover positions are hashed and compared; an anchor that occurs
twice is extended: the full windows around it are hashed and compared in turn.

Occurrences of one hash are never paired. Each task sends one row for a hash
that it saw once; of a hash that it saw at several places it already knows that
these repeat, and sends one row for the other tasks, so a hash has at most as
many rows as there are batches. A place is a (text, position); equal texts are
one text, and those that several documents have repeat from end to end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsmith.llm.common import batches_of_rows, mix, signed, stored, task, window_hashes, word_hashes

WIDTH, PERIOD = 35, 21
#: A perfect difference set modulo 21.
_COVER_21 = (3, 6, 7, 12, 14)
_PLACES = "h long, h2 long, k1 long, k2 int, pos long, known boolean"
_FOUND = "k1 long, k2 int, pos long"


def difference_cover(period: int) -> tuple[int, ...]:
    """Residues among which every difference modulo ``period`` occurs."""
    if period == 21:
        return _COVER_21
    step = int(np.ceil(np.sqrt(period)))
    return tuple(sorted({*range(min(step, period)), *(min(i, period - 1) for i in range(step, period + step, step))}))


def _places(h, h2, k1, k2, pos):
    """Rows to send for the places in a batch: see the module's text."""
    order = np.lexsort((pos, k2, k1, h2, h))
    h, h2, k1, k2, pos = (x[order] for x in (h, h2, k1, k2, pos))
    new = np.ones(len(h), bool)  # not the place before (equal texts give equal places)
    new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (pos[1:] != pos[:-1])
    h, h2, k1, k2, pos = (x[new] for x in (h, h2, k1, k2, pos))
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
    again = ~first
    again[:-1] |= ~first[1:]
    again = np.flatnonzero(again)  # places that repeat within the batch
    # they need no partner: they go out under hashes of their own, which spreads them
    spread = signed(mix(signed(k1[again]).view(np.uint64) + pos[again].astype(np.uint64)))
    n, m = int(first.sum()), len(again)
    cut = lambda x: np.concatenate([x[first], x[again]])
    return pa.record_batch({
        "h": pa.array(np.concatenate([signed(h[first]), spread])), "h2": pa.array(np.concatenate([signed(h2[first]), np.arange(m)])),
        "k1": pa.array(signed(cut(k1))), "k2": pa.array(cut(k2), pa.int32()), "pos": pa.array(cut(pos)), "known": pa.array(np.repeat([False, True], [n, m])),
    })


def _joined(parts):
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


@task
def _anchors(batches, width, period):
    cover, short = np.array(difference_cover(period)), width - period + 1
    for batch in batches_of_rows(batches, 10_000, 32 << 20):
        parts = []
        for text, k1, k2 in zip(*(batch.column(c).to_pylist() for c in ("text", "k1", "k2")), strict=True):
            words = text.encode().split() if text else []
            if len(words) < width:
                continue
            h = window_hashes(word_hashes(words), short)
            at = np.arange(len(h))
            at = at[np.isin(at % period, cover)]
            parts.append((h[at], np.zeros(len(at), np.uint64), np.full(len(at), k1, np.int64).view(np.uint64), np.full(len(at), k2, np.int32), at))
        if parts:
            yield _places(*_joined(parts))


@task
def _windows(batches, width, period):
    for batch in batches_of_rows(batches):
        parts = []
        for text, k1, k2, near in zip(*(batch.column(c).to_pylist() for c in ("text", "k1", "k2", "near")), strict=True):
            hashes = word_hashes(text.encode().split())
            n = len(hashes) - width + 1
            mark = np.zeros(len(hashes) + period, np.int32)  # windows that hold one of the anchors
            near = np.array(near)
            np.add.at(mark, np.maximum(near - period + 1, 0), 1)
            np.add.at(mark, near + 1, -1)
            at = np.flatnonzero(np.cumsum(mark)[:n] > 0)
            parts.append((window_hashes(hashes, width)[at], window_hashes(hashes, width, 1)[at], np.full(len(at), k1, np.int64).view(np.uint64), np.full(len(at), k2, np.int32), at))
        if parts:
            yield _places(*_joined(parts))


@task
def _repeated(batches):
    """Places whose hash another place has, from rows sorted by hash; a run may go over batches."""
    held = None
    for batch in batches:
        table = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if held is not None:
            table = {c: np.concatenate([held[c], table[c]]) for c in table}
        h, h2 = table["h"], table["h2"]
        if not len(h):
            continue
        edge = np.flatnonzero((h[1:] != h[:-1]) | (h2[1:] != h2[:-1])) + 1
        last = edge[-1] if len(edge) else 0
        held = {c: x[last:] for c, x in table.items()}
        yield from _of_runs({c: x[:last] for c, x in table.items()})
    if held is not None:
        yield from _of_runs(held)


def _of_runs(t):
    n = len(t["h"])
    if not n:
        return
    first = np.ones(n, bool)
    first[1:] = (t["h"][1:] != t["h"][:-1]) | (t["h2"][1:] != t["h2"][:-1])
    run = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    other = (t["k1"] != t["k1"][at][run]) | (t["k2"] != t["k2"][at][run]) | (t["pos"] != t["pos"][at][run])
    several = np.zeros(len(at), bool)
    several[run[other]] = True
    out = t["known"] | several[run]
    if out.any():
        yield pa.record_batch({"k1": pa.array(t["k1"][out], pa.int64()), "k2": pa.array(t["k2"][out], pa.int32()), "pos": pa.array(t["pos"][out], pa.int64())})


def _by_text(places: DataFrame, name: str) -> DataFrame:
    """Repeated places, as one list of positions for each text."""
    found = places.repartition("h").sortWithinPartitions("h", "h2").mapInArrow(_repeated, _FOUND)
    return found.groupBy("k1", "k2").agg(F.collect_set("pos").alias(name))


@task
def _cut(batches, width):
    for batch in batches_of_rows(batches):
        words_of, removed_of, kept_of, spans_of = [], [], [], []
        for text, copied, starts in zip(*(batch.column(c).to_pylist() for c in ("text", "copied", "starts")), strict=True):
            words = text.encode().split() if text else []
            n = len(words)
            gone = np.zeros(n, bool)
            if copied and n >= width:
                gone[:] = True
            elif starts:
                mark = np.zeros(n + 1, np.int32)
                np.add.at(mark, np.array(starts), 1)
                np.add.at(mark, np.array(starts) + width, -1)
                gone = np.cumsum(mark)[:n] > 0
            edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            spans_of.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            kept_of.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(words))
            words_of.append(n)
            removed_of.append(int(gone.sum()))
        rest = [c for c in batch.schema.names if c not in ("text", "copied", "starts")]
        yield pa.record_batch(
            [*(batch.column(c) for c in rest), pa.array(words_of, pa.int64()), pa.array(removed_of, pa.int64()), pa.array(kept_of, pa.binary()).cast(pa.string()), pa.array(spans_of, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            names=[*rest, "n_words", "n_removed", "kept", "removed"],
        )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, period: int = PERIOD) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed) of each row of ``docs``.

    Words are runs of other characters than space and U+0009 to U+000D. A word
    goes if a window of ``width`` words that covers it starts anywhere else too,
    in the same document or another; windows are judged on the input.
    ``kept`` has the other words joined by one space, ``removed`` the word spans
    that went. Null and empty texts have no words; equal texts and repeated rows
    are copies of each other, whatever their ids; ids may be null; an empty table gives
    an empty result.
    """
    if not 1 <= period <= width:
        raise ValueError("the period must lie between 1 and the width")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.hash("text")})
    near = _by_text(slim.select("text", "k1", "k2").mapInArrow(lambda it: _anchors(it, width, period), _PLACES), "near")
    copies = slim.where("text is not null").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    marks = near.select("k1", "k2", "near", F.lit(False).alias("copied")).unionByName(copies.select("k1", "k2", F.lit(None).cast("array<long>").alias("near"), F.lit(True).alias("copied")))
    marks = stored(marks.groupBy("k1", "k2").agg(F.first("near", ignorenulls=True).alias("near"), F.max("copied").alias("copied")), "marks")
    marked = stored(slim.join(marks, ["k1", "k2"], "left").withColumn("copied", F.coalesce("copied", F.lit(False))), "marked")
    close = marked.where("near is not null")
    starts = stored(_by_text(close.select("text", "k1", "k2", "near").mapInArrow(lambda it: _windows(it, width, period), _PLACES), "starts"), "starts")
    hit = close.where("not copied").select("doc_id", "text", "k1", "k2", "copied").join(starts, ["k1", "k2"], "left").select("doc_id", "text", "copied", "starts")
    rest = marked.where("near is null or copied").select("doc_id", "text", "copied", F.lit(None).cast("array<long>").alias("starts"))
    kind = dict(slim.dtypes)["doc_id"]
    return hit.unionByName(rest).mapInArrow(lambda it: _cut(it, width), f"doc_id {kind}, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>")
