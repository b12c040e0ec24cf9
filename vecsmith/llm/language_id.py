"""Language identification by spans.

Script ranges of a word's letters narrow the languages that can be meant. Each
word is scored for these by letter n-grams (log probabilities from labelled
text); Viterbi with a switching penalty then labels the words, so that
mixed-language text falls into spans. A document's language is that of most of
its letters.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsmith.llm.common import batches_of_rows, mix, task

BUCKETS, ORDERS, PENALTY, PER_LANGUAGE = 1 << 15, (1, 2, 3), 12.0, 4000
_CHARS, _ROWS = 1 << 20, 2000
_NEVER = np.float32(-1e4)
#: First code points of script ranges and the classes they begin.
_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2DE0, "cyrillic"), (0x2E80, "han"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "indic"), (0xA960, "hangul"), (0xA980, "other"), (0xAB30, "latin"),
    (0xAB70, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0x10000, "other"), (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = sorted({s for _, s in _RANGES})

_TABLES: list = []


def _characters():
    """For each code point: its lower case (0 if no letter), and its script class."""
    if not _TABLES:
        lower = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                lower[c] = ord(low) if len(low) == 1 else c
        starts = np.array([a for a, _ in _RANGES])
        classes = np.array([SCRIPTS.index(s) for _, s in _RANGES], np.uint8)
        script = classes[np.searchsorted(starts, np.arange(0x110000), side="right") - 1]
        _TABLES.append((lower, script))
    return _TABLES[0]


class _Words:
    """The words (runs of letters) of some texts, laid end to end."""

    def __init__(self, texts: list[str]):
        lower, script = _characters()
        points = [np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) for t in texts]
        sizes = np.array([len(p) + 1 for p in points])
        flat = np.zeros(int(sizes.sum()) + 2, np.uint32)  # a gap before the first text and after each
        self.text_at = np.cumsum(sizes) - sizes + 1
        for at, p in zip(self.text_at, points, strict=True):
            flat[at : at + len(p)] = p
        self.low = lower[flat]
        letter = self.low > 0
        edge = np.diff(letter.astype(np.int8), prepend=np.int8(0))
        self.starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.lengths = ends - self.starts
        self.script = script[flat[self.starts]]
        self.text_of = np.searchsorted(self.text_at, self.starts, side="right") - 1
        self.words_in = np.bincount(self.text_of, minlength=len(texts))

    def grams(self, buckets: int):
        """For each n-gram order: the hashed n-gram that begins at each place, and whether it lies in a word.

        A word is read with a gap on either side, so n-grams see its first and last letters.
        """
        low = self.low.astype(np.uint64)
        inside = np.zeros(len(low), bool)
        inside[self.low > 0] = True
        before = np.zeros(len(low), bool)
        before[:-1] = inside[1:] & ~inside[:-1]  # the gap before a word
        for n in ORDERS:
            h = np.full(len(low), n, np.uint64)
            ok = (inside | before).copy() if n > 1 else inside.copy()
            for k in range(n):
                shifted = np.zeros(len(low), np.uint64)
                shifted[: len(low) - k] = low[k:]
                h = h * np.uint64(0x100000001B3) + shifted
                if 0 < k < n - 1:  # only the last place may be the gap after the word
                    inner = np.zeros(len(low), bool)
                    inner[: len(low) - k] = inside[k:]
                    ok &= inner
            yield (mix(h) & np.uint64(buckets - 1)).astype(np.int32), ok


def gram_counts(texts: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """Counts of hashed n-grams, one row for each order."""
    out = np.zeros((len(ORDERS), buckets), np.int64)
    words = _Words(texts)
    for i, (h, ok) in enumerate(words.grams(buckets)):
        out[i] = np.bincount(h[ok], minlength=buckets)
    return out


def _pieces(texts: list):
    """Runs of texts of about a million characters together; a longer text is one by itself."""
    run, size = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        size += len(t or "")
        if size >= _CHARS or len(run) >= _ROWS:
            yield run
            run, size = [], 0
    if run:
        yield run


class Model:
    """Languages, their n-gram log probabilities, and which of them each script allows."""

    def __init__(self, languages: list[str], counts: np.ndarray, letters: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        log = np.log(smooth / smooth.sum(axis=2, keepdims=True)) if len(languages) else counts.astype(float)
        self.scores = np.ascontiguousarray(np.moveaxis(log, 0, 2)).astype(np.float32)  # order, bucket, language
        share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
        self.allowed = (share >= 0.01).T  # script, language
        self.allowed[~self.allowed.any(axis=1)] = True  # an unseen script says nothing

    def word_scores(self, words: _Words) -> np.ndarray:
        total = np.zeros((len(words.low) + 1, len(self.languages)), np.float32)
        for i, (h, ok) in enumerate(words.grams(self.scores.shape[1])):
            at = np.flatnonzero(ok)
            total[at] += self.scores[i][h[at]]
        # a word's places are its letters and the gap before it
        first = np.maximum(words.starts - 1, 0)
        bounds = np.stack([first, words.starts + words.lengths], axis=1).ravel()
        out = np.add.reduceat(total, bounds, axis=0)[::2] if len(words.starts) else total[:0]
        out = out - out.max(axis=1, keepdims=True)
        return np.where(self.allowed[words.script], out, _NEVER).astype(np.float32)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word: ``counts`` words for each text in turn, all texts side by side.

    Of equal paths the one that stays, and then the first language, wins.
    """
    labels = np.zeros(len(scores), np.int32)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    if not len(order):
        return labels
    sizes = counts[order]
    at = (np.cumsum(counts) - counts)[order]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # texts with at least t words
    best = scores[at].astype(np.float32)
    back = []
    for t in range(1, sizes[0]):
        n = active[t]
        now = best[:n]
        top = now.argmax(axis=1)
        jump = now[np.arange(n), top] - np.float32(penalty)
        stay = now >= jump[:, None]
        back.append(np.where(stay, -1, top[:, None]).astype(np.int16))
        best[:n] = np.where(stay, now, jump[:, None]) + scores[at[:n] + t]
    state = np.full(len(order), 0)
    for t in range(sizes[0] - 1, -1, -1):
        n = active[t]
        m = active[t + 1] if t + 1 < sizes[0] else 0
        state[m:n] = best[m:n].argmax(axis=1)  # texts whose last word this is
        if m:
            b = back[t][np.arange(m), state[:m]]
            state[:m] = np.where(b < 0, state[:m], b)
        labels[at[:n] + t] = state[:n]
    return labels


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def label(texts: list[str | None], model: Model, penalty: float = PENALTY):
    """(language, score, spans) of each text."""
    n = len(texts)
    langs, shares, spans = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
    if not model.languages:
        return langs, shares, spans
    held = []
    for run in _pieces(texts):
        words = _Words([texts[i] or "" for i in run])
        held.append((model.word_scores(words), words.words_in, words.starts - words.text_at[words.text_of], words.lengths))
    scores, counts, starts, lengths = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros((0, 1)), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))
    labels = viterbi(scores, counts, penalty)
    text_of = np.repeat(np.arange(n), counts)
    letters = np.zeros((n, len(model.languages)), np.int64)
    np.add.at(letters, (text_of, labels), lengths)
    total = letters.sum(axis=1)
    top = letters.argmax(axis=1)
    new = np.ones(len(labels), bool)
    new[1:] = (labels[1:] != labels[:-1]) | (text_of[1:] != text_of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(labels)) - 1
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        spans[text_of[a]].append({"start": int(starts[a]), "end": int(starts[b] + lengths[b]), "lang": model.languages[labels[a]]})
    for i in np.flatnonzero(total):
        langs[i], shares[i] = model.languages[top[i]], float(letters[i, top[i]] / total[i])
    return langs, shares, spans


@task
def _learned(batches):
    """Per language: n-gram counts (one row an order) and letters a script, as sparse rows."""
    sums: dict = {}
    for batch in batches_of_rows(batches):
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            own = [t or "" for t, x in zip(texts, langs, strict=True) if x == lang]
            for run in _pieces(own):
                some = [own[i] for i in run]
                words = _Words(some)
                script = np.zeros(len(SCRIPTS), np.int64)
                np.add.at(script, words.script, words.lengths)
                grams, letters = sums.setdefault(lang, (np.zeros((len(ORDERS), BUCKETS), np.int64), np.zeros(len(SCRIPTS), np.int64)))
                for i, (h, ok) in enumerate(words.grams(BUCKETS)):
                    grams[i] += np.bincount(h[ok], minlength=BUCKETS)
                letters += script
    for lang, (grams, letters) in sums.items():
        for kind, row in [*enumerate(grams), (-1, letters)]:
            at = np.flatnonzero(row)
            if len(at):
                yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "kind": pa.array([kind] * len(at), pa.int32()), "at": pa.array(at, pa.int32()), "n": pa.array(row[at], pa.int64())})


def train(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` documents of each language, chosen by a hash of the id.

    That is the bound of the sample, in whole texts; where a language has fewer,
    all are used. Rows without a language or a text take no part. The model has
    ``BUCKETS`` numbers for each n-gram order and language, whatever the input.
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((0, len(ORDERS), BUCKETS)), np.zeros((0, len(SCRIPTS))))
    spark = labelled.sparkSession
    rates = spark.createDataFrame([(k, min(1.0, per_language / n)) for k, n in sizes.items()], "lang string, rate double")
    place = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(rates, "lang").where((F.col("rate") >= 1) | (place < F.col("rate"))).select("lang", "text")
    got = sample.mapInArrow(_learned, "lang string, kind int, at int, n long").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes, key=lambda x: x.encode())
    counts, letters = np.zeros((len(languages), len(ORDERS), BUCKETS)), np.zeros((len(languages), len(SCRIPTS)))
    index = got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=int)
    kind, at, n = (got[c].to_numpy() for c in ("kind", "at", "n"))
    gram = kind >= 0
    counts[index[gram], kind[gram], at[gram]] = n[gram]
    letters[index[~gram], at[~gram]] = n[~gram]
    return Model(languages, counts, letters)


@task
def _labelled(batches, model, penalty):
    model = model.value
    for batch in batches_of_rows(batches, 5000):
        langs, shares, spans = label(batch.column("text").to_pylist(), model, penalty)
        yield pa.record_batch([*batch.columns, pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, _SPANS)], names=[*batch.schema.names, "lang_pred", "score", "spans"])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """(doc_id, text, lang_pred, score, spans) of each row of ``docs``; only the text is looked at.

    ``spans`` has start and end (in characters) and language of each run of words of one language.
    ``score`` is the share of the letters that lie in spans of ``lang_pred``.
    A null text, one without letters, and any text under a model without
    languages is ``und`` with score 0 and no spans. Null and repeated ids go
    through row by row; an empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size for each language
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(lambda it: _labelled(it, shared, penalty), f"doc_id {kind}, text string, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def held_out(id_column) -> F.Column:
    """Whether crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))
