"""Exact token counts at every prefix of a text, by dynamic programming.

In byte-pair encoding the tokens of a prefix are the tokens of a shorter prefix
and one last token. Of the vocabulary pieces that end at a place, exactly one
agrees with the last token before it (the library encodes the two, side by
side, as these two), so ``count[i] = count[i - len(last)] + 1``. No piece has a
space mark after another character, so a text's counts are those of its
space-led segments in turn; each distinct segment is worked out once.

The counts are kept as one signed byte for each character: by how much the
count changes there. Truncation and budget questions then need no encoding.
"""

from __future__ import annotations

import re
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vecsmith.llm.common import AT_TASK_END, batches_of_rows, task

LIMIT = 4096
_KEPT = 500_000
_SPACE = "▁"
_SEGMENT = re.compile("▁*[^▁]+|▁+")
_MARK = "﷐"


class PrefixCounts:
    """Prefix counts of texts under a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        #: Pieces by their characters from the last on; the empty key marks a whole piece.
        self.endings: dict = {}
        for p in self.ids:
            node = self.endings
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = {}
        #: No piece crosses from another character to a space mark; else segments would not be independent.
        self.crossing = any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in self.ids)
        #: A character in no piece: nothing merges across it.
        used = set("".join(self.ids))
        self.barrier = next(chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in used)
        self.before = len(self._encoded(self.barrier))
        self.agree: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}

    def _encoded(self, text: str) -> list[int]:
        return self.sp.encode(text.replace(_SPACE, " "))

    def agrees(self, last: str, piece: str) -> bool:
        """Whether the library encodes the two, side by side, as these two; ``last`` is empty at a start."""
        if len(self.agree) > 2 * _KEPT:
            self.agree.clear()
        want = [self.ids[p] for p in (last, piece) if p]
        got = self.agree[last, piece] = self._encoded(self.barrier + last + piece)[self.before :] == want
        return got

    def extend(self, s: str, count: list[int], last: list[str]) -> None:
        """Go on to all prefixes of ``s``; ``count`` and ``last`` hold those of its first characters."""
        agree = self.agree
        for i in range(len(count), len(s) + 1):
            node, j, starts = self.endings, i, []
            while j and (node := node.get(s[j - 1])) is not None:
                j -= 1
                if "" in node:
                    starts.append(j)
            for j in reversed(starts):
                piece = s[j:i]
                fits = agree.get((last[j], piece))
                if fits or fits is None and self.agrees(last[j], piece):
                    count.append(count[j] + 1)
                    last.append(piece)
                    break
            else:  # an unknown character: its bytes, and nothing merges across
                count.append(count[i - 1] + len(s[i - 1].encode("utf-8", "surrogatepass")))
                last.append("")

    def learn(self, segments: list[str]) -> None:
        """Work out sorted segments; each goes on from the prefix it shares with the one before."""
        count, last, before, known, extend = [0], [""], "", self.known, self.extend
        for s in segments:
            same = 0
            for x, y in zip(before, s, strict=False):
                if x != y:
                    break
                same += 1
            del count[same + 1 :], last[same + 1 :]
            extend(s, count, last)
            known[s] = bytes([(y - x) & 255 for x, y in pairwise(count)])
            before = s

    def __call__(self, texts: list[str | None]) -> list[tuple[bytes, int]]:
        """(change of the count at each character, total) of each text.

        The first change includes that of the space mark the library puts before
        every text; a prefix of no characters has 0 tokens.
        """
        split = []
        for t in texts:
            if not t:
                split.append(())
                continue
            t = _SPACE + t.replace(" ", _SPACE)
            if self.crossing:
                split.append((t,))
            elif _SPACE + _SPACE in t or _MARK in t:
                split.append(_SEGMENT.findall(t))
            else:
                split.append(t.replace(_SPACE, _MARK + _SPACE).split(_MARK)[1:])
        known = self.known
        if len(known) > _KEPT:
            known.clear()
        self.learn(sorted(set().union(*split).difference(known)))
        out = []
        for segments in split:
            steps = b"".join(map(known.__getitem__, segments))
            if steps:  # the leading mark is no character of the text
                a, b = np.frombuffer(steps[:2].ljust(2, b"\0"), np.int8)
                steps = np.int8(a + b).tobytes() + steps[2:]
            out.append((steps, int(np.frombuffer(steps, np.int8).sum(dtype=np.int64))))
        return out


_BY_PATH: dict[str, PrefixCounts] = {}


def prefix_counts(path: str) -> PrefixCounts:
    """One model for each worker process and model file."""
    if path not in _BY_PATH:
        _BY_PATH[path] = PrefixCounts(path)
        AT_TASK_END.append(_BY_PATH[path].known.clear)
    return _BY_PATH[path]


@task
def _counted(batches, path):
    counts = prefix_counts(path)
    for batch in batches_of_rows(batches):
        got = counts(batch.column("text").to_pylist())
        yield pa.record_batch([*(batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"), pa.array([n for _, n in got], pa.int64()), pa.array([s for s, _ in got], pa.binary())], names=[*(c for c in batch.schema.names if c != "text"), "n_tokens", "steps"])


def token_prefixes(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, steps) of each row of ``docs``.

    ``steps`` has a signed byte for each character (code point) of the text: the
    change of the exact token count there; their sums are the counts of all
    prefixes. Null and empty texts have no bytes, tokens or steps. Null ids,
    repeated rows and an empty table go through row by row.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    out = slim.mapInArrow(lambda it: _counted(it, tokenizer), f"doc_id {kind}, n_bytes long, n_tokens long, steps binary")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "steps")


def tokens_at(steps: Column, chars: Column) -> Column:
    """Token count of the prefix of ``chars`` characters (the whole text, if it is shorter; 0 below 1); null if either is null."""

    @pandas_udf("long")
    def at(steps: pd.Series, chars: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or pd.isna(n) else int(np.frombuffer(s, np.int8)[: max(int(n), 0)].sum(dtype=np.int64)) for s, n in zip(steps, chars, strict=True)], dtype="Int64")

    return at(steps, chars)


def chars_within(steps: Column, budget: Column) -> Column:
    """The longest prefix, in characters, whose own token count is within ``budget`` (0 if it is negative); null if either is null."""

    @pandas_udf("long")
    def within(steps: pd.Series, budget: pd.Series) -> pd.Series:
        out = []
        for s, n in zip(steps, budget, strict=True):
            if s is None or pd.isna(n):
                out.append(None)
                continue
            fits = np.flatnonzero(np.cumsum(np.frombuffer(s, np.int8), dtype=np.int64) <= n)
            out.append(int(fits[-1]) + 1 if len(fits) else 0)
        return pd.Series(out, dtype="Int64")

    return within(steps, budget)


def running(steps: bytes) -> list[int]:
    """Counts of all prefixes, from 0 characters on."""
    return [0, *accumulate(np.frombuffer(steps, np.int8).astype(int).tolist())]
