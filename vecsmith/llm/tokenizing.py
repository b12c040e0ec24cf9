"""Token ids of whole texts with the tokenizers library, each distinct piece between spaces encoded once."""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vecsmith.llm.common import AT_TASK_END

_KEPT, _AT_ONCE = 400_000, 20_000
#: Before a piece: no space leads it.
_BARE = "\0"
#: White space, as the pre-tokenizer's pattern has it.
_SPACES = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
#: Letters in any version of Unicode; between one of them and a stop the pre-tokenizer always cuts.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_STOPS = ".,;:!?"
_WORD = re.compile(f"[{_LETTERS}]+")


def _visible_bytes() -> dict[int, str]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class SegmentIds:
    """Encodes texts piece by piece.

    A byte-level pre-tokenizer always ends a word before the space that leads the
    next one, around a line feed that has no other white space beside it, and after a letter before a stop. So a text's ids are
    those of its pieces between these places in turn. The pieces of a batch are numbered by Arrow; each distinct one goes through the
    library once (words through its model alone) and is remembered (within a task, and up to a fixed number).
    Texts with white space in runs, with the mark or with an added token in them
    go to the library whole, and so does every text if the file has another
    pre-tokenizer, a normalizer, or anything else that looks beyond a piece.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype(f"<u{array(self.code).itemsize}")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        first = spec.get("pre_tokenizer") or {}
        by_piece = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", True)
        plain = not any(spec.get(k) for k in ("normalizer", "truncation", "padding")) and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.cuts, self.line = by_piece and plain and len(line) == 1, line[0] if line else -1
        self.model, self.visible = self.library.model, _visible_bytes()
        self.known: dict[str, bytes] = {}

    def forget(self) -> None:
        self.known.clear()

    def _library(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Words by the model; other pieces in one call, on lines of their own; those with white space at an end one by one."""
        if len(self.known) + len(pieces) > _KEPT:
            self.known.clear()
        text, together, tokenize, code, space = {}, [], self.model.tokenize, self.code, self.visible[32]
        for p in pieces:
            bare, lead = (p[1:], "") if p[:1] == _BARE else (p, " ")
            if _WORD.fullmatch(bare) is not None:
                shown = bare if bare.isascii() else bare.encode().decode("latin-1").translate(self.visible)
                self.known[p] = array(code, [t.id for t in tokenize(space + shown if lead else shown)]).tobytes()
            elif not bare or bare[0].isspace() or bare[-1].isspace():
                self.known[p] = self._library(lead + bare) if p != _BARE else b""
            else:
                text[p] = lead + bare
                together.append(p)
        for at in range(0, len(together), _AT_ONCE):
            some = together[at : at + _AT_ONCE]
            ids = np.array(self.library.encode("\n".join(text[p] for p in some), add_special_tokens=False).ids, self.dtype)
            edge = [-1, *np.flatnonzero(ids == self.line).tolist(), len(ids)]
            if len(edge) == len(some) + 1:
                size, data = self.dtype.itemsize, ids.tobytes()
                self.known.update((p, data[size * (a + 1) : size * b]) for p, a, b in zip(some, edge[:-1], edge[1:], strict=True))
            else:
                self.known.update((p, self._library(text[p])) for p in some)

    def _by_piece(self, texts: pa.Array) -> pa.Array:
        marked = pc.binary_join_element_wise(pa.scalar(_BARE), pc.replace_substring(texts, "\n", f" {_BARE}\n {_BARE}"), "")
        marked = pc.replace_substring_regex(marked, f"([{_LETTERS}])([{_STOPS}])", rf"\1 {_BARE}\2")
        pieces = pc.split_pattern(marked, " ")
        flat = pieces.flatten().dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        if unknown := [p for p in distinct if p not in self.known]:
            before = {} if len(self.known) + len(unknown) <= _KEPT else {p: self.known[p] for p in distinct if p in self.known}
            self._learn(unknown)
            self.known.update(before)
        all_ids = pa.array([self.known[p] for p in distinct], pa.binary()).take(flat.indices)
        edge = np.frombuffer(all_ids.buffers()[1], np.int32, len(all_ids) + 1)[pieces.offsets.to_numpy()]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(edge)), all_ids.buffers()[2]])

    def ids(self, texts: pa.Array) -> pa.Array:
        """The ids of each text, as bytes of ``dtype``; null and empty texts have none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return pa.array([], pa.binary())
        whole = pc.match_substring_regex(texts, _SPACES + "{2}") if self.cuts else pa.array([True] * len(texts))
        for a in (_BARE, *self.added):
            whole = pc.or_(whole, pc.match_substring(texts, a))
        if not pc.any(whole).as_py():
            return self._by_piece(texts)
        alone = pa.array([self._library(t) for t in texts.filter(whole).to_pylist()], pa.binary())
        rest = texts.filter(pc.invert(whole))
        both = pa.concat_arrays([alone, self._by_piece(rest)]) if len(rest) else alone
        mask = whole.to_numpy(zero_copy_only=False)
        place = np.where(mask, np.cumsum(mask) - 1, len(alone) + np.cumsum(~mask) - 1)
        return both.take(pa.array(place))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        return self.ids(pa.array(texts, pa.string())).to_pylist()


_BY_PATH: dict[str, SegmentIds] = {}


def segment_ids(path: str) -> SegmentIds:
    """One encoder for each worker process and vocabulary file."""
    if path not in _BY_PATH:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _BY_PATH[path] = SegmentIds(path)
        AT_TASK_END.append(_BY_PATH[path].forget)
    return _BY_PATH[path]
