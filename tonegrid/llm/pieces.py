"""Byte-level BPE. Pieces: a text is cut at single spaces between two visible characters, where every
pre-token ends, and each distinct piece is numbered once. FileEncoder: ids of whole texts for a tokenizers file.

The cut never changes the ids: no match of the pre-tokenisation pattern crosses such a space to its left."""

from __future__ import annotations

import json
import re
from array import array
from itertools import accumulate, groupby, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged

#: The characters with property White_Space, and four controls that Python also takes as such.
WHITE = r"\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
UNSAFE = f" [{WHITE}]|[{WHITE}] |^ | $"
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Below this character all Unicode versions agree on which are letters, numbers and spaces.
SETTLED = "԰"


class Pieces:
    """Numbers for the pieces of texts, by `numbers(piece)`, which gives them as bytes of int32; each distinct piece is asked for once.

    limit: distinct pieces that are remembered; beyond it all are forgotten, so memory stays bounded."""

    def __init__(self, numbers, limit: int = 400_000):
        self.numbers, self.limit = numbers, limit
        self.forget()

    def forget(self) -> None:
        self.rows: tuple[dict, dict] = ({}, {})
        self.flat, self.starts = array("i"), array("q", [0])

    def _find(self, pieces, spaced: bool) -> np.ndarray:
        table, numbers, lead = self.rows[spaced], self.numbers, " " if spaced else ""
        rows = np.fromiter(map(table.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(rows < 0).tolist()
        if missing:
            names = [pieces[j] for j in missing]
            new = list(dict.fromkeys(names))
            made = [numbers(lead + p) for p in new]
            first = len(self.starts) - 1
            self.starts.extend(accumulate((len(m) >> 2 for m in made[1:]), initial=len(self.flat) + (len(made[0]) >> 2)))
            self.flat.frombytes(b"".join(made))
            table.update(zip(new, range(first, first + len(new))))
            rows[missing] = [table[p] for p in names]
        return rows

    def _gather(self, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all rows, and where the texts end, given the piece counts at which they do."""
        starts, flat = np.frombuffer(self.starts, np.int64), np.frombuffer(self.flat, np.int32) if self.flat else np.zeros(0, np.int32)
        lengths = starts[rows + 1] - starts[rows]
        out = flat[ragged(starts[rows], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[at]
        return ends, out

    def _safe(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        first = np.zeros(len(codes), bool)
        first[at[:-1]] = True
        known = coded.dictionary.to_numpy(zero_copy_only=False)
        later = np.zeros(len(known), bool)
        later[codes[~first]] = True
        table = np.zeros(len(known), np.int64)
        table[later] = self._find(known[later], True)
        rows = table[codes]
        rows[first] = self._find(known[codes[first]], False)
        return self._gather(rows, at)

    def _one(self, text: str) -> np.ndarray:
        cut = CUT.split(text)
        rows = np.concatenate([self._find(cut[:1], False), self._find(cut[1:], True)])
        return self._gather(rows, np.array([0, len(rows)]))[1]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and numbers of all texts; a null counts as an empty text."""
        if sum(map(len, self.rows)) > self.limit:
            self.forget()
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(1, np.int64), np.zeros(0, np.int32)
        unsafe = pc.match_substring_regex(texts, UNSAFE)
        if not pc.any(unsafe).as_py():
            return self._safe(texts)
        bad = unsafe.to_numpy(zero_copy_only=False)
        parts: list = [None] * len(texts)
        if not bad.all():
            ends, numbers = self._safe(texts.filter(pc.invert(unsafe)))
            for j, i in enumerate(np.flatnonzero(~bad)):
                parts[i] = numbers[ends[j] : ends[j + 1]]
        for i in np.flatnonzero(bad):
            parts[i] = self._one(texts[int(i)].as_py())
        return np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate(parts)


def bytes_as_characters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes and ids of a tokenizers file, if ids alone decide what is merged: a plain byte-level BPE whose merges stand in
    the order of their ids, one for each longer token, and whose tokens are all found again when they are encoded. In such a file the
    lowest pair to merge is the pair with the lowest id, so a rank encoder gives the same ids. None for any other file."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, cut = told["model"], told.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    if not plain or not level or told.get("normalizer"):
        return None
    vocabulary, back = model["vocab"], {c: b for b, c in bytes_as_characters().items()}
    merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if any(not set(t) <= set(back) for t in vocabulary) or len(set(merged)) != len(merged) or merged != sorted(merged) or len(vocabulary) != 256 + len(merged) or -1 in merged:
        return None
    encode = Tokenizer.from_file(path).model.tokenize
    if any([x.id for x in encode(t)] != [i] for t, i in vocabulary.items()):
        return None
    return {bytes(back[c] for c in t): i for t, i in vocabulary.items()}


class FileEncoder:
    """ids of texts as the tokenizers library gives them for a file, without special tokens. Where byte_ranks() holds, whole texts go
    to a rank encoder; pieces with characters that Unicode versions class differently, and other files, go to the library itself."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        ranks = byte_ranks(path)
        self.ranked = ranks and tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _library(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def one(self, text: str) -> list[int]:
        if not self.ranked:
            return self._library(text)
        if text.isascii() or max(text) < SETTLED:
            return self.ranked(text)
        first, *rest = CUT.split(text)
        runs = groupby([first, *(f" {p}" for p in rest)], lambda p: max(p) < SETTLED)
        return [i for settled, run in runs for i in (self.ranked if settled else self._library)("".join(run))]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and ids of all texts; a null counts as an empty text."""
        ends, ids = [0], array("i")
        for t in texts.to_pylist():
            if t:
                ids.extend(array("i", self.one(t)))
            ends.append(len(ids))
        return np.array(ends, np.int64), np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)


_encoders: dict[str, FileEncoder] = {}


def file_encoder(path: str) -> FileEncoder:
    """One encoder per file and worker."""
    if path not in _encoders:
        _encoders[path] = FileEncoder(path)
    return _encoders[path]
