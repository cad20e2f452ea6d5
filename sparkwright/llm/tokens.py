"""Tokenizing whole texts inside tasks.

The tokenizer file normalizes, then cuts at white space before its merges run,
so the ids of a text are those of its white-space-separated words in order.
Each word is therefore encoded once per worker and its ids are kept, as bytes,
in a memo of bounded size; a text becomes one ``join`` over its words.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sparkwright.llm.common import text_bytes

MEMO_WORDS = 350_000          # words kept per worker; the memo starts anew beyond that
MEMO_UNITS = 350_000          # letter runs kept per worker, likewise
LONG_WORD = 200               # longer ones are encoded but not kept

# A plain word holds printable ASCII but the apostrophe, and Latin letters that
# normalization leaves alone.  The file's pre-tokenizer cuts such a word into
# letter runs, single digits and runs of other signs; all else goes whole.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_PLAIN = re.compile(f"[!-&(-~{_LETTERS}]+")
_UNITS = re.compile(f"[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+")

# The same for many words at once, one per line; a line end counts as a unit with an id that no file has.
_PLAIN_LINES = re.compile(f"[!-&(-~{_LETTERS}\n]*")
_LINE_UNITS = re.compile(f"[{_LETTERS}]+|[0-9]|[^\n0-9{_LETTERS}]+|\n")
_STOP_ID = 0xFFFFFFFF
_STOP = _STOP_ID.to_bytes(4, "little")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + n) for n, b in enumerate(others)}


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian uint32 bytes."""
    values = array("I", ids)
    if sys.byteorder == "big":
        values.byteswap()
    return values.tobytes()


class _Units(dict):
    """Lower-cased unit of a plain word -> its ids as little-endian uint32 bytes."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        self.letters = _byte_letters()

    def __missing__(self, unit: str) -> bytes:
        if unit == "\n":
            return _STOP
        seen = unit if unit.isascii() else unit.encode().decode("latin-1").translate(self.letters)
        ids = _packed([t.id for t in self.model.tokenize(seen)])
        if len(self) > MEMO_UNITS:
            self.clear()
        if len(unit) <= LONG_WORD:
            self[unit] = ids
        return ids


class _Words(dict):
    """Word -> its ids as little-endian uint32 bytes."""

    def __init__(self, tokenizer, units: _Units):
        super().__init__()
        self.tokenizer = tokenizer
        self.units = units

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "surrogatepass")
        if _PLAIN.fullmatch(text) and "<|" not in text:
            ids = b"".join(map(self.units.__getitem__, _UNITS.findall(text.lower())))
        else:
            ids = _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self) > MEMO_WORDS:
            self.clear()
        if len(word) <= LONG_WORD:
            self[word] = ids
        return ids


class WordTokenizer:
    """Ids of whole texts from one word-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        full = Tokenizer.from_file(path)
        self._words = _Words(full, _Units(full.model))  # its merges alone for units, else all of it

    def encode_bytes(self, text: str | None) -> bytes:
        """All ids of ``text`` (no special tokens added) as little-endian uint32 bytes."""
        return b"".join(map(self._words.__getitem__, text_bytes(text).split()))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all ``texts`` on end, as ``encode_bytes`` gives them, and how many each text has.

        Every different word is encoded once per batch; numpy puts the ids of the texts together.
        """
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        n_words = len(coded.dictionary)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n_words], pa.int32()), coded.dictionary), "\n")
        table, begins, lengths = self._encode_words(lines[0].as_py(), n_words)
        lengths = lengths[codes]                      # of every word now
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = table[np.repeat(begins[codes] - ends[:-1], lengths) + np.arange(ends[-1])]
        bounds = split.offsets.to_numpy()
        return ids, np.diff(ends[bounds - bounds[0]])

    def _encode_words(self, lines: str, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One array with the ids of words, given one per line, and where those of each begin and how many they are."""
        words, odd = [], []
        if not _PLAIN_LINES.fullmatch(lines) or "<|" in lines:
            words = lines.split("\n")
            odd = [n for n, word in enumerate(words) if not _PLAIN_LINES.fullmatch(word) or "<|" in word]
            strange = set(odd)
            lines = "\n".join([word for n, word in enumerate(words) if n not in strange])
        pieces = []
        if n_words > len(odd):
            pieces += map(self._words.units.__getitem__, _LINE_UNITS.findall(f"{lines.lower()}\n"))
        for n in odd:
            pieces += self._words[words[n].encode("utf-8", "surrogatepass")], _STOP
        table = np.frombuffer(b"".join(pieces), dtype="<u4")
        stops = np.flatnonzero(table == _STOP_ID)     # the plain words' first, then those of the odd ones
        order = np.concatenate([np.delete(np.arange(n_words), odd), np.array(odd, dtype=np.int64)])
        begins, lengths = np.zeros(n_words, dtype=np.int64), np.zeros(n_words, dtype=np.int64)
        begins[order] = np.concatenate([[0], stops[:-1] + 1])[:n_words]
        lengths[order] = stops - begins[order]
        return table, begins, lengths


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for ``path`` (loaded once per Python worker)."""
    return WordTokenizer(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)
