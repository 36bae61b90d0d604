"""Token ids of whole texts, a batch at a time.

A text is cut into units before single spaces and newlines and between a settled letter or digit and a punctuation
character of ASCII. In both tokenizers no pretoken runs over such a place (a pretoken's white space stands at its start, and
letters and digits end the pretokens they are in), so a text's ids are its units' ids in a row. A character is settled if
Unicode has not changed its kind since version 3.2, so that all engines' tables agree on it, and if normalising and lowercasing
it gives one settled letter or itself; `İ`, whose lower case ends in a mark, isn't. Units are dictionary-encoded by Arrow; only
a batch's distinct units are looked up, and only those never seen go through merging. Byte-level texts with two white-space
characters in a row are given to the library whole, as the cut isn't proven there.
"""

from __future__ import annotations

import base64
import contextlib
import ctypes
import functools
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÿ]*")
#: The pretoken patterns on texts of PLAIN characters.
BYTE_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s0-9{LATIN}]+|\s+(?!\S)|\s+")
LOWER_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Punctuation of ASCII, for a character class.
MARKS = r"!-/:-@\[-`{-~"
#: Bytes of text that are cut at a time, known units, and the longest unit that is kept.
BATCH_BYTES, KNOWN, LONGEST = 4 << 20, 100_000, 64
#: Stands before a unit that no space or newline stands before. Texts that hold it are encoded whole.
MARK = "\x1e"


@functools.cache
def settled(kind: str) -> str:
    """For a character class: the settled characters of the basic plane whose category begins with `kind` (L or N)."""
    old, now = unicodedata.ucd_3_2_0, unicodedata

    def is_(c: str) -> bool:
        return len(c) == 1 and old.category(c)[0] == now.category(c)[0] == kind and now.normalize("NFC", c) == c

    found = [k for k in range(0x10000) if is_(chr(k)) and is_(chr(k).lower())]
    ends = [k for k, after in zip(found, [*found[1:], -1]) if after != k + 1]
    starts = [k for k, before in zip(found, [-1, *found]) if before != k - 1]
    return "".join(rf"\x{{{a:x}}}-\x{{{z:x}}}" for a, z in zip(starts, ends))


def byte_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def byte_encoding(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_ranks(path), special_tokens={})


@functools.cache
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _alphabet() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write bytes with."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def _merger(path: str):
    """(merge of one pretoken's bytes, what ends a word's last character). A word end is a byte that UTF-8 never has;
    the vocabulary numbers characters before merges, so the end joins its character first, as in the file."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end, of = model.get("end_of_word_suffix") or "", _alphabet()
    ranks: dict[bytes, int] = {}
    for token, i in model["vocab"].items():
        last = bool(end) and token.endswith(end)
        body = token[: -len(end)] if last else token
        if all(c in of for c in body) and not token.startswith("<|"):
            ranks[bytes(of[c] for c in body) + b"\xff" * last] = i
    return tiktoken.Encoding("merges", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece, b"\xff" * bool(end)


def blanked(texts: pa.Array, where: np.ndarray) -> pa.Array:
    """texts with empty ones in the places that where marks."""
    if not where.any():
        return texts
    values = texts.to_pylist()
    for k in np.flatnonzero(where).tolist():
        values[k] = ""
    return pa.array(values, pa.large_string())


class UnitEncoder:
    """Ids as the tokenizers library gives them for a .json vocabulary, without added special tokens."""

    def __init__(self, path: str):
        self.path, self.library = path, library(path)
        self.merge, self.end = _merger(path)
        self.words = LOWER_WORDS if self.end else BYTE_WORDS
        self.known: dict[str, bytes] = {}

    def slow(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def word(self, w: str) -> bytes:
        ids = self.merge(w.encode() + self.end)
        got = struct.pack(f"<{len(ids)}I", *ids)
        if len(w) <= LONGEST:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[w] = got
        return got

    def one(self, text: str) -> bytes:
        """Ids of a unit, or of any text, as little-endian unsigned 32-bit integers."""
        if "<|" in text or not (text.isascii() and text.isprintable() or PLAIN.fullmatch(text)):
            return np.array(self.slow(text), dtype="<u4").tobytes()
        known = self.known
        return b"".join([known.get(w) or self.word(w) for w in self.words.findall(text.lower() if self.end else text)])

    def starts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(places in text where tokens begin, how many tokens begin at each and before the next place). A byte-level
        vocabulary's pretokens are told as a whole where their pattern is known, and single tokens elsewhere."""
        if "<|" in text or self.end or not (text.isascii() and text.isprintable() or PLAIN.fullmatch(text)):
            at = np.array([a for a, _ in self.library.encode(text, add_special_tokens=False).offsets], np.int64)
            return at, np.ones(len(at), np.int64)
        words, known = self.words.findall(text), self.known
        size = np.fromiter(map(len, words), np.int64, len(words))
        return np.cumsum(size) - size, np.fromiter((len(known.get(w) or self.word(w)) >> 2 for w in words), np.int64, len(words))

    def units(self, names: list[str]) -> list[bytes]:
        """Each with the space that was cut off, which word vocabularies don't have."""
        full = [u[1:] if u[:1] == MARK else u if self.end or u[:1] == "\n" else " " + u for u in names]
        known, one = self.known.get, self.one
        return [known(u) or one(u) for u in full]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, n + 1 offsets). Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        apart = pc.match_substring_regex(texts, rf"{MARK}|<\|" if self.end else rf"{MARK}|<\||{WHITE}{{2}}").to_numpy(zero_copy_only=False)
        cut = blanked(texts, apart)
        cut = pc.replace_substring_regex(cut, f"([{settled('L')}{settled('N')}])([{MARKS}])", rf"\1 {MARK}\2")
        lists = pc.split_pattern(pc.replace_substring(cut, "\n", " \n"), " ")
        at = np.asarray(lists.offsets, dtype=np.int64)
        at = at - at[0]
        coded = lists.flatten().dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = coded.dictionary.to_pylist()
        parts = self.units(names)
        first = which[at[:-1]]
        if not self.end:  # a text's first unit has no space before it
            parts += [self.one(names[u]) for u in first.tolist()]
            which[at[:-1]] = len(names) + np.arange(n)
        for k in np.flatnonzero(apart).tolist():
            parts.append(self.one(texts[k].as_py()))
            which[at[k]] = len(parts) - 1
        taken = pa.array(parts, pa.large_binary()).take(pa.array(which))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(which) + 1, 8 * taken.offset) >> 2
        ids = np.frombuffer(taken.buffers()[2] or b"", "<u4")[ends[0] : ends[-1]]
        return ids, (ends - ends[0])[at]


@functools.cache
def encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)


def release() -> None:
    """Gives memory that isn't used any more back to the system, as Python workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of text; a longer text has its own."""
    for b in batches:
        size = np.nan_to_num(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False).astype(float)) + 64
        group = np.cumsum(size) // limit
        cuts = np.flatnonzero(np.diff(group, prepend=-1.0))
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), b.num_rows]):
            if z > a:
                yield b.slice(a, z - a)
    release()
