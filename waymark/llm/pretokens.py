"""Texts cut into pre-tokens, many texts at a time in numpy, and values computed once for each distinct one.

The public byte-pair files cut texts by one published pattern: contractions, runs of letters, of numbers and of
other characters, each run with the blank before it in one of the files, and white space. ``cut`` finds these
places from the classes of bytes: ASCII and the Latin letters of two bytes, whose class and case are plain. A run
between white space that holds any other character is one piece, which the library itself is to take apart.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

#: The published patterns of the two kinds of files.
WITH_BLANK = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WITHOUT_BLANK = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: UTF-8 of white space outside ASCII, and the four separators that only some libraries count as such.
ODD_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80").search
#: Pieces of ``cut`` that are one pre-token for certain, and those of them that lower-casing leaves as they are.
CERTAIN = re.compile(rb"(?:[\t-\r -~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+").fullmatch
CERTAIN_LOWER = re.compile(rb"(?:[!-@\[-~]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
SEPARATOR = 0xFF  # never part of UTF-8
SPACE, LETTER, DIGIT, OTHER, ODD, END = range(6)


def _classes() -> np.ndarray:
    table = np.full(256, ODD, np.uint8)
    table[0x21:0x7F] = OTHER
    table[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
    table[0x30:0x3A] = DIGIT
    table[[9, 10, 11, 12, 13, 32]] = SPACE
    table[SEPARATOR] = END
    return table


CLASSES = _classes()


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte, as a table for ``str.translate`` on Latin-1 text."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def steps_of(path: str) -> tuple[list[dict], list[dict]]:
    """Normalising and pre-token steps of a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    inner = lambda key, plural: (lambda x: x.get(plural, [x]) if x else [])(spec.get(key))
    return inner("normalizer", "normalizers"), inner("pre_tokenizer", "pretokenizers")


def drops_space(path: str) -> bool:
    """Whether a file lower-cases, cuts by ``WITHOUT_BLANK`` and drops white space."""
    normal, steps = steps_of(path)
    first = steps[0] if steps else {}
    kept = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed"
    same = first.get("pattern", {}).get("Regex") == WITHOUT_BLANK and all(s.get("type") == "ByteLevel" and not s.get("use_regex") and not s.get("add_prefix_space") for s in steps[1:])
    return bool(kept and same) and {s["type"] for s in normal} <= {"NFC", "Replace", "Lowercase"} and any(s["type"] == "Lowercase" for s in normal)


def keeps_blank(path: str) -> bool:
    """Whether a file takes texts as they are and cuts them by ``WITH_BLANK``."""
    normal, steps = steps_of(path)
    return not normal and len(steps) == 1 and steps[0].get("type") == "ByteLevel" and steps[0].get("use_regex", True) and not steps[0].get("add_prefix_space")


def cut(texts: list[bytes], with_blank: bool) -> tuple[pa.Array, np.ndarray]:
    """All pieces of the texts in order, and where each text's begin (one place more than there are texts).

    ``with_blank``: by the pattern of that name, where white space makes pieces too and texts may hold none of
    ``ODD_SPACE``; else by the other one, for texts whose ASCII letters are lower case.
    """
    mark = bytes([SEPARATOR])
    buffer = np.frombuffer(mark.join([*texts, b"", b"", b""]), np.uint8)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    kind = CLASSES[buffer]
    lead = np.flatnonzero((buffer >= 0xC3) & (buffer <= 0xC5))
    if len(lead):
        a, b = buffer[lead], buffer[lead + 1]
        # Not the two signs among the letters, nor the capital that lower-cases to a letter and a mark.
        letter = (b >= 0x80) & (b < 0xC0) & ~((a == 0xC3) & ((b == 0x97) | (b == 0xB7))) & ~((a == 0xC4) & (b == 0xB0))
        kind[lead[letter]] = LETTER
        kind[lead[letter] + 1] = LETTER
    odd = np.flatnonzero(kind == ODD)
    if len(odd):  # the run between white space that it stands in
        gap = np.flatnonzero((kind == SPACE) | (kind == END))
        after = np.unique(np.searchsorted(gap, odd))
        inside = np.zeros(len(kind) + 1, np.int8)
        inside[gap[after]] -= 1
        inside[np.where(after > 0, gap[after - 1] + 1, 0)] += 1
        kind[np.cumsum(inside[:-1], dtype=np.int8) > 0] = ODD
    start = np.empty(len(kind), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    ends = kind == END
    start |= ends
    if with_blank:
        # The last of white space before anything else stands alone, or goes with what follows if it is a blank.
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~ends[1:])
        start[last] = True
        start[last[buffer[last] == 0x20] + 1] = False
    else:
        start |= kind == DIGIT
    mark_at = np.flatnonzero((buffer == 0x27) & start & (kind == OTHER))
    if len(mark_at):
        a, b = buffer[mark_at + 1], buffer[mark_at + 2]
        one = mark_at[np.isin(a, np.frombuffer(b"stmd", np.uint8))]
        two = mark_at[((b == 0x65) & ((a == 0x72) | (a == 0x76))) | ((a == 0x6C) & (b == 0x6C))]
        for at, n in ((one, 2), (two, 3)):
            start[at + 1] = False
            rest = at + n
            start[rest[kind[rest] == LETTER]] = True
    keep = ~ends if with_blank else (kind != SPACE) & ~ends
    first = np.flatnonzero(start & keep)
    data = buffer[keep]
    offsets = np.append(np.flatnonzero(start[keep]), len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return pieces, np.searchsorted(first, begins)


class Merger:
    """Ids of pieces: the file's BPE model merges those that are one pre-token, the library takes the others apart."""

    def __init__(self, tokenizer, certain):
        self.tokenizer, self.tokenize, self.certain, self.table = tokenizer, tokenizer.model.tokenize, certain, byte_alphabet()

    def __call__(self, pieces: list[bytes]) -> list[list[int]]:
        certain, tokenize, table = self.certain, self.tokenize, self.table
        out = [[t.id for t in tokenize(p.decode("latin-1").translate(table))] if certain(p) else None for p in pieces]
        rest = [k for k, v in enumerate(out) if v is None]
        if rest:
            for k, v in zip(rest, whole_ids(self.tokenizer, [pieces[k] for k in rest]), strict=True):
                out[k] = v
        return out


def whole_ids(tokenizer, texts: list[bytes]) -> list[list[int]]:
    """Ids of whole texts as the library gives them."""
    return [e.ids for e in tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]


class Memo:
    """Values of keys, remembered within a bound of bytes: a full young generation becomes the old one.

    Keys longer than ``LONGEST`` are computed each time, so texts without any blank are never held.
    """

    LONGEST = 64
    #: What an entry takes besides its key: two objects and a place in the dictionary.
    ENTRY = 250

    def __init__(self, most_bytes: int = 80 << 20):
        self.most, self.held, self.young, self.old = most_bytes, 0, {}, {}

    def look_up(self, keys: list, compute) -> list:
        """The value of every key (each given once); ``compute`` gets the list of those that neither generation has."""
        get = self.young.get
        found = list(map(get, keys))
        missing = [j for j, v in enumerate(found) if v is None]
        if not missing:
            return found
        todo = []
        for j in missing:
            if (v := self.old.get(keys[j])) is None:
                todo.append(j)
            else:
                found[j] = v
        if todo:
            for j, v in zip(todo, compute([keys[j] for j in todo]), strict=True):
                found[j] = v
        for j in missing:
            if len(k := keys[j]) <= self.LONGEST:
                self.held += self.ENTRY + len(k)
                if self.held > self.most:
                    self.old, self.young, self.held = self.young, {}, self.ENTRY + len(k)
                self.young[k] = found[j]
        return found


def batches(texts: list[bytes], most_bytes: int = 8_000_000):
    """Slices of a column, as (first, last), of bounded text size (one text at least)."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most_bytes:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
