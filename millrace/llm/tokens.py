"""Token ids of whole Arrow columns of text, by a memo of their pieces.

The tokenizer lower-cases, drops white space and splits letters from digits from punctuation
before it merges, so a text's ids are those of its pieces in order. numpy cuts a column's
bytes into pieces, Arrow numbers the distinct ones, and the library encodes each that the
memo lacks. Words with any character outside a plain set go to the library whole.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLANK, LETTER, DIGIT, MARK, OTHER = range(5)
#: Bytes of text cut at a time; a slice takes some 15 times as much while it is numbered.
SLICE_BYTES = 4 << 20


def _classes() -> np.ndarray:
    """Class of each byte. Bytes above ASCII are OTHER but for the lead byte of Latin-1 letters."""
    t = np.full(256, OTHER, np.uint8)
    t[[ord(c) for c in " \n\t\r"]] = BLANK
    t[ord("0") : ord("9") + 1] = DIGIT
    t[ord("A") : ord("Z") + 1] = t[ord("a") : ord("z") + 1] = LETTER
    # An apostrophe may start a contraction and "<" a special token: words with them stay whole.
    t[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<"]] = MARK
    t[0xC3] = LETTER
    return t


CLASSES = _classes()
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def cut(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of valid UTF-8, and where their pieces start; ``starts``: of the texts."""
    cls, low = CLASSES[data], LOWERED[data]
    if len(at := np.flatnonzero(data == 0xC3)):
        nxt = data[at + 1]
        odd = (nxt == 0x97) | (nxt == 0xB7)  # the signs for times and divided by
        cls[at[odd]] = OTHER
        cls[at + 1] = np.where(odd, OTHER, LETTER)
        low[at + 1] = np.where((nxt < 0x9F) & ~odd, nxt + 0x20, nxt)
    first = np.zeros(len(data), bool)
    first[starts[starts < len(data)]] = True
    if len(odd := np.flatnonzero(cls == OTHER)):
        word = np.cumsum((cls == BLANK) | first, dtype=np.int32)
        whole = np.zeros(int(word[-1]) + 1, bool)
        whole[word[odd]] = True
        rows = np.flatnonzero(whole[word] & (cls != BLANK))
        cls[rows], low[rows] = OTHER, data[rows]
    first[1:] |= cls[1:] != cls[:-1]
    return low, np.flatnonzero(first)


#: How byte-level alphabets show bytes: printable ones of Latin-1 as they are, the others from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class TextIds:
    """The memo holds two generations of at most ``most`` pieces of up to 64 bytes: some 30 MB each."""

    def __init__(self, path: str, most: int = 150_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.tokenize = self.tokenizer.model.tokenize
        self.direct = self._same()
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _merge(self, word: bytes) -> bytes:
        """The model's ids of one run of letters, lower-cased as pieces are; its alphabet stands for bytes."""
        text = word.decode() if word.isascii() else word.decode("latin-1").translate(_SHOWN)
        return array(self.code, [t.id for t in self.tokenize(text)]).tobytes()

    def _same(self) -> bool:
        """Whether the model alone gives what the tokenizer gives for runs of letters: tried on words of all letters and lengths."""
        letters = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
        words = [letters[i % len(letters) :][:n][::step] for n in (1, 2, 3, 5, 9, 30) for i in range(len(letters)) for step in (1, -1)] + [x * n for x in "aeszé" for n in (2, 7, 40)] + "the of information über straßen niño naïveté hello".replace("ß", "").split()
        try:
            return all(self._merge(w.encode()) == np.array(e.ids, self.dtype).tobytes() for w, e in zip(words, self.tokenizer.encode_batch(words, add_special_tokens=False)))
        except Exception:  # a model that is asked otherwise
            return False

    def learn(self, missing: list[bytes]) -> dict[bytes, bytes]:
        """Runs of letters are encoded together, as each is one word of a longer text."""
        found: dict[bytes, bytes] = {}
        words, rest = [], []
        for p in missing:
            (words if _is_word(p) and len(p) <= 256 else rest).append(p)
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            e = self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False)
            ids, owner = np.array(e.ids, self.dtype), np.array(e.word_ids)
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            if len(cuts) != len(some):
                raise ValueError("this tokenizer cuts runs of letters; a memo of pieces does not hold for it")
            raw, w = ids.tobytes(), self.dtype.itemsize
            ends = [*cuts[1:].tolist(), len(ids)]
            found.update((p, raw[a * w : b * w]) for p, a, b in zip(some, cuts.tolist(), ends))
        for p, e in zip(rest, self.tokenizer.encode_batch([p.decode() for p in rest], add_special_tokens=False) if rest else []):
            found[p] = np.array(e.ids, self.dtype).tobytes()
        return found

    def look_up(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each distinct piece; those of the older generation come back into the newer one."""
        out = list(map(self.memo.get, pieces))
        if None not in out:
            return out
        if len(self.memo) + out.count(None) > self.most:
            self.old, self.memo = self.memo, {}
        old, memo, merge, unknown = self.old.get, self.memo, self._merge, []
        for i, ids in enumerate(out):
            if ids is None:
                p = pieces[i]
                if (ids := old(p)) is None:
                    if not self.direct or not _is_word(p):
                        unknown.append(i)
                        continue
                    ids = merge(p)
                out[i] = ids
                if len(p) <= 64:
                    memo[p] = ids
        if unknown:
            fresh = self.learn([pieces[i] for i in unknown])
            for i in unknown:
                out[i] = fresh[pieces[i]]
            memo.update((p, ids) for p, ids in fresh.items() if len(p) <= 64)
        return out

    def encode(self, texts: pa.Array, slice_bytes: int = SLICE_BYTES):
        """Yield (number of texts, ids, offsets): text i of a slice has ids[offsets[i]:offsets[i + 1]]."""
        texts = texts.cast(pa.large_string())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(off, off[a] + slice_bytes, "right")) - 1)
            yield b - a, *self._encode(data[off[a] : off[b]], off[a : b + 1] - off[a])
            a = b

    def _encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(off), np.int64)
        low, starts = cut(data, off[:-1])
        ends = np.append(starts, len(data)).astype(np.int32)  # a text, and so a slice, has less than 2**31 bytes
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(low)]).dictionary_encode()
        which = pieces.indices.to_numpy(zero_copy_only=False)
        ids = self.look_up(pieces.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // self.dtype.itemsize
        flat, at = np.frombuffer(b"".join(ids), self.dtype), np.cumsum(size, dtype=np.int32) - size
        n = size[which]
        before = np.zeros(len(n) + 1, np.int32)
        np.cumsum(n, out=before[1:])
        out = flat[np.repeat(at[which] - before[:-1], n) + np.arange(before[-1], dtype=np.int32)]
        return out, before[np.searchsorted(starts, off)].astype(np.int64)


def _is_word(p: bytes) -> bool:
    """A run of plain letters, as ``cut`` makes them."""
    return p.isalpha() or (b"\xc3" in p and CLASSES[p[0]] == LETTER and not p.translate(None, _LETTER_BYTES) and p.decode().isalpha())


_LETTER_BYTES = bytes(b for b in range(256) if CLASSES[b] == LETTER or 0x80 <= b <= 0xBF)


@lru_cache(maxsize=2)
def text_ids(path: str) -> TextIds:
    """One memo for each Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return TextIds(path)
