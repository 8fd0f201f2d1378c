"""Token ids of whole texts by the tokenizers library, with a bounded memory of parts already encoded.

A byte-level BPE encodes the pieces of its splitting pattern one by one, and a piece never runs on over a space
that stands after or before a character other than white space. So a text is cut at such spaces; a part of letters and
the signs after them is cut between the two, as the pattern does. All parts of many texts are found and looked up at
once (numpy over UTF-8 bytes, an open-addressing table of 64-bit hashes whose entries are checked by length and first
bytes), and each distinct part is encoded by the library's model once per worker process. Everything else - other
tokenizers, special tokens within the text, unusual white space - is encoded by the library as a whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from kindred.llm import remembered, textscan

# The splitting pattern of byte-level BPE and its special token: fixed values of the public vocabulary format.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ɏ0-9]+|\s+(?!\S)|\s+")
#: Characters whose class (letter, digit, other, white space) the pattern above and the library see alike.
PLAIN = re.compile(r"[\n\x20-\x7eÀ-ÖØ-öø-ɏ]*\Z")
UNSAFE_GAP = re.compile(r"\s \s")
#: Signs that end a word without a contraction: all of ASCII's but the apostrophe.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
END_ID = 0
MEMORY = 1_000_000  # parts that one worker process remembers, about 60 bytes each

_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN[[ord(c) for c in SIGNS]] = True
_SPACED = np.uint64(0x5851F42D4C957F2D)

_codecs: dict[str, "Codec"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def codec(path: str) -> "Codec":
    """The codec of this process: workers are reused, and so is what they have encoded."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others as the letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _letters(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters of ASCII or of U+00C0 to U+024F, without the two signs among them."""
    found = _LETTER[raw]
    if len(raw) > 1:
        a, b = raw[:-1], raw[1:]
        two = (a >= 0xC3) & (a <= 0xC9)
        if two.any():
            two &= ~((a == 0xC3) & ((b == 0x97) | (b == 0xB7))) & ~((a == 0xC9) & (b > 0x8F))
            found[:-1] |= two
            found[1:] |= two
    return found


class _Memory:
    """Entries by 64-bit key in an open-addressing table: numpy arrays of bounded size."""

    def __init__(self, most: int):
        self.most = most
        self.keys = np.zeros(1 << max(4, (2 * most - 1).bit_length()), np.uint64)
        self.entry = np.zeros(len(self.keys), np.int32)
        self.check, self.start, self.count = (np.zeros(1024, kind) for kind in (np.uint64, np.int64, np.int32))
        self.ids = np.zeros(4096, np.uint32)
        self.n = self.n_ids = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        mask = np.uint64(len(self.keys) - 1)
        out = np.full(len(keys), -1, np.int64)
        slot, left = (keys & mask).astype(np.int64), np.arange(len(keys))
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.entry[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & int(mask)
        return out

    def add(self, keys: np.ndarray, check: np.ndarray, ids: list[list[int]]) -> None:
        """New keys, each once."""
        n, counts = len(keys), np.array([len(x) for x in ids], np.int32)
        flat = np.array([i for x in ids for i in x], np.uint32)
        for name, size in (("check", self.n + n), ("start", self.n + n), ("count", self.n + n), ("ids", self.n_ids + len(flat))):
            held = getattr(self, name)
            if size > len(held):
                grown = np.zeros(max(size, 3 * len(held) // 2), held.dtype)
                grown[: len(held)] = held
                setattr(self, name, grown)
        new = slice(self.n, self.n + n)
        self.check[new], self.count[new] = check, counts
        self.start[new] = self.n_ids + np.cumsum(counts) - counts
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        mask, left = len(self.keys) - 1, np.arange(n)
        slot = (keys & np.uint64(mask)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.keys[slot[taken]] = keys[left[taken]]
            self.entry[slot[taken]] = self.n + left[taken]
            on = np.ones(len(left), bool)
            on[taken] = False
            left, slot = left[on], (slot[on] + 1) & mask
        self.n, self.n_ids = self.n + n, self.n_ids + len(flat)


class Codec:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        self.special = [x["content"] for x in spec.get("added_tokens") or []]
        self.by_parts = (
            spec["model"]["type"] == "BPE" and not spec.get("normalizer") and not spec["model"].get("dropout")
            and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
            and not any(" " in x for x in self.special)
        )
        # a special token of letters, or of signs, alone could hide within a word or the signs after it
        self.worded = not any(re.fullmatch(r"[^\W\d_]+|[^\w\s]+", x) for x in self.special)
        self.vocabulary_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._spelling = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.forget()

    def forget(self) -> None:
        self._memory: _Memory | None = None

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _piece(self, piece: bytes) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece.decode("latin-1").translate(self._spelling))]

    def _learned(self, parts: list[bytes], simple: list[bool]) -> list[list[int]]:
        """Ids of parts, each with its leading space, if any. simple: it is one piece."""
        out: list[list[int] | None] = []
        for part, one in zip(parts, simple):
            if one:
                out.append(self._piece(part))
                continue
            text = part.decode()
            if PLAIN.match(text) and not any(x in text for x in self.special):
                out.append([i for x in PIECES.findall(text) for i in self._piece(x.encode())])
            else:
                out.append(None)
        hard = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(hard, self._whole([parts[i].decode() for i in hard])):
            out[i] = ids
        return out

    def _by_parts(self, texts: list[str]) -> list[bytes]:
        blobs = [t.encode() for t in texts]
        data = b"".join(blobs)
        raw = np.frombuffer(data, np.uint8)
        at = np.cumsum([0, *map(len, blobs)])
        gaps = np.flatnonzero(raw == 0x20)
        counts = np.diff(np.searchsorted(gaps, at)) + 1
        firsts = np.cumsum(counts) - counts
        n = len(gaps) + len(texts)
        spaced, inner = np.ones(n, bool), np.ones(n, bool)
        spaced[firsts], inner[firsts + counts - 1] = False, False
        starts, ends = np.empty(n, np.int64), np.empty(n, np.int64)
        starts[firsts], starts[spaced] = at[:-1], gaps + 1
        ends[~inner], ends[inner] = at[1:], gaps

        # letters and the signs after them: two items, if the part is nothing else
        stem = ends.copy()
        able = np.flatnonzero(ends > starts)
        able = able[_SIGN[raw[ends[able] - 1]]]
        while len(able):
            stem[able] -= 1
            able = able[stem[able] > starts[able]]
            able = able[_SIGN[raw[stem[able] - 1]]]
        letters = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(_letters(raw), out=letters[1:])
        simple = (stem > starts) & (letters[stem] - letters[starts] == stem - starts) & self.worded
        tailed = simple & (stem < ends)
        stem = np.where(simple, stem, ends)

        items = n + int(tailed.sum())
        place = np.arange(n) + np.cumsum(tailed) - tailed
        low, high, lead, one = np.empty(items, np.int64), np.empty(items, np.int64), np.zeros(items, bool), np.ones(items, bool)
        low[place], high[place], lead[place], one[place] = starts, stem, spaced, simple
        low[place[tailed] + 1], high[place[tailed] + 1] = stem[tailed], ends[tailed]

        keys = textscan.span_hashes(raw, low, high)
        keys[lead] ^= _SPACED
        keys[keys == 0] = 1
        size = high - low
        eight = np.ndarray((len(raw) + 1,), "<u8", data + bytes(8), strides=(1,))[low]
        eight &= (np.uint64(1) << (np.uint64(8) * np.minimum(size, 7).astype(np.uint64))) - np.uint64(1) | np.where(size > 7, ~np.uint64(0), np.uint64(0))
        check = eight ^ textscan.mixed(size.astype(np.uint64) * np.uint64(2) + lead)

        memory = self._memory
        if memory is None or memory.n > 3 * memory.most // 4:
            memory = self._memory = _Memory(MEMORY)
        entry = memory.find(keys)
        fresh = np.flatnonzero(entry < 0)
        if len(fresh):
            _, first = np.unique(keys[fresh], return_index=True)
            new = fresh[first]
            if memory.n + len(new) > memory.most:  # many parts at once: a memory for them alone
                memory = self._memory = _Memory(max(MEMORY, 2 * len(keys)))
                _, new = np.unique(keys, return_index=True)
                fresh = np.arange(len(keys))
            parts = [b" " + data[a:b] if s else data[a:b] for a, b, s in zip(low[new].tolist(), high[new].tolist(), lead[new].tolist())]
            memory.add(keys[new], check[new], self._learned(parts, one[new].tolist()))
            entry[fresh] = memory.find(keys[fresh])
        told = memory.count[entry]
        total = np.zeros(items + 1, np.int64)
        np.cumsum(told, out=total[1:])
        ids = memory.ids[np.repeat(memory.start[entry] - total[:-1], told) + np.arange(total[-1])].astype("<u4")
        bounds = total[np.append(place[firsts], items)]
        out = [ids[a:b].tobytes() for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
        wrong = memory.check[entry] != check
        if wrong.any():  # two parts of one hash
            rows = np.unique(np.searchsorted(place[firsts], np.flatnonzero(wrong), side="right") - 1).tolist()
            for i, found in zip(rows, self._whole([texts[i] for i in rows])):
                out[i] = np.array(found, "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, without special or end tokens added."""
        remembered.claim(self)
        easy = [i for i, t in enumerate(texts) if not UNSAFE_GAP.search(t)] if self.by_parts else []
        out: list[bytes | None] = [None] * len(texts)
        if easy:
            for i, ids in zip(easy, self._by_parts([texts[i] for i in easy])):
                out[i] = ids
        hard = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(hard, self._whole([texts[i] for i in hard])):
            out[i] = np.array(ids, "<u4").tobytes()
        return out
