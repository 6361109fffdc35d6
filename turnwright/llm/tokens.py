"""Token ids of whole texts by a tokenizer file, fast where white space always splits tokens."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
from xxhash import xxh3_64_intdigest

from turnwright.llm.common import text_slices, worker_state

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_MARKUP = re.compile("[<|>]")
#: Marks that may follow a word; each run of them is one piece of text for a tokenizer that splits words off.
_MARKS = '.,!?;:*#$%&"()[]-+=/@~^`{}_'

PRODUCTION_VOCABULARY = "word_bpe_49k.json"


def production_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PRODUCTION_VOCABULARY)


class Store:
    """Ids by 64-bit key, in arrays: a table with open addresses, and the ids one after the other.

    Beyond ``limit`` keys it starts anew."""

    def __init__(self, limit: int):
        self.limit = limit
        self._clear(limit)

    def _clear(self, entries: int) -> None:
        """No entries, and room for so many at half the slots."""
        self.bits = max(10, (2 * entries).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.places = np.zeros(1 << self.bits, np.int32)
        self.flat = np.zeros(1 << 16, "<u4")
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = 0

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Each key's place, -1 where it is not known."""
        out = np.full(len(key), -1, np.int64)
        left, slot = np.arange(len(key)), self._slots(key)
        while len(left):
            held = self.keys[slot]
            hit = held == key[left]
            out[left[hit]] = self.places[slot[hit]]
            go = ~hit & (held != 0)
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, key: np.ndarray, place: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """Places of all keys after those without one have got ``ids``."""
        new = np.flatnonzero(place < 0)
        if len(self.size) + len(new) > self.limit:
            # Start anew with what these keys need.
            known = np.flatnonzero(place >= 0)
            kept = [self.flat[b : b + n].tobytes() for b, n in zip(self.begin[place[known]].tolist(), self.size[place[known]].tolist())]
            self._clear(max(self.limit, len(key)))
            ids, new = kept + ids, np.concatenate([known, new])
            place = np.full(len(key), -1, np.int64)
        raw = np.frombuffer(b"".join(ids), "<u4")
        if self.used + len(raw) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(raw), len(self.flat)), "<u4")])
        self.flat[self.used : self.used + len(raw)] = raw
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = len(self.size)
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used += len(raw)
        place[new] = first + np.arange(len(new))
        left, slot = new, self._slots(key[new])
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = key[left[free]]
            mine = free & (self.keys[slot] == key[left])
            self.places[slot[mine]] = place[left[mine]]
            go = ~mine
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return place


class ChunkEncoder:
    """Encodes texts exactly as the library does without special tokens.

    Where the tokenizer drops white space (checked on probes), the ids of a text are those of its
    white-space chunks one after the other; the ids of distinct chunks are kept between texts. New chunks go to
    the library many at a time. see ``Store``."""

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.path, self.limit = path, limit
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        special = [(i, t.content) for i, t in sorted(self.tok.get_added_tokens_decoder().items()) if t.special]
        self.mark = special[0] if special else None
        self.by_chunk = self.mark is not None and self._drops_space()
        self.store = Store(limit)
        self.words = self._word_encoder() if self.by_chunk else None

    def _drops_space(self) -> bool:
        for a, b in (("one", "two"), ("Ünder", "it's"), ("x.", "(y"), ("12", "éa")):
            apart = self._library(a) + self._library(b)
            if any(self._library(a + s + b) != apart for s in (" ", "\n", "  ", "\t\r\n", "  ", "\x0b", " ")):
                return False
        return self._library(" a ") == self._library("a")

    def _library(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _bytes(self, text: str) -> bytes:
        return np.array(self._library(text), dtype="<u4").tobytes()

    def _marked(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without markup, through one call of the library for some thousands."""
        number, mark = self.mark
        out: list[bytes] = []
        for i in range(0, len(chunks), 4000):
            part = chunks[i : i + 4000]
            made = self.tok.encode_batch_fast([mark.join(part)], add_special_tokens=False)[0].ids
            ids = np.array(made, dtype="<u4")
            cuts = np.flatnonzero(ids == number).tolist()
            if len(cuts) != len(part) - 1:
                out += map(self._bytes, part)
                continue
            raw, start = ids.tobytes(), 0
            for cut in cuts:
                out.append(raw[start * 4 : cut * 4])
                start = cut + 1
            out.append(raw[start * 4 :])
        return out

    def _word_encoder(self):
        """A tokenizer for lower-case words of Latin letters alone, or None where words do not stand alone.

        It has the same model, without the normaliser and the splitting pattern, which leave such words as
        they are; each word's last id is one that ends a word."""
        from tokenizers import Tokenizer, pre_tokenizers
        from tokenizers.models import BPE

        spec = json.load(open(self.path))
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "ignore_merges": False}
        if model["type"] != "BPE" or not suffix or any(model.get(k, v) != v for k, v in plain.items()):
            return None
        if [p["type"] for p in pre] != ["Split", "ByteLevel"] or pre[1]["add_prefix_space"] or pre[1]["use_regex"]:
            return None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        tok = Tokenizer(BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=suffix))
        split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), split])
        self._letters = frozenset("abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)])))
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
        for stem, tail in (("straße", "."), ("ärger", "!!"), ("naïvement", ',"'), ("abc", "&&&*"), ("on", "-")):
            for text in (stem, stem + tail, stem.title() + tail, tail):
                apart = [] if text == tail else tok.encode(stem).ids
                if self._library(text) != apart + (self._library(tail) if text.endswith(tail) else []):
                    return None
        return tok

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words, some thousands a call."""
        out: list[bytes] = []
        for i in range(0, len(words), 4000):
            part = words[i : i + 4000]
            ids = np.array(self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(part):
                out += map(self._bytes, part)
                continue
            raw, start = ids.tobytes(), 0
            for cut in cuts:
                out.append(raw[start * 4 : cut * 4])
                start = cut
        return out

    def learn(self, new: list[bytes]) -> list[bytes]:
        """The ids of pieces: words of Latin letters, marks, and any other chunks."""
        texts = [p.decode() for p in new]
        letters = self._letters if self.words is not None else frozenset()
        found: dict[str, bytes] = {}
        words = [w for w in texts if len(w) <= LONGEST and letters.issuperset(w)] if letters else []
        found.update(zip(words, self._word_ids(words)))
        rest = [w for w in texts if w not in found]
        plain = [w for w in rest if not _MARKUP.search(w)]
        found.update(zip(plain, self._marked(plain)))
        return [found[w] if w in found else self._bytes(w) for w in texts]

    def arrays(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in one array, and where each text's ids begin and end.

        Chunks are cut, lower-cased and told apart as byte arrays: a chunk of Latin letters and marks after them is two
        pieces, any other chunk one. Pieces are compared by a 64-bit hash; only distinct ones become objects."""
        raw = [t.encode() for t in texts]
        data = b"\n".join([*raw, b""])
        edges = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=edges[1:])
        b = np.frombuffer(data, np.uint8)
        space = _CLASS[b] == 1
        change = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(b) and not space[0]:
            change = np.concatenate([[0], change])
        start, end = change[::2], change[1::2]
        low = _LOWER[b]
        second = np.flatnonzero(b[:-1] == 0xC3) + 1
        upper = second[(b[second] >= 0x80) & (b[second] <= 0x9E) & (b[second] != 0x97)]
        low[upper] += 0x20
        letter = _CLASS[b] == 2
        accented = second[(b[second] >= 0x80) & (b[second] <= 0xBF) & (b[second] != 0x97) & (b[second] != 0xB7)]
        letter[accented] = letter[accented - 1] = True
        letters = np.zeros(len(b) + 1, np.int32)
        np.cumsum(letter, out=letters[1:])
        marks = np.zeros(len(b) + 1, np.int32)
        np.cumsum(_CLASS[b] == 3, out=marks[1:])
        n = letters[end] - letters[start]
        middle = start + n
        simple = (n > 0) & (letters[middle] - letters[start] == n) & (marks[end] - marks[middle] == end - middle)
        simple &= (end - start <= LONGEST) & (self.words is not None)
        two = simple & (middle < end)
        # Pieces in the order of the text.
        first = np.arange(len(start)) + np.concatenate([[0], np.cumsum(two)[:-1]]) if len(start) else start
        count = len(start) + int(two.sum())
        at, to = np.empty(count, np.int64), np.empty(count, np.int64)
        at[first], to[first] = start, np.where(simple, middle, end)
        at[first[two] + 1], to[first[two] + 1] = middle[two], end[two]
        other = np.ones(count, bool)
        other[first[simple]] = False
        other[first[two] + 1] = False
        power, inverse = _powers(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_RANDOM[low] * power[: len(b)], out=sums[1:])
        good = np.flatnonzero(~other)
        keys = (sums[to[good]] - sums[at[good]]) * inverse[at[good]]
        one, code = distinct(keys)
        lowered = low.tobytes()
        one = good[one]
        whole = np.flatnonzero(other)
        chunks = [data[i:j] for i, j in zip(at[whole].tolist(), to[whole].tolist())]
        names = {c: i for i, c in enumerate(dict.fromkeys(chunks), len(one))}
        codes = np.empty(count, np.int64)
        codes[good] = code
        codes[whole] = np.fromiter(map(names.__getitem__, chunks), np.int64, len(chunks))
        wide = np.fromiter(map(xxh3_64_intdigest, names), np.uint64, len(names))
        key = np.concatenate([(sums[to[one]] - sums[at[one]]) * inverse[at[one]], wide])
        lowered = low.tobytes()
        place = self.store.find(key)
        new = np.flatnonzero(place < 0)
        if len(new):
            listed = list(names)
            span = zip(new.tolist(), at[one[new[new < len(one)]]].tolist(), to[one[new[new < len(one)]]].tolist())
            pieces = [lowered[i:j] for _, i, j in span] + [listed[i - len(one)] for i in new[new >= len(one)].tolist()]
            place = self.store.add(key, place, self.learn(pieces))
        flat, begin, size = self.store.flat, self.store.begin[place], self.store.size[place]
        sizes = size[codes]
        ends = np.zeros(count + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        where = np.repeat(begin[codes] - ends[:-1], sizes) + np.arange(ends[-1])
        return flat[where], ends[np.searchsorted(at, edges)]

    def encode(self, texts: list[str], end: int | None = None) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, ``end`` after each if given."""
        tail = b"" if end is None else np.array([end], dtype="<u4").tobytes()
        if not self.by_chunk:
            return [self._bytes(t) + tail for t in texts]
        # A long text is encoded in pieces that white space parts, so that memory does not grow with its length.
        pieces = [list(cut_at_space(t, SLICE)) for t in texts]
        flat = [x for p in pieces for x in p]
        made: list[bytes] = []
        for s in text_slices(flat, SLICE, free=False):
            ids, ends = self.arrays(flat[s])
            raw = ids.tobytes()
            made += [raw[i:j] for i, j in zip((ends[:-1] * 4).tolist(), (ends[1:] * 4).tolist())]
        at = iter(made)
        return [b"".join([*islice(at, len(p)), tail]) for p in pieces]


#: Characters that are worked on at once; a longer run without white space stands alone.
SLICE = 200_000

_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]")


def cut_at_space(text: str, most: int) -> Iterator[str]:
    """Pieces of ``text``, each of ``most`` characters and up to the next white space, which begins the next piece."""
    start = 0
    while len(text) - start > most and (m := _SPACE.search(text, start + most)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text

#: Longest chunk, in bytes, that is told apart by its hash.
LONGEST = 60

_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[[*range(65, 91), *range(97, 123)]] = 2
_CLASS[[ord(c) for c in _MARKS]] = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def distinct(keys: np.ndarray, bits: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """(places of the distinct keys, number of each key among them): by a table of slots, clashes by sorting."""
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
    table = np.zeros(1 << bits, np.int32)
    table[slot] = np.arange(len(keys), dtype=np.int32)
    rep = table[slot]
    same = keys[rep] == keys
    chosen = np.zeros(len(keys), bool)
    chosen[rep[same]] = True
    one = np.flatnonzero(chosen)
    number = np.empty(len(keys), np.int64)
    number[one] = np.arange(len(one))
    code = number[rep]
    rest = np.flatnonzero(~same)
    if len(rest):
        _, first, inverse = np.unique(keys[rest], return_index=True, return_inverse=True)
        code[rest] = inverse + len(one)
        one = np.concatenate([one, rest[first]])
    return one, code


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (by ASCII white space) of all texts, and how many words each text has."""
    if max(map(len, texts), default=0) > 4 * SLICE:  # long texts in pieces; a word's hash is the same anywhere
        pieces = [list(cut_at_space(t, SLICE)) for t in texts]
        made = [word_hashes([x]) for p in pieces for x in p]
        count = np.add.reduceat([int(c[0]) for _, c in made], np.cumsum([0, *map(len, pieces[:-1])]))
        return np.concatenate([h for h, _ in made]), count
    raw = [t.encode() for t in texts]
    b = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    space = _CLASS[b] == 1
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(b) and not space[0]:
        change = np.concatenate([[0], change])
    start, end = change[::2], change[1::2]
    power, inverse = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_RANDOM[b] * power[: len(b)], out=sums[1:])
    edges = np.cumsum([0] + [len(r) + 1 for r in raw])
    count = np.diff(np.searchsorted(start, edges))
    return (sums[end] - sums[start]) * inverse[start], count


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x9E3779B97F4A7C15
        size = max(n, 1 << 18)
        out = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def encoder(path: str) -> ChunkEncoder:
    """This Python process's encoder of ``path``."""
    return worker_state(("encoder", path), lambda: ChunkEncoder(path))
