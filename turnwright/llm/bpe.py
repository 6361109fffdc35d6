"""BPE encoding and decoding, long unsplit text by tree concatenation.

Text that white space splits is encoded chunk by chunk. A longer run of characters that nothing splits is
halved until the leaves are short; leaves are encoded in parallel by ``WORKERS`` threads (the library holds no lock), and
so are all joins of a level: halves are joined by encoding a window around the join anew. The window grows until its first
token is one that the left half already had there and its last one that the right half had: then all neighbouring tokens
agree, and the join is exact.

Long texts are worked through in pieces, and digests are taken piece by piece, so that a task holds the ids of one text and
little else. Cases: a null text is empty: no tokens, empty decoded text. Repeated rows get equal results."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame

from turnwright.llm.common import append, as_documents, text_slices, worker_state
from turnwright.llm.tokens import ChunkEncoder, production_path

LEAF = 512
WORKERS = 4
#: Leaves or joins that a thread takes at once.
SHARE = 64

Tokens = list[tuple[int, int, int]]  # id, first character, end


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TreeEncoder:
    """Encodes one run of letters of a BPE model; ``last`` tells whether it ends a word."""

    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        model = json.load(open(path))["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = ("unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
        options = {k: model[k] for k in keys if model.get(k)}
        suffix = model.get("end_of_word_suffix") or None
        make = lambda **more: Tokenizer(BPE(vocab=model["vocab"], merges=merges, **options, **more))
        self.inner = make()
        self.final = make(end_of_word_suffix=suffix) if suffix else self.inner
        self.leaf = leaf

    @cached_property
    def pool(self) -> ThreadPoolExecutor:
        return ThreadPoolExecutor(WORKERS)

    def _shared(self, work: Callable[[list], list], items: list) -> list:
        """``work`` on shares of the items, by several threads where there are several shares."""
        shares = [items[i : i + SHARE] for i in range(0, len(items), SHARE)]
        done = self.pool.map(work, shares) if len(shares) > 1 else map(work, shares)
        return [x for part in done for x in part]

    def _plain(self, runs: list[str], last: bool, at: list[int]) -> list[Tokens]:
        made = (self.final if last else self.inner).encode_batch(runs, add_special_tokens=False)
        return [[(i, a + o, b + o) for i, (a, b) in zip(e.ids, e.offsets)] for e, o in zip(made, at)]

    def encode(self, run: str) -> list[int]:
        """Ids of the run, as the model encodes it whole."""
        cuts = [0, len(run)]
        while max(b - a for a, b in zip(cuts, cuts[1:])) > self.leaf:
            cuts = sorted({*cuts, *[(a + b) // 2 for a, b in zip(cuts, cuts[1:]) if b - a > self.leaf]})
        leaves = lambda at: self._plain([run[a:b] for a, b in at], False, [a for a, _ in at])
        parts = self._shared(leaves, list(zip(cuts[:-2], cuts[1:-1]))) + self._plain([run[cuts[-2] :]], True, [cuts[-2]])
        joins = lambda pairs: [self._join(run, a, b) for a, b in pairs]
        while len(parts) > 1:
            joined = self._shared(joins, list(zip(parts[::2], parts[1::2])))
            parts = joined + ([parts[-1]] if len(parts) % 2 else [])
        return [t[0] for t in parts[0]] if parts else []

    def _join(self, run: str, left: Tokens, right: Tokens) -> Tokens:
        size = 4
        while True:
            i, j = max(0, len(left) - size), min(len(right), size)
            begin = left[i][1] if left else right[0][1]
            end = right[j - 1][2] if right else left[-1][2]
            window = self._plain([run[begin:end]], end == len(run), [begin])[0]
            whole_left, whole_right = i == 0, j == len(right)
            if (whole_left or window[0] == left[i]) and (whole_right or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            size *= 2


class Codec:
    """Encodes and decodes whole texts as the library does, without special tokens added."""

    def __init__(self, path: str, leaf: int = LEAF):
        self.chunks = ChunkEncoder(path)
        self.tok = self.chunks.tok
        self.leaf = leaf
        spec = json.load(open(path))
        pre = spec.get("pre_tokenizer") or {}
        kinds = [p["type"] for p in pre.get("pretokenizers", [pre])]
        self.splittable = kinds[-1:] == ["ByteLevel"] and spec["model"]["type"] == "BPE" and self.chunks.by_chunk
        self.tree = TreeEncoder(path, leaf) if self.splittable else None
        self.joined = self.tok.decoder is None
        # Tokens that are cut out of the raw text as they stand; what lies between is encoded by itself.
        added = self.tok.get_added_tokens_decoder()
        plain = all(t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word) for t in added.values())
        self.special = {t.content: i for i, t in added.items()} if plain else None
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def encode_long(self, chunk: str) -> list[int]:
        """Ids of a chunk without white space, its long pieces by tree concatenation."""
        if not self.splittable or self.special is None:
            return self.tok.encode(chunk, add_special_tokens=False).ids
        out: list[int] = []
        for part in self.marks.split(chunk) if self.marks else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part)):
                    out += self.tree.encode(piece) if len(piece) > self.leaf else [t.id for t in self.tok.model.tokenize(piece)]
        return out

    def decoded_hash(self, ids: np.ndarray) -> str:
        """SHA-256 of the library's decoded text in UTF-8; without a decoder that is the tokens with blanks between."""
        if not self.joined:
            return hashlib.sha256(self.tok.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest()
        out = hashlib.sha256()
        for i in range(0, len(ids), 500_000):
            out.update(b" " * (i > 0) + b" ".join(map(self.names.__getitem__, ids[i : i + 500_000].tolist())))
        return out.hexdigest()

    @cached_property
    def names(self) -> list[bytes]:
        """The tokens by id."""
        vocab = self.tok.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            out[i] = token.encode()
        return out

    def _with_long(self, text: str, long: re.Pattern) -> bytes:
        """Ids of a text with long chunks: these by tree concatenation, what lies between as usual."""
        out, at = [], 0
        for m in long.finditer(text):
            out += self.chunks.encode([text[at : m.start()]])
            out.append(np.array(self.encode_long(m[0]), "<u4").tobytes())
            at = m.end()
        return b"".join(out + self.chunks.encode([text[at:]]))

    def digest(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Number of ids, and SHA-256 of the ids and of the decoded text, of each text."""
        counts, ids_hash, text_hash = [], [], []
        long = re.compile(r"[^ \t\n\x0b\x0c\r]{%d,}" % (self.leaf + 1))
        hard = {i for i, t in enumerate(texts) if self.tree is not None and long.search(t)}
        easy = iter(self.chunks.encode([t for i, t in enumerate(texts) if i not in hard]))
        for i, text in enumerate(texts):
            raw = self._with_long(text, long) if i in hard else next(easy)
            counts.append(len(raw) // 4)
            ids_hash.append(hashlib.sha256(raw).hexdigest())
            text_hash.append(self.decoded_hash(np.frombuffer(raw, "<u4")))
        return counts, ids_hash, text_hash


def codec(path: str) -> Codec:
    return worker_state(("codec", path), lambda: Codec(path))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    path = path or production_path()

    def run(texts):
        out: tuple[list, list, list] = ([], [], [])
        texts = [t or "" for t in texts]
        for s in text_slices(texts):
            for a, b in zip(out, codec(path).digest(texts[s])):
                a.extend(b)
        return out

    frame = append(as_documents(docs, "doc_id", "text"), "n_tokens long, ids_sha256 string, decoded_sha256 string", run, "text")
    return frame.drop("text")
