"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

A text is cut before every single space that follows a character which is no white space.  No match
of the splitting pattern crosses such a place, so a text's ids are its chunks' ids in order.  Each
distinct chunk of a batch, found by Arrow's dictionary encoding, is cut into the pattern's matches.  A
match is looked up in a bounded per-worker cache of two generations and otherwise encoded: its bytes
are mapped to the byte alphabet's characters and given to the library's BPE model.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space, and more, before a space: such a space may belong to a longer match.
_UNSAFE = r"[\x00-\x20\x7f\x{80}-\x{a0}\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}] "
_SAFE_CUT = re.compile(r"(?<=\S)(?= )")
#: Punctuation that a match of its own begins with after letters.
_CLOSING = ".,;:!?"
#: Matches after which half of a worker's cache goes, and the longest that is kept, in characters: some 80 MB.
CACHE, LONGEST = 400_000, 64
#: Bytes of text encoded at a time, so that a distinct chunk is looked up once in many texts.
RUN_BYTES = 1 << 23


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, others from U+0100 up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


ALPHABET = byte_alphabet()
_TO_CHAR = {b: c for b, c in enumerate(ALPHABET)}
_TO_BYTE = {c: b for b, c in enumerate(ALPHABET)}


def to_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHAR)


def to_bytes(token: str) -> bytes:
    return bytes(_TO_BYTE[c] for c in token)


def merges_of(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """The merge that made each token: what is left of it when lower ranks have merged all they can."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)))
            if best[0] >= rank:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if len(parts) == 2:
            out.append((to_chars(parts[0]), to_chars(parts[1])))
    return out


class ByteBpe:
    """Encoder and decoder for one vocabulary; make it through ``load``."""

    def __init__(self, model, pattern: str, token_bytes: list[bytes], cache: int = CACHE):
        from tokenizers import Regex, pre_tokenizers

        self.model = model
        self.split = pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.limit = cache
        self.sizes = np.array([len(t) for t in token_bytes], dtype=np.int64)
        self.pool = np.frombuffer(b"".join(token_bytes), dtype=np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _match(self, match: str) -> bytes:
        """Ids of one match of the pattern as little-endian 32-bit integers."""
        ids = self.cache.get(match)
        if ids is None:
            ids = self.older.get(match)
            if ids is None:
                chars = match.replace(" ", "Ġ") if match.isascii() and match.isprintable() else to_chars(match.encode())
                ids = array("I", [t.id for t in self.model.tokenize(chars)]).tobytes()
            if len(match) <= LONGEST:
                self.cache[match] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        # a space at most and Latin letters are one match, closing punctuation after them another
        stem = chunk.rstrip(_CLOSING)
        body = stem[1:] if stem[:1] == " " else stem
        if body.isalpha() and (body.isascii() or max(body) < "ɐ"):
            return self._match(stem) + self._match(chunk[len(stem) :]) if len(stem) < len(chunk) else self._match(chunk)
        return b"".join([self._match(m) for m, _ in self.split.pre_tokenize_str(chunk)])

    def _lookup(self, chunks: list[str]) -> list[bytes]:
        if len(self.cache) > self.limit // 2:
            # matches met again move from the older half to the newer one, the others go
            self.cache, self.older = {}, self.cache
        found = list(map(self.cache.get, chunks))
        for at in [i for i, ids in enumerate(found) if ids is None]:
            found[at] = self._chunk(chunks[at])
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32) and where each text's ids begin; a null counts as empty."""
        texts = texts.fill_null("") if texts.null_count else texts
        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        odd = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(~odd), texts, pa.scalar("", texts.type)) if odd.any() else texts
        parts = pc.split_pattern(plain, " ")
        begin = np.asarray(parts.offsets, dtype=np.int64)
        begin -= begin[0]
        flat = parts.flatten().dictionary_encode()
        slot = np.asarray(flat.indices, dtype=np.int64).copy()
        found = self._lookup([" " + w for w in flat.dictionary.to_pylist()])
        firsts = parts.flatten().take(pa.array(begin[:-1])).to_pylist()
        slot[begin[:-1]] = len(found) + np.arange(len(texts))
        found += self._lookup([w for w in firsts])
        if odd.any():
            rest: list[int] = []
            counts = np.diff(begin)
            pieces: list[np.ndarray] = []
            at = 0
            for row in np.flatnonzero(odd):
                row = int(row)
                pieces.append(slot[begin[at] : begin[row]])
                chunks = _SAFE_CUT.split(texts[row].as_py())
                pieces.append(np.arange(len(found), len(found) + len(chunks)))
                found += self._lookup(chunks)
                counts[row] = len(chunks)
                at = row + 1
            pieces.append(slot[begin[at] :])
            slot = np.concatenate(pieces)
            begin = np.concatenate([[0], np.cumsum(counts)])
        sizes = np.fromiter((len(x) // 4 for x in found), dtype=np.int64, count=len(found))
        pool = np.frombuffer(b"".join(found), dtype="<u4")
        ids, ends = gather(pool, np.cumsum(sizes) - sizes, sizes, slot)
        return ids, np.concatenate([[0], ends])[begin]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; a character split between tokens is whole again once they are joined."""
        out, _ = gather(self.pool, self.starts, self.sizes, ids.astype(np.int64))
        return out.tobytes()

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte start of each id in the decoded text, and the text's length."""
        return np.concatenate([[0], np.cumsum(self.sizes[ids.astype(np.int64)])])


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``pool[starts[s]:starts[s]+sizes[s]]`` for every s in ``slot``, joined, and where each one ends."""
    size = sizes[slot]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts[slot] - (ends - size), size) + np.arange(total)], ends


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBpe:
    """From a ranks file (``.tiktoken``) or a tokenizers file (``.json``) with a byte-level BPE model."""
    from tokenizers import models

    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        bpe = models.BPE(vocab=vocab, merges=merges, cache_capacity=0, ignore_merges=bool(model.get("ignore_merges")))
    else:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        vocab = {to_chars(t): r for t, r in ranks.items()}
        bpe = models.BPE(vocab=vocab, merges=merges_of(ranks), cache_capacity=0, ignore_merges=True)
    tokens = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        tokens[i] = to_bytes(token)
    return ByteBpe(bpe, pattern, tokens)
