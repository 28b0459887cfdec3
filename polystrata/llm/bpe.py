"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the others by a heap over linked bytes; decoding by id."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

_LATIN_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_LATIN_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN_SPACES = "\t-\r \x85\xa0"


def latin_pattern(pattern: str) -> str | None:
    """The pattern in classes of Latin-1 only, for the standard `re`; None where it uses more than letters, numbers and spaces."""
    p = pattern.replace(r"\s\p{L}\p{N}", _LATIN_SPACES + _LATIN_LETTERS + _LATIN_NUMBERS).replace(r"\p{L}", f"[{_LATIN_LETTERS}]").replace(r"\p{N}", f"[{_LATIN_NUMBERS}]")
    p = p.replace(r"\S", f"[^{_LATIN_SPACES}]").replace(r"\s", f"[{_LATIN_SPACES}]")
    return None if "\\p" in p or "\\P" in p else p


class PerfectHash:
    """A minimal perfect hash of byte strings by hash and displace: a seed per bucket, a slot per key, the key kept to tell strangers.

    Keys are split into len(keys) / 4 buckets; the largest first, each tries
    seeds until its keys fall into free slots. A look-up costs two hashes and
    one comparison.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        self.n = max(1, len(keys))
        self.buckets = self.n // 4 + 1
        self.seeds = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * self.n
        self.values = [0] * self.n
        groups: dict[int, list[int]] = {}
        for i, k in enumerate(keys):
            groups.setdefault(self._mix(k, 0) % self.buckets, []).append(i)
        for bucket, members in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            seed = 1
            while True:
                slots = [self._mix(keys[i], seed) % self.n for i in members]
                if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                    break
                seed += 1
            self.seeds[bucket] = seed
            for i, s in zip(members, slots):
                self.keys[s], self.values[s] = keys[i], values[i]

    @staticmethod
    def _mix(key: bytes, seed: int) -> int:
        x = (hash_bytes(key) ^ (seed * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return x ^ (x >> 29)

    def get(self, key: bytes) -> int | None:
        slot = self._mix(key, self.seeds[self._mix(key, 0) % self.buckets]) % self.n
        return self.values[slot] if self.keys[slot] == key else None


try:
    from xxhash import xxh3_64_intdigest as hash_bytes
except ImportError:

    def hash_bytes(key: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little")


class Memo(dict):
    """What recent pre-tokens became, in two generations of at most `most` entries each; a hint only, never needed."""

    def __init__(self, make: Callable[[str], object], most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ByteBPE:
    """Encodes and decodes by a ranks file (base64 token, rank a line) and a splitting pattern, without special tokens."""

    def __init__(self, path: str, pattern: str, memo: int = 250_000):
        import regex

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.tokens = [b""] * (max(int(r) for _, r in pairs) + 1)
        self.ranks: dict[bytes, int] = {}
        for token, rank in pairs:
            self.tokens[int(rank)] = raw = base64.b64decode(token)
            self.ranks[raw] = int(rank)
        self.whole = PerfectHash(list(self.ranks), list(self.ranks.values()))
        latin = latin_pattern(pattern)
        self.any = regex.compile(pattern)
        self.latin = re.compile(latin) if latin else None
        self.spelled = Memo(lambda t: " ".join(map(str, self.pretoken(t.encode("utf-8", "surrogatepass")))), memo)
        self.by_text = {str(i): t for i, t in enumerate(self.tokens)}

    def merge(self, raw: bytes) -> list[int]:
        """Merges the adjacent pair of lowest rank, the leftmost first, until none is left: a heap of pairs over a doubly linked list of parts."""
        n = len(raw)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        end = list(range(1, n + 1))
        ranks, heap = self.ranks, []
        for i in range(n - 1):
            r = ranks.get(raw[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if end[i] < 0:
                continue
            j = after[i]
            if j >= n or end[j] != stop:
                continue  # one of the two has grown or gone
            end[i], end[j] = stop, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := ranks.get(raw[i : end[k]])) is not None:
                    heapq.heappush(heap, (x, i, end[k]))
            if (p := before[i]) >= 0 and (x := ranks.get(raw[p:stop])) is not None:
                heapq.heappush(heap, (x, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = after[i]
        return out

    def pretoken(self, raw: bytes) -> list[int]:
        whole = self.whole.get(raw)
        return [whole] if whole is not None else self.merge(raw)

    def split(self, text: str) -> list[str]:
        if self.latin and (text.isascii() or max(text) <= "\xff"):
            return self.latin.findall(text)
        return self.any.findall(text)

    def spell(self, text: str) -> str:
        """The ids in decimal, joined by one space."""
        return " ".join(map(self.spelled.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.spell(text).split()]

    def decode_spelled(self, ids: str) -> bytes:
        return b"".join(map(self.by_text.__getitem__, ids.split()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens[i] for i in ids)


_made: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """One per worker process and vocabulary."""
    if (path, pattern) not in _made:
        _made[path, pattern] = ByteBPE(path, pattern)
    return _made[path, pattern]


def _text(x: object) -> str:
    return x if isinstance(x, str) else ""


def encode_documents(docs: DataFrame, path: str, pattern: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, carried columns, n_tokens, token_ids: one row for each input row, in one narrow pass.

    Null texts count as empty and give no tokens. Every text is encoded whole,
    whatever its length; long texts go in slices of rows so that a batch's ids
    stay small. Ids, repeated or null, are passed through; other columns are
    ignored unless carried.
    """
    ship(docs.sparkSession)
    kept = docs.select("doc_id", *carry, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = coder(path, pattern)
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                ids = [np.array(bpe.spell(_text(t)).split(), np.int32) for t in part["text"]]
                yield part.drop(columns="text").assign(n_tokens=[len(x) for x in ids], token_ids=ids)

    return kept.mapInPandas(run, schema + ", n_tokens long, token_ids array<int>")


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As encode_documents, but with digests of the ids and of the bytes decoded from them."""
    ship(docs.sparkSession)
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = coder(path, pattern)
        for pdf in batches:
            n, ids, back = [], [], []
            for t in pdf["text"]:
                spelled = bpe.spell(_text(t))
                n.append(spelled.count(" ") + 1 if spelled else 0)
                ids.append(hashlib.sha256(spelled.encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode_spelled(spelled)).hexdigest())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": back})

    return kept.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
