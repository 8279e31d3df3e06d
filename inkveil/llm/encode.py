"""Token ids by the tokenizers library, in Arrow batches on the executors."""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from inkveil.llm import bytetext as B

#: Words that one worker remembers (some 50 bytes each), and the bytes of the longest; others are encoded whenever they come.
REMEMBERED = 500_000
REMEMBERED_BYTES = 64

#: Parts that the library encodes at once.
GROUP = 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def splits_at_spaces(spec: dict) -> bool:
    """Whether the tokenizer drops white space before its merges, so that parts between spaces can be
    encoded one by one: its normaliser turns runs of white space into one space, and its first
    pre-tokeniser keeps only matches of a pattern without white space."""
    normalisers = (spec.get("normalizer") or {}).get("normalizers", [])
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    collapsed = any(x.get("type") == "Replace" and x.get("pattern") == {"Regex": "\\s+"} and x.get("content") == " " for x in normalisers)
    plain = all(x.get("type") in ("NFC", "Replace", "Lowercase") for x in normalisers) and any(x.get("type") == "Lowercase" for x in normalisers)
    dropped = bool(steps) and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
    return collapsed and plain and dropped and not any(" " in x["content"] or x.get("lstrip") or x.get("rstrip") for x in spec.get("added_tokens") or [])


_LAST = np.isin(np.arange(256), [ord(","), ord(".")])
_PLAIN = np.zeros(256, bool)
_PLAIN[0x30:0x3A] = _PLAIN[0x61:0x7B] = True


def _picked(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of values one after another, and where each begins (one more entry than ranges)."""
    begin = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    return values[np.arange(begin[-1]) + np.repeat(start - begin[:-1], count)], begin


class Encoder:
    """Texts to id sequences, equal to the library's own encoding of each whole text with
    add_special_tokens=False.

    Each distinct part between spaces is encoded once by the library and remembered with its bytes, found by a 64-bit digest of
    them; parts that share a digest but not their bytes are encoded by themselves. When there are too many, those that did not come
    again are forgotten. Since the tokenizer lower-cases, parts that differ in ASCII case are one; a last comma or stop
    after an ASCII letter or digit is a part of its own, as it is for the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.by_part = splits_at_spaces(spec)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.special = [x["content"].lower().encode() for x in spec.get("added_tokens") or []]
        self.known = np.zeros(0, np.uint64)  # sorted digests
        self.slot = np.zeros(0, np.int32)  # and their places in:
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)  # whether a part has come again since parts were last forgotten
        self.ids = np.zeros(0, self.dtype)
        self.bytes = np.zeros(0, np.uint8)  # of the remembered parts, and where each begins (one more entry than parts)
        self.place = np.zeros(1, np.int64)

    def _library(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """In small groups: the library's own result for a part takes far more memory than its ids."""
        ids, count = [], []
        for k in range(0, len(parts), GROUP):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(parts[k : k + GROUP], add_special_tokens=False)]
            count += map(len, lists)
            ids.append(np.fromiter(itertools.chain.from_iterable(lists), self.dtype))
        return np.concatenate([np.zeros(0, self.dtype), *ids]), np.array(count, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (one more entry than texts)."""
        if not self.by_part:
            texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(len(offsets) - 1)]
            ids, count = self._library(texts)
            return ids, np.r_[0, np.cumsum(count)]
        # Case matters to marks that compose with a preceding letter, and to special tokens: then it stays.
        low = B.LOWER[data]
        if ((data == 0xCC) | (data == 0xCD)).any() or any(x in low.tobytes() for x in self.special):
            low = data
        starts, ends, first = self._parts(low, offsets)
        distinct, where, inverse = self._distinct(low, starts, ends)
        begin, end = starts[where], ends[where]
        at = np.searchsorted(self.known, distinct)
        inside = np.flatnonzero(at < len(self.known))
        hit = np.zeros(len(distinct), bool)
        hit[inside] = self.known[at[inside]] == distinct[inside]
        taken = hit.copy()
        own = self.slot[at[hit]]
        hit[hit] = B.equal(low, begin[hit], end[hit], self.bytes, self.place[own], self.place[own + 1])
        start, count, store = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), self.ids
        own = self.slot[at[hit]]
        start[hit], count[hit] = self.start[own], self.count[own]
        self.again[own] = True
        if not hit.all():
            fresh = np.flatnonzero(~hit)
            raw = low.tobytes()
            parts = [raw[a:b] for a, b in zip(begin[fresh].tolist(), end[fresh].tolist(), strict=True)]
            ids, n = self._library([x.decode() for x in parts])
            start[fresh], count[fresh] = len(store) + np.cumsum(n) - n, n
            store = np.concatenate([store, ids])
            if len(self.known) + len(fresh) > REMEMBERED:
                self._forget()
            if len(self.known) + len(fresh) <= REMEMBERED:
                self._remember(distinct[fresh], taken[fresh], parts, ids, n)
        out, total = _picked(store, start[inverse], count[inverse])
        return out, total[first]

    @staticmethod
    def _distinct(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct parts' digests, a part with each, and for every part its entry. Parts whose bytes are not those of
        their digest's entry have an entry of their own at the end."""
        distinct, where, inverse = np.unique(B.digests(low, starts, ends), return_index=True, return_inverse=True)
        same = B.equal(low, starts, ends, low, starts[where[inverse]], ends[where[inverse]])
        if not same.all():
            odd = np.flatnonzero(~same)
            inverse[odd] = len(distinct) + np.arange(len(odd))
            distinct, where = np.r_[distinct, B.digests(low, starts[odd], ends[odd])], np.r_[where, odd]
        return distinct, where, inverse

    def _forget(self) -> None:
        """Keeps the parts that have come again, or none if these are more than half of what may be remembered."""
        kept = np.flatnonzero(self.again)
        if len(kept) > REMEMBERED // 2:
            kept = kept[:0]
        place = np.full(len(self.start), -1, np.int32)
        place[kept] = np.arange(len(kept), dtype=np.int32)
        here = place[self.slot] >= 0
        self.known, self.slot = self.known[here], place[self.slot[here]]
        self.ids, begin = _picked(self.ids, self.start[kept], self.count[kept])
        self.start, self.count = begin[:-1], self.count[kept]
        self.bytes, self.place = _picked(self.bytes, self.place[kept], self.place[kept + 1] - self.place[kept])
        self.again = np.zeros(len(kept), bool)

    def _remember(self, digest: np.ndarray, taken: np.ndarray, parts: list[bytes], ids: np.ndarray, count: np.ndarray) -> None:
        """Keeps parts of up to REMEMBERED_BYTES whose digest no remembered one has, the first of each digest."""
        _, first = np.unique(digest, return_index=True)
        keep = np.zeros(len(digest), bool)
        keep[first] = True
        keep = np.flatnonzero(keep & ~taken & (np.fromiter(map(len, parts), np.int64, len(parts)) <= REMEMBERED_BYTES))
        keep = keep[np.argsort(digest[keep], kind="stable")]
        place = np.searchsorted(self.known, digest[keep])
        self.known = np.insert(self.known, place, digest[keep])
        self.slot = np.insert(self.slot, place, np.arange(len(self.start), len(self.start) + len(keep), dtype=np.int32))
        more, begin = _picked(ids, (np.cumsum(count) - count)[keep], count[keep])
        self.start, self.count = np.r_[self.start, len(self.ids) + begin[:-1]], np.r_[self.count, count[keep]]
        self.again = np.r_[self.again, np.zeros(len(keep), bool)]
        self.ids = np.concatenate([self.ids, more])
        raw = [parts[k] for k in keep.tolist()]
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(raw), np.uint8)])
        self.place = np.r_[self.place, self.place[-1] + np.cumsum(list(map(len, raw)), dtype=np.int64)]

    @staticmethod
    def _parts(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, first = B.words(low, offsets, B.NOT_SPACE)
        cut = np.flatnonzero((ends - starts > 1) & _LAST[low[ends - 1]] & _PLAIN[low[np.maximum(ends - 2, 0)]])
        where = cut + 1
        more = np.searchsorted(cut, first)  # cuts before each text's first part
        return np.insert(starts, where, ends[cut] - 1), np.insert(ends, cut, ends[cut] - 1), first + more

    def column(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For ranges i:j of the column's texts (null: empty): their ids, and where each text's begin."""
        data, offsets = B.column_bytes(column)
        for i, j in B.runs(offsets):
            yield i, j, *self.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
