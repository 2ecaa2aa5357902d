"""BPE by a bounded-lookahead streaming transducer, in lockstep over many words; decoding by a byte-to-text state machine.

Lookahead. A merge z = x + y of rank r stands or falls with its right neighbours only through
merges of lower rank that take y first: those of (y, w), which in turn depend on what follows
w. Walking the merge list by rank gives for each token a bound on the bytes behind it that
can matter, and so the SUFFICIENT LOOKAHEAD of the list: once that many bytes from a token's
start are known, the token is final. The transducer merges a window of bounded size, emits
the tokens that are final, and goes on from the first one that is not. It holds one window,
however long the input.

Speed. Pre-tokens are cut by numpy over the code points of a batch. Equal ones are brought
together by a hash and then compared character by character, so that a clash of hashes never
gives one the ids of another. Each distinct one is merged once, in lockstep with others of like
length, and kept in a bounded memo under its characters; those longer than LONG bytes go
through the transducer alone, unkept.

Ids equal those of the tokenizers library for byte-level files with or without an end-of-word
suffix. Null or empty text: no ids. Added tokens in a text become their ids. Very long texts: a
text is cut in pre-tokens whole, and a pre-token of any length takes one window of memory. Repeated
rows and ids: each row gets its own result, the same for equal texts. Empty table: no rows. Other
columns, whatever their names, are not read. There are no ties: the merge of least rank, then the
leftmost, is always one.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tempora.llm.common import Bounded, documents, small_batches
from tempora.llm.sorted_hash import Finder

#: Bytes of a pre-token beyond which it goes through the transducer's windows.
LONG = 48
#: Pre-tokens that a worker remembers at most.
MEMO = 300_000
#: Characters that are cut into pre-tokens at a time; one text is never split here.
SLICE = 1 << 19

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_NONE = np.int32(2**31 - 1)
_classes: np.ndarray | None = None
_lower: np.ndarray | None = None


def byte_symbols() -> list[str]:
    """The printable symbol that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


def char_classes() -> np.ndarray:
    """Class of each code point. Those that the standard library does not know yet count as OTHER."""
    global _classes
    if _classes is None:
        c = np.full(sys.maxunicode + 1, OTHER, dtype=np.int8)
        text = "".join(map(chr, range(sys.maxunicode + 1)))
        for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            for m in regex.finditer(pattern, text):
                c[m.start() : m.end()] = value
        unknown = [i for i in np.flatnonzero(c != OTHER).tolist() if unicodedata.category(chr(i)) == "Cn"]
        c[unknown] = OTHER
        _classes = c
    return _classes


def lower_map() -> np.ndarray:
    global _lower
    if _lower is None:
        _lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
        for i in range(sys.maxunicode + 1):
            if len(low := chr(i).lower()) == 1:
                _lower[i] = ord(low)
    return _lower


class Table:
    """Merges and vocabulary of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        self.suffixed = bool(suffix)
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in vocab.items():
            t = t.removesuffix(suffix) if suffix else t
            self.bytes[i] = bytes(back[c] for c in t) if t not in self.special else t.encode()
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.text = [str(i) for i in range(len(self.bytes))]
        pairs = []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.append((vocab[a], vocab[b], vocab[a + b]))
        self.rank = {(a, b): (r, c) for r, (a, b, c) in enumerate(pairs)}
        self.lookahead = self._lookahead(pairs)
        self.window = max(4 * self.lookahead, 256)
        p = np.array(pairs, dtype=np.int64).reshape(-1, 3)
        key = self._key(p[:, 0], p[:, 1])
        order = np.argsort(key)
        self.pairs = Finder(key[order])
        self.ranks = np.append(order.astype(np.int32), _NONE)
        self.merged = p[:, 2]
        lens = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.byte_at = np.concatenate([[0], np.cumsum(lens)])
        self.byte_flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)

    def _lookahead(self, pairs: list[tuple[int, int, int]]) -> int:
        reach: dict[int, int] = {}  # bytes behind a token that can decide whether it forms
        taken: dict[int, int] = {}  # the same of the merges so far that take the token as their left part
        size = [len(b) for b in self.bytes]
        most = 1
        for x, y, z in pairs:
            d = max(reach.get(x, 0) - size[y], reach.get(y, 0), taken.get(y, 0), 0)
            reach[z] = max(reach.get(z, 0), d)
            taken[x] = max(taken.get(x, 0), size[y] + reach[z])
            most = max(most, size[z] + reach[z])
        return most

    # -- merging

    def merge(self, data: bytes, last: bool) -> list[int]:
        """Merge one sequence, least rank first and leftmost among equals; last: it ends a pre-token."""
        ids = self.inner[np.frombuffer(data, dtype=np.uint8)].tolist()
        if last and ids:
            ids[-1] = int(self.final[data[-1]])
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, z, i, p = heapq.heappop(heap)
            j = after[i]
            if ids[i] != p[0] or j >= n or ids[j] != p[1]:
                continue
            ids[i], ids[j] = z, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := (z, ids[k])) in self.rank:
                    heapq.heappush(heap, (*self.rank[q], i, q))
            if (h := before[i]) >= 0 and (q := (ids[h], z)) in self.rank:
                heapq.heappush(heap, (*self.rank[q], h, q))
        return [x for x in ids if x >= 0]

    def lockstep(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as int32 bytes; all of like length are merged together."""
        out: list[bytes] = [b""] * len(words)
        size = np.array([len(w) for w in words])
        for i in np.flatnonzero(size > LONG).tolist():
            t = Transducer(self)
            out[i] = np.array(t.feed(words[i]) + t.finish(), dtype=np.int32).tobytes()
        order = np.flatnonzero((size <= LONG) & (size > 0))
        order = order[np.argsort(size[order], kind="stable")]
        for lo in range(0, len(order), 4096):
            part = order[lo : lo + 4096]
            self._merge_block([words[i] for i in part.tolist()], part, out)
        return out

    def _merge_block(self, words: list[bytes], place: np.ndarray, out: list[bytes]) -> None:
        width = max(map(len, words))
        n = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), dtype=np.uint8).reshape(-1, width)
        cols = np.arange(width)
        ids = np.full((len(words), width + 1), -1, dtype=np.int64)
        ids[:, :width] = np.where(cols < n[:, None] - 1, self.inner[raw], np.where(cols == n[:, None] - 1, self.final[raw], -1))
        rank = np.full((len(words), width + 1), _NONE, dtype=np.int32)
        r, c = np.nonzero(cols < n[:, None] - 1)
        rank[r, c] = self.ranks[self.pairs.rows(self._key(ids[r, c], ids[r, c + 1]))]

        def done(rows: np.ndarray) -> None:
            for w, k, m in zip(ids[rows].astype(np.int32), place[rows].tolist(), n[rows].tolist()):
                out[k] = w[:m].tobytes()

        while True:
            p = rank.argmin(axis=1)
            rows = np.arange(len(ids))
            best = rank[rows, p]
            live = best != _NONE
            if not live.all():
                done(np.flatnonzero(~live))
                ids, rank, p, best, place, n = ids[live], rank[live], p[live], best[live], place[live], n[live]
                rows = np.arange(len(ids))
            if not len(ids):
                return
            ids[rows, p] = self.merged[best]
            shift = np.arange(width) + (np.arange(width) > p[:, None])
            ids[:, :-1] = np.take_along_axis(ids, shift, axis=1)
            rank[:, :-1] = np.take_along_axis(rank, shift, axis=1)
            n -= 1
            ids[rows, n] = -1
            for at in (p - 1, p):
                ok = (at >= 0) & (at < n - 1)
                a = np.maximum(at, 0)
                new = self.ranks[self.pairs.rows(self._key(np.where(ok, ids[rows, a], 0), np.where(ok, ids[rows, a + 1], 0)))]
                rank[rows[at >= 0], a[at >= 0]] = np.where(ok, new, _NONE)[at >= 0]
            top = int(n.max())
            if top < width - 4:
                width = top + 1
                ids, rank = ids[:, : width + 1].copy(), rank[:, : width + 1].copy()
                rank[:, width] = _NONE


class Transducer:
    """Bytes of one pre-token in, final ids out; holds at most one window."""

    def __init__(self, table: Table):
        self.table, self.held = table, bytearray()

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        t = self.table
        for lo in range(0, len(data), t.window):
            self.held += data[lo : lo + t.window]
            while len(self.held) > t.window:
                at = 0
                for i in t.merge(bytes(self.held[: t.window]), False):
                    if at + t.lookahead > t.window:
                        break
                    out.append(i)
                    at += len(t.bytes[i])
                del self.held[:at]
        return out

    def finish(self) -> list[int]:
        out = self.table.merge(bytes(self.held), True)
        self.held.clear()
        return out


class Decoder:
    """Ids in, text out: bytes of tokens pass a UTF-8 state machine that keeps unfinished characters."""

    def __init__(self, table: Table):
        self.table = table
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        data, _ = expand(self.table.byte_flat, self.table.byte_at[ids], self.table.byte_at[ids + 1] - self.table.byte_at[ids])
        return self.state.decode(data.tobytes())

    def finish(self) -> str:
        return self.state.decode(b"", True)


def expand(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces flat[start : start + length] in a row, and where each ends."""
    end = np.cumsum(length)
    if not len(end) or not end[-1]:
        return flat[:0], end
    return flat[np.repeat(start - (end - length), length) + np.arange(end[-1])], end


# ---- pre-tokens

_K = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _grow_powers(n: int) -> None:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)


def pretoken_starts(x: np.ndarray, first: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens start in code points x; first marks texts' starts. spaced: a blank joins what follows it, digits stay together.

    Also gives the class of each code point. Pre-tokens and, unless spaced, white space tile the input.
    """
    n = len(x)
    cls = char_classes()[x]
    mark = first.copy()
    mark[1:] |= cls[1:] != cls[:-1]
    if not spaced:
        mark |= cls == NUMBER
    start = np.flatnonzero(mark)
    end = np.append(start[1:], n)
    kind = cls[start]
    follows = np.append(~first[start[1:]], False)  # the next run is in the same text
    quote = (kind == OTHER) & (end - start == 1) & (x[start] == 39) & follows
    if spaced:
        before = np.maximum(start - 1, 0)
        quote &= first[start] | (x[before] != 32)
    q = np.flatnonzero(quote)
    q = q[kind[np.minimum(q + 1, len(kind) - 1)] == LETTER]
    if len(q):
        s, e = start[q + 1], end[q + 1]
        one = np.isin(x[s], [115, 116, 109, 100])
        c2 = x[np.minimum(s + 1, n - 1)]
        two = (e - s > 1) & (((x[s] == 114) & (c2 == 101)) | ((x[s] == 118) & (c2 == 101)) | ((x[s] == 108) & (c2 == 108)))
        k = np.where(one, 1, np.where(two, 2, 0))
        s, e, k = s[k > 0], e[k > 0], k[k > 0]
        mark[s] = False
        mark[(s + k)[s + k < e]] = True
    if spaced:
        w = np.flatnonzero((kind == SPACE) & follows)
        lone = x[end[w] - 1] == 32
        mark[end[w][lone]] = False  # the blank goes to what follows
        mark[end[w] - 1] = True
    return np.flatnonzero(mark), cls


def distinct(x: np.ndarray, text: str, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A run of each kind among the runs of code points x from start to end, and the kind of every run.

    h is a hash of each run. Runs of one hash are compared with the first of them; those that differ are told apart by their characters.
    """
    _, where, kind = np.unique(h, return_index=True, return_inverse=True)
    size, first = end - start, where[kind]
    same = size == size[first]
    check = np.flatnonzero(same & (first != np.arange(len(first))))
    mine, last = expand(x, start[check], size[check])
    its, _ = expand(x, start[first[check]], size[check])
    differ = np.flatnonzero(mine != its)
    same[check[np.searchsorted(last, differ, side="right")]] = False
    if not same.all():
        more: dict[str, int] = {}
        extra = []
        for i in np.flatnonzero(~same).tolist():
            k = more.setdefault(text[start[i] : end[i]], len(where) + len(more))
            if k == len(where) + len(extra):
                extra.append(i)
            kind[i] = k
        where = np.append(where, extra)
    return where, kind


class Encoder:
    """Texts to ids in the way of one tokenizer file."""

    def __init__(self, table: Table):
        self.table = table
        self.memo: dict[str, bytes] = {}

    def _normal(self, text: str) -> str:
        """For files with end-of-word marks, which lower case: what numpy cannot do by code point."""
        if self.table.suffixed and not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "İ" in text:
                text = text.replace("İ", "i̇")
        return text

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """int32 ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        held, owner, size = [], [], 0
        for i, t in enumerate(texts):
            t = t or ""
            if self.table.split is not None and "<" in t and self.table.split.search(t):
                parts = self.table.split.split(t)
                ids = self._batch([self._normal(p) for p in parts[::2]])
                mixed = [ids[0]]
                for s, p in zip(parts[1::2], ids[1:]):
                    mixed += [np.array([self.table.special[s]], dtype=np.int32), p]
                out[i] = np.concatenate(mixed)
                continue
            held.append(self._normal(t))
            owner.append(i)
            size += len(t)
            if size >= SLICE:
                for k, ids in zip(owner, self._batch(held)):
                    out[k] = ids
                held, owner, size = [], [], 0
        for k, ids in zip(owner, self._batch(held)):
            out[k] = ids
        return out

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        empty = np.empty(0, dtype=np.int32)
        if not joined:
            return [empty] * len(texts)
        x = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        at = np.cumsum(size) - size
        first = np.zeros(len(x), dtype=bool)
        first[at[size > 0]] = True
        if self.table.suffixed:
            x = lower_map()[x]
        start, cls = pretoken_starts(x, first, not self.table.suffixed)
        end = np.append(start[1:], len(x))
        if self.table.suffixed:
            keep = cls[start] != SPACE
            start, end = start[keep], end[keep]
        _grow_powers(len(x) + 1)
        v = (x.astype(np.uint64) + np.uint64(1)) * _K
        v ^= v >> np.uint64(29)
        v *= _powers[0][: len(x)]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(v)])
        h = (sums[end] - sums[start]) * _powers[1][start]
        h ^= (h >> np.uint64(31)) ^ ((end - start).astype(np.uint64) << np.uint64(50))
        text = x.tobytes().decode("utf-32-le", "surrogatepass") if self.table.suffixed else joined
        where, inverse = distinct(x, text, start, end, h)
        kinds = [text[a:b] for a, b in zip(start[where].tolist(), end[where].tolist())]
        memo = self.memo
        found = list(map(memo.get, kinds))
        missing = [i for i, f in enumerate(found) if f is None]
        if missing:
            words = [kinds[i].encode("utf-8", "surrogatepass") for i in missing]
            if len(memo) + len(words) > MEMO:
                memo.clear()
            for i, w, ids in zip(missing, words, self.table.lockstep(words)):
                found[i] = ids
                if len(w) <= LONG and len(memo) < MEMO:
                    memo[kinds[i]] = ids
        length = np.array([len(f) for f in found], dtype=np.int64) >> 2
        flat = np.frombuffer(b"".join(found), dtype=np.int32)
        ids, last = expand(flat, (np.cumsum(length) - length)[inverse], length[inverse])
        last = np.concatenate([[0], last])
        cut = last[np.searchsorted(start, np.append(at, len(x)))]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file."""
    if path not in _encoders:
        _encoders[path] = Encoder(Table(path))
    return _encoders[path]


# ---- Spark

#: Ids that are turned to text at a time.
STEP = 1 << 16


def id_digest(table: Table, ids: np.ndarray) -> str:
    sha = hashlib.sha256()
    for lo in range(0, len(ids), STEP):
        part = ",".join(map(table.text.__getitem__, ids[lo : lo + STEP].tolist()))
        sha.update((("," if lo else "") + part).encode())
    return sha.hexdigest()


def text_digest(table: Table, ids: np.ndarray) -> str:
    sha, d = hashlib.sha256(), Decoder(table)
    for lo in range(0, len(ids), STEP):
        sha.update(d.feed(ids[lo : lo + STEP]).encode())
    sha.update(d.finish().encode())
    return sha.hexdigest()


class _Digests:
    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(self.path)
        for b in batches:
            ids = e.encode(b.column(1).to_pylist())
            cols = [b.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([id_digest(e.table, i) for i in ids], pa.string()), pa.array([text_digest(e.table, i) for i in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


class _Ids:
    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(self.path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(e.encode(b.column(1).to_pylist()), pa.list_(pa.int32()))], names=["doc_id", "ids"])


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of each whole text."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(Bounded(_Ids(path)), f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def op5_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = documents(spark, sf_dir)
    small_batches(spark)
    return docs.mapInArrow(Bounded(_Digests(path or tokenizer_path("byte_bpe_50k.json"))), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
