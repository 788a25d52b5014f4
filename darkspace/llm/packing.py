"""Harmonic packing of token sequences."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices, tidied, words_of

CAPACITY, SEPARATOR = 4096, 2
#: Distinct words whose ids a worker remembers, and words looked up at a time.
MEMORY = 400_000
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{n} long" for n in NAMES)


class Encoder:
    """Token ids of texts under a tokenizer that lower-cases and never merges across white space.

    Texts are lower-cased (A-Z) and cut at ASCII white space; each distinct
    word is encoded once by the library and its ids are kept in one pool, by
    the word itself (cleared when full). A word that ends in ASCII signs other
    than an apostrophe is the ids of its letters and those of its signs, since
    the tokenizer's pattern cuts there. Words of letters only are encoded many
    at a time: the tokenizer's end-of-word marks tell them apart again.
    """

    LETTERS = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
    SIGNS = rb"[!-&(-/:-@\[-`{-~]+"
    TOGETHER = 1000

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        check_rules(path)
        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.letters, self.signed = re.compile(self.LETTERS), re.compile(b"(%s)(%s)" % (self.LETTERS, self.SIGNS))
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.begin, self.size = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.pool, self.used = np.empty(1 << 18, np.uint32), 0

    def _keep(self, words: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> None:
        first, used = len(self.index), self.used
        self.index.update(zip(words, range(first, first + len(words)), strict=True))
        self.used += len(ids)
        if len(self.index) > len(self.begin):
            self.begin, self.size = (np.concatenate((x, np.empty(max(len(x), len(words)), np.int64))) for x in (self.begin, self.size))
        if self.used > len(self.pool):
            self.pool = np.concatenate((self.pool, np.empty(max(len(self.pool), len(ids)), np.uint32)))
        self.begin[first : len(self.index)] = used + np.cumsum(sizes) - sizes
        self.size[first : len(self.index)] = sizes
        self.pool[used : self.used] = ids

    def _add_others(self, words: list[bytes]) -> None:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        self._keep(words, sizes, np.fromiter((i for ids in encoded for i in ids), np.uint32, int(sizes.sum())))

    def _add_letters(self, words: list[bytes]) -> None:
        for k in range(0, len(words), self.TOGETHER):
            part = words[k : k + self.TOGETHER]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(part) and last[-1] == len(ids) - 1:
                self._keep(part, np.diff(last, prepend=-1), ids)
            else:  # a tokenizer without such marks
                self._add_others(part)

    def _add(self, words: Iterable[bytes]) -> None:
        letters, others, signed, halves = {}, {}, [], []
        for word in words:
            if self.letters.fullmatch(word):
                letters[word] = None
            elif m := self.signed.fullmatch(word):
                signed.append(word)
                halves += m.groups()
            else:
                others[word] = None
        for k, word in enumerate(halves):
            if word not in self.index:
                (others if k % 2 else letters)[word] = None
        self._add_letters(list(letters))
        self._add_others(list(others))
        if signed:
            rows = np.fromiter(map(self.index.__getitem__, halves), np.int64, len(halves))
            sizes = self.size[rows]
            self._keep(signed, sizes.reshape(-1, 2).sum(1), self._gather(rows, sizes))

    def _gather(self, where: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(self.begin[where] - ends + sizes, sizes) + np.arange(int(sizes.sum()))]

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words, and how many each has."""
        if len(self.index) > self.memory:
            self._clear()
        rows = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(rows < 0).tolist()
        if missing:
            self._add(dict.fromkeys(words[k] for k in missing))
            rows[missing] = [self.index[words[k]] for k in missing]
        sizes = self.size[rows]
        return self._gather(rows, sizes), sizes

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if not any(b"<|" in t for t in texts):  # special strings keep their case
            texts = [t.lower() for t in texts]
        if len(texts) == 1:
            return [np.concatenate([self._ids(words)[0] for words in words_of(texts[0])])]
        parts = [t.split() for t in texts]
        ids, sizes = self._ids(list(chain.from_iterable(parts)))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return np.split(ids, ends[np.cumsum([len(p) for p in parts])[:-1]])


def check_rules(path: str) -> None:
    """A ValueError unless the file's rules cut at white space and fold A-Z, which the encoder relies on."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    parts = lambda key, inner: [x.get("type") for x in ((file.get(key) or {}).get(inner) or [])]
    cutters = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    pattern = (cutters[0].get("pattern") or {}).get("Regex", "")
    folds = "Lowercase" in parts("normalizer", "normalizers")
    cuts = cutters[0].get("behavior") == "Removed" and cutters[0].get("invert") and regex.search(pattern, " \t\n\r\f\v") is None
    if not (folds and cuts) or file["model"].get("dropout") or file.get("truncation") or file.get("padding"):
        raise ValueError(f"{path}: not a tokenizer that lower-cases and drops white space")


class Bins:
    """One worker's bins: class k holds documents of more than capacity / (k + 1) and up to capacity / k tokens, k to a bin.

    A full bin's gap takes the longest waiting documents that fit as a whole,
    of whatever class; what is left of it takes the front of the longest
    waiting document, whose rest waits in its own class. So a bin has no
    padding and cuts one document at most. Of a document above the capacity
    whole bins go first. When the input ends, the waiting documents fill bins
    one after the other, and the last tokens bins of powers of two.
    """

    def __init__(self, worker: int, capacity: int):
        if capacity & capacity - 1:
            raise ValueError("the capacity must be a power of two")
        self.capacity, self.next_id = capacity, worker << 36
        self.waiting: dict[int, list[tuple]] = {}  # by class: document, its start, its ids from there, its tokens in all
        self.unfilled: list[tuple[list, int]] = []
        self.done: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.capacity:
            self._close([(doc_id, start, ids[start : start + self.capacity], total)])
            start += self.capacity
        if start < total:
            self._wait((doc_id, start, ids[start:].copy(), total))

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.done.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def _wait(self, item: tuple) -> None:
        kind = self.capacity // len(item[2])
        rows = self.waiting.setdefault(kind, [])
        rows.append(item)
        if len(rows) == kind:
            del self.waiting[kind]
            self.unfilled.append((rows, self.capacity - sum(len(r[2]) for r in rows)))
        while self.unfilled and self._fill():
            pass

    def _fill(self) -> bool:
        """Fills the last of the bins with gaps; False if no document waits for it."""
        pieces, gap = self.unfilled.pop()
        while gap:
            item = self._fitting(gap)
            if item is None:
                if not self.waiting:
                    self.unfilled.append((pieces, gap))
                    return False
                doc_id, start, ids, total = self._take(min(self.waiting), 0)
                item = (doc_id, start, ids[:gap], total)
                pieces.append(item)
                self._close(pieces)
                self._wait((doc_id, start + gap, ids[gap:], total))
                return True
            pieces.append(item)
            gap -= len(item[2])
        self._close(pieces)
        return True

    def _fitting(self, gap: int) -> tuple | None:
        """A waiting document of at most ``gap`` tokens, of the class of the longest."""
        least = self.capacity // gap
        for kind in sorted(k for k in self.waiting if k >= least):
            rows = self.waiting[kind]
            fits = [n for n, r in enumerate(rows) if len(r[2]) <= gap] if kind == least else [0]
            if fits:
                return self._take(kind, max(fits, key=lambda n: len(rows[n][2])))
        return None

    def _take(self, kind: int, place: int) -> tuple:
        rows = self.waiting[kind]
        item = rows.pop(place)
        if not rows:
            del self.waiting[kind]
        return item

    def end(self) -> None:
        rest = [item for _, rows in sorted(self.waiting.items()) for item in rows]
        self.waiting = {}
        pieces, gap = self.unfilled.pop() if self.unfilled else ([], self.capacity)
        for doc_id, start, ids, total in rest:
            while len(ids):
                pieces.append((doc_id, start, ids[:gap], total))
                start, ids, gap = start + len(ids[:gap]), ids[gap:], gap - len(ids[:gap])
                if not gap:
                    self._close(pieces)
                    pieces, gap = self.unfilled.pop() if self.unfilled else ([], self.capacity)
        for held, left in [(pieces, gap), *self.unfilled]:
            self._powers(held, self.capacity - left)
        self.unfilled = []

    def _powers(self, pieces: list[tuple], size: int) -> None:
        """Pieces that don't fill a bin, in bins of the powers of two that their size is made of."""
        pieces = pieces[::-1]
        while size:
            length = need = 1 << size.bit_length() - 1
            own = []
            while need:
                doc_id, start, ids, total = pieces.pop()
                own.append((doc_id, start, ids[:need], total))
                if len(ids) > need:
                    pieces.append((doc_id, start + need, ids[need:], total))
                need -= len(own[-1][2])
            self._close(own)
            size -= length

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.done, strict=True)) or [()] * len(NAMES)
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)


_encoders: dict[tuple[str, int], Encoder] = {}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR, memory: int = MEMORY) -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text) and their places in sequences of ``capacity`` tokens.

    A document is its ids and a separator. Documents up to the capacity are
    classed by how often they go into it, and each worker fills the bins of a
    class with that fixed number of documents, independently of the others;
    gaps take whole documents first and then the front of one more (``Bins``).
    Documents above the capacity give whole sequences and a rest that is
    classed like a document. No sequence has padding: all have ``capacity``
    tokens but those at a worker's end, whose lengths are powers of two. No
    shuffle and no coordination; sequence_id is worker * 2**36 + number, so a
    repeated task gives the same rows.

    Null and empty texts are their separator alone. Very long texts are encoded
    some at a time; a worker holds the ids of one text, and of the documents
    that wait (fewer than capacity for each class, of which there are about 2
    * sqrt(capacity)). Documents of equal length wait in the order of the rows.
    Repeated rows are packed as often as they occur. No rows give no rows.
    Extra columns are ignored. A worker remembers the ids of ``memory`` distinct
    words (about 200 bytes each).
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get((path, memory)) or _encoders.setdefault((path, memory), Encoder(path, memory))
        bins = Bins(TaskContext.get().partitionId(), capacity)
        tail = np.array([separator], "<u4")
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                ids = encoder.encode(as_bytes(batch.column(1)[start:stop]))
                for doc_id, own in zip(batch.column(0)[start:stop].to_pylist(), ids, strict=True):
                    bins.add(doc_id, np.concatenate((own, tail)).astype("<u4"))
                yield bins.take()
        bins.end()
        yield bins.take()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op5_packing(spark, sf_dir):
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
