"""Exact token counts by compiled finite-state transducers with counted emissions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

#: Character classes. Letters that can end or continue a contraction have their own.
LETTER, NUMBER, OTHER, BLANK, WHITE, QUOTE, ONE, R, E, V, L, END = range(12)
#: States: what the current pre-token is.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, CONTRACTED, BLANK_1, WHITE_1, BLANK_N, WHITE_N = range(13)
STATES = 13
HERE, BEFORE = 1, 2
#: Characters whose state maps are composed at a time.
CHUNK = 256
#: Distinct pre-tokens whose counts a worker remembers, and states of the merges that it keeps.
MEMORY, STATES_KEPT = 500_000, 200_000
#: Characters of a long text that are worked on at a time.
LONG = 1 << 20


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission by (class, state).

    Emission HERE: a pre-token begins at this character; BEFORE: one begins at
    the character before (white space gives its last blank to what follows; a
    contraction turns out to be none).
    """
    step, emit = np.zeros((12, STATES), np.uint8), np.zeros((12, STATES), np.uint8)
    letters = (LETTER, ONE, R, E, V, L)
    waiting = {QUOTED_R: E, QUOTED_V: E, QUOTED_L: L}
    for c in range(12):
        for s in range(STATES):
            if c in (BLANK, WHITE):
                again = s in (BLANK_1, WHITE_1, BLANK_N, WHITE_N)
                to = (BLANK_N if again else BLANK_1) if c == BLANK else (WHITE_N if again else WHITE_1)
                out = 0 if again else HERE | (BEFORE if s in waiting else 0)
            elif c == END:
                to, out = START, HERE | (BEFORE if s in waiting else 0)
            else:
                kind = IN_LETTERS if c in letters else IN_NUMBERS if c == NUMBER else IN_OTHER
                fresh = QUOTED if c == QUOTE else kind
                if s in waiting:
                    to, out = (CONTRACTED, 0) if c == waiting[s] else (IN_LETTERS, BEFORE) if kind == IN_LETTERS else (fresh, BEFORE | HERE)
                elif s == QUOTED and kind == IN_LETTERS:
                    to, out = {ONE: (CONTRACTED, 0), R: (QUOTED_R, 0), V: (QUOTED_V, 0), L: (QUOTED_L, 0)}.get(c, (IN_LETTERS, HERE))
                elif s == QUOTED and kind == IN_OTHER or s == kind:
                    to, out = kind, 0
                elif s == BLANK_1:
                    to, out = kind, 0
                elif s == BLANK_N:
                    to, out = kind, BEFORE
                else:
                    to, out = fresh, HERE | (BEFORE if s == WHITE_N else 0)
            step[c, s], emit[c, s] = to, out
    return step, emit


STEP, EMIT = _compile()


def _classes() -> np.ndarray:
    """The class of every code point, from Unicode's properties."""
    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for found in regex.finditer(pattern, everything):
            points = np.frombuffer(found[0].encode("utf-32-le"), np.uint32)
            out[points] = kind
    for characters, kind in ((" ", BLANK), ("'", QUOTE), ("stmd", ONE), ("r", R), ("e", E), ("v", V), ("l", L)):
        for x in characters:
            out[ord(x)] = kind
    return out


_shared: dict = {}


def _class_table() -> np.ndarray:
    if "classes" not in _shared:
        _shared["classes"] = _classes()
    return _shared["classes"]


def states_before(classes: np.ndarray) -> np.ndarray:
    """The transducer's state before each character.

    Chunks run in lockstep from every state, which gives each chunk's map from
    entry to exit state; a parallel prefix scan composes the maps to each
    chunk's entry state; then all chunks run again from those.
    """
    n = len(classes)
    width = -(-n // CHUNK)
    grid = np.full(width * CHUNK, END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(width, CHUNK).T)
    table = STEP.ravel()
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (width, 1))
    base = grid.astype(np.intp) * STATES
    for row in base:
        maps = table[row[:, None] + maps]
    shift = 1
    while shift < width:  # maps[k] becomes the map of chunks 0 to k
        maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift].astype(np.intp), 1)
        shift *= 2
    now = np.concatenate(([START], maps[:-1, START])).astype(np.uint8)
    out = np.empty((CHUNK, width), np.uint8)
    for k, row in enumerate(base):
        out[k] = now
        now = table[row + now]
    return out.T.ravel()[:n]


class MergeTransducer:
    """A deterministic transducer over the bytes of a pre-token whose transitions carry the change of its token count.

    Byte-pair encoding keeps every prefix's last token: the last token of a
    longer prefix is the one token that ends there and may follow the last
    token of what is before it. Two tokens may follow each other if no merge
    crosses their border. So a state need only hold, for each place where a
    token still growing may have begun, how far it has grown (a node of the
    tokens' tree), the token that ended there, and how many tokens the prefix
    has more than it had there. These are finitely many; states and
    transitions are compiled when first reached and dropped beyond MEMORY.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        numbers = {bytes([b]): b for b in range(256)}
        self.rank: dict[tuple[int, int], int] = {}
        self.born, self.halves = [-1] * 256, [(0, 0)] * 256
        useful = [True] * 256
        for rank, (left, right) in enumerate(merges):
            if left not in numbers or right not in numbers or left + right in numbers:
                raise ValueError("merges must build each token once, from earlier ones")
            pair = numbers[left], numbers[right]
            numbers[left + right] = len(self.born)
            useful.append(useful[pair[0]] and useful[pair[1]] and self._apart(*pair, rank))
            self.rank[pair] = rank
            self.born.append(rank)
            self.halves.append(pair)
        self.children: dict[int, int] = {}
        self.token = [-1]
        for raw, number in numbers.items():
            if useful[number]:
                node = 0
                for byte in raw:
                    key = node << 8 | byte
                    node = self.children.get(key) or self.children.setdefault(key, self._node())
                self.token[node] = number
        self.inner = {key >> 8 for key in self.children}
        self._clear()

    def _node(self) -> int:
        self.token.append(-1)
        return len(self.token) - 1

    def _clear(self) -> None:
        start = ((0, -1, 0),)
        self.numbers, self.states = {start: 0}, [start]
        self.table: dict[int, int] = {}
        self.follows: dict[tuple[int, int], bool] = {}

    def _apart(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether no merge of a rank less than ``before`` crosses the border of two tokens.

        The merges that made the two are undone, latest first; at each stage a
        merge of what then meets at the border would have come earlier if its
        rank is less, and of equal ranks the leftmost comes first.
        """
        while True:
            if self.rank.get((left, right), before) < before:
                return False
            first, second = self.born[left], self.born[right]
            if first < 0 and second < 0:
                return True
            if first > second:
                before, left = first, self.halves[left][1]
            else:
                before, right = second + 1, self.halves[right][0]

    def _compile(self, state: int, byte: int) -> int:
        growing, last, gain = [], -1, 0
        for node, ended, more in self.states[state]:
            child = self.children.get(node << 8 | byte)
            if child is None:
                continue
            growing.append((child, ended, more))
            token = self.token[child]
            if token >= 0 and last < 0:
                fits = ended < 0 or self.follows.get((ended, token))
                if fits is None:
                    fits = self.follows[ended, token] = self._apart(ended, token)
                if fits:
                    last, gain = token, 1 - more
        to = (*((node, ended, more + gain) for node, ended, more in growing if node in self.inner), (0, last, 0))
        number = self.numbers.get(to)
        if number is None:
            number = self.numbers[to] = len(self.states)
            self.states.append(to)
        value = self.table[state << 8 | byte] = number << 12 | gain + 2048
        return value

    def count(self, raw: bytes) -> int:
        """The number of tokens of a pre-token."""
        if len(self.states) > STATES_KEPT:
            self._clear()
        state, n, table = 0, 0, self.table
        for byte in raw:
            value = table.get(state << 8 | byte) or self._compile(state, byte)
            state = value >> 12
            n += (value & 4095) - 2048
        return n


def read_merges(path: str) -> tuple[list[tuple[bytes, bytes]], list[str]]:
    """The merges, as bytes, and the added tokens of a file; a ValueError if its rules are not those compiled here."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, cutter = file["model"], file.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or file.get("normalizer") or file.get("truncation") or file.get("padding"):
        raise ValueError(f"{path}: not a plain byte-level BPE file")
    if cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
        raise ValueError(f"{path}: its pre-tokenizer is not the byte-level one that this transducer compiles")
    if any(t.get(k) for t in file.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: added tokens that take neighbouring characters are not supported")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow 255
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return [tuple(bytes(letters[c] for c in half) for half in pair) for pair in pairs], [t["content"] for t in file.get("added_tokens", ())]


#: Where a long text may be cut: a pre-token begins there whatever came before, and nothing before is looked back at.
_SAFE = regex.compile(r"\S(?=\s\S)|\p{L}(?=[^\s\p{L}\p{N}'])")


class Counter:
    """Token counts of texts under a byte-level BPE file, by two transducers and without the library's encoder.

    The first cuts a text into pre-tokens; the second, restarted at every
    cut, counts the tokens of each. Counts of pre-tokens met before are kept,
    by the pre-token itself. Added tokens inside a text count one each, as is
    the library's default.
    """

    def __init__(self, path: str):
        merges, special = read_merges(path)
        self.merger = MergeTransducer(merges)
        self.special = sorted(special, key=len, reverse=True)
        self.pattern = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.weights: dict[str, int] = {}

    def _weight(self, piece: str) -> int:
        if len(self.weights) >= MEMORY:
            self.weights.clear()
        n = self.weights[piece] = self.merger.count(piece.encode())
        return n

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for k, text in enumerate(texts):
            cutting = self.pattern is not None and any(s in text for s in self.special)
            pieces = self.pattern.split(text) if cutting else [text]
            out[k] = len(pieces) - 1
            for piece in pieces:
                at = 0
                while len(piece) - at > LONG and (safe := _SAFE.search(piece, at + LONG)):
                    out[k] += self._count([piece[at : safe.end()]])[0]
                    at = safe.end()
                parts.append(piece[at:])
                owner.append(k)
        np.add.at(out, np.array(owner, np.int64), self._count(parts))
        return out

    def _count(self, parts: list[str]) -> np.ndarray:
        joined = "\0".join(["", *parts, ""])
        classes = _class_table()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        ends = np.cumsum([0, *(len(p) + 1 for p in parts)])
        classes[ends] = END
        emitted = EMIT[classes, states_before(classes)]
        begins = (emitted & HERE) > 0
        begins[:-1] |= (emitted[1:] & BEFORE) > 0
        edges = np.flatnonzero(begins)
        starts, stops = edges[:-1], edges[1:]
        real = classes[starts] != END
        starts, stops = starts[real], stops[real]
        look, weights, place = self.weights.get, [], starts.tolist()
        for a, b in zip(place, stops.tolist(), strict=True):
            piece = joined[a:b]
            n = look(piece)
            weights.append(self._weight(piece) if n is None else n)
        part = np.searchsorted(ends, starts, "right") - 1
        return np.bincount(part, weights=weights, minlength=len(parts)).astype(np.int64) if weights else np.zeros(len(parts), np.int64)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text).

    Null and empty texts have 0 bytes and 0 tokens; long texts are worked on
    LONG characters at a time, up to the next place where a cut changes
    nothing (a run of letters, digits or white space alone is held whole);
    repeated rows are counted alike; nothing depends on order; no rows give no
    rows; extra columns are ignored. No shuffle: a lost executor repeats its
    tasks. ``path`` must exist on every worker; a file with other rules than
    plain byte-level BPE is refused with a ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _shared.get(path) or _shared.setdefault(path, Counter(path))
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                raw = as_bytes(batch.column(1)[start:stop])
                counts = counter.counts([x.decode("utf-8", "replace") for x in raw])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[start:stop], pa.array([len(x) for x in raw], pa.int64()), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op7_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
