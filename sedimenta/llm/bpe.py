"""Byte-level BPE encoding and decoding over a contiguous rank array per word."""

from __future__ import annotations

import hashlib
import heapq
import json
import threading
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batch_of, id_text, in_slices

# The word pattern of byte-level BPE, and Unicode's White_Space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"""
NONE = 1 << 60
ID_BITS = 20


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable Latin-1, else 256 onwards in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    """A tokenizer file read once per worker. Words are remembered up to max_words, then others are merged anew."""

    def __init__(self, tokenizer_json: str, max_words: int = 400_000) -> None:
        spec = json.loads(tokenizer_json)
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.token_bytes = {i: as_bytes(t) for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        vocab = {b: i for i, b in self.token_bytes.items()}
        self.ranks: dict[tuple[int, int], int] = {}  # rank, then the merged id in the low bits
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = as_bytes(a), as_bytes(b)
            self.ranks[vocab[a], vocab[b]] = rank << ID_BITS | vocab[a + b]
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.find_words = regex.compile(PATTERN).findall
        self.spaces = set(regex.findall(f"[{SPACE}]", "".join(map(chr, range(0x3001)))))
        self.newline = str(self.single[10])
        self.max_words = max_words
        self.words: dict[str, str] = {}  # pieces of the pattern
        self.first: dict[str, str] = {}  # what stands before a line's first space
        self.later: dict[str, str] = {}  # what follows a space
        self.runs: dict[str, bytes] = {}  # for decoding

    def merge(self, word: bytes) -> list[int]:
        """Parts and the rank of each part with its right neighbour lie in two plain lists. The least rank is found
        by a scan, the boundary at its right deleted, and the ranks on both sides looked up again."""
        ids = [self.single[b] for b in word]
        if len(ids) > 400:
            return self._merge_long(ids)
        get = self.ranks.get
        ranks = [get(pair, NONE) for pair in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            ids[i] = least & ((1 << ID_BITS) - 1)
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NONE)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges for a word too long for scans: a heap of ranks over linked parts."""
        n = len(ids)
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(self.ranks[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = rank & ((1 << ID_BITS) - 1), False, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (found := self.ranks.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (found, x, ids[x], ids[y]))
        return [x for x, ok in zip(ids, alive) if ok]

    def _by_pattern(self, text: str) -> str:
        """The ids of a text cut by the pattern alone."""
        out = []
        for w in self.find_words(text):
            ids = self.words.get(w)
            if ids is None:
                ids = ",".join(map(str, self.merge(w.encode())))
                if len(self.words) < self.max_words and len(w) < 64:
                    self.words[w] = ids
            out.append(ids)
        return ",".join(out)

    def _learn(self, pieces: list[str], known: dict[str, str], before: str) -> list[str] | None:
        """Id runs of what lies between spaces; None where white space meets white space."""
        out = []
        for p in pieces:
            ids = known.get(p)
            if ids is None:
                if not p or p[0] in self.spaces or p[-1] in self.spaces:
                    return None
                ids = self._by_pattern(before + p)
                if len(known) < self.max_words and len(p) < 64:
                    known[p] = ids
            out.append(ids)
        return out

    def _runs(self, text: str) -> list[str]:
        """A space or line end between two other characters always begins a new word of the pattern, so what lies
        between them is encoded by itself and remembered. Texts with other white space go through the pattern."""
        out: list[str] = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            try:
                runs = [self.first[head], *map(self.later.__getitem__, rest)]
            except KeyError:
                one, more = self._learn([head], self.first, ""), self._learn(rest, self.later, " ")
                if one is None or more is None:
                    return [ids] if (ids := self._by_pattern(text)) else []
                runs = one + more
            if out:
                out.append(self.newline)
            out += runs
        return out

    def encode_runs(self, text: str) -> list[str]:
        """Ids as decimal text joined by commas, in runs; the strings of special tokens become their ids."""
        if not any(s in text for s in self.special):
            return self._runs(text)
        out: list[str] = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(str(self.special[part]))
            elif part:
                out += self._runs(part)
        return out

    def encode(self, text: str) -> str:
        return ",".join(self.encode_runs(text))

    def _run_bytes(self, ids: str) -> bytes:
        found = self.runs.get(ids)
        if found is None:
            found = b"".join([self.token_bytes[int(x)] for x in ids.split(",")])
            if len(self.runs) < self.max_words and len(ids) < 64:
                self.runs[ids] = found
        return found

    def decode_runs(self, runs: list[str]) -> str:
        """The text of ids given in runs; bytes that are no UTF-8 become U+FFFD."""
        try:
            return b"".join(map(self.runs.__getitem__, runs)).decode("utf-8", "replace")
        except KeyError:
            return b"".join(map(self._run_bytes, runs)).decode("utf-8", "replace")

    def decode(self, ids: str) -> str:
        return self.decode_runs([ids]) if ids else ""


#: Seconds without a task after which a worker, which Spark keeps for tasks of any kind, forgets tokenizer and words.
IDLE_S = 5.0
_loaded: dict[int, Bpe] = {}
_idle: list[threading.Timer] = []


@contextmanager
def _tokenizer(shared) -> Iterator[Bpe]:
    """The worker's tokenizer with the words that it remembers; tasks that follow soon find both again."""
    while _idle:
        _idle.pop().cancel()
    bpe = _loaded.get(shared.value[0])  # held here, as a timer may go off just now
    if bpe is None:
        _loaded.clear()
        bpe = _loaded[shared.value[0]] = Bpe(shared.value[1])
    try:
        yield bpe
    finally:
        timer = threading.Timer(IDLE_S, _loaded.clear)
        timer.daemon = True
        timer.start()
        _idle.append(timer)


def _shared(docs: DataFrame, tokenizer_path: str):
    """The file's text, read on the driver: executors need no such path. Its size is a tokenizer's, a few MB."""
    with open(tokenizer_path, encoding="utf-8") as file:
        text = file.read()
    if len(text) > 64 << 20:
        raise ValueError("a tokenizer file of over 64 MB is not broadcast")
    return docs.sparkSession.sparkContext.broadcast((hash(text), text))


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its ids as an array<int>, one row for each row of docs."""
    shared = _shared(docs, tokenizer_path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        with _tokenizer(shared) as bpe:
            for batch in batches:
                for part in in_slices(batch):
                    ids = [[int(x) for x in e.split(",")] if (e := bpe.encode(t)) else [] for t in part.column(1).to_pylist()]
                    yield batch_of(schema, [part.column(0), ids])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>")


def digest_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode again, and return doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs.

    A null text is an empty one: no tokens, digests of nothing. Repeated rows give repeated rows. Map-side only.
    """
    shared = _shared(docs, tokenizer_path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        with _tokenizer(shared) as bpe:
            for batch in batches:
                for part in in_slices(batch):
                    rows = []
                    for text in part.column(1).to_pylist():
                        runs = bpe.encode_runs(text)
                        ids = ",".join(runs)
                        rows.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(bpe.decode_runs(runs).encode()).hexdigest()))
                    yield batch_of(schema, [part.column(0), *(list(c) for c in zip(*rows))] if rows else [[], [], [], []])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
