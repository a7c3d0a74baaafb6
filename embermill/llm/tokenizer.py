"""Exact encoding by a byte-level BPE vocabulary, in time linear in the text.

A text is cut by the vocabulary's pattern; each piece is encoded by a backtracking encoder. It takes the longest
token that begins at the current byte (all tokens that begin anywhere in the piece come from one pass of an
Aho-Corasick automaton of reversed tokens over the reversed piece), accepts it if it may follow the token before it,
and else tries the next shorter one or steps back. Two tokens may stand beside each other if undoing their merges
never shows a pair across their border that BPE would have merged first; the answers are kept in a table. Each byte
position is given up at most once, so the work is linear, and the result is that of the merges."""

from __future__ import annotations

import base64
import json
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embermill.session import share

#: Python's \s also takes U+001C to U+001F, which the vocabulary's own pattern doesn't.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the pattern of the vocabulary.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Pieces whose ids a worker remembers; it starts anew beyond that. It has no influence on the result.
MEMO_PIECES = 400_000
SLICE_CHARS = 4_000_000


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return f"/opt/tokenizers/{name}"


@dataclass(frozen=True)
class Vocabulary:
    """Tokens in the order of their ids (which is the order of merging), and the pair each was merged from."""

    tokens: tuple[bytes, ...]
    left: np.ndarray
    right: np.ndarray


def read_vocabulary(path: str | None = None) -> Vocabulary:
    """From a rank file (lines of base64 and rank) or a tokenizer JSON file."""
    path = path or default_path()
    if path.endswith(".json"):
        ids = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        back = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        ranks = {bytes(back[c] for c in t): i for t, i in ids.items() if all(c in back for c in t) and not t.startswith("<|")}
    else:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ids must run from 0 without gaps")
    left, right = np.arange(len(tokens), dtype=np.int32), np.arange(len(tokens), dtype=np.int32)
    for i, t in enumerate(tokens):
        if len(t) > 1:
            left[i], right[i] = _split(t, i, ranks)
    return Vocabulary(tuple(tokens), left, right)


def _split(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int]:
    """The two tokens that the last merge of ``token`` joins."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return ranks[parts[0]], ranks[parts[1]]


class _Memo(dict):
    """Piece to its number in the pool; a new piece is encoded when it is first asked for."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, text: str) -> int:
        return self.encoder.piece(text)


class Encoder:
    """Encodes pieces and texts; one for each worker process."""

    def __init__(self, v: Vocabulary):
        import ahocorasick
        import regex

        self.v = v
        self.find = regex.compile(PATTERN).findall
        self.size = [len(t) for t in v.tokens]
        self.whole = {t: i for i, t in enumerate(v.tokens)}
        self.left, self.right = v.left.tolist(), v.right.tolist()
        self.merged = {(a, b): i for i, (a, b, n) in enumerate(zip(self.left, self.right, self.size)) if n > 1}
        self.fits: dict[int, bool] = {}
        self.backwards = ahocorasick.Automaton()
        for i, t in enumerate(v.tokens):
            self.backwards.add_word(t[::-1].decode("latin-1"), i)
        self.backwards.make_automaton()
        self.forget()

    def forget(self) -> None:
        self.memo = _Memo(self)
        self.pool, self.at, self.count = [], [], []

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves ``b`` beside ``a``. The merges of both are undone from the youngest; a pair across the
        border that is older than what was undone would have been merged instead."""
        key = a << 20 | b
        known = self.fits.get(key)
        if known is not None:
            return known
        x, y, before, left, right = a, b, 1 << 30, self.left, self.right
        while True:
            joined = self.merged.get((x, y))
            if joined is not None and joined < before:
                ok = False
                break
            if self.size[x] == 1 and self.size[y] == 1:
                ok = True
                break
            # undo the younger of the two merges; of equal tokens the right one was made later
            if x > y:
                before, x = x, right[x]
            else:
                before, y = y + 1, left[y]
        if len(self.fits) > 4_000_000:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def encode_bytes(self, raw: bytes) -> list[int]:
        """The ids of one piece."""
        if (i := self.whole.get(raw)) is not None:
            return [i]
        n = len(raw)
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.backwards.iter(raw[::-1].decode("latin-1")):
            starts[n - 1 - end].append(token)  # longest first
        size, compatible = self.size, self.compatible
        out: list[int] = []
        tried: list[int] = []  # which of the tokens at its place each token is
        dead = bytearray(n + 1)
        pos, k = 0, 0
        while pos < n:
            here = starts[pos]
            while k < len(here):
                token = here[k]
                if not dead[pos + size[token]] and (not out or compatible(out[-1], token)):
                    break
                k += 1
            if k < len(here):
                out.append(token)
                tried.append(k)
                pos, k = pos + size[token], 0
            else:
                dead[pos] = 1
                pos, k = pos - size[out.pop()], tried.pop() + 1
        return out

    def piece(self, text: str) -> int:
        """The number under which the piece's ids lie in the pool."""
        ids = self.encode_bytes(text.encode("utf-8", "surrogatepass"))
        self.memo[text] = k = len(self.at)
        self.at.append(len(self.pool))
        self.count.append(len(ids))
        self.pool += ids
        return k

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(the number of ids of each text, all ids)."""
        if len(self.memo) > MEMO_PIECES:
            self.forget()
        get, numbers, pieces = self.memo.__getitem__, [], []
        for text in texts:
            words = self.find(text) if text else ()
            numbers.extend(map(get, words))
            pieces.append(len(words))
        of = np.fromiter(numbers, np.int64, len(numbers))
        at, count, pool = np.array(self.at, np.int64), np.array(self.count, np.int64), np.array(self.pool, np.int32)
        if not len(of):
            return np.zeros(len(texts), np.int64), np.zeros(0, np.int32)
        n = count[of]
        ends = np.cumsum(n)
        flat = pool[np.repeat(at[of] - (ends - n), n) + np.arange(ends[-1])]
        before = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pieces)])]
        return np.diff(before), flat


def _kept(key: str, make):
    """Something that a worker process keeps from task to task."""
    there = sys.modules.setdefault("_embermill_kept", types.ModuleType("_embermill_kept")).__dict__
    if key not in there:
        there[key] = make()
    return there[key]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= SLICE_CHARS:
            yield at, i + 1
            at, chars = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _shared(spark: SparkSession, path: str | None):
    path = path or default_path()
    return f"encoder {path}", share(spark, read_vocabulary(path))


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str | None = None, counts_only: bool = False) -> DataFrame:
    """``id`` and ``ids`` (array<int>) of every row, or ``n_tokens`` with ``counts_only``; no special tokens.

    Null and empty texts have the empty list; every character is encoded, whatever it is; rows with equal or null
    ids are kept as they are. No shuffle; other columns are ignored. Texts of any length are encoded as a whole."""
    key, shared = _shared(docs.sparkSession, vocabulary)
    kind = dict(docs.dtypes)[id]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _kept(key, lambda: Encoder(shared()))
        for b in it:
            texts = b.column(1).to_pylist()
            for lo, hi in _slices(texts):
                n, flat = encoder.encode_texts(texts[lo:hi])
                if counts_only:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n)], ["id", "n_tokens"])
                else:
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "ids"])

    rest = "n_tokens bigint" if counts_only else "ids array<int>"
    return docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(batches, f"id {kind}, {rest}").withColumnRenamed("id", id)


def decode(encoded: DataFrame, id: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``id`` and ``text`` back from the ids, by a table of each token's offset and length in the joined tokens.

    Null lists give null, empty ones the empty text; bytes that are no UTF-8 (lists cut inside a character) come out
    as U+FFFD; an id outside the vocabulary is an error."""
    _, shared = _shared(encoded.sparkSession, vocabulary)
    kind = dict(encoded.dtypes)[id]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared().tokens
        joined = np.frombuffer(b"".join(tokens), np.uint8)
        size = np.array([len(t) for t in tokens], np.int64)
        at = np.cumsum(size) - size
        for b in it:
            lists = b.column(1)
            n = np.diff(lists.offsets.to_numpy())
            flat = np.asarray(lists.flatten(), np.int64)
            m = size[flat]
            ends = np.cumsum(m)
            raw = joined[np.repeat(at[flat] - (ends - m), m) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
            n = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, n)
            cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
            texts = [raw[a:z].decode("utf-8", "replace") if ok else None for a, z, ok in zip(cuts[:-1].tolist(), cuts[1:].tolist(), lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(F.col(id).alias("id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(batches, f"id {kind}, text string").withColumnRenamed("id", id)
