"""Reading level of texts from graded n-gram models.

All judged texts and all texts marked with a language train: tasks count, the driver has the summed counts, and of each
judged text the parts of its distribution.

``prose_words`` keeps the running prose of a text, and character models of the languages (``fit_languages``) tell
whether it is English. For each cut of the scale, two interpolated bigram models are trained on the prose of texts
judged at or below it, and of those judged above it. The gap of a word is its surprisal under the lower model less that
under the upper one; a text's distribution of gaps, over all its words, is described by the means of its equal parts
in ascending order. A score that rises with each of these parts (weights fitted on texts left out of training) is
mapped by isotonic regression to the probability of a level above the cut; the level is the sum of these."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embermill.session import cut as settle
from embermill.session import share

MIN_WORDS = 30
FOLDS = 5
LEAST_WORDS = 8  # of a text that trains
PARTS = 8  # of a text's distribution of gaps
#: How often texts marked with a wrong language move to the one that fits them best.
MOVES = 3
#: Texts and characters that a task has in hand at once.
HELD_TEXTS, HELD_CHARACTERS = 2_048, 4_000_000
MOST_BITS = math.log2(26)  # of a character of English: more is no better than an even choice among the letters

# The commonest function words of English; they tell prose from lists.
FUNCTION_WORDS = frozenset(
    """the a an of and or but nor to in on at by for with from into upon through between before after until while than then
    that this these those which whose who whom what where when why how it its he she they we you i me us them him her his
    their our your my is are was were be been being am do does did has have had having will would can could shall should may
    might must not no if unless because although though as so such there here one once each every any some all both neither
    either more most less least very too also only even just still already now again ever never own same other another about
    against under over out up down off it's don't isn't""".split()
)
_MARKS = re.compile(r"[̀-ͯ҉​-‏⁠﻿­]+")
_TOKEN = re.compile(r"(?<!\w)[^\W\d_]+(?:['-][^\W\d_]+)*(?!\w)")
# What may begin anywhere among signs or letters is tried where these begin; markup before it may end at > or `.
_MARKUP = re.compile(r"<[^<>]{1,200}>|https?://\S+|(?:(?<!\S)|(?<=[>`]))\S*[/\\]\S*\.\w+\S*|`[^`]*`|&[a-z]+;|(?<!\w)\w*_\w+(?:\.\w+)?")
_LATIN = re.compile(r"[a-z'-]+$")


class _Words(dict):
    """The words of what stands between blanks, kept for when it comes again."""

    def __init__(self, markup: bool) -> None:
        self.markup = markup

    def __missing__(self, part: str) -> list[str]:
        found = _TOKEN.findall(_MARKUP.sub(" ", part) if self.markup else part)
        if len(part) <= 40:
            if len(self) >= 100_000:
                self.clear()
            self[part] = found
        return found


_WORDS, _MARKED_WORDS = _Words(False), _Words(True)


def _lines(text: str) -> Iterator[list[str]]:
    """The words of each line in lower case, without markup and marks that don't show."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).replace("’", "'")
    lower, words = text.lower(), _MARKED_WORDS
    if "<" in text or "`" in text:  # these may have blanks between them
        lower, words = _MARKUP.sub(" ", lower), _WORDS
    for line in lower.split("\n"):
        yield list(chain.from_iterable(map(words.__getitem__, line.split())))


def prose_words(text: str) -> tuple[list[str], bool]:
    """(the words of the running English prose in lower case, whether function words are as common as in English).

    A line belongs to the prose if it has a function word for each ten words or so; lists of prompts, parameters,
    paths, numbers and codes have none, lines in another language few."""
    return _prose(_lines(text))


def _prose(lines: Iterable[list[str]]) -> tuple[list[str], bool]:
    out: list[str] = []
    english = 0
    for words in lines:
        if not words:
            continue
        known = sum(map(FUNCTION_WORDS.__contains__, words))
        if 10 * known < len(words):
            continue
        english += known
        out += words
    return out, bool(out) and 8 * english >= len(out)


# --- language -------------------------------------------------------------------------------------------------------

_SIZE = 32  # classes of characters: letters, blank, apostrophe and hyphen, other Latin letters, other scripts
_CLASS = np.full(0x250, 28, np.uint32)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[ord(" ")] = 0
_CLASS[[ord("'"), ord("-")]] = 27


def _stream(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(the classes of the characters of the texts, given as words, one after another and two blanks, the characters of
    each)."""
    c = np.frombuffer(("".join([" " + " ".join(t) + " " for t in texts]) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c < len(_CLASS), _CLASS[np.minimum(c, len(_CLASS) - 1)], 29)
    return c.astype(np.uint8), np.array([sum(map(len, t)) + max(len(t) - 1, 0) + 2 for t in texts], np.int64)


def _trigrams(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.intp)
    return (c[:-2] * _SIZE + c[1:-1]) * _SIZE + c[2:]


def _counted(c: np.ndarray, n: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the values of ``of``, given for each text, counts of the trigrams of the texts that have each)."""
    there, of = np.unique(of, return_inverse=True)
    inside = np.ones(n.sum(), bool)
    for back in (1, 2):  # these reach into the next text
        inside[np.cumsum(n) - back] = False
    key = np.repeat(of * _SIZE**3, n) + _trigrams(c)
    return there, np.bincount(key[inside], minlength=len(there) * _SIZE**3).reshape(len(there), -1)


def _characters(n: np.ndarray, joint: bool = False) -> np.ndarray:
    """From counts of trigrams: log2 probability of each character after the two before it, interpolated with shorter
    contexts by the number of different followers; or ``joint``, of the three together, which tells languages apart
    where some texts of one are counted with another."""
    if joint:
        return np.log2((n + 0.1) / (n.sum() + 0.1 * len(n))).astype(np.float32)
    p = (n.reshape(-1, _SIZE).sum(0) + 1) / (n.sum() + _SIZE)
    for order in (2, 3):
        counts = n.reshape(-1, *[_SIZE] * order).sum(0)
        follow, total = (counts > 0).sum(-1, keepdims=True), counts.sum(-1, keepdims=True)
        p = np.where(total > 0, (counts + follow * p) / np.maximum(total + follow, 1), p)
    return np.log2(p).astype(np.float32).ravel()


@dataclass
class Languages:
    names: list[str]
    table: np.ndarray  # languages x trigrams

    def bits(self, texts: list[list[str]]) -> np.ndarray:
        """Mean bits of a character of each text (as words) under each language, languages x texts; 0 without any."""
        return self.bits_of(*_stream(texts))

    def bits_of(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        """As ``bits``, of what ``_stream`` gives."""
        out = np.zeros((len(self.names), len(n)))
        if len(n):
            grams, starts = _trigrams(c), np.cumsum(n) - n
            spans = np.stack([starts, starts + n - 2], axis=1).ravel()
            for row, table in zip(out, self.table):
                row[:] = np.where(n > 2, -np.add.reduceat(table.take(grams), spans, dtype=np.float64)[::2], 0)
        return out / np.maximum(n - 2, 1)

    def english(self, texts: list[list[str]]) -> np.ndarray:
        bits = self.bits(texts)
        e = self.names.index("en")
        return (bits[e] <= bits.min(0)) & (bits[e] <= MOST_BITS)


def _left_out(names: list[str], n: np.ndarray) -> list[Languages]:
    """For each fold, models from the counts, folds x languages x trigrams, of the others."""
    total = n.sum(0)
    return [Languages(names, np.array([_characters(x, True) for x in total - k])) for k in n]


def _settled(names: list[str], n: np.ndarray, moved: Callable[[list[Languages]], np.ndarray]) -> Languages | None:
    """The models once the texts have moved; ``moved`` has the counts when they lie where these models fit them best."""
    if "en" not in names:
        return None
    for _ in range(MOVES):
        new = moved(_left_out(names, n))
        if (new == n).all() or not new[:, names.index("en")].any():
            break
        n = new
    total = n.sum(0)
    there = [i for i in range(len(names)) if total[i].any()]
    return Languages([names[i] for i in there], np.array([_characters(x) for x in total[there]]))


def fit_languages(texts: list[list[str]], marks: list[str], folds: int = FOLDS, fold: np.ndarray | None = None) -> Languages | None:
    """Models of the marked languages. Marks may be wrong: texts move to the language whose model, trained without
    them, fits them best, and the models are trained again. None where nothing is marked as English: the language is
    then not told."""
    names = sorted(set(marks))
    fold = np.arange(len(texts)) % folds if fold is None else fold
    parts = [_stream([t for t, k in zip(texts, fold) if k == f]) for f in range(folds)]

    def counts(of: list[np.ndarray]) -> np.ndarray:
        n = np.zeros((folds, len(names), _SIZE**3), np.int64)
        for f, (c, sizes) in enumerate(parts):
            there, some = _counted(c, sizes, of[f])
            n[f, there] = some
        return n

    first = np.array([names.index(m) for m in marks], np.int64)
    return _settled(names, counts([first[fold == f] for f in range(folds)]), lambda models: counts([m.bits_of(*p).argmin(0) for m, p in zip(models, parts)]))


# --- surprisal ------------------------------------------------------------------------------------------------------


def _unseen(w: str) -> str:
    """The class of a word that training hasn't seen: its length and ending."""
    if not _LATIN.match(w):
        return "<?>"
    return f"<{min(len(w) // 3, 5)}{w[-3:] if len(w) > 6 else ''}>"


@dataclass
class Grams:
    """Interpolated bigram models of several sides over one vocabulary."""

    words: dict[str, int]
    unigram: np.ndarray  # log2 probability, sides x words
    weight: np.ndarray  # log2 weight of the unigram after a word, sides x words
    keys: np.ndarray  # the seen pairs, first * len(words) + second, sorted
    bigram: np.ndarray  # log2 probability of each seen pair, sides x pairs

    def ids(self, words: list[str]) -> np.ndarray:
        get, known = self.words.get, self.words
        out = [get(w, -1) for w in words]
        if -1 in out:
            rest = known["<?>"]
            for i, k in enumerate(out):
                if k < 0:
                    out[i] = get(_unseen(words[i]), rest)
        return np.array(out, np.int64)

    def surprisal(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each word after the one before it, sides x words; ``starts``: where texts begin."""
        before = np.concatenate([[0], ids[:-1]])
        before[starts[starts < len(ids)]] = 0
        key = before * len(self.words) + ids
        out = self.weight[:, before] + self.unigram[:, ids]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            seen = self.keys[at] == key
            out[:, seen] = self.bigram[:, at[seen]]
        return -out


def fit_grams(texts: list[list[str]], side: np.ndarray, sides: int, least: int = 2) -> Grams:
    """Models of each side: bigrams interpolated with unigrams (weights by the number of different followers), these
    with the pooled unigrams, these with the even distribution. Words seen in fewer than ``least`` texts count as
    their class of ending."""
    in_texts = Counter(w for t in texts for w in set(t))
    words = {"<s>": 0, "<?>": 1}
    for w, n in sorted(in_texts.items()):
        if n >= least and _LATIN.match(w):
            words[w] = len(words)
    for w, n in sorted(in_texts.items()):
        if n < least or w not in words:
            words.setdefault(_unseen(w), len(words))
    v = len(words)
    rest = words["<?>"]
    uni = np.zeros((sides, v))
    all_keys, all_sides = [], []
    for t, s in zip(texts, side):
        ids = np.array([words.get(w, -1) if w in words else words.get(_unseen(w), rest) for w in t], np.int64)
        if not len(ids):
            continue
        np.add.at(uni[s], ids, 1)
        all_keys.append(np.concatenate([[0], ids[:-1]]) * v + ids)
        all_sides.append(np.full(len(ids), s))
    flat = np.concatenate(all_keys) if all_keys else np.zeros(0, np.int64)
    of = np.concatenate(all_sides) if all_sides else np.zeros(0, np.int64)
    keys, at = np.unique(flat, return_inverse=True)
    n2 = np.zeros((sides, len(keys)))
    np.add.at(n2, (of, at), 1)
    return _grams(words, uni, keys, n2)


def _grams(words: dict[str, int], uni: np.ndarray, keys: np.ndarray, n2: np.ndarray) -> Grams:
    """Models from the counts of words, sides x words, and of pairs, sides x pairs."""
    sides, v = uni.shape
    pooled = (uni.sum(0) + 0.5) / (uni.sum() + 0.5 * v)
    types = (uni > 0).sum(1, keepdims=True)
    p1 = (uni + 0.5 * (types + 1) * pooled) / (uni.sum(1, keepdims=True) + 0.5 * (types + 1))
    first = keys // v
    total, follow = np.zeros((sides, v)), np.zeros((sides, v))
    for s in range(sides):
        np.add.at(total[s], first, n2[s])
        np.add.at(follow[s], first, n2[s] > 0)
    mix = (2 * follow + 1) / (total + 2 * follow + 1)
    p2 = (1 - mix[:, first]) * n2 / np.maximum(total[:, first], 1) + mix[:, first] * p1[:, keys % v]
    f = np.float32
    return Grams(words, np.log2(p1).astype(f), np.log2(mix).astype(f), keys, np.log2(p2).astype(f))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function of least squares (pool adjacent violators): (knots, values)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x[order], y[order], (np.ones(len(x)) if w is None else w)[order]):
        blocks.append([xi, xi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            b = blocks.pop()
            blocks[-1][1], blocks[-1][2], blocks[-1][3] = b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]
    knots = np.array([k for b in blocks for k in (b[0], b[1])], float)
    values = np.array([b[2] / b[3] for b in blocks for _ in (0, 1)], float)
    return knots, values


@dataclass
class ReadingModel:
    cuts: list[int]
    grams: list[Grams]
    weights: list[np.ndarray]  # of the parts of the distribution, not negative
    curves: list[tuple[np.ndarray, np.ndarray]]
    languages: Languages | None = None

    def gaps(self, texts: list[list[str]], cuts: list[int] | None = None) -> np.ndarray:
        """The score of each text at each cut, cuts x texts: its weighted parts."""
        return np.array([_parts(_gaps(self.grams[i], texts)[0], _lengths(texts)) @ self.weights[i] for i in map(self.cuts.index, cuts or self.cuts)])

    def above(self, gap: np.ndarray, cut: int) -> np.ndarray:
        """The probability of a level above the cut."""
        knots, values = self.curves[self.cuts.index(cut)]
        return np.interp(gap, knots, values) if len(knots) else np.zeros(len(gap))

    def english(self, texts: list[list[str]]) -> np.ndarray:
        return self.languages.english(texts) if self.languages else np.ones(len(texts), bool)


def _lengths(texts: list[list[str]]) -> np.ndarray:
    return np.array([len(t) for t in texts], np.int64)


def _gaps(g: Grams, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(the gap of every word, the bits of every word under both sides)."""
    ids = g.ids([w for t in texts for w in t])
    if not len(ids):
        return np.zeros(0, np.float32), np.zeros((2, 0), np.float32)
    n = _lengths(texts)
    bits = g.surprisal(ids, np.cumsum(n) - n)
    return np.clip(bits[0] - bits[1], -6, 6), bits


def _ordered(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each text's values in ascending order; the values are not many, so one sort of a combined key does."""
    if not len(values):
        return values
    key = np.repeat(np.arange(len(n), dtype=np.float64) * 1024, n) + values
    return np.sort(key) - np.repeat(np.arange(len(n), dtype=np.float64) * 1024, n)


def _parts(gap: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The means of ``PARTS`` equal parts of each text's ordered gaps, texts x parts: together the whole distribution.
    Parts of a word count with it. 0 for texts without words."""
    ordered = _ordered(gap.astype(np.float64), n)
    total = np.concatenate([[0.0], np.cumsum(ordered), [0.0]])
    padded = np.concatenate([ordered, [0.0]])
    edges = (np.cumsum(n) - n)[:, None] + n[:, None] * np.arange(PARTS + 1) / PARTS
    whole = np.minimum(np.floor(edges + 1e-9).astype(np.int64), len(ordered))
    upto = total[whole] + np.maximum(edges - whole, 0) * padded[whole]
    return np.diff(upto, axis=1) * PARTS / np.maximum(n, 1)[:, None]


def _weighted(parts: np.ndarray, side: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights of the parts, none negative, adding up to 1: those of the logistic model that tells the sides apart,
    held near even ones."""
    v, b = np.full(parts.shape[1], 1.0), 0.0
    x = parts / max(parts.std(), 1e-9)
    rate = 4 / (1 + (x**2).sum(1).mean())
    for _ in range(steps):
        g = (1 / (1 + np.exp(-np.clip(x @ v + b, -30, 30))) - side) / len(side)
        v, b = np.maximum(v - rate * (x.T @ g + 0.02 * (v - v.mean())), 0), b - rate * g.sum()
    return v / v.sum() if v.sum() > 0 else np.full(len(v), 1 / len(v))


def _quartiles(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Lower quartile, median, upper quartile and mean of each text's words, texts x 4; NaN for texts without."""
    out = np.full((len(n), 4), np.nan)
    some = n > 0
    ends = np.cumsum(n)
    ordered = _ordered(bits, n)
    for i, q in enumerate((0.25, 0.5, 0.75)):
        at = q * (n[some] - 1)
        lo = np.floor(at).astype(np.int64)
        hi = np.minimum(lo + 1, n[some] - 1)
        first = (ends - n)[some]
        out[some, i] = ordered[first + lo] + (at - lo) * (ordered[first + hi] - ordered[first + lo])
    total = np.concatenate([[0.0], np.cumsum(bits, dtype=np.float64)])
    out[some, 3] = (total[ends] - total[ends - n])[some] / n[some]
    return out


def _judged(parts: np.ndarray, side: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(weights, curve, texts whose judgement isn't contradicted outright) from the parts of all texts."""
    w = _weighted(parts[keep], side[keep].astype(float))
    score = parts @ w
    curve = isotonic(score, side.astype(float))
    p = np.interp(score, *curve)
    return w, curve, np.where(side == 1, p > 0.1, p < 0.9)


def _enough(n: int, above: int, folds: int) -> bool:
    return n >= 2 * folds and folds <= above <= n - folds


def _plain(n: int, above: int) -> tuple[np.ndarray, np.ndarray]:
    """The curve where judgements are too few for left-out gaps: the sign of the mean gap decides."""
    return (np.array([-1.0, 0.0, 1.0]), np.array([0.0, 0.5, 1.0])) if 0 < above < n else (np.zeros(1), np.full(1, above / n if n else 0.0))


_EVEN = np.full(PARTS, 1 / PARTS)


def fit(texts: list[list[str]], level: np.ndarray, cuts: tuple[int, ...] = (1, 2, 3, 4), folds: int = FOLDS, fold: np.ndarray | None = None) -> ReadingModel:
    """Models, weights and curves from texts (as words) and their levels; weights and curves from texts left out.
    Texts whose judgement the left-out models contradict outright (nine to one) train no model: raters err."""
    grams, weights, curves = [], [], []
    fold = np.arange(len(texts)) % folds if fold is None else fold
    for c in cuts:
        side = (level > c + 0.001).astype(int)
        if not _enough(len(texts), side.sum(), folds):
            grams.append(fit_grams(texts, side, 2))
            weights.append(_EVEN)
            curves.append(_plain(len(texts), side.sum()))
            continue
        keep = np.ones(len(texts), bool)
        for _ in range(2):
            parts = np.zeros((len(texts), PARTS))
            for f in range(folds):
                train, out = (fold != f) & keep, [t for t, k in zip(texts, fold) if k == f]
                g = fit_grams([t for t, k in zip(texts, train) if k], side[train], 2)
                parts[fold == f] = _parts(_gaps(g, out)[0], _lengths(out))
            w, curve, agree = _judged(parts, side, keep)
            if not keep.all():
                break
            keep = agree
            if keep.all():
                break
        grams.append(fit_grams([t for t, k in zip(texts, keep) if k], side[keep], 2))
        weights.append(w)
        curves.append(curve)
    return ReadingModel(list(cuts), grams, weights, curves)


# --- training in tasks ----------------------------------------------------------------------------------------------


def _held(it: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of as many rows as may be in hand at once, by the length of the texts in a column."""
    for b in it:
        n = np.nan_to_num(pc.utf8_length(b.column(column)).to_numpy(zero_copy_only=False).astype(float))
        lo = 0
        while lo < b.num_rows:
            k = max(1, int(np.searchsorted(np.cumsum(n[lo : lo + HELD_TEXTS]), HELD_CHARACTERS, "right")))
            yield b.slice(lo, k)
            lo += k


def _read(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """Read the texts that train, once: rows with the prose of the judged ones (and perhaps others), and rows with the
    characters of many marked ones, in order of their folds. Copies of a text lie in one fold."""
    # 8 bytes a judged text: they spare a shuffle of all texts; the join that follows is by the id itself
    hashes = np.sort(judged.select(F.xxhash64("doc_id").alias("h")).toArrow().column(0).to_numpy())
    shared = share(docs.sparkSession, hashes)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, key bigint, fold int, words string, characters binary, sizes binary, marks binary, folds binary"

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared()
        for b in _held(it, 1):
            texts, mark = b.column(1).to_pylist(), b.column(2).to_pylist()
            h, fold = b.column(3).to_numpy(), b.column(5).to_numpy()
            asked = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
            lines = [list(_lines(t)) if m or k else [] for t, m, k in zip(texts, mark, asked)]
            rows, prose = [], []
            for i in np.flatnonzero(asked):
                words, likely = _prose(lines[i])
                if likely and len(words) >= LEAST_WORDS:
                    rows.append(i)
                    prose.append(" ".join(words))
            marked = [i for i in np.argsort(fold, kind="stable") if mark[i] and sum(map(len, lines[i])) >= LEAST_WORDS]
            c, n = _stream([[w for line in lines[i] for w in line] for i in marked])
            blob = [pa.compress(c.tobytes(), "zstd", asbytes=True), n.tobytes(), "".join([mark[i] for i in marked]).encode(), fold[marked].astype(np.int8).tobytes()]
            taken = b.take(pa.array([*rows, 0], pa.int64()))
            none = pa.nulls(len(rows))
            yield pa.RecordBatch.from_arrays(
                [taken.column(0), taken.column(4), taken.column(5), pa.array([*prose, None], pa.string()), *[pa.array([*none.to_pylist(), x if marked else None], pa.binary()) for x in blob]],
                ["doc_id", "key", "fold", "words", "characters", "sizes", "marks", "folds"],
            )

    mark = F.lower(F.trim("lang")) if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.when(mark.rlike("^[a-z][a-z]$"), mark).alias("mark"), F.xxhash64("doc_id"), F.xxhash64("doc_id", "text"), F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int"))
    return settle(rows.filter(F.col("text").isNotNull()).mapInArrow(batches, schema))


def _count_languages(read: DataFrame, models: list[Languages] | None = None) -> tuple[list[str], np.ndarray]:
    """(languages, counts of trigrams, folds x languages x trigrams) of the texts as they are marked, or as the models
    of their folds have them."""
    shared = share(read.sparkSession, models)

    def sparse(n: dict[tuple[int, str], np.ndarray]) -> pa.RecordBatch:
        at = [np.flatnonzero(x) for x in n.values()]
        columns = [pa.array([f for f, _ in n], pa.int32()), pa.array([m for _, m in n], pa.string()), pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()), pa.array([x[a].tobytes() for x, a in zip(n.values(), at)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["fold", "mark", "grams", "n"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = shared()
        n: dict[tuple[int, str], np.ndarray] = {}
        for b in it:
            for characters, sizes, marks, folds in zip(*[x.to_pylist() for x in b.columns]):
                size, of, fold = np.frombuffer(sizes, np.int64), np.frombuffer(marks, "S2").astype("U2"), np.frombuffer(folds, np.int8)
                c = np.frombuffer(pa.decompress(characters, int(size.sum()) + 2, "zstd", asbytes=True), np.uint8)
                for f in np.unique(fold).tolist():
                    lo, hi = np.searchsorted(fold, [f, f + 1])
                    start, k = size[:lo].sum(), size[lo:hi]
                    part = c[start : start + k.sum() + 2]
                    there, some = _counted(part, k, of[lo:hi] if by is None else np.array(by[f].names)[by[f].bits_of(part, k).argmin(0)])
                    for m, x in zip(there.tolist(), some):
                        n[f, m] = n[f, m] + x if (f, m) in n else x.copy()
                if len(n) > 256:
                    yield sparse(n)
                    n = {}
        yield sparse(n)

    def added(rows: Iterator[pa.RecordBatch]) -> dict[tuple[int, str], np.ndarray]:
        n: dict[tuple[int, str], np.ndarray] = {}
        for b in rows:
            for f, m, at, x in zip(*[c.to_pylist() for c in b.columns]):
                n.setdefault((f, m), np.zeros(_SIZE**3, np.int64))[np.frombuffer(at, np.uint16)] += np.frombuffer(x, np.int64)
        return n

    schema = "fold int, mark string, grams binary, n binary"
    counted = read.filter(F.col("characters").isNotNull()).select("characters", "sizes", "marks", "folds").mapInArrow(batches, schema)
    total = added(counted.groupBy("fold", "mark").applyInArrow(lambda t: pa.Table.from_batches([sparse(added(t.to_batches()))]), schema).toArrow().to_batches())
    names = models[0].names if models else sorted({m for _, m in total})
    n = np.zeros((FOLDS, len(names), _SIZE**3), np.int64)
    for (f, m), x in total.items():
        n[f, names.index(m)] = x
    return names, n


@dataclass
class Vocabulary:
    """Words that may have a model of their own, and the classes of endings of all."""

    words: dict[str, int]
    kind: np.ndarray  # the class of each word
    texts: np.ndarray  # how many texts have it, folds x words

    def ids(self, words: list[str]) -> np.ndarray:
        get = self.words.get
        return np.array([get(w, -1) if w in self.words else get(_unseen(w), 1) for w in words], np.int64)

    def grams(self, texts: np.ndarray, keys: np.ndarray, n: np.ndarray, least: int = 2) -> Grams:
        """As ``fit_grams``, from how many of its texts have each word, and from the counts of pairs, sides x pairs."""
        size = len(self.kind)
        as_ = np.where(texts >= least, np.arange(size), self.kind)
        some = n.any(0)
        first, second, n = as_[keys[some] // size], as_[keys[some] % size], n[:, some]
        uni = np.array([np.bincount(second, weights=x, minlength=size) for x in n])
        there = uni.any(0)
        there[:2] = True
        to, v = np.cumsum(there) - 1, int(there.sum())
        pairs, at = np.unique(to[first] * v + to[second], return_inverse=True)
        n2 = np.array([np.bincount(at, weights=x, minlength=len(pairs)) for x in n])
        return _grams({w: int(to[i]) for w, i in self.words.items() if there[i]}, uni[:, there], pairs, n2)


def _vocabulary(judged: DataFrame, least: int = 2) -> Vocabulary:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _held(it, 1):
            n = Counter((w, f) for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in set(t.split(" ")))
            columns = [[w for w, _ in n], [_unseen(w) for w, _ in n], [f for _, f in n], list(n.values())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()))], ["word", "kind", "fold", "n"])

    by_fold = [F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in range(FOLDS)]
    words = judged.select("fold", "words").mapInArrow(batches, "word string, kind string, fold int, n bigint").groupBy("word", "kind").agg(F.sum("n").alias("n"), *by_fold)
    # a word of too few texts has too few in any part of them: its class is enough
    own = F.when((F.col("n") >= least) & (F.col("kind") != "<?>"), F.col("word"))
    found = words.groupBy(own.alias("word"), "kind").agg(*[F.sum(f"n{f}").alias(f"n{f}") for f in range(FOLDS)]).toArrow()
    word, kind = found.column("word").to_pylist(), found.column("kind").to_pylist()
    ids = {"<s>": 0, "<?>": 1}
    for w in [*sorted(set(kind)), *sorted(w for w in word if w is not None)]:
        ids.setdefault(w, len(ids))
    kinds, texts = np.arange(len(ids)), np.zeros((FOLDS, len(ids)), np.int64)
    at = np.array([-1 if w is None else ids[w] for w in word], np.int64)
    kinds[at[at >= 0]] = np.array([ids[k] for k in kind], np.int64)[at >= 0]
    for f in range(FOLDS):
        texts[f, at[at >= 0]] = found.column(f"n{f}").to_numpy()[at >= 0]
    return Vocabulary(ids, kinds, texts)


def _count_pairs(judged: DataFrame, vocabulary: Vocabulary, steps: int, only: dict[int, np.ndarray] | None = None) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(how many texts have each word, folds x words, pairs of words, how often each occurs, folds x steps x pairs) of
    all texts, at -1, or of those with the given keys."""
    shared = share(judged.sparkSession, (vocabulary, only))
    size = len(vocabulary.kind)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, keys = shared()
        for b in _held(it, 3):
            key, fold, step = (b.column(i).to_numpy() for i in range(3))
            for c in [-1] if keys is None else keys:
                rows = np.arange(len(key)) if keys is None else np.flatnonzero(np.isin(key, keys[c]))
                texts = [t.split(" ") for t in b.column(3).take(pa.array(rows, pa.int64())).to_pylist()]
                n = _lengths(texts)
                ids = v.ids([w for t in texts for w in t])
                before = np.concatenate([[0], ids[:-1]])
                before[(np.cumsum(n) - n)[n > 0]] = 0
                pairs = (before * size + ids) * FOLDS * steps + np.repeat(fold[rows].astype(np.int64) * steps + step[rows], n)
                of = np.unique(np.repeat(np.arange(len(n)), n) * size + ids)  # each word once a text
                words = -1 - (of % size * FOLDS + fold[rows].astype(np.int64)[of // size])
                what, times = np.unique(np.concatenate([pairs[: len(ids)], words]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(what), c), pa.int32()), pa.array(what, pa.int64()), pa.array(times, pa.int64())], ["cut", "what", "n"])

    found = judged.select("key", "fold", "step", "words").mapInArrow(batches, "cut int, what bigint, n bigint").groupBy("cut", "what").agg(F.sum("n").alias("n")).toArrow()
    cut, what, times = (found.column(i).to_numpy() for i in range(3))
    out = {}
    for c in [-1] if only is None else only:
        pair, word = (cut == c) & (what >= 0), (cut == c) & (what < 0)
        texts = np.zeros((FOLDS, size), np.int64)
        np.add.at(texts, ((-1 - what[word]) % FOLDS, (-1 - what[word]) // FOLDS), times[word])
        keys, at = np.unique(what[pair] // (FOLDS * steps), return_inverse=True)
        n = np.zeros((FOLDS * steps, len(keys)), np.int64)
        n[what[pair] % (FOLDS * steps), at] = times[pair]
        out[c] = texts, keys, n.reshape(FOLDS, steps, -1)
    return out


def _less(all_: tuple[np.ndarray, np.ndarray, np.ndarray], some: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = all_[2].copy()
    n[:, :, np.searchsorted(all_[1], some[1])] -= some[2]
    return all_[0] - some[0], all_[1], n


def _left_out_parts(judged: DataFrame, models: dict[int, list[Grams]]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """(keys, steps, the parts at each cut) of the texts under the models of their folds, in order of the keys."""
    shared = [share(judged.sparkSession, {c: m[f] for c, m in models.items()}) for f in range(FOLDS)]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, of = -1, {}
        for b in _held(it, 3):
            fold = b.column(1).to_numpy()
            for f in np.unique(fold).tolist():  # rows are in order of the folds: a task has the models of one at a time
                if f != at:
                    at, of = f, shared[f]()
                part = b.filter(pa.array(fold == f))
                texts = [t.split(" ") for t in part.column(3).to_pylist()]
                parts = np.concatenate([_parts(_gaps(g, texts)[0], _lengths(texts)) for g in of.values()], axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([x.tobytes() for x in parts], pa.binary())], ["key", "step", "parts"])

    found = judged.select("key", "fold", "step", "words").mapInArrow(batches, "key bigint, step int, parts binary").toArrow()
    key, step = found.column(0).to_numpy(), found.column(1).to_numpy()
    parts = np.frombuffer(b"".join(found.column(2).to_pylist()), np.float64).reshape(len(key), len(models), PARTS)
    order = np.lexsort((step, key))
    return key[order], step[order], {c: parts[order, i] for i, c in enumerate(models)}


def fit_judged(judged: DataFrame, cuts: tuple[int, ...]) -> ReadingModel:
    """As ``fit``, from rows ``key``, ``fold``, ``words`` (by blanks) and ``step``, the number of cuts below the level."""
    steps = len(cuts) + 1
    above = {c: sum(x < c for x in cuts) + 1 for c in cuts}  # the step from which a text lies above the cut
    texts = {r["step"]: r["count"] for r in judged.groupBy("step").count().collect()}
    n = sum(texts.values())
    n_above = {c: sum(k for s, k in texts.items() if s >= above[c]) for c in cuts}
    vocabulary = _vocabulary(judged)
    everything = _count_pairs(judged, vocabulary, steps)[-1]

    def grams(c: int, counts: tuple[np.ndarray, np.ndarray, np.ndarray], without: int | None = None) -> Grams:
        folds = [f for f in range(FOLDS) if f != without]
        pairs = counts[2][folds].sum(0)
        return vocabulary.grams(counts[0][folds].sum(0), counts[1], np.array([pairs[: above[c]].sum(0), pairs[above[c] :].sum(0)]))

    counts, weights, curves = dict.fromkeys(cuts, everything), dict.fromkeys(cuts, _EVEN), {c: _plain(n, n_above[c]) for c in cuts}
    told = [c for c in cuts if _enough(n, n_above[c], FOLDS)]
    keep: dict[int, np.ndarray] = {}
    while told:
        key, step, parts = _left_out_parts(judged, {c: [grams(c, counts[c], f) for f in range(FOLDS)] for c in told})
        agree = {}
        for c in told:
            weights[c], curves[c], agree[c] = _judged(parts[c], (step >= above[c]).astype(int), keep.get(c, np.ones(len(key), bool)))
        told = [c for c in told if c not in keep and not agree[c].all()]
        if told:
            keep = {c: agree[c] for c in told}
            out = _count_pairs(judged, vocabulary, steps, {c: key[~keep[c]] for c in told})
            counts |= {c: _less(everything, out[c]) for c in told}
    return ReadingModel(list(cuts), [grams(c, counts[c]) for c in cuts], [weights[c] for c in cuts], [curves[c] for c in cuts])


def train(docs: DataFrame, labels: DataFrame, cuts: tuple[int, ...] = (1, 2, 3, 4)) -> ReadingModel:
    """A model from all judged texts: a text's level is the mean of its raters' judgements, each counted once. Null
    verdicts, judgements of missing texts and texts with fewer than 8 words of English prose train nothing. The
    languages are learnt from all texts by the two-letter mark in ``lang`` (which may be absent, null or wrong).

    To the driver come counts (of trigrams by language, of pairs of words) and 8 numbers of each judged text and cut."""
    by_rater = labels.filter(F.col("reading_level").isNotNull()).groupBy("doc_id", "rater").agg(F.avg("reading_level").alias("level"))
    levels = by_rater.groupBy("doc_id").agg(F.avg("level").alias("level"))
    read = _read(docs, levels)
    languages = _settled(*_count_languages(read), lambda models: _count_languages(read, models)[1])
    shared = share(docs.sparkSession, languages)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared()
        for b in _held(it, 3):
            yield b if m is None else b.filter(pa.array(m.english([t.split(" ") for t in b.column(3).to_pylist()])))

    step = sum([(F.col("level") > c + 0.001).cast("int") for c in cuts], F.lit(0))
    rows = read.filter(F.col("words").isNotNull()).select("doc_id", "key", "fold", "words").join(levels, "doc_id")
    judged = rows.select("key", "fold", step.alias("step"), "words").mapInArrow(batches, "key bigint, fold int, step int, words string").sortWithinPartitions("fold")
    model = fit_judged(settle(judged), cuts)
    model.languages = languages
    return model


def grade(docs: DataFrame, model: ReadingModel, keep: tuple[str, ...] = (), spread: bool = True) -> DataFrame:
    """Every document with ``n_words`` of running prose, whether it is ``english``, the quartiles and mean of its
    words' surprisal (bits under the better of both sides of the lowest cut's models; null without ``spread``),
    ``above`` (the probability of a level above each cut, by its number) and ``level`` (1 plus these probabilities),
    and the columns ``keep``.

    Texts without English prose, null and empty ones have null measures. Texts are read as a whole; no shuffle. Rows
    with equal or null ids are kept; other columns are ignored. Columns to keep may not be named like a measure."""
    if set(keep) & {"doc_id", "n_words", "english", "bits_q1", "bits_median", "bits_q3", "bits_mean", "above", "level"}:
        raise ValueError("a column to keep is named like a measure")
    shared = share(docs.sparkSession, model)
    kind = dict(docs.dtypes)["doc_id"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ReadingModel = shared()
        for b in it:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                read = [prose_words(t) if t else ([], False) for t in part.column(1).to_pylist()]
                texts = [w if k else [] for w, k in read]
                ok = np.array([bool(w) for w in texts], bool)
                ok &= m.english(texts)
                texts = [w if k else [] for w, k in zip(texts, ok)]
                n = _lengths(texts)
                above, bits = [], None
                for c, g, w in zip(m.cuts, m.grams, m.weights):
                    gap, both = _gaps(g, texts)
                    bits = both.min(0) if bits is None else bits
                    above.append(np.where(ok, m.above(_parts(gap, n) @ w, c), np.nan))
                above = np.array(above)
                quartiles = _quartiles(bits, n) if spread else np.full((len(n), 4), np.nan)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * len(m.cuts), pa.int32()), pa.array(above.T.reshape(-1)))
                number = lambda a: pa.array(a, from_pandas=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(ok), *[number(quartiles[:, i]) for i in range(4)], lists, number(1 + above.sum(0)), *part.columns[2:]],
                    ["doc_id", "n_words", "english", "bits_q1", "bits_median", "bits_q3", "bits_mean", "above", "level", *keep],
                )

    schema = T.StructType.fromDDL(f"doc_id {kind}, n_words bigint, english boolean, bits_q1 double, bits_median double, bits_q3 double, bits_mean double, above array<double>, level double")
    schema = T.StructType([*schema.fields, *[docs.schema[c] for c in keep]])
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *keep).mapInArrow(batches, schema)


def demanding(docs: DataFrame, labels: DataFrame, cut: int = 3, min_words: int = MIN_WORDS) -> DataFrame:
    """Ids of the documents in English with at least ``min_words`` words of running prose that more likely than not
    take a reader above level ``cut``."""
    graded = grade(docs, train(docs, labels, (cut,)), spread=False)
    return graded.filter(F.col("english") & (F.col("n_words") >= min_words) & (F.col("above")[0] >= 0.5)).select("doc_id")
