"""Log lines of many programs into entries with timestamp, level, component and message, by position-word mining.

Heads are cut into pieces: values that parse as times, words, numbers, spaces and marks. ``count_heads`` counts the
beginnings of all unindented lines, ``count_words`` each word at its place (the kinds of what precedes it).
``mine_templates`` gives the slots their roles from these counts: where level names are frequent lies the level, where
other words return again and again before a delimiter, beside a time, a level or a bracket, lies the component; marks
and kinds of a frequent template are its constants. ``parse_entries`` reads the lines in order by the mined templates;
self-describing records (JSON, key=value) are read by their keys, and what fits no template by fallback rules.

Lines are read by chunks of ``chunk_lines`` numbers of a job, so a job with most of the lines is spread over many
tasks; entries that run over the end of a chunk are put together afterwards from one row per chunk."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from embermill.session import cut, share

CHUNK_LINES = 8192
SUPPORT = 2e-4  # of the heads: at most 8 / SUPPORT places and 1 / SUPPORT templates

# Level names as programs write them.
LEVELS = {
    "d": "DEBUG", "dbg": "DEBUG", "debug": "DEBUG", "trace": "DEBUG", "10": "DEBUG",
    "i": "INFO", "inf": "INFO", "info": "INFO", "notice": "INFO", "20": "INFO",
    "w": "WARNING", "wrn": "WARNING", "warn": "WARNING", "warning": "WARNING", "30": "WARNING",
    "e": "ERROR", "err": "ERROR", "error": "ERROR", "40": "ERROR",
    "c": "CRITICAL", "crt": "CRITICAL", "crit": "CRITICAL", "critical": "CRITICAL",
    "f": "CRITICAL", "ftl": "CRITICAL", "fatal": "CRITICAL", "50": "CRITICAL",
}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}

_WORD = "|".join(sorted((w for w in LEVELS if w.isalpha() and len(w) > 1), key=len, reverse=True))
_ISO = r"(?P<y>\d{4})[-/](?P<mo>\d\d)[-/](?P<d>\d\d)[T ](?P<h>\d\d):(?P<mi>\d\d):(?P<s>\d\d)(?:[.,](?P<f>\d+))?\s?(?P<z>Z|[+-]\d\d:?\d\d)?"
_DMY = r"(?P<d>\d\d?)[- ](?P<mon>[A-Za-z]{3})[- ](?P<y>\d{4}) (?P<h>\d\d?):(?P<mi>\d\d):(?P<s>\d\d)(?:[.,](?P<f>\d+))?(?: (?P<ap>[AP]M))?"

_ANSI = re.compile(r"\x1b\[[0-9;?]*[A-Za-z]")
_PAIR = re.compile(r'([A-Za-z_][\w.\-]*)=("(?:[^"\\]|\\.)*"|\S*)(?:\s+|$)')
_FIELD = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*("(?:[^"\\]|\\.)*"|-?[\d.]+(?:[eE][+-]?\d+)?|true|false|null|[\[{])')
_NUMBER = re.compile(r"(\d{9,})(?:\.(\d*))?$")
_ISO_RE, _DMY_RE = re.compile(_ISO), re.compile(_DMY)
# Keys of records, in the order in which they are believed.
TIME_KEYS, LEVEL_KEYS = ("time", "ts", "timestamp", "@timestamp", "asctime", "t"), ("level", "lvl", "severity", "levelname")
COMPONENT_KEYS, MESSAGE_KEYS = ("component", "comp", "logger", "name", "module"), ("message", "msg", "event")

_EPOCH_DAY = datetime(1970, 1, 1).toordinal()


_DAYS: dict[tuple[int, int, int], int | None] = {}


def _day(y: int, mo: int, d: int) -> int | None:
    """Days since 1970."""
    key = (y, mo, d)
    if key not in _DAYS:
        if len(_DAYS) > 10_000:
            _DAYS.clear()
        try:
            _DAYS[key] = datetime(y, mo, d).toordinal() - _EPOCH_DAY
        except ValueError:
            _DAYS[key] = None
    return _DAYS[key]


def _millis(g: dict) -> tuple[int | None, int | None]:
    """(milliseconds since 1970 UTC, None), or for a head without a year (None, month-day-and-time code)."""
    h = int(g["h"])
    if g.get("ap"):
        h = h % 12 + (12 if g["ap"] == "PM" else 0)
    ms = ((h * 60 + int(g["mi"])) * 60 + int(g["s"])) * 1000 + int(((g.get("f") or "") + "000")[:3])
    mo = MONTHS.get(g["mon"].lower(), 0) if g.get("mon") else int(g["mo"])
    d = int(g["d"])
    if not (1 <= mo <= 12 and 1 <= d <= 31):
        return None, None
    if not g.get("y"):
        return None, (mo * 100 + d) * 100_000_000 + ms
    day = _day(int(g["y"]), mo, d)
    if day is None:
        return None, None
    z = g.get("z")
    off = 0
    if z and z != "Z":
        off = (int(z[1:3]) * 60 + int(z[-2:])) * (-1 if z[0] == "-" else 1)
    return day * 86_400_000 + ms - off * 60_000, None


def _stamp(text: str) -> int | None:
    """The time of a record's field: ISO text, a day-month-year text, or seconds or milliseconds since 1970; digits
    beyond milliseconds are dropped, never rounded."""
    if m := _NUMBER.match(text):
        whole, frac = m.group(1), m.group(2) or ""
        if len(whole) >= 16:
            return int(whole) // 1000
        return int(whole) if len(whole) >= 12 else int(whole) * 1000 + int((frac + "000")[:3])
    m = _ISO_RE.match(text) or _DMY_RE.match(text)
    return _millis(m.groupdict())[0] if m else None


def _level(text: str) -> str | None:
    return LEVELS.get(text.strip().lower())


def _unquote(v: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m.group(1), m.group(1)), v[1:-1]) if v[:1] == '"' else v


class _Head:
    __slots__ = ("ts", "part", "level", "comp", "msg")

    def __init__(self, ts=None, part=None, level=None, comp=None, msg=None):
        self.ts, self.part, self.level, self.comp, self.msg = ts, part, level, comp, msg


def _take(head: _Head, pairs) -> None:
    """Roles of a record's fields; the first field of a role counts."""
    for k, v in pairs:
        key = k.lower()
        if head.ts is None and key in TIME_KEYS:
            head.ts = _stamp(_unquote(v))
        elif head.level is None and key in LEVEL_KEYS:
            head.level = _level(_unquote(v))
        elif head.comp is None and key in COMPONENT_KEYS:
            head.comp = _unquote(v)
        elif head.msg is None and key in MESSAGE_KEYS:
            head.msg = _unquote(v)


def _record(line: str) -> _Head | None:
    """A JSON record on one line: only fields of its own level count."""
    if not line.rstrip().endswith("}"):
        return None
    head, at, depth, top = _Head(), 1, 0, []
    while m := _FIELD.search(line, at):
        between = line[at : m.start()]
        depth += between.count("{") + between.count("[") - between.count("}") - between.count("]")
        if depth <= 0:
            top.append(m.groups())
        at = m.end()
        if m.group(2) in "[{":
            depth += 1
    if not top:
        return None
    _take(head, top)
    return head


def _pairs(line: str, keys: dict[str, str]) -> _Head | None:
    """A line of key=value pairs that names a time or a level, and a component. ``keys``: mined roles of keys."""
    head, at, found = _Head(), 0, []
    while m := _PAIR.match(line, at):
        found.append(m.groups())
        at = m.end()
        if m.group(1).lower() in MESSAGE_KEYS:
            break
    names = {k.lower() for k, _ in found}
    if len(found) < 2 or not (names & {*TIME_KEYS, *LEVEL_KEYS} or "time" in (known := {keys.get(k) for k in names}) or "level" in known):
        return None
    _take(head, found)
    if keys:
        # conventional names first
        for role, have in (("time", head.ts), ("level", head.level), ("component", head.comp)):
            if have is None:
                _take(head, [(role, v) for k, v in found if keys.get(k.lower()) == role])
    return head if head.comp else None


# --- heads in pieces ------------------------------------------------------------------------------------------------

_MON = "|".join(m.capitalize() for m in MONTHS)
_IDENT = r"[A-Za-z_]\w*(?:[.\-/](?:[A-Za-z_]\w*|\d{1,3}(?!\d)))*"
#: What a head is cut into. The named kinds are values that parse as (parts of) a time, words, numbers and spaces; any
#: other character is a mark.
_PIECE = re.compile(
    rf"""(?P<ymd>\d{{4}}[-/]\d\d[-/]\d\d(?!\d))|(?P<dmy>\d\d?[-\ ](?:{_MON})[-\ ]\d{{4}}(?!\d))|(?P<md>(?:{_MON})\ +\d\d?(?=\ +\d\d:))
    |(?P<mmdd>\d{{4}}(?=\ +\d\d?:\d\d:\d\d))|(?P<clock>\d\d?:\d\d:\d\d(?:[.,]\d+)?(?:\ [AP]M\b)?(?:\ ?(?:Z\b|[+-]\d\d:?\d\d\b))?)
    |(?P<epoch>\d{{10}}(?:\.\d+)?(?![\w.])|\d{{13}}(?![\w.]))|(?P<letter>[A-Z](?=\d{{4}}\ +\d\d?:\d\d:\d\d))|(?P<t>T(?=\d\d:\d\d:\d\d))
    |(?P<word>{_IDENT})|(?P<number>\d+)|(?P<space>\s+)|(?P<more>\x1e)|(?P<mark>.)""",
    re.X,
)
_TIMES = ("ymd", "dmy", "md", "mmdd", "clock", "epoch")
_COMPONENT = rf"(?P<c>(?!(?i:{_WORD})(?![\w.\-/]))[A-Za-z_][\w.\-/]*)"
#: Regular expressions of the kinds, for reading.
_KINDS = {
    "ymd": r"(?P<y>\d{4})[-/](?P<mo>\d\d)[-/](?P<d>\d\d)", "dmy": r"(?P<d>\d\d?)[- ](?P<mon>[A-Za-z]{3})[- ](?P<y>\d{4})", "md": r"(?P<mon>[A-Z][a-z]{2}) +(?P<d>\d\d?)",
    "mmdd": r"(?P<mo>\d\d)(?P<d>\d\d)", "clock": r"(?P<h>\d\d?):(?P<mi>\d\d):(?P<s>\d\d)(?:[.,](?P<f>\d+))?(?: (?P<ap>[AP]M))?(?: ?(?P<z>Z|[+-]\d\d:?\d\d))?",
    "epoch": r"(?P<e>\d{10,13}(?:\.\d+)?)", "t": "T", "word": r"[A-Za-z_][\w.\-/]*", "number": r"\d+", "space": r"\s+", "component": _COMPONENT,
    "level_letter": "(?P<l>[DIWECF])", "level_upper": f"(?P<l>{_WORD.upper()})", "level_lower": f"(?P<l>{_WORD})", "level_any": f"(?P<l>(?i:{_WORD}))",
}
_CLOSER = {"[": "]", "<": ">", "(": ")"}
_PLAIN_CLOSERS, _CLOSERS = "]:|-", "]>):|-~#*"
_SEP = "\x1f"


def _pieces(head: str, most: int = 40) -> list[tuple[str, str]]:
    """(kind, text) of the first pieces; a mark's kind is the mark."""
    out = []
    for m in _PIECE.finditer(head):
        kind = m.lastgroup
        if kind == "more":
            out.append(("more", ""))
            break
        out.append(("word" if kind == "letter" else m.group() if kind == "mark" else kind, m.group()))
        if len(out) >= most:
            out.append(("more", ""))
            break
    return out


def _after(p: list[tuple[str, str]], i: int, closers: str) -> int | None:
    """Where the delimiter ends that follows the word at ``i``, a line or process number included; None without one."""
    kind = lambda j: p[j][0] if j < len(p) else None
    j = i + 1
    if kind(j) == ":" and kind(j + 1) == "number":
        j += 2
    elif kind(j) in ("[", "(") and kind(j + 1) == "number" and kind(j + 2) == _CLOSER[kind(j)]:
        j += 3
    opened = _CLOSER.get(kind(i - 1)) if i else None
    if opened:
        if kind(j) != opened:
            return None
        j += 1
        return j + 1 if kind(j) == ":" else j
    k = j + (kind(j) == "space")
    m = k
    while kind(m) and len(kind(m)) == 1 and kind(m) in closers:
        m += 1
    if m > k:
        return m
    return j if kind(j) is None or (kind(j) == "space" and kind(j + 1) is None) else None


def _places(p: list[tuple[str, str]]) -> list[tuple[int, str, str]]:
    """(index, place, delimiter) of each word: its place is the kinds of all pieces before it."""
    out, kinds = [], [k for k, _ in p]
    for i, (kind, _) in enumerate(p):
        if kind == "word":
            end = _after(p, i, _CLOSERS)
            out.append((i, _SEP.join(kinds[:i]), "" if end is None else _SEP.join(kinds[i + 1 : end]) or "$"))
    return out


def _style(word: str) -> str:
    return "level_letter" if len(word) == 1 else "level_upper" if word.isupper() else "level_lower" if word.islower() else "level_any"


def _is_level(word: str) -> bool:
    return word.lower() in LEVELS and (len(word) > 1 or word in "DIWECF")


class _Slots:
    """What was counted at a word's place: lines, lines with a level name, different other words."""

    def __init__(self, counted: dict[tuple[str, str], tuple[int, int, int]], least: float):
        self.counted, self.least = counted, least

    def level(self, place: str, after: str, sure: bool) -> bool:
        """Level names are frequent there; if not ``sure``, they are nearly all there is."""
        n, names, _ = self.counted.get((place, after), (0, 0, 0))
        return names >= self.least and (sure or names >= 0.9 * n)

    def component(self, place: str, after: str) -> bool:
        """Other words are frequent there, and are used again and again."""
        n, names, words = self.counted.get((place, after), (0, 0, 0))
        return n - names >= self.least and n - names >= 0.02 * n and words <= max(20, 0.5 * (n - names))

    def share(self, place: str, after: str, of: tuple[str, str]) -> float:
        return self.counted.get((place, after), (0, 0, 0))[0] / max(self.counted.get(of, (1, 0, 0))[0], 1)


def _template(p: list[tuple[str, str]], slots: _Slots | None) -> str | None:
    """The head's template: constants (marks), kinds, and the slots with their roles, up to the end of the head; None
    if it isn't the head of an entry.

    With ``slots`` (mined), roles follow the counts at each place. Without, for outliers, only what is beyond doubt is
    a head: a time or a level name, and a component between the commonest marks."""
    timed = any(k in _TIMES for k, _ in p)
    level = comp = None
    skipped, kinds = 0, [k for k, _ in p]
    closers = _CLOSERS if slots else _PLAIN_CLOSERS
    before = False  # a time so far
    at = -1
    for i, place, after in _places(p):
        before = before or any(k in _TIMES for k in kinds[at + 1 : i])
        at, word = i, p[i][1]
        if kinds[i + 1 : i + 2] == ["="]:
            return None
        end = _after(p, i, closers)
        if comp is None:
            enclosed = i > 0 and kinds[i - 1] in _CLOSER
            if level is None and _is_level(word) and (slots is None or slots.level(place, after, True)):
                level = i
                continue
            first = i == 1 and enclosed  # a tag at the line's start needs no more evidence, if it is frequent
            if end is not None and not _is_level(word) and (before or (level is not None and not _spaced(kinds, level)) or (first and slots)):
                if after == "$" and not (timed and level is not None):
                    return None  # the line ends with a word that might be anything
                if slots is None or slots.component(place, after):
                    comp, comp_end, comp_place = i, end, (place, after)
                    continue
            skipped += 1
            if slots is None or skipped > 2 or end is not None:
                return None
            continue
        # the word after the component: a level, or the component itself after the name of a thread
        if i - comp_end <= 2 and all(k == "space" or k in _CLOSER for k in kinds[comp_end:i]):
            if level is None and _is_level(word) and (slots.level(place, after, bool(after)) if slots else end is not None and _style(word) == "level_upper"):
                if end is not None or slots:
                    level = i
                    comp_end = max(comp_end, end if end is not None else i + 1)
            elif slots and end is not None and end > i + 1 and level is not None and slots.component(place, after) and slots.share(place, after, comp_place) >= 0.9:
                comp, comp_end = i, end
        break
    if comp is None:
        return None
    out = [("component" if i == comp else _style(p[i][1]) if i == level else k) for i, k in enumerate(kinds[: max(comp_end, (level or 0) + 1)])]
    if out[-1] == "space":
        out.pop()
    return _SEP.join(out)


def _spaced(kinds: list[str], level: int) -> bool:
    """Whether the level name is followed by a colon and a space: what follows is then the message."""
    return kinds[level + 1 : level + 3] == [":", "space"]


_COMPILED: dict[str, re.Pattern[str] | None] = {}


def _pattern(template: str) -> re.Pattern[str] | None:
    if template not in _COMPILED:
        if len(_COMPILED) > 20_000:
            _COMPILED.clear()
        kinds = template.split(_SEP)
        text = "".join(_KINDS[k] if len(k) > 1 or k == "t" else re.escape(k) for k in kinds)
        last = kinds[-1]
        end = r"\s*$" if last == "component" else "" if last == ":" and "space" not in kinds[-2:] else r"(?=\s|$)"
        try:
            _COMPILED[template] = re.compile(text + end)
        except re.error:  # two times of one kind
            _COMPILED[template] = None
    return _COMPILED[template]


def _fit(template: str, line: str) -> _Head | None:
    """The line read by a template."""
    pattern = _pattern(template)
    m = pattern.match(line) if pattern else None
    if not m:
        return None
    g = m.groupdict()
    ts = part = None
    if g.get("h") and g.get("d"):
        ts, part = _millis(g)
    elif g.get("e"):
        ts = _stamp(g["e"])
    return _Head(ts, part, LEVELS.get(g["l"].lower()) if g.get("l") else None, g["c"], line[m.end() :].strip())


def _begins(template: str, first: str) -> bool:
    """Whether a line that begins with this character can fit."""
    kind = template.split(_SEP, 1)[0]
    if len(kind) == 1:
        return first == kind
    return first.isdigit() == (kind in ("ymd", "dmy", "mmdd", "clock", "epoch", "number"))


_MAYBE = re.compile(rf".{{0,40}}?\d:\d\d:\d\d|[\[<(]?(?i:{_WORD})[^\w\s]|\W?\d{{10}}")


def _outlier(line: str) -> _Head | None:
    """A line of no mined template, by the rules alone."""
    if not _MAYBE.match(line):
        return None
    template = _template(_pieces(line), None)
    return _fit(template, line) if template else None


#: The part of a line that may be a head: up to eight words, ending with the first of two plain words in a row.
_HEAD = re.compile(r"(?:(?![a-z]+ +[a-z]+\b)\S+(?:\s+|$)){0,8}(?:[a-z]+\b)?")
_MASK = {i: "0" for i in range(48, 58)}


def _plain(line: str) -> str:
    return _ANSI.sub("", line) if "\x1b" in line else line


def count_heads(lines: DataFrame) -> DataFrame:
    """``head`` (digits as 0, an end mark where the line goes on) and ``n``: how often each head begins an unindented
    line that is no JSON record.

    Counts are summed in each Python batch before the shuffle. Null, blank and indented lines count for nothing."""

    def batch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n: Counter[str] = Counter()
            for line in b.column(0).to_pylist():
                if not line:
                    continue
                x = _plain(line)
                if not x or x[0] in " \t\r\n{}":
                    continue
                m = _HEAD.match(x)
                n[m.group() if m.end() == len(x) else m.group() + "\x1e"] += 1
            masked: Counter[str] = Counter()
            for head, k in n.items():
                masked[head.translate(_MASK)] += k
            if masked:
                yield pa.RecordBatch.from_arrays([pa.array(masked.keys(), pa.string()), pa.array(masked.values(), pa.int64())], ["head", "n"])

    return lines.select("line").mapInArrow(batch, "head string, n bigint").groupBy("head").agg(F.sum("n").alias("n"))


def count_words(heads: DataFrame) -> DataFrame:
    """``place``, ``after``, ``word`` and ``n``: the position-word counts. A word's place is what comes before it,
    ``after`` the delimiter behind it. The values of key=value fields are counted at their key, ``word`` then says only
    what they are (a time, a level, a word, other)."""

    def batch(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            n: Counter[tuple[str, str, str]] = Counter()
            for head, k in zip(pdf["head"], pdf["n"]):
                if _PAIR.match(head):
                    for key, v in _PAIR.findall(head.rstrip("\x1e")):
                        kind = _value_kind(_unquote(v))
                        n[key.lower() + "=", kind, v if kind in ("level", "word") else ""] += k
                    continue
                p = _pieces(head)
                for i, place, after in _places(p):
                    n[place, after, p[i][1]] += k
            if n:
                yield pd.DataFrame([(*key, k) for key, k in n.items()], columns=["place", "after", "word", "n"])

    counted = heads.mapInPandas(batch, "place string, after string, word string, n bigint")
    return counted.groupBy("place", "after", "word").agg(F.sum("n").alias("n"))


def _value_kind(v: str) -> str:
    if any(k in _TIMES and k != "epoch" for k, _ in _pieces(v, 3)):
        return "time"
    return "level" if _is_level(v) and len(v) > 1 else "word" if re.fullmatch(_IDENT, v) else "other"


@dataclass
class Mined:
    """Templates with their counts, and the roles of keys in key=value lines."""

    templates: dict[str, int] = field(default_factory=dict)
    keys: dict[str, str] = field(default_factory=dict)


def mine_templates(heads: DataFrame, support: float = SUPPORT) -> Mined:
    """The frequent templates of heads, their slots with roles by what was counted at each place.

    Places and templates of fewer than ``support`` of the heads are left to the fallback rules, so at most 8 / support
    places and 1 / support templates come to the driver, however many lines there are."""
    total = heads.agg(F.sum("n")).first()[0] or 0
    if not total:
        return Mined()
    least = max(1.0, support * total)
    name = F.lower("word").isin(*[w for w in LEVELS if len(w) > 1]) | F.col("word").isin(*"DIWECF")
    words = cut(count_words(heads))
    by_place = words.groupBy("place", "after").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(name, F.col("n"))), F.lit(0)).alias("names"), F.count(F.when(~name, 1)).alias("words"))
    frequent = by_place.filter((F.col("n") >= least)).collect()
    counted = {(r["place"], r["after"]): (r["n"], r["names"], r["words"]) for r in frequent if not r["place"].endswith("=")}
    shared = heads.sparkSession.sparkContext.broadcast((counted, least))

    def batch(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = _Slots(*shared.value)
        for pdf in it:
            n: Counter[str] = Counter()
            for head, k in zip(pdf["head"], pdf["n"]):
                if not _PAIR.match(head) and (t := _template(_pieces(head), slots)):
                    n[t] += k
            if n:
                yield pd.DataFrame({"template": list(n), "n": list(n.values())})

    found = heads.mapInPandas(batch, "template string, n bigint").groupBy("template").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return Mined({r["template"]: r["n"] for r in found.collect()}, _key_roles(frequent))


def _key_roles(frequent: list) -> dict[str, str]:
    """Roles of keys by the kinds of their values; conventional names need no counts."""
    at: dict[str, dict[str, tuple[int, int]]] = {}
    for r in frequent:
        if r["place"].endswith("="):
            at.setdefault(r["place"][:-1], {})[r["after"]] = (r["n"], r["words"])
    roles = {}
    for key, kinds in at.items():
        n = sum(k for k, _ in kinds.values())
        for kind, role in (("time", "time"), ("level", "level"), ("word", "component")):
            k, different = kinds.get(kind, (0, 0))
            if k >= 0.9 * n and (role != "component" or (different <= 0.1 * k and key not in MESSAGE_KEYS)):
                roles[key] = role
    return roles


_ENTRY = "job_id bigint, chunk bigint, first_seq bigint, last_seq bigint, ts bigint, part bigint, level string, component string, message string, rest string, kind string, has_head boolean, closed boolean"


class _Reader:
    """Reads the lines of one chunk after the other; gives rows of ``_ENTRY``.

    kind: entry (ends in its chunk), last (the chunk's last entry), open (as last, in a record whose end hasn't
    come), lead (what comes before the chunk's first head, one for every chunk). ``message`` is the head's own, ``rest``
    the lines after it; of a lead, ``message`` is that of the record it may continue, ``closed`` whether it ends that
    record, and ``rest`` all its lines; after (beside such a lead) has the lines after that end."""

    def __init__(self, mined: Mined, with_message: bool):
        self.keys, self.with_message = mined.keys, with_message
        # the longest template first, then the commonest
        self.templates = sorted(mined.templates, key=lambda t: (-len(t.split(_SEP)), -mined.templates[t], t))
        self.by_first: dict[str, list[str]] = {}
        self.rows: list[tuple] = []
        self.at: tuple | None = None

    def begin(self, job: int, chunk: int) -> None:
        self.at = (job, chunk)
        self.seq: int | None = None
        self.lead_last: int | None = None
        self.lead, self.lead_indent, self.lead_closed, self.lead_text = _Head(), None, False, []
        self.head: _Head | None = None

    def read(self, line: str) -> _Head | None:
        first = line[0]
        if first == "{":
            return _record(line)
        if first not in self.by_first:
            self.by_first[first] = [t for t in self.templates if _begins(t, first)]
        for t in self.by_first[first]:
            if h := _fit(t, line):
                return h
        if "=" in line and (h := _pairs(line, self.keys)):
            return h
        return _outlier(line)

    def line(self, seq: int, raw: str | None) -> None:
        if seq == self.seq:
            return  # delivered twice
        line = _plain(raw) if raw else ""
        head = None
        record = False
        if line and line[0] not in " \t\r\n":
            if line.rstrip() == "{":
                head, record = _Head(), True
            else:
                head = self.read(line)
        if head is not None:
            if self.head is not None:
                self.end("entry")
            self.head, self.first, self.open, self.indent = head, seq, record, None
            self.text: list[str] = []
        elif self.head is None:
            self.lead_last = seq
            if self.with_message:
                self.lead_text.append(line)
            if not self.lead_closed:
                self.lead_closed, self.lead_indent = self.field(self.lead, line, self.lead_indent)
                if self.lead_closed:
                    self.lead_end = len(self.lead_text)
        elif self.open:
            closed, self.indent = self.field(self.head, line, self.indent)
            if closed:
                self.open = False
        elif self.with_message:
            self.text.append(line)
        self.seq = seq

    def field(self, head: _Head, line: str, indent: int | None) -> tuple[bool, int | None]:
        """One line of a record over several lines: (whether it is closed, the indent of its own fields)."""
        bare = line.lstrip(" \t")
        if line[:1] == "}":
            return True, indent
        if bare[:1] == '"':
            by = len(line) - len(bare)
            if indent is None or by < indent:
                indent = by
            if by == indent and (m := _FIELD.match(bare)):
                _take(head, [m.groups()])
        return False, indent

    def end(self, kind: str) -> None:
        h = self.head
        self.rows.append((*self.at, self.first, self.seq, h.ts, h.part, h.level, h.comp, h.msg, self.joined(self.text), kind, True, not self.open))

    def joined(self, lines: list[str]) -> str | None:
        return "\n".join(lines) if lines else None

    def finish(self) -> None:
        if self.at is None:
            return
        if self.head is not None:
            self.end("open" if self.open else "last")
        h = self.lead
        plain = (*self.at, None, self.lead_last, h.ts, None, h.level, h.comp, h.msg, self.joined(self.lead_text))
        self.rows.append((*plain, "lead", self.head is not None, self.lead_closed))
        if self.with_message and self.lead_closed:
            # the lines after the end of the record, for the case that one was open
            self.rows.append((*plain[:-1], self.joined(self.lead_text[self.lead_end :]), "after", self.head is not None, True))
        self.at = None


def parse_entries(lines: DataFrame, jobs: DataFrame, with_message: bool = True, chunk_lines: int = CHUNK_LINES, support: float = SUPPORT) -> DataFrame:
    """Entries of ``lines`` (job_id, seq, line, received_at): job_id, first_seq, last_seq, ts_ms, level, component
    and, if wanted, message.

    Lines are taken by ``seq``, each once (of repeated deliveries the earliest received). Null and blank lines
    belong to the entry before them. Lines without job_id or seq have no place and are left out. ``ts_ms`` is -1
    without a time, ``level`` NONE without a level, ``component`` empty for a record that names none. A head without
    a year takes that of the job's ``started``, else ``ended``, else the first line's ``received_at``. Other columns
    are ignored; empty tables give no rows."""
    spark = lines.sparkSession
    placed = lines.select("job_id", "seq", "line", "received_at").filter(F.col("job_id").isNotNull() & F.col("seq").isNotNull())
    shared = share(spark, mine_templates(cut(count_heads(placed)), support))
    schema = pa.schema([pa.field(n, {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in _ENTRY.split(", "))])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(shared(), with_message)
        here = None
        for b in it:
            for job, chunk, seq, line in zip(*[c.to_numpy().tolist() for c in b.columns[:3]], b.column(3).to_pylist()):
                if here != (job, chunk):
                    reader.finish()
                    here = (job, chunk)
                    reader.begin(job, chunk)
                reader.line(seq, line)
            if reader.rows:
                yield batch_of(reader.rows)
                reader.rows = []
        reader.finish()
        if reader.rows:
            yield batch_of(reader.rows)

    chunked = placed.withColumn("chunk", F.floor(F.col("seq") / chunk_lines).cast("bigint"))
    ordered = chunked.repartition("job_id", "chunk").sortWithinPartitions("job_id", "chunk", "seq", "received_at", "line")
    rows = cut(ordered.select("job_id", "chunk", "seq", "line").mapInArrow(read, _ENTRY))

    # one row per chunk: which head the lines before its first head belong to
    lead = rows.filter(F.col("kind") == "lead")
    if with_message:
        after = rows.filter(F.col("kind") == "after").select("job_id", "chunk", F.col("rest").alias("after"))
        lead = lead.join(after, ["job_id", "chunk"], "left")
    else:
        lead = lead.withColumn("after", F.lit(None).cast("string"))
    by_chunk = W.partitionBy("job_id").orderBy("chunk")
    owner = F.last(F.when(F.col("has_head"), F.col("chunk")), ignorenulls=True).over(by_chunk.rowsBetween(W.unboundedPreceding, -1))
    lead = lead.withColumn("owner", owner).filter(F.col("owner").isNotNull())
    earlier = W.partitionBy("job_id", "owner").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    lead = lead.withColumn("over", F.coalesce(F.max("closed").over(earlier), F.lit(False)))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & ~F.col("over"), F.col("chunk"))).alias(f"l_{c}")
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", c.alias("x")))), lambda s: s["x"]), "\n")
    nothing = F.lit(None).cast("string")
    beyond = F.when(F.col("over"), F.col("rest")).when(F.col("closed"), F.col("after"))
    texts = {"l_rest": F.when(F.count("rest") > 0, text(F.col("rest"))), "l_beyond": F.when(F.count(beyond) > 0, text(beyond))} if with_message else {"l_rest": nothing, "l_beyond": nothing}
    tails = lead.groupBy("job_id", F.col("owner").alias("chunk")).agg(F.max("last_seq").alias("l_last"), *[first(c) for c in ("ts", "level", "component", "message")], *[v.alias(k) for k, v in texts.items()])
    message = lambda *parts: F.concat_ws("\n", F.coalesce(parts[0], F.lit("")), *parts[1:]).alias("message")
    out = rows.filter(F.col("kind") == "entry").select("job_id", "first_seq", "last_seq", "ts", "part", "level", "component", message(F.col("message"), F.col("rest")))
    last = rows.filter(F.col("kind").isin("last", "open")).join(tails, ["job_id", "chunk"], "left")
    goes_on = F.col("kind") == "open"
    filled = lambda c: F.when(goes_on, F.coalesce(c, f"l_{c}")).otherwise(F.col(c))
    last = last.select(
        "job_id", "first_seq", F.coalesce("l_last", "last_seq").alias("last_seq"), filled("ts").alias("ts"), "part", filled("level").alias("level"), filled("component").alias("component"),
        message(filled("message"), F.col("rest"), F.when(goes_on, F.col("l_beyond")).otherwise(F.col("l_rest"))),
    )
    entries = out.unionByName(last)

    # heads without a year
    dated = entries.filter(F.col("part").isNull()).withColumn("ts_ms", F.coalesce("ts", F.lit(-1).cast("bigint")))
    begun = jobs.select(F.col("id").alias("job_id"), F.coalesce("started", "ended").alias("begun")).groupBy("job_id").agg(F.min("begun").alias("begun"))
    undated = entries.filter(F.col("part").isNotNull()).join(begun, "job_id", "left")
    arrived = placed.groupBy("job_id").agg(F.min("received_at").alias("arrived"))
    lacking = undated.filter(F.col("begun").isNull()).drop("begun").join(arrived, "job_id", "left").withColumnRenamed("arrived", "begun")
    undated = undated.filter(F.col("begun").isNotNull()).unionByName(lacking)
    month_day, ms = F.floor(F.col("part") / 100_000_000).cast("int"), F.col("part") % 100_000_000
    day = F.date_add(F.make_date(F.year("begun"), F.floor(month_day / 100).cast("int"), F.lit(1)), month_day % 100 - 1)
    undated = undated.withColumn("ts_ms", F.coalesce(F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000 + ms, F.lit(-1))).drop("begun")
    columns = ["job_id", "first_seq", "last_seq", "ts_ms", F.coalesce("level", F.lit("NONE")).alias("level"), F.coalesce("component", F.lit("")).alias("component")]
    return dated.unionByName(undated).select(*columns, *["message"] * with_message)
