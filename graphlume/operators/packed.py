"""Several values packed in one field: dialect choice by minimum description length.

Every field is parsed under each dialect (delimiters x quoting x wrapping) that its
characters allow. A parse costs the code lengths of its values, the choice of each
delimiter and the choice of the dialect, in bits; the field is split by its cheapest
parse. Value codes come from counts over all fields of the table: values with at
least ``min_share`` of all occurrences have a code of their own (so the code book
never has more than ``1 / min_share`` entries, whatever the size of the table), all
others are spelled with the character codes of the same table.

The first codes count what lies between any two marks or within quotes, whatever the
dialect; each round then counts the values of the cheapest parses. Equal texts are parsed
once, with their number. A parse is left as soon as its bits exceed the best one's.

Defined results: a null, empty or blank text gives no row; an empty entry gives a row
with an empty value that keeps its position; a delimiter after the last value adds
nothing; an opening or closing bracket may be missing or of another kind. Columns
beside the key and the text are ignored. With ``integers``, values that are integers
come out in one notation (``+1``, ``1.0`` and ``1`` are ``1``); without, values are
left as they are but for surrounding blanks and quoting.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlume.session import cut, drop

DELIMITERS = {
    "comma": ",", "semicolon": ";", "bar": "|", "slash": "/", "tab": "\t", "colon": ":", "ampersand": "&", "tilde": "~", "caret": "^",
    "blank": None, "dash": None, "mixed": ",;|/\t",
}
QUOTINGS = {"none": "", "double": '"', "either": "\"'"}
OPEN, CLOSE = "[({<", "])}>"
#: Flush a partial count when it holds this many entries.
FLUSH = 100_000
#: A longer value is always spelled, so that the code book's bytes are bounded too.
LONGEST_CODED = 200
#: Results a task keeps for texts it meets again, and the longest such text.
REMEMBERED, LONGEST_REMEMBERED = 20_000, 2_000

_MINUS = str.maketrans({"−": "-", "–": "-", "﹣": "-", "－": "-"})
_INTEGER = re.compile(r"[+-]?\d+(?:\.0+)?")


@lru_cache(maxsize=65_536)
def canonical(value: str) -> str:
    """Integers in one notation, everything else without surrounding blanks."""
    value = value.strip()
    if value and len(value) < 20 and (value[0] in "+-−–﹣－" or value[0].isdigit()):
        plain = value.translate(_MINUS)
        if _INTEGER.fullmatch(plain):
            return str(int(plain.split(".")[0]))
    return value


@dataclass(frozen=True)
class Dialect:
    delimiter: str
    quoting: str
    backslash: bool = False
    wrapped: bool = False

    @property
    def name(self) -> str:
        return f"{self.delimiter}/{self.quoting}{'/backslash' if self.backslash else ''}{'/wrapped' if self.wrapped else ''}"


@dataclass
class Parse:
    dialect: Dialect
    values: list[tuple[str, str]]  # (side, value)
    loose: str = ""  # text that no rule of the dialect explains
    bits: float = 0.0


def _delimiters(text: str, sections: bool) -> list[str]:
    """The dialects' delimiters that can explain this text."""
    found = [name for name, marks in DELIMITERS.items() if marks and name != "mixed" and marks in text and not (sections and name == "colon")]
    if sum(DELIMITERS[name] in DELIMITERS["mixed"] for name in found) > 1:
        found.append("mixed")
    if sections:
        if re.search(r"\n\s*-\s", text):
            found.append("dash")
    elif re.search(r"\S\s+\S", text):
        found.append("blank")
    return found or ["comma"]


#: A quote where a value can begin; elsewhere it is a sign like any other.
_BEGINS = {mark: re.compile(rf"(?:^|[^\w\"'\\]){mark}") for mark in "\"'"}


def _quotings(text: str) -> list[tuple[str, bool]]:
    """The quotings that can make a difference for this text."""
    double, single = ('"' in text and bool(_BEGINS['"'].search(text))), ("'" in text and bool(_BEGINS["'"].search(text)))
    found = [("none", False)]
    found += [("double", False)] * double + [("either", False)] * single
    if "\\" in text or text[:1] == "{" and ('""' in text or "''" in text):
        found += [("double", True)] * double + [("either", True)] * single
    return found


_QUOTED = {
    ('"', False): re.compile(r'"((?:[^"]|"")*)"'), ("'", False): re.compile(r"'((?:[^']|'')*)'"),
    ('"', True): re.compile(r'"((?:[^"\\]|\\.)*)"', re.S), ("'", True): re.compile(r"'((?:[^'\\]|\\.)*)'", re.S),
}


def _unquote(body: str, mark: str, backslash: bool) -> str:
    if backslash:
        return re.sub(r"\\(.)", r"\1", body, flags=re.S) if "\\" in body else body
    return body.replace(mark * 2, mark)


def _split(text: str, separator: re.Pattern, quotes: str, backslash: bool) -> tuple[list[str], str]:
    """Values between separators; a quote counts only where a value begins. Second: unexplained text."""
    if not quotes or not any(q in text for q in quotes):
        return separator.split(text), ""
    values, loose, at, end = [], [], 0, len(text)
    while True:
        while at < end and text[at] in " \n\r" or at < end and text[at] == "\t" and not separator.match(text, at):
            at += 1
        quoted = _QUOTED[text[at], backslash].match(text, at) if at < end and text[at] in quotes else None
        if quoted:
            values.append(_unquote(quoted[1], text[at], backslash))
            at = quoted.end()
            m = separator.search(text, at)
            stop = m.start() if m else end
            loose.append(text[at:stop].strip())
        else:
            m = separator.search(text, at)
            stop = m.start() if m else end
            values.append(text[at:stop])
        if not m:
            return values, "".join(loose)
        at = m.end()


_SEPARATORS = {name: re.compile("[" + re.escape(marks) + "]") for name, marks in DELIMITERS.items() if marks}
_SEPARATORS["blank"] = re.compile(r"\s+")
_SEPARATORS["dash"] = re.compile(r"\n\s*-\s+")


def _unwrap(text: str) -> str:
    """Without a last delimiter, quotes around the whole and one pair of brackets, of which either may be missing."""
    text = _unended(text)
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" and text.count(text[0]) == 2:
        text = text[1:-1].strip()
    if text[:1] and text[0] in OPEN:
        text = text[1:]
    if text[-1:] and text[-1] in CLOSE:
        text = text[:-1]
    return _unended(text.strip())


def _unended(text: str) -> str:
    return text[:-1].rstrip() if text[-1:] and text[-1] in DELIMITERS["mixed"] else text


def _entries(values: list[str], side: str, integers: bool) -> list[tuple[str, str]]:
    values = [canonical(v) for v in values] if integers else [v.strip() for v in values]
    if values and not values[-1]:
        values.pop()
    return [(side, v) for v in values]


def _flat(text: str, integers: bool) -> Iterator[Parse]:
    inner, text = _unwrap(text), _unended(text)
    for wrapped, body in [(False, text)] + [(True, inner)] * (inner != text):
        for delimiter in _delimiters(body, False):
            for quoting, backslash in _quotings(body):
                values, loose = _split(body, _SEPARATORS[delimiter], QUOTINGS[quoting], backslash)
                yield Parse(Dialect(delimiter, quoting, backslash, wrapped), _entries(values, "", integers), loose)


class Sections:
    """Patterns for texts in which named sides each hold a list."""

    def __init__(self, names: Iterable[str]):
        word = "|".join(map(re.escape, names))
        self.mark = re.compile(rf"(?:^|[\s{{\[(;,\]}})])[\"']?(?:{word})[\"']?\s*[:=,]", re.I)
        mark = rf"[\"']?(?:{word})[\"']?\s*[:=,]"
        self.start = re.compile(rf"[\s{{\[(;,\]}})]*[\"']?({word})[\"']?\s*[:=,][ \t]*", re.I)
        self.stop = re.compile(rf"[;,\s]\s*(?={mark})", re.I)
        self.ends = {name: re.compile(f"(?P<stop>{self.stop.pattern})|(?P<next>{p.pattern})", re.I) for name, p in _SEPARATORS.items()}
        self.closes = {name: re.compile(rf"(?P<stop>\]|{self.stop.pattern})|(?P<next>{p.pattern})", re.I) for name, p in _SEPARATORS.items()}

    def parse(self, text: str, d: Dialect, codes: Codes | None = None, bound: float = math.inf, integers: bool = False) -> Parse | None:
        """None if no section is found, or as soon as the values' bits exceed ``bound``."""
        out, loose, at, quotes = [], [], 0, QUOTINGS[d.quoting]
        bits = codes.dialect(d) if codes else 0.0
        while m := self.start.match(text, at):
            side, at = m[1].lower(), m.end()
            bracket = text[at : at + 1] == "["
            if bracket:
                at += 1
            elif d.delimiter == "dash" and (m := _SEPARATORS["dash"].match(text, at)):
                at = m.end()
            ends, values = (self.closes if bracket else self.ends)[d.delimiter], []
            while True:
                while text[at : at + 1] == " ":
                    at += 1
                q = text[at : at + 1]
                quoted = _QUOTED[q, d.backslash].match(text, at) if q and q in quotes else None
                start = quoted.end() if quoted else at
                m = ends.search(text, start)
                stop = m.start() if m else len(text)
                if quoted:
                    values.append(_unquote(quoted[1], q, d.backslash))
                    loose.append(text[start:stop].strip(" \t\r\n}"))
                else:
                    values.append(text[at:stop].rstrip(" \t\r\n}") if not m else text[at:stop])
                at = m.end() if m else len(text)
                if codes and values[-1]:
                    bits += codes.value(canonical(values[-1]) if integers else values[-1].strip()) if values[-1].strip() else 0.0
                    if bits > bound:
                        return None
                if not m or m.lastgroup == "stop" or m["stop"]:
                    break
            out += _entries(values, side, integers)
        rest = text[at:].strip(" \t\r\n}])")
        return Parse(d, out, "".join(loose) + rest)


#: Bits to choose one of a dialect's delimiters.
_CHOICE = {name: math.log2(len(marks)) if marks else 0.0 for name, marks in DELIMITERS.items()}


class _CharBits(dict):
    """Bits by character; 20 for one too rare to be counted."""

    def __missing__(self, key: str) -> float:
        return 20.0


@dataclass(frozen=True)
class Codes:
    """Code lengths in bits: of values, of characters, of a spelled value's announcement, of dialects."""

    values: dict[str, float]
    chars: _CharBits
    spell: float
    dialects: dict[str, float]
    new_dialect: float = 20.0

    def spelled(self, value: str) -> float:
        return self.spell + self.chars["\0"] + sum(map(self.chars.__getitem__, value))

    def value(self, value: str) -> float:
        code = self.values.get(value)
        return self.spelled(value) if code is None else code

    def dialect(self, d: Dialect) -> float:
        return self.dialects.get(d.name, self.new_dialect)

    def cost(self, parse: Parse, bound: float = math.inf) -> float:
        """Bits of a parse; infinite as soon as they exceed ``bound``."""
        bits = self.dialect(parse.dialect) + len(parse.values) * _CHOICE[parse.dialect.delimiter]
        for _, v in parse.values:
            bits += self.value(v)
            if bits > bound:
                return math.inf
        return bits + (self.spelled(parse.loose) if parse.loose else 0)


def cheapest(text: str, sections: Sections | None, codes: Codes, integers: bool) -> Parse | None:
    """Ties go to the dialect tried first; dialects with a short code are tried first, so that others are left early."""
    best, bound = None, math.inf
    if sections is None:
        for parse in _flat(text, integers):
            parse.bits = codes.cost(parse, bound)
            if best is None or parse.bits < bound:
                best, bound = parse, parse.bits
        return best
    dialects = [Dialect(delimiter, quoting, backslash) for delimiter in _delimiters(text, True) for quoting, backslash in _quotings(text)]
    for d in sorted(dialects, key=codes.dialect):
        parse = sections.parse(text, d, codes, bound, integers)
        if parse:
            parse.bits = codes.cost(parse, bound)
            if best is None or parse.bits < bound:
                best, bound = parse, parse.bits
    return best


_TOKEN = re.compile(r"""[ \r\[({<]*(?:"((?:[^"\\]|\\.|"")*)"|'((?:[^'\\]|\\.|'')*)')|([^,;|/\t\n:&~^]+)""")


def _tokens(text: str, sections: Sections | None, integers: bool) -> list[str]:
    """What lies between marks or within quotes, whatever the dialect."""
    found = []
    for double, single, bare in _TOKEN.findall(sections.mark.sub("\n", text) if sections else text):
        token = (double or single or bare).strip()
        if token and token[0] in OPEN and CLOSE[OPEN.index(token[0])] not in token:
            token = token[1:].strip()
        if token and token[-1] in CLOSE and OPEN[CLOSE.index(token[-1])] not in token:
            token = token[:-1].strip()
        if token:
            found += [token] if sections else token.split()
    return [canonical(t) for t in found] if integers else found


def _counter(sections: Sections | None, codes: Codes | None, integers: bool):
    """Partial counts of values, characters of values and dialects."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[str, str], float] = defaultdict(float)
        chars: dict[float, Counter] = defaultdict(Counter)

        def flush() -> pd.DataFrame:
            for weight, seen in chars.items():
                for c, n in seen.items():
                    found["char", c] += weight * n
            chars.clear()
            frame = pd.DataFrame([(k, v, w) for (k, v), w in found.items()], columns=["kind", "value", "weight"])
            found.clear()
            return frame

        for batch in batches:
            for text, n in zip(batch["text"], batch["n"].to_numpy(dtype=float)):
                if codes is None:
                    values = _tokens(text, sections, integers)
                elif parse := cheapest(text, sections, codes, integers):
                    found["dialect", parse.dialect.name] += n
                    values = [v for _, v in parse.values]
                else:
                    continue
                found["all", ""] += n * len(values)
                for value in values:
                    if len(value) <= LONGEST_CODED:
                        found["value", value] += n
                chars[n].update("\0".join(values) + "\0")
                if len(found) > FLUSH or len(chars) > 1000:
                    yield flush()
        if found or chars:
            yield flush()

    return count


def learn_codes(texts: DataFrame, sections: Sections | None, rounds: int = 1, min_share: float = 1e-4, integers: bool = False) -> Codes:
    """Code lengths from counts over all texts (columns ``text``, no nulls, and ``n``, how often)."""
    codes = None
    for _ in range(rounds + 1):
        counts = texts.mapInPandas(_counter(sections, codes, integers), "kind string, value string, weight double")
        counts = cut(counts.groupBy("kind", "value").agg(F.sum("weight").alias("weight")))
        total = {r["kind"]: r["weight"] for r in counts.groupBy("kind").agg(F.sum("weight").alias("weight")).collect()}
        floor = F.when(F.col("kind") == "value", F.lit(min_share * total.get("all", 0.0))).otherwise(F.lit(min_share / 10) * F.when(F.col("kind") == "char", total.get("char", 0.0)).otherwise(0.0))
        kept: dict[str, dict[str, float]] = defaultdict(dict)
        for r in counts.where(F.col("weight") >= floor).collect():  # at most 1 / min_share values, 10 / min_share characters and the dialects
            kept[r["kind"]][r["value"]] = r["weight"]
        drop(counts)
        # a value's code is its share, and each use of it bears its part of writing the code book's entry, the value
        # spelled once; it is coded only where that is shorter than spelling it every time. The announcement of a
        # spelled value gets the share that coded values leave, so both are settled in turn.
        every = max(total.get("all", 0.0), 1.0)
        chars = _CharBits({c: -math.log2(w / total["char"]) for c, w in kept["char"].items()})
        coded, spell, values = kept["value"], every / 2, {}
        for _ in range(3):
            draft = Codes({}, chars, -math.log2(spell / every), {})
            costs = {v: -math.log2(w / every) + draft.spelled(v) / max(w, 1.0) for v, w in coded.items()}
            values = {v: b for v, b in costs.items() if b < draft.spelled(v)}
            spell = max(every - sum(coded[v] for v in values), every * min_share)
        draft = Codes({}, chars, -math.log2(min(spell, every) / every), {})
        fields = total.get("dialect", 0.0) + 1.0
        dialects = {d: -math.log2(min(w, fields - 0.5) / fields) for d, w in kept["dialect"].items()}
        codes = Codes(values, chars, draft.spell, dialects, math.log2(fields))
    return codes


def split_packed(df: DataFrame, key: str, text: str, sections: Iterable[str] = (), rounds: int = 1, min_share: float = 1e-4, integers: bool = False) -> DataFrame:
    """One row per entry: ``row_key, side, pos, val, dialect, bits`` (``side`` is '' without sections).

    ``key`` is a LONG and identifies a row; rows with the same key count once.
    ``sections`` are the names under which a text groups its entries, in any case.
    """
    rules = Sections(sections) if sections else None
    rows = df.select(F.col(key).cast("long").alias("row_key"), F.trim(F.col(text)).alias("text"))
    rows = cut(rows.where(F.col("text").isNotNull() & F.col("text").rlike(r"\S")).dropDuplicates(["row_key"]))  # read by each round
    texts = cut(rows.groupBy("text").agg(F.count("*").alias("n")))
    codes = learn_codes(texts, rules, rounds, min_share, integers)
    drop(texts)
    columns = ["row_key", "side", "pos", "val", "dialect", "bits"]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[tuple]] = {}
        for batch in batches:
            out = []
            for row_key, body in zip(batch["row_key"], batch["text"]):
                entries = known.get(body)
                if entries is None:
                    best = cheapest(body, rules, codes, integers)
                    pos: dict[str, int] = defaultdict(int)
                    entries = []
                    for side, value in best.values if best else ():
                        pos[side] += 1
                        entries.append((side, pos[side], value, best.dialect.name, best.bits))
                    if len(body) <= LONGEST_REMEMBERED:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[body] = entries
                out += [(row_key, *e) for e in entries]
                if len(out) > FLUSH:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(split, "row_key long, side string, pos int, val string, dialect string, bits double")
