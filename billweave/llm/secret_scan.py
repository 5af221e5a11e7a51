"""Secrets in texts.

Method: an Aho-Corasick automaton finds keywords; only at a hit is the regular expression of that
kind tried, anchored there; spans with an embedded checksum count only if it is right. Where digits or
capitals follow a number, every end that it can have is tested, and the first that is right counts.

Kinds, in this order where two start at the same place:
  assign  a name such as `password` or `api_key`, `:` or `=`, and a value of six characters or more
  access  AKIA and letters, 20 characters or more in all
  hex     24 lower-case hex digits or more; any four hex digits count as its keyword
  forge   tokens that start with ghp_, gho_, ghu_, ghs_, ghr_ or npm_; the last six letters are the
          CRC-32 of the rest in base 62
  iban    `IBAN` and an account number that leaves 1 in the test modulo 97; the length of its country
          first, whatever follows, then from the longest that no letter or digit follows
  card    `card` or `visa` and a number of 13 to 19 digits that passes the Luhn test; from the longest
          that no digit follows
Within one kind, spans are leftmost and do not overlap; spans of different kinds may.

Null text counts as empty and has no spans. Texts are scanned whole. Repeated rows get equal
results; all columns stay, and one called like the new one is replaced. Nothing is shuffled.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billweave.llm.rows import with_arrow

#: The kinds that every scan has.
BASE = ("assign", "access", "hex")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()),
                                  T.StructField("start", T.IntegerType()),
                                  T.StructField("end", T.IntegerType())]))
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS, ALNUM = frozenset(DIGITS62[:10]), frozenset(DIGITS62)

#: Characters of an account number by country.
IBAN_LENGTHS = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU"}.items() for country in countries.split()}


def base62(number: int, width: int) -> str:
    out = ""
    for _ in range(width):
        number, digit = divmod(number, 62)
        out = DIGITS62[digit] + out
    return out


def right_crc(found: re.Match) -> bool:
    return base62(zlib.crc32(found[1][:-6].encode()), 6) == found[1][-6:]


def right_luhn(found: re.Match) -> bool:
    digits = [int(d) for d in re.sub(r"\D", "", found[1])][::-1]
    doubled = sum(sum(divmod(2 * d, 10)) for d in digits[1::2])
    return 13 <= len(digits) <= 19 and (sum(digits[::2]) + doubled) % 10 == 0


def right_mod97(found: re.Match) -> bool:
    code = found[1].replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def card_ends(found: re.Match) -> Iterator[int]:
    text, end = found.string, found.end()
    for at in range(end, found.start(1), -1):
        if text[at - 1] in DIGITS and text[at:at + 1] not in DIGITS:
            yield at


def iban_ends(found: re.Match) -> Iterator[int]:
    text, start = found.string, found.start(1)
    places = [at + 1 for at in range(start, found.end()) if text[at] != " "]
    size = IBAN_LENGTHS.get(found[1][:2], 0)
    if 0 < size <= len(places):
        yield places[size - 1]
    yield from (at for at in reversed(places) if text[at:at + 1] not in ALNUM)


@dataclass(frozen=True)
class Kind:
    name: str
    keywords: tuple[str, ...]  # in lower case
    pattern: str
    holds: object              # of a match: whether it counts
    any_case: bool = False     # of the pattern
    #: of a match: the ends to test; the first of them that counts is the span's
    ends: object = lambda found: (found.end(),)


def hex_keywords() -> tuple[str, ...]:
    return tuple(map("".join, itertools.product("0123456789abcdef", repeat=4)))


KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "api_key", "apikey"), ASSIGN,
         lambda m: len(m[2]) >= 6, any_case=True),
    Kind("access", ("akia",), ACCESS, lambda m: len(m[0]) >= 20),
    Kind("hex", hex_keywords(), HEX, lambda m: len(m[0]) >= 24),
    Kind("forge", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
         r"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])", right_crc),
    Kind("iban", ("iban",), r"IBAN[:\x20]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})",
         right_mod97, ends=iban_ends),
    Kind("card", ("card", "visa"), r"(?:card|visa)[^0-9\n]{0,20}([0-9](?:[\x20-]?[0-9]){12,18})",
         right_luhn, any_case=True, ends=card_ends),
)


class Scanner:
    def __init__(self, kinds: tuple[Kind, ...] = KINDS) -> None:
        self.names = [k.name for k in kinds]
        # ASCII case only; the patterns hold nothing that re.ASCII changes otherwise
        self.rules = [(re.compile(k.pattern, re.ASCII | re.IGNORECASE * k.any_case).match, k.holds, k.ends)
                      for k in kinds]
        held: dict[str, list[tuple[int, int]]] = {}
        for n, kind in enumerate(kinds):
            for word in kind.keywords:
                held.setdefault(word, []).append((n, len(word) - 1))
        self.automaton = ahocorasick.Automaton()
        for word, owners in held.items():
            self.automaton.add_word(word, owners)
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start and kind."""
        lower = text.encode(errors="surrogatepass").lower().decode(errors="surrogatepass")
        done, tried = [0] * len(self.names), [-1] * len(self.names)
        found = []
        for last, owners in self.automaton.iter(lower):
            for n, back in owners:
                at = last - back
                if at < done[n] or at == tried[n]:
                    continue
                match, holds, ends = self.rules[n]
                tried[n] = at
                if m := match(text, at):
                    cuts = (m if end == m.end() else match(text, at, end) for end in ends(m))
                    if cut := next((c for c in cuts if c and holds(c)), None):
                        found.append((at, n, cut.end()))
                        done[n] = cut.end()
                    elif n < len(BASE):
                        done[n] = m.end()  # a failing match of these kinds still takes its place
        found.sort()
        return [(self.names[n], at, end) for at, n, end in found]


def scan(df: DataFrame, text: str = "text", spans: str = "secrets",
         kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """`df` with an array of (kind, start, end), in code points, end exclusive."""

    def start():
        scanner = Scanner(kinds)
        return lambda texts: [[[dict(zip(("kind", "start", "end"), s)) for s in scanner.spans(t or "")]
                               for t in texts]]

    return with_arrow(df, [text], [T.StructField(spans, SPANS)], start)


def redact(df: DataFrame, text: str = "text", spans: str = "secrets", mask: str = "[SECRET]") -> DataFrame:
    """`df` with the spans in `text` replaced by `mask`; overlapping ones by one. Null stays null."""

    def start():
        return lambda texts, found: [[t and masked(t, s or [], mask)
                                      for t, s in zip(texts, found, strict=True)]]

    out = with_arrow(df, [text, spans], [T.StructField(text, T.StringType())], start)
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def masked(text: str, spans: list[dict], mask: str) -> str:
    out, at = [], 0
    for span in sorted(spans, key=lambda s: s["start"]):
        if span["start"] >= at:
            out += [text[at:span["start"]], mask]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
