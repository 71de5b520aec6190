"""Chinese numerals in transcripts: to digits, and long digit runs to readable ones.

Callbacks on matches can't be said in SQL, so this is one Arrow-batched pandas UDF, `normalised`, over plain functions.
Behaviour is that of common transcript tools, oddities included: a numeral right after 几, 数, 上 or 好几 is left
alone; a zero before a unit counts as one; a run of digits beside any letter, CJK ones included, isn't made readable.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits, units, words that make a numeral vague, and units that keep digits as they are.
DIGITS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "幺": 1, "两": 2}
UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10_000, "亿": 100_000_000}
VAGUE = ("好几", "几", "数", "上")
KEEP = "年号期章节楼层室届任季度版页页码秒分时第"

_digit, _unit = "".join(DIGITS), "".join(UNITS)
NUMERAL = re.compile(f"[{_digit}]?(?:[{_unit}][{_digit}]?)+")
RUN = re.compile(f"[{_digit}]{{2,}}")
LONG = re.compile(r"\d{5,}")
TENS = re.compile(f"([{_digit}]?)([十百千])")
SECTION = re.compile(f"(?P<tens>(?:[{_digit}]?[十百千])*)(?P<ones>[{_digit}]?)(?P<large>[万亿]?)")

# Numbers that were a unit's word, with what they become again.
WORDS_AGAIN = (
    (r"(\d+(?:\.\d+)?)\s*多\s*10000(?!\d)", r"\1多万"),
    (r"(\d+(?:\.\d+)?)\s*多\s*100000000(?!\d)", r"\1多亿"),
    (r"(?<![\d.])10000(?![\d.])", "万"),
    (r"(?<![\d.])100000000(?![\d.])", "亿"),
)


def value(numeral: str) -> int | None:
    """Value of a numeral with units, section by section (a section ends at 万 or 亿); None if it has no digit, or a
    large unit comes before anything was said.  In a section that 万 or 亿 ends, nothing before it counts as one, even after tens."""
    first = next((i for i, c in enumerate(numeral) if c in DIGITS), None)
    if first is None:
        return None
    out = 0
    for m in SECTION.finditer(numeral):
        tens = sum(max(DIGITS.get(d, 0), 1) * UNITS[u] for d, u in TENS.findall(m["tens"]))
        ones = DIGITS.get(m["ones"], 0)
        if not m["large"]:
            out += tens + ones
        elif tens or first < m.end():
            out += (tens + max(ones, 1)) * UNITS[m["large"]]
        else:
            return None
    return out


#: Patterns of numerals and how what they match is read, in this order.
READINGS = (
    (NUMERAL, lambda s: "" if (n := value(s)) is None else str(n)),
    (RUN, lambda s: "".join(str(DIGITS[c]) for c in s)),
)


def to_digits(text: str) -> str:
    """Numerals with units, then runs of two or more digits read one by one; not after a vague word."""
    for pattern, read in READINGS:
        text = pattern.sub(lambda m, read=read: m[0] if m.string.endswith(VAGUE, 0, m.start()) else read(m[0]) or m[0], text)
    return text


def readable(text: str) -> str:
    """Bare numbers from 10000 on as 万 or 亿, with one decimal where needed."""

    def long(m):
        before, after = text[: m.start()], text[m.end() :]
        beside = [x for x in (before[-1:], after[:1]) if x]
        if any(x.isalnum() or x == "." for x in beside) or (after and after[0] in KEEP) or before.endswith((*VAGUE, "多")):
            return m[0]
        n = int(m[0])
        for size, name in ((UNITS["亿"], "亿"), (UNITS["万"], "万")):
            if n >= size:
                return f"{n // size}{name}" if n % size == 0 else f"{n / size:.1f}{name}"
        return m[0]

    return LONG.sub(long, text)


def mended(text: str) -> str:
    """A unit that was spelt out where it belongs to the number before, or stands alone, is a word again."""
    for pattern, word in WORDS_AGAIN:
        text = re.sub(pattern, word, text)
    return text


def normalise(text: str | None, mend: bool = True) -> str | None:
    if text is None:
        return None
    text = readable(to_digits(text))
    return mended(text) if mend else text


def normalised(x: str | Column, mend: bool = True) -> Column:
    """As `normalise`, for a column; texts without digits of either kind pass through in the JVM."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda t: normalise(t, mend))

    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.rlike(f"[{_digit}{_unit}]|\\d{{5}}"), f(c)).otherwise(c)
