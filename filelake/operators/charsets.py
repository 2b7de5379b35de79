"""Which code page bytes are in that are neither marked nor UTF-8: pair models of what each page makes of them.

Every candidate page decodes the first 64 KiB, and the characters get the log likelihood of their
script: how common a letter is, and how well a kind of character follows the kind before it (words keep to one
script and one case, symbols and unused codes are rare inside them). Only bytes above 7F count, as all pages agree on the
others. The best page wins if its likelihood per byte is one that text has; what no page makes text of stays without a label.
So do bytes that are UTF-8 behind a binary head.
"""

from __future__ import annotations

import codecs
import re
from functools import cache

import numpy as np
import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes given to the models.
SAMPLE = 64 << 10
#: Least mean log likelihood of a byte above 7F that passes for text, and least number of such bytes.
FLOOR, EVIDENCE = -4.9, 4
#: Well-formed UTF-8 outside ASCII, and the share of the bytes above 7F that such a run must hold behind the last byte that is in none.
UTF8 = re.compile(
    rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)
MOSTLY = 0.75
#: Letters of ASCII, a byte above 7F between ASCII ones, and what it is worth in a comparison that words are Latin with an accent here and there.
LETTERS = bytes([*range(65, 91), *range(97, 123)])
LONE, LATIN = re.compile(rb"(?<![\x80-\xff])[\x80-\xff](?![\x80-\xff])"), 1.0

# Letters of the scripts in the order of how common they are, in per mille of the letters.
CYRILLIC = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", [110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 1, 1], strict=True))
#: In per mille of the letters outside ASCII, over the languages of Western Europe.
WESTERN = dict(zip("éàèêçôîâùûëïœáíóúñüöäßåæøãõìòý", [190, 70, 60, 40, 30, 20, 15, 15, 15, 10, 10, 8, 3, 60, 60, 65, 25, 40, 75, 60, 70, 30, 15, 5, 5, 25, 8, 6, 6, 3], strict=True))
#: Quotes, dashes and marks that texts hold, per mille each.
MARKS = "«»„“”‘’–—…№§°€¿¡¤"

BLANK, SIGN, LOWER, UPPER, OWN_LOWER, OWN_UPPER, KANA, KANJI, HALF, MARK, OTHER, BROKEN = range(12)
#: Codecs of the labels, and the letters that count as their own script.
PAGES = {
    "windows-1251": ("cp1251", CYRILLIC), "ibm866": ("cp866", CYRILLIC), "koi8-r": ("koi8_r", CYRILLIC), "shift_jis": ("cp932", None), "windows-1252": ("cp1252", WESTERN),
}


@cache
def _kinds(label: str) -> tuple[np.ndarray, np.ndarray]:
    """Kind and log likelihood of every character of the basic plane under a page."""
    letters = PAGES[label][1]
    kind, log = np.full(1 << 16, OTHER, np.int8), np.full(1 << 16, -7.5, np.float32)
    kind[:128], log[:128] = SIGN, 0
    kind[[*range(0x21), 0x7F]] = BLANK
    kind[97:123], kind[65:91] = LOWER, UPPER
    for c in MARKS:
        kind[ord(c)], log[ord(c)] = MARK, -4.5
    kind[0xA0], log[0xA0] = BLANK, -4.0
    if letters is not None:
        # letters of the Latin page go on from ASCII ones; a Cyrillic word has only its own
        western = letters is WESTERN
        for c, share in letters.items():
            for form, cased in ((c, LOWER if western else OWN_LOWER), (c.upper(), UPPER if western else OWN_UPPER)):
                if len(form) == 1 and (cased in (LOWER, OWN_LOWER) or form != c):
                    kind[ord(form)], log[ord(form)] = cased, np.log(share / 1000) - (0.3 if western and cased == UPPER else 0.0)
    else:
        kind[0x3041:0x30FF], log[0x3041:0x30FF] = KANA, np.log(1 / 90)
        kind[0x3001:0x3003], log[0x3001:0x3003] = KANA, np.log(1 / 40)
        kind[0x4E00:0xA000], log[0x4E00:0xA000] = KANJI, np.log(1 / 1500)
        kind[0xFF61:0xFFA0] = HALF
        kind[0xFF01:0xFF61], log[0xFF01:0xFF61] = MARK, -5.0
    kind[0x80:0xA0] = kind[0xFFFD] = BROKEN
    log[0x80:0xA0] = log[0xFFFD] = -12.0
    return kind, log


@cache
def _follow() -> np.ndarray:
    """Log likelihood of a kind after a kind, 0 where nothing speaks against it."""
    t = np.zeros((12, 12), np.float32)
    t[LOWER, UPPER] = t[OWN_LOWER, OWN_UPPER] = -5.0  # a capital inside a word
    t[OWN_UPPER, OWN_UPPER] = t[UPPER, UPPER] = -0.1
    for gap in (BLANK, SIGN, MARK):
        t[gap, OWN_UPPER] = -0.8
    for a in (LOWER, UPPER):
        for b in (OWN_LOWER, OWN_UPPER):
            t[a, b] = t[b, a] = -5.0  # two scripts in a word
    for a in (LOWER, UPPER, OWN_LOWER, OWN_UPPER, KANA, KANJI):
        t[a, OTHER] = t[OTHER, a] = -2.0
    t[HALF, [KANA, KANJI]] = t[[KANA, KANJI], HALF] = -3.0
    return t


def _high(data: bytes) -> int:
    """Bytes above 7F."""
    return len(data.translate(None, bytes(range(128))))


def scores(data: bytes) -> dict[str, float]:
    """Mean log likelihood of a byte above 7F under each page."""
    sample = data[:SAMPLE]
    high = _high(sample)
    out = {}
    for label, (codec, _) in PAGES.items():
        # the sample may cut a character
        text = codecs.getincrementaldecoder(codec)("replace").decode(sample, False)
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        codes = np.where(codes < 1 << 16, codes, 0xFFFD)
        kind, log = _kinds(label)
        kinds = np.r_[np.int8(BLANK), kind[codes]]
        steps = _follow()[kinds[:-1], kinds[1:]]
        # a step counts where it leads to or from a character that is not ASCII
        outer = np.r_[False, codes > 127]
        out[label] = float((log[codes].sum() + steps[outer[:-1] | outer[1:]].sum()) / max(high, 1))
    return out


def _behind_head(sample: bytes, high: int) -> bool:
    """Whether most of the bytes above 7F are UTF-8 behind the last one that is not."""
    rest = UTF8.sub(lambda m: b"a" * len(m[0]), sample)
    if len(sample) == SAMPLE:
        rest = rest[:-3]  # the sample may cut a character
    return _high(sample[len(rest.rstrip(bytes(range(128)))) :]) >= MOSTLY * high


def _latin(sample: bytes, high: int) -> float:
    """What the letters of ASCII tell for the Western page: they are many more than lone accents, or too few for its words."""
    letters = len(sample) - len(sample.translate(None, LETTERS))
    if letters < high:
        return -LATIN
    return LATIN if letters >= 2 * high and len(LONE.findall(sample)) >= MOSTLY * high else 0.0


def guess(data: bytes) -> tuple[str | None, float]:
    """The likeliest page and how sure that is, from 0 to 1; no page where none makes text of the bytes, or they are UTF-8 behind a head."""
    sample = data[:SAMPLE]
    high = _high(sample)
    if high < EVIDENCE or _behind_head(sample, high):
        return None, 0.0
    own = scores(data)
    western = _latin(sample, high)
    found = sorted(((label, score + western * (label == "windows-1252")) for label, score in own.items()), key=lambda x: -x[1])
    (label, best), (_, second) = found[:2]
    if own[label] < FLOOR:
        return None, 0.0
    return label, float(1 / (1 + np.exp(-min((best - second) * high, 50.0))))


def guess_of(content: Column, wanted: Column) -> Column:
    """struct<label, confidence> of the rows that want it, by their bytes from the first one above 7F on; the others send nothing to Python."""

    @F.pandas_udf("struct<label string, confidence double>")
    def page(data: pd.Series) -> pd.DataFrame:
        found = [guess(bytes(b)) if b is not None else (None, 0.0) for b in data]
        return pd.DataFrame({"label": pd.Series([x[0] for x in found], dtype=object), "confidence": [x[1] for x in found]})

    first = F.regexp_instr(F.decode(content, "ISO-8859-1"), F.lit(r"[\x80-\xFF]"))
    return page(F.when(wanted, F.substring(content, F.greatest(first - 1, F.lit(1)), F.lit(SAMPLE))))
