"""Text and time functions as native columns: they stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kaptura.functions import lexicon as lex

CJK = r"[一-鿿]"
#: White space as Python's strip() takes it, for the inside of a character class too.
BLANKS = r"\s\x1c-\x1f\x85   -     　"
_SPACE = f"[{BLANKS}]"
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    """Without a search through the text."""
    return F.btrim(text, F.lit(_SPACES))


def has_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike(CJK), F.lit(False))


def visual_length(text: Column) -> Column:
    """Two for each CJK character or wide mark, one for any other."""
    narrow = F.regexp_replace(text, rf"[一-鿿{lex.WIDE_PUNCTUATION}]", "")
    return 2 * F.char_length(text) - F.char_length(narrow)


def spaced(text: Column, last: str = r"龥", gaps: str = " +") -> Column:
    """A space between CJK and Latin letters or digits; runs of spaces become one."""
    cjk = rf"[一-{last}]"
    out = F.regexp_replace(text, rf"({cjk})([a-zA-Z0-9])", "$1 $2")
    out = F.regexp_replace(out, rf"([a-zA-Z0-9])({cjk})", "$1 $2")
    return strip(F.regexp_replace(out, gaps, " "))


def without_marks(text: Column) -> Column:
    return F.regexp_replace(text, "[*_~`]+", "")


def spaced_wide(text: Column) -> Column:
    """The normaliser's variant: the whole CJK block, runs of two or more blanks."""
    return spaced(text, r"鿿", r"[ \t]{2,}")


def spaced_unmarked(text: Column) -> Column:
    """The command line's variant: marks go, too."""
    return strip(without_marks(spaced(text)))


def without_outer_punctuation(text: Column) -> Column:
    """A line without punctuation and blanks at its ends; question and exclamation marks stay."""
    outer = "[" + _SPACE[1:-1] + "".join(f"\\x{{{ord(c):x}}}" for c in lex.OUTER_PUNCTUATION) + "]+"
    return F.when(text == "", "").otherwise(spaced(F.regexp_replace(F.regexp_replace(text, f"^{outer}", ""), f"{outer}$", "")))


def with_terms(text: Column, terms: list[tuple[str, str]]) -> Column:
    """Each term replaced in turn, wherever it stands."""
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), ((a, b) for a, b in terms if a), text)


def content(text: Column, variant: str = "service") -> Column:
    """What is left without punctuation and blanks."""
    return F.regexp_replace(text, f"(?U)[{lex.GUARD_PUNCTUATION[variant]}]+", "")


def digits(text: Column) -> Column:
    """Spoken and written digits as one string."""
    spoken = "".join(lex.CN_DIGITS)
    return F.regexp_replace(F.translate(text, spoken, "".join(lex.CN_DIGITS.values())), r"[^\p{Nd}]", "")


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm with carries; negative times are zero."""
    ms = F.round(F.greatest(seconds.cast("double"), F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.expr("1") * F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def srt_seconds(text: Column) -> Column:
    """Seconds of H:M:S,mmm or H:M:S.mmm; null where it isn't a time."""
    pattern = r"^\s*(\d+):(\d+):(\d+)[,.](\d+)\s*$"
    part = [F.regexp_extract(text, pattern, i).try_cast("double") for i in range(1, 5)]
    return part[0] * 3600 + part[1] * 60 + part[2] + part[3] / 1000


def three_slices(text: Column, total: int = 2500) -> Column:
    """Texts over ``total`` characters: a third of that from 10, 45 and 75 percent."""
    n, each = F.char_length(text), total // 3
    heads = ("前段", "中段", "后段")
    parts = []
    for head, number, share in zip(heads, "一二三", (0.10, 0.45, 0.75), strict=True):
        at = F.floor(n * F.lit(share)).cast("int") + 1
        parts += [F.lit(f"【采样片段{number} ({head})】\n"), F.substring(text, at, F.lit(each)), F.lit("\n\n")]
    return F.when(n <= total, text).otherwise(F.concat(*parts[:-1]))


def answer_text(raw: Column) -> Column:
    """A model's answer without its thinking and code fences."""
    out = F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")
    return strip(F.regexp_replace(F.regexp_replace(strip(out), r"^```json\s*", ""), "```$", ""))
