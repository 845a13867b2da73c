"""The guard: whether a proposed correction of a line may stand, and why.

The cheap layers (empty, identical, length, formatting) need no alignment; they are one chain,
so a pair that they decide costs no more. What differs is then judged block by block, and each
block must pass one of the tests. ``variant`` is "service" or "cli"; the two differ in their
character sets, in stutter removal and in how jargon is completed. A phonetics provider gives a
word's syllables; without one, spelling is compared.
"""

from __future__ import annotations

import difflib
import itertools
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kaptura.functions import lexicon as lex
from kaptura.functions import text as tx
from kaptura.functions.spoken import fuzzy_syllables, similarity
from kaptura.operators.align import runs_in_order

Syllables = Callable[[str], Sequence[str]]
RESULT = "struct<accepted:boolean,reason:string>"


@dataclass(frozen=True)
class Profile:
    """What is known of a document's domain."""

    domain: str = ""
    topic: str = ""
    jargon_list: Sequence[str] = ()
    confusion_rules: Mapping[str, str] = field(default_factory=dict)
    style_notes: str = ""


_IDENTIFIER = re.compile(r"[a-zA-Z][零〇一幺二两三四五六七八九十0-9]+\Z")
_PLAIN_IDENTIFIER = re.compile(r"[a-zA-Z][0-9]+\Z")
_CJK = re.compile(r"[一-鿿]")


def digits_of(text: str) -> str:
    return "".join(lex.CN_DIGITS.get(c, c) for c in text if c in lex.CN_DIGITS or c.isdigit())


def initial_of(syllable: str) -> str:
    return next((i for i in lex.INITIALS if syllable.startswith(i)), "")


def changes(a: str, b: str) -> Iterator[tuple[int, int, int, int]]:
    """What differs between two texts: (from, to) in each, from left to right.

    Frequent characters count as any other: difflib leaves them out from 200 characters on, and then
    takes all of two long texts for one changed block.
    """
    if a in b or b in a:  # no run can be longer than the shorter text
        runs = [(0, b.index(a), len(a))] if a in b else [(a.index(b), 0, len(b))]
    elif len(b) < 64:
        runs = difflib.SequenceMatcher(None, a, b).get_matching_blocks()
    else:
        runs = runs_in_order(a, b)
    i = j = 0
    for x, y, size in itertools.chain(runs, [(len(a), len(b), 0)]):
        if i < x or j < y:
            yield i, x, j, y
        i, j = x + size, y + size


class Guard:
    def __init__(self, variant: str = "service", syllables: Syllables | None = None):
        self.variant, self.syllables = variant, syllables
        self.punctuation = re.compile(f"[{lex.GUARD_PUNCTUATION[variant]}]+")
        self.units = frozenset(lex.GUARD_CN_UNITS[variant] + lex.GUARD_LATIN_UNITS[variant])
        self.latin = re.compile("[a-zA-Z0-9]" if variant == "cli" else "[a-zA-Z]")

    def bare(self, text: str) -> str:
        return self.punctuation.sub("", text)

    # -- stutter

    def _without_one_repeat(self, text: str, size: int):
        """What a text can become when one repetition is taken out and ``size`` characters with it."""
        if self.variant == "cli":
            for m in re.finditer(r"(.)\1+", text):
                if m.end() - m.start() - 1 == size:
                    yield text[: m.start()] + m.group(1) + text[m.end() :]
        if size in ((2, 3, 4) if self.variant == "cli" else (1, 2, 3, 4)):
            for i in range(len(text) - 2 * size + 1):
                if text[i : i + size] == text[i + size : i + 2 * size]:
                    yield text[: i + size] + text[i + 2 * size :]

    def stutter(self, original: str, corrected: str) -> bool:
        a, b = self.bare(original), self.bare(corrected)
        if self.variant == "cli":
            a, b = a.lower(), b.lower()
        elif len(a) - len(b) > 6:
            return False
        return bool(b) and len(a) > len(b) and any(b == x for x in self._without_one_repeat(a, len(a) - len(b)))

    # -- blocks

    def numeral(self, a: str, b: str) -> bool:
        """Spoken numbers, identifiers or units written another way, with the same digits."""
        a, b = a.strip(), b.strip()
        if not a or not b:
            return False
        if _IDENTIFIER.match(a):
            return bool(_PLAIN_IDENTIFIER.match(b)) and a[0].lower() == b[0].lower()
        if not self.units.issuperset(a + b):
            return False
        x, y = digits_of(a), digits_of(b)
        return not (x and y and x != y)

    def sounds_like(self, a: str, b: str) -> bool:
        if not a or not b:
            return False
        if a == b:
            return True
        if self.syllables is None:
            return similarity(a.lower(), b.lower()) >= 0.75
        pa, pb = list(self.syllables(a)), list(self.syllables(b))
        x, y = "".join(pa).lower(), "".join(pb).lower()
        if pa == pb or x == y:
            return True
        if not self.latin.search(a) and not self.latin.search(b):
            if abs(len(a) - len(b)) > 1:
                return False
            fuzzy = ("".join(fuzzy_syllables(p, self.variant)) for p in (pa, pb))
            return similarity(x, y) >= 0.70 or similarity(*fuzzy) >= 0.70
        for i in (-1, 0):  # a CJK tail, or head, of both must sound alike
            if _CJK.match(a[i]) and _CJK.match(b[i]) and similarity(self.syllables(a[i])[0], self.syllables(b[i])[0]) < 0.70:
                return False
        return similarity(x, y) >= (0.48 if x and y and x[0] == y[0] else 0.70)

    def initials_alike(self, a: str, b: str) -> bool:
        if self.syllables is None:
            return False
        pa, pb = self.syllables(a), self.syllables(b)
        if not pa or not pb:
            return False
        x, y = initial_of(pa[0]), initial_of(pb[0])
        return x == y != "" or any(x in g and y in g for g in lex.CONFUSABLE_INITIALS)

    def _rule(self, a: str, b: str, profile: Profile) -> bool:
        wanted = profile.confusion_rules.get(self.bare(a).lower())
        return wanted is not None and self.bare(wanted).lower() == self.bare(b).lower() and (self.sounds_like(a, b) or self.numeral(a, b))

    def _jargon(self, a: str, b: str, around: tuple[str, str], profile: Profile) -> bool:
        x, y = a.upper(), b.upper()
        if x and any(j.upper() == y and y.startswith(x) and len(j) - len(x) <= 2 for j in profile.jargon_list):
            return True
        near, wanted = around
        single = self.variant == "cli" and (len(a) <= 1 or len(b) <= 1)
        return single and any(j.lower() == wanted and wanted.startswith(near) for j in profile.jargon_list)

    def block(self, old: str, new: str, span: tuple[int, int, int, int], profile: Profile) -> str | None:
        """None if a changed block passes, else the reason."""
        i1, i2, j1, j2 = span
        a, b = old[i1:i2], new[j1:j2]
        if self.numeral(a, b):
            return None
        x, y = digits_of(a), digits_of(b)
        if x and y and x != y:
            return f"digit_mismatch_{x}->{y}"

        def around(n: int) -> tuple[str, str]:
            return old[max(0, i1 - n) : i2 + n], new[max(0, j1 - n) : j2 + n]

        single = len(a) <= 1 and len(b) <= 1 and not x and not y
        passes = a.lower() == b.lower() or self._rule(a, b, profile) or self._jargon(a, b, around(4), profile) or self.sounds_like(a, b) or single and self.initials_alike(a, b) and self.sounds_like(*around(1))
        return None if passes else f"non_phonetic_change_{a}->{b}"

    def verify(self, original: str | None, corrected: str | None, profile: Profile = Profile()) -> tuple[bool, str]:  # noqa: B008
        new = (corrected or "").strip()
        if not new:
            return False, "empty_output"
        old = (original or "").strip()
        if old == new:
            return True, "identical"
        a, b = self.bare(old), self.bare(new)
        if a:
            least, most = (0.40, 2.0) if len(a) <= 5 else (0.55, 1.65)
            if not least <= len(b) / len(a) <= most:
                return False, f"length_ratio_{len(b) / len(a):.2f}"
        if self.stutter(old, new):
            return True, "accepted_stutter_reduction"
        if a == b:
            return True, "accepted_formatting_only" if a else "accepted_punctuation_only"
        for span in changes(a, b):
            if reason := self.block(a, b, span, profile):
                return False, reason
        return True, "accepted"

    def safely(self, original: str | None, corrected: str | None, profile: Profile = Profile(), compat: bool = False) -> tuple[bool, str]:  # noqa: B008
        """A guard that fails rejects; with ``compat`` it lets the candidate pass."""
        try:
            return self.verify(original, corrected, profile)
        except Exception:  # noqa: BLE001
            return compat, "guard_error"


def profile_of(row) -> Profile:
    """A profile from a struct column's value; null is the empty profile."""
    if row is None:
        return Profile()
    get = row.get if isinstance(row, dict) else lambda k: row[k] if k in row else None
    rules = get("confusion_rules")
    return Profile(get("domain") or "", get("topic") or "", list(get("jargon_list") if get("jargon_list") is not None else ()), dict(rules if rules is not None else {}), get("style_notes") or "")


def verified(original: Column, corrected: Column, profile: Column | None = None, variant: str = "service", syllables: Syllables | None = None, compat: bool = False) -> Column:
    """struct<accepted, reason> of each pair; of pairs that ``native_reason`` decides only the
    reason travels to Python."""
    guard = Guard(variant, syllables)
    known = native_reason(original, corrected)
    inputs = [known, *(F.when(known.isNull(), F.coalesce(c, F.lit(""))) for c in (original, corrected))]

    def judged(reasons, old, new, profiles) -> pd.DataFrame:
        rows = [guard.safely(a, b, p, compat) if k is None else (k != "empty_output", k) for k, a, b, p in zip(reasons, old, new, profiles, strict=True)]
        return pd.DataFrame(rows, columns=["accepted", "reason"])

    @F.pandas_udf(RESULT)
    def run(reasons: pd.Series, old: pd.Series, new: pd.Series) -> pd.DataFrame:
        return judged(reasons, old, new, [Profile()] * len(old))

    @F.pandas_udf(RESULT)
    def run_with(reasons: pd.Series, old: pd.Series, new: pd.Series, profiles: pd.DataFrame) -> pd.DataFrame:
        return judged(reasons, old, new, [profile_of(r) for r in profiles.to_dict("records")])

    return run(*inputs) if profile is None else run_with(*inputs, profile)


def native_reason(original: Column, corrected: Column) -> Column:
    """The reason where one look at the pair tells it, as native columns; null for other pairs.

    Taking marks out natively costs more than it saves, so formatting is left to Python.
    """
    new = F.coalesce(corrected, F.lit(""))
    return F.when(~new.rlike(f"[^{tx.BLANKS}]"), "empty_output").when(original == new, "identical")
