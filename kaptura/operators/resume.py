"""Caption lines from tokens that come one by one, from a state that doesn't grow with the document.

Each step of the segmentation looks a little ahead: a cut is judged with the next word, moved with the
next cut, a line is joined or carried on with the cut behind the next, and its end is known with the
start of the next. So every step keeps what waits for that, and words stay only as long as a line that
may still change holds them: those of the line before the last kept one are forgotten. What comes out
equals the lines of the whole document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from kaptura.operators import lines as ln
from kaptura.operators.lines import Style, Word

Line = tuple[int, float, float, str]


@dataclass
class Resumable:
    """Places are counted from the document's first word; ``base`` is that of the first word kept."""

    held: list[Word] = field(default_factory=list)  # tokens of a clause or a run of letters that isn't over
    words: list[Word] = field(default_factory=list)
    shown: list[tuple[float, float, str]] = field(default_factory=list)  # a line whose next isn't known
    last: list[list] = field(default_factory=list)  # a line with times that the next may cut
    ended: float | None = None  # of the last token
    at_sentence: bool = False
    base: int = 0
    line: int = 0  # where the line begins that is cut next
    columns: int = 0
    cut: int = -1  # a cut that waits for the next; -1: none
    moved: int = 0  # the last cut that was moved
    end: int = -1  # a moved cut that waits for the next
    before: int = -1  # where the last line kept begins
    start: int = 0  # and where it ends
    given: int = 0

    def token(self, token: Word, tokenizer: Callable[[str], list[str]] | None = None, style: Style = Style()) -> Iterator[Line]:  # noqa: B008
        """Lines that have become final by the next token."""
        gap = token.start - self.ended if self.ended is not None else 0.0
        if self.ended is not None and (gap >= ln.BREATH or self.at_sentence and gap >= ln.SENTENCE_BREATH):
            yield from self._release(tokenizer, style)
        self.held.append(token)
        self.ended, self.at_sentence = token.end, token.sentence_end
        if tokenizer is None and not (len(token.text.strip()) == 1 and token.text.strip().isascii() and token.text.strip().isalnum()):
            yield from self._release(tokenizer, style)

    def finish(self, tokenizer: Callable[[str], list[str]] | None = None, style: Style = Style()) -> Iterator[Line]:  # noqa: B008
        """The lines that are left when no token follows."""
        yield from self._release(tokenizer, style)
        over = self.base + len(self.words)
        if over:
            yield from self._cut(over, style, True)
        for line in self.shown:
            yield from self._placed(line, line[0] + ln.FAR, style)
        yield from self._final()

    def _release(self, tokenizer: Callable[[str], list[str]] | None, style: Style) -> Iterator[Line]:
        clause = [{"text": t.text, "start": t.start, "end": t.end, "sentence_end": t.sentence_end, "clause_end": t.clause_end} for t in self.held]
        self.held = []
        for word in ln.clause_words(clause, tokenizer) if clause else ():
            yield from self._word(word, style)

    def _word(self, word: Word, style: Style) -> Iterator[Line]:
        """Judges the word before this one."""
        self.words.append(word)
        i = len(self.words) - 2
        if i < 0:
            return
        lo, before = self.line - self.base, self.words[i]
        self.columns += ln.width(before.text)
        if word.bound:
            return
        if ln._cut_after(self.words, lo, i, self.columns, style):
            self.line, self.columns = self.base + i + 1, 0
        elif self.columns >= style.widest or before.end - self.words[lo].start >= style.longest:
            self.line += ln.best_split(self.words[lo : i + 1], style.target)
            self.columns = sum(ln.width(w.text) for w in self.words[self.line - self.base : i + 1])
        else:
            return
        yield from self._cut(self.line, style, False)

    def _cut(self, cut: int, style: Style, over: bool) -> Iterator[Line]:
        """Moves the cut before this one; the document's end stays where it is."""
        if self.cut >= 0:
            place = self.cut
            if self.moved < place < cut:
                place = self.base + ln.moved(self.words, self.moved - self.base, place - self.base, cut - self.base)
            if place > self.moved:
                self.moved = place
                yield from self._line(place, style)
        self.cut = cut
        if over:
            if cut > self.moved:
                yield from self._line(cut, style)
            yield from self._judge(self.end, None, style)
            if self.start > max(self.before, 0):
                yield from self._kept(self.before, self.start, style)

    def _line(self, end: int, style: Style) -> Iterator[Line]:
        if self.end >= 0:
            yield from self._judge(self.end, end, style)
        self.end = end

    def _judge(self, hi: int, beyond: int | None, style: Style) -> Iterator[Line]:
        near = lambda place: place - self.base
        what = ln.fate(self.words, near(self.before) if self.before >= 0 else None, near(self.start), near(hi), None if beyond is None else near(beyond), style)
        if what == ln.JOIN:
            self.start = hi
        elif what == ln.KEEP:
            if self.before >= 0:
                yield from self._kept(self.before, self.start, style)
            self.before, self.start = self.start, hi
            self.words, self.base = self.words[near(self.before) :], self.before

    def _kept(self, a: int, b: int, style: Style) -> Iterator[Line]:
        line = ln.displayed(self.words[a - self.base : b - self.base])
        if line:
            for waiting in self.shown:
                yield from self._placed(waiting, line[0], style)
            self.shown = [line]

    def _placed(self, line: tuple[float, float, str], follows: float, style: Style) -> Iterator[Line]:
        placed = ln.placed(self.last[0] if self.last else None, line, follows, style)
        yield from self._final()
        self.last = [placed]

    def _final(self) -> Iterator[Line]:
        for a, b, text in self.last:
            self.given += 1
            yield self.given, a, round(b, 3), text
        self.last = []
