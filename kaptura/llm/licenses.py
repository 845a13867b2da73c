"""Licence notices and licence expressions in documents.

One Aho-Corasick automaton finds notice phrases over a document's folded words; a second one
finds identifier tags in its lower-cased text. What follows a tag on its line is a licence
expression: a shunting-yard parser turns it into postfix order (``with`` binds tightest, then
``and``, then ``or``) and evaluates it to the licences it names and whether they are choices.

Null and empty texts have no words, places or labels and score 0. A tag whose expression does
not parse, or names no known licence ("license: see below"), gives no label and no terms. An
expression of more than ``most_choices`` alternatives is kept as one set of all it names: its
labels are the same. Texts are scanned whole, in time in proportion to their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from kaptura.llm.words import fold_words, framed, lower_ascii, original_spans, word_starts

#: The base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Further phrases of well-known notices and the labels they give.
MORE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "boost software license": "bsl",
    "isc license": "isc",
    "creative commons": "cc",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}

#: Tags before a licence expression.
TAGS = ("spdx-license-identifier:", "license-expression:", "license:", "licence:")

#: Labels of identifiers, by what the identifier begins with; the longest that fits counts.
FAMILIES = {"mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "epl": "epl", "bsd": "bsd", "bsl": "bsl", "isc": "isc", "cc0": "cc0", "cc-by": "cc-by", "cc-by-sa": "cc-by-sa", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "unlicense": "public-domain"}

_TOKEN = re.compile(r"\s*([()]|[a-z0-9][a-z0-9.+-]*|[^\s])")
_BINDS = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Terms:
    """What an expression says: the sets of licences, one of which must be kept to in full."""

    choices: frozenset[frozenset[str]]

    def joined(self, operator: str, right: Terms) -> Terms:
        if operator == "or":
            return Terms(self.choices | right.choices)
        if operator == "and":
            return Terms(frozenset(a | b for a in self.choices for b in right.choices))
        (exception,) = next(iter(right.choices))
        return Terms(frozenset(frozenset(f"{x} with {exception}" for x in a) for a in self.choices))


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard order of an expression in lower case; None where it isn't one."""
    out, held, operand_next = [], [], True
    for token in _TOKEN.findall(expression):
        if token in _BINDS:
            if operand_next:
                return None
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[token]:
                out.append(held.pop())
            held.append(token)
            operand_next = True
        elif token == "(":
            if not operand_next:
                return None
            held.append(token)
        elif token == ")":
            if operand_next:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif token[0].isalnum():
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
        else:
            return None
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


def evaluate(expression: str, most_choices: int = 256) -> Terms | None:
    """Licences of an expression; None if it doesn't parse or an exception isn't a plain name."""
    order = postfix(expression)
    if order is None:
        return None
    stack: list[Terms] = []
    for token in order:
        if token not in _BINDS:
            stack.append(Terms(frozenset([frozenset([token.rstrip(".")])])))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with" and (len(right.choices) != 1 or len(next(iter(right.choices))) != 1):
            return None
        if token == "and" and len(left.choices) * len(right.choices) > most_choices:
            # Too many alternatives to list: what all of them name together.
            both = frozenset().union(*left.choices, *right.choices)
            stack.append(Terms(frozenset([both])))
            continue
        stack.append(left.joined(token, right))
    return stack[0]


def known(identifier: str) -> bool:
    """Whether an identifier belongs to a family of licences."""
    return family(identifier) in FAMILIES.values()


def family(identifier: str) -> str:
    """The label of an identifier; one that fits no family is its own label."""
    name = identifier.split(" with ")[0]
    fits = [k for k in FAMILIES if name == k or name.startswith((k + "-", k + "+"))]
    return FAMILIES[max(fits, key=len)] if fits else name


class Scanner:
    _kept: Scanner | None = None

    def __init__(self):
        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for base, table in ((True, BASE_PHRASES), (False, MORE_PHRASES)):
            for phrase, label in table.items():
                self.phrases.add_word(f" {phrase} ", (len(phrase) + 2, len(phrase.split()), label, base))
        for tag in TAGS:
            self.tags.add_word(tag, len(tag))
        self.phrases.make_automaton()
        self.tags.make_automaton()

    @classmethod
    def load(cls) -> Scanner:
        if cls._kept is None:
            cls._kept = cls()
        return cls._kept

    def expressions(self, text: str) -> list[str]:
        """Expressions behind tags; of overlapping tags the one that begins first."""
        found, beyond = [], -1
        for start, size in sorted((end - size + 1, size) for end, size in self.tags.iter(text)):
            if start < beyond:
                continue
            beyond = start + size
            stop = text.find("\n", beyond)
            found.append(text[beyond : stop if stop >= 0 else len(text)].strip(" \t\r\x0b\x0c*/#->;.'\""))
        return found

    def scan(self, text: str | None) -> dict:
        words = fold_words(text)
        out = {"n_words": len(words), "places": [], "base_labels": set(), "labels": set(), "terms": []}
        if not words:
            return out
        line = framed(words)
        hits = list(self.phrases.iter(line))
        if hits:
            starts = word_starts(words)
            for end, (size, n, label, base) in hits:
                first = int(starts.searchsorted(end - size + 1))
                out["places"].append((first, first + n, label, base))
                out["labels"].add(label)
                if base:
                    out["base_labels"].add(label)
        if ":" in text:
            for expression in self.expressions(lower_ascii(text)):
                terms = evaluate(expression)
                names = {x for choice in terms.choices for x in choice if known(x)} if terms else ()
                if names:
                    out["terms"].append(terms)
                    out["labels"].update(map(family, names))
        return out


def score(found: dict) -> float:
    """1 for a tag with an expression, 0.8 for a base phrase, 0.5 for another phrase; 0 for none."""
    if found["terms"]:
        return 1.0
    return 0.8 if found["base_labels"] else 0.5 if found["places"] else 0.0


def license_places(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row for each phrase found: ``keep``, label, start_word, start and stop in code points."""
    kept = docs.select(*keep, docs[text].alias(max([*keep, ""], key=len) + "_text"))  # a name that none of them has
    schema = docs.select(*keep).schema.add("label", "string").add("start_word", "long").add("start", "long").add("stop", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner.load()
        for batch in batches:
            rows, cols = [], ([], [], [], [])
            for i, body in enumerate(batch.column(len(keep)).to_pylist()):
                places = scanner.scan(body)["places"]
                for (first, _, label, _), (a, b) in zip(places, original_spans(body, [p[:2] for p in places]) if places else [], strict=True):
                    rows.append(i)
                    for c, v in zip(cols, (label, first, a, b), strict=True):
                        c.append(v)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns[:-1], pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[*keep, "label", "start_word", "start", "stop"])

    return kept.mapInArrow(run, schema)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each document: words, base places, first and last base place, labels, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner.load()
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for body in batch.column(1).to_pylist():
                found = scanner.scan(body)
                base = [p[0] for p in found["places"] if p[3]]
                for c, v in zip(cols, (found["n_words"], len(base), min(base, default=None), max(base, default=None), ",".join(sorted(found["base_labels"])), ",".join(sorted(found["labels"])), score(found)), strict=True):
                    c.append(v)
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kept = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return kept.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
