"""Personal data: patterns, and a linear-chain conditional random field over word shapes.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers. The random field
adds forms that they miss (phone numbers without a plus, addresses with a written-out "at") and a
kind of its own, secrets (access keys, and passwords and tokens behind their name); it is trained by gradient ascent on the likelihood of a small labelled table made here by a rule,
and decoded by Viterbi over batches of sequences in numpy. A span of the field stays if it is
well formed for its kind and meets no span of the patterns.

Words without a digit or a mark, between words of that sort, are outside every span: training
checks that their score for "outside" exceeds every other by more than transitions can make up.
So sequences are cut there, and the decoding of the parts is that of the whole.

Null and empty texts have no spans. Texts are read whole; matching is linear in their length.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: In the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: With the kind that only the field finds.
ALL_KINDS = (*KINDS, "secret")
LABELS = ("outside", *ALL_KINDS)
SECRET = ALL_KINDS.index("secret")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can't begin inside a run of digits that failed from its start.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]")
_TOKEN = re.compile(r"\S+")
#: What a secret is called in settings and code.
_NAMES_A_SECRET = re.compile(r"[\w.-]*(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key)", re.I)
_ASSIGNED = re.compile(r"([\w.-]+)\s*:?[=:]\s*[\"']?([^\s\"']{8,})[\"']?")
_UPPER_MIXED = re.compile(r"(?=[A-Z0-9]*[0-9])(?=[A-Z0-9]*[A-Z]{2})[A-Z0-9]{16,40}")
_MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/_.-]{12,}={0,2}")


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if n % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards."""
    out, beyond, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > beyond and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            beyond = m.end()
        at = text.find("@", max(at + 1, beyond))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind, end of the patterns' spans, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out)


# ---------------------------------------------------------------------------- word shapes

#: Word-shape features: a name and the shape it stands for, digits as 9 and letters as x.
SHAPES = {
    "one": r"9{1,2}",
    "three": r"9{3}",
    "four": r"9{4}",
    "five": r"9{5,6}",
    "seven": r"9{7,8}",
    "nine": r"9{9,11}",
    "long": r"9{12,19}",
    "longer": r"9{20,}",
    "plus": r"\+9{1,3}",
    "plus long": r"\+9[9().-]{7,}",
    "area": r"\(9{2,4}\)",
    "area joined": r"\(9{2,4}\)-?9[9.-]+",
    "pair": r"9{3,4}-9{3,4}",
    "triple": r"9{3}[-.]9{3}[-.]9{4}",
    "date": r"9{4}-9{2}-9{2}|9{1,2}[/.]9{1,2}[/.]9{2,4}",
    "groups": r"9{4}(?:-9{2,7}){2,4}",
    "quad": r"9{1,3}(?:\.9{1,3}){3}",
    "quad port": r"9{1,3}(?:\.9{1,3}){3}:9+",
    "decimal": r"9+\.9+",
    "version": r"x*9+\.9+\.9+(?:\.x\w*)?",
    "email": r"[x9._%+-]+@[x9-]+(?:\.[x9-]+)+",
    "at": r"[\[(]xx[\])]",
    "at sign": r"@",
    "host": r"[x9-]+(?:\.[x9-]+)*\.x{2,}",
}
_SHAPES = [(n, re.compile(p)) for n, p in SHAPES.items()]
#: Shapes that letters and cases matter for, and those of all else.
_NAMES = [n for n, _ in _SHAPES] + ["secret name", "secret given", "equals", "upper mixed", "mixed", "other", "word", "edge"]
_AT = {n: i for i, n in enumerate(_NAMES)}
_TRIM = ".,;:!?\"'"
_JUNK = _TRIM + "#*$%&|<>"
_LETTER = re.compile(r"[^\W\d_]")


def shape_of(token: str) -> int:
    """The number of a token's shape."""
    core = token.strip(_TRIM)
    if core in ("=", ":="):
        return _AT["equals"]
    if _NAMES_A_SECRET.fullmatch(core.rstrip("=:")):
        return _AT["secret name"]
    inner = core.strip(_JUNK)
    if (m := _ASSIGNED.fullmatch(inner)) and _NAMES_A_SECRET.fullmatch(m.group(1)):
        return _AT["secret given"]
    if not _MARK.search(core) and "." not in core:
        return _AT["word"]
    shape = _LETTER.sub("x", re.sub(r"[0-9]", "9", core))
    for name, pattern in _SHAPES:
        if pattern.fullmatch(shape):
            return _AT[name] if name != "host" or _MARK.search(core) else _AT["word"] if "." not in core else _AT["host"]
    if _UPPER_MIXED.fullmatch(inner):
        return _AT["upper mixed"]
    if _MIXED.fullmatch(inner):
        return _AT["mixed"]
    return _AT["other"] if _MARK.search(core) else _AT["word"]


# ---------------------------------------------------------------------------- the labelled table


def labelled_table(n: int = 720, seed: int = 9) -> list[tuple[list[str], list[int]]]:
    """Lines of words with their labels, by a rule: words of no meaning around one item each."""
    rng = np.random.default_rng(seed)

    def word() -> str:
        w = "".join(rng.choice(list("abcdefghilmnoprstuvw"), int(rng.integers(1, 9))))
        return w.capitalize() if rng.random() < 0.15 else w + ("," if rng.random() < 0.1 else "")

    def d(k: int) -> str:
        return "".join(map(str, rng.integers(0, 10, k)))

    def mixed(alphabet: str, k: int) -> str:
        return "".join(rng.choice(list(alphabet), k)) + "a7" if alphabet.islower() else "".join(rng.choice(list(alphabet), k)) + "QZ3"

    def name() -> str:
        return str(rng.choice(["password", "passwd", "secret", "token", "api_key", "access_key", "db.password", "TOKEN"]))

    small, large = "abcdef0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

    def host() -> str:
        return f"mail{d(1)}.{word().strip(',').lower()}.com"

    makers = [
        lambda: ([f"{word().strip(',').lower()}.{d(2)}@{host()}"], 1),
        lambda: ([word().strip(",").lower() + d(1), "[at]", host()], 1),
        lambda: ([word().strip(",").lower() + d(2), "(at)", host()], 1),
        lambda: ([".".join(str(x) for x in rng.integers(0, 256, 4))], 2),
        lambda: ([".".join(str(x) for x in rng.integers(0, 256, 4)) + ":" + d(4)], 2),
        lambda: ([d(4), d(4), d(4), d(4)], 3),
        lambda: (["-".join(d(4) for _ in range(4))], 3),
        lambda: ([d(16)], 3),
        lambda: ([d(4), d(6), d(5)], 3),
        lambda: ([f"+{d(1)}", f"({d(3)})", f"{d(3)}-{d(4)}"], 4),
        lambda: ([f"({d(3)})", f"{d(3)}-{d(4)}"], 4),
        lambda: ([f"{d(3)}-{d(3)}-{d(4)}"], 4),
        lambda: ([f"({d(3)})-{d(3)}-{d(4)}"], 4),
        lambda: ([f"+{d(2)}{d(9)}"], 4),
        lambda: ([f"+{d(2)}", d(3), d(3), d(4)], 4),
        lambda: ([f"{rng.integers(1900, 2030)}"], 0),
        lambda: ([f"{rng.integers(1900, 2030)}", "-", f"{rng.integers(1900, 2030)}"], 0),
        lambda: ([f"{rng.integers(1900, 2030)}-0{d(1)}-1{d(1)}"], 0),
        lambda: ([f"{d(2)}.{d(2)}"], 0),
        lambda: ([f"{d(1)}.{d(1)}.{d(1)}"], 0),
        lambda: ([d(int(rng.integers(1, 9)))], 0),
        lambda: ([d(3), word(), d(4)], 0),
        lambda: (["@", word()], 0),
        lambda: (["x" + d(20)], 0),
        lambda: ([d(24)], 0),
        lambda: ([host()], 0),
        lambda: ([word() for _ in range(3)], 0),
        lambda: ([f"{name()}={mixed(small, int(rng.integers(10, 40)))}"], SECRET + 1),
        lambda: ([name(), "=", f'"{mixed(small, int(rng.integers(12, 40)))}"'], SECRET + 1),
        lambda: ([name() + ":", mixed(small, int(rng.integers(12, 40)))], SECRET + 1),
        lambda: ([mixed(large, int(rng.integers(14, 22)))], SECRET + 1),
        lambda: ([word(), mixed(small, int(rng.integers(12, 40)))], 0),
        lambda: (["commit", mixed(small, 38), word()], 0),
        lambda: ([name(), word(), d(4)], 0),
        lambda: ([word(), "=", d(int(rng.integers(1, 6)))], 0),
        lambda: ([word(), "=", mixed(small, 14)], 0),
    ]
    table = []
    for i in range(n):
        item, label = makers[i % len(makers)]()
        before, after = ([word() for _ in range(int(rng.integers(0, 5)))] for _ in range(2))
        table.append((before + list(item) + after, [0] * len(before) + [label] * len(item) + [0] * len(after)))
    return table


# ---------------------------------------------------------------------------- the random field


class Field:
    """emit[o, s]: scores of labels for the shape s at offset o - 1 from a word; step: transitions.

    A sequence begins after and ends before "outside".
    """

    def __init__(self, emit: np.ndarray, step: np.ndarray):
        self.emit, self.step = emit, step
        word, edge = _AT["word"], _AT["edge"]
        self.cuts = True
        for a, b in itertools.product((word, edge), repeat=2):
            s = emit[0, a] + emit[1, word] + emit[2, b]
            # What one word loses by another label than "outside", whatever stands on its sides.
            for k in range(1, len(LABELS)):
                gain = (step[:, k] - step[:, 0]).max() + (step[k] - step[0]).max()
                self.cuts &= bool(s[0] - s[k] > gain)

    def scores(self, shapes: np.ndarray) -> np.ndarray:
        """For rows of padded shapes with one neighbour before and one behind."""
        return self.emit[0][shapes[:, :-2]] + self.emit[1][shapes[:, 1:-1]] + self.emit[2][shapes[:, 2:]]

    def decode(self, sequences: list[list[int]]) -> list[list[int]]:
        """Best labels of sequences of shapes (each with its two neighbours), by length in batches."""
        out: list[list[int]] = [[]] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        for size, same in itertools.groupby(order, key=lambda i: len(sequences[i])):
            ids = list(same)
            for at in range(0, len(ids), 4096):
                part = ids[at : at + 4096]
                for i, labels in zip(part, self._viterbi(self.scores(np.array([sequences[i] for i in part]))), strict=True):
                    out[i] = labels
        return out

    def _viterbi(self, scores: np.ndarray) -> list[list[int]]:
        n, length, k = scores.shape
        best = scores[:, 0] + self.step[0]
        back = np.zeros((length, n, k), np.int8)
        for t in range(1, length):
            ways = best[:, :, None] + self.step[None]
            back[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[:, t]
        label = (best + self.step[:, 0]).argmax(axis=1)
        path = [label]
        for t in range(length - 1, 0, -1):
            label = back[t][np.arange(n), label]
            path.append(label)
        return np.stack(path[::-1], axis=1).tolist()


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def likelihood(groups: list[tuple[np.ndarray, np.ndarray]], emit: np.ndarray, step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of groups of padded shapes and labels of one length each, and its gradient."""
    k, value = len(LABELS), 0.0
    d_emit, d_step = np.zeros_like(emit), np.zeros_like(step)
    for shapes, y in groups:
        scores = emit[0][shapes[:, :-2]] + emit[1][shapes[:, 1:-1]] + emit[2][shapes[:, 2:]]
        n, length, _ = scores.shape
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0] + step[0]
        for t in range(1, length):
            ahead[:, t] = _log_sum(ahead[:, t - 1, :, None] + step[None], 1) + scores[:, t]
        behind[:, -1] = step[:, 0]
        for t in range(length - 2, -1, -1):
            behind[:, t] = _log_sum(step[None] + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        log_z = _log_sum(ahead[:, -1] + step[:, 0], 1)
        walked = np.concatenate((np.zeros((n, 1), y.dtype), y, np.zeros((n, 1), y.dtype)), axis=1)
        value += np.take_along_axis(scores, y[:, :, None], 2).sum() + step[walked[:, :-1], walked[:, 1:]].sum() - log_z.sum()
        delta = np.eye(k)[y] - np.exp(ahead + behind - log_z[:, None, None])
        for o in range(3):
            np.add.at(d_emit[o], shapes[:, o : o + length], delta)
        d_step[0] += delta[:, 0].sum(axis=0)
        d_step[:, 0] += delta[:, -1].sum(axis=0)
        for t in range(1, length):
            pair = np.exp(ahead[:, t - 1, :, None] + step[None] + (scores[:, t] + behind[:, t])[:, None, :] - log_z[:, None, None])
            np.add.at(d_step, (y[:, t - 1], y[:, t]), 1.0)
            d_step -= pair.sum(axis=0)
    return float(value), d_emit, d_step


def train(table: list[tuple[list[str], list[int]]], rounds: int = 200, rate: float = 0.1, decay: tuple[float, float] = (1e-5, 3e-3)) -> Field:
    """Gradient ascent (with running moments of the gradient) on the mean log-likelihood, less
    squared weights: ``decay`` of scores and, more, of transitions."""
    k, edge = len(LABELS), _AT["edge"]
    params = [np.zeros((3, len(_NAMES), k)), np.zeros((k, k))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    by_length: dict[int, tuple[list, list]] = {}
    for words, labels in table:
        if words:
            shapes, ys = by_length.setdefault(len(words), ([], []))
            shapes.append([edge, *map(shape_of, words), edge])
            ys.append(labels)
    groups = [(np.array(s), np.array(y)) for s, y in by_length.values()]
    total = sum(len(s) for s, _ in groups)
    for turn in range(1, rounds + 1):
        _, *slopes = likelihood(groups, *params)
        for p, g, (m, v), less in zip(params, slopes, moments, decay, strict=True):
            g = g / total - less * p
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Field(*params)


# ---------------------------------------------------------------------------- finding spans


def _well_formed(kind: int, text: str) -> bool:
    digits = _digits(text)
    if kind == 0:
        return "@" in text and bool(_DOMAIN.search(text)) or bool(re.fullmatch(r"[\w.%+-]+\s*[\[(]at[\])]\s*[A-Za-z0-9-]+(?:\s*(?:\.|[\[(]dot[\])])\s*[A-Za-z0-9-]+)+", text))
    if kind == 1:
        parts = re.split(r"[.:]", text)
        return len(parts) >= 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts[:4])
    if kind == SECRET:
        return bool(_MIXED.fullmatch(text))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits) and not _LETTER.search(text)
    return 9 <= len(digits) <= 15 and not _LETTER.search(text) and bool(re.search(r"[()\-. ]", text.strip())) and not re.fullmatch(r"[0-9. ]+", text)


def field_spans(texts: list[str | None], field: Field) -> list[list[tuple[int, int, int]]]:
    """start, kind, end of the field's spans of each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sequences, places = [], []
    word, edge = _AT["word"], _AT["edge"]
    for n, text in enumerate(texts):
        at = 0
        while text and (m := _MARK.search(text, at)):
            begin, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
            at = end = end if end >= 0 else len(text)
            tokens = [t.span() for t in _TOKEN.finditer(text, begin, end)]
            shapes = [edge, *(shape_of(text[a:b]) for a, b in tokens), edge]
            if not field.cuts:
                sequences.append(shapes)
                places.append((n, tokens))
                continue
            odd = [i for i, s in enumerate(shapes[1:-1]) if s != word]
            i = 0
            while i < len(odd):  # what stands one word from an odd word belongs to its part
                first = max(0, odd[i] - 1)
                while i + 1 < len(odd) and odd[i + 1] - odd[i] <= 3:
                    i += 1
                last = min(len(tokens) - 1, odd[i] + 1)
                sequences.append(shapes[first : last + 3])
                places.append((n, tokens[first : last + 1]))
                i += 1
    for (n, tokens), labels in zip(places, field.decode(sequences), strict=True):
        at = 0
        for label, same in itertools.groupby(labels):
            size = len(list(same))
            if label:
                text = texts[n]
                start, end = tokens[at][0], tokens[at + size - 1][1]
                trim = _JUNK if label - 1 == SECRET else _TRIM
                while end > start and text[end - 1] in trim:
                    end -= 1
                while start < end and text[start] in trim:
                    start += 1
                if label - 1 == SECRET and (m := _ASSIGNED.match(text, start, end)):
                    start, end = m.span(2)  # the name stays
                if _well_formed(label - 1, text[start:end]):
                    out[n].append((start, label - 1, end))
            at += size
    return out


def all_spans(texts: list[str | None], field: Field) -> list[tuple[list, list]]:
    """Each text's base spans, and all spans in order."""
    found = []
    for text, more in zip(texts, field_spans(texts, field), strict=True):
        base = base_spans(text) if text else []
        added = [s for s in more if not any(a < s[2] and s[0] < b for a, _, b in base)] if more else []
        found.append((base, sorted(base + added)))
    return found


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_private(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts of the patterns' spans by kind, base_sha256, spans (all of them), n_spans."""
    field = field or train(labelled_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, lists, sizes = [[] for _ in KINDS], [], [], []
            for base, spans in all_spans(batch.column(1).to_pylist(), field):
                for k, c in enumerate(counts):
                    c.append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                lists.append(listed(spans))
                sizes.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(lists, pa.string()), pa.array(sizes, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    schema = docs.select("doc_id").schema
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    return docs.select("doc_id", "text").mapInArrow(run, schema.add("base_sha256", "string").add("spans", "string").add("n_spans", "long"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or each run of overlapping ones, replaced by its kind in brackets."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{ALL_KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_private(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """All columns of ``docs``, the spans in ``text`` masked; null texts stay null."""
    field = field or train(labelled_table())
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [masked(t, s) if s else t for t, (_, s) in zip(texts, all_spans(texts, field), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
