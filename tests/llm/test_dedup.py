import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from kaptura.llm import components, jaccard, queries, simhash, suffix_dedup
from kaptura.llm.common import table


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(ids, fps, most=2):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                x, y = find(a), find(ids[j])
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates_by_brute_force(spark, sf_dir):
    texts = [r.text for r in table(spark, sf_dir, "documents").collect()] + ["", None, " \t", "one", "One two", "ONE TWO"]
    got = simhash.near_duplicates(frame(spark, texts)).collect()
    fps = [plain_fingerprint(t) for t in texts]
    want = plain_components(list(range(len(texts))), fps)
    assert {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in got} == {i: (fps[i], want[i]) for i in want}


def test_shared_passages_by_brute_force(spark, sf_dir, monkeypatch):
    texts = [r.text for r in table(spark, sf_dir, "documents").collect()]
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    passage = rng.sample(words, 51)
    for extra in (0, -1, 3):  # a whole passage, one word less, a longer one
        for _ in range(2):
            own = rng.sample(words, 60 + extra)
            texts.append(" ".join(own[:20] + (passage + own[-extra:] if extra > 0 else passage[: 51 + extra]) + own[20:]))
    texts += ["", None, " ".join(passage), "a b"]
    monkeypatch.setattr(suffix_dedup, "BUCKET", 1 << 12)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(spark.createDataFrame([(90_000, texts[0]), (90_001, "a b")], "doc_id long, text string"))
    got = {r.doc_id: r.shares_passage for r in suffix_dedup.shared_passages(rows).collect()}
    assert got == {r.doc_id: r.shares_passage for r in suffix_dedup.remove_repeats(rows, passage=51).collect()}
    held = defaultdict(set)
    listed = [(r.doc_id, (r.text or "").encode().split()) for r in rows.collect()]
    for i, w in listed:
        for k in range(len(w) - 50):
            held[tuple(w[k : k + 51])].add(i)
    assert got == {i: any(len(held[tuple(w[k : k + 51])]) > 1 for k in range(len(w) - 50)) for i, w in listed}


def near_copies(seed, n):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {rng.getrandbits(64) for _ in range(n)}
    for c in centres:
        for _ in range(n):
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
    return sorted(fps)


@pytest.mark.parametrize("most", [0, 1, 2, 3, 5, 11])
def test_links_by_brute_force_with_and_without_splitting(spark, most):
    fps = near_copies(1, 150 if most == 2 else 60)
    want = plain_components(list(range(len(fps))), fps, most)
    rows = [(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)]
    classes = spark.createDataFrame(rows, "fp long, rep long")
    for over in (4, 1024):
        links = simhash.fingerprint_links(classes, most, split_over=over)
        found = {r.node: r.component for r in components.components(links).collect()}
        assert {i: found.get(i, i) for i in want} == want


def test_links_of_a_run_over_many_batches():
    fps = np.array(near_copies(2, 80), np.uint64).view(np.int64)
    key = np.repeat([1, 2, 3, 4], [1, 150, 2, len(fps) - 153]).astype(np.int64)
    cols = [key, np.zeros_like(key), fps, np.arange(len(fps))]

    def links(size):
        batches = (pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in cols], names=["key", "sub", "fp", "rep"]) for i in range(0, len(fps), size))
        return [pair for b in simhash._linked(batches, 2) for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]

    assert sorted(links(7)) == sorted(links(1)) == sorted(links(10_000)) != []


def test_components_of_a_path_and_of_nothing(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (900, 901), (901, 900)], "a long, b long")
    found = {r.node: r.component for r in components.components(links).collect()}
    assert found == {**dict.fromkeys(range(n + 1), 0), 900: 900, 901: 900}
    assert components.components(links.limit(0)).count() == 0


def test_near_duplicates_of_odd_ids_and_of_nothing(spark):
    docs = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (None, "x y z"), (9, "x y z")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == [("4", "4"), ("4", "4"), ("9", "None"), ("None", "None")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    docs = spark.createDataFrame([(4, "a b c d", 1), (4, "a b c d", 1), (2, "a b c d", 2), (8, "other words here", 3), (None, None, 4)], "doc_id long, text string, row int")
    got = sorted((str(r.doc_id), r.row) for r in simhash.drop_near_duplicates(docs).collect())
    assert got == [("2", 2), ("8", 3), ("None", 4)]


# ------------------------------------------------------------------ suffix arrays


def plain_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    places = defaultdict(list)
    for d, b in enumerate(data):
        for i in range(len(b) - length + 1):
            places[b[i : i + length]].append((d, i))
    gone = [bytearray(len(b)) for b in data]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d][i : i + length] = b"\1" * length
    out = []
    for b, g in zip(data, gone, strict=True):
        runs = sum(1 for i in range(len(g)) if g[i] and (not i or not g[i - 1]))
        out.append((len(b), sum(g), runs, hashlib.sha256(bytes(c for c, x in zip(b, g, strict=True) if not x)).hexdigest()))
    return out


def sample(seed):
    rng = random.Random(seed)
    word = lambda k=6: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, k)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(4)]
    texts = ["", None, "a" * 700, "ab" * 300, "ab" * 301, passages[0], passages[0], "x" * 39]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(25))) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passages)[rng.randrange(30) :])
        texts.append(" ".join(parts))
    edited = list(texts[-1] * 3)
    for _ in range(5):
        edited[rng.randrange(len(edited))] = "#"
    return [*texts, "".join(edited), texts[-1] * 3]


def test_suffix_order():
    rng = random.Random(2)
    for text in (b"", b"a", b"aaaa", b"mississippi", b"abab" * 9, bytes(rng.choice(b"abc") for _ in range(400)), bytes(range(256)) * 2):
        assert suffix_dedup.two_stage_suffix_array(text, len(text) + 1) == sorted(range(len(text)), key=lambda i: text[i:])


def test_hashes_of_equal_strings_are_equal():
    data = np.frombuffer(b"0123456789" * 9, np.uint8)
    for length in (1, 7, 32, 40):
        h = suffix_dedup.string_hashes(data, length, 1)
        assert len(h) == len(data) - length + 1 and (h[:-10] == h[10:]).all() and len(set(h.tolist())) == 10
    x = np.random.default_rng(1).integers(0, 50, 300)
    assert suffix_dedup.sliding_min(x, 37).tolist() == [x[i : i + 37].min() for i in range(264)]


def check(spark, texts, length, gram, most):
    got = suffix_dedup.remove_repeats(frame(spark, texts), length, gram, most).collect()
    want = plain_removal(texts, length)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == dict(enumerate(want))


def test_removal_by_brute_force(spark):
    check(spark, sample(1), 40, 8, 1 << 19)


def test_crowded_groups_by_brute_force(spark):
    check(spark, sample(2), 40, 8, 300)


def test_blocks_by_brute_force(spark, monkeypatch):
    texts = sample(3)
    whole = [suffix_dedup.value_runs(np.frombuffer((t or "").encode(), np.uint8), 40, 8) for t in texts]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    for t, (a, _, v, _) in zip(texts, whole, strict=True):
        a2, b2, v2, _ = suffix_dedup.value_runs(np.frombuffer((t or "").encode(), np.uint8), 40, 8)
        assert set(a) <= set(a2) and [v[np.searchsorted(a, x, "right") - 1] for x in a2] == v2
        assert all(x <= y for x, y in zip(a2, b2, strict=True))


def test_removal_on_the_documents(spark, sf_dir):
    texts = [r.text for r in table(spark, sf_dir, "documents").orderBy("doc_id").collect()]
    check(spark, texts, 400, 32, 1 << 19)


def test_removal_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a" * 500), (3, "b" * 10), (3, "c" * 900), (3, "c" * 900)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == [("3", 0, 0), ("3", 900, 1), ("3", 900, 1), ("None", 500, 1)]
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ near copies by Jaccard similarity


def plain_sets(texts):
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        out.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def plain_groups(texts):
    sets = plain_sets(texts)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 9 * len(a & b) >= 4 * (len(a) + len(b)) and (a or not b) and (b or not a):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def edited_texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    line = " ".join(f"common{i}" for i in range(12))
    texts = ["", None, " \t", "one", "ONE", "a b c d e", "a b c d e f"]
    for size in (20, 60, 200, 900):
        for _ in range(4):
            words = rng.choices(vocabulary, k=size)
            for edits in (0, 0, 1, 2, 3, 5, size // 40, size // 25):
                copy = list(words)
                for _ in range(edits):
                    at = rng.randrange(len(copy))
                    copy[at : at + rng.randrange(2)] = [rng.choice(vocabulary)]
                texts.append(" ".join(copy) + (f" {line}" if rng.random() < 0.5 else ""))
    rng.shuffle(texts)
    return texts


def test_near_copies_by_brute_force(spark, sf_dir, monkeypatch):
    for seed, common in ((1, np.zeros(0, np.uint64)), (2, None)):
        texts = edited_texts(seed) + ([r.text for r in table(spark, sf_dir, "documents").collect()] if seed == 1 else [])
        if common is None:  # any set of shingles may go behind the others
            common = np.unique(np.concatenate([jaccard.shingle_set(t)[::3] for t in texts]))
        monkeypatch.setattr(jaccard, "common_shingles", lambda texts, width, c=common: c)
        rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
        want = plain_groups(texts)
        # As it is; with crowded keys; with components beyond what is gathered, in several chunks.
        for bounds in ({}, {"crowd": 3}, {"crowd": 3, "gathered": 60, "chunk": 700}):
            got = {r.row: r.component_id for r in jaccard.near_copies(rows, **bounds).collect()}
            assert [got[i] for i in range(len(texts))] == want


def test_pipeline_drops_copies_that_differ_by_more_than_two_bits(spark, sf_dir):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join([*words[:50], "other", *words[51:]]), " ".join([*words[:20], "x", *words[21:40], "y", *words[41:60], "z", *words[61:]])]
    assert (plain_fingerprint(texts[0]) ^ plain_fingerprint(texts[1])).bit_count() > 2
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, texts), sf_dir).collect()) == [0, 2]


def test_near_copies_come_from_fingerprints_first(spark, monkeypatch):
    rng = random.Random(8)
    texts = edited_texts(4)
    for _ in range(12):  # long texts with one word changed: few bits differ
        words = [f"w{rng.randrange(5000)}" for _ in range(900)]
        texts += [" ".join(words), " ".join([*words[:400], "other", *words[401:]])]
    # With no keys only fingerprints can find anything.
    monkeypatch.setattr(jaccard, "common_shingles", lambda texts, width: np.zeros(0, np.uint64))
    monkeypatch.setattr(jaccard, "keys_of", lambda found, common, least: found[:0])
    fps = [jaccard.majority_bits(jaccard.shingle_set(t)) for t in texts]
    sets, bits = plain_sets(texts), plain_components(list(range(len(texts))), fps, jaccard.NEAR_BITS)
    near = {(i, j) for i in bits for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= jaccard.NEAR_BITS and sets[i] != sets[j]}
    assert sum(9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) for i, j in near) > 5
    got = {r.row: r.component_id for r in jaccard.near_copies(spark.createDataFrame(list(enumerate(texts)), "row long, text string")).collect()}
    for i, j in near:
        if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
            assert got[i] == got[j]
    # What fingerprints alone connect is still held to true similarity.
    assert all(bits[i] == bits[got[i]] for i in bits if sets[i] != sets[got[i]])


def test_runs_over_batches():
    rng = random.Random(3)
    keys = sorted(rng.choices(range(40), k=300))
    for size in (1, 2, 7, 50, 1000):
        batches = [pa.RecordBatch.from_pydict({"key": keys[i : i + size], "place": list(range(i, min(i + size, 300)))}) for i in range(0, 300, size)]
        parts = [t.to_pydict() for t in jaccard._runs(iter(batches))]
        assert [p for t in parts for p in t["place"]] == list(range(300))
        assert sum(len(set(t["key"])) for t in parts) == len(set(keys))


def colliding(length=400):
    """Two strings that agree in every polynomial with an odd base modulo 2 ** 64, whatever the base."""
    product = np.array([1], np.int64)
    for n in (1, 2, 4, 8, 16, 32, 64, 128, 128):
        factor = np.zeros(n + 1, np.int64)
        factor[0], factor[n] = -1, 1
        product = np.convolve(product, factor)
    product *= 4
    a, b = (np.full(length, ord("a"), np.int64) for _ in range(2))
    a[: len(product)] += np.maximum(product, 0)
    b[: len(product)] += np.maximum(-product, 0)
    a[-16:], b[-16:] = ord("h"), ord("h")
    return "".join(map(chr, a)), "".join(map(chr, b))


def test_strings_that_collide_are_no_repeats(spark):
    a, b = colliding()
    assert len(a) == len(b) == 400 and a != b
    x, y = (np.frombuffer(t.encode(), np.uint8) for t in (a, b))
    for seed in (1, 2):
        assert (suffix_dedup.string_hashes(x, 400, seed) == suffix_dedup.string_hashes(y, 400, seed)).all()
    bases = suffix_dedup.drawn_bases()
    assert not any((p == q).all() for p, q in zip(suffix_dedup.fingerprints(x, 400, bases), suffix_dedup.fingerprints(y, 400, bases), strict=True))
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("bcdfgjkl") for _ in range(n))
    for most in (suffix_dedup.MOST_BYTES, 1):
        rows = [(0, a), (1, b)] + [(i, noise(250) + a[:300] + noise(250)) for i in range(2, 1502)]
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), most_bytes=most)
        assert got.filter("n_removed > 0").count() == 0


def test_fingerprints_are_polynomials_modulo_the_prime():
    data = np.random.default_rng(1).integers(0, 256, 700).astype(np.uint8)
    bases = (5, 2**31 - 3, 123456789, 7)
    for length in (1, 8, 31, 400):
        h, g = (x.view(np.uint64) for x in suffix_dedup.fingerprints(data, length, bases))
        for at in (0, 17, 700 - length):
            want = [0, 0, 0, 0]
            for byte in data[at : at + length].tolist():
                want = [(v * k + byte) % (2**31 - 1) for v, k in zip(want, bases, strict=True)]
            assert [int(h[at] >> 32), int(h[at]) & 0xFFFFFFFF, int(g[at] >> 32), int(g[at]) & 0xFFFFFFFF] == want
        assert len(h) == 701 - length


def test_op10_shows_passages_shorter_than_its_strings(spark, tmp_path):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(51)
    rows = [text(40) + f"  {passage}\n" + text(30), text(9) + f" {passage} " + text(90), text(120), passage[3:] + " " + text(60), None]
    assert len(passage) < 400
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_removed, r.shares_passage) for r in queries.op10_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (0, False), 3: (0, False), 4: (0, False)}


def test_parts_of_words_by_brute_force(monkeypatch):
    rng = random.Random(1)
    bases = suffix_dedup.drawn_bases()
    for _ in range(60):
        texts = ["".join(rng.choice(["a", "bé", "ccc", " ", "  ", "\n", "\t", "\x0b", "\x1c", "x" * 70, "x" * 71]) for _ in range(rng.randrange(60))).encode() for _ in range(rng.randrange(1, 6))]
        monkeypatch.setattr(suffix_dedup, "BLOCK", rng.choice([8, 64, 1 << 18]))
        got, numbers = [[] for _ in texts], {}
        for step in (1, 3):
            monkeypatch.setattr(suffix_dedup, "STEP", step)
            got = [[] for _ in texts]
            for part in suffix_dedup.word_parts(texts, 9):
                data, starts, ends, owner = part
                at = np.flatnonzero(owner >= 0)
                for i, *pair in zip(at.tolist(), *(c.tolist() for c in suffix_dedup.word_fingerprints(part, at, 9, bases)), strict=True):
                    window = bytes(data[starts[i] : ends[i + 8]])
                    got[owner[i]].append(window)
                    assert numbers.setdefault((step, window), pair) == pair
            split = [[w if len(w) <= 64 else b"\xff" + hashlib.sha256(w).hexdigest().encode() for w in t.split()] for t in texts]
            assert got == [[b" ".join(w[i : i + 9]) for i in range(len(w) - 8)] for w in split]
        assert len({(s, *p) for (s, _), p in numbers.items()}) == len(numbers)
