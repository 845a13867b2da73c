"""SimHash near-duplicates through tables of distances to pivots.

Fingerprint: lower-case A-Z, words between ASCII white space, shingles of words joined by one
space; a bit is 1 if it is 1 in over half the shingles' XXH64 values. Fingerprints link at
``most_bits`` or fewer differing bits.

Pivots are reference fingerprints. The distances of a fingerprint to the zero pivot and to 32
pivots with two neighbouring bits each give, by a sum and a difference, its 32 *coordinates*
(0 to 2). Two fingerprints that differ in d bits differ by at most d over all coordinates, so of
d + 2 groups of coordinates at least two agree, and each pair of groups is a join key: no link is
missed, whatever ``most_bits``. With two bits these are four groups of eight and six keys; with
more, keys are more and tell less. Among the fingerprints of a key, pairs whose largest difference
of distance to the scattered pivots is over ``most_bits`` are discarded, and only the rest are
compared bit by bit.

Copies with one fingerprint are one class before any pair is made. Within a key, links are
reduced to a spanning forest in the task, so rows grow with fingerprints and not with pairs.
A key of more than ``split_over`` fingerprints is split: of ``most_bits`` + 1 further groups, made of
the coordinates outside the key, at least one must agree as well.

Null, empty and blank texts have fingerprint zero and link like any other; fewer words than a
shingle are one shingle; rows with the same doc_id are each returned; a null doc_id counts as
smaller than any other and is returned as null.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kaptura.llm.common import few_rows, shuffle_partitions, stored
from kaptura.llm.components import components

SHINGLE, MOST_BITS, SEED = 3, 2, 42
N_COORDINATES = 32
#: Scattered pivots: as many as make a chance survivor rare.
N_SCATTERED = 24
_NULL_ID = -(1 << 63)


def shingle_hashes(text: str | None, width: int = SHINGLE) -> list[int]:
    words = text.encode().lower().split() if text else []
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, SEED)]
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    return majority_bits(np.array(shingle_hashes(text, width), np.uint64))


def majority_bits(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded however long the text
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def pivots() -> tuple[np.ndarray, np.ndarray]:
    """The two-bit pivots, and the scattered ones (a fixed sequence of random bits)."""
    pairs = np.array([3 << (2 * i) for i in range(N_COORDINATES)], np.uint64)
    return pairs, np.random.default_rng(20).integers(0, 1 << 64, N_SCATTERED, np.uint64)


def coordinates(fps: np.ndarray) -> np.ndarray:
    """From distances to the zero pivot z and to each pair pivot p: (z + 2 - p) / 2."""
    pairs, _ = pivots()
    zero = popcount(fps).astype(np.int16)
    return ((zero[:, None] + 2 - popcount(fps[:, None] ^ pairs[None, :])) >> 1).astype(np.uint8)


def group_codes(coords: np.ndarray, members: list[np.ndarray]) -> list[np.ndarray]:
    """Each group's coordinates as one number in base 3."""
    return [coords[:, m].astype(np.int64) @ (3 ** np.arange(len(m), dtype=np.int64)) for m in members]


def group_pairs(most_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The coordinates of each pair of groups, and those outside it."""
    groups = np.array_split(np.arange(N_COORDINATES), most_bits + 2)
    inside = [np.concatenate(p) for p in itertools.combinations(groups, 2)]
    return [(p, np.setdiff1d(np.arange(N_COORDINATES), p)) for p in inside]


def _keys(fps: np.ndarray, most_bits: int) -> Iterator[np.ndarray]:
    """A key of each fingerprint for each pair of groups; the pair is the key's remainder."""
    pairs, coords = group_pairs(most_bits), coordinates(fps)
    for n, code in enumerate(group_codes(coords, [inside for inside, _ in pairs])):
        yield code * len(pairs) + n


def _split_keys(fps: np.ndarray, key: np.ndarray, most_bits: int) -> Iterator[np.ndarray]:
    """Finer keys, from 1 on, for each fingerprint of a crowded key, from coordinates outside it."""
    pairs, coords, parts = group_pairs(most_bits), coordinates(fps), most_bits + 1
    finer = np.zeros((parts, len(fps)), np.int64)
    for n, (_, rest) in enumerate(pairs):
        here = np.flatnonzero(key % len(pairs) == n)
        for s, code in enumerate(group_codes(coords[here], np.array_split(rest, parts))):
            finer[s, here] = code * parts + s + 1
    yield from finer


def _forest(fps: np.ndarray, ids: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of one key."""
    n = len(fps)
    table = popcount(fps[:, None] ^ pivots()[1][None, :]).astype(np.int8)
    parent, links = np.arange(n), []
    for step in range(1, n):
        a = np.arange(n - step)
        open_ = parent[a] != parent[a + step]
        a = a[open_]
        if not len(a):
            continue
        near = np.ones(len(a), np.bool_)
        for p in range(0, N_SCATTERED, 8):  # eight pivots at a time, on what is left
            left = a[near]
            near[near] = np.abs(table[left, p : p + 8] - table[left + step, p : p + 8]).max(axis=1) <= most_bits
        a = a[near]
        a = a[popcount(fps[a] ^ fps[a + step]) <= most_bits]
        for i in a.tolist():
            x, y = i, i + step
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((int(ids[i]), int(ids[i + step])))
        if len(a):
            while not np.array_equal(up := parent[parent], parent):
                parent = up
    return links


def _linked(batches: Iterator[pa.RecordBatch], most_bits: int) -> Iterator[pa.RecordBatch]:
    """Links within runs of rows (key, sub, fp, rep) that are sorted by key and sub."""
    held: list[list[np.ndarray]] = []  # parts of a run that may go on in the next batch

    def out(cols) -> pa.RecordBatch | None:
        key, sub, fp, rep = cols
        if not len(key):
            return None
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
        edges = np.concatenate(([0], cuts, [len(key)]))
        sizes = np.diff(edges)
        links: list[tuple[int, int]] = []
        fps = fp.view(np.uint64)
        two = edges[:-1][sizes == 2]  # most keys have one or two: those pairs at once
        if len(two):
            _, scattered = pivots()
            apart = np.abs(popcount(fps[two, None] ^ scattered).astype(np.int8) - popcount(fps[two + 1, None] ^ scattered).astype(np.int8)).max(axis=1)
            two = two[apart <= most_bits]
            two = two[popcount(fps[two] ^ fps[two + 1]) <= most_bits]
            links += zip(rep[two].tolist(), rep[two + 1].tolist(), strict=True)
        for g in np.flatnonzero(sizes > 2):
            links += _forest(fps[edges[g] : edges[g + 1]], rep[edges[g] : edges[g + 1]], most_bits)
        if not links:
            return None
        a, b = zip(*links, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        goes_on = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        if held and goes_on.all() and (held[0][0][0], held[0][1][0]) == (cols[0][0], cols[1][0]):
            held.append(cols)
            continue
        size = sum(len(part[0]) for part in held)
        cols = [np.concatenate(x) for x in zip(*held, cols, strict=True)]
        whole = size + int((~goes_on).sum())
        got, held = out([c[:whole] for c in cols]), [[c[whole:] for c in cols]]
        if got is not None:
            yield got
    if held and (got := out([np.concatenate(x) for x in zip(*held, strict=True)])) is not None:
        yield got


def fingerprint_links(classes: DataFrame, most_bits: int = MOST_BITS, split_over: int = 1024) -> DataFrame:
    """Links (a, b) that connect the classes (fp, rep) as all pairs within ``most_bits`` would."""
    if not 0 <= most_bits < N_COORDINATES - 1:
        raise ValueError(f"a group has at least one of {N_COORDINATES} coordinates")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for key in _keys(fp.view(np.uint64), most_bits):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(rep)], names=["key", "fp", "rep"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, rep = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for sub in _split_keys(fp.view(np.uint64), key, most_bits):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sub), pa.array(fp), pa.array(rep)], names=["key", "sub", "fp", "rep"])

    rows = classes.select("fp", "rep").mapInArrow(keyed, "key long, fp long, rep long")
    sizes = rows.groupBy("key").count().filter("count > 1")
    sizes = stored(sizes.select("key", (F.col("count") > split_over).alias("crowded")), "simhash-keys")
    shared = rows.join(sizes, "key")
    crowded = shared.filter("crowded").select("key", "fp", "rep").mapInArrow(split, "key long, sub long, fp long, rep long")
    plain = shared.filter("not crowded").select("key", F.lit(0).cast("long").alias("sub"), "fp", "rep")
    dealt = plain.unionByName(crowded).repartition(shuffle_partitions(classes.sparkSession), "key", "sub").sortWithinPartitions("key", "sub")
    return dealt.mapInArrow(lambda batches: _linked(batches, most_bits), "a long, b long")


def near_duplicates(docs: DataFrame, most_bits: int = MOST_BITS, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long), component_id: the smallest doc_id reachable, itself included."""
    marked = stored(fingerprints(docs, width), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(_NULL_ID))).alias("rep")), "classes")
    found = components(fingerprint_links(classes, most_bits))
    roots = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = marked.join(roots, "fp")
    return out.select("doc_id", "fp", F.nullif("component_id", F.lit(_NULL_ID)).alias("component_id"))


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def numbered_rows(docs: DataFrame) -> DataFrame:
    """doc (all columns), row (a number of its own), written down once."""
    return stored(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")


def first_of_groups(numbered: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of each group (row, component_id), with all its columns: that of the smallest doc_id
    (null first), of equal ones the first written."""
    known = stored(groups.join(numbered.select("row", F.col("doc.doc_id").alias("id")).hint("merge"), "row"), "groups")
    # The least of each group is taken partly in each task; nothing is joined by group.
    kept = known.groupBy("component_id").agg(F.min(F.struct("id", "row"))["row"].alias("row"))
    gone = stored(known.select("row").join(kept.select("row").hint("merge"), "row", "left_anti"), "gone")
    # Beyond what may be broadcast the documents move.
    return numbered.join(F.broadcast(gone) if few_rows(gone) else gone, "row", "left_anti").select("doc.*")


def drop_near_duplicates(docs: DataFrame, most_bits: int = MOST_BITS, width: int = SHINGLE) -> DataFrame:
    """One row of each group, with all its columns: that of the smallest doc_id (null first), of
    equal ones the first written."""
    numbered = numbered_rows(docs)
    rows = numbered.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))
    return first_of_groups(numbered, near_duplicates(rows, most_bits, width).select(F.col("doc_id").alias("row"), "component_id"))
