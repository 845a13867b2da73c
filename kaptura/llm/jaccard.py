"""Near copies by the Jaccard similarity of their sets of word shingles, all of them.

First come SimHash fingerprints of the sets and their tables of distances to pivots: texts within
``NEAR_BITS`` differing bits are candidates. As two texts of similarity 4/5 differ in ten bits on average
and no number of bits is a bound, what fingerprints leave is found by keys.

A text's set holds the XXH64 values of its shingles (words as for SimHash). Two sets of similarity
4/5 or more share over four fifths of each, so they share one of the first n - ceil(4n/5) + 1
shingles of each in any order that holds for all texts: these are a text's *keys*, and no pair is
missed. The order is that of the hashes, with shingles behind all others that are common in a
sample; the sample decides how many texts meet in a key, never which pairs are found.

Texts of a key are compared by a table of 64 counts each (for long texts one count for 4 to 8
shingles), of the shingles that fall to each of 64 or more reference sets: the differences add up
to no more than the sets' symmetric difference, which at 4/5 is at most a ninth of both sizes.
Pairs beyond that are discarded, those that fingerprints have connected aren't compared; the rest leave
the task as a spanning forest, so rows grow with texts and not with pairs. The texts of a component of these links then meet in one task, once
each, and only pairs of true similarity 4/5 or more link.

Nothing is gathered that grows with the table. A key of more than ``CROWD`` texts is dealt to
blocks of texts of like size; besides each block's forest, its texts are linked to the key's first
one, which joins more than is similar but misses nothing. A component of more than ``GATHERED``
shingles isn't gathered either: the links of its forests are verified one by one, which gives its
clusters, and the texts outside its largest cluster are compared with all of it, a chunk of
bounded size at a time. Two texts inside the largest cluster are connected already, so no link
between clusters is missed.

Texts of equal sets are one class before any pair is made. Null, empty and blank texts have the
empty set, which is like itself only; fewer words than a shingle are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kaptura.llm.common import few_rows, shuffle_partitions, stored
from kaptura.llm.components import components
from kaptura.llm.simhash import fingerprint_links, first_of_groups, majority_bits, numbered_rows, shingle_hashes

#: Words of a shingle, and the least similarity as a fraction.
WIDTH, LEAST = 5, (4, 5)
N_COUNTS = 64
#: Differing bits of fingerprints that are candidates; with more, the pivots' keys hardly tell texts apart.
NEAR_BITS = 3
#: A shingle found in so many texts of the sample goes behind all others.
SAMPLED, COMMON, MOST_COMMON = 1 / 64, 16, 200_000
#: Texts of a key that one task compares, and shingles of a component or chunk that one task holds.
CROWD, GATHERED, CHUNK = 2048, 1 << 22, 1 << 20


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted and without repeats."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def keys_of(found: np.ndarray, common: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """The shingles of a set of which any set that is similar enough shares one among its own."""
    if not len(found):
        return found
    n = len(found) + (-least[0] * len(found) // least[1]) + 1
    if len(common):
        last = common[np.minimum(common.searchsorted(found), len(common) - 1)] == found
        found = np.concatenate((found[~last], found[last]))
    return found[:n]


def counts_of(found: np.ndarray) -> np.ndarray:
    """Shingles in each reference set, 255 at most: a cut that never adds to a difference."""
    parts = max(N_COUNTS, 1 << max(0, (len(found) // 4).bit_length() - 1))
    return np.minimum(np.bincount((found & np.uint64(parts - 1)).astype(np.int64), minlength=parts), 255).astype(np.uint8)


def folded(counts: np.ndarray, parts: int = N_COUNTS) -> np.ndarray:
    """The counts that fewer reference sets give."""
    return np.minimum(counts.reshape(-1, parts).sum(axis=0, dtype=np.int64), 255).astype(np.uint8)


class Counts:
    """The counts of some texts, and their first comparison as one matrix."""

    def __init__(self, whole: list[np.ndarray]):
        self.whole, self.few = whole, np.array([folded(c) for c in whole], np.uint8).reshape(-1, N_COUNTS)

    def of(self, rows: np.ndarray) -> Counts:
        out = Counts.__new__(Counts)
        out.whole, out.few = [self.whole[i] for i in rows.tolist()], self.few[rows]
        return out

    def with_one(self, more: np.ndarray) -> Counts:
        out = Counts.__new__(Counts)
        out.whole, out.few = [*self.whole, more], np.vstack((self.few, folded(more)))
        return out

    def apart(self, i: int, j: int) -> int:
        x, y = self.whole[i], self.whole[j]
        parts = min(len(x), len(y))
        x, y = folded(x, parts), folded(y, parts)
        return int((np.maximum(x, y) - np.minimum(x, y)).sum(dtype=np.int64))


def _may_be_similar(n: np.ndarray, counts: Counts, a: np.ndarray, b: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Which pairs of rows the sizes and counts leave open."""
    p, q = least
    open_ = np.flatnonzero((q + p) * np.abs(n[a] - n[b]) <= (q - p) * (n[a] + n[b]))
    apart = np.zeros(len(open_), np.int64)
    for at in range(0, N_COUNTS, 16):  # sixteen at a time, on what is left
        x, y = counts.few[a[open_], at : at + 16], counts.few[b[open_], at : at + 16]
        apart = apart + (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)
        near = (q + p) * apart <= (q - p) * (n[a[open_]] + n[b[open_]])
        open_, apart = open_[near], apart[near]
    long = np.minimum(n[a[open_]], n[b[open_]]) >= 8 * N_COUNTS
    keep = [not more or (q + p) * counts.apart(i, j) <= (q - p) * (n[i] + n[j]) for more, i, j in zip(long.tolist(), a[open_].tolist(), b[open_].tolist(), strict=True)]
    out = np.zeros(len(a), np.bool_)
    out[open_[np.array(keep, np.bool_)]] = True
    return out


def _forest(rep: np.ndarray, n: np.ndarray, counts: Counts, near: np.ndarray, least: tuple[int, int]) -> list[tuple[int, int]]:
    """A spanning forest of the open pairs among the classes of one key; those of one ``near`` are connected already."""
    order = np.lexsort((rep, n))
    rep, n, counts = rep[order], n[order], counts.of(order)
    p, q = least
    _, first, of = np.unique(near[order], return_index=True, return_inverse=True)
    parent, links = first[of], []
    for step in range(1, len(rep)):
        a = np.arange(len(rep) - step)
        if not ((q + p) * (n[step:] - n[:-step]) <= (q - p) * (n[step:] + n[:-step])).any():
            break  # sizes are in order: pairs further apart differ more
        a = a[parent[a] != parent[a + step]]
        if not len(a):
            if (parent == parent[0]).all():
                break
            continue
        a = a[_may_be_similar(n, counts, a, a + step, least)]
        for i in a.tolist():
            x, y = i, i + step
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((int(rep[i]), int(rep[i + step])))
        if len(a):
            while not np.array_equal(up := parent[parent], parent):
                parent = up
    return links


def similar_groups(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> list[int]:
    """For each set the first one it is connected with by pairs of similarity ``least`` or more."""
    p, q = least
    n, counts = np.array([len(s) for s in sets], np.int64), Counts([counts_of(s) for s in sets])
    root, left = [0] * len(sets), np.arange(len(sets))
    while len(left):
        first, left = int(left[0]), left[1:]
        root[first], reached = first, [first]
        while reached and len(left):
            at = reached.pop()
            near = left[_may_be_similar(n, counts, np.full(len(left), at), left, least)]
            near = near[n[near] > 0] if n[at] else near
            if not len(near):
                continue
            if n[at]:
                ends = np.cumsum(n[near])
                both = np.concatenate([sets[i] for i in near])
                shared = np.add.reduceat(sets[at][np.minimum(sets[at].searchsorted(both), n[at] - 1)] == both, ends - n[near], dtype=np.int64)
                near = near[(p + q) * shared >= p * (n[near] + n[at])]
            for i in near.tolist():
                root[i] = first
            reached += near.tolist()
            left = left[~np.isin(left, near)] if len(near) else left
    return root


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, so that no value of it is spread over two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        begin = int(key.searchsorted(key[-1]))  # the last run may go on in the next batch
        new = not held or held[-1].column(0)[0].as_py() != int(key[0])
        if held and (new or begin):
            yield pa.Table.from_batches(held if new else [*held, batch.slice(0, int(key.searchsorted(key[0], "right")))])
            done = 0 if new else int(key.searchsorted(key[0], "right"))
            held = []
        else:
            done = 0
        if begin > done:
            yield pa.Table.from_batches([batch.slice(done, begin - done)])
        held.append(batch.slice(max(begin, done) if not held else 0))
        held = [b for b in held if b.num_rows]
    if held:
        yield pa.Table.from_batches(held)


def common_shingles(texts: DataFrame, width: int = WIDTH) -> np.ndarray:
    """Shingles that many texts hold, by a sample; they only change the order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, width).view(np.int64))], names=["key"])

    counted = texts.select("text").sample(SAMPLED, seed=1).mapInArrow(run, "key long").groupBy("key").count()
    rows = counted.filter(F.col("count") >= COMMON).orderBy(F.desc("count")).limit(MOST_COMMON).collect()
    return np.sort(np.array([r.key for r in rows], np.int64).view(np.uint64))


def shingle_sets(texts: DataFrame, common: np.ndarray, width: int = WIDTH, least: tuple[int, int] = LEAST) -> DataFrame:
    """row, class (the set's hash), n, fp (its fingerprint), counts and keys of every row (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            classes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            fps = np.array([majority_bits(s) for s in sets], np.uint64).view(np.int64)
            keys = [keys_of(s, common, least).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(classes), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), pa.array([counts_of(s).tobytes() for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["row", "class", "n", "fp", "counts", "keys"],
            )

    return texts.select("row", "text").mapInArrow(run, "row long, class long, n long, fp long, counts binary, keys array<long>")


def near_fingerprints(classes: DataFrame, most_bits: int = NEAR_BITS) -> DataFrame:
    """Links (a, b) of classes (rep, fp) that connect all whose fingerprints differ in ``most_bits`` or fewer."""
    heads = stored(classes.groupBy("fp").agg(F.min("rep").alias("rep")), "fingerprints")
    same = classes.select("fp", F.col("rep").alias("b")).join(heads.select("fp", F.col("rep").alias("a")).hint("merge"), "fp").filter("a <> b")
    return fingerprint_links(heads, most_bits).unionByName(same.select("a", "b"))


def _open_links(batches: Iterator[pa.RecordBatch], least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Links within the runs of rows (key, rep, n, counts, near), of which no run is long."""
    for part in _runs(batches):
        key, rep, n = (part.column(i).to_numpy() for i in range(3))
        near = part.column(4).to_numpy()
        counts = Counts([np.frombuffer(c, np.uint8) for c in part.column(3).to_pylist()])
        edges = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        sizes = np.diff(edges)
        two = edges[:-1][sizes == 2]  # most keys have two: those pairs at once
        two = two[near[two] != near[two + 1]]
        two = two[_may_be_similar(n, counts, two, two + 1, least)]
        links = list(zip(rep[two].tolist(), rep[two + 1].tolist(), strict=True))
        for g in np.flatnonzero(sizes > 2):
            x, y = edges[g], edges[g + 1]
            links += _forest(rep[x:y], n[x:y], counts.of(np.arange(x, y)), near[x:y], least)
        a, b = zip(*set(links), strict=True) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _settled(batches: Iterator[pa.RecordBatch], width: int, least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """rep, root of rows (component, rep, text) in order."""
    for part in _runs(batches):
        of = part.column(0).to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]))
        rep, roots = part.column(1).to_numpy(), []
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            sets = [shingle_set(t, width) for t in part.column(2).slice(x, y - x).to_pylist()]
            roots += [int(rep[x + i]) for i in similar_groups(sets, least)]
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(roots, pa.int64())], names=["rep", "root"])


def similar(x: np.ndarray, y: np.ndarray, least: tuple[int, int]) -> bool:
    """Whether two sets, not both empty, are of similarity ``least`` or more."""
    p, q = least
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return (p + q) * shared >= p * (len(x) + len(y)) and shared > 0


def _verified(edges: DataFrame, texts: DataFrame, width: int, least: tuple[int, int]) -> DataFrame:
    """The links (a, b) of truly similar texts (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(shingle_set(x, width), shingle_set(y, width), least) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    one = texts.select(F.col("row").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("row").alias("b"), F.col("text").alias("y"))
    return edges.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _across(batches: Iterator[pa.RecordBatch], width: int, least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Links between clusters, of rows (component, chunk, minor, node, cluster, text) in order: a
    chunk's texts come first, then the texts that are compared with it, a batch at a time."""
    where, nodes, clusters, sets, counts, n = None, [], [], [], None, None

    def links(minors: pa.RecordBatch) -> set[tuple[int, int]]:
        nonlocal counts, n
        if counts is None:
            counts, n = Counts([counts_of(s) for s in sets]), np.array([len(s) for s in sets], np.int64)
        found: set[tuple[int, int]] = set()
        of, at = np.array(clusters, np.int64), np.arange(len(sets))
        for node, cluster, text in zip(*(minors.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
            own = shingle_set(text, width)
            both = counts.with_one(counts_of(own))
            rest = at[of != cluster]
            size = np.append(n, len(own))
            for i in rest[_may_be_similar(size, both, np.full(len(rest), len(n)), rest, least)].tolist():
                pair = (min(cluster, clusters[i]), max(cluster, clusters[i]))
                if pair not in found and nodes[i] != node and similar(own, sets[i], least):
                    found.add(pair)
        return found

    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        out: set[tuple[int, int]] = set()
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if x == y:
                continue
            part = batch.slice(x, y - x)
            if keys[x][:2] != where:
                where, nodes, clusters, sets, counts = keys[x][:2], [], [], [], None
            if keys[x][2]:
                out |= links(part) if sets else set()
                continue
            nodes += part.column(3).to_pylist()
            clusters += part.column(4).to_pylist()
            sets += [shingle_set(t, width) for t in part.column(5).to_pylist()]
        a, b = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _settled_in_chunks(large: DataFrame, links: DataFrame, texts: DataFrame, width: int, least: tuple[int, int], chunk: int) -> DataFrame:
    """rep, root of the nodes of components (node, component, total) too large to gather."""
    n = shuffle_partitions(texts.sparkSession)
    inside = links.join(large.select(F.col("node").alias("a")), "a", "left_semi").groupBy("b").agg(F.min("a").alias("a"))
    found = components(_verified(inside.select("a", "b"), texts, width, least)).select("node", F.col("component").alias("cluster"))
    labelled = stored(large.join(found, "node", "left").withColumn("cluster", F.coalesce("cluster", "node")), "clusters")
    sizes = labelled.groupBy("component", "cluster").count()
    largest = sizes.groupBy("component").agg(F.max_by("cluster", F.struct("count", "cluster")).alias("largest"))
    with_text = labelled.join(largest, "component").join(texts.select(F.col("row").alias("node"), "text"), "node")
    chunks = F.ceil(F.col("total") / chunk).cast("int")
    every = with_text.select("component", F.pmod(F.xxhash64("node"), chunks).cast("int").alias("chunk"), F.lit(False).alias("minor"), "node", "cluster", "text")
    minors = with_text.filter("cluster <> largest").select("component", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(True).alias("minor"), "node", "cluster", "text")
    dealt = every.unionByName(minors).repartition(n, "component", "chunk").sortWithinPartitions("component", "chunk", "minor")
    across = dealt.mapInArrow(lambda batches: _across(batches, width, least), "a long, b long")
    joined = components(across.unionByName(labelled.filter("node <> cluster").select(F.col("node").alias("a"), F.col("cluster").alias("b"))))
    return joined.select(F.col("node").alias("rep"), F.col("component").alias("root"))


def near_copies(texts: DataFrame, width: int = WIDTH, least: tuple[int, int] = LEAST, crowd: int = CROWD, gathered: int = GATHERED, chunk: int = CHUNK) -> DataFrame:
    """row, component_id (the smallest row reachable) of every row of ``texts`` (row, text; row unique)."""
    spark = texts.sparkSession
    n = shuffle_partitions(spark)
    sets = stored(shingle_sets(texts, common_shingles(texts, width), width, least), "shingle-sets")
    first = [F.first(c).alias(c) for c in ("n", "fp", "counts", "keys")]
    classes = stored(sets.groupBy("class").agg(F.min("row").alias("rep"), *first), "shingle-classes")
    alike = stored(near_fingerprints(classes.select("rep", "fp")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "fingerprint-links")
    near = stored(components(alike).select(F.col("node").alias("rep"), F.col("component").alias("near")), "fingerprint-groups")
    keyed = classes.select(F.explode("keys").alias("key"), "rep", "n")
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("texts"), F.min("rep").alias("head")).filter("texts > 1"), "shared-keys")
    # Merged by hint at every size: what a small table would broadcast grows with the input.
    met = stored(keyed.join(shared.hint("merge"), "key"), "key-members")
    # Texts of up to a quarter more words share a block of a crowded key, in as many parts as it needs.
    like = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)))
    block = F.when(F.col("texts") <= crowd, F.lit(0).cast("long")).otherwise(F.xxhash64(like, F.pmod(F.xxhash64("rep"), F.ceil(F.col("texts") / crowd))))
    known = classes.select("rep", "n", "counts").join(F.broadcast(near) if few_rows(near) else near, "rep", "left").withColumn("near", F.coalesce("near", "rep"))
    rows = met.select(F.xxhash64("key", block).alias("key"), "rep").join(known.hint("merge"), "rep").select("key", "rep", "n", "counts", "near")
    rows = rows.repartition(n, "key").sortWithinPartitions("key")
    opened = rows.mapInArrow(lambda batches: _open_links(batches, least), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = stored(opened.unionByName(alike).distinct(), "open-links")
    heads = met.filter(F.col("texts") > crowd).select(F.col("head").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    found = stored(components(links.unionByName(heads)), "open-components")
    totals = found.join(classes.select(F.col("rep").alias("node"), "n"), "node").groupBy("component").agg(F.sum("n").alias("total"))
    totals = stored(totals, "component-sizes")
    large = totals.filter(F.col("total") > gathered)
    # The components that are gathered are bounded, so joins by component meet no hot key there.
    small = found.join(large, "component", "left_anti")
    small = stored(small, "small-components")
    members = F.broadcast(small) if few_rows(small) else small  # else the texts move
    meet = texts.select(F.col("row").alias("node"), "text").join(members, "node").select("component", F.col("node").alias("rep"), "text")
    meet = meet.repartition(n, "component").sortWithinPartitions("component", "rep")
    settled = meet.mapInArrow(lambda batches: _settled(batches, width, least), "rep long, root long").filter("rep <> root")
    if large.limit(1).count():
        settled = settled.unionByName(_settled_in_chunks(found.join(large, "component"), links, texts, width, least, chunk).filter("rep <> root"))
    roots = classes.select("class", "rep").join(stored(settled, "near-copies"), "rep", "left").select("class", F.coalesce("root", "rep").alias("component_id"))
    return sets.select("row", "class").join(roots.hint("merge"), "class").select("row", "component_id")


def drop_near_copies(docs: DataFrame, width: int = WIDTH, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row of each group, with all its columns, as ``simhash.drop_near_duplicates``."""
    numbered = numbered_rows(docs)
    return first_of_groups(numbered, near_copies(numbered.select("row", F.col("doc.text").alias("text")), width, least))
