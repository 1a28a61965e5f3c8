"""Near copies at a word-shingle similarity, by wide SimHash codes compared in bit slices, and verified on shingles.

A 64-bit fingerprint tells apart texts of a similarity of 0.99 and 0.9, but not of 0.9 and 0.7. Here a text has two
codes of several 64-bit words: one of its distinct words, by which it is filed, and one of its distinct shingles, by
which it is judged. Each word of the first is filed under all pairs of its four segments, as in `simhash`, so two near
copies miss each other only if they differ on three of four segments in every word. What is filed alone is dropped
before the judging codes are fetched. A group above `most` texts is cut into blocks, and every two blocks are compared
in a task of their own. A group's judging codes stand as bit planes; carry-save counters add up the differing bits of
64 pairs at a time, and words of pairs that are all beyond the radius are abandoned. The radius lies `SLACK` below the
similarity asked for, so that the codes' own spread loses few pairs.

A group hands on a spanning forest of pairs, the nearest first; the pairs of all groups are then verified: the distinct
shingles of both texts are compared, and only pairs that are as similar as asked for are links. So no link is wrong.
Finding is probable, not certain: see the README for measured recall.

Null and empty texts are one group. Repeated rows and rows without an id are as in `simhash`. An empty table gives an
empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import absent, as_bytes, cut, splitmix
from marlstone.llm.components import components
from marlstone.llm.simhash import _filed, roots_of, shingle_hashes

FILE_WORDS, JUDGE_WORDS, FILE_SHINGLE = 8, 6, 1
#: How far below the similarity asked for a pair is still verified: more than twice the codes' spread.
SLACK = 0.1
#: Texts of a group that are compared in one task.
MOST = 4096
_SEEDS = splitmix(np.arange(1, 1 + max(FILE_WORDS, JUDGE_WORDS), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def radius_at(similarity: float, bits: int = 64 * JUDGE_WORDS) -> int:
    """Expected number of differing bits between sets of this Jaccard similarity."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def wide_code(hashes: np.ndarray, words: int) -> np.ndarray:
    """`words` fingerprints of one list of hashes, each from another mixing of them."""
    if not len(hashes):
        return np.zeros(words, np.uint64)
    ones = np.zeros((words, 64), np.int64)
    for lo in range(0, len(hashes), 1 << 13):
        part = hashes[lo : lo + (1 << 13)]
        for w in range(words):
            bits = np.unpackbits(splitmix(part ^ _SEEDS[w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[w] += bits.sum(0, dtype=np.int32 if len(part) < 1 << 24 else np.int64)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view(np.uint64).ravel()


def name_of(words: np.ndarray, shingles: np.ndarray) -> np.uint64:
    """A hash of all words and shingles; 0 for a text without any."""
    if not len(words):
        return np.uint64(0)
    return splitmix(splitmix(words).sum(keepdims=True) ^ splitmix(shingles).sum(keepdims=True) + np.uint64(len(words)))[0]


def codes_of(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name (a hash of all shingles), filing code and judging code of each text."""
    name = np.zeros(len(texts), np.uint64)
    file, judge = np.zeros((len(texts), FILE_WORDS), np.uint64), np.zeros((len(texts), JUDGE_WORDS), np.uint64)
    for i, t in enumerate(texts):
        short, long = shingle_hashes(t, FILE_SHINGLE), shingle_hashes(t, k)
        file[i], judge[i] = wide_code(np.unique(short), FILE_WORDS), wide_code(np.unique(long), JUDGE_WORDS)
        name[i] = name_of(short, long)
    return name, file, judge


# --- bit slices ---------------------------------------------------------------------------------------------------------


def planes_of(codes: np.ndarray) -> np.ndarray:
    """planes[i] holds bit i of all codes (one row each), 64 codes to a word, and a spare word."""
    padded = np.zeros((-(-len(codes) // 64) * 64 + 64, codes.shape[1]), np.uint64)
    padded[: len(codes)] = codes
    table = np.unpackbits(padded.view(np.uint8).reshape(len(padded), -1), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(table.T), axis=1, bitorder="little").view(np.uint64)


def within(planes: np.ndarray, at: np.ndarray, d: np.ndarray, radius: int) -> np.ndarray:
    """For words at of 64 places each and shifts d: bits of the places i whose code is within the radius of that at i + d."""
    depth, full = radius.bit_length(), ~np.uint64(0)
    todo, out = np.arange(len(at)), np.zeros(len(at), np.uint64)
    there, low = at + d // 64, (d % 64).astype(np.uint64)
    high = np.uint64(63) - low
    count, over = np.zeros((depth, len(at)), np.uint64), np.zeros(len(at), np.uint64)

    def beyond():
        more, same = over.copy(), np.full(len(over), full)
        for b in range(depth - 1, -1, -1):
            if radius >> b & 1:
                same &= count[b]
            else:
                more |= same & count[b]
                same &= ~count[b]
        return more

    for p in range(planes.shape[0]):
        row = planes[p]
        mate = (row[there] >> low) | (row[there + 1] << np.uint64(1) << high)
        carry = row[at] ^ mate
        for b in range(depth):
            count[b], carry = count[b] ^ carry, count[b] & carry
            if b and not carry.any():
                break
        else:
            over |= carry
        if p % 32 == 31:
            go = beyond() != full
            if not go.all():
                at, there, low, high, todo, count, over = at[go], there[go], low[go], high[go], todo[go], count[:, go], over[go]
                if not len(at):
                    return out
    out[todo] = ~beyond()
    return out


def nearest_tree(n: int, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (a, b) of n places that join all that the pairs join, with the least sum of `far`."""
    root, chosen = np.arange(n), []
    key = far.astype(np.int64) << 32 | np.arange(len(a))
    while True:
        open_ = np.flatnonzero(root[a] != root[b])
        if not len(open_):
            return np.unique(np.concatenate(chosen)) if chosen else open_
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, root[a[open_]], key[open_])
        np.minimum.at(best, root[b[open_]], key[open_])
        chosen.append(np.unique(best[best < np.iinfo(np.int64).max]) & 0xFFFFFFFF)
        root = roots_of(n, a[chosen[-1]], b[chosen[-1]], root)


def forest(group: np.ndarray, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of pairs within the radius that join what all such pairs of one group join, the nearest first."""
    _, inv, size = np.unique(group, return_inverse=True, return_counts=True)
    order = np.lexsort((inv, -size[inv]))
    n = int((size[inv] > 1).sum())
    order = order[:n]
    if not n:
        return order, order
    gid, codes = inv[order], codes[order]
    planes = planes_of(codes)
    ends = np.flatnonzero(np.concatenate([gid[1:] != gid[:-1], [True]])) + 1
    left = ends[np.searchsorted(ends, np.arange(n), "right")] - np.arange(n)
    most, held = size[inv][order], []

    def thinned():
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        tree = nearest_tree(n, a, b, np.bitwise_count(codes[a] ^ codes[b]).sum(1, dtype=np.int64))
        return [(a[tree], b[tree])]

    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, shifts and masks that are compared together

    def compare():
        nonlocal held
        at, d, mask = (np.concatenate(x) for x in zip(*waiting, strict=True))
        waiting.clear()
        near = within(planes, at, d, radius) & mask
        some = np.flatnonzero(near)
        if len(some):
            row, bit = np.nonzero(np.unpackbits(near[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i = 64 * at[some][row] + bit
            held.append((i, i + d[some][row]))
            if sum(len(x) for x, _ in held) > 1 << 20:
                held = thinned()

    for d in range(1, int(most[0])):
        active = int(np.searchsorted(-most, -d, "left"))
        mask = np.packbits(np.concatenate([left[:active] > d, np.zeros(-active % 64, bool)]), bitorder="little").view(np.uint64)
        at = np.flatnonzero(mask)
        waiting.append((at, np.full(len(at), d), mask[at]))
        if sum(len(x) for x, _, _ in waiting) >= 1 << 12:
            compare()
    if waiting:
        compare()
    if not held:
        return order[:0], order[:0]
    ((a, b),) = thinned()
    return order[a], order[b]


# --- distributed --------------------------------------------------------------------------------------------------------


def coded(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, name, file, judge) of every row; the codes as arrays of 64-bit integers."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames):
        for b in frames:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                name, file, judge = codes_of(as_bytes(part.column(1)), k)
                wide = [pa.FixedSizeListArray.from_arrays(pa.array(c.view(np.int64).ravel()), c.shape[1]).cast(pa.list_(pa.int64())) for c in (file, judge)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(name.view(np.int64)), *wide], names=["id", "name", "file", "judge"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, name long, file array<long>, judge array<long>")


def _accompanied(filed: DataFrame) -> DataFrame:
    """(t, key, name) of rows that share their key with another one."""

    def run(frames):
        last = None
        for b in frames:
            t, key, name = (b.column(i).to_numpy() for i in range(3))
            if last is not None:
                t, key, name = (np.concatenate([[x], y]) for x, y in zip(last[:3], (t, key, name), strict=True))
            same = (t[1:] == t[:-1]) & (key[1:] == key[:-1])
            hit = np.zeros(len(t), bool)
            hit[1:] |= same
            hit[:-1] |= same
            if last is not None:
                hit[0] |= last[3]
            yield _batch(t[:-1][hit[:-1]], key[:-1][hit[:-1]], name[:-1][hit[:-1]])
            last = (t[-1], key[-1], name[-1], bool(hit[-1]))
        if last is not None and last[3]:
            yield _batch(*(np.array([x]) for x in last[:3]))

    def _batch(t, key, name):
        return pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(key, pa.int64()), pa.array(name, pa.int64())], names=["t", "key", "name"])

    return filed.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(run, "t int, key long, name long")


def _blocked(groups: DataFrame, most: int) -> DataFrame:
    """The rows with a block pair `i`, `j`: groups above `most` rows are cut into blocks, and a row goes to every pair of
    its own block and another one; in other groups both are 0."""
    large = cut(groups.groupBy("t", "key").count().where(F.col("count") > most))
    both = groups.withColumns({"i": F.lit(0), "j": F.lit(0)})
    if large.isEmpty():
        return both
    parts = large.select("t", "key", F.ceil(F.col("count") / most).cast("int").alias("parts"))
    cut_up = groups.join(parts, ["t", "key"]).withColumn("own", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
    cut_up = cut_up.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("parts > 1")
    cut_up = cut_up.select(*groups.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return both.join(large, ["t", "key"], "left_anti").unionByName(cut_up)


def _judged(groups: DataFrame, radius: int, most: int = MOST) -> DataFrame:
    """Pairs (a, b) of names within the radius; rows (t, key, name, judge)."""

    def run(frames):
        held, count = [], 0
        for b in frames:
            held.append(pa.Table.from_batches([b]))
            count += b.num_rows
            if count >= 1 << 14:
                rows = pa.concat_tables(held)
                keys = np.stack([rows[c].to_numpy().astype(np.int64) for c in KEYS])
                other = np.flatnonzero((keys != keys[:, -1:]).any(0))
                end = int(other[-1]) + 1 if len(other) else 0
                if end:
                    yield from emit(rows.slice(0, end))
                held, count = [rows.slice(end)], rows.num_rows - end
        if count:
            yield from emit(pa.concat_tables(held))

    def emit(rows):
        rows = rows.combine_chunks()
        keys, name = np.stack([rows[c].to_numpy().astype(np.int64) for c in KEYS]), rows["name"].to_numpy()
        judge = rows["judge"].combine_chunks().flatten().to_numpy().reshape(len(name), -1).view(np.uint64)
        group = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(0))])
        a, b = forest(group, judge, radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(name[a], name[b])), pa.array(np.maximum(name[a], name[b]))], names=["a", "b"])

    KEYS = ("t", "key", "i", "j")
    return _blocked(groups, most).repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(run, "a long, b long").distinct()


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """(name, shingles) of rows (id, text): the hashes of the distinct shingles, in order."""

    def run(frames):
        for b in frames:
            for i in range(0, b.num_rows, 256):
                hashes = [(shingle_hashes(t, FILE_SHINGLE), shingle_hashes(t, k)) for t in as_bytes(b.column(1).slice(i, 256))]
                name = np.array([name_of(*h) for h in hashes], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array([np.unique(h[1]).view(np.int64) for h in hashes], pa.list_(pa.int64()))], names=["name", "shingles"])

    return texts.mapInArrow(run, "name long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of names whose shingles are as similar as asked for."""
    one = pairs.join(sets.select(F.col("name").alias("a"), F.col("shingles").alias("x")), "a")
    both = one.join(sets.select(F.col("name").alias("b"), F.col("shingles").alias("y")), "b")

    def run(frames):
        for b in frames:
            x, y = b.column(2), b.column(3)
            near = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                u, v = x[i].values.to_numpy(), y[i].values.to_numpy()
                shared = len(u) + len(v) - len(np.unique(np.concatenate([u, v])))
                near[i] = shared >= similarity * (len(u) + len(v) - shared)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(near)), b.column(1).filter(pa.array(near))], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def classes(rows: DataFrame, texts: DataFrame, similarity: float, k: int) -> DataFrame:
    """(name, root, first_id): every distinct code, its component and the component's least id. texts: (id, text)."""
    nodes = cut(rows.groupBy("name").agg(F.min("id").alias("first_id"), F.first("file").alias("file"), F.first("judge").alias("judge")))
    words = nodes.select("name", F.posexplode("file").alias("w", "code"))
    filed = _filed(words, 16).select((F.col("w") * 6 + F.col("_f.t")).cast("int").alias("t"), F.col("_f.key").alias("key"), "name")
    groups = _accompanied(filed).join(nodes.select("name", "judge"), "name").select("t", "key", "name", "judge")
    pairs = cut(_judged(groups, radius_at(similarity - SLACK)))
    ends = cut(pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct().join(nodes.select("name", "first_id"), "name"))
    some = texts.join(ends.select(F.col("first_id").alias("_end")).distinct(), F.col("id") == F.col("_end"), "left_semi")
    if not ends.where("first_id IS NULL").isEmpty():
        some = some.union(texts.where("id IS NULL"))
    # An id may come with several texts, so what has been read is told apart by name.
    sets = shingle_sets(some, k).join(ends.select("name"), "name", "left_semi")
    sets = cut(sets.groupBy("name").agg(F.first("shingles").alias("shingles")))
    linked = components(verified(pairs, sets, similarity))
    rooted = nodes.select("name", "first_id").join(linked, F.col("name") == F.col("node"), "left")
    rooted = cut(rooted.select("name", "first_id", F.coalesce("root", "name").alias("root")))
    return rooted.select("name", "root").join(rooted.groupBy("root").agg(F.min("first_id").alias("first_id")), "root")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, name, root, component_id) of every row."""
    rows, texts = cut(coded(df, id_col, text_col, k)), df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.select("id", "name").join(classes(rows, texts, similarity, k), "name").select("id", "name", "root", F.col("first_id").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component, with all its columns: that of the least id; of rows with one id, one. A component
    without any id keeps one of its rows."""
    found = near_copies(df, id_col, text_col, k, similarity)
    nth, name = absent(df, "_nth"), absent(df, "_name")
    named = cut(found.where(F.col("id") == F.col("component_id")).select(F.col("id").alias("_id")).distinct())
    rows = df.join(named, df[id_col] == named["_id"], "left_semi")
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(id_col).orderBy(text_col))).where(F.col(nth) == 1).drop(nth)
    nameless = df.where(F.col(id_col).isNull())
    if nameless.isEmpty():
        return rows
    lone = found.where("component_id IS NULL").groupBy("root").agg(F.min("name").alias(name)).select(name)
    at = df.columns.index(text_col)

    def run(frames):
        for b in frames:
            got = codes_of(as_bytes(b.column(at)), k)[0].view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], names=[*b.schema.names, name])

    marked = nameless.mapInArrow(run, type(df.schema)([*df.schema.fields]).add(name, "long")).join(lone, name, "left_semi")
    first = marked.withColumn(nth, F.row_number().over(Window.partitionBy(name).orderBy(text_col))).where(F.col(nth) == 1).drop(nth, name)
    return rows.unionByName(first)
