"""SimHash fingerprints and their links, compared in bit slices.

Documents become 64-bit fingerprints of their word shingles; equal fingerprints are one node from then on. Two
fingerprints within the radius differ in at most `radius` of the RADIUS + 2 segments, so they agree on at least two: a
node is filed under every pair of segments, and only nodes filed together are compared. A group is held as bit planes,
64 nodes to a machine word. Every shift of the planes compares 64 pairs at once: the differing bits of each plane go
through carry-save counters of one and two, and a block of words is abandoned once all its counters exceed the radius.
A group above `most` nodes is filed again under pairs of segments of its remaining bits; what is left free then bounds
the group (16 bits: 65,536 nodes), whatever the corpus. Each task hands on a spanning forest of what it found, never all
pairs of a group.

Null and empty texts have fingerprint zero and link like others. Repeated rows share a fingerprint. A row without an id
links like others but never names a component; one that reaches no id has a null component. Other columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import as_bytes, cut, documents, slices
from marlstone.llm.components import components

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
RADIUS = 2


def shingle_hashes(text: bytes, k: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of k words, space-joined, repeats included; of the whole sequence if it is shorter."""
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    n = len(words) - k + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)), np.uint64, n)


def fingerprints_of(texts: list[bytes], k: int = 3, seed: int = 42) -> np.ndarray:
    """A bit of a fingerprint is 1 if it is set in over half of the text's shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in slices(texts):
        parts = [shingle_hashes(t, k, seed) for t in texts[a:b]]
        for i, p in enumerate(parts):
            if len(p):
                ones = np.zeros(64, np.int64)
                for lo in range(0, len(p), 1 << 14):
                    ones += np.unpackbits(p[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                out[a + i] = np.packbits(2 * ones > len(p), bitorder="little").view(np.uint64)[0]
    return out


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames):
        for b in frames:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                fp = fingerprints_of(as_bytes(part.column(1)), k, seed)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


# --- bit slices -----------------------------------------------------------------------------------------------------


def planes_of(codes: np.ndarray, bits: int = 64) -> np.ndarray:
    """planes[i] holds bit i of all codes, 64 codes to a word, and a spare word."""
    n = -(-len(codes) // 64) * 64 + 64
    padded = np.zeros(n, np.uint64)
    padded[: len(codes)] = codes
    table = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits]
    return np.packbits(np.ascontiguousarray(table.T), axis=1, bitorder="little").view(np.uint64)


def within(planes: np.ndarray, d: int, live: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Bits of the places i whose code is within the radius of that at i + d; live: the words worth comparing.

    planes has a spare word at its end. Only words still in question are shifted and counted.
    """
    skip, bits = divmod(d, 64)
    at = np.flatnonzero(live[: max(0, planes.shape[1] - 1 - skip)])
    one, two, over = (np.zeros(len(at), np.uint64) for _ in range(3))
    full = ~np.uint64(0)
    out = np.zeros(len(live), np.uint64)
    for p in range(planes.shape[0]):
        row = planes[p]
        mate = row[at + skip]
        if bits:
            mate = (mate >> np.uint64(bits)) | (row[at + skip + 1] << np.uint64(64 - bits))
        diff = row[at] ^ mate
        carry = one & diff
        one ^= diff
        over |= two & carry
        two ^= carry
        if p % 4 == 3:  # blocks in which every pair is beyond the radius are dropped
            go = (over | _above(one, two, radius)) != full
            if not go.all():
                at, one, two, over = at[go], one[go], two[go], over[go]
                if not len(at):
                    return out
    out[at] = ~(over | _above(one, two, radius))
    return out


def _above(one: np.ndarray, two: np.ndarray, radius: int) -> np.ndarray:
    """Which counters of one + 2 * two exceed the radius."""
    return [one | two, two, one & two, np.zeros_like(one)][radius]


def roots_of(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The least place that each of n places reaches by the links (a, b)."""
    root = np.arange(n) if root is None else root
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def forest(group: np.ndarray, codes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the groups' pairs within the radius join: (code, least place's code) by spanning stars."""
    _, inv, count = np.unique(group, return_inverse=True, return_counts=True)
    order = np.lexsort((codes, inv, -count[inv]))
    size, gid, codes = count[inv][order], inv[order], codes[order]
    keep = size > 1
    size, gid, codes = size[keep], gid[keep], codes[keep]
    n = len(codes)
    if not n:
        return codes, codes
    planes = planes_of(codes)
    ends = np.flatnonzero(np.concatenate([gid[1:] != gid[:-1], [True]])) + 1
    left = ends[np.searchsorted(ends, np.arange(n), "right")] - np.arange(n)  # places to the end of the group
    root = np.arange(n)
    found_a, found_b, held = [], [], 0
    for d in range(1, int(size[0])):
        active = int(np.searchsorted(-size, -d, "left"))  # groups of more than d come first
        words = -(-active // 64)
        mate = left[:active] > d
        mask = np.packbits(np.concatenate([mate, np.zeros(words * 64 - active, bool)]), bitorder="little").view(np.uint64)
        near = within(planes, d, mask != 0, radius) & mask
        if near.any():
            i = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
            found_a.append(i)
            found_b.append(i + d)
            held += len(i)
            if held > 1 << 20:
                root = roots_of(n, np.concatenate(found_a), np.concatenate(found_b), root)
                found_a, found_b, held = [], [], 0
    if found_a:
        root = roots_of(n, np.concatenate(found_a), np.concatenate(found_b), root)
    moved = np.flatnonzero(root != np.arange(n))
    return codes[moved], codes[root[moved]]


# --- distributed search -----------------------------------------------------------------------------------------------


def _segments(code: Column, width: int, at: list[int]) -> Column:
    """The segments of `width` bits at the given numbers, side by side in one integer."""
    out = F.lit(0).cast("long")
    for i in at:
        out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(code, width * i).bitwiseAND(F.lit((1 << width) - 1)))
    return out


def _filed(nodes: DataFrame, width: int, shift: Column | None = None) -> DataFrame:
    """A row of `nodes` for each pair of its four segments of `width` bits: table number and key added."""
    code = F.col("code") if shift is None else shift
    pairs = list(combinations(range(4), 2))
    keys = F.array(*[F.struct(F.lit(t).cast("int").alias("t"), _segments(code, width, list(p)).alias("key")) for t, p in enumerate(pairs)])
    return nodes.withColumn("_f", F.explode(keys))


def _rest(t: Column, code: Column) -> Column:
    """The two segments of 16 bits that table t leaves free, side by side."""
    out = F.lit(None).cast("long")
    for n, p in enumerate(combinations(range(4), 2)):
        out = F.when(t == n, _segments(code, 16, [i for i in range(4) if i not in p])).otherwise(out)
    return out


def _compare(filed: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links among rows that agree in `keys`; a task reads its rows in key order and compares whole groups."""
    spread = filed.repartition(*keys).sortWithinPartitions(*keys)

    def run(frames):
        held: list[np.ndarray] = []
        count = 0
        for b in frames:
            held.append(np.stack([b.column(i).to_numpy() for i in range(b.num_columns)]))
            count += held[-1].shape[1]
            if count >= 1 << 17:
                rows = np.concatenate(held, axis=1)
                end = int(np.flatnonzero((rows[:-1] != rows[:-1, -1:]).any(0))[-1] + 1) if (rows[:-1] != rows[:-1, -1:]).any() else 0
                if end:
                    yield from emit(rows[:, :end])
                held = [rows[:, end:]]
                count = held[0].shape[1]
        if held:
            yield from emit(np.concatenate(held, axis=1))

    def emit(rows):
        group = np.concatenate([[0], np.cumsum((rows[:-1, 1:] != rows[:-1, :-1]).any(0))])
        a, b = forest(group, rows[-1].view(np.uint64), radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return spread.select(*[F.col(k).cast("long") for k in keys], "code").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, code_col: str = "fp", radius: int = RADIUS, most: int = 4096) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct codes within the radius (0 to 2)."""
    if not 0 <= radius <= 2:
        raise ValueError("pairs of four segments cover a radius of at most 2")
    filed = _filed(nodes.select(F.col(code_col).alias("code")), 16).select("code", F.col("_f.t").alias("t"), F.col("_f.key").alias("key"))
    large = cut(filed.groupBy("t", "key").count().where(F.col("count") > most).select("t", "key"))
    plain = filed.join(large, ["t", "key"], "left_anti") if not large.isEmpty() else filed
    out = _compare(plain, ["t", "key"], radius)
    if not large.isEmpty():
        again = _filed(filed.join(large, ["t", "key"]), 8, _rest(F.col("t"), F.col("code")))
        again = again.select("t", "key", F.col("_f.t").alias("t2"), F.col("_f.key").alias("key2"), "code")
        out = out.union(_compare(again, ["t", "key", "t2", "key2"], radius))
    return out


def classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, first_id): every distinct fingerprint, its component and the component's least id."""
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("first_id")))
    linked = components(links(nodes, "fp", radius))
    rooted = nodes.join(linked, nodes.fp == linked.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("first_id"))
    return rooted.select("fp", "root").join(least, "root")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, k: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp, root, component_id) of every row."""
    fps = cut(fingerprint(df, id_col, text_col, k, seed))
    return fps.join(classes(fps, radius), "fp").select("id", "fp", "root", F.col("first_id").alias("component_id"))


def hex64(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def op3_simhash(spark, sf_dir):
    found = near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), hex64(F.col("fp")).alias("fingerprint"), "component_id")
