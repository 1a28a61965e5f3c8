"""Target-distribution importance resampling over hashed n-grams, by the algebra of CRC-32.

A batch of texts is one byte array. The CRC of each word is computed once; a run of words is never built as a string. The
CRC of two strings one after the other is the first one's, moved past as many zero bytes as the second has, XOR the
second one's. Moving is linear over GF(2), so each length has a matrix of 32 by 32 bits, kept as four tables of 256 columns
for lengths below 64 and for powers of two above.

First pass: each task counts its features by bucket, and only these counts are shuffled, for the documents and for the
target. A bucket's gain is the logarithm of how much likelier the target is to have it, in thousandths. Second pass: a
document's weight is the mean gain of its features. Noise of a Gumbel distribution, from a hash of the id, turns the highest
scores into a draw without replacement in proportion to exp(weight / 1000). Scores are ranked over ranges of scores, so
no task holds them all. The gains are the only thing broadcast: one number for each of `buckets`.

Null and empty texts, and texts without words, have no features and weight 0; they can't be drawn while `min_words` is
above 0. A null id counts as empty in the noise. Repeated rows are weighed each by itself and each take a place; those of
equal score and id are told apart by nothing, so either may be first. An empty table draws nothing, an empty target gives
gains that favour buckets rare among the documents. A text of any length is read in blocks. Other columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import as_bytes, batches, cut, documents, slices, table

BUCKETS, NGRAMS, SEED, MIN_WORDS, PERCENT = 10000, 2, 7, 20, 25
BLOCK = 1 << 20

#: A-Z in lower case; ASCII other than digits and letters becomes a space.
CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


BYTE = _byte_table()
ONES = np.uint32(0xFFFFFFFF)


def _tables(columns: np.ndarray) -> np.ndarray:
    """A matrix, by the images of the 32 bits, as four tables: the image of each value of each byte."""
    out = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        out[bit // 8] ^= np.where(np.arange(256) >> bit % 8 & 1, columns[bit], np.uint32(0))
    return out


def _times(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables of the lengths 0 to 63, and of the powers of two from 64 on."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    low, cols = [], bits
    for _ in range(64):
        low.append(_tables(cols))
        cols = BYTE[cols & 255] ^ (cols >> 8)
    power = [_tables(cols)]
    for _ in range(40):
        power.append(_tables(_times(power[-1], _times(power[-1], bits))))
    return np.stack(low, 1), power


LOW, POWER = _shifts()


def shift(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each CRC moved past `size` zero bytes."""
    at = size & 63
    out = LOW[0][at, crc & 255] ^ LOW[1][at, crc >> 8 & 255] ^ LOW[2][at, crc >> 16 & 255] ^ LOW[3][at, crc >> 24]
    high, k = size >> 6, 0
    while high.any():
        rows = np.flatnonzero(high & 1)
        out[rows] = _times(POWER[k], out[rows])
        high, k = high >> 1, k + 1
    return out


def word_crcs(clean: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, CRC) of the words of cleaned bytes."""
    buf = np.frombuffer(clean, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], buf != 32, [False]]).astype(np.int8)))
    start, size = edge[::2], edge[1::2] - edge[::2]
    order = np.argsort(-size, kind="stable")
    by_size, at = size[order], start[order]
    crc = np.full(len(start), ONES, np.uint32)
    longest = int(by_size[0]) if len(by_size) else 0
    left = np.searchsorted(-by_size, -np.arange(1, min(longest, 32) + 1), "right")
    for j, m in enumerate(left.tolist()):
        crc[:m] = BYTE[(crc[:m] ^ buf[at[:m] + j]) & 255] ^ (crc[:m] >> 8)
    crc ^= ONES
    if longest > 32:
        view = memoryview(clean)
        for i in range(int(np.searchsorted(-by_size, -32, "left"))):
            crc[i] = zlib.crc32(view[int(at[i]) : int(at[i] + by_size[i])])
    out = np.empty_like(crc)
    out[order] = crc
    return start, size, out


SPACE = np.array([zlib.crc32(b" ")], np.uint32)


def runs(row: np.ndarray, size: np.ndarray, crc: np.ndarray, n: int, known: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, CRC) of the runs of 1 to n words of one row, joined by a space, but for runs within the first `known` words."""
    yield row[known:], crc[known:]
    tail = shift(np.broadcast_to(SPACE, crc.shape), size) ^ crc
    run = crc
    for k in range(1, n):
        m = len(crc) - k
        if m <= 0:
            return
        run = shift(run[:m], size[k:] + 1) ^ tail[k:]
        own = row[:m] == row[k:]
        own[: max(0, known - k)] = False
        yield row[:m][own], run[own]


def grams(texts: list[bytes], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, CRC, length of the runs) of every run of 1 to n words of each text, some texts or a block of a long one at a time."""
    for a, b in slices(texts):
        clean = b" ".join(texts[a:b]).translate(CLEAN)
        if len(clean) <= BLOCK:
            start, size, crc = word_crcs(clean)
            first = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
            row = a + np.searchsorted(first, start, "right") - 1
            for k, (r, c) in enumerate(runs(row, size, crc, n), 1):
                yield r, c, k
            continue
        last_size, last_crc, lo = np.zeros(0, np.int64), np.zeros(0, np.uint32), 0
        while lo < len(clean):
            hi = clean.find(b" ", min(lo + BLOCK, len(clean)))
            hi = len(clean) if hi < 0 else hi
            _, size, crc = word_crcs(clean[lo:hi])
            known, size, crc = len(last_crc), np.concatenate([last_size, size]), np.concatenate([last_crc, crc])
            for k, (r, c) in enumerate(runs(np.full(len(crc), a), size, crc, n, known), 1):
                yield r, c, k
            keep = min(n - 1, len(crc))
            last_size, last_crc, lo = size[len(size) - keep :], crc[len(crc) - keep :], hi


def histogram(df: DataFrame, text_col: str = "text", ngrams: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the features of all texts by bucket; each task's counts are added up before they are shuffled."""

    def run(frames):
        total = np.zeros(buckets, np.int64)
        for b in batches(frames):
            for _, crc, _ in grams(as_bytes(b.column(0)), ngrams):
                total += np.bincount(crc % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return df.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", ngrams: int = NGRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, an array of `buckets` integers."""
    counts = []
    for df in (docs, target):
        n = np.zeros(buckets, np.int64)
        for bucket, held in histogram(df, text_col, ngrams, buckets).collect():
            n[bucket] = held
        counts.append(n)
    s, t = counts
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id in thousandths."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", ngrams: int = NGRAMS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    id_type, buckets = docs.schema[id_col].dataType.simpleString(), len(gain)

    def run(frames):
        for b in batches(frames):
            words, features, total = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for row, crc, k in grams(as_bytes(b.column(1)), ngrams):
                n = np.bincount(row, minlength=b.num_rows)
                features += n
                if k == 1:
                    words += n
                total += np.bincount(row, gain[crc % buckets], b.num_rows).astype(np.int64)
            weight = total // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    out = docs.select(id_col, text_col).mapInArrow(run, f"doc_id {id_type}, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def placed(df: DataFrame, order: list[Column], into: str) -> DataFrame:
    """Adds the place from 1 that each row has in `order`: ranges of it are ranked each by itself and moved by what stands before."""
    dealt = cut(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    held = dict(dealt.groupBy("range").count().collect())
    before, out = {}, 0
    for r in sorted(held):
        before[r], out = out, out + held[r]
    if not before:
        return dealt.withColumn(into, F.lit(0).cast("long")).drop("range")
    moved = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair])[F.col("range").cast("long")]
    nth = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return dealt.withColumn(into, nth + moved).drop("range")


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, ngrams: int = NGRAMS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row; rank is null where it isn't drawn."""
    all_rows = cut(weigh(docs, gains(docs, target, text_col, ngrams, buckets), id_col, text_col, ngrams, seed))
    able = all_rows.where(F.col("n_words") >= min_words)
    most = percent * able.count() // 100
    rank = placed(able, [F.desc("score"), F.asc("doc_id")], "rank")
    rank = rank.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return rank.unionByName(all_rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The drawn rows with all their columns; ids must be unique (of rows with one id, all come or none), null ids never come."""
    drawn = draw(docs, target, id_col, text_col, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(drawn, id_col, "left_semi")


def op11_resample(spark, sf_dir):
    return draw(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of each distinct feature, byte by byte, from the table of its polynomial.
ORACLE = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
texts AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (
  SELECT side, id, unnest(w) AS g FROM words UNION ALL
  SELECT side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
counted AS (SELECT side, id, g, count(*) AS n FROM grams GROUP BY ALL),
raw AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM counted)),
hashed AS (
  SELECT g, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
         list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i::INT + 1, 2))::BIGINT)),
         lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) % 10000 AS bucket
  FROM raw, crc),
filed AS (SELECT side, id, bucket, sum(n) AS n FROM counted JOIN hashed USING (g) GROUP BY ALL),
held AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM filed GROUP BY bucket),
sums AS (SELECT coalesce(sum(n) FILTER (side = 0), 0) AS s_all, coalesce(sum(n) FILTER (side = 1), 0) AS t_all FROM filed),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain
  FROM held, sums WHERE s IS NOT NULL),
weights AS (
  SELECT id AS doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight
  FROM filed JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (
  SELECT d.doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || d.doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d JOIN words w ON w.side = 0 AND w.id = d.doc_id LEFT JOIN weights x ON x.doc_id = d.doc_id),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * able // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
