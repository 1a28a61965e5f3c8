"""Quality rules by repetition coverage.

A batch of texts is one byte array. Prefix sums of a polynomial in an odd base modulo 2**64 give the hash of any byte
range or run of words in constant time, so every n-gram length costs one subtraction and one sort in numpy. Such hashes
collide on texts made for it, so windows and lines of one hash are compared word by word and byte by byte before they
count. A window found twice marks its words as covered; the covered characters of several lengths, and of repeated
lines, decide. The limits are those of `Rules`; a text exactly at a limit passes.

Null and empty texts have no words and fail the base rule. Repeated rows are judged each by itself. An empty table gives
an empty one. Other columns pass through `keep` unread, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marlstone.llm.common import as_bytes, batches, documents, eights, same_bytes, slices, splitmix

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = int(_rng.integers(1 << 40, 1 << 62)) * 2 + 1
STEP = int(_rng.integers(1 << 40, 1 << 62)) * 2 + 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if n <= 1 << 22:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=out[1:])
    return out


@dataclass
class Rules:
    """Largest shares of a text's word characters that may stand in windows of n words, and in lines, that the text has
    had before; and of its lines that may be such. A heading or notice that comes back once stays below them."""

    windows: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.15, 7: 0.15, 8: 0.15, 9: 0.15, 10: 0.12})
    line_chars: float = 0.20
    lines: float = 0.50
    min_words: int = 50
    repeat_words_percent: int = 50


def pairs_of(keys: np.ndarray, same, value) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions of values that occur more than once: all of them, and those after each value's first.

    keys: hashes of the values. same(a, b) says of arrays of positions with equal hashes which pairs have equal values;
    where a hash stands for more than one value, value(i) tells them apart.
    """
    order = np.argsort(keys)
    s = keys[order]
    pair = np.flatnonzero(s[1:] == s[:-1])
    wrong = ~same(order[pair], order[pair + 1])
    more, more_later = [], []
    if wrong.any():
        shared = np.unique(s[pair[wrong]])
        groups: dict = {}
        for i in np.flatnonzero(np.isin(keys, shared)).tolist():
            groups.setdefault(value(i), []).append(i)
        for g in groups.values():
            if len(g) > 1:
                more += g
                more_later += g[1:]
        pair = pair[~np.isin(s[pair], shared)]
    hit = np.unique(np.concatenate([order[pair], order[pair + 1]]))
    _, first = np.unique(keys[hit], return_index=True)
    later = np.delete(hit, first)
    if more:
        hit, later = np.sort(np.concatenate([hit, more])), np.sort(np.concatenate([later, more_later]))
    return hit, later


def word_ids(raw: bytes, at8: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each word, equal where and only where the words are, whatever their hashes do."""
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    wrong = (size != size[first[ids]]) | ~same_bytes(at8, starts, at8, starts[first[ids]], np.minimum(size, size[first[ids]]))
    if wrong.any():
        names: dict[bytes, int] = {}
        for i in np.flatnonzero(wrong).tolist():
            ids[i] = names.setdefault(raw[starts[i] : ends[i]], len(first) + len(names))
    return ids


def measure(texts: list[bytes], rules: Rules) -> dict[str, np.ndarray]:
    """The counts and shares of each text."""
    n_docs = len(texts)
    raw = b"\n".join(texts) + b"\n"
    buf, at8 = np.frombuffer(raw, np.uint8), eights(raw)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, n_docs)
    bounds = prefix(size)
    space = SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    starts, ends = edge[0::2], edge[1::2]
    lead = (buf & 0xC0) != 0x80
    chars = prefix((lead & ~space).astype(np.int64))
    symbols = prefix(SYMBOL[buf].astype(np.int64))
    hashed = prefix(BYTE[buf] * powers(BASE, len(buf)))
    back = powers(inverse(BASE), len(buf))

    def text_hash(a, b):
        return splitmix((hashed[b] - hashed[a]) * back[a] + (b - a).astype(np.uint64))

    first = np.searchsorted(starts, bounds)  # word range of each text
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    word_len = chars[ends] - chars[starts]
    word_chars = prefix(word_len)
    out = {"n_words": np.diff(first), "word_chars": np.diff(word_chars[first]), "n_symbols": symbols[bounds[1:]] - symbols[bounds[:-1]]}

    own = splitmix(np.arange(1, n_docs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    hashes = text_hash(starts, ends)
    word = word_ids(raw, at8, starts, ends, hashes)
    rolled = prefix(hashes * powers(STEP, len(starts)))
    unroll = powers(inverse(STEP), len(starts))

    def covered(n: int, again: bool) -> np.ndarray:
        """Which words stand in a window of n words that its text has twice or more; again: the first one doesn't count."""
        if len(starts) < n:
            return np.zeros(len(starts), bool)
        k = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])
        window = splitmix((rolled[k + n] - rolled[k]) * unroll[k]) ^ own[doc[k]]

        def same(a, b):
            a, b = k[a], k[b]
            out = doc[a] == doc[b]
            for j in range(n):
                out &= word[a + j] == word[b + j]
            return out

        at = k[pairs_of(window, same, lambda i: (doc[k[i]], *word[k[i] : k[i] + n].tolist()))[again]]
        mark = np.zeros(len(starts) + 1, np.int64)
        mark[at] += 1
        np.subtract.at(mark, at + n, 1)
        return np.cumsum(mark)[:-1] > 0

    out["n_repeat_words"] = np.diff(prefix(covered(3, False).astype(np.int64))[first])

    stops = np.flatnonzero(buf == 10)
    opens = np.concatenate([[0], stops[:-1] + 1])
    worded = np.searchsorted(starts, stops) > np.searchsorted(starts, opens)
    opens, stops = opens[worded], stops[worded]
    line_doc = np.searchsorted(bounds, opens, "right") - 1
    wide = stops - opens

    def same_line(a, b):
        return (line_doc[a] == line_doc[b]) & (wide[a] == wide[b]) & same_bytes(at8, opens[a], at8, opens[b], np.minimum(wide[a], wide[b]))

    _, later = pairs_of(text_hash(opens, stops) ^ own[line_doc], same_line, lambda i: (line_doc[i], raw[opens[i] : stops[i]]))
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n_docs)
    lines = np.bincount(line_doc, minlength=n_docs)
    dup_chars = np.bincount(line_doc[later], weights=(chars[stops] - chars[opens])[later], minlength=n_docs)

    total = np.maximum(out["word_chars"], 1)
    bad = (out["n_dup_lines"] > rules.lines * lines) | (dup_chars > rules.line_chars * total)
    for n, most in rules.windows.items():
        share = np.diff(prefix(np.where(covered(n, True), word_len, 0))[first]) / total
        out[f"share_{n}"] = share
        bad |= share > most
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.repeat_words_percent * out["n_words"])
    out["kept"] = ~(out["base_failed"] | bad)
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(texts: list[bytes], rules: Rules) -> dict[str, np.ndarray]:
    parts = [measure(texts[a:b], rules) for a, b in slices(texts)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules | None = None) -> DataFrame:
    """One row per input row: its id, the counts, the shares of repeated characters and the verdict."""
    rules = rules or Rules()
    id_type = df.schema[id_col].dataType.simpleString()
    shares = [f"share_{n}" for n in rules.windows]
    schema = ", ".join([f"`{id_col}` {id_type}", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in shares), "base_failed boolean", "kept boolean"])

    def run(frames):
        for b in batches(frames):
            r = judged(as_bytes(b.column(1)), rules)
            if r:
                names = [*COUNTS, *shares, "base_failed", "kept"]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(r[c].astype(np.int64) if c in COUNTS else r[c]) for c in names)], names=[id_col, *names])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def keep(df: DataFrame, text_col: str = "text", rules: Rules | None = None) -> DataFrame:
    """The rows whose text passes, with all their columns."""
    rules = rules or Rules()
    at = df.columns.index(text_col)

    def run(frames):
        for b in batches(frames):
            r = judged(as_bytes(b.column(at)), rules)
            if r:
                yield b.filter(pa.array(r["kept"]))

    return df.mapInArrow(run, df.schema)


def op7_quality(spark, sf_dir):
    cols = ["doc_id", *COUNTS, "base_failed", "kept"]
    return score(documents(spark, sf_dir)).select(*cols)
