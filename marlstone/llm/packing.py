"""Best-fit packing of token pieces into fixed-length sequences, by bin completion over length classes.

Pieces of one length are interchangeable, so the packing is solved on the histogram of lengths, which has no more rows
than the capacity whatever the corpus. Around the largest length left, a branch-and-bound looks for the filling of the
space beside it that wastes least, with best fit as the first incumbent; it is applied as often as the histogram allows.
What comes of this is the first packing. `lower_bound` tells how few sequences any packing needs; while the packing has
more, the search goes back over its sequences, the last first, and tries their other undominated fillings. A filling is
dominated if some of its pieces could give place to one that is left, as long as they together or longer by no more than
the waste. A branch ends once what it has used and the lower bound of what is left don't beat the incumbent. `effort`
ends the going back after so many steps; without it the search runs until the packing is proved to be a best one. The
plan says which bound it has reached. Pieces find their places by their rank among the pieces of their length, taken
without gathering a length in one task.

Null and empty texts are one piece: the end id. Repeated rows are packed each by itself; which of the pieces of one
length gets which place is free, and follows their salted order. An id may be null. Other columns are not read. An empty
table gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import as_bytes, cut, documents, eights, same_bytes, slices, splitmix, spread_rank
from marlstone.llm.quality import BASE, BYTE, inverse, powers, prefix

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
#: Steps of the search for fewer sequences, unless a caller asks for other ones or for a proof.
EFFORT = 5_000


# --- tokens -------------------------------------------------------------------------------------------------------------


#: Parts made of these characters fall into the tokenizer's own pre-tokens as PRE says; other parts it gets whole.
SIMPLE = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ!-/:-@\[-`{-~]+")
PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")


class Encoder:
    """Token ids of texts as arrays of unsigned 32-bit integers.

    The tokenizer drops white space and never joins text across it, so parts between blanks and line ends are encoded
    once and remembered. A batch is one byte array: parts get 64-bit hashes from prefix sums, an open hash table in
    numpy finds their ids in a pool, and only parts not met before reach the tokenizer. A remembered part counts only
    if its bytes agree; parts whose hash another part has taken are encoded by themselves. `most` parts and pre-tokens
    are remembered at a time; a full memory starts anew.
    """

    def __init__(self, path: str | None = None, most: int = 3 << 18):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tok, self.most = Tokenizer.from_file(path), most
        self.word_ends = np.zeros(1 + max(self.tok.get_vocab().values()), bool)
        self.word_ends[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self.pre: dict[str, bytes] = {}
        self._clear()

    def _clear(self) -> None:
        self.n = self.pooled = self.spelt = 0
        self.keys, self.slot = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int64)
        self.at, self.len, self.pool = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.word_at, self.word_len, self.words = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 16, np.uint8)

    def _encode(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, as bytes; each new pre-token goes to the tokenizer once."""
        split = [PRE.findall(p.lower()) if SIMPLE.fullmatch(p) and "<|" not in p else None for p in parts]
        new = [w for w in set().union(*filter(None, split)) if w not in self.pre]
        if len(self.pre) + len(new) > self.most // 2:
            self.pre = {}
            new = list(set().union(*filter(None, split)))
        run = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        for i in range(0, len(new), 1000):
            # A pre-token's last id alone ends a word, so a line of them falls apart again.
            ids = np.array(run([" ".join(new[i : i + 1000])], add_special_tokens=False)[0].ids, np.uint32)
            raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self.word_ends[ids]) + 1)).tolist()
            self.pre.update(zip(new[i : i + 1000], map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True))
        whole = iter(run([p for p, x in zip(parts, split, strict=True) if x is None], add_special_tokens=False))
        get = self.pre.__getitem__
        return [np.array(next(whole).ids, np.uint32).tobytes() if x is None else b"".join(map(get, x)) for x in split]

    def _find(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.keys) - 1)
        out, todo, pos = np.full(len(h), -1, np.int64), np.arange(len(h)), h & mask
        while len(todo):
            k = self.keys[pos]
            hit = k == h
            out[todo[hit]] = self.slot[pos[hit]]
            go = ~hit & (k != 0)
            todo, h, pos = todo[go], h[go], (pos[go] + np.uint64(1)) & mask
        return out

    def _put(self, h: np.ndarray, slots: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        pos = h & mask
        while len(h):
            free = self.keys[pos] == 0
            self.keys[pos[free]] = h[free]
            won = free & (self.keys[pos] == h)
            self.slot[pos[won]] = slots[won]
            h, slots, pos = h[~won], slots[~won], (pos[~won] + np.uint64(1)) & mask

    def _learn(self, h: np.ndarray | None, parts: list[bytes]) -> np.ndarray:
        """Remembers the parts' ids and bytes; under their hashes, if given. The slots that they get."""
        ids = self._encode([p.decode("utf-8", "replace") for p in parts])
        size, letters = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids, parts))
        size //= 4
        new, total, spelt = len(parts), int(size.sum()), int(letters.sum())
        self.pool, self.words = _grown(self.pool, self.pooled + total), _grown(self.words, self.spelt + spelt + 8)
        self.at, self.len, self.word_at, self.word_len = (_grown(x, self.n + new) for x in (self.at, self.len, self.word_at, self.word_len))
        ends, stops, slots = self.pooled + np.cumsum(size), self.spelt + np.cumsum(letters), np.arange(self.n, self.n + new)
        self.pool[self.pooled : self.pooled + total] = np.frombuffer(b"".join(ids), np.uint32)
        self.words[self.spelt : self.spelt + spelt] = np.frombuffer(b"".join(parts), np.uint8)
        self.at[slots], self.len[slots], self.word_at[slots], self.word_len[slots] = ends - size, size, stops - letters, letters
        self.n, self.pooled, self.spelt = self.n + new, self.pooled + total, self.spelt + spelt
        if h is not None:
            if 2 * self.n > len(self.keys):
                used = self.keys != 0
                old = self.keys[used], self.slot[used]
                width = 1 << int(4 * self.n - 1).bit_length()
                self.keys, self.slot = np.zeros(width, np.uint64), np.zeros(width, np.int64)
                self._put(*old)
            self._put(h, slots)
        return slots

    def _spelt_so(self, slot: np.ndarray, at8: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the remembered parts are those that stand there."""
        held = np.ndarray(len(self.words) - 7, "<u8", self.words, strides=(1,))
        short = np.minimum(size, self.word_len[slot])
        return (self.word_len[slot] == size) & same_bytes(held, self.word_at[slot], at8, starts, short)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = b"\n".join(texts) + b"\n"
        buf, at8 = np.frombuffer(raw, np.uint8), eights(raw)
        gap = (buf == 32) | (buf == 10)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap])))
        starts, ends = edge[0::2], edge[1::2]
        sums = prefix(BYTE[buf] * powers(BASE, len(buf)))
        h = splitmix((sums[ends] - sums[starts]) * powers(inverse(BASE), len(buf))[starts] + (ends - starts).astype(np.uint64))
        h = np.maximum(h, np.uint64(1))
        if self.n > self.most or max(self.pooled, self.spelt) > 16 * self.most:
            self._clear()
        slot = self._find(h)
        lost = np.flatnonzero(slot < 0)
        if len(lost):
            new, first = np.unique(h[lost], return_index=True)
            self._learn(new, [raw[starts[i] : ends[i]] for i in lost[first].tolist()])
            slot[lost] = self._find(h[lost])
        other = np.flatnonzero(~self._spelt_so(slot, at8, starts, ends - starts)).tolist()
        if other:
            found: dict[bytes, list[int]] = {}
            for i in other:
                found.setdefault(raw[starts[i] : ends[i]], []).append(i)
            for where, s in zip(found.values(), self._learn(None, list(found)).tolist(), strict=True):
                slot[where] = s
        size = self.len[slot]
        to = prefix(size)
        ids = self.pool[np.repeat(self.at[slot] - to[:-1], size) + np.arange(to[-1])]
        bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        return np.split(ids, to[np.searchsorted(starts, bounds[:-1])])


def _grown(x: np.ndarray, least: int) -> np.ndarray:
    """The array with at least that many places, doubled where it has fewer."""
    while len(x) < least:
        x = np.concatenate([x, np.zeros_like(x)])
    return x


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """The token ids of each text and the end id, cut into pieces of at most `capacity`.

    One row per piece: id, piece, start, length, ids_crc32, and with keep_ids the ids themselves.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    end = np.array([end_id], np.uint32)

    def run(frames):
        encode = Encoder(path)
        for b in frames:
            for i in range(0, b.num_rows, 2048):
                ids, texts = b.column(0).slice(i, 2048), as_bytes(b.column(1).slice(i, 2048))
                row, piece, length, crc, kept = [], [], [], [], []
                for lo, hi in slices(texts):
                    for at, tokens in enumerate(encode(texts[lo:hi]), lo):
                        tokens = np.concatenate([tokens, end]).astype("<u4")
                        for k, a in enumerate(range(0, len(tokens), capacity)):
                            part = tokens[a : a + capacity]
                            row.append(at)
                            piece.append(k)
                            length.append(len(part))
                            crc.append(zlib.crc32(part))
                            if keep_ids:
                                kept.append(part.astype(np.int32))
                piece = np.array(piece, np.int32)
                cols = [ids.take(pa.array(row, pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.list_(pa.int32()))] * keep_ids, names=names + ["ids"] * keep_ids)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


# --- the plan -----------------------------------------------------------------------------------------------------------


@dataclass
class Plan:
    """Entry i places the pieces of `length[i]` with rank from `first[i]` on: `each[i]` to a sequence, from sequence
    `sequence[i]` and offset `offset[i]` on, in `times[i]` sequences. Entries are ordered by length and rank. No packing has fewer sequences than
    `bound`; proved: nor fewer than this one."""

    sequences: int = 0
    bound: int = 0
    proved: bool = True
    length: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    times: list[int] = field(default_factory=list)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing of counts[x] pieces of each length x takes fewer sequences.

    For every k: pieces above capacity - k stand alone, those above half the capacity each begin a sequence, and what
    pieces from k on don't find room beside those needs more of them. Also, at most capacity // k pieces of length k or
    more fit a sequence, and lengths may be rounded by any function that no filled sequence exceeds (`_rounded`).
    """
    x = np.arange(capacity + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * x)
    k = np.arange(capacity // 2 + 1)
    half, under = capacity // 2, capacity - k
    alone_or_first = n[capacity] - n[half]
    beside = (n[under] - n[half]) * capacity - (total[under] - total[half])
    small = total[half] - np.where(k > 0, total[k - 1], 0)
    by_halves = int(alone_or_first + max(0, int((-((beside - small) // capacity)).max())))
    longer = (n[capacity] - n)[:-1]  # pieces above k - 1, for k from 1 on
    by_number = int((-(-longer // (capacity // x[1:]))).max()) if capacity else 0
    scale, weights = _rounded(capacity)
    return max(by_halves, by_number, int((-(-(weights @ counts) // scale)).max()))


@lru_cache(maxsize=8)
def _rounded(capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For p from 1 to 48: what a full sequence weighs, and the weight of each length: (p + 1) parts of the capacity, rounded
    down, count as p, and a length of whole parts counts as it is."""
    p, x = np.arange(1, 49)[:, None], np.arange(capacity + 1)[None, :]
    parts = (p + 1) * x
    return (p * capacity)[:, 0], np.where(parts % capacity == 0, p * x, parts // capacity * capacity).astype(np.int64)


class _Shelf:
    """Lengths still there, with the next smaller one found in near-constant time."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.tolist()
        self.below = list(range(len(self.n)))
        self.used = [0] * len(self.n)

    def put(self, x: int, more: int) -> None:
        """Adds pieces of length x, or takes some away."""
        if more > 0 and self.n[x] == 0:
            self.below = list(range(len(self.n)))  # what points past x may be wrong now
        self.n[x] += more

    def at_most(self, x: int) -> int:
        """The largest length up to x that is left beside what is in use; 0 if none."""
        while x > 0:
            root = x
            while root > 0 and self.n[root] == 0:
                root = self.below[root] if self.below[root] != root else root - 1
            while x != root and x > 0:
                self.below[x], x = root, self.below[x] if self.below[x] != x else x - 1
            if root <= 0 or self.n[root] > self.used[root]:
                return max(root, 0)
            x = root - 1
        return 0


def _complete(shelf: _Shelf, room: int, branches: int) -> list[int]:
    """The filling of `room` with the least waste that the search finds, largest lengths first."""
    best: list[int] = []
    least = room + 1
    nodes = 0

    def best_fit(left: int, top: int) -> tuple[list[int], int]:
        got = []
        while left and (x := shelf.at_most(min(left, top))):
            got.append(x)
            shelf.used[x] += 1
            left -= x
        for x in got:
            shelf.used[x] -= 1
        return got, left

    def search(chosen: list[int], left: int, top: int) -> None:
        """Tries what can follow `chosen`, with lengths of at most `top`, in falling order."""
        nonlocal best, least, nodes
        nodes += 1
        rest, waste = best_fit(left, top)
        if waste < least:
            best, least = chosen + rest, waste
        x = shelf.at_most(min(left, top))
        while x and least and nodes <= branches:
            # Alone, a length leaves left - x; unless that beats the incumbent or more can follow, the branch is dead.
            shelf.used[x] += 1
            if left - x < least or shelf.at_most(min(left - x, x)):
                search([*chosen, x], left - x, x)
            shelf.used[x] -= 1
            x = shelf.at_most(x - 1)

    search([], room, room)
    return best


class _Effort:
    """How many steps the search may still take; None: no limit."""

    def __init__(self, steps: int | None):
        self.steps, self.gone = steps, False

    def spend(self) -> bool:
        if self.steps is not None:
            self.gone |= self.steps <= 0
            self.steps -= 1
        return not self.gone


def _spread(bits: int, by: int) -> int:
    """The bits, and each of them moved up by 1 to `by` places."""
    step = 1
    while by > 0:
        take = min(step, by)
        bits |= bits << take
        by, step = by - take, step + take
    return bits


def _dominated(filling: list[int], waste: int, spare: int) -> bool:
    """Whether some pieces of the filling could give place to one that is left (bit x of spare: a piece of length x)."""
    one = more = 0  # bit t: one piece, or several pieces, of the filling are t long together
    for x in filling:
        more |= (more | one) << x
        one |= 1 << x
    longer = _spread(one << 1, waste - 1) if waste else 0  # a single piece gives place to a longer one only
    return bool((_spread(more, waste) | longer) & spare)


def _fillings(counts: list[int], room: int, top: int, effort: _Effort):
    """Every undominated filling of `room` beside a piece of length `top`; counts without that piece. Largest first."""
    sizes = [x for x in range(min(room, top), 0, -1) if counts[x]]
    have = sum(1 << x for x in range(1, room + 1) if counts[x])
    chosen: list[int] = []

    def deeper(i: int, left: int):
        for j in range(i, len(sizes)):
            for k in range(min(counts[sizes[j]], left // sizes[j]), 0, -1):
                if not effort.spend():
                    return
                chosen.extend([sizes[j]] * k)
                yield from deeper(j + 1, left - k * sizes[j])
                del chosen[len(chosen) - k :]
        spare = have
        for x in set(chosen):
            if chosen.count(x) == counts[x]:
                spare &= ~(1 << x)
        if not spare & ((1 << left + 1) - 1) and not _dominated(chosen, left, spare):
            yield list(chosen)

    yield from deeper(0, room)


def _choices(shelf: _Shelf, capacity: int, branches: int, effort: _Effort):
    """Fillings of a sequence around the largest length left, and how often to apply each: what is tried in turn."""
    top = next(x for x in range(capacity, 0, -1) if shelf.n[x])
    shelf.used[top] = 1
    first = _complete(shelf, capacity - top, branches)
    shelf.used[top] = 0
    counts = list(shelf.n)
    counts[top] -= 1

    def every():
        yield first
        for f in _fillings(counts, capacity - top, top, effort):
            if f != first:
                yield f

    for filling in every():
        per = {x: (top, *filling).count(x) for x in (top, *filling)}
        for times in range(min(shelf.n[x] // k for x, k in per.items()), 0, -1):
            yield per, times


def solve(histogram: dict[int, int], capacity: int = CAPACITY, effort: int | None = EFFORT, branches: int = 400) -> Plan:
    """A packing of the histogram of lengths.

    effort: steps of the search after the first packing; None: until it is proved to be a best one, which may take long.
    branches: what the search for the first filling of a sequence tries beyond best fit.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for k, n in histogram.items():
        counts[k] = n
    bound, left = lower_bound(counts, capacity), int(counts.sum())
    shelf, best, least, steps_left = _Shelf(counts), [], int(counts.sum()) + 1, _Effort(effort)
    steps: list[tuple[dict[int, int], int]] = []
    nodes = [_choices(shelf, capacity, branches, steps_left)] if left else []
    used = 0

    def apply(per: dict[int, int], times: int, sign: int) -> None:
        for x, k in per.items():
            shelf.put(x, -sign * k * times)

    while nodes and least > bound and not steps_left.gone:
        choice = next(nodes[-1], None)
        if choice is None:
            nodes.pop()
            if steps:
                per, times = steps.pop()
                apply(per, times, -1)
                used, left = used - times, left + times * sum(per.values())
            continue
        per, times = choice
        if best and not steps_left.spend():
            break
        apply(per, times, 1)
        used, left = used + times, left - times * sum(per.values())
        steps.append(choice)
        if left and (not best or used + lower_bound(np.array(shelf.n), capacity) < least):
            nodes.append(_choices(shelf, capacity, branches, steps_left))
            continue
        if not left and used < least:
            best, least = list(steps), used
        steps.pop()
        apply(per, times, -1)
        used, left = used - times, left + times * sum(per.values())
    plan = Plan(bound=bound, proved=least <= bound or not steps_left.gone)
    taken = [0] * (capacity + 1)
    for per, times in best:
        offset = 0
        for x, k in per.items():
            plan.length.append(x)
            plan.first.append(taken[x])
            plan.each.append(k)
            plan.sequence.append(plan.sequences)
            plan.offset.append(offset)
            plan.times.append(times)
            offset += k * x
            taken[x] += k * times
        plan.sequences += times
    order = np.lexsort((plan.first, plan.length))
    for name in ("length", "first", "each", "sequence", "offset", "times"):
        setattr(plan, name, np.array(getattr(plan, name), np.int64)[order])
    return plan


def plan_of(rows: DataFrame, length_col: str = "length", capacity: int = CAPACITY, effort: int | None = EFFORT) -> Plan:
    """How to pack the pieces of a table: at most `effort` steps of search (None: to proof), with the bound that it was held
    against and whether it is proved to be a best one."""
    return solve({r[0]: r[1] for r in rows.groupBy(length_col).count().collect()}, capacity, effort)  # at most `capacity` rows


def place(rows: DataFrame, length_col: str = "length", id_cols: tuple[str, ...] = ("id", "piece"), capacity: int = CAPACITY, effort: int | None = EFFORT, plan: Plan | None = None) -> DataFrame:
    """The rows with `sequence_id` and `offset`; lengths from 1 to the capacity. Call it on a table that stays as it is.

    plan: that of the same rows, where the caller has looked at it; `effort` is that of `plan_of`."""
    plan = plan_of(rows, length_col, capacity, effort) if plan is None else plan
    held = np.bincount(plan.length, plan.each * plan.times, capacity + 1).astype(np.int64) if len(plan.length) else np.zeros(1, np.int64)
    span = 1 + int(held.max())
    keys = plan.length * span + plan.first if len(plan.length) else np.empty(0, np.int64)
    salts = max(16, int(held.sum()) // 200_000)
    order = [c for c in rows.columns if c != length_col]
    salt = F.pmod(F.xxhash64(*id_cols), F.lit(salts))
    ranked = spread_rank(rows, [length_col], [c for c in order if c not in ("ids",)], salt, into="_rank")
    at = ranked.columns.index(length_col)
    schema = type(rows.schema)([*rows.schema.fields]).add("sequence_id", "long").add("offset", "long")

    def run(frames):
        for b in frames:
            length, rank = b.column(at).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            e = np.searchsorted(keys, length * span + rank, "right") - 1
            j = rank - plan.first[e]
            sequence, offset = plan.sequence[e] + j // plan.each[e], plan.offset[e] + (j % plan.each[e]) * length
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(run, schema)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, effort: int | None = EFFORT) -> DataFrame:
    """Pieces of the texts with their places; one row per piece. `effort`: steps of the search, None to proof."""
    return place(cut(pieces(df, id_col, text_col, capacity, path=path)), capacity=capacity, effort=effort).withColumnRenamed("id", id_col)


def op4_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir))
