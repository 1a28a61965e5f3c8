"""Secret scan with a recursive decoding worklist.

A text is the first layer. Every layer is scanned for the base patterns, then unwrapped: URL escapes, Unicode and
character-reference escapes, base64 runs, and gzip, zlib or bzip2 data inside them give further layers.

* Escapes are undone once, of either sort, and until none is left, in one pass from the right in which what an escape
  gives may begin another one. Both results are layers. What stands between them differs only in the characters that
  begin escapes, which no pattern has. Such a layer keeps the range of the original that each character came from, so a
  finding is a span of the original.
* All that a base64 run holds, at any depth, has the run as its span, so below it only the kinds that occur count. Bytes
  are read as text and, where they are compressed, unpacked, level by level, with streams that follow one another.
  A level's text is read in windows of about `unpack_limit` bytes that end where no pattern, escape or run can stand. Where
  a window has no such place, the next one is read with its end, blanks taken as one, and a run that is still open is
  decoded as a stream of its own. A level is held in memory up to that size and unpacked again from the one above it
  beyond; so memory follows neither what data unpacks to nor its depth.
* Bytes that were met before, in a level above or elsewhere in the text, are not entered again: a cycle ends there.

Null and empty texts have no spans. Repeated rows are scanned each by itself. Findings that begin at one place are listed
by kind, then end. An empty table gives no rows, or an empty table. Other columns are not read, or stay as they are.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import hashlib
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import documents

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
EIGHT = re.compile(r"[0-9a-f]{8}")

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:amp|lt|gt|quot|apos|equals|colon);")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
BREAK = r"[ \t]*(?:\r?\n|\r|(?:\\r)?\\n)[ \t]*"
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{BREAK}[A-Za-z0-9+/_-]++)+={{0,2}}")
#: How base64 of compressed data begins, behind a character that may also be a separator.
PACKED = re.compile(r"(?<=[+/_-])(?:H4sI|Qlpo|e[A-P][A-Za-z0-9+/_-]{2})")
ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|" + UNICODE.pattern.replace("(?:\\\\u[0-9A-Fa-f]{4})+", "\\\\u[0-9A-Fa-f]{4}").replace("(?:\\\\x[0-9A-Fa-f]{2})+", "\\\\x[0-9A-Fa-f]{2}"))
LEAD = re.compile(r"[%\\&]")
#: The shortest finding has twelve characters.
TWELVE = re.compile(rb"[\x20-\x7e]{12}")
#: Up to the last byte that stands in no pattern, escape or base64 run, nor between a run's lines.
CLOSED = re.compile(rb".*[^\0\t\n\r \"#%&'+./0-9:;=A-Z\\_a-z{}-]", re.S)
BEFORE_RUN = re.compile(r".*[^A-Za-z0-9+/_\s\\-]", re.S)
NO_RUN = re.compile(rb"[^A-Za-z0-9+/_\s\\-]")
CARRIED = 4096
NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&equals;": "=", "&colon;": ":"}


def matches(text: str) -> list[tuple[int, int, int]]:
    """Base findings as (start, kind number, end): leftmost and non-overlapping per kind."""
    low = text.lower()
    out = []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if EIGHT.search(text[::3]):  # 24 hexadecimal digits in a row hold eight of every third character in a row
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


@dataclass
class Layer:
    """lo and hi: where in the original each character begins and ends; None where the layer is the original."""

    text: str
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.lo is None else (int(self.lo[a:b].min()), int(self.hi[a:b].max()))

    def place(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return (np.arange(a, b), np.arange(a + 1, b + 1)) if self.lo is None else (self.lo[a:b], self.hi[a:b])


def _url(run: str) -> list[tuple[str, int]]:
    """Characters of a run of URL escapes, each with the escapes' length."""
    data = bytes.fromhex(run.replace("%", ""))
    return [(c, 3 * len(c.encode("utf-8", "surrogateescape"))) for c in data.decode("utf-8", "surrogateescape")]


def _unicode(run: str) -> list[tuple[str, int]]:
    if run[0] == "&":
        if run[1] != "#":
            return [(NAMED[run], len(run))]
        code = int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])
    elif run[1] == "x":
        return [(chr(b), 4) for b in bytes.fromhex(run.replace("\\x", ""))]
    elif run[1] == "U" or run[2] == "{":
        code = int(run[2:].strip("{}"), 16)
    else:
        units = bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be", "surrogatepass")
        return [(c, 12 if ord(c) > 0xFFFF else 6) for c in units]
    return [(chr(code) if code < 0x110000 else "�", len(run))]


def unescaped(layer: Layer, marks: str, pattern: re.Pattern, read) -> Layer | None:
    """The layer with the pattern's runs undone; None if it has none. Every run begins with one of the marks."""
    if not any(c in layer.text for c in marks) or not pattern.search(layer.text):
        return None
    text, lo, hi, end = [], [], [], 0
    for m in pattern.finditer(layer.text):
        text.append(layer.text[end : m.start()])
        a, b = layer.place(end, m.start())
        lo.append(a)
        hi.append(b)
        at = m.start()
        for c, size in read(m.group()):
            text.append(c)
            s, e = layer.span(at, at + size)
            lo.append([s])
            hi.append([e])
            at += size
        end = m.end()
    text.append(layer.text[end:])
    a, b = layer.place(end, len(layer.text))
    return Layer("".join(text), np.concatenate([*lo, a]).astype(np.int64), np.concatenate([*hi, b]).astype(np.int64))


def resolved(text: str) -> list[tuple[str, int, int]]:
    """The text with escapes undone until none is left, as stretches (characters, from, to): those of the original as they
    are, or what its characters in between stand for, which are more. Bytes beyond ASCII stay halves of characters, which
    no pattern has."""
    stack: list[tuple[str | None, int, int]] = []  # what follows, the nearest last; None: as it is

    def ahead() -> str:
        out, i = "", len(stack)
        while i and len(out) < 10:
            i -= 1
            c, a, b = stack[i]
            out += text[a : min(b, a + 10)] if c is None else c
        return out[:10]

    def take(n: int) -> int:
        """Takes n characters away; where the last of them ended in the original."""
        while True:
            c, a, b = stack.pop()
            size = b - a if c is None else len(c)
            if size > n:
                stack.append((c, a + n, b))
                return a + n
            n -= size
            if not n:
                return b

    end = len(text)
    for at in reversed(array("q", (m.start() for m in LEAD.finditer(text)))):
        if at + 1 < end:
            stack.append((None, at + 1, end))
        char, stop, end = text[at], at + 1, at
        while char in "%\\&" and (m := ESCAPE.match(char + ahead())):
            stop = take(m.end() - 1)
            char = chr((0xDC00 if m.group()[1] >= "8" else 0) + int(m.group()[1:], 16)) if char == "%" else _unicode(m.group())[0][0]
        stack.append((None if stop == at + 1 else char, at, stop))
    stack.append((None, 0, end))
    out: list[tuple[str, int, int]] = []
    for c, a, b in reversed(stack):
        out.append((text[a:b] if c is None else c, a, b))
    return out


def _unpacker(head: bytes):
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and int.from_bytes(head[:2]) % 31 == 0:
        return zlib.decompressobj(15)
    return bz2.BZ2Decompressor() if head[:3] == b"BZh" else None


#: Opens bytes for reading: (whether something of its own begins here, bytes). What begins has at least three bytes.
Source = Callable[[], Iterator[tuple[bool, bytes]]]


def _unpacked(source: Source, part: int) -> Iterator[tuple[bool, bytes]]:
    """What the compressed streams hold that begin where the source says so, or right behind one another; a broken one
    ends early."""
    d, behind, rest, first, held = None, False, b"", False, b""
    for begins, data in source():
        if begins:
            if held:
                yield first, held
            d, behind, rest, first, held = _unpacker(data[:3]), False, b"", True, b""
        while d is not None or behind:
            if behind:  # a stream has ended; another one may follow
                rest = (rest + data).lstrip(b"\0")
                if len(rest) < 3:
                    break
                if held:
                    yield first, held
                d, behind, data, rest, first, held = _unpacker(rest[:3]), False, rest, b"", True, b""
                continue
            try:
                got = d.decompress(data, part)
            except (zlib.error, OSError, EOFError, ValueError):
                d = None
                break
            data = getattr(d, "unconsumed_tail", b"")
            held += got
            if len(held) >= 3 or (held and not first):
                yield first, held
                first, held = False, b""
            if d.eof:
                d, behind, data = None, True, d.unused_data
            elif not got and not data:
                break
    if held:
        yield first, held


def _readable(data: bytes) -> bool:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return all(c.isprintable() or c in "\t\r\n" for c in text)


def _blocks(text: str):
    """Places of the lines that wrapped base64 may stand in: lines of one length with a shorter last one, and all lines that follow one another."""
    for m in WRAPPED.finditer(text):
        lines = [(x.start(), x.end()) for x in re.finditer(r"[A-Za-z0-9+/_-]+={0,2}", re.sub(r"\\[rn]", "  ", m.group()))]
        lines = [(m.start() + a, m.start() + b) for a, b in lines]
        at, whole = 0, False
        while at < len(lines) - 1:
            end, size = at + 1, lines[at][1] - lines[at][0]
            while end < len(lines) and lines[end][1] - lines[end][0] == size:
                end += 1
            last = end < len(lines) and lines[end][1] - lines[end][0] < size
            if end + last - at > 1:
                whole |= end + last - at == len(lines)
                yield lines[at : end + last]
            at = end
        if not whole:
            yield lines


def _runs(text: str):
    """Start and text of each base64 run within a line; only words that are long enough are looked into."""
    at = 0
    for word in text.split():
        if len(word) >= 16:
            at = text.index(word, at)
            for m in BASE64.finditer(word):
                yield at + m.start(), m.group()
            at += len(word)


def _decoded(run: str) -> bytes:
    run = run.rstrip("=")
    if len(run) % 4 == 1:
        run = run[:-1]
    return base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4))


def _pieces(run: str, before: str):
    """Start and end of what may be base64 by itself where a run's +, /, - or _ are separators: its plain and its
    URL-safe parts, what follows a separator and begins like compressed data, and the other three alignments. Behind a
    per cent sign the run may begin after the digits of escaped ones."""
    if before == "%" and (m := re.match("(?:25)+", run)):
        yield 2, len(run)
        yield m.end(), len(run)
    if not any(c in run for c in "+/-_"):
        return
    for one in (r"[A-Za-z0-9+/]{16,}={0,2}", r"[A-Za-z0-9_-]{16,}={0,2}"):
        for m in re.finditer(one, run):
            if m.end() - m.start() < len(run):
                yield m.span()
    for m in PACKED.finditer(run):
        if _unpacker(_decoded(m.group())) is not None:
            yield m.start(), len(run)
    for k in (1, 2, 3):
        yield k, len(run)


def contents(text: str) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and bytes of what may be base64 in a text; wrapped lines are joined first. Nothing in a run that is plain
    text as a whole is looked at again."""
    clean: list[tuple[int, int]] = []
    for lines in _blocks(text):
        run = "".join(text[a:b] for a, b in lines)
        if len(run) >= 16:
            data = _decoded(run)
            if _readable(data):
                clean.append((lines[0][0], lines[-1][1]))
            yield lines[0][0], lines[-1][1], data
    clean.sort()
    ends = np.maximum.accumulate([b for _, b in clean]) if clean else []
    for start, run in _runs(text):
        at = bisect.bisect_right(clean, (start, len(text)))
        if at and ends[at - 1] >= start + len(run):
            continue
        data = _decoded(run)
        yield start, start + len(run), data
        pieces = list(_pieces(run, text[start - 1 : start]))
        if pieces and not _readable(data):
            for a, b in pieces:
                yield start + a, start + b, _decoded(run[a:b])


def _variants(text: str) -> Iterator[str]:
    """A text whose places don't count, and what undoing its escapes gives."""
    yield text
    for pattern, read in ((URL, _url), (UNICODE, _unicode)):
        once = pattern.sub(lambda m, read=read: "".join(c for c, _ in read(m.group())), text) if LEAD.search(text) else text
        if once != text:
            yield once
            if ESCAPE.search(once):
                yield "".join(c for c, _, _ in resolved(text))


def _run_at(source: Source, start: int, shift: int, part: int) -> Iterator[tuple[bool, bytes]]:
    """The bytes of the base64 run that begins at a place of a source, decoded from its character `shift` on; white space
    and escaped line ends in it don't count."""
    at, rest, first = 0, b"", True
    for _, data in source():
        at += len(data)
        if at <= start:
            continue
        data = data[max(0, start - at + len(data)) :]
        stop = NO_RUN.search(data)
        rest += re.sub(rb"\\[rn]|[\s\\]", b"", data[: stop.start()] if stop else data)
        if first:
            if len(rest) < 12 and not stop:
                continue
            rest = rest[shift:]
        whole = len(rest) - len(rest) % 4
        out = _decoded((rest if stop else rest[:whole]).decode("latin-1"))
        rest = rest[whole:]
        if out:
            yield first, out
            first = False
        if stop:
            return
    if rest and (out := _decoded(rest.decode("latin-1"))):
        yield first, out


def _narrow(text: str) -> str:
    """UTF-16 of either order, read byte by byte, without its zeros; a zero character becomes a control character."""
    return text.replace("\0\0\0", "\1").replace("\0", "")


class Inside:
    """Kinds of findings in bytes, at any depth."""

    def __init__(self, part: int):
        self.part = part
        self.known: dict[bytes, set[int]] = {}

    def of_bytes(self, data: bytes) -> set[int]:
        if _unpacker(data[:3]) is None and not TWELVE.search(data.replace(b"\0", b"") if b"\0" in data else data):
            return set()
        return self.of(lambda: iter([(True, data)]))

    def of(self, source: Source) -> set[int]:
        levels: list[set[int]] = []
        while True:
            digest, packed, held, size = hashlib.sha256(), False, [], 0
            for begins, data in source():
                digest.update(b"+" * begins + data)
                packed |= begins and _unpacker(data[:3]) is not None
                size += len(data)
                held = [*held, (begins, data)] if size <= self.part else []
            if (key := digest.digest()) in self.known:
                levels.append(self.known[key])
                break
            levels.append(self.known.setdefault(key, set()))
            if size <= self.part:
                source = partial(iter, held)
            levels[-1].update(self.text_of(source))
            if not packed:
                break
            source = partial(_unpacked, source, self.part)
        for i in range(len(levels) - 2, -1, -1):
            levels[i] |= levels[i + 1]
        return levels[0]

    def text_of(self, source: Source) -> set[int]:
        """Kinds in the text of one level."""
        found: set[int] = set()
        at, held, tail, in_run, before = 0, b"", "", False, None
        for data in self._chunks(source):
            held += data or b""
            while held and (data is None or len(held) > self.part):
                closed = CLOSED.match(held[: self.part])
                last = data is None and len(held) <= self.part
                cut = len(held) if last else closed.end() if closed else self.part
                window, is_open = held[:cut].decode("latin-1"), not last and closed is None
                skip = 0
                if in_run and (m := NO_RUN.search(held[:cut])):
                    skip, in_run = m.start(), False
                elif in_run:
                    skip = cut
                again, before = (window, tail, skip) == before, (window, tail, skip)
                for text in () if again else (window, _narrow(window)) if "\0" in window else (window,):
                    for t in _variants(re.sub("  +", " ", tail + text)):
                        found.update(k for _, k, _ in matches(t))
                    if skip < cut:
                        for t in _variants(text[skip:] if text is window else text):
                            for _, _, inner in contents(t):
                                found |= self.of_bytes(inner)
                if is_open and not in_run:
                    ended = BEFORE_RUN.match(window)
                    start = max(skip, ended.end() if ended else 0)
                    in_run = start < cut
                    for shift in range(4 * in_run):
                        found |= self.of(partial(_run_at, source, at + start, shift, self.part))
                tail = re.sub("  +", " ", tail + window)[-CARRIED:] if is_open else ""
                in_run &= is_open
                held, at = held[cut:], at + cut
        return found

    def _chunks(self, source: Source) -> Iterator[bytes | None]:
        """The source's bytes in pieces of bounded size, then None."""
        for _, data in source():
            for i in range(0, len(data), self.part):
                yield data[i : i + self.part]
        yield None


def scan(text: str, unpack_limit: int = 1 << 20) -> list[tuple[int, int, int, int]]:
    """All findings as (start, kind number, end, depth), by start, then kind, then end; depth 0 are the base ones."""
    found: dict[tuple[int, int, int], int] = {}
    inside = Inside(unpack_limit)
    work = [(Layer(text), 0)]
    while work:
        layer, depth = work.pop(0)
        for a, kind, b in matches(layer.text):
            s, e = layer.span(a, b)
            found.setdefault((s, kind, e), depth)
        for a, b, data in contents(layer.text):
            if kinds := inside.of_bytes(data):
                s, e = layer.span(a, b)
                for kind in kinds:
                    found.setdefault((s, kind, e), depth + 1)
        if depth == 0:
            once = [x for x in (unescaped(layer, "%", URL, _url), unescaped(layer, "\\&", UNICODE, _unicode)) if x is not None]
            work += [(x, 1) for x in once]
            if any(ESCAPE.search(x.text) for x in once):
                work.append((_fully(text), 2))
    return sorted((s, k, e, d) for (s, k, e), d in found.items())


def _fully(text: str) -> Layer:
    """The text with escapes undone until none is left."""
    lo, hi, out = [], [], []
    for c, a, b in resolved(text):
        out.append(c)
        same = len(c) == b - a
        lo.append(np.arange(a, b) if same else np.full(len(c), a))
        hi.append(np.arange(a + 1, b + 1) if same else np.full(len(c), b))
    return Layer("".join(out), np.concatenate(lo).astype(np.int64), np.concatenate(hi).astype(np.int64))


SPANS = "array<struct<kind:string,start:long,end:long,depth:int>>"


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row; spans by start, then kind."""
    kind = df.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())]))

    def run(frames):
        for b in frames:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                spans = [[{"kind": KINDS[k], "start": s, "end": e, "depth": d} for s, k, e, d in scan(t)] if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, shape)], names=["id", "spans"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, spans {SPANS}")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secrets(spark, sf_dir):
    found = find(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["depth"] == 0)

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(text: str) -> str:
    """The text with each stretch of findings replaced by the name of its first one's kind."""
    out, end = [], 0
    stretch: list[list[int]] = []
    for s, k, e, _ in scan(text):
        if stretch and s < stretch[-1][2]:
            stretch[-1][2] = max(e, stretch[-1][2])
        else:
            stretch.append([s, k, e])
    for s, k, e in stretch:
        out += [text[end:s], f"[{KINDS[k]}]"]
        end = e
    return "".join([*out, text[end:]])


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with their texts redacted; other columns as they are."""
    at = df.columns.index(text_col)

    def run(frames):
        for b in frames:
            texts = [t if not t else redacted(t) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return df.mapInArrow(run, df.schema)
