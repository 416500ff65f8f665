"""Cutting oversized items at natural boundaries, range by range.

An item (a text column's value or a whole file) is seen as byte ranges of
``range_bytes``.  A range is read with a halo on both sides that is widened
until it closes every run of blanks or marks and every heading that crosses the
seam, so a boundary is judged alike wherever ranges end; the range that owns the
first character of the next unit owns the boundary.

1. *detect* (parallel over ranges): boundaries with their strength and the
   range's character count, in a few array passes;
2. *stitch*: prefix sums of the counts turn places in a range into places in
   the item; a boundary table cut into blocks of ``block`` characters gives one
   anchor a block (its first paragraph, else sentence, else blank);
3. *plan* (parallel over the segments between anchors): a moving cursor cuts
   each piece at the last of the strongest boundaries within the limit; piece
   numbers are prefix sums of the segments' counts;
4. *emit*: every range gives its share of each piece by offset in one pass; no
   task ever holds a whole file.

An item of one range needs no stitching and goes through the same steps in one
pass.  Neither range size nor number of tasks changes the pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import materialize, pick

HALO = 512
SECTION, PARAGRAPH, SENTENCE, BLANK = 4, 3, 2, 1
#: What a piece may end at, in order of preference, and from which share of the limit on.
CHOICES = ((SECTION, 0.5), (PARAGRAPH, 0.5), (SENTENCE, 0.5), (SENTENCE, 0.0), (BLANK, 0.0))
_BREAKS = "\n\r\x0b\x0c\x85\u2028\u2029"
_HEAD = re.compile(rf"[^{_BREAKS}.!?;:,]{{1,80}}+(?:\r\n|[{_BREAKS}])\s*+\S|={{1,6}}[^{_BREAKS}=]{{1,200}}+={{1,6}}+[ \t]*+(?:[{_BREAKS}]|$)")
_WIDE = re.compile(r"(?<![。！？])[。！？]++[”』」）]*+\s*+(?=\S)")
_OPEN_END = "\"'”’»)]』」）.!?।॥؟۔…。！？"
_OTHER = re.compile(rf"[^\s{re.escape(_OPEN_END)}]")  # ends every run of blanks and marks
_CLOSED = re.compile(r"[\s\S]{220}\s*+\S")  # longer than any heading, and no open run of blanks


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of every code point: 1 blank, 2 line break, 3 end mark, 4 closing mark."""
    t = np.zeros(0x110000, np.uint8)
    for cp in range(0x3001):
        t[cp] = chr(cp).isspace()
    for kind, chars in ((2, _BREAKS), (3, ".!?।॥؟۔…"), (4, "\"'”’»)]")):
        t[[ord(c) for c in chars]] = kind
    return t


def boundaries(text: str, lo: int, hi: int, at_byte: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places ``lo <= p < hi`` in ``text`` where a new unit begins, ascending, with strengths.

    Section: a heading after a blank line; paragraph: after a blank line;
    sentence: after an end mark or a line break; blank: between words, the
    first in each 64 bytes of the item (``text`` begins at byte ``at_byte``).
    """
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[cp]
    edge = np.flatnonzero(np.diff(((kind == 1) | (kind == 2)).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    begin, end = edge[0::2], edge[1::2]
    keep = end < cp.size
    begin, end = begin[keep], end[keep]
    brk = kind == 2
    brk[1:] &= ~((cp[1:] == 10) & (cp[:-1] == 13))
    count = np.concatenate(([0], np.cumsum(brk + (cp == 0x2029))))
    lines = count[end] - count[begin]
    strength = np.where(lines >= 2, PARAGRAPH, np.where(lines == 1, SENTENCE, 0)).astype(np.int8)
    before = np.where(begin > 0, kind[np.maximum(begin - 1, 0)], 0)
    strength[(strength == 0) & (before == 3)] = SENTENCE
    for i in np.flatnonzero((strength == 0) & (before == 4)).tolist():
        j = int(begin[i]) - 1
        while j >= 0 and kind[j] == 4:
            j -= 1
        if j >= 0 and kind[j] == 3:
            strength[i] = SENTENCE
    gap = strength == 0
    width = np.cumsum(1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)) if gap.any() else None
    if width is not None:
        block = (at_byte + width[end[gap] - 1]) >> 6
        strength[np.flatnonzero(gap)[np.diff(block, prepend=-1) > 0]] = BLANK
    mine = (end >= lo) & (end < hi) & (strength > 0)
    place, strength = end[mine], strength[mine]
    for i in np.flatnonzero(strength == PARAGRAPH).tolist():
        if _HEAD.match(text, int(place[i])):
            strength[i] = SECTION
    wide = np.array([m.end() for m in _WIDE.finditer(text) if lo <= m.end() < hi], np.int64)
    if wide.size:
        place, strength = np.concatenate((place, wide)), np.concatenate((strength, np.full(wide.size, SENTENCE, np.int8)))
        order = np.lexsort((-strength, place))
        place, strength = place[order], strength[order]
        first = np.diff(place, prepend=-1) > 0
        place, strength = place[first], strength[first]
    return place.astype(np.int64), strength


def anchors(p: np.ndarray, s: np.ndarray, total: int, block: int) -> list[int]:
    """Where the segments of an item begin: 0, and one place in each further block of ``block`` characters."""
    out = [0]
    for lo in range(block, total, block):
        at = slice(*np.searchsorted(p, (lo, lo + block)))
        out.append(next((int(x[0]) for least in (PARAGRAPH, SENTENCE, BLANK) if (x := p[at][s[at] >= least]).size), lo))
    return out


def plan(p: np.ndarray, s: np.ndarray, start: int, stop: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of the segment ``[start, stop)`` with boundaries ``p`` of strength ``s``."""
    out = []
    while stop - start > limit:
        far = start + limit
        at = slice(np.searchsorted(p, start, side="right"), np.searchsorted(p, far, side="right"))
        w, v = p[at], s[at]
        end = far
        for strength, least in CHOICES:
            fit = np.flatnonzero((v >= strength) & (w >= start + max(1, least * limit)))
            if fit.size:
                end = int(w[fit[-1]])
                break
        out.append((start, end))
        # the next piece starts at the first boundary within the overlap
        back = np.flatnonzero((v >= SENTENCE) & (w >= end - overlap) & (w < end))
        start = int(w[back[0]]) if back.size else end
    if stop > start:
        out.append((start, stop))
    return out


def block_of(limit: int) -> int:
    """Characters of a block: wide against the limit, so that anchors cost hardly any room."""
    return max(1 << 20, 64 * limit)


def cut(text: str, limit: int, overlap: int, block: int) -> list[tuple[int, int]]:
    """Pieces of a whole text."""
    p, s = boundaries(text, 0, len(text))
    begin = anchors(p, s, len(text), block)
    return [piece for a, b in zip(begin, [*begin[1:], len(text)]) for piece in plan(p, s, a, b, limit, overlap)]


def _whole(limit: int, overlap: int, block: int):
    """(item, id, text) of one range each -> pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "piece_no", "start_at", "end_at", "piece"]
        for batch in batches:
            rows, size = [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_py()
                rows += [(i, k, a, b, text[a:b]) for k, (a, b) in enumerate(cut(text, limit, overlap, block))]
                size += len(text)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _PIECE_KINDS)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _PIECE_KINDS)], names)

    return run


_PIECE_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
_RANGE = "item long, range_no int, at_byte long, left int, body int, data binary"
DETECTED = "item long, range_no int, n_chars int, places array<int>, strengths array<byte>, text string"


def _aligned(data: bytes, at: int) -> int:
    """The first place from ``at`` on that is not inside a UTF-8 character."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def with_halo(read: Callable[[int, int], bytes], start: int, body: int, size: int) -> tuple[int, bytes]:
    """Bytes before ``start`` and the range with its halos; ``read(offset, length)`` gives bytes of the item."""
    own, left, right = read(start, body), HALO, HALO
    while True:
        before = read(max(0, start - left), min(left, start))
        if left >= start or _OTHER.search(before[_aligned(before, 0) :].decode("utf-8", "replace")):
            break
        left *= 4
    while True:
        after = read(start + body, min(right, size - start - body))
        if start + body + right >= size or _CLOSED.match(after[_aligned(after, 0) :].decode("utf-8", "ignore")):
            return len(before), before + own + after
        right *= 4


def text_ranges(items: DataFrame, range_bytes: int = 1 << 20) -> DataFrame:
    """Byte ranges with halos of ``(item, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = value.as_py()
                for no, start in enumerate(range(0, max(len(raw), 1), range_bytes)):
                    body = min(range_bytes, len(raw) - start)
                    left, data = with_halo(lambda at, n, raw=raw: raw[at : at + n], start, body, len(raw))
                    yield pa.RecordBatch.from_pylist([{"item": item, "range_no": no, "at_byte": start, "left": left, "body": body, "data": data}], _RANGE_ARROW)

    return items.select("item", F.col("text").cast("binary").alias("raw")).mapInArrow(run, _RANGE)


_RANGE_ARROW = pa.schema([("item", pa.int64()), ("range_no", pa.int32()), ("at_byte", pa.int64()), ("left", pa.int32()), ("body", pa.int32()), ("data", pa.binary())])


def file_ranges(spark: SparkSession, paths: list[str], range_bytes: int = 1 << 26) -> DataFrame:
    """Byte ranges with halos of whole files; workers seek, nobody reads a file whole."""
    from pyarrow import fs

    rows = []
    for item, path in enumerate(paths):
        system, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        size = system.get_file_info(name).size
        rows += [(item, no, path, start, min(range_bytes, size - start), size) for no, start in enumerate(range(0, max(size, 1), range_bytes))]
    todo = spark.createDataFrame(rows, "item long, range_no int, path string, start long, body int, size long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, no, path, start, body, size in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                with system.open_input_file(name) as f:
                    left, data = with_halo(lambda at, n, f=f: f.read_at(n, at), start, body, size)
                yield pa.RecordBatch.from_pylist([{"item": item, "range_no": no, "at_byte": start, "left": left, "body": body, "data": data}], _RANGE_ARROW)

    return todo.repartition(max(1, len(rows)), "item", "range_no").mapInArrow(read, _RANGE)


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, no, at_byte, left, body, value in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5)):
            data = value.as_py()
            z, a, b = _aligned(data, 0) if at_byte > left else 0, _aligned(data, left), _aligned(data, left + body)
            before, own, after = data[z:a].decode("utf-8", "replace"), data[a:b].decode("utf-8", "replace"), data[b:].decode("utf-8", "ignore")
            p, s = boundaries(before + own + after, len(before), len(before) + len(own), at_byte - left + z)
            yield pa.RecordBatch.from_arrays(
                [pa.array([item], pa.int64()), pa.array([no], pa.int32()), pa.array([len(own)], pa.int32()), pa.array([(p - len(before)).astype(np.int32)], pa.list_(pa.int32())), pa.array([s], pa.list_(pa.int8())), pa.array([own], pa.string())],
                ["item", "range_no", "n_chars", "places", "strengths", "text"],
            )


def _by_block(block: int):
    """Ranges -> their parts in each block: places in the item, and the first of each strength."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, no, base, n, places, strengths in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), batch.column(5)):
                p, s = np.array(places.as_py(), np.int64) + base, np.array(strengths.as_py(), np.int8)
                for b in range(base // block, max(base, base + n - 1) // block + 1):
                    at = slice(*np.searchsorted(p, (b * block, (b + 1) * block)))
                    first = [next(iter(p[at][s[at] >= least].tolist()), None) for least in (PARAGRAPH, SENTENCE, BLANK)]
                    rows.append((item, b, no, base, n, p[at], s[at], *first))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["item", "block", "range_no", "base", "n_chars", "p", "s", "first3", "first2", "first1"])

    return run


def _by_segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, block, anchor, p, s) -> (item, segment, p, s): what lies before a block's anchor belongs to the segment before."""
    for batch in batches:
        rows = []
        for item, b, anchor, places, strengths in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), batch.column(4)):
            p, s = np.array(places.as_py(), np.int64), np.array(strengths.as_py(), np.int8)
            k = int(np.searchsorted(p, anchor))
            rows += [(item, seg, p[x], s[x]) for seg, x in ((b - 1, slice(0, k)), (b, slice(k, None))) if p[x].size]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int8())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["item", "segment", "p", "s"])


def _plan_segments(limit: int, overlap: int):
    def run(key: tuple, segment: pa.Table, parts: pa.Table) -> pa.Table:
        if not segment.num_rows:
            return _SEGMENT_PIECES.empty_table()
        p = np.concatenate([np.empty(0, np.int64), *(np.array(x.as_py(), np.int64) for x in parts.column("p"))])
        s = np.concatenate([np.empty(0, np.int8), *(np.array(x.as_py(), np.int8) for x in parts.column("s"))])
        order = np.argsort(p, kind="stable")
        pieces = plan(p[order], s[order], segment.column("start")[0].as_py(), segment.column("stop")[0].as_py(), limit, overlap)
        return pa.table([[key[0].as_py()] * len(pieces), [key[1].as_py()] * len(pieces), list(range(len(pieces))), [a for a, _ in pieces], [b for _, b in pieces]], schema=_SEGMENT_PIECES)

    return run


_SEGMENT_PIECES = pa.schema([("item", pa.int64()), ("segment", pa.int64()), ("k", pa.int64()), ("start_at", pa.int64()), ("end_at", pa.int64())])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text, base, pieces) of a range -> its share of each piece."""
    for batch in batches:
        for item, value, no, base, pieces in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
            text, todo = value.as_py(), pieces.as_py()
            for lo in range(0, len(todo), 2048):
                part = todo[lo : lo + 2048]
                share = [text[max(x["start_at"] - base, 0) : x["end_at"] - base] for x in part]
                alone = [x["start_at"] >= base and x["end_at"] <= base + len(text) for x in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(part), pa.int64()), *(pa.array([x[c] for x in part], k) for c, k in (("piece_no", pa.int32()), ("start_at", pa.int64()), ("end_at", pa.int64()))), pa.array([no] * len(part), pa.int32()), pa.array(alone), pa.array(share, pa.string())],
                    ["item", "piece_no", "start_at", "end_at", "range_no", "alone", "t"],
                )


def split_ranges(ranges: DataFrame, limit: int, overlap: int, block: int | None = None) -> DataFrame:
    """Pieces ``(item, piece_no, start_at, end_at, piece)`` of ranges from :func:`text_ranges` or :func:`file_ranges`."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must lie between 0 and limit")
    block = block or block_of(limit)
    found = materialize(ranges.mapInArrow(_detect, DETECTED))
    # one small row a range: prefix sums over an item's ranges
    order = Window.partitionBy("item").orderBy("range_no")
    spans = found.select("item", "range_no", F.col("n_chars").cast("long").alias("n")).withColumn("base", F.sum("n").over(order) - F.col("n")).drop("n")
    totals = found.groupBy("item").agg(F.sum("n_chars").alias("total"))
    placed = found.select("item", "range_no", "n_chars", "places", "strengths").join(spans, ["item", "range_no"]).select("item", "range_no", "base", "n_chars", "places", "strengths")
    parts = materialize(placed.mapInArrow(_by_block(block), "item long, block long, range_no int, base long, n_chars int, p array<long>, s array<byte>, first3 long, first2 long, first1 long"))
    blocks = parts.groupBy("item", "block").agg(*[F.min(c).alias(c) for c in ("first3", "first2", "first1")])
    anchor = F.when(F.col("block") == 0, F.lit(0)).otherwise(F.coalesce("first3", "first2", "first1", F.col("block") * block))
    blocks = blocks.join(totals, "item").filter(F.col("block") * block < F.col("total")).select("item", "block", anchor.alias("start"), "total")
    segments = materialize(blocks.select("item", F.col("block").alias("segment"), "start", F.coalesce(F.lead("start").over(Window.partitionBy("item").orderBy("block")), "total").alias("stop")))
    starts = segments.select("item", F.col("segment").alias("block"), F.col("start").alias("anchor"))
    cut_up = parts.select("item", "block", "p", "s").join(starts, ["item", "block"]).select("item", "block", "anchor", "p", "s").mapInArrow(_by_segment, "item long, segment long, p array<long>, s array<byte>")
    made = materialize(segments.groupBy("item", "segment").cogroup(cut_up.groupBy("item", "segment")).applyInArrow(_plan_segments(limit, overlap), "item long, segment long, k long, start_at long, end_at long"))
    before = made.groupBy("item", "segment").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.partitionBy("item").orderBy("segment")) - F.col("c")).drop("c")
    pieces = made.join(before, ["item", "segment"]).select("item", (F.col("before") + F.col("k")).cast("int").alias("piece_no"), "start_at", "end_at")
    # a piece meets a range in the later of the blocks in which the two begin
    reach = pieces.select("*", F.explode(F.expr(f"sequence(start_at div {block}, (end_at - 1) div {block})")).alias("block"))
    near = reach.join(parts.select("item", "block", "range_no", "base", "n_chars"), ["item", "block"]).filter(f"base < end_at and base + n_chars > start_at and block = greatest(start_at div {block}, base div {block})")
    todo = near.groupBy("item", "range_no", "base").agg(F.collect_list(F.struct("piece_no", "start_at", "end_at")).alias("pieces"))
    shares = materialize(found.select("item", "range_no", "text").join(todo, ["item", "range_no"]).select("item", "text", "range_no", "base", "pieces").mapInArrow(_slices, "item long, piece_no int, start_at long, end_at long, range_no int, alone boolean, t string"))
    # what crosses a seam is put together; a piece is within the limit, so its shares are few and small
    joined = shares.filter("not alone").groupBy("item", "piece_no", "start_at", "end_at").agg(F.array_sort(F.collect_list(F.struct("range_no", "t"))).alias("p"))
    return shares.filter("alone").select("item", "piece_no", "start_at", "end_at", F.col("t").alias("piece")).union(joined.select("item", "piece_no", "start_at", "end_at", F.expr("array_join(transform(p, x -> x.t), '')")))


def split_texts(docs: DataFrame, id_col: str, text_col: str, limit: int, overlap: int, range_bytes: int = 1 << 20, block: int | None = None) -> DataFrame:
    """Pieces ``(id, piece_no, start_at, end_at, piece)`` of every text longer than ``limit`` characters.

    Pieces hold at most ``limit`` characters, follow each other without gaps,
    overlap by at most ``overlap`` characters and give the text back when the
    overlaps are dropped.  Texts within the limit, null and empty texts give no
    rows; repeated rows of an id and text give one set of pieces; an id with
    several long texts has the pieces of each; other columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must lie between 0 and limit")
    rows = pick(docs, id=id_col, text=text_col).filter((F.char_length("text") > limit) & F.col("id").isNotNull()).withColumn("item", F.xxhash64("id", "text"))
    size = F.octet_length("text")
    pieces = rows.filter(size <= range_bytes).dropDuplicates(["item"]).select("id", "text").mapInArrow(_whole(limit, overlap, block or block_of(limit)), "id long, piece_no int, start_at long, end_at long, piece string")
    large = rows.filter(size > range_bytes)
    if large.isEmpty():
        return pieces
    large = large.dropDuplicates(["item"])
    ranges = text_ranges(large, range_bytes)
    ranges = ranges.repartition(ranges.sparkSession.sparkContext.defaultParallelism * 4, "item", "range_no")
    return pieces.union(split_ranges(ranges, limit, overlap, block).join(rows.filter(size > range_bytes).select("item", "id").distinct(), "item").select("id", "piece_no", "start_at", "end_at", "piece"))


def split_files(spark: SparkSession, paths: list[str], limit: int, overlap: int, range_bytes: int = 1 << 26, block: int | None = None) -> DataFrame:
    """Pieces of whole UTF-8 files; ``item`` is the place in ``paths``.  Invalid bytes become U+FFFD."""
    return split_ranges(file_ranges(spark, paths, range_bytes), limit, overlap, block)
