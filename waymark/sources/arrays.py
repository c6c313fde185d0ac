"""A file that is one JSON array, read by many tasks.

Spark's line reader cuts the file into splits at the byte ``}`` (any store, any
size); a split's pieces and the bytes between them are the file again.  Whether
a byte stands in a string, and how deep, depends on all bytes before it, so a
first pass finds what each split does to that state, for both cases that it may
begin in; the states are chained, and a second pass cuts every split at the
commas between elements.  An element that a split's end cuts is put together
from its parts, which are few: two a split at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where splits may be cut; it closes an object, so pieces are about one element long.
MARK = "}"
#: Bytes that are looked at at once.
CHUNK = 4_000_000
#: Nesting at which a split may begin.
DEEPEST = 500


class Lexer:
    """Where brackets and commas stand, from one chunk to the next."""

    def __init__(self, inside: bool = False, depth: int = 0):
        self.inside, self.depth, self.escaped = inside, depth, False

    def quotes(self, data: np.ndarray) -> np.ndarray:
        """Which bytes are quotes that no backslash stands before."""
        found = data == 34
        back = np.flatnonzero(data == 92)
        if self.escaped and (not len(back) or back[0] != 0):
            found[0] = False
        if not len(back):
            self.escaped = False
            return found
        first = np.flatnonzero(np.diff(back, prepend=-2) != 1)
        starts, lengths = back[first], np.diff(np.append(first, len(back)))
        if self.escaped and starts[0] == 0:
            lengths = lengths.copy()
            lengths[0] -= 1  # the first of them is itself escaped
            ends = starts + lengths
            ends[0] += 1
        else:
            ends = starts + lengths
        after = ends[lengths % 2 == 1]
        self.escaped = bool(len(after)) and after[-1] == len(data)
        found[after[after < len(data)]] = False
        return found

    def feed(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Depth after each byte, and which bytes stand outside of strings."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        quotes = self.quotes(data)
        outside = ~((np.cumsum(quotes) & 1).astype(bool) ^ self.inside) & ~quotes
        steps = np.zeros(len(data), np.int64)
        steps[((data == 123) | (data == 91)) & outside] = 1
        steps[((data == 125) | (data == 93)) & outside] = -1
        depth = self.depth + np.cumsum(steps)
        self.inside ^= bool(quotes.sum() & 1)
        self.depth = int(depth[-1])
        return depth, outside


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", MARK).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[np.ndarray]]]:
    """Each split of a task with its bytes, in chunks; a split's rows come together."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(3)))

    left = rows()
    ahead = next(left, None)
    while ahead is not None:
        key = ahead[:2]

        def chunks(key=key):
            nonlocal ahead
            held, size = [], 0
            while ahead is not None and ahead[:2] == key:
                held.append(ahead[2])
                size += len(ahead[2]) + 1
                ahead = next(left, None)
                if size >= CHUNK:
                    yield np.frombuffer(b"}".join([*held, b""]), np.uint8)
                    held, size = [], 0
            if held:
                yield np.frombuffer(b"}".join([*held, b""]), np.uint8)

        mine = chunks()
        yield key, mine
        for _ in mine:  # whatever was not asked for
            pass


def _states(pieces: DataFrame) -> dict[str, list[tuple[int, bool, int]]]:
    """For each file the splits in order, each with the state that it begins in, and the state at the end.

    One small row a split goes through the driver.
    """

    def returns(lexer: Lexer, data: np.ndarray, seen: Counter) -> None:
        """Count how often brackets close down to each depth that is not above the split's first."""
        first = lexer.depth
        depth, _ = lexer.feed(data)
        down = depth[(np.diff(depth, prepend=first) < 0) & (depth <= 0) & (depth >= -DEEPEST)]
        seen.update(down.tolist())

    def run(batches):
        for (path, start), chunks in _splits(batches):
            out, other, seen, also = Lexer(False), Lexer(True), Counter(), Counter()
            for data in chunks:
                returns(out, data, seen)
                returns(other, data, also)
            yield pa.RecordBatch.from_pylist([{"path": path, "start": start, "odd": out.inside, "out": out.depth, "other": other.depth, "seen": [seen[-d] for d in range(DEEPEST)], "also": [also[-d] for d in range(DEEPEST)]}])

    chained: dict[str, list[tuple[int, bool, int]]] = {}
    last: dict[str, tuple[bool, int, int]] = {}
    shape = "path string, start long, odd boolean, out long, other long, seen array<long>, also array<long>"
    for r in pieces.mapInArrow(run, shape).orderBy("path", "start").collect():
        inside, depth, closed = last.get(r.path, (False, 0, 0))
        chained.setdefault(r.path, []).append((r.start, inside, depth))
        ended = (r.also if inside else r.seen)[depth] if 0 <= depth < DEEPEST else 0
        last[r.path] = (inside ^ r.odd, depth + (r.other if inside else r.out), closed + ended)
    for path, state in last.items():
        if state != (False, -1, 1):  # the mark that the reader adds at the end of the file is one too many
            raise ValueError(f"{path}: no whole array")
    return chained


_PARTS = pa.schema([("path", pa.string()), ("start", pa.int64()), ("k", pa.int64()), ("begins", pa.bool_()), ("ends", pa.bool_()), ("opened", pa.bool_()), ("closed", pa.bool_()), ("text", pa.binary())])
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True


def _parts(pieces: DataFrame, states: dict[tuple[str, int], tuple[bool, int]]) -> DataFrame:
    """What lies between the separators of each split: elements, and parts of those that its ends cut.

    ``begins`` and ``ends`` tell whether the element does so in this split,
    ``opened`` and ``closed`` whether at the brackets of the array.
    """
    sent = pieces.sparkSession.sparkContext.broadcast(states)  # a state a split

    def run(batches):
        for (path, start), chunks in _splits(batches):
            lexer = Lexer(*sent.value[path, start])
            before, gathered, k = lexer.depth, [], 0
            begins = opened = False  # of the part that is being gathered
            for n, data in enumerate(chunks):
                if start == n == 0 and data[:3].tobytes() == b"\xef\xbb\xbf":
                    data = data[3:]
                depth, outside = lexer.feed(data)
                above = np.concatenate(([before], depth[:-1]))
                before = int(depth[-1]) if len(depth) else before
                steps = outside & (above != depth)
                opens, closes = steps & (above == 0) & (depth == 1), steps & (above == 1) & (depth == 0)
                if ((above == 0) & (depth == 0) & ~(outside & _BLANK[data])).any() or (data[opens] != 91).any() or (data[closes] != 93).any():
                    raise ValueError(f"{path}: more than an array")
                raw, at, rows = data.tobytes(), 0, []
                for i in np.flatnonzero(((data == 44) & outside & (depth == 1)) | opens | closes).tolist():
                    if not opens[i]:
                        gathered.append(raw[at:i])
                        rows.append((path, start, k, begins, True, opened, bool(closes[i]), b"".join(gathered)))
                        k += 1
                    gathered, at, begins, opened = [], i + 1, True, bool(opens[i])
                if before > 0:
                    gathered.append(raw[at:])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _PARTS)], schema=_PARTS)
            if before > 0:
                row = (path, start, k, begins, False, opened, False, b"".join(gathered))
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, _PARTS)], schema=_PARTS)

    return pieces.mapInArrow(run, "path string, start long, k long, begins boolean, ends boolean, opened boolean, closed boolean, text binary")


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """``path, element`` (JSON text) of files that are one JSON array each.

    Files of any size.  A file that is no array, is cut off or goes on behind
    its array is an error, and so are a comma without an element and text that
    is not UTF-8.  An empty array has no rows; a path without a byte is an
    error.
    """
    pieces = _pieces(spark, path)
    chained = _states(pieces)
    if not chained:
        raise ValueError(f"{path}: no whole array")
    parts = _parts(pieces, {(name, start): (inside, depth) for name, rows in chained.items() for start, inside, depth in rows})
    whole = parts.where("begins AND ends").select("path", "text", "opened", "closed")
    order = Window.partitionBy("path").orderBy("start", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = parts.where("NOT (begins AND ends)").withColumn("number", F.sum(F.col("begins").cast("int")).over(order))  # two rows a split at most
    together = F.expr("unhex(array_join(transform(sort_array(collect_list(struct(start, k, hex(text) AS h))), x -> x.h), ''))")
    joined = cut.groupBy("path", "number").agg(together.alias("text"), F.bool_or("opened").alias("opened"), F.bool_or("closed").alias("closed")).drop("number")
    found = whole.unionByName(joined).withColumn("element", F.decode("text", "UTF-8"))
    blank = F.trim(F.translate("element", "\t\r\n", "   ")) == ""
    missing = F.raise_error(F.concat("path", F.lit(": an element is missing"))).cast("string")
    return found.where(~(blank & F.col("opened") & F.col("closed"))).select("path", F.when(blank, missing).otherwise(F.col("element")).alias("element"))
