"""Lines that many documents share, removed by streams over sorted hash ranges.

Every distinct line key of a document becomes (hash, document, positions).  The records are partitioned by ranges of (hash, document)
and sorted within them, so a key in a third of all documents spreads over as many ranges as it fills.  Each range is streamed once: a run of
one hash is held back until its tenth document, then it is known to be frequent and flows on; shorter runs inside a range are dropped from the stream.  Only
the first and the last run of a range can go on in another one; if they are short, their few records and the run's count go to a second look at
the counts of all ranges.  What returns to a document is a compressed bitmap of the lines to keep, never text.

Bitmaps of a proven total size go to all tasks and no text moves; beyond it a bitmap filter (KeyFilter) leaves the documents that lose nothing where they
are, and only the others are shuffled to their bitmaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, KeyFilter, discard, free_name, parts_of, shipped, stash, tidy, width_for

_SPACE = ASCII_SPACE.encode()
#: Records of a range on average, rows of a text that are told from its repeats in a task, records that a run holds back, and bytes of bitmaps that are broadcast at most.
RANGE_RECORDS, REMEMBERED, HELD, BROADCAST_BYTES = 2_000_000, 200_000, 100_000, 64 << 20


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


RECORDS = "h1 long, h2 long, doc long, print long, lines binary"
STREAMED = "h1 long, h2 long, doc long, print long, lines binary, sure boolean, count long"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, print, text) -> the records of each text, those of a row that repeats in the task once."""
    done: set[tuple[int, int]] = set()
    for batch in batches:
        for lo, count in parts_of(batch.column(2)):
            part = batch.slice(lo, count)
            docs, prints, texts = (part.column(c).to_pylist() for c in range(3))
            out: list[list] = [[] for _ in range(3)]
            hashes: list[bytes] = []
            for doc, mark, text in zip(docs, prints, texts, strict=True):
                if (doc, mark) in done:
                    continue
                if len(done) >= REMEMBERED:
                    done.clear()
                done.add((doc, mark))
                places: dict[bytes, list[int]] = {}
                for n, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
                    key = line_key(line)
                    if key:
                        places.setdefault(xxhash.xxh3_128_digest(key), []).append(n)
                for h, found in places.items():
                    hashes.append(h)
                    out[0].append(doc)
                    out[1].append(mark)
                    out[2].append(np.array(found, "<u4").tobytes())
            both = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["h1", "h2", "doc", "print", "lines"])


def _stream(least: int):
    """Sorted records -> records of frequent lines (sure), and for the first and last run of the range its count and, if it is short, its records (not sure).

    A run of few documents with very many records (rows that repeat an id with other texts) is not held back: its records go out as not sure, with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, True
        count, last_doc, held = 0, None, []  # of the current run; held: slices until it is known to be frequent
        waiting, owes = 0, False  # records held, and whether some have gone out as not sure

        def closing(edge: bool) -> Iterator[pa.RecordBatch]:
            if key is None or not (edge or owes):
                return
            if count < least:
                for piece in held:
                    yield marked(piece, None)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.bool_()), pa.array([count], pa.int64())], names=names)

        names = [c.split()[0] for c in STREAMED.split(", ")]

        def marked(piece: pa.RecordBatch, sure: bool | None) -> pa.RecordBatch:
            n = piece.num_rows
            return pa.RecordBatch.from_arrays([*piece.columns, pa.array([sure] * n, pa.bool_()), pa.nulls(n, pa.int64())], names=names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h1, h2, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            cuts = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [n]])
            fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
            seen = np.cumsum(fresh)
            sure: list[tuple[int, int]] = []
            for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
                if key is None or key[0] != h1[lo] or key[1] != h2[lo]:
                    yield from closing(first)
                    first = key is None
                    key, count, last_doc, held, waiting, owes = (int(h1[lo]), int(h2[lo])), 0, None, [], 0, False
                new = int(seen[hi - 1] - seen[lo]) + int(last_doc != int(doc[lo]))
                before, count, last_doc = count, count + new, int(doc[hi - 1])
                if count >= least:
                    if before < least:
                        for piece in held:
                            yield marked(piece, True)
                        held = []
                    sure.append((lo, hi))
                elif hi == n or first:
                    held.append(batch.slice(lo, hi - lo))
                    waiting += hi - lo
                    if waiting >= HELD:
                        for piece in held:
                            yield marked(piece, None)
                        held, waiting, owes = [], 0, True
            for lo, hi in sure:
                yield marked(batch.slice(lo, hi - lo), True)
        yield from closing(True)

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, dropped = [], []
        for found in batch.column(2).to_pylist():
            places = np.unique(np.frombuffer(b"".join(found), "<u4"))
            keep = np.ones((int(places[-1]) // 8 + 1) * 8, np.uint8)
            keep[places] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
            dropped.append(len(places))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary()), pa.array(dropped, pa.int64())], names=["doc", "print", "keep_bitmap", "n_dropped"])


def kept_lines(text: str, bitmap: bytes | None) -> str:
    """The lines of a text that its bitmap keeps; lines past its end are kept."""
    if bitmap is None:
        return text
    lines = text.split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)]
    gone = set(np.flatnonzero(keep == 0).tolist())
    return "\n".join(x for n, x in enumerate(lines) if n not in gone)


def keep_bitmaps(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, print, keep_bitmap, n_dropped) for the documents that lose lines; print is xxhash64 of the text, doc the id (the print where the id is null).
    Bits past the last dropped line are left out: such lines stay."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.xxhash64(text)
    source = shipped(docs).select(F.coalesce(F.col(id_col).cast("long"), mark).alias("doc"), mark.alias("print"), text.alias("text"))
    # written down once: ranges are drawn from a sample of the records before they are shuffled
    records = stash(source.mapInArrow(tidy(_records), RECORDS), "records")
    order = ["h1", "h2", "doc"]
    ranges = records.repartitionByRange(width_for(spark, records.count(), RANGE_RECORDS), *order).sortWithinPartitions(*order)
    streamed = stash(ranges.mapInArrow(_stream(least), STREAMED), "runs")
    discard(records)
    totals = streamed.where("count is not null").groupBy("h1", "h2").agg(F.sum("count").alias("total")).where(F.col("total") >= least).select("h1", "h2")
    unsure = streamed.where("count is null and sure is null").join(totals, ["h1", "h2"], "left_semi")
    found = streamed.where("sure").select("doc", "print", "lines").union(unsure.select("doc", "print", "lines"))
    gathered = found.groupBy("doc", "print").agg(F.collect_set("lines").alias("lines"))  # repeats of a row add nothing
    out = stash(gathered.mapInArrow(_bitmaps, "doc long, print long, keep_bitmap binary, n_dropped long"), "bitmaps")
    discard(streamed)
    return out


def _cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """(text, bitmap) -> the lines that stay; null without a bitmap."""
    for texts, maps in batches:
        done: list[pa.Array] = []
        for at, count in parts_of(texts):
            rows = zip(texts.slice(at, count).to_pylist(), maps.slice(at, count).to_pylist(), strict=True)
            done.append(pa.array([None if m is None else kept_lines(t, m) for t, m in rows], pa.string()))
        yield pa.concat_arrays(done) if done else pa.array([], pa.string())


def drop_frequent_lines(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs, one row per row, its text without the lines whose key stands in at least `least` documents, and n_lines, n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case; empty keys are never frequent.  A null or empty text is one
    empty line and comes back empty.  Documents are counted by id: rows that repeat an id are one document (rows without an id count by text).  Other columns, whatever their
    names, pass through; columns named n_lines or n_dropped are replaced.  An empty table gives an empty result."""
    maps = keep_bitmaps(docs, least, id_col, text_col)
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    own: dict[str, str] = {}
    for n in ("d", "p", "doc", "print", "keep_bitmap", "n_dropped", "hit"):
        own[n] = free_name([*names, *own.values()], n)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    mark = F.xxhash64(text)
    keyed = docs.select("*", F.coalesce(F.col(f"`{id_col}`").cast("long"), mark).alias(own["d"]), mark.alias(own["p"]))
    size = maps.agg(F.sum(F.length("keep_bitmap") + 64)).first()[0] or 0
    small = KeyFilter(maps, "doc", "print") if size > broadcast_bytes else None
    maps = maps.withColumnsRenamed({n: own[n] for n in maps.columns})
    same = (F.col(own["d"]) == F.col(own["doc"])) & (F.col(own["p"]) == F.col(own["print"]))
    if small is None:
        joined = keyed.join(F.broadcast(maps), same, "left")
    else:
        marked = small.mark(keyed, own["hit"], F.col(own["d"]), F.col(own["p"]))
        joined = marked.where(F.col(own["hit"])).join(maps, same, "left")  # a join that can spill: a partition's bitmaps may be many
        joined = joined.unionByName(marked.where(~F.col(own["hit"])), allowMissingColumns=True)
    bitmap = F.col(own["keep_bitmap"])
    cut = F.arrow_udf(tidy(_cut), "string")(F.when(bitmap.isNotNull(), text), bitmap)  # other texts stay in the JVM
    lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    kept = [F.coalesce(cut, text).alias(n) if n == text_col else F.col(f"`{n}`") for n in names]
    return joined.select(*kept, lines.cast("long").alias("n_lines"), F.coalesce(own["n_dropped"], F.lit(0).cast("long")).alias("n_dropped"))
