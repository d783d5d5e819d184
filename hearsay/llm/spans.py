"""What the two substring operators share besides their methods: keys of rows,
minimizers, packed rows, and removing spans from texts.

Which windows repeat is decided in ``debruijn`` and ``suffixes``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import materialize, partitions
from .words import grams, mix, text_bytes

#: Parts of a partition: a task holds one of them at a time.
SLICES = 4
#: Bytes of rows that a map task holds before it sends them as blocks.
BLOCK = 32_000_000
#: Bytes of blocks that a task opens at once.
OPEN = 8_000_000
#: A note on a document: windows whose words or bytes stand elsewhere too.
SPAN = np.dtype([("doc", "<i8"), ("lo", "<u4"), ("n", "<u4")])
NOTES, TEXTS = 0, 1
PARTS_SQL = "part int, kind int, blob binary"
PARTS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def with_key(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """(key, id, text): the key orders the rows as their ids do and is unique.
    Rows that repeat an id, or have none, are ordered by their texts.
    ``carry``: columns that go along as the struct ``carried``."""
    more = [F.struct(*[docs[f"`{c}`"] for c in carry]).alias("carried")] if carry else []
    rest = ["carried"] if carry else []
    src = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"), *more)
    whole = dict(src.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint")
    if whole and src.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        return src.select(F.col("id").cast("bigint").alias("key"), "id", "text", *rest)
    ranged = src.repartitionByRange(partitions(docs.sparkSession), F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ranged = ranged.sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return materialize(ranged.select(F.monotonically_increasing_id().alias("key"), "id", "text", *rest), "keyed")


def minimizer_runs(symbols: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """(text, first window, windows, place of the minimizer in the run, its hash)
    of each run: neighbouring windows of ``length`` symbols whose smallest k-mer
    hash is at one place.  Equal windows have their minimizers at equal places."""
    n = len(symbols)
    sizes = np.diff(offsets)
    whole = sizes >= length
    if n < length or not whole.any():
        none = np.empty(0, np.int64)
        return none, none, none, none, np.empty(0, np.uint64)
    kmers = grams(symbols, k)
    low = np.uint64(0xFFFFFFFF)  # the same cut everywhere, or equal windows could differ in their minimizer
    best = (kmers & ~low) | np.arange(n - k + 1, dtype=np.uint64)
    reach, want = 1, length - k + 1
    while 2 * reach <= want:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if reach < want:
        best = np.minimum(best[: len(best) - (want - reach)], best[want - reach :])
    fits = np.zeros(n + 1, np.int32)
    np.add.at(fits, offsets[:-1][whole], 1)
    np.add.at(fits, offsets[1:][whole] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(fits[: n - length + 1]) > 0)
    place = (best[starts] & low).astype(np.int64)
    owner = np.searchsorted(offsets, starts, "right") - 1
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])))
    lo, at, own = starts[first], place[first], owner[first]
    return own, lo, np.diff(np.append(first, len(starts))), at - lo, kmers[at]


def by_part(r: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each part."""
    if not len(r):
        return
    order = np.argsort(part, kind="stable")
    r, part = r[order], part[order]
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(r)).tolist(), strict=True):
        yield int(part[a]), r[a:b]


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (mix(h) >> np.uint64(33)) % np.uint64(parts)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``most`` bytes at a time."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= most:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def dealt(df: DataFrame, parts: int) -> DataFrame:
    """Rows of one part together, parts in order: ``SLICES`` parts a partition."""
    return df.repartitionById(parts // SLICES, F.floor(F.col("part") / SLICES).cast("int")).sortWithinPartitions("part")


def part_by_part(batches, columns: list[int]) -> Iterator[list[list]]:
    """The columns' values of one part after the other; column 0 is the part."""
    current, held = None, [[] for _ in columns]
    for batch in batches:
        parts = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else np.empty(0, np.int64)
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(parts)).tolist(), strict=True):
            if parts[a] != current:
                if current is not None:
                    yield held
                current, held = parts[a], [[] for _ in columns]
            for h, c in zip(held, columns, strict=True):
                h += batch.column(c).slice(a, b - a).to_pylist()
    if current is not None:
        yield held


def covered(spans: np.ndarray | None, n: int, length: int) -> np.ndarray:
    """Which of a document's ``n`` symbols its repeated windows cover.
    ``spans``: rows of (first window, windows)."""
    if spans is None or not len(spans):
        return np.zeros(n, bool)
    lo, end = spans[:, 0], spans[:, 0] + spans[:, 1] - 1 + length
    edge = np.bincount(lo, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def edges(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs."""
    d = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat, pa.int64()))


def packed(rows: np.ndarray) -> bytes:
    """Rows as bytes, compressed: the first byte of every row, then the second ones, and so on,
    so that ids and places that ascend take next to no room."""
    raw = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), rows.dtype.itemsize).T.tobytes()
    return len(rows).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    out = [np.empty(0, kind)]
    for x in blobs:
        n = int.from_bytes(x[:8], "little")
        raw = np.frombuffer(pa.decompress(pa.py_buffer(x)[8:], n * kind.itemsize, codec="zstd"), np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).reshape(-1).view(kind))
    return np.concatenate(out)


def notes_of(rows: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part of the documents, notes on them).  Spans that touch become one."""
    rows = rows[np.lexsort((rows["lo"], rows["doc"]))]
    if rows.dtype == SPAN and len(rows):
        end = rows["lo"].astype(np.int64) + rows["n"]
        first = np.flatnonzero(np.append(True, (rows["doc"][1:] != rows["doc"][:-1]) | (rows["lo"][1:] != end[:-1])))
        n, rows = np.add.reduceat(rows["n"], first), rows[first]
        rows["n"] = n
    for p, some in by_part(rows, part_of(rows["doc"].astype(np.uint64), parts)):
        yield p, packed(some)


def _blocks(rows: DataFrame, parts: int) -> DataFrame:
    """(part, kind, blob): the rows by their ``key``, as compressed Arrow streams of many rows."""

    def streams(held: list[pa.RecordBatch]) -> Iterator[tuple]:
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table["key"].to_numpy().astype(np.uint64)
        for p, at in by_part(np.arange(len(keys)), part_of(keys, parts)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table.take(pa.array(at)))
            yield p, TEXTS, sink.getvalue().to_pybytes()

    def send(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK:
                yield from batches_of(streams(held), PARTS)
                held, size = [], 0
        if held:
            yield from batches_of(streams(held), PARTS)

    return rows.mapInArrow(send, PARTS_SQL)


def beside(rows: DataFrame, notes: DataFrame, parts: int) -> DataFrame:
    """The rows and the notes (part, blob) on them, dealt by ``key``, for ``noted`` to read.
    Texts are most of what moves here, so they move compressed and many at a time."""
    return dealt(notes.select("part", F.lit(NOTES).alias("kind"), "blob").unionByName(_blocks(rows, parts)), parts)


def noted(batches, kind: np.dtype) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, notes of ``kind``, where those of each row begin and end)."""
    for kinds, blobs in part_by_part(batches, [1, 2]):
        notes = unpacked([x for k, x in zip(kinds, blobs, strict=True) if k == NOTES], kind)
        notes = notes[np.argsort(notes["doc"], kind="stable")]
        docs = np.ascontiguousarray(notes["doc"])
        held, size = [], 0
        texts = [x for k, x in zip(kinds, blobs, strict=True) if k == TEXTS]
        del kinds, blobs
        for i, x in enumerate(texts):
            held.append(pa.ipc.open_stream(x).read_all())
            size += held[-1].nbytes
            if size >= OPEN or i == len(texts) - 1:
                for batch in pa.concat_tables(held).combine_chunks().to_batches():
                    keys = batch.column("key").to_numpy()
                    yield batch, notes, np.searchsorted(docs, keys), np.searchsorted(docs, keys, "right")
                held, size = [], 0


def apply_notes(keyed: DataFrame, notes: DataFrame, parts: int, keep: Callable, kept_type: pa.DataType, kept_sql: str) -> DataFrame:
    """(id, n, n_removed, removed_start, removed_end, kept) of every document.
    ``notes``: (part, blob), of ``SPAN``; ``keep(text bytes, rows (first window, windows))``
    -> (number of symbols, gone, what stays)."""
    more = ["carried"] if "carried" in keyed.columns else []
    schema = T.StructType([keyed.schema["id"], *T._parse_datatype_string(f"n bigint, n_removed bigint, removed_start array<bigint>, removed_end array<bigint>, kept {kept_sql}").fields, *[keyed.schema[c] for c in more]])

    def run(batches):
        for batch, spans, begin, end in noted(batches, SPAN):
            data, offsets = text_bytes(batch.column("text"))
            n, removed, starts, ends, kept = [], [], [], [], []
            for i, (x, y) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
                found = np.stack([spans["lo"][x:y], spans["n"][x:y]], 1).astype(np.int64) if y > x else None
                size, gone, rest = keep(data[offsets[i] : offsets[i + 1]], found)
                a, b = edges(gone)
                n.append(size)
                removed.append(int((b - a).sum()))
                starts.append(a)
                ends.append(b)
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), _lists(starts), _lists(ends), pa.array(kept, pa.binary()).cast(kept_type), *[batch.column(c) for c in more]],
                names=["id", "n", "n_removed", "removed_start", "removed_end", "kept", *more],
            )

    return beside(keyed.select("key", "id", "text", *more), notes, parts).mapInArrow(run, schema)


def apply_spans(keyed: DataFrame, spans: DataFrame, read: Callable, keep: Callable, kept_type: pa.DataType, kept_sql: str) -> DataFrame:
    """(id, n, n_removed, removed_start, removed_end, kept) of every document.
    ``spans``: (key, spans); ``read`` makes rows (first window, windows) of them;
    ``keep(text bytes, rows)`` -> (number of symbols, gone, what stays)."""
    more = ["carried"] if "carried" in keyed.columns else []
    joined = keyed.join(spans, "key", "left").select("id", "text", "spans", *more)
    schema = T.StructType([joined.schema["id"], *T._parse_datatype_string(f"n bigint, n_removed bigint, removed_start array<bigint>, removed_end array<bigint>, kept {kept_sql}").fields, *[joined.schema[c] for c in more]])

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            found = batch.column(2).to_pylist()
            n, removed, starts, ends, kept = [], [], [], [], []
            for i, sp in enumerate(found):
                size, gone, rest = keep(data[offsets[i] : offsets[i + 1]], read(sp) if sp else None)
                a, b = edges(gone)
                n.append(size)
                removed.append(int((b - a).sum()))
                starts.append(a)
                ends.append(b)
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), _lists(starts), _lists(ends), pa.array(kept, pa.binary()).cast(kept_type), *[batch.column(3) for _ in more]],
                names=["id", "n", "n_removed", "removed_start", "removed_end", "kept", *more],
            )

    return joined.mapInArrow(run, schema)
