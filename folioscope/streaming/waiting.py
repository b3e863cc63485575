"""Rows of one key that wait in the state of a stream, in chunks that are read in order."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.streaming import StatefulProcessorHandle

#: Rows that are sorted together before they are cut into chunks, rows of a chunk, and rows given out at a time.
GATHERED, CHUNK, PIECE = 200_000, 1_000, 50_000


class Waiting:
    """A list of chunks and, in a map, the rows of each, so that no value grows with the rows of a key.

    A chunk holds consecutive rows of a sorted gathering, so few chunks overlap; reading them in
    order of their first row needs only what overlaps in memory. Rows have a column ``us``.
    """

    def __init__(self, handle: StatefulProcessorHandle, columns: pa.Schema, order: str):
        self._columns, self._order, self._first = columns, order, None
        self._chunks = handle.getListState("waiting", "chunk string, low long, first_us long")
        self._rows = handle.getMapState("waiting_rows", "chunk string", "body binary")

    def add(self, batches: Iterator[pd.DataFrame]) -> int | None:
        """Keep rows; gives the time of the first of them."""
        held, rows, entries = [], 0, []
        for batch in batches:
            held.append(pa.table([pa.array(batch[c.name], c.type, from_pandas=True) for c in self._columns], self._columns))
            rows += len(batch)
            if rows >= GATHERED:
                entries += self._put(held)
                held, rows = [], 0
        entries += self._put(held)
        if entries:
            self._chunks.appendList(entries)
        return min((first for _, _, first in entries), default=None)

    def _put(self, tables: list[pa.Table]) -> list[tuple]:
        rows = pa.concat_tables([self._columns.empty_table(), *tables])
        if not len(rows):
            return []
        ordered = rows.sort_by(self._order).combine_chunks()
        entries = []
        for begin in range(0, len(ordered), CHUNK):
            part = ordered.slice(begin, CHUNK).combine_chunks().to_batches()[0]
            name = uuid.uuid4().hex
            self._rows.updateValue((name,), (part.serialize().to_pybytes(),))
            entries.append((name, part[self._order][0].as_py(), min(part["us"].to_pylist())))
        return entries

    def due(self, passed_us: int) -> Iterator[pd.DataFrame]:
        """Take the rows before a time out, in order; the others stay."""
        entries = [tuple(e) for e in self._chunks.get()]
        touched = sorted((e for e in entries if e[2] < passed_us), key=lambda e: e[1])
        if not touched:
            return
        kept = [e for e in entries if e[2] >= passed_us]
        held, late, rows, late_rows = [], [], 0, 0
        for i, (name, _, _) in enumerate(touched):
            body = self._rows.getValue((name,))[0]
            batch = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(bytes(body)), self._columns)])
            self._rows.removeKey((name,))
            early = pc.fill_null(pc.less(batch["us"], passed_us), False)
            if not pc.all(early).as_py():
                late.append(batch.filter(pc.invert(early)))
                late_rows += len(late[-1])
                batch = batch.filter(early)
            held.append(batch)
            rows += len(batch)
            if late_rows >= GATHERED:
                kept += self._put(late)
                late, late_rows = [], 0
            if rows >= PIECE and i + 1 < len(touched):
                # No later chunk has a row before the first of the next one.
                whole = pa.concat_tables(held)
                complete = pc.fill_null(pc.less(whole[self._order], touched[i + 1][1]), False)
                held = [whole.filter(pc.invert(complete))]
                rows = len(held[0])
                if rows < len(whole):
                    yield whole.filter(complete).sort_by(self._order).to_pandas()
        kept += self._put(late)
        self._first = min((e[2] for e in kept), default=None)
        if kept:
            self._chunks.put(kept)
        else:
            self._chunks.clear()
        if rows:
            yield pa.concat_tables(held).sort_by(self._order).to_pandas()

    def first(self) -> int | None:
        """The time of the first row that still waits after rows of this key were taken."""
        return self._first
