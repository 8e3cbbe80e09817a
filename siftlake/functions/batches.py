"""Batches of bounded size for functions that make Python objects of what they read."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa

#: Bytes of a slice, as Arrow holds them; Python objects made of them take some twenty times as much.
SLICE = 1 << 20
#: Rows of a slice of clusters or of an output.
ROWS = 1024


def sliced(batches: Iterable[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, in slices of at most `most` bytes; a longer row stays alone."""
    for batch in batches:
        todo = [batch]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > most:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            elif part.num_rows:
                yield part


def framed(batches: Iterable[pd.DataFrame], rows: int = ROWS) -> Iterator[pd.DataFrame]:
    """The same of frames, by rows."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]
