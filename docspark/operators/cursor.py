"""Batched cursors over lazy results."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row

from docspark.errors import CursorClosed

BATCH = 100


class Cursor:
    """Rows of a DataFrame in batches; partitions are fetched one at a time."""

    def __init__(self, df: DataFrame, batch: int = BATCH):
        self.batch = batch if batch > 0 else BATCH
        self._rows: Iterator[Row] | None = iter(df.toLocalIterator(prefetchPartitions=True))
        self._ahead: list[Row] = []

    def _open(self) -> Iterator[Row]:
        if self._rows is None:
            raise CursorClosed("the cursor is closed")
        return self._rows

    def fetch_more(self, n: int = 0) -> list[Row]:
        """The next n rows, or a batch; closes the cursor when the rows end."""
        rows = self._open()
        n = n if n > 0 else self.batch
        out = self._ahead[:n] + list(islice(rows, max(0, n - len(self._ahead))))
        self._ahead = self._ahead[n:] or list(islice(rows, 1))
        if not self._ahead:
            self.close()
        return out

    @property
    def has_more(self) -> bool:
        if self._rows is None:
            return False
        if not self._ahead:
            self._ahead = list(islice(self._rows, 1))
            if not self._ahead:
                self.close()
        return bool(self._ahead)

    def next(self) -> Row | None:
        return self.fetch_more(1)[0] if self.has_more else None

    def __iter__(self) -> Iterator[Row]:
        while self.has_more:
            yield from self.fetch_more()

    def collect_all(self) -> list[Row]:
        return list(self)

    def close(self) -> None:
        self._rows = None
        self._ahead = []
