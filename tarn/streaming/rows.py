"""Results read in batches, with the engine working only as far as the reader goes."""

from __future__ import annotations


class RowStream:
    """Iterates rows; partitions are computed one after another as they are reached.

    ``read_ahead`` computes the next partition meanwhile.  Leaving the loop stops
    the work on further partitions.  An error shows at its partition's first row.
    """

    def __init__(self, query, batch_size: int = 1000, read_ahead: bool = False):
        if batch_size < 1:
            raise ValueError("a batch has rows")
        self._query, self._size, self._ahead = query, batch_size, read_ahead

    def __iter__(self):
        for batch in self.batches():
            yield from batch

    def batches(self):
        db = self._query._database()
        decode = db.decoder(self._query.node)
        source = self._query.frame().toLocalIterator(prefetchPartitions=self._ahead)
        batch = []
        try:
            for row in source:
                batch.append(decode(row))
                if len(batch) == self._size:
                    yield batch
                    batch = []
            if batch:
                yield batch
        finally:
            close = getattr(source, "close", None)
            if close:
                close()
