"""Binary files of Fortran records: data between its length in bytes before and after."""

from __future__ import annotations

from typing import BinaryIO

import numpy as np


class Records:
    """A file's records from a place on; the order of bytes is that of the first length."""

    def __init__(self, f: BinaryIO, order: str | None = None):
        self.f = f
        if order is None:
            raw, at = f.read(4), f.tell() - 4
            order = next((o for o in "<>" if len(raw) == 4 and 0 < int(np.frombuffer(raw, f"{o}u4")[0]) < 1 << 24), None)
            f.seek(max(0, at))
        if order is None:
            raise OSError("no record at the begin of the file")
        self.order = order

    def _mark(self) -> int | None:
        raw = self.f.read(4)
        return int(np.frombuffer(raw, f"{self.order}i4")[0]) if len(raw) == 4 else None

    def length(self) -> int | None:
        """Bytes of the next record, which is not passed; None at the end."""
        n = self._mark()
        if n is not None:
            self.f.seek(-4, 1)
        return n

    def read(self, dtype: str) -> np.ndarray:
        """The next record as values of a type (such as `i4`)."""
        n = self._mark()
        if n is None:
            raise EOFError("no further record")
        out = np.frombuffer(self.f.read(n), f"{self.order}{dtype}")
        if self._mark() != n:
            raise OSError(f"a record of {n} bytes doesn't end where it should")
        return out

    def value(self, dtype: str):
        return self.read(dtype)[0].item()

    def skip(self, records: int = 1) -> None:
        for _ in range(records):
            n = self._mark()
            if n is None:
                raise EOFError("no further record")
            self.f.seek(n, 1)
            if self._mark() != n:
                raise OSError(f"a record of {n} bytes doesn't end where it should")
