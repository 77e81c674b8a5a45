"""Driver logging: info.log, error.log and the console."""

from __future__ import annotations

import contextlib
import logging
import time
from pathlib import Path

from pyarrow import fs

from folioflow.sources.files import store_of


class StoreHandler(logging.Handler):
    """A log in a store that cannot append: kept here, and written whole every half minute that has lines, and when the log ends."""

    SECONDS = 30

    def __init__(self, store: fs.FileSystem, path: str, clear: bool):
        super().__init__()
        self.store, self.path, self.lines, self.written = store, path, [], time.monotonic()
        if not clear:
            with contextlib.suppress(FileNotFoundError), store.open_input_stream(path, compression=None) as old:
                self.lines.append(old.read().decode(errors="replace"))

    def emit(self, record: logging.LogRecord) -> None:
        self.lines.append(f"{self.format(record)}\n")
        if time.monotonic() - self.written > self.SECONDS:
            self.write()

    def write(self) -> None:
        with self.store.open_output_stream(self.path, compression=None) as out:
            out.write("".join(self.lines).encode())
        self.written = time.monotonic()

    def close(self) -> None:
        self.write()
        super().close()


def set_up(folder: str | None, clear: bool = False) -> logging.Logger:
    """The log, and its two files in a local folder or in that of another store."""
    log = logging.getLogger("folioflow")
    log.setLevel(logging.INFO)
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if folder:
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        local = isinstance(store, fs.LocalFileSystem)
        for name, level in (("info.log", logging.INFO), ("error.log", logging.ERROR)):
            at = f"{base}/{name}"
            handlers.append(logging.FileHandler(Path(at), mode="w" if clear else "a", encoding="utf-8") if local else StoreHandler(store, at, clear))
            handlers[-1].setLevel(level)
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)
    return log
