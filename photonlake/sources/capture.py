"""What external programs write about files."""

from __future__ import annotations

import contextlib
import subprocess
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Bytes of output that are read of each run.
MOST = 16 << 20


def run(argv: list[str], content: bytes, seconds: float, most: int) -> tuple[str | None, bool, str]:
    """(text, whether it was cut, state) of a program that gets the content on its standard input. state: ended, failed (with its code), too slow, stopped (after as much output as is
    read) or missing."""
    try:
        program = subprocess.Popen(argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
    except FileNotFoundError:
        return None, False, "missing"
    late = threading.Event()

    def stop():
        late.set()
        program.kill()

    def feed():
        with contextlib.suppress(OSError):  # it may end without reading all
            program.stdin.write(content)
        with contextlib.suppress(OSError):
            program.stdin.close()

    clock, feeder = threading.Timer(seconds, stop), threading.Thread(target=feed, daemon=True)
    clock.start()
    feeder.start()
    try:
        data = program.stdout.read(most + 1)  # no more than that is held, however much it writes
        cut = len(data) > most
        if cut:
            program.kill()
        code = program.wait()
    finally:
        clock.cancel()
        program.stdout.close()
    state = "stopped" if cut else "too slow" if late.is_set() else "ended" if code == 0 else f"failed {code}"
    return data[:most].decode("utf-8", "replace"), cut, state


def captured(files: DataFrame, argv: list[str], seconds: float = 30.0, most: int = MOST) -> DataFrame:
    """path, text, cut and state for each file (path, content): the output of a program that is run once for each, with the content as its input, for a bounded time and up to a bounded
    size. Null content is empty. The program has to be there on every executor; where it isn't, the state says so and the text is null."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(p, *run(argv, bytes(c) if c is not None else b"", seconds, most)) for p, c in zip(batch["path"], batch["content"])]
            yield pd.DataFrame(out, columns=["path", "text", "cut", "state"])

    return files.select("path", "content").mapInPandas(rows, "path string, text string, cut boolean, state string")
