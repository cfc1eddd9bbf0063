"""What surrounds a run: external commands over a column, a config file changed under a lock, a connection by service name."""

from __future__ import annotations

import os
import socket
import subprocess
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def through_command(df: DataFrame, value: str, command: list[str]) -> DataFrame:
    """(value): the lines an external command writes, its input being the column's values of a partition, a line each (nulls are left out).

    One process a partition, streamed both ways. A command that fails fails the task, with the end of what it said on its error output.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
        said: list[bytes] = []
        broken: list[BaseException] = []

        def feed() -> None:
            try:
                for b in batches:
                    for x in b.column(0):
                        p.stdin.write(x.as_py().encode() + b"\n")
                p.stdin.close()
            except BrokenPipeError:
                pass
            except BaseException as e:  # noqa: BLE001  raised below, in the task's own thread
                broken.append(e)
                p.kill()

        threads = [threading.Thread(target=feed), threading.Thread(target=lambda: said.append(p.stderr.read()[-2000:]))]
        for t in threads:
            t.start()
        lines: list[str] = []
        for line in p.stdout:
            lines.append(line.rstrip(b"\n").decode(errors="replace"))
            if len(lines) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
                lines = []
        for t in threads:
            t.join()
        if broken:
            raise broken[0]
        if p.wait():
            raise RuntimeError(f"{command[0]} ended with {p.returncode}: {b''.join(said).decode(errors='replace')}")
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    return df.where(F.col(value).isNotNull()).select(F.col(value).cast("string").alias("value")).mapInArrow(run, "value string")


@contextmanager
def locked(path: str, tries: int = 60, pause: float = 1.0) -> Iterator[None]:
    """Hold the lock directory `path`.lock; raises TimeoutError if another holder keeps it for all tries."""
    lock = f"{path}.lock"
    for i in range(tries):
        try:
            os.mkdir(lock)
            break
        except FileExistsError:
            if i + 1 == tries:
                raise TimeoutError(f"{lock} is held") from None
            time.sleep(pause)
    try:
        yield
    finally:
        os.rmdir(lock)


def update_lines(path: str, change: Callable[[str], str | None], tries: int = 60, pause: float = 1.0) -> int:
    """Change a text file's lines under its lock and return how many differ; a line for which change gives None goes. The file is replaced as a whole."""
    with locked(path, tries, pause):
        with open(path) as f:
            old = f.read().splitlines()
        new = [change(x) for x in old]
        with open(f"{path}.new", "w") as f:
            f.writelines(x + "\n" for x in new if x is not None)
        os.replace(f"{path}.new", path)
    return sum(a != b for a, b in zip(old, new, strict=True))


def connected(host: str, service: str | int, timeout: float = 10.0) -> socket.socket:
    """A TCP connection to a port number or a service known by name."""
    port = service if isinstance(service, int) else int(service) if service.isdigit() else socket.getservbyname(service, "tcp")
    return socket.create_connection((host, port), timeout)
