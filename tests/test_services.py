import os
import socket
import threading

import pytest
from pyspark.sql import functions as F

from readloom.functions.primes import is_prime, next_prime
from readloom.sources import services, text


def test_through_command(spark):
    df = spark.range(30_000).repartition(3).select(F.when(F.col("id") % 1000 != 7, F.concat(F.lit("r"), "id")).alias("v"), F.lit(1).alias("value"))
    got = services.through_command(df, "v", ["tr", "r", "R"])
    assert sorted(r.value for r in got.collect()) == sorted(f"R{i}" for i in range(30_000) if i % 1000 != 7)
    assert services.through_command(df, "v", ["head", "-n", "2"]).count() == 6
    assert services.through_command(df.limit(0), "v", ["cat"]).count() == 0
    with pytest.raises(Exception, match="ended with 3"):
        services.through_command(df, "v", ["sh", "-c", "cat > /dev/null; exit 3"]).count()


def test_locked_update(tmp_path):
    p = str(tmp_path / "lib")
    with open(p, "w") as f:
        f.write("a new\nb new\nc new\n")
    assert services.update_lines(p, lambda x: None if x[0] == "b" else x.replace("new", "done") if x[0] == "a" else x) == 2
    assert open(p).read() == "a done\nc new\n" and sorted(os.listdir(tmp_path)) == ["lib"]
    with services.locked(p), pytest.raises(TimeoutError):
        services.update_lines(p, str, tries=2, pause=0.01)
    assert not os.path.exists(p + ".lock")


def test_connected():
    server = socket.create_server(("127.0.0.1", 0))
    port = server.getsockname()[1]
    t = threading.Thread(target=lambda: server.accept()[0].sendall(b"hello"))
    t.start()
    with services.connected("127.0.0.1", str(port)) as c:
        assert c.recv(5) == b"hello"
    t.join()
    with pytest.raises(OSError):
        services.connected("127.0.0.1", "no-such-service")


def test_next_prime():
    sieve = [n for n in range(2, 5000) if all(n % d for d in range(2, int(n**0.5) + 1))]
    assert [n for n in range(5000) if is_prime(n)] == sieve
    assert [next_prime(n) for n in (-3, 0, 2, 3, 4, 14, 1 << 31)] == [2, 2, 2, 3, 5, 17, 2147483659]
    assert not is_prime(3215031751) and is_prime((1 << 61) - 1)


@pytest.mark.parametrize("codec", ["none", "gz", "bz2", "xz", "lzma", "zst"])
def test_ordered_lines(spark, tmp_path, codec):
    df = spark.range(5000).select(F.xxhash64("id").alias("k"), F.when(F.col("id") % 50 > 0, F.concat(F.lit("é"), "id")).alias("value")).repartition(7)
    path = str(tmp_path / "out")
    text.write_lines(df, path, order=["k"], codec=codec)
    want = [r.value or "" for r in df.orderBy("k").collect()]
    names = sorted(os.listdir(path))
    assert all(n.endswith("" if codec == "none" else codec) for n in names) and not any(n.startswith(".") for n in names)
    back = spark.read.format("readloom_lines").load(path).orderBy("file", "line_no")
    assert [r.value for r in back.collect()] == want
