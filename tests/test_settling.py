import re
from pathlib import Path

from tidemark.settling import discard, settle


def test_settling_gives_native_memory_of_the_driver_back(spark):
    """What the JVM frees between blocks that it still holds stays with the C library unless it is asked for."""
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()

    def native():
        """MB of the JVM without its heap."""
        jvm.System.gc()
        jvm.System.gc()
        own = sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024
        return own - jvm.Runtime.getRuntime().totalMemory() / (1 << 20)

    discard(settle(spark.range(10)))
    text = bytes(range(256)) * 1024
    held, out = [], jvm.java.nio.ByteBuffer.allocate(1 << 18).array()
    before = native()
    for _ in range(400):
        d = jvm.java.util.zip.Deflater(9)
        d.setInput(text)
        held.append(d)
        d.deflate(out)
    for i, d in enumerate(held):
        if i % 20:
            d.end()
    freed = native()
    discard(settle(spark.range(10)))
    after = native()
    assert freed - before > 40
    assert freed - after > 0.6 * (freed - before)
    for d in held[::20]:
        d.end()
