"""What the Python workers of the pipeline keep beside the JVM."""

import random
import re

import pytest

from innlytics.llm import common, exact_dedup, packing


def anonymous_mb():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) / 1024


def test_an_empty_index_starts_no_python_workers(spark):
    table = exact_dedup.DigestIndex.empty(spark, 10).table
    # rows given as a list are an RDD that Python workers serialise
    assert "ExistingRDD" not in table._jdf.queryExecution().toString()
    assert table.collect() == []
    assert [f"{n} {t.replace('bigint', 'long')}" for n, t in table.dtypes] == exact_dedup.INDEX_SCHEMA.split(", ")


def test_a_step_gives_freed_memory_back():
    kept = []

    @common.trimmed
    def step(batches):
        for b in batches:
            held = [bytes(1000) for _ in range(200_000)]
            kept.append(held[-1])  # the top of the heap stays in use
            del held
            yield b

    before = anonymous_mb()
    assert list(step(iter([1, 2]))) == [1, 2]
    assert step.__name__ == "step"
    assert anonymous_mb() - before < 100


def test_a_word_table_stays_small():
    tokenizers = pytest.importorskip("public_tokenizers")
    t = packing.WordTable(tokenizers.path("word_bpe_49k.json"))
    r = random.Random(5)
    for _ in range(500):
        t.encode(" ".join("".join(r.choices("aeioulmnrst", k=7)) for _ in range(1000)).encode())
    assert len(t.young) + len(t.old) <= 310_000
