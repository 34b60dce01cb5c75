import random

import pytest



@pytest.fixture()
def make_docs(spark):
    """Documents from texts, with an extra column and a clashing one."""
    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "src", None if t is None else len(t), 1, "x") for i, t in zip(ids, texts)]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, quality int, lo string")
    return make


@pytest.fixture()
def awkward():
    """NULL, empty, blank, tiny, tied and repeated, and one long text."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(300)]
    long = " ".join(r.choice(words) for _ in range(40_000))
    return [None, "", " \n\t ", "one", "One", "a b c d", "a b c d", "tie\x00tie", "é😀 ﬁ ▁x", long, long,
            "WARC/1.0\r\n" * 3, "x" * 3000, None]


@pytest.fixture()
def prose():
    def make(n, seed=0, length=120):
        r = random.Random(seed)
        words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 9))) for _ in range(2000)]
        return [" ".join(r.choice(words) for _ in range(r.randint(length // 2, length * 2))).capitalize() + "."
                for _ in range(n)]
    return make


def rows_of(df):
    return [r.asDict() for r in df.collect()]


