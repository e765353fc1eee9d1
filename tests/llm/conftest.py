import random
import zlib

import pytest

WORDS = ["the", "of", "and", "to", "is", *(f"{a}{b}{c}" for a in ("tha", "wen", "sor", "mil") for b in ("der", "lon", "kif", "pas") for c in ("t", "ning", "os", "ed"))]


def prose(seed, n, words=WORDS):
    r = random.Random(seed)
    out = [r.choice(words) for _ in range(n)]
    return " ".join(w.capitalize() + "," if k % 9 == 0 else w + "." if k % 13 == 12 else w for k, w in enumerate(out))


#: Extra columns with names that the operators use themselves.
CLASH = "id long, label int, score double, rep long, i long, t string, k long, b int, _text string, _did long, _sid long, value string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def rows_of(spark, texts):
    """Documents of (id, text) pairs, with nulls in all other columns of every third."""
    rows = [(i, x, *(("en", "s", len(x or "")) if k % 3 else (None, None, None)), *(k, 1, 0.5, 7, 8, "z", 9, 1, "q", 5, 6, "v")) for k, (i, x) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


LONG = prose(99, 60_000)


def odd_texts():
    """Null ids and texts, empty, blank and very long texts, ties, repeated rows, control characters, other scripts."""
    a = prose(1, 60)
    return [(1, a), (1, a), (2, a), (3, None), (4, ""), (5, " \n\t "), (None, prose(2, 30)), (None, None), (6, LONG), (7, "x"), (8, "日本語 と 中文▁ ▁▁ é ß\r\n\x00"), (9, "! ? 12"), (-3, prose(3, 40)), (1 << 62, prose(4, 5))]


@pytest.fixture(scope="session")
def odd(spark):
    return rows_of(spark, odd_texts()).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())
