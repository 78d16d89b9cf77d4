from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cell int, score string, _row int, sig long, `a b` int, `c.d` string, `_kept` string, `e` struct<`x y`: int>"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(words))


def cases() -> list[tuple]:
    """Documents with copies, near copies, shared passages, boilerplate, nulls, empty, odd and long texts, repeated rows."""
    base = [prose(i, 40 + 7 * i) for i in range(24)]
    passage = prose(99, 30)
    texts: list[str | None] = [*base, base[3], base[3], base[5] + " tail words here", base[5].replace(" ", "  ", 3), base[7][: len(base[7]) // 2] + " " + passage, passage + "\n" + base[8], passage]
    texts += [None, "", " \n\t", "one two", "one two", "Ünïcode " * 30, "a" * 3000, "ab" * 40, "日本語の文章です。" * 40, prose(50, 9000), base[2].upper(), "x", "Menu | Home\n" + base[9], "Menu | Home\n" + base[10], "Menu | Home \n" + base[11]]
    rows = [(i * 3 + 1, t, ("en", "de")[i % 2] if i % 7 else None, f"s{i % 3}" if i % 11 else None, len(t) if t is not None else None, i, "clash", 1, 2, i, "p", "k", (i,)) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, base[3], "en", "s1", 5, 0, None, None, None, None, None, None, None), (None,) * 13]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(cases(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
