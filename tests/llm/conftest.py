from __future__ import annotations

import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "su") for b in ("ran", "tel", "vik") for c in ("", "a", "os", "é")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, t string, n int, keep_id string, shard string, marks string, anchor string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and wordless texts, copies, near copies, shared passages, repeated rows, a null id and a very long text."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 90)) for _ in range(40)]
    rows: list[tuple[int | None, str | None]] = list(enumerate(base))
    rows += [(100 + i, edited(rng, base[i % 8], 0.02 * (i % 5))) for i in range(40)]
    rows += [(200 + i, base[3] + "\t\n " * (i % 2)) for i in range(6)]
    passage = prose(rng, 40)
    rows += [(300 + i, f"{prose(rng, 20)} {passage} {prose(rng, 15)}") for i in range(8)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "one two three"), (405, "One TWO three"), (406, "ha " * 60), (407, "ha " * 61)]
    rows += [(410, prose(rng, 6000)), (411, f"{prose(rng, 3000)} {passage}"), (None, base[5]), (None, None), (7, base[7]), (7, base[7]), (-3, base[9]), (420, "İ ſ K é x y ｆ " + passage)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", f"src{k % 3}" if k % 7 else None, len(t or ""), "x", "y", 1, "z", "s", "m", "a") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
