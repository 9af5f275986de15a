import random

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, fp string, repeats string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, source) or (doc_id, text), with columns whose names clash with results."""
    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y", "z", "w") for r in rows]
        return spark.createDataFrame(full, DOCUMENT)
    return build


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, nulls, blanks, ties, one very long text and repeated rows."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(120)]
    rows = [(i, t, f"s{i % 5}") for i, t in enumerate(texts)]
    rows += [(200 + i, texts[i], "s0") for i in range(30)]
    for i in range(20):
        near = texts[i].split()
        near[len(near) // 2] = "changed"
        rows.append((300 + i, " ".join(near), "s1"))
    rows += [(400, None, None), (401, "", "s2"), (402, " \t\n ", "s2"), (None, texts[3], "s3"), (None, None, "s3"), (5, texts[5], "s0"),
             (403, "A" * 300 + " " + "na " * 500, "s4"), (404, " ".join(rng.choice(words) for _ in range(6000)), "s4"),
             (405, "UPPER Case Words, and-signs\x0bhere", "s4")]
    return rows


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCUMENT)
