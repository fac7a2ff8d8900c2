import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

#: Rows with names that operators use inside, to clash.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, h string, fp string, host string, key string, score string, label string"


def words(rng, n, stem="w"):
    return " ".join(f"{stem}{rng.randrange(400)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """[(doc_id, text, lang, source)]: nulls, empty and very long texts, copies, near copies, ties, junk."""
    rng = random.Random(4)
    base = words(rng, 300)
    texts = [None, "", "  \n\t ", "one", "one two", "ONE TWO", "a b c", base, base, base + " tail", base.replace("w1", "w1", 1), base.upper().lower()]
    for i in range(30):
        w = base.split()
        w[i * 7] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [words(rng, rng.randrange(5, 200), f"x{i}_") for i in range(30)]
    texts += ["same line here\n" + words(rng, 60, f"y{i}_") + "\nsame line here" for i in range(8)]
    texts += [words(rng, 12, "z") * 6, "a b c " * 40, "%%% $$$ " * 60, "\n".join(["dup"] * 70), "é ß ñ 𝒳 " * 30, words(rng, 30000, "long")]
    return [(i, t, ["en", "fr", None][i % 3], ["s0", "s0", "s1", None][i % 4]) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(d, t, g, s, len(t or ""), "h", "f", "x", "k", "0", "l") for d, t, g, s in corpus]
    return spark.createDataFrame(rows, EXTRA).repartition(3)
