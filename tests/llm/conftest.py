import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, line=12):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + line]) for i in range(0, n, line))


def corpus():
    """Copies, near copies, shared passages, blanks, very long and odd texts."""
    base = [prose(s, 90) for s in range(6)]
    near = base[0].split(" ")
    near[20] = "changed"
    passage = prose(99, 60)
    long = prose(7, 30_000)
    texts = [
        *base, base[0], base[0], " ".join(near), base[1] + "\n" + passage, prose(20, 40) + "\n" + passage, passage,
        None, "", " \t\n", "one", "two words", "é ü 漢字 😀", "Is onhe. " * 200, long, long + " end", base[2].upper(), "a\n\na\nb\n\na\nb\nc",
    ]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t) if t else None) for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    rows.append((None, base[4], "en", "s1", 5))  # no id
    rows.append((2, "another text under an id that is taken " + prose(50, 30), "de", "s2", 3))
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
