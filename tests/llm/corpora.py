"""Small corpora for the tests."""

import random

SYLLABLES = ["ba", "ko", "ri", "ten", "mul", "sa", "vor", "li", "nu", "gat", "pe", "shi"]


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))


def text(rng, n):
    return " ".join(word(rng) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, size int, held_out string, found int, n_words int"


def rows(seed=5, n=60):
    """Documents with copies, near copies, shared passages and all awkward rows; extra columns clash with result names."""
    rng = random.Random(seed)
    passage = text(rng, 70)
    out = []
    for i in range(n):
        body = text(rng, rng.randint(1, 160))
        kind = i % 6
        if kind == 1 and out:
            body = rng.choice(out)[1] or ""
        elif kind == 2 and out:
            words = (rng.choice(out)[1] or "x").split() or ["x"]
            words[rng.randrange(len(words))] = "changed"
            body = " ".join(words)
        elif kind == 3:
            body = f"{text(rng, 20)}\n{passage}\t{text(rng, 15)}"
        elif kind == 4:
            body = " ".join(["ha hum"] * rng.randint(1, 90))
        out.append((i, body, ["en", "fr", None][i % 3], f"s{i % 4}" if i % 5 else None, len(body), 1.0, "x", i, "h", i, i))
    out += [
        (n, None, "en", "s0", None, None, None, None, None, None, None),
        (n + 1, "", None, None, 0, None, None, None, None, None, None),
        (n + 2, " \n\t ", "fr", "s1", 4, None, None, None, None, None, None),
        (None, passage, "en", "s1", 1, None, None, None, None, None, None),
        (3, out[3][1], "en", "s1", 1, None, None, None, None, None, None),
        (3, text(rng, 80), "en", "s1", 1, None, None, None, None, None, None),
        out[5],
        out[5],
        (n + 3, text(rng, 3000), "fr", "s2", 1, None, None, None, None, None, None),
    ]
    return out


def documents(spark, seed=5, n=60):
    return spark.createDataFrame(rows(seed, n), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
