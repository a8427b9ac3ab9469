"""Small tables with what real ones hold: nulls, empty and long texts, repeated rows, extra columns of clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n int, g string, sig string, row long, h long, chunk long, cid long, own string, key string, _row long"


def prose(seed, words=120, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{int(r.paretovariate(1.1)) % vocabulary}x{r.randrange(40)}" for _ in range(words))


def documents(spark):
    base = prose(1)
    swapped = base.split()
    swapped[60] = "changed"
    texts = {1: base, 2: base, 3: " ".join(swapped), 4: None, 5: "", 6: "  \n\t ", 7: "one", 8: "one two", 9: prose(2, 4000), 10: base.upper(), 11: "x" * 5000, 12: "a b c d e f g h " * 30, 13: prose(3), 14: prose(3) + " tail", 15: "naïve ▁ 日本 \x00 🤗"}
    rows = [(i, t, ["en", None][i % 2], ["s", "t", None][i % 3]) for i, t in texts.items()]
    rows += [(None, base, None, None), (None, None, None, None), (2, base, "en", "t"), (1, base, None, "t")]
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, 7, "z", "z", 1, 2, 3, 4, "z", "z", 5) for r in rows], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
