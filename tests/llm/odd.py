"""Small odd tables that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, n string, digest string, " \
       "block string, fp string, y string, words string, word string, key string, ghost string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["the", "of", "and", "to"] + ["".join(r.choice(["ka", "ri", "to", "mel", "sun"]) for _ in range(r.randint(2, 5)))
                                          for _ in range(400)]
    out = [r.choice(words[:4]) if r.random() < 0.3 else r.choice(words) for _ in range(n)]
    return " ".join(w + (".\n" if i % 11 == 10 else "") for i, w in enumerate(out)).replace("\n ", "\n")


def texts() -> dict:
    long = prose(1, 6000)
    base = prose(2, 200)
    near = base.split(" ")
    near[50] = "different"
    return {0: "", 1: None, 2: "word", 3: "x" * 20_000, 4: long, 5: base, 6: base, 7: " ".join(near),
            8: "  double  spaces\t\ttabs\r\n\n ", 9: "<|endoftext|>mid <|endoftext|>", 10: "日本語 текст é ß 🙂",
            11: "\n", 12: prose(3, 90), 13: "don't we'll I'm 'S  12,345.67", 14: prose(5, 2500), 15: base.upper()}


def documents(spark, rows=None):
    rows = list(texts().items()) if rows is None else rows
    rows = [*rows]
    return spark.createDataFrame([(i, t, None, "s", None, 7, "n", "d", "b", "f", "1", "w", "w", "k", "g")
                                  for i, t in rows], DOCS)


def odd_documents(spark):
    """All the texts, a repeated row and rows without an id."""
    t = texts()
    return documents(spark, [*t.items(), (5, t[5]), (None, t[12]), (None, None)])
