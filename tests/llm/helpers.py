"""Small tables that hold what documents may hold."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=DOCS):
    """A documents table from (doc_id, text) pairs or whole rows."""
    full = [r if len(r) > 2 else (*r, "en", f"src{(r[0] or 0) % 3}", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, schema)


def prose(seed=0, n=60, words=("the", "of", "ring", "Éa", "tion", "ab.", "to,", "in", "ç", "was", "here", "line")):
    """Texts with shared passages, repeats, odd spaces, empty ones and nulls."""
    r = random.Random(seed)
    passages = [" ".join(r.choice(words) + str(r.randrange(40)) for _ in range(r.choice([12, 25, 40]))) for _ in range(5)]
    texts = ["", None, " \t\n ", "one", "a b", "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a"]
    while len(texts) < n:
        parts = []
        for _ in range(r.randrange(1, 6)):
            parts.append(r.choice(passages) if r.random() < 0.4 else " ".join(r.choice(words) + (str(r.randrange(9)) if r.random() < 0.5 else "") for _ in range(r.randrange(1, 40))))
        texts.append(r.choice([" ", "\n", "  ", "\t"]).join(parts))
    texts[20:24] = [texts[19]] * 4
    return list(enumerate(texts[:n]))
