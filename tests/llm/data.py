"""Small tables for the operators' tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "tu", "za") for b in ("ran", "sil", "ton", "vek", "wud", "xor")]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def edited(text: str, every: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(w if rng.randrange(every) else f"edit{rng.randrange(10**6)}" for w in text.split(" "))


def docs(spark, texts, extra=False):
    """texts: text, or (doc_id, text)."""
    rows = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
    out = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None) for i, t in rows], SCHEMA)
    if extra:  # columns with the names that operators use themselves
        from pyspark.sql import functions as F

        for name in ("digest", "keep_id", "row", "kept", "size", "key", "id", "hash", "gone", "score", "a", "b"):
            out = out.withColumn(name, F.lit("x"))
    return out
