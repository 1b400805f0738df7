"""Small documents with every odd case, and brute-force versions of the operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, length string, node string"
SYLLABLES = {"en": "the and tion ing er on of ha ti re".split(), "fr": "eau ment la ou che é pa le tre vi".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def odd_rows():
    """Rows with NULLs in each column, empty, blank, short, long, repeated and tied texts,
    and further columns whose names clash with those of the operators."""
    rng = random.Random(5)
    base = sentence(rng, "en", 60)
    near = base.replace(base.split()[30], "changed", 1)
    texts = [None, "", " ", "\n\n", "a", "7 3 9", base, base, near, sentence(rng, "fr", 80), "tab\there  two  blanks \n next", "é \U0001f600 <|endoftext|>  x",
             sentence(rng, "en", 4000), "x" * 3000, sentence(rng, "fr", 3), "|".join(["w"] * 300), "same line here\n" * 40]
    rows = [(i, t, ["en", "fr", None][i % 3], "s", len(t or ""), 0.5, "no", "9", "n") for i, t in enumerate(texts)]
    rows += [rows[6], rows[1], (None, base, "en", "s", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(spark, n=240, seed=3):
    """Clean texts of two languages, and junk, with labels by doc_id."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        lang = "en" if i % 3 else "fr"
        text = ". ".join(sentence(rng, lang, rng.randint(6, 14)).capitalize() for _ in range(rng.randint(2, 8))) + "."
        good = i % 5 != 1
        if not good:
            text = " ".join(w + "###" for w in text.upper().split())
        docs.append((i, text, lang, "s", len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
