"""A small corpus with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, tokens int, `key` string, chunk long"


def corpus(n=60, seed=3, repeat=False, null_id=True):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé ñ".replace(" ", "")) for _ in range(rng.randint(1, 9))) for _ in range(90)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    rows = []
    texts = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 13, 40, 120]))]
        text = rng.choice([" ", "\n", " \t "]).join(words)
        if k % 7 == 0:
            text = f"{text} {passage}"
        if k % 9 == 0 and texts:
            text = rng.choice(texts).replace(" ", "  ")
        if k % 11 == 0 and texts:
            near = rng.choice(texts).split()
            if near:
                near[rng.randrange(len(near))] = "changed"
            text = " ".join(near).upper()
        texts.append(text)
        rows.append((k, text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "long " * 4000), (-5, "negative id " + passage), (n + 4, "x" * 30_000), (n + 5, "nul \x00 and \x1f byte " + passage)]
    if null_id:
        rows.append((None, "no id " + passage))
    if repeat:
        rows += [rows[0], rows[7]]
    return rows


def frame(spark, rows, parts=3):
    full = [(d, t, "en", ("s1", "s2", None, "é")[0 if d is None else d % 4], 0, True, "x", 1, "k", 9) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def as_dict(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}
