"""Small documents with every odd case, shared by the tests of the operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "  \t\n ", "one", "two words", "three small words", "a b c d", "A B C D", "!!! ??? ...", "ÄÖÜ straße Ğ ﬁ ½", "日本語 テキスト です", "x" * 50_000, "<|endoftext|> <|startoftext|> word", "a\x00b \x1c\x85 c\xa0d"]


def words(rng, n, pool=None):
    pool = pool or ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return [rng.choice(pool) for _ in range(n)]


def corpus(seed=1):
    """(doc_id, text) rows: odd texts, repeated rows, one id twice, null ids, exact and near copies, shared passages."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base, passage = words(rng, 150, pool), words(rng, 60, pool)
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(base)) for i in range(5)]
    for i in range(25):
        copy = list(base)
        for _ in range(i % 12):
            copy[rng.randrange(len(copy))] = rng.choice(pool)
        rows.append((200 + i, " ".join(copy)))
    for i in range(12):
        text = words(rng, rng.randint(5, 80), pool)
        at = rng.randrange(len(text))
        rows.append((300 + i, " ".join(text[:at] + passage[i % 4 :] + text[at:])))
    rows += [(400 + i, "\n".join(" ".join(words(rng, rng.randint(1, 30), pool)) for _ in range(rng.randint(1, 9)))) for i in range(30)]
    rows.append((450, " ".join(["same"] * 120)))
    rows.append((451, " ".join(words(rng, 30_000, pool))))
    rows += [(460, "twice the same row"), (460, "twice the same row"), (461, "one id"), (461, "with two texts"), (None, " ".join(base)), (None, "no id"), (None, None)]
    return rows


def frame(spark, rows=None, partitions=4):
    rows = corpus() if rows is None else rows
    return spark.createDataFrame([(i, t, "en" if i is None or i % 2 else None, None, None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(partitions)


def with_clashes(docs):
    """The same rows with columns named like everything that an operator adds or uses inside."""
    from pyspark.sql import functions as F

    names = ["kept", "score", "n_words", "digest", "cls", "rep", "node", "bucket", "_key", "_text", "_row", "owner", "sig", "token_ids", "n_tokens", "lang_pred", "predicted", "length", "offset", "a.b"]
    return docs.select("*", *[F.lit("mine").alias(n) for n in names])
