import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and to in is that for it with as was on be by at this have from or had not are but what all were when we there can an your which their said if do will each about how up out them".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split(),
    "el": "και το να του η της με που την από για τα είναι στο των ο δεν στη θα τη τους οι στην ένα ως ότι".split(),
}


def prose(rng, n, lang="en"):
    return " ".join(rng.choice(WORDS[lang]) + (rng.choice("abcdefgh") if rng.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="session")
def docs_rows():
    """Documents with nulls, empty and long texts, exact and near copies, ties and shared passages."""
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.choice([3, 30, 80, 200]), rng.choice(["en", "de", "el"])), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ä", None]), 1) for i in range(60)]
    rows = [(i, t, "el" if t[0] > "ʹ" else x, s, n) for i, t, x, s, n in rows]
    text = rows[1][1]
    base = prose(rng, 150)
    passage = prose(rng, 45)
    for i in range(60, 75):
        w = base.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(["xx", "yy"])
        rows.append((i, " ".join(w), "en", "a", 1))
    rows += [(80 + i, f"{prose(rng, 20)} {passage}\n{prose(rng, 5)}", "en", "b", 1) for i in range(6)]
    rows += [(90, text, "en", "a", 1), (91, text.upper(), "en", None, 1), (92, None, None, None, None), (93, "", "de", "b", 0), (94, " \n\t ", "de", "b", 3), (95, "word", "en", "b", 4), (96, "WORD", "en", "b", 4)]
    rows += [(97, "12 34 !!", "en", "a", 8), (98, prose(rng, 6000), "en", "a", 1), (99, "same words " * 60, "en", "b", 1), (100, "a  b\n\n c  ", "en", "c", 1), (101, "漢字 <|endoftext|> é x", "en", "c", 1)]
    rows += [rows[5], (None, "no id here at all, none", "en", "b", 1), (None, None, None, "a", None), (-7, text, "en", "a", 1)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns with the names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["row", "key", "h", "n", "node", "root", "part", "seq", "keep_id", "kept", "copies", "size", "score", "_sha", "_id", "_text", "id", "spans", "k1", "near", "starts", "ids", "rank", "start", "removed", "component_id", "held_out", "tag", "digest", "chunk"]
    return docs.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(names)])


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path
