import random

import pytest

from galeframe.llm.support import ready

WORDS = "the of and to in is that for was on with this from by are le la des une est der die und das ein el los que por".split()
# Columns whose names the operators use inside.
CLASH = ["rank", "gram", "id", "key", "marks", "count", "score", "rejected", "meeting", "rep", "lang_pred", "c0"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "a", "en", "io"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with nulls, empty and long ones, copies, near copies, shared passages."""
    rng = random.Random(11)
    out = [None, "", " \n ", "one", "Two words", "five words are in here", "x" * 5000, "é ü ñ 中文 😀 <|endoftext|> 'tis", "123 456 !!!", "it's we've 're x\x1c y"]
    base = sentence(rng, 120)
    passage = sentence(rng, 60)
    out += [base, base, base.upper(), base + " end"]
    for k in range(25):
        words = base.split(" ")
        for _ in range(k % 7):
            words[rng.randrange(len(words))] = rng.choice(["zebra", "quark", "fjord"]) + str(rng.randrange(50))
        out.append(" ".join(words))
    out += [sentence(rng, rng.randrange(1, 9)) for _ in range(40)]
    out += [sentence(rng, 40) + " " + passage + " " + sentence(rng, 30) for _ in range(8)]
    out += ["ab" * 700, sentence(rng, 6000)]
    out += [sentence(rng, rng.randrange(20, 200)) for _ in range(40)]
    return out


def frame(spark, rows):
    """documents with extra columns of clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    data = [(i, t, lang, "src0", None if t is None else len(t), *["z"] * len(CLASH)) for i, t, lang in rows]
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def docs(spark, texts):
    ready(spark)
    return frame(spark, [(3 * k, t, "en" if k % 2 else "fr") for k, t in enumerate(texts)]).repartition(4)


@pytest.fixture(scope="session")
def none(spark, docs):
    return frame(spark, [])
