"""Documents with every awkward case the operators define."""

import pytest

PROSE = ("The river ran slowly past the old mill, and nobody in the village could say who had built it. Some held that monks had come from "
         "the north with carts of stone; others swore the wheel had turned before any road was laid. Either way the miller kept his hours, "
         "rose before the sun, and ground what was brought to him without a question or a word of thanks.")
SHARED = "This passage stands in many documents and has a good deal more than forty characters."
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, n_words int, part string, rank string, node double, key string"


def awkward():
    words = PROSE.split()
    texts = [
        (1, PROSE), (2, PROSE), (2, PROSE), (3, PROSE.replace("slowly", "quickly")), (4, PROSE.upper()), (5, None), (6, ""), (7, "   \n\t "), (8, "one"),
        (9, "one two three four"), (10, "one two three four"), (11, "\n\n\n"), (12, SHARED + "\n" + PROSE), (13, "  " + SHARED.upper() + "\t\n" + PROSE[:200]),
        (14, SHARED), (15, SHARED + "\n" + SHARED), (16, "x\n" + SHARED + "\ny"), (17, "é ü ß 漢字 🙂 " * 40), (18, "a" * 5000), (19, "1" * 3000 + "." * 50 + "@" * 50),
        (20, " ".join(words * 60)), (21, "home | about | contact | terms\n" + PROSE), (22, "word!! word!! word!! " * 30), (23, " ".join(f"w{i}" for i in range(12))),
        (24, " ".join(f"w{i}" for i in range(13))), (25, " ".join(f"w{i}" for i in range(11))), (None, PROSE), (None, None), (26, "Released under the MIT license."),
        (27, "mail a.b@c.example.com or +1 (988) 555-2485 at 10.0.0.255 with 4111 1111 1111 1111"), (28, "<|endoftext|> and <|startoftext|>x<|ENDOFTEXT|>"),
        (29, "tab\there\x0b\x0c\rand nbsp line"), (30, "A" + "́" + "H̱ İ ﬁ ½ ²"), (-31, PROSE[::-1]),
    ]
    return [(i, t, None if i and i % 3 == 0 else "en", None, -1, 7, 8, "p", "r", 0.5, None) for i, t in texts]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(df):
    """(doc_id, text) of all rows."""
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
