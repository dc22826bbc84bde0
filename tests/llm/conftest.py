import pytest

TEXTS = [
    (1, "The same words in this small text are here for all to see."),
    (2, "The same words in this small text are here for all to see."),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "one two"),
    (7, "word " * 30_000 + "end"),
    (8, "x" * 20_000),
    (9, "Mail the.72@mail3.example.com or +1 (136) 555-7479, card 4111 1111 1111 1111 at 10.1.2.3."),
    (9, "Mail the.72@mail3.example.com or +1 (136) 555-7479, card 4111 1111 1111 1111 at 10.1.2.3."),
    (None, "a row without an id"),
    (10, "Ünï­cödé — “quotes” ﬁ 日本語 🙂 <|endoftext|> it's"),
    (-5, "Released under the MIT License.\nmore"),
]
#: Names that the operators use for columns of their own.
CLASHING = "id bigint, rep bigint, fp bigint, key string, label int, score double, kinds string, copies int, rank int, bucket string, h string, v int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), 1, 2, 3, "k", 4, 0.5, "x", 6, 7, "b", "h", 8) for i, t in TEXTS]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
