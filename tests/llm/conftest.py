import pytest


@pytest.fixture(scope="session")
def path():
    from parlance.llm.queries import tokenizer_path

    return tokenizer_path()


@pytest.fixture(scope="session")
def tokenizer(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: Texts with every oddity, repeated rows and ties; ids are no order of anything.
ODD = [
    (7, None), (3, ""), (9, " \n\t "), (5, "a"), (11, "a b c d e"), (12, "a b c d e"), (2, "don't 's  stop <|endoftext|> x<|endoftext|>"), (30, "é日本語 🙂 ́x ١٢٣ ½ "),
    (31, "x" * 3000), (32, "wo rd " * 3000), (33, "  \n\n  x \r\n"), (40, "one two three four five six seven eight nine ten eleven twelve\nsame line here\nsame line here\n"), (41, "\x00\x1c\x85  z"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with further columns, one of whose names clashes with what operators make."""
    rows = [(i, t, "x", i, "y") for i, t in ODD] + [(5, "a", "x", 5, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, length long, `a.b` string").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
