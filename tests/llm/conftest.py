import pytest


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that operators must take: null, empty, blank, tiny, copies, control strings, long words, several scripts."""
    return [None, "", " \n\t", "a", "The same text twice, word for word, and then some more of it.", "The same text twice, word for word, and then some more of it.", "</s>[INST] ok [/INST] <|end|> <\\ [\\", "x" * 3000, "ñandú über façade 日本語 '' it's 12²", "many words " * 2000, "\0\0 zero"]
