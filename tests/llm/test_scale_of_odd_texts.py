"""Very long texts of one mark must not take quadratic time."""

import time

import pytest

from archiveloom.llm.language import plain, sentences
from archiveloom.llm.markup import classified, pieces
from archiveloom.llm.quality import line_kinds, statistics
from archiveloom.llm.scans import prepared, repaired
from archiveloom.llm.stuffing import block_ratio, sentence_share

ODD = ["<", "[", "**", "_", "\\", "$", "&", "|", "=", " ", "\n", " \n", "-", ".", "x", "{", "#", "`", "a ", "\t", "http://", "1", "\xa0", "a;", "[a](", "''a", "\\a{", "<li>a"]


@pytest.mark.parametrize("mark", ODD)
def test_linear(mark):
    text = mark * (20_000 // len(mark))
    began = time.time()
    for f in (pieces, classified, prepared, lambda t: repaired(t, {"a": "b"}, set()), lambda t: line_kinds(t, frozenset()), lambda t: statistics(t, frozenset()), lambda t: sentences(plain(t)), sentence_share, block_ratio):
        f(text)
    assert time.time() - began < 8
