"""Words and seeds of several texts at once."""

import random
import re

import numpy as np

from riskloom.llm import decontaminate
from riskloom.llm.common import WordHashes, ngram_hashes


def test_only_words_of_items_have_hashes_of_their_own():
    words = decontaminate.ItemWords(iter(["one", "two", "one", "é"]))
    found = words.of([["one", "no"], [], ["é", "never"]]).tolist()
    hashes = WordHashes()
    assert found == [hashes["one"], words.other, hashes["é"], words.other]
    assert words.other not in words.known.values() and decontaminate.ItemWords(iter([])).of([["a"]]).tolist() == [0]
    pick, signs = random.Random(1), [*"aZ09_- \t\n\x1c.'", "é", "İ", "漢", "\x85"]
    for text in ["".join(pick.choices(signs[: pick.choice([12, 16])], k=30)) for _ in range(500)]:
        assert decontaminate.words_of(text) == re.findall(r"[^\W_]+", text.lower())


def test_seeds_do_not_reach_into_the_next_text():
    words = decontaminate.ItemWords(iter("a b c d e".split()))
    block = decontaminate.ItemBlock([1], [words.of(["a b c d e".split()])], {}, 0.6, 3)
    texts = [t.split() for t in ("x a b", "c d", "", "y b c d", "a b", "c")]
    starts = np.cumsum([0, *map(len, texts)])
    assert decontaminate._seeded(block, words.of(texts), starts) == [3]
    assert len(ngram_hashes(words.of(texts), 3)) == starts[-1] - 2
