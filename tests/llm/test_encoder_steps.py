"""What a step of the encoder looks at."""

from riskloom.llm.queries import TOKENIZER
from riskloom.llm.tokens import TokenEncoder


class Unwalked(dict):
    def keys(self):
        raise AssertionError("the whole cache was walked")


def test_a_step_looks_up_its_units_only():
    tool = TokenEncoder(TOKENIZER)
    tool.known = Unwalked()
    texts = ["one two three", "two three four"]
    assert tool.encode(texts) == tool.plain(texts)
    assert tool.encode(texts[::-1]) == tool.plain(texts[::-1])
    assert set(tool.known) == {"two", "three", "four"}


def test_a_known_word_is_not_encoded_again_with_signs_or_on_a_new_line():
    tool = TokenEncoder(TOKENIZER)
    units = tool._units
    tool.encode(["a word another", "b. other,\nword"])
    seen = []
    tool._units = lambda some, *more: seen.extend(some) or units(some, *more)
    texts = ["x word, another. word!?", "y\nword; word\nword, other"]
    assert tool.encode(texts) == tool.plain(texts)
    assert seen == ["other"] or not seen


def test_signs_and_line_feeds_give_the_ids_of_whole_texts():
    tool = TokenEncoder(TOKENIZER)
    texts = ["a it's, it', 'tis. é, ß! x<|endoftext|>, <|endoftext|>. <|endoftext, y_, 1.5, 12,", "\nfoo", "foo\n", "a\n\nb c", "a \nb c", "a\n b c"]
    texts += ["a\r\nb c", "a\n᠎b c", "a​\nb c", "a b\nc,\nd <x>\n<|endoftext|>\n'll e\n's", "\n", "", " ", "a ×, ÷. ɐ, 中, 中。 b"]
    assert tool.encode(texts) == tool.plain(texts) == tool.encode(texts)
    assert tool.held == tool._cost(tool.known) + tool._cost(tool.signs)
