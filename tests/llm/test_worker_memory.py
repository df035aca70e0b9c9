"""What a stage leaves in reused Python workers."""

import pytest

from riskloom.llm.common import give_back
from riskloom.llm.queries import TOKENIZER
from riskloom.llm.tokens import encoder


@pytest.mark.parametrize("kept", [True, False])
def test_stages_that_do_not_encode_free_the_encoders(kept):
    encoder(TOKENIZER, 1 << 20).encode(["some words here"])
    give_back(encoders=kept)
    assert bool(encoder.cache_info().currsize) == kept
    encoder.cache_clear()
