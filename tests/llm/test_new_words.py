"""Words met for the first time get the library's ids, with and without a space before them."""

import pytest

from hushframe.llm.tokens import ChunkEncoder, packed, public_path


@pytest.mark.parametrize(("name", "word_ends"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_new_words_give_the_librarys_ids(name, word_ends):
    encoder = ChunkEncoder(public_path(name), word_ends, None)
    for word in ("Zqxweril", "the", "vbnonré", "élan", "A"):
        for key, text in ((word, word if word_ends else " " + word), (" " + word, word)):
            assert encoder._word(key) == packed(encoder.tokenizer.encode(text, add_special_tokens=False).ids)
