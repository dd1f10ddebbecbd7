"""A chunk that is not in the cache is worked out while its text is gone through, and stays in the cache."""

from hushframe.llm.tokens import ChunkEncoder, packed, public_path


def test_new_chunks_are_found_in_one_pass():
    encoder = ChunkEncoder(public_path("byte_bpe_50k.json"), False, 0)
    text = "Zqxweril, the 12 vbnonr\u00e9.\nA foo;bar the"
    asked = iter(text.split(" "))
    # Keys that can be gone through once only.
    found = b"".join(map(encoder.cache.__getitem__, [" " + next(asked), *asked]))
    assert found == packed(encoder.tokenizer.encode(text, add_special_tokens=False).ids)
    assert "the" in encoder.cache
    assert encoder.ids(text) == found + packed([0])
