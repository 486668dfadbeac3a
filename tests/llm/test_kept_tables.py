"""What a worker keeps for the batches of one stage of the pipeline is not held through the next."""

import public_tokenizers

from threadmill.llm import bpe, common, decontaminate


def test_encoding_begins_without_tables_of_earlier_steps():
    common.powers(common.BASE, 1 << 20)
    decontaminate._made["x"] = object()
    bpe._made.clear()
    encoder = bpe.tokenizer_of(bpe.load(public_tokenizers.path("word_bpe_49k.json")))
    assert not common._powers and not decontaminate._made
    assert len(next(iter(encoder.encode_all(["the morning market"])))) > 0 and common.powers(common.BASE, 3)[2] == common.BASE * common.BASE


def test_encoding_alone_keeps_no_decoded_texts():
    definition = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    encoder, whole = bpe.tokenizer_of(definition, texts=False), bpe.ForcedBoundaryBpe(definition)
    texts = ["The morning market, naïve 12 words!", "", "a" * 300 + " <|endoftext|> b"]
    assert [x.tolist() for x in encoder.encode_all(texts)] == [x.tolist() for x in whole.encode_all(texts)]
    assert encoder.ids and not encoder.texts and whole.texts and not any(t for _, t in encoder.fragments.values())
