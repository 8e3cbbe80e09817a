"""Token ids against the library: special strings, other tokenizers, repeated rows."""

import random
import zlib

import numpy as np
import pytest

from siftlake.llm import token_output


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name):
    from tokenizers import Tokenizer

    path = token_output.public_tokenizer(name)
    whole, encoder, rng = Tokenizer.from_file(path), token_output.ChunkEncoder(path), random.Random(9)
    bits = ["hello", " ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", ". ", "World,", "\n", "<|", "42", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(300)] + ["hello <|endoftext|> world", "plain text."]
    for end_id in (1, 7):
        flat, sizes = encoder.encode([t.encode() for t in texts], end_id)
        for t, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1])):
            assert ids.tolist() == [*whole.encode(t, add_special_tokens=False).ids, end_id], t
    assert encoder.chunked == (name == "word_bpe_49k.json")


def test_repeated_rows_keep_a_row_each(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_output.public_tokenizer("word_bpe_49k.json"))
    rows = [(3, "same text"), (3, "same text"), (3, "other, text"), (None, "x"), (None, None), (1, "<|endoftext|>")]
    got = token_output.tokens_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    crc = lambda t: zlib.crc32(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == sorted((str(i), crc(t)) for i, t in rows)
    ends = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:])) and ends[0][0] == 0
