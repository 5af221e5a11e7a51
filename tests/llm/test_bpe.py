import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from billweave.llm import bpe
from helpers import LONG, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Hello, world! It's 2024.", "", None, "   \n\n\t  x  ", "a<|endoftext|>b <|endoftext|>", LONG,
         "aaaaaaaaaaaaaaaaaaaaa bbbb", "日本語 😀👩‍👩‍👧 ñandú", "we'll 'S \u0085\u00a0\x1c z", "Hello, world! It's 2024.",
         "x" * 20_000, "\ufeff\u200b ²½ ٣٤"]


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.Tokenizer(PATH)


def test_like_the_tokenizers_library_and_back(spark, tokenizer):
    from tokenizers import Tokenizer
    theirs = Tokenizer.from_file(PATH)
    docs = documents(spark, TEXTS).withColumn("decoded", F.lit("mine"))
    coded = bpe.encode(docs, tokenizer)
    rows = bpe.decode(coded, tokenizer).orderBy("doc_id").collect()
    for text, row in zip(TEXTS, rows, strict=True):
        ids = np.frombuffer(row.ids, "<u4").tolist()
        assert ids == theirs.encode(text or "", add_special_tokens=False).ids
        assert row.decoded == theirs.decode(ids, skip_special_tokens=False) == (text or "")
    assert coded.columns == [*docs.columns, "ids"]


def test_words_are_merged_alike_in_any_company(tokenizer):
    """All words at once, or one by one; the cache changes nothing."""
    words = [w.encode() for w in (" the", "the", "thethethe", "eeeeeee", "z", "", " 1000000")]
    assert bpe.merge_words(words, tokenizer) == [bpe.merge_words([w], tokenizer)[0] for w in words]
    encoder = bpe.Encoder(tokenizer)
    first = encoder.encode(TEXTS)
    assert encoder.encode(TEXTS) == first == bpe.Encoder(tokenizer).encode(TEXTS)


def test_empty_table_and_other_tokenizers(spark, tokenizer, tmp_path):
    assert bpe.decode(bpe.encode(documents(spark, []), tokenizer), tokenizer).count() == 0
    with pytest.raises(ValueError, match="plain byte-level"):
        bpe.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))
