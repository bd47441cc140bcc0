import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer as Library

from parcelflow.llm import bpe
from parcelflow.llm.settings import TOKENIZERS

from .conftest import ODD_TEXTS

PATH = TOKENIZERS["word_bpe_49k"]
LETTERS = "abAB'sStTreEvVdDlL  \n\t.,!<|>0123éÉßΣςσ́İ あ漢🙂-—%aaa"


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


def test_as_the_library_over_documents(spark, docs_of, library):
    draw = random.Random(5)
    made = [
        "".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 90)))
        + draw.choice(["", "<|endoftext|>", "x<|startoftext|>É<|endoftext|>"])
        for _ in range(300)
    ]
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = [*ODD_TEXTS, *made, *texts]
    encoded = bpe.encode_documents(docs_of(texts), PATH)
    rows, sums = (df.orderBy("doc_id").collect() for df in (encoded, bpe.digests(encoded)))
    assert len(rows) == len(texts)
    for text, row, digest in zip(texts, rows, sums):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids, text
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row["decoded"] == decoded
        packed = np.array(ids, "<u4").tobytes()
        assert (digest["n_tokens"], digest["ids_sha256"], digest["decoded_sha256"]) == (
            len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(),
        )


def test_every_character_as_the_library(library):
    encoder = bpe.Encoder(bpe.Vocabulary.read(PATH))
    points = [c for c in range(1, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    points += [c for c in range(1, 0x3000)] + [*bpe.LOWER]
    texts = [f"a{chr(c)}b {chr(c)}1" for c in points]
    own = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]
    assert own == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_memory_of_words_starts_anew(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    encoder = bpe.Encoder(bpe.Vocabulary.read(PATH))
    for text in ["one two three four five", "five six", "one six seven", ""]:
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode(text).ids


def test_ids_and_texts_as_columns_of_their_own(spark, docs_of):
    from pyspark.sql import functions as F

    tokenizer = bpe.Tokenizer(spark, PATH)
    docs = docs_of([*ODD_TEXTS, "one Two three's"])
    rows = docs.select("doc_id", tokenizer.encode(F.col("text")).alias("ids"))
    rows = rows.withColumn("decoded", tokenizer.decode(F.col("ids"))).orderBy("doc_id").collect()
    assert rows == bpe.encode_documents(docs, PATH).orderBy("doc_id").collect()


def test_empty_table_null_ids_and_other_columns(docs_of):
    docs = docs_of([(None, "a b"), (None, None), (3, "a b")]).withColumnRenamed("lang", "ids")
    assert bpe.digests(bpe.encode_documents(docs, PATH)).select("n_tokens").orderBy("n_tokens").collect() == [
        (0,), (2,), (2,)
    ]
    assert bpe.digests(bpe.encode_documents(docs.limit(0), PATH)).count() == 0
