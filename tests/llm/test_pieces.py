import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from docquarry.llm import pieces
from docquarry.llm.pieces import ChunkTable, decode_documents, encode_documents, encoder, op3_sentencepiece, pieces_stay_in_words, text_stays
from tests.llm.data import odd, odd_texts, store, table, with_extra

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_equal_to_the_library_on_random_texts():
    sp, encode = library(), encoder(MODEL)
    assert pieces_stay_in_words(MODEL)
    random.seed(4)
    alphabet = [" ", " ", "  ", "▁", "\n", "\t", "\x00", "a", "b", "the", "é", "漢", "😀", " ", " ", "<s>", "</s>", "<unk>", "<0x41>", "'", "1", "﻿", "é"]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randrange(0, 30))) for _ in range(3000)]
    texts += [x for x in odd_texts() if x is not None]
    for t, ids in zip(texts, encode(texts)):
        assert np.frombuffer(ids, "<i4").tolist() == sp.encode(t), repr(t)


@pytest.mark.parametrize("change", [str.strip, lambda t: " ".join(t.split(" ")).replace("  ", " "), lambda t: unicodedata.normalize("NFKC", t)])
def test_models_that_change_the_text_are_refused(spark, monkeypatch, change):
    class Changing:
        """The library with a model that changes texts before it cuts them."""

        def __init__(self):
            self.sp = library()

        def normalize(self, text):
            return self.sp.normalize(change(text))

        def __getattr__(self, name):
            return getattr(self.sp, name)

    assert text_stays(MODEL)
    monkeypatch.setattr(pieces, "_processor", lambda model_file: Changing())
    assert not text_stays(MODEL)
    with pytest.raises(ValueError, match="strips blanks"):
        encode_documents(table(spark, ["a"]), MODEL)


def test_table_is_bounded_and_complete():
    table_ = ChunkTable(lambda cs, _: {c: c.upper().encode() for c in cs}, size=10)
    for i in range(100):
        lists = [[f"c{k}" for k in range(i, i + 8)], [], ["c0"]]
        assert table_.joined(lists) == [b"".join(c.upper().encode() for c in x) for x in lists]
        assert len(table_.now) <= 20 and len(table_.older) <= 20


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(docs, found):
    sp = library()
    want = []
    for doc_id, text in docs:
        ids = sp.encode(text or "")
        want.append((doc_id, len(ids), digest(",".join(map(str, ids))), digest(sp.decode(ids) if ids else "")))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check(docs, op3_sentencepiece(spark, sf).collect())


def test_odd_rows(spark, tmp_path):
    df = odd(spark)
    check(df.select("doc_id", "text").collect(), op3_sentencepiece(spark, store(df, tmp_path / "a")).collect())
    assert op3_sentencepiece(spark, store(table(spark, []), tmp_path / "b")).count() == 0


def test_round_trip_keeps_columns(spark):
    df = with_extra(table(spark, ["a plain text, with words", "Zweiter  Text\n"]))
    back = decode_documents(encode_documents(df, MODEL), MODEL)
    assert back.columns == [*df.columns, "_ids", "_decoded"]
    assert all(r["text"] == r["_decoded"] for r in back.collect())
