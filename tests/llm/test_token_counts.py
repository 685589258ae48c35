import pytest
from tokenizers import Tokenizer

import public_tokenizers
from attrition.llm import token_counts as tc
from attrition.llm.tokenization import VOCABULARY, load_tokenizer
from tests.llm.cases import awkward, awkward_rows, clashing, empty


def library_counts(rows):
    t = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    return sorted(((k, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for k, x in rows), key=repr)


def counts(df, **options):
    return sorted(((r.key, r.n_bytes, r.n_tokens) for r in tc.token_counts(df, **options).collect()), key=repr)


def test_awkward_rows_cut_into_small_chunks(spark):
    assert counts(awkward(spark), chunk_bytes=1000, overlap_bytes=50) == library_counts([(r[0], r[1]) for r in awkward_rows()])


def test_seams_that_need_wider_overlaps(spark):
    rows = [(1, "a" * 9000), (2, "é" * 5000 + " tail " * 300), (3, "x <|endoftext|> y" * 500), (4, "\n\n   \n" * 2000),
            (5, ("word " * 30 + "w" * 700) * 20), (5, ("word " * 30 + "w" * 700) * 20), (6, "漢字 かな " * 1500), (None, "1 2  3\t4\r\n" * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert counts(df, chunk_bytes=700, overlap_bytes=32) == library_counts(rows)


def test_chunks_cover_the_text():
    data = ("añ " * 1000).encode()
    cuts = tc.cut_points(data, 300, 20)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(data)
    for (_, b), (c, _) in zip(cuts, cuts[1:], strict=False):
        assert b - c >= 20
        data[c:b].decode()


def test_other_vocabularies_are_encoded_whole(spark):
    df = spark.createDataFrame([(1, "Some words here"), (2, None)], "doc_id long, text string")
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert counts(df, vocabulary="piece_bpe_32k.model")[0][2] == len(sp.encode("Some words here"))
    wp = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert counts(df, vocabulary="word_bpe_49k.json")[0][2] == len(wp.encode("Some words here", add_special_tokens=False).ids)


@pytest.mark.parametrize("context", ["a{0}b {0} 1{0}{0}2  {0}x {0}\n"])
def test_both_libraries_agree_on_every_code_point(context):
    t = load_tokenizer()
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 16):  # sixteen neighbours share a text
        text = "".join(context.format(c) for c in points[i:i + 16])
        assert t.exact.encode(text, add_special_tokens=False).ids == t.fast.encode_ordinary(text)


def test_columns_clash_and_empty(spark):
    assert tc.count_table(clashing(spark, "n_bytes", "n_tokens", "row", "key")).count() == len(awkward_rows())
    assert tc.count_table(empty(spark)).collect() == []
