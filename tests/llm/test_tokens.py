import public_tokenizers
import pytest
import sentencepiece

from wiretide.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


def want(rows, limit=4096):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out = []
    for doc, text, *_ in rows:
        n = len(model.encode(text or ""))
        out.append((-1 if doc is None else doc, len((text or "").encode()), n, n > limit))
    return sorted(out)


def got(df, **options):
    return sorted(tokens.token_counts(df, PATH, **options).toPandas().fillna(-1).astype({"doc_id": int}).itertuples(index=False, name=None))


@pytest.mark.parametrize("chunk, overlap", [(tokens.CHUNK, tokens.OVERLAP), (120, 24), (64, 6)])
def test_equals_the_library(make_docs, corpus, chunk, overlap):
    rows = corpus + [(500, "x" * 900, "s"), (501, "  a  b " * 90 + "<s> </s>\n\n\t" * 30, "s"), (502, "日本語のテキスト" * 60, "s"), (503, "😀é́" * 150, "s")]
    assert got(make_docs(rows), chunk=chunk, overlap=overlap) == want(rows)


def test_no_rows(empty_docs):
    assert got(empty_docs) == []
