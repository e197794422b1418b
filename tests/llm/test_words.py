import random
import re

import pyarrow as pa
import pytest

from radquery.llm.op5_quality import repeated_words
from radquery.llm.token_ids import encoding
from radquery.llm.words import slices, split_flat, split_words

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = ["", "  a b\n\nc ", "\x0b x\x0cy \x1c z\x85w v u", "don't İstanbul'S Ǆ é ́a", "\x00", "abc. Abc, é. a., .,. a.b. 1. ́. ,", "q.́ it's. 's, İ. K.",
       "<|endoftext|> x <|ENDOFTEXT|>. y<|startoftext|>z", "the " * 3000, "日本語 текст Ωmega 'll 'LL", "tab\tand\rreturn"]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def test_split():
    flat, offsets = split_flat(pa.array(ODD))
    assert [flat.slice(offsets[i], offsets[i + 1] - offsets[i]).to_pylist() for i in range(len(ODD))] == [words(t) for t in ODD]


def test_slices_cover_every_row_once():
    batch = pa.record_batch([["x" * n for n in (5, 0, 50, 3, 3)] + [None]], names=["text"])
    parts = list(slices(batch, most=10))
    assert [r for p in parts for r in p.column(0).to_pylist()] == batch.column(0).to_pylist() and len(parts) > 2


def test_ids_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    with encoding(path) as encoder:
        ids, offsets = encoder.encode(pa.array([*ODD, None]), 1)
    for i, t in enumerate([*ODD, ""]):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids + [1]


def test_words_of_letters_are_told_apart_in_one_text():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, rng = Tokenizer.from_file(path), random.Random(1)
    some = ["House", "straße", "ǅ", "한국", "текст", "ﬁne", "İstanbul", "İİ", "x1y", "don't", "a.", "qzxvkj"]  # two are more than one run in lower case
    with encoding(path) as encoder:
        assert encoder.ends is not None
        for known in (some[:6], some):
            texts = [" ".join(rng.choice(known) + "ab"[: k % 3] for _ in range(k % 9)) for k in range(1500)]
            ids, offsets = encoder.encode(pa.array(texts), 1)
            assert [ids[offsets[i] : offsets[i + 1]].tolist() for i in range(len(texts))] == [plain.encode(t, add_special_tokens=False).ids + [1] for t in texts]
            encoder.forget()


def test_repeated_words():
    def brute(w):
        seen, out = {}, set()
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                out.update(j for i in at for j in range(i, i + 8))
        return len(out)

    texts = ["a b c d e f g h " * 3, "x " * 9, "x " * 8, "", "a b c d e f g h z " * 2 + "q", "a b c d e f g h", "p q r"]
    codes, offsets, _ = split_words(pa.array(texts))
    assert repeated_words(codes, offsets).tolist() == [brute(words(t)) for t in texts]
