import hashlib
import random

import pytest
from tokenizers import Tokenizer

from hourcast.llm import bpe


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder()


def test_same_as_the_library(library, coder):
    texts = [
        "", " ", "a", "aaaaaaa aaaaaaaaaa", "don't we'LL I'd", "<|endoftext|>x<|startoftext|>", "<|STARTOFTEXT|> <|endoftext", "ΣΑΣ İi ß ﬁ",
        "é é ẞ", "1234 ½ ² Ⅷ ٣", "\x1c\x1d\x85　x y", "日本語テキスト 한국어", "😀😀 👩‍👩‍👧", "_a_b__c", "x" * 5000, "hello,world!!! ''s 's",
        "internationalization of the unbelievable", "﻿abc", "a\x00b\x7f",
    ]
    for t in texts:
        assert coder.encode(t) == library.encode(t, add_special_tokens=False).ids, ascii(t)
        ids = coder.encode(t)
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_character_is_of_the_library_s_kind(library, coder):
    """Letters, numbers, lower case and compositions of the library's own Unicode version, new characters included."""
    every = [chr(c) for c in range(0x80, 0x32000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(every), 512):
        text = " ".join(f"a{c}1{c}" for c in every[k : k + 512])
        words = [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]
        assert len(coder.split(text)) == len(words), hex(ord(every[k]))
    rng = random.Random(9)
    new = [*range(0x1C89, 0x1C8B), 0xA7CB, 0xA7DC, *range(0x105C0, 0x105F4), *range(0x10940, 0x10960), 0x10D50, *range(0x11DE0, 0x11DEA), *range(0x11380, 0x113D0), *range(0x16D40, 0x16D6B), 0x20D9, 0x307]
    for _ in range(1500):
        text = "".join(rng.choice([chr(rng.choice(new)), rng.choice("aZ1 !ÉΣ"), chr(rng.randrange(0x250, 0x3100))]) for _ in range(rng.randrange(1, 12)))
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_shared_prefixes_do_not_change_a_word(coder, library):
    words = ["the", "then", "thenc", "thence", "thenceforth", "thencefort", "th", "t", "theme", "themes", "tthe"]
    together = coder.v.encode_words(words)
    for w in words:
        assert list(together[w]) == list(coder.v.encode_words([w])[w]) == library.encode(w, add_special_tokens=False).ids


def test_every_token_is_its_own_encoding(coder):
    # tokens that no merge makes from their own symbols are never encoded
    for t, (rank, a, b) in list(coder.v.made.items())[::97]:
        if rank >= 0:
            assert coder.v.symbols[t] == coder.v.symbols[a] + coder.v.symbols[b]


def test_whole_table(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: r for r in bpe.op3_trie_bpe(spark, docs).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert got[r["doc_id"]]["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_encode_then_decode(spark, odd, library):
    encoded = bpe.encode(odd)
    ids = [r["ids"] for r in encoded.collect()]
    assert sorted(map(tuple, ids)) == sorted(tuple(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd.collect())
    assert sorted(r["decoded"] for r in bpe.decode(encoded).collect()) == sorted(library.decode(x, skip_special_tokens=False) for x in ids)
