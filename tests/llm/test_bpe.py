from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer

from framelake.llm.bpe import Encoder, Vocabulary, bpe_encode

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", " ", "a", "aaaaaaa" * 9, "  two  spaces \n\n tab\t", "<|endoftext|>", "x<|endoftext|> y <|endoftext|>", "it's WE'LL don't", "žluťoučký kůň 日本語 🙂🙂", "1234567890 12,3", "\x00\x01​  　x", "é" * 300, "ab " * 500, "!!!???...", " \t<|endoftext|>\n "]


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_matches_library_on_hard_and_random_texts():
    rng, lib = random.Random(5), library()
    texts = HARD + ["".join(rng.choice("abcdeé  \n\t'sTthe0123 ,.!日🙂<|>") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    mine = Encoder(Vocabulary(open(PATH).read()))
    ids = mine.encode_batch(texts)
    want = [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]
    assert ids == want
    assert [mine.decode(x) for x in ids] == [lib.decode(x, skip_special_tokens=False) for x in want]


def test_decode_of_ids_that_are_not_utf8():
    lib, mine = library(), Encoder(Vocabulary(open(PATH).read()))
    rng = random.Random(1)
    for _ in range(50):
        ids = [rng.randrange(50257) for _ in range(20)]
        assert mine.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_whole_table_nulls_extra_columns_and_long_text(spark):
    lib = library()
    rows = [(1, "hello world", "ids"), (2, None, "x"), (None, "null id", None), (3, "", "n"), (3, "word " * 30000, "t"), (4, "z" * 20000, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, list(r.ids), r.decoded) for r in bpe_encode(df, PATH, decode=True).collect())
    want = sorted((-1 if i is None else i, len(x), x, t or "") for i, t, _ in rows for x in [lib.encode(t or "", add_special_tokens=False).ids])
    assert got == want
    assert bpe_encode(df.limit(0), PATH).count() == 0


def test_query_on_the_whole_table(spark):
    import hashlib

    from framelake.llm.queries import op4_bpe
    from tests.conftest import SF

    lib = library()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    got = op4_bpe(spark, SF)
    assert dict(got.dtypes)["n_tokens"] == "bigint"
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()} == want
