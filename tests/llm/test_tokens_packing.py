import base64
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from palimpsest.llm import packing, tokens

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "a", "Hello  world\n\n it's 42 o'clock\t\r\n x", "<|endoftext|> <|startoftext|>", "word <|endoftext|> x", "a<|startoftext|>b <|ENDOFTEXT|>", "é<|endoftext|>" * 3000, "Éa̋ ß 東京 x\x85y\xa0z\x1cq ΑΣ ΑΣΑ", "😀" * 50,
    "word, " * 40_000, "x" * 70_000, " \n" * 40_000 + "end", "it's they're 5's " * 9000, "a", "a",
]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, ids long")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_is_the_whole_text(spark):
    plain = reference()
    rows = tokens.decode(tokens.encode(frame(spark), RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == plain.encode_ordinary(text)
        assert r.n_tokens == len(r.ids) // 4 and bytes(r.decoded) == text.encode()


def test_cut_ids_decode_to_raw_bytes(spark):
    ids = np.array(reference().encode_ordinary("😀é"), "<u4")
    got = tokens.decode(spark.createDataFrame([(1, ids[:1].tobytes()), (2, None)], "k int, ids binary"), RANKS, P.PATTERN).orderBy("k").collect()
    assert "😀é".encode().startswith(bytes(got[0].decoded)) and got[1].decoded is None


def test_empty_tables(spark):
    assert tokens.encode(frame(spark).limit(0), RANKS, P.PATTERN).count() == 0
    assert packing.pack_documents(frame(spark).limit(0), WORDS).count() == 0


def check_packing(pieces, texts, length):
    plain = Tokenizer.from_file(WORDS)
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for doc, rows in by_doc.items():
        want = [*plain.encode(texts[doc] or "", add_special_tokens=False).ids, 2]
        rows.sort(key=lambda r: r.start)
        got = [i for r in rows for i in np.frombuffer(r.ids, "<u4").tolist()]
        assert got == want and [r.start for r in rows] == np.cumsum([0, *(r.length for r in rows[:-1])]).tolist()
        assert all(r.doc_tokens == len(want) and r.length == len(r.ids) // 4 > 0 for r in rows)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0, *(r.length for r in rows[:-1])]).tolist()
        total = sum(r.length for r in rows)
        assert total <= length and total & (total - 1) == 0


def test_packing(spark):
    for length in (64, 4096):
        check_packing(packing.pack_documents(frame(spark), WORDS, length=length).collect(), TEXTS, length)


def test_special_tokens_may_be_ordinary_text():
    plain = Tokenizer.from_file(WORDS)
    plain.encode_special_tokens = True
    flat, lens = packing.TextIds(WORDS, special=False).of_texts(pa.array(TEXTS, pa.string()))
    assert np.split(flat, np.cumsum(lens)[:-1]) and flat.tolist() == [i for t in TEXTS for i in plain.encode(t or "", add_special_tokens=False).ids]


def test_other_tokenizer_files_get_whole_texts():
    other = P.path("byte_bpe_50k.json")
    ids, plain = packing.TextIds(other), Tokenizer.from_file(other)
    texts = [t for t in TEXTS if not t or len(t) < 1000]
    flat, lens = ids.of_texts(pa.array(texts, pa.string()))
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not ids.by_words and packing.TextIds(WORDS).by_words
    assert lens.tolist() == list(map(len, want)) and flat.tolist() == [i for x in want for i in x]


def test_crc_of_pieces(spark):
    rows = packing.pack_documents(frame(spark, ["one two three"] * 3), WORDS).selectExpr("ids", "crc32(ids) c").collect()
    assert all(zlib.crc32(r.ids) == r.c for r in rows)


def test_hilbert_curve_visits_neighbours():
    for bits, dims in ((3, 2), (2, 3), (4, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = packing.hilbert_key(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
