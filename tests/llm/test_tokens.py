import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from nimbostrat.llm.token_store import WaveletMatrix, folder, occurrences, read_documents, token_output, write_tokens
from nimbostrat.llm.tokens import as_bytes, count_batch, encoder, ids_batch, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "B", "é", "'", "'s", "'ll", " ", "  ", "\n", "\n\n", "\t", ".", "***", "1", "42", "漢", "́", " ", "\x1c", "<|endoftext|>", "Ω", "²", "_", "\r\n", " the", "ing", "😀"]


def whole(texts):
    return [e.ids for e in encoder(PATH, "test", lambda e: e.ids).tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_pieces_encode_like_whole_texts(text):
    enc = encoder(PATH, "test", lambda e: e.ids)
    parts = enc.cut(text)
    assert "".join(parts) == text
    assert [x for ids in enc.learn(parts) for x in ids] == whole([text])[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), max_size=5))
def test_batches_encode_like_whole_texts(texts):
    enc = encoder(PATH, "<u2", as_bytes("<u2"))
    ids, counts = ids_batch(pa.array(texts, pa.large_string()), enc, "<u2")
    want = whole(texts) if texts else []
    assert counts.tolist() == [len(x) for x in want] == count_batch(pa.array(texts, pa.large_string()), PATH).tolist()
    assert ids.tolist() == [i for x in want for i in x]


def test_memory_starts_afresh(monkeypatch):
    """With little memory, and more pieces in a batch than it holds, results stay the same."""
    from nimbostrat.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    monkeypatch.setattr(tokens, "TOGETHER", 7)
    texts = [" ".join(f"w{k}.x\ny{k % 3}" for k in range(j, j + 9)) for j in range(20)]
    ids, counts = ids_batch(pa.array(texts, pa.large_string()), tokens.PieceEncoder(PATH, as_bytes("<u2")), "<u2")
    assert ids.tolist() == [i for x in whole(texts) for i in x] and counts.tolist() == [len(x) for x in whole(texts)]


def test_memory_of_pieces_is_small():
    """Pieces are remembered in arrays, not as an object each."""
    enc = encoder(PATH, "small", as_bytes("<u2"))
    ids_batch(pa.array(["some first words"], pa.large_string()), enc, "<u2")
    texts = pa.array([" ".join(f"w{k * 7919}q" for k in range(j, j + 1000)) for j in range(0, 50000, 1000)], pa.large_string())
    tracemalloc.start()
    try:
        ids_batch(texts, enc, "<u2")
        assert tracemalloc.get_traced_memory()[0] < 100 * 50000
    finally:
        tracemalloc.stop()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*PARTS, " a", " B!", " 'll", " é", " <|", "endoftext|>", " ²"]), max_size=14).map("".join), min_size=1, max_size=40))
def test_joined_pieces_encode_like_whole_texts(texts):
    """Pieces that the library gets in one text, in texts of three pieces and with a memory of few."""
    from nimbostrat.llm import tokens

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tokens, "JOINED", 3)
        patch.setattr(tokens, "REMEMBERED", 9)
        enc = encoder(PATH, "joined", as_bytes("<u4"))
        ids, counts = ids_batch(pa.array(texts, pa.large_string()), enc, "<u4")
    want = whole(texts)
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_documents_meet_shard_starts_where_they_are(spark, docs):
    """Rows of documents aren't shuffled to find where their shard begins."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = token_output(docs([(1, "a"), (2, "b")]), PATH)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan


def test_counts(docs, by_id):
    rows = [(1, "Some words, again."), (2, None), (3, ""), (4, "a" * 3000), (5, "long text " * 20000)]
    out = by_id(token_counts(docs(rows), PATH))
    for k, text in rows:
        n = len(whole([text or ""])[0])
        assert (out[k]["n_tokens"], out[k]["n_bytes"], out[k]["over_limit"]) == (n, len((text or "").encode()), n > 512)
    assert token_counts(docs([]), PATH).count() == 0
    clash = docs(rows).withColumnRenamed("source", "n_tokens")
    assert "text" not in token_counts(clash, PATH).columns and by_id(token_counts(clash, PATH))[2]["n_tokens"] == 0


def test_sentencepiece_counts(docs, by_id):
    path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["Some words here", "  two  spaces ", "x\ny", ""]
    out = by_id(token_counts(docs(list(enumerate(texts))), path))
    assert [out[k]["n_tokens"] for k in range(4)] == [len(model.encode(t)) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 600, n).astype(np.uint16)
    m = WaveletMatrix(n, *WaveletMatrix.build(ids, 10).parts())
    assert (m.decode() == ids).all()
    assert [m.access(i) for i in range(0, n, 97)] == ids[::97].tolist()
    for value in {*ids[:5].tolist(), 599, 1023}:
        where = np.flatnonzero(ids == value)
        assert m.rank(value, n) == len(where) and m.rank(value, n // 2) == (where < n // 2).sum()
        assert [m.select(value, k) for k in range(len(where))] == where.tolist()
        with pytest.raises(IndexError):
            m.select(value, len(where))


def test_round_trip(spark, docs, by_id):
    rows = [(k * 7 % 101, f"Text number {k}. " * (k % 9)) for k in range(101)] + [(500, None), (501, "z" * 2000)]
    table, out = docs(rows), folder(spark)
    write_tokens(table, PATH, out, shard_tokens=300)
    held = by_id(read_documents(spark, out))
    start, expected = 0, {}
    for k, text in sorted(rows):
        ids = whole([text or ""])[0] + [0]
        assert held[k]["ids"] == ids
        expected[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    found = by_id(token_output(table, PATH))
    assert {k: (v["start"], v["n_tokens"], v["ids_crc32"]) for k, v in found.items()} == expected
    token = whole(["Text"])[0][0]
    assert sum(r["n"] for r in occurrences(spark, out, token).collect()) == sum(v["ids"].count(token) for v in held.values())


def test_odd_tables(spark, docs):
    assert token_output(docs([]), PATH).count() == 0
    rows = token_output(docs([(1, "b"), (1, "a"), (None, "c"), (1, "a")]), PATH).orderBy("start").collect()
    assert [(r["doc_id"], r["start"]) for r in rows] == [(None, 0), (1, 2), (1, 4), (1, 6)]


def test_repeated_rows_and_clashing_columns(docs):
    rows = [(1, "Some words"), (1, "Some words"), (2, "x" * 5)]
    clash = docs(rows).withColumnRenamed("lang", "start").withColumnRenamed("source", "part").withColumnRenamed("n_chars", "n_tokens")
    assert sorted((r["doc_id"], r["n_tokens"]) for r in token_counts(clash, PATH).collect()) == sorted((k, len(whole([t])[0])) for k, t in rows)
    found = token_output(clash, PATH).orderBy("start").collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in found] == [(k, len(whole([t])[0]) + 1) for k, t in rows]


def test_recurring_pieces_outlast_the_memory(monkeypatch):
    """Pieces met again stay when the memory is full, though the latest batch lacks them; ids are those of the library."""
    from nimbostrat.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 100)
    enc, common = tokens.PieceEncoder(PATH, as_bytes("<u2")), [f" the{k}" for k in range(20)]
    batches = [common + [f" a{k}" for k in range(20)], common + [f" b{k}" for k in range(20)], [f" c{k}" for k in range(45)], common[::-1]]
    met, plain = [], enc.encoded
    enc.encoded = lambda parts: met.append(len(parts)) or plain(parts)
    for parts in batches:
        ids, sizes = enc.recall(pa.array(parts, pa.large_string()))
        assert np.split(ids, np.cumsum(sizes)[:-1])[-1].tolist() == whole(parts)[-1] and ids.tolist() == [x for one in whole(parts) for x in one]
    assert met == [40, 20, 45, 0]
    assert len(enc.pieces) <= 100
