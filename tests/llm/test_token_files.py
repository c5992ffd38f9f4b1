import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from glossa.llm import textcuts
from glossa.llm import token_files as T

P = pytest.importorskip("public_tokenizers")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


def odd_texts(rng, n):
    signs = list("ab cZé  ß\t\n日本   \u0085　'st.,1 2  😀ñ Ā࿿ \x00\x1c") + ["'ll", " the", "<|endoftext|>", "\r\n"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_chunks_have_the_tokens_of_whole_texts(library):
    texts = odd_texts(random.Random(5), 4000) + ["", " ", "a" * 5000, "é " * 900, None, " lead", "trail "]
    with open(JSON, "rb") as file:
        chunks = T.library_ids(file.read(), "<u2")
    chunks.size = 3000
    for _ in range(2):  # the second time partly from the cache
        ids, ends = chunks.encode(pa.array(texts))
        for t, a, b in zip(texts, ends.tolist(), ends[1:].tolist()):
            assert ids[a:b].tolist() == library.encode(t or "", add_special_tokens=False).ids
    # Slices of arrays have offsets of their own.
    part = pa.array(texts).slice(7, 100)
    assert "".join(textcuts.chunks(part)[0].to_pylist()) == "".join(texts[7:107])


def test_new_words_are_encoded_many_at_a_time(library, monkeypatch):
    words = [f" wört{i}a" for i in range(1000)] + ["'s", " 's", "×'t", "Ā", "ɏ$", " !", "<|endoftext|>"]
    odd = ["\n", " ", "  a", "a ", "\u00a0b", "日本", "\ta", " \u3000", "\r", "a\nb"]
    texts: list[str] = []

    class Counted:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, batch, **options):
            texts.extend(batch)
            return library.encode_batch_fast(batch, **options)

    import tokenizers

    monkeypatch.setattr(tokenizers, "Tokenizer", type("Made", (), {"from_buffer": staticmethod(lambda _: Counted())}))
    chunks = T.library_ids(b"", "<u2")
    rng = random.Random(3)
    new = rng.sample(words + odd, len(words) + len(odd))
    assert [np.frombuffer(x, "<u2").tolist() for x in chunks.of(new)] == [library.encode(x, add_special_tokens=False).ids for x in new]
    assert len(texts) < 40  # each word was a text of its own
    assert textcuts.chunks(pa.array(["abc$$$ d's (é)-1"]))[0].to_pylist() == ["abc", "$$$", " d's", " (é", ")-1"]


@pytest.mark.parametrize("n, kinds", [(0, 3), (1, 1), (255, 5), (5000, 2), (300_000, 40_000), (270_001, 3)])
def test_block_round_trip(n, kinds):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), kinds - 1) if kinds > 3 else rng.integers(0, kinds, n)
    counts = np.bincount(ids, minlength=kinds + 3) * 1000
    freq, bits = T.scaled(counts)
    assert freq.sum() == (1 << bits if n else 0) and ((freq > 0) == (counts > 0)).all()
    table = T.Table(freq, bits)
    cuts = np.sort(rng.integers(0, n + 1, 9))
    sizes = np.diff(np.concatenate([[0], cuts, [n]]))
    data = T.encode_block(sizes, ids, table)
    back, out = T.decode_block(data, table)
    assert (back == sizes).all() and (out == ids).all()
    for a, b in [(0, n), (n // 2, n // 2 + 10), (n - 3, n + 9), (n, n)]:
        assert (T.decode_range(data, table, a, b) == ids[max(a, 0) : b]).all()


def test_size_is_near_the_entropy():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 400_000), 30_000)
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    table = T.Table(*T.scaled(counts))
    assert 8 * len(T.encode_block(np.array([len(ids)]), ids, table)) < 1.05 * len(ids) * -(p * np.log2(p)).sum()


def test_damage_is_found():
    ids = np.arange(9000) % 70
    table = T.Table(*T.scaled(np.bincount(ids)))
    data = T.encode_block(np.array([9000]), ids, table)
    for at in (0, 40, 2000, len(data) - 1):
        with pytest.raises(ValueError):
            T.decode_block(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :], table)
    other = T.Table(*T.scaled(np.bincount(ids) + np.arange(70)))
    with pytest.raises(ValueError):
        T.decode_block(data, other)


def expected(library, rows):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_documents(spark, library, monkeypatch):
    rng = random.Random(2)
    texts = odd_texts(rng, 400) + [None, "", "!!!", "long " * 30_000] + ["a copy"] * 300
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(t, 9, d) for d, t in rows], "text string, start int, doc_id long").repartition(5)
    monkeypatch.setattr(T, "BLOCK", 900)
    store = T.write(docs, JSON, parts=6)
    got = T.read(spark, store, with_ids=True).collect()
    assert sorted((tuple(r)[:4] for r in got), key=lambda r: r[1]) == expected(library, rows)
    assert store.blocks(spark).count() > 10 and len(store.before) > 1
    whole = [i for r in sorted(got, key=lambda r: r.start) for i in r.token_ids]
    for a, b in [(0, 50), (1000, 1500), (len(whole) - 5, len(whole) + 5), (40_000, 41_000)]:
        assert [i for r in T.read_ids(spark, store, a, b).orderBy("start").collect() for i in r.token_ids] == whole[a:b]


def test_repeated_ids_and_empty_table(spark, library):
    rows = [(1, "x"), (1, "x"), (1, "yy"), (0, "z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = T.read(spark, T.write(docs, JSON)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [0, 1, 1, 1] and got[-1].start + got[-1].n_tokens == sum(r.n_tokens for r in got)
    empty = T.write(spark.createDataFrame([], "doc_id long, text string"), JSON)
    assert T.read(spark, empty).collect() == [] and T.read_ids(spark, empty, 0, 9).collect() == []
