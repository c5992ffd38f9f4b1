import hashlib
import random
import time

import pyarrow as pa
import pytest

from glossa.llm import byte_bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

ALPHABET = "ab'sé ½ \n\t\x85%1  “ß漢\U0001f600Thé'll"


@pytest.fixture(scope="module")
def pair():
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.Encoder(ranks, P.PATTERN, cache=500), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def drawn(rng, most=30):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most)))


def test_encoding_equals_the_library(pair):
    ours, library = pair
    rng = random.Random(1)
    for text in ["", " ", "a", "\n\n x", "<|endoftext|>", "x" * 3000, " " * 500, "aaaa" * 200, *(drawn(rng) for _ in range(3000))]:
        ids = ours.encode(text)
        assert ids == library.encode_ordinary(text), repr(text)
        assert ours.decode(ids) == text.encode()


def test_columns_equal_the_library(pair):
    ours, library = pair
    rng = random.Random(4)
    texts = [None, "", " ", "a b", "  two", "end ", "é à ñ", "a\u3000 b", "x\u00a0 y \u2003z", "w" * 900, "don't 's 'll", *(drawn(rng) for _ in range(3000)), *(" ".join(drawn(rng, 8) for _ in range(9)) for _ in range(300))]
    for own in (ours, byte_bpe.Encoder(ours.vocabulary.ranks, "(?:" + P.PATTERN + ")", 50)):
        ids, ends = own.encode_column(pa.array(texts))
        for t, a, b in zip(texts, ends.tolist(), ends[1:].tolist()):
            assert ids[a:b].tolist() == library.encode_ordinary(t or ""), repr(t)


def test_appends_and_edits_equal_a_fresh_encoding(pair):
    ours, library = pair
    rng = random.Random(2)
    for _ in range(400):
        open_ = ours.open(drawn(rng))
        for _ in range(5):
            a = rng.randint(0, len(open_.text))
            open_.replace(a, rng.randint(a, min(len(open_.text), a + 5)), drawn(rng, 4))
            open_.append(drawn(rng, 3))
            assert open_.tokens() == library.encode_ordinary(open_.text), repr(open_.text)


def test_an_edit_encodes_few_pieces(pair):
    open_ = pair[0].open("one two three four five " * 200)
    assert open_.replace(2400, 2401, "x") < 6


def test_prefix_table_gives_every_prefix(pair):
    ours, library = pair
    data = b"internationalisation"
    table = byte_bpe.Prefixes(ours.vocabulary, data[:5]).append(data[5:])
    for end in range(1, len(data) + 1):
        assert table.tokens(end) == library._encode_bytes(data[:end])
    assert table.replace(5, 8, b"XYZ").tokens() == library._encode_bytes(b"interXYZionalisation")


def test_both_ways_fill_one_table(pair):
    ours, _ = pair
    rng = random.Random(4)
    for _ in range(500):
        data = "".join(rng.choice("abcdeinst\x85é漢") for _ in range(rng.randint(0, 60))).encode()
        whole = byte_bpe.Prefixes(ours.vocabulary, data)
        some = ours.vocabulary.on_demand(data)
        assert all(token in (-1, whole.last[end]) for end, token in enumerate(some))
        assert ours.vocabulary.encode(data) == whole.tokens()


def test_long_pieces_take_time_in_proportion(pair):
    ours, library = pair
    rng = random.Random(8)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    took = []
    for size in (100_000, 1_000_000):
        began = time.process_time()
        ids = ours.vocabulary.encode(text[:size].encode())
        took.append(time.process_time() - began)
        assert ours.decode(ids) == text[:size].encode()
    assert took[1] < 30 * took[0]
    assert ours.vocabulary.encode(text[:20_000].encode()) == library._encode_bytes(text[:20_000].encode())


def test_operator_on_nulls_repeats_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (3, "", "y")], "doc_id long, text string, n_tokens string")
    rows = byte_bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 0), (1, 2), (1, 2), (3, 0)]
    assert all(r.ids_sha256 == r.decoded_sha256 == empty for r in rows if not r.n_tokens)
    assert byte_bpe.encode_decode(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_a_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary({b"a": 0})


def test_workers_keep_no_texts_between_tasks(spark):
    """Workers outlive their stage; what they keep adds up to the executor's memory."""
    from glossa.llm.queries import tokenizer_file

    path, pattern = tokenizer_file()
    docs = spark.createDataFrame([(i, f"words of text number {i} and its end") for i in range(400)], "doc_id long, text string").repartition(4)
    byte_bpe.encode_decode(docs, path, pattern).write.format("noop").mode("overwrite").save()

    def kept(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(e._young) + len(e._old) + len(e.chunks.young) + len(e.chunks.old) for e in byte_bpe._ENCODERS.values())])], names=["n"])

    assert {r.n for r in spark.range(0, 4, 1, 4).mapInArrow(kept, "n long").collect()} == {0}
