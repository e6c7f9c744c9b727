"""Packing, token files and the codec."""

import json
import random
from array import array
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from corpuscraft.llm import token_files, wordbpe
from corpuscraft.llm.bestfit_packing import BestFit, pack_documents
from corpuscraft.llm.piece_codec import PieceCodec, codec_digest, decode_documents, default_model, encode_documents, product, states
from corpuscraft.llm.token_files import read_token_files, write_token_files
from corpuscraft.llm.wordbpe import coder, default_vocabulary

ODD = "aZéßÑöǅİſK 's'tnt.,!?…-_<|>0 9½²あ中  \t\n\x1ce\u0301\u200b😀'"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def library_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_coder_is_the_library(tokenizer):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|endoftext|>b c's <|startoftext|>x", "", None, "don't we'll I'D", "word " * 3000]
    c = coder(default_vocabulary())
    for t in texts:
        assert c.encode(t) == array("I", library_ids(tokenizer, t)).tobytes(), repr(t)


def test_words_are_learned_once_a_batch(tokenizer, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    texts = [None, "", " \n", "a<|endoftext|>b ABC!! abc Straße"] + [" ".join(rng.choices(words, k=40)) for _ in range(200)]
    for remembered in (0, 20_000, 10**8):  # the ids don't depend on what is remembered
        monkeypatch.setattr(wordbpe, "REMEMBERED", remembered)
        c, asked = wordbpe.WordCoder(default_vocabulary()), []
        learn = c._learn
        monkeypatch.setattr(c, "_learn", lambda new: asked.append(new) or learn(new))
        for a, b in ((0, 100), (100, 150), (150, 204), (3, 3)):
            ids, ends = c.encode_all(pa.array(texts[a:b], pa.string()))
            want = [library_ids(tokenizer, t) for t in texts[a:b]]
            assert ids.tolist() == [i for t in want for i in t] and ends.tolist() == [sum(map(len, want[: k + 1])) for k in range(len(want))]
        assert all(len(new) == len(set(new)) for new in asked) and len(asked) <= 3 and c.used <= remembered
        assert remembered < 10**8 or sum(map(len, asked)) == len(set().union(*asked))


ROWS = [(3, "Hello, world! It's here.", "x"), (1, None, "x"), (2, "", None), (None, "no id", "x"), (7, "long words here " * 3000, "x"), (3, "Hello, world! It's here.", "y"), (9, "ümlaut naïve 東京", "x")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, offset string")


# packing


def test_best_fit_closes_the_fullest():
    bins = BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7)] == [(0, 0), (1, 0)]
    assert bins.place(3) == (1, 7)  # the fullest that fits
    assert bins.place(8) == (2, 0)
    assert bins.place(5) == (3, 0)  # bin 2 (two free) closes before bin 0 (four free)
    assert bins.place(2) == (0, 6)


def test_best_fit_bounds_open_bins():
    rng, bins, fill = random.Random(1), BestFit(100, 5), {}
    for _ in range(2000):
        n = rng.randint(1, 100)
        b, at = bins.place(n)
        assert fill.get(b, 0) == at
        fill[b] = at + n
        assert fill[b] <= 100 and sum(map(len, bins.by_free)) == bins.n_open <= 5


def check_packing(tokenizer, rows, got, capacity):
    want = []
    for i, t in rows:
        ids = library_ids(tokenizer, t) + [0]
        want += [(i, k, s, len(p := ids[s : s + capacity]), crc32(array("I", p).tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    assert sorted(map(str, [tuple(r)[:5] for r in got])) == sorted(map(str, want))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r.length for r in got)


def test_packing_keeps_every_token(spark, tokenizer):
    rows = [(i, t) for i, t, _ in ROWS]
    got = pack_documents(docs(spark), capacity=256).collect()
    check_packing(tokenizer, rows, got, 256)
    assert pack_documents(docs(spark).limit(0)).count() == 0


def test_packing_is_tight(spark, tokenizer):
    rng = random.Random(6)
    rows = [(i, " ".join(["word"] * rng.randint(0, 300))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = pack_documents(df, capacity=256, with_ids=True).collect()
    assert all(crc32(r.ids) == r.ids_crc32 for r in got)
    n, total = check_packing(tokenizer, rows, got, 256)
    assert n <= 1.02 * -(-total // 256)


# token files


def test_token_files_round_trip(spark, tokenizer, tmp_path):
    root = str(tmp_path / "t")
    write_token_files(docs(spark), root, shards=3)
    got = sorted(read_token_files(spark, root).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 7, 9]
    at, texts = 0, {i: t for i, t, _ in ROWS}
    for r in got:
        ids = array("I", library_ids(tokenizer, texts[r.doc_id]) + [1])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc32(ids.tobytes()))
        at += len(ids)
    index = json.loads((tmp_path / "t" / "index.json").read_text())
    assert index["n_ids"] == at and index["width"] == 2
    whole = np.concatenate([np.fromfile(tmp_path / "t" / f"{name}.ids", "<u2") for _, name, _ in index["bases"]])
    assert len(whole) == at
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith(".")]


def test_token_files_in_pieces(spark, tokenizer, tmp_path, monkeypatch):
    """Blocks of few documents, pieces smaller than a document, and files that aren't mapped."""
    rng = random.Random(3)
    texts = [" ".join(["word"] * rng.choice([0, 1, 3, 40])) for _ in range(60)]
    root = str(tmp_path / "p")
    write_token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), root, shards=1)
    (name,) = (n for _, n, _ in json.loads((tmp_path / "p" / "index.json").read_text())["bases"])
    files = fs.LocalFileSystem()
    mapped = token_files.Numbers(files, f"{root}/{name}.ids", "<u2")
    read = token_files.Numbers(fs.SubTreeFileSystem("/", files), f"{root}/{name}.ids"[1:], "<u2")
    wanted = [crc32(array("I", library_ids(tokenizer, t) + [1]).tobytes()) for t in texts]
    bounds = token_files.Numbers(files, f"{root}/{name}.offsets", "<u8").range(0, 61).tolist()
    assert not hasattr(read, "map") and hasattr(mapped, "map") and len(read) == len(mapped) == bounds[-1]
    for piece in (1, 2, 7, 1 << 20):
        monkeypatch.setattr(token_files, "PIECE", piece)
        assert token_files.checksums(mapped, bounds) == token_files.checksums(read, bounds) == wanted
        assert token_files.checksums(read, bounds[5:20]) == wanted[5:19]
    got = sorted(read_token_files(spark, root).collect(), key=lambda r: r.doc_id)
    assert [r.ids_crc32 for r in got] == wanted and [r.start for r in got] == bounds[:-1]


def test_token_files_have_shards_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD", 1000)
    df = spark.createDataFrame([(i, "word " * 20) for i in range(300)], "doc_id long, text string")
    write_token_files(df, str(tmp_path / "b"))
    assert len(json.loads((tmp_path / "b" / "index.json").read_text())["bases"]) >= 25
    assert read_token_files(spark, str(tmp_path / "b")).count() == 300


def test_token_files_of_nothing(spark, tmp_path):
    write_token_files(docs(spark).limit(0), str(tmp_path / "e"))
    assert read_token_files(spark, str(tmp_path / "e")).count() == 0


# the codec


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(default_model())


def brute_best(codec, text):
    """The highest score of any sequence of pieces."""
    s = codec.normal(text)
    best = [0.0] + [-np.inf] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - codec.reach), j):
            found = codec.pieces.get(s[i:j])
            if found:
                best[j] = max(best[j], best[i] + found[1])
        if s[j - 1] not in codec.pieces:
            best[j] = max(best[j], best[j - 1] + codec.least)
    return best[-1]


def score_of(codec, ids):
    scores = {i: s for i, s in codec.pieces.values()}
    total, pending = 0.0, b""
    for i in np.frombuffer(ids, "<u4").tolist():
        if i in scores:
            total += scores[i]
        else:
            pending += codec.table[i]
    return total + codec.least * len(pending.decode())


TEXTS = ["", "the", "Hello  world 😀\n a\tb", "abcdefghij" * 40, " \n\n  x ", "▁mark", "It was the best of times, it was the worst. " * 20, "😀é中" * 30]


@pytest.mark.parametrize("text", TEXTS)
def test_encoding_has_the_best_score(codec, text):
    ids = codec.encode(text)
    assert abs(score_of(codec, ids) - brute_best(codec, text)) < 1e-6
    assert codec.decode(ids) == text.replace("▁", " ")


def test_library_lattice_agrees(codec):
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(default_model(), "rb").read())
    model.trainer_spec.model_type = 1
    lib = SentencePieceProcessor(model_proto=model.SerializeToString())
    for text in ("the", "then the", "ouen the of it", "quick brown foxes"):
        assert codec.encode(text) == array("I", [lib.piece_to_id(p) for p in lib.nbest_encode_as_pieces(text, 4)[0]]).tobytes()
    ids = [int(i) for i in np.frombuffer(codec.encode("Round trip, é😀"), "<u4")]
    assert lib.decode(ids) == "Round trip, é😀"


@pytest.mark.parametrize("text", TEXTS[1:])
@pytest.mark.parametrize("size", [16, 23, 64])
def test_chunks_reach_the_same_score(codec, text, size):
    s = codec.normal(text)
    chunks = [(s[a : a + size], s[a + size : a + size + codec.reach - 1]) for a in range(0, len(s), size)]
    ms = [codec.transfer(*c, whole=True) for c in chunks]
    assert states(ms, 0, 0) == states([codec.transfer(*c) for c in chunks], 0, 0)
    total = ms[0]
    for m in ms[1:]:
        total = product(total, m)
    at = states(ms, 0, 0)
    ids = b"".join(codec.trace(*c, a, b) for c, a, b in zip(chunks, at, at[1:]))
    assert abs(total[0, 0] - brute_best(codec, text)) < 1e-3 and abs(score_of(codec, ids) - total[0, 0]) < 1e-3
    assert codec.decode(ids) == text.replace("▁", " ")


def test_documents_by_both_ways(spark, codec):
    got = codec_digest(docs(spark), chunk=1000).collect()
    assert len(got) == len(ROWS) and all(r.round_trip for r in got)
    want = {i: crc32(codec.encode(t or "")) for i, t, _ in ROWS}
    assert {r.doc_id: r.ids_crc32 for r in got} == want  # the long text took the scan
    back = decode_documents(encode_documents(docs(spark))).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert codec_digest(docs(spark).limit(0)).count() == 0


# the model's own method


def test_merges_are_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    from corpuscraft.llm import merge_codec

    lib = SentencePieceProcessor(model_file=default_model())
    rng = random.Random(5)
    words = ["The", "quick", "naïve", "東京", "😀", "don't", "", "\n", "\t", "x" * 30, "Ünder", "1,234.5", "▁"]
    texts = [*TEXTS, *(" ".join(rng.choices(words, k=400)) for _ in range(10)), "ab" * 2000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: array("I", lib.encode(t or "")).tobytes() for i, t in enumerate(texts)}
    for chunk in (7, 100, 32768):
        rows = merge_codec.encode_documents(df, chunk=chunk).collect()
        assert {r.doc_id: bytes(r.ids) for r in rows} == want and {r.doc_id: r.text for r in rows} == dict(enumerate(texts))
        got = merge_codec.codec_digest(df, chunk=chunk).collect()
        assert {r.doc_id: (r.n_ids, r.ids_crc32) for r in got} == {i: (len(x) // 4, crc32(x)) for i, x in want.items()}
        assert all(r.round_trip == ("▁" not in (texts[r.doc_id] or "")) for r in got)
    assert merge_codec.codec_digest(df.limit(0)).count() == 0
