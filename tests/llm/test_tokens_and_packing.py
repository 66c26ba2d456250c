"""Token shards, packing, media and chat formatting: exact round trips against the plain libraries."""

from __future__ import annotations

import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sigspark.llm import chat_format, media, packing, queries, storage, token_frames, tokens

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ODD_TEXTS = ["", " ", "a", "\n\n  x", "it's we'll  \t\r\n 12ab_c", "naïve café ½ ²", "日本語 テキスト", "🙂🙂 ‍ ", "a" * 3000, "  trailing  ", "\x00\x1f", "ſ K", "À é", "</s><s>", "1٢٣", " x y"]


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.fixture(scope="module")
def encoded(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: np.array(library_ids(r["text"]), "<u4") for r in rows}


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_ids_are_those_of_the_library(text):
    assert np.frombuffer(tokens.encoder().encode(text), "<u2").tolist() == library_ids(text)[:-1]


def test_ids_of_random_text_are_those_of_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 500)  # generations change often
    rng = random.Random(3)
    common = "  \n\t'sta.,9\x1c\xa0\u3000\x85é"
    codec = tokens.PieceEncoder()
    for _ in range(20_000):
        parts = [rng.choice(common) if rng.random() < 0.7 else chr(rng.choice([rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.randrange(30))]
        if rng.random() < 0.05:
            parts.insert(rng.randrange(len(parts) + 1), "<|endoftext|>")
        text = "".join(parts)
        assert np.frombuffer(codec.encode(text), "<u2").tolist() == library_ids(text)[:-1]


@pytest.mark.parametrize("slice_bytes", [1, 64, 4 << 20])
def test_texts_encoded_together_keep_their_own_ids(monkeypatch, slice_bytes):
    monkeypatch.setattr(tokens, "SLICE_BYTES", slice_bytes)
    texts = [None, *ODD_TEXTS, "", "\nOf", "x\n", "\nOf", "'s", "don", "'t", " <|endoftext|> x", "w" * 100, "é" * 70 + ", é", "a  b", None]
    for column in (pa.array(texts), pa.array(["first", *texts], pa.large_string()).slice(1)):
        got = [np.frombuffer(ids, "<u2").tolist() for ids in tokens.PieceEncoder().encode_all(column)]
        assert got == [library_ids(t)[:-1] for t in texts]
    assert list(tokens.PieceEncoder().encode_all(pa.array([], pa.string()))) == []


def test_other_vocabularies_go_to_the_library_whole():
    codec = tokens.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(codec.encode("Some TEXT, here  now"), "<u2").tolist() == plain.encode("Some TEXT, here  now", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["end <|endoftext|> next", "<|endoftext|>", "a<|endoftext|><|endoftext|>b <|endoftext|", "é\n <|endoftext|>\n x"])
def test_added_tokens_are_those_of_the_library(text):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = np.frombuffer(tokens.encoder().encode(text), "<u2").tolist()
    assert got == plain.encode(text, add_special_tokens=False).ids and 50256 in got


def test_token_query_is_the_library(spark, sf_dir, encoded):
    at, expected = 0, {}
    for i in sorted(encoded):
        expected[i] = (at, len(encoded[i]), zlib.crc32(encoded[i].tobytes()))
        at += len(encoded[i])
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op1_token_frames(spark, sf_dir).collect()} == expected


def test_token_frames_edges_and_selective_reads(spark, monkeypatch):
    monkeypatch.setattr(token_frames, "FRAME_BYTES", 64)
    monkeypatch.setattr(token_frames, "RUN_SHARDS", 2)
    rows = [(3, "x y z" * 50), (1, None), (None, "null id"), (2, ""), (3, "x y z" * 50), (2, "tie"), (-5, "first")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, start string")
    manifest = token_frames.write_token_frames(df, storage.new_dir(spark, "t"))
    got = token_frames.read_token_frames(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, -5, 1, 2, 2, 3, 3]
    assert [r["n_tokens"] for r in got][2:4] == [1, 1]
    assert [r["doc_id"] for r in token_frames.read_token_frames(manifest, {1, 3}).orderBy("start").collect()] == [1, 3, 3]
    empty = token_frames.write_token_frames(df.limit(0), storage.new_dir(spark, "t"))
    assert token_frames.read_token_frames(empty).collect() == []


def shard(docs):
    out = io.BytesIO()
    token_frames.write_shard(out, docs)
    return out.getvalue()


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


def test_reader_decompresses_only_the_frames_it_needs_and_finds_damage():
    raw = shard([(i, np.random.default_rng(i).integers(0, 50_000, 60_000).astype("<u2").tobytes()) for i in range(20)])
    reader = token_frames.ShardReader(Bytes(raw))
    assert len(list(reader.rows({7}))) == 1 and reader.frames_read == 1 < len(reader.frames)
    hurt = bytearray(raw)
    hurt[int(reader.frames[3]["offset"]) + 40] ^= 1
    bad = token_frames.ShardReader(Bytes(bytes(hurt)))
    assert len(list(bad.rows({0}))) == 1
    with pytest.raises(Exception):  # noqa: B017, PT011
        list(bad.rows())


def check_packing(rows, encoded, capacity=1024):
    """Each piece right, documents whole and in order, only long ones cut, sequences gapless and within capacity."""
    docs, bins = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append(r)
    assert set(docs) == set(encoded)
    for i, pieces in docs.items():
        pieces.sort(key=lambda r: r["piece"])
        ids, at = encoded[i], 0
        for k, r in enumerate(pieces):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["length"] == capacity or k == 0
            at += r["length"]
        assert at == len(ids) and len(pieces) == -(-len(ids) // capacity)
    for pieces in bins.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(bins)


def test_packing_query(spark, sf_dir, encoded):
    n = check_packing(queries.op6_best_fit_packing(spark, sf_dir).collect(), encoded)
    assert n <= 1 + 1.01 * sum(len(x) for x in encoded.values()) / 1024


def test_packing_rounds_merge_what_tasks_leave(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROUND_BINS", 8)
    rng = random.Random(5)
    docs = [(i, " ".join("word" for _ in range(rng.randrange(1, 700)))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(24)
    n = check_packing(packing.pack_sequences(df).collect(), {i: np.array(library_ids(t), "<u4") for i, t in docs})
    total = sum(len(library_ids(t)) for _, t in docs)
    assert n <= 1.05 * total / 1024 + 1


def test_packing_edges(spark):
    rows = [(1, None), (2, ""), (None, "x"), (4, "y"), (4, "y"), (5, "word " * 5000)]
    df = spark.createDataFrame([(i, t, 9, "p") for i, t in rows], "doc_id long, text string, offset int, piece string")
    got = packing.pack_sequences(df).collect()
    assert sorted(str(r["doc_id"]) for r in got if r["length"] < 1024 and r["doc_id"] != 5) == ["1", "2", "4", "4", "None"]
    assert packing.pack_sequences(df.limit(0)).collect() == []


def test_best_fit_takes_the_fullest_bin():
    where, bins = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins == 2 and where.tolist() == [0, 1, 0, 1, 1]


# Media


def test_media_query_reads_back_whole_texts(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op3_media_columns(spark, sf_dir).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        stored = b"P6\n64 %d\n255\n" % (len(payload) // 192) + payload
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(stored))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and len(r["feature"]) == 16


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (16, 16), (7, 64)])
def test_codecs_round_trip(shape):
    pixels = np.random.default_rng(0).integers(0, 256, (*shape, 3)).astype(np.uint8)
    assert (media.decode(media.encode_ppm(pixels)) == pixels).all()
    assert (media.decode(media.encode_bmp(pixels)) == pixels).all()


def test_plain_and_bit_netpbm():
    assert media.decode(b"P1 # c\n3 1\n1 0 1").tolist() == [[0, 255, 0]]
    assert media.decode(b"P2\n2 1\n15\n0 15").tolist() == [[0, 255]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P5 2 1 65535\n\x00\x00\xff\xff").tolist() == [[0, 255]]


def test_area_resize_is_the_mean_of_areas():
    image = np.random.default_rng(1).integers(0, 256, (12, 9)).astype(float)
    assert np.allclose(media.area_resize(image, 4, 3), image.reshape(4, 3, 3, 3).mean(axis=(1, 3)))
    fine = np.kron(image, np.ones((5, 7)))  # edges inside pixels: the same areas on a grid that divides
    assert np.allclose(media.area_resize(image, 5, 7), fine.reshape(5, 12, 7, 9).mean(axis=(1, 3)))


def test_features_of_a_large_image_take_little_memory():
    import tracemalloc

    image = np.random.default_rng(3).integers(0, 256, (200_000, 64, 3), np.uint8)
    data = media.encode_ppm(image)
    tracemalloc.start()
    found, small = media.difference_hash(media.decode(data)), media.tile(media.decode(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.1 * len(data)
    # By all pixels at once: rows of equal areas, and columns that divide a pixel.
    rows = (image @ np.array([0.299, 0.587, 0.114])).reshape(8, 25_000, 64).mean(axis=1)
    means = np.round(np.repeat(rows, 9, axis=1).reshape(8, 9, 64).mean(axis=2), 3)
    assert found == np.packbits(means[:, 1:] > means[:, :-1]).tobytes().hex()
    assert len(small) == len(media.tile(image[:7]))


def test_media_edges(spark):
    rows = [(1, None), (2, b""), (3, b"BMxx"), (4, b"P6\n2 2\n255\nabc"), (5, media.encode_ppm(np.zeros((2, 2, 3), np.uint8))), (None, b"P9")]
    got = {r["doc_id"]: r for r in media.media_features(spark.createDataFrame([(i, m, "n") for i, m in rows], "doc_id long, media binary, n_bytes string")).collect()}
    assert all(got[i]["feature"] is None for i in (1, 2, 3, 4, None)) and got[2]["media_bytes"] == 0 and got[1]["media_bytes"] is None
    assert np.load(io.BytesIO(got[5]["tile"])).shape == (16, 16, 3) and got[5]["n_bytes"] == "n"
    texts = spark.createDataFrame([(1, None, "m"), (1, "", "m"), (None, "é" * 200, "m")], "doc_id long, text string, media string")
    assert sorted(r["payload_bytes"] for r in media.media_features(media.texts_to_media(texts)).collect()) == [192, 192, 576]
    assert media.media_features(media.texts_to_media(texts.limit(0))).collect() == []


# Chat


def test_chat_query_is_the_table(spark, sf_dir):
    convs = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    got = {r["conv_id"]: r for r in queries.op7_chat_format(spark, sf_dir).collect()}
    assert set(got) == set(convs)
    for i, turns in convs.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[i]["n_turns"] == len(turns) and got[i]["loss_chars"] == len(loss)
        assert got[i]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[i]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_any_turn_comes_back():
    rng = random.Random(2)
    parts = ["[INST]", "[/INST]", "[OUT]", "[\\/OUT]", "\\", "[", "]", "\n", "<s>", "</s>", "<<SYS>>", "<|im_end|>", "[ROLE:x]", "[/ROLE:a\\2fb]", "ok", "<\\/s>"]
    for _ in range(2000):
        role = rng.choice(["user", "assistant", "system", "tool", "a/b", "[x]", "", "INST"])
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        stored, _ = chat_format.render(role, text)
        assert [x[:2] for x in chat_format.parse(stored)] == [(role, text)]
        assert chat_format.unescape(chat_format.escape(text)) == text


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, 0, "assistant", "né"), (2, None, "assistant", ""), (3, 0, "tool/x", "y" * 100_000)]
    df = spark.createDataFrame([(*r, "f", "e") for r in rows], "conv_id long, turn long, role string, text string, formatted string, escaped string")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat_format.audit_conversations(chat_format.formatted_table(df)).collect()}
    assert got == {1: (3, 0), None: (1, 2), 2: (1, 0), 3: (1, 0)}
    assert chat_format.audit_conversations(chat_format.formatted_table(df.limit(0))).collect() == []
    with pytest.raises(chat_format.GrammarError):
        chat_format.parse("[INST]x[/OUT]\n")


def test_media_features_edges(spark):
    colours = bytearray(media.encode_bmp(np.zeros((2, 2, 3), np.uint8)))
    colours[28], colours[46:50] = 8, (300).to_bytes(4, "little")
    rows = [(1, None), (2, b""), (3, b"BM"), (4, bytes(colours)), (5, media.encode_bmp(np.zeros((2, 2, 3), np.uint8))), (5, media.encode_bmp(np.zeros((2, 2, 3), np.uint8)))]
    df = spark.createDataFrame([(i, m, "t", "x", "y") for i, m in rows], "doc_id long, media binary, tile string, Feature string, `a.b` string")
    out = media.media_features(df)
    assert out.columns[:2] == ["doc_id", "a.b"]
    got = {r["doc_id"]: (r["payload_bytes"], r["media_bytes"], r["a.b"]) for r in out.collect()}
    assert got == {1: (None, None, "y"), 2: (None, 0, "y"), 3: (None, 2, "y"), 4: (None, len(colours), "y"), 5: (12, 70, "y")}
    assert out.count() == 6 and media.media_features(df.limit(0)).collect() == []
    with pytest.raises(media.MediaError):
        media.decode(bytes(colours))


def test_audit_of_null_and_repeated_turns(spark):
    df = spark.createDataFrame([(1, 0, None, "e"), (2, 0, "[INST]a[/INST]\n", "e"), (2, 0, "[INST]a[/INST]\n", "e"), (None, 1, "[OUT]b[/OUT]\n", "e")], "conv_id long, turn long, formatted string, n_turns string")
    assert {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat_format.audit_conversations(df).collect()} == {1: (0, 0), 2: (2, 0), None: (1, 1)}
    assert chat_format.audit_conversations(df.limit(0)).collect() == []
