"""Token ids, their files and packing, against the library and against the definitions."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from merchantry.llm import binary, packing
from merchantry.llm.tokens import Encoder
from tests.llm.edge import documents, empty

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def library(path):
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


ENCODERS = {path: (Encoder(path, path == BYTE), library(path)) for path in (WORD, BYTE)}


def ids_of(path, text):
    return ENCODERS[path][1].encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("abSstTé'’ \n\t\r\x85 .!?-09ßÉµ²日Σς́<|>endoftx\x1c")), max_size=40))
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_the_library(path, text):
    assert np.frombuffer(ENCODERS[path][0].ids(text), "<u2").tolist() == ids_of(path, text)


def test_encoder_forgets_when_full(monkeypatch):
    monkeypatch.setattr("merchantry.llm.tokens.MEMORY", 5)
    small = Encoder(BYTE, True)
    for text in ("one two three four five six seven", "eight nine ten one two", "x" * 500 + " y"):
        assert np.frombuffer(small.ids(text), "<u2").tolist() == ids_of(BYTE, text)


@given(st.lists(st.integers(0, 1 << 40), max_size=700))
def test_elias_fano_returns_every_value(values):
    values = np.array(sorted(values), np.uint64)
    made = binary.EliasFano.of(values)
    back, end = binary.EliasFano.read(b"head" + made.to_bytes(), 4)
    assert end == 4 + len(made.to_bytes())
    assert back.values().tolist() == values.tolist()
    assert [back.select(i) for i in range(0, len(values), 7)] == values[::7].tolist()


def test_elias_fano_is_near_minimal():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 24, 20_000)).astype(np.uint64)
    bits = 8 * len(binary.EliasFano.of(values).to_bytes()) / len(values)
    assert bits < 2 + np.log2((1 << 24) / 20_000) + 0.5


def test_block_selects_documents():
    ids = [np.arange(i, dtype="<u2").tobytes() for i in range(1, 40)]
    block = binary.Block(binary.encode_block([None, -5, -5, *range(10, 46)], ids))
    assert block.doc_ids() == [None, -5, -5, *range(10, 46)]
    assert all(block.document(i).tolist() == list(range(i + 1)) for i in range(39))


def expected_files(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    out, at = [], 0
    for doc_id, text in ordered:
        ids = np.array([*ids_of(WORD, text), 1], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("block_ids", [4, 1 << 20])
def test_token_files_round_trip(spark, tmp_path, block_ids):
    df = documents(spark)
    binary.write_token_files(df, f"{tmp_path}/ids", WORD, block_ids=block_ids)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    wanted = expected_files(rows)
    digests = binary.read_token_files(spark, f"{tmp_path}/ids", digest=True)
    assert sorted(map(tuple, digests.collect()), key=lambda r: r[1]) == wanted
    back = binary.read_token_files(spark, f"{tmp_path}/ids").orderBy("start").collect()
    assert [zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in back] == [w[3] for w in wanted]


def test_token_files_of_nothing(spark, tmp_path):
    binary.write_token_files(empty(spark), f"{tmp_path}/ids", WORD)
    assert binary.read_token_files(spark, f"{tmp_path}/ids").count() == 0


def test_documents_are_found_by_id(spark, tmp_path):
    rows = [(None, "none"), *[(5, f"five {i}") for i in range(3)], *[(i, f"text {i} " * (i % 7)) for i in range(10, 300, 3)]]
    df = spark.createDataFrame([*rows, (-(2**62), "least"), (2**62, "last")], "doc_id bigint, text string")
    binary.write_token_files(df, f"{tmp_path}/ids", WORD, block_ids=50)
    wanted = [5, 11, 13, 298, -(2**62), 2**62]
    found = binary.find_documents(spark, f"{tmp_path}/ids", wanted).collect()
    expected = [(d, [*ids_of(WORD, t), 1]) for d, t in map(tuple, df.collect()) if d in wanted]
    assert sorted((r["doc_id"], list(r["ids"])) for r in found) == sorted(expected)
    assert binary.find_documents(spark, f"{tmp_path}/ids", []).count() == 0


def letters(n):
    return "".join(chr(97 + n // 26**k % 26) for k in range(4))


def test_ids_beyond_16_bits(spark, tmp_path):
    made = Tokenizer(models.WordLevel({letters(i): i for i in range(70_000)}, unk_token=letters(0)))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    made.save(f"{tmp_path}/words.json")
    numbers = [[69_999, 1, 65_536], [3], []]
    df = spark.createDataFrame(
        [(i, " ".join(map(letters, ns))) for i, ns in enumerate(numbers)], "doc_id bigint, text string"
    )
    binary.write_token_files(df, f"{tmp_path}/ids", f"{tmp_path}/words.json")
    back = binary.read_token_files(spark, f"{tmp_path}/ids").orderBy("start").collect()
    assert [list(r["ids"]) for r in back] == [[*ns, 1] for ns in numbers]
    pieces = packing.pack(df, f"{tmp_path}/words.json", spaced=False, keep_ids=True).orderBy("doc_id").collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in pieces] == [[*ns, 2] for ns in numbers]


@pytest.mark.parametrize("n, wanted", [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]), (2048, [(0, 1024), (1024, 1024)])])
def test_cut_points(n, wanted):
    assert packing.cut_points(n, 1024) == wanted


@given(st.lists(st.integers(1, 15), max_size=60), st.booleans())
def test_sum_of_squares_follows_its_rule(lengths, any_fit):
    """Each item, longest first, goes where the sum of squared counts becomes smallest."""
    capacity = 16
    bins, offsets = packing.sum_of_squares(np.array(lengths, np.int64), capacity, any_fit)
    gaps: dict[int, int] = {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[i]

        def after(gap, size=size):
            counts = np.bincount(list(gaps.values()), minlength=capacity + 1)
            if gap != capacity:
                counts[gap] -= 1
            counts[gap - size] += gap > size
            return (counts[1:capacity].astype(int) ** 2).sum()

        room = sorted({g for g in gaps.values() if g >= size})
        options = {g: after(g) for g in [*room, *([] if any_fit and room else [capacity])]}
        chosen = gaps.get(int(bins[i]), capacity)
        assert options[chosen] == min(options.values())
        assert offsets[i] == capacity - chosen
        gaps[int(bins[i])] = chosen - size


def check_packed(packed, rows, capacity):
    wanted = []
    for doc_id, text in rows:
        ids = np.array([*ids_of(BYTE, text), 2], "<u4")
        for piece, (start, length) in enumerate(packing.cut_points(len(ids), capacity)):
            wanted.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
    assert sorted((tuple(r)[:5] for r in packed), key=repr) == sorted(wanted, key=repr)
    placed: dict[int, list] = {}
    for r in packed:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in placed.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(placed), sum(w[3] for w in wanted)


@pytest.mark.parametrize("capacity, group_rows", [(1024, 20_000), (16, 3)])
def test_pack_edge_rows(spark, capacity, group_rows):
    df = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    packed = packing.pack(df, BYTE, capacity=capacity, group_rows=group_rows).collect()
    check_packed(packed, rows, capacity)


def test_pack_in_rounds_comes_close_to_the_bound(spark):
    rows = [(i, " ".join(["word"] * (1 + i * 37 % 90))) for i in range(1500)]
    packed = packing.pack(documents(spark, rows), BYTE, capacity=128, group_rows=200).collect()
    bins, tokens = check_packed(packed, rows, 128)
    assert bins <= 1.02 * tokens / 128 + 2


def test_pack_ends_where_nothing_fits_together(spark):
    rows = [(i, " ".join(["word"] * 9)) for i in range(60)]
    packed = packing.pack(documents(spark, rows), BYTE, capacity=16, group_rows=7).collect()
    assert check_packed(packed, rows, 16)[0] == 60


def test_pack_nothing(spark):
    assert packing.pack(empty(spark), BYTE).count() == 0


def test_sequences_hold_the_ids(spark):
    rows = [(1, "a b c"), (2, "d e f g h i j k"), (3, None)]
    packed = packing.pack(documents(spark, rows), BYTE, capacity=8, keep_ids=True)
    got = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        ids = [*ids_of(BYTE, dict(rows)[r["doc_id"]]), 2][r["start"] : r["start"] + r["length"]]
        assert got[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids
