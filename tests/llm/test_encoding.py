import os
import random

import pytest

from trackloom.llm import bpe
from trackloom.llm.encoding import count_tokens, decode_ids, encode

PATH = f"{bpe.TOKENIZERS}/{bpe.BYTE_BPE}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")
ALPHABETS = ["ab", "abc", "etaoin shr", "aA '", " \n\t a", "'llves ", "0123 ", "日本語のaé", "€𝄞a", ".-=_ "]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts():
    r = random.Random(8)
    made = ["".join(r.choice(a) for _ in range(n)) for a in ALPHABETS for n in (1, 7, 60, 900, 5000)]
    return [*made, "", "<|endoftext|>", "I'm they'll DON'T", "x" * 30_000, " " * 20_000, "ab" * 20_000 + " end"]


def test_streams_as_the_library_encodes(reference):
    machine = bpe.Transducer(bpe.read_ranks(PATH), window=1, chunk=64)
    assert machine.window == 2 * machine.lookahead
    for text in texts():
        assert list(machine.encode(text)) == reference.encode_ordinary(text)


def test_long_pieces_take_constant_memory(reference, monkeypatch):
    """No more than a window and the lookahead of an open piece is held, whatever its length."""
    held, merge = [0], bpe.merge

    def watched(piece, *rest):
        held[0] = max(held[0], len(piece))
        return merge(piece, *rest)

    machine = bpe.Transducer(bpe.read_ranks(PATH), chunk=4096)
    monkeypatch.setattr(bpe, "merge", watched)
    r = random.Random(6)
    block = "".join(r.choice("etaoinshr") for _ in range(50_000))
    long = {f"I {block * 20}'s": 1_000_000, " " * 300_000 + "x": 300_000, "\n" * 70_000 + " x": 70_000, "a" + " \n" * 40_000: 80_000, "-" * 100_000: 100_000, "é7" + "7" * 90_000 + "b": 90_000}
    for text in long:
        assert list(machine.encode(text)) == reference.encode_ordinary(text)
        assert machine.count(text) == len(reference.encode_ordinary(text))
    huge = block * 200  # 10 MB in one piece
    assert abs(machine.count(huge) - 200 * machine.count(block)) < 2_000
    assert held[0] <= 2 * machine.window


def test_a_piece_in_parts(reference):
    machine = bpe.Transducer(bpe.read_ranks(PATH), window=1)
    r = random.Random(2)
    for _ in range(20):
        piece = "".join(r.choice("abcdefgh") for _ in range(3000)).encode()
        cuts = sorted(r.sample(range(len(piece)), 9))
        parts = [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)], strict=True)]
        assert list(machine.stream(parts)) == reference.encode_ordinary(piece.decode())


def test_round_trip_and_defined_results(rows, reference):
    data = [(i, t, "x") for i, t in enumerate([*texts(), None])]
    df = rows("doc_id long, text string, ids string", data + data[:3])
    ids = {r["doc_id"]: r["ids"] for r in encode(df).collect()}
    assert encode(df).count() == len(data) + 3
    assert all(ids[i] == (reference.encode_ordinary(t) if t else []) for i, t, _ in data)
    back = {r["doc_id"]: r["text"] for r in decode_ids(encode(df)).collect()}
    assert all(back[i] == (t or "") for i, t, _ in data)
    sizes = {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, ["doc_id"]).collect()}
    assert all(sizes[i] == len(ids[i]) for i, _, _ in data)
    assert encode(df.limit(0)).count() == 0


def test_decoding_cut_bytes():
    tokens = {0: b"a", 1: b"\xe2\x82", 2: b"\xac"}
    assert "".join(bpe.decode([0, 1, 2, 1], tokens)) == "a€�"
