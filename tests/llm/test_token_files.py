"""op5_token_files encodes texts in batches and codes blocks by their ids' counts."""

import contextlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from corpusmill.llm import coder, pieces, tokenfiles

ODD = ["", None, " ", "  a", "a  b\n c", "x<|endoftext|>y z", "a\n", "\n a", "don't 'll  x9 9x　 y  z é \U0001f600 ok", "a ", " b", "\x1c q", "\xa0 \xa0", "a a.a a. .a a b", "w'", "w's w'x w''", "² a². _a_ a_"]


def test_many_texts_are_encoded_as_the_library_does(monkeypatch):
    calls, plain = [], Tokenizer.from_file(path(tokenfiles.TOKENIZER))
    encoder = tokenfiles.Encoder(tokenfiles.TOKENIZER)
    monkeypatch.setattr(encoder, "_matches", lambda m, f=encoder._matches: calls.append(len(m)) or f(m))
    rows = [" ".join(f"un{i}wo{i * j}rd, of" for j in range(50)) for i in range(40)]
    for texts in (ODD, rows, rows[::-1]):
        ids, bounds = encoder.encode_all(pa.array(texts, pa.string()), 2)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
        assert [encoder.encode(t or "") for t in texts] == [ids[a : b - 1].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert len(calls) < 60  # not one for each word


def test_words_not_used_of_late_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokenfiles, "KEPT_BYTES", 4096)
    encoder, plain = tokenfiles.Encoder(tokenfiles.TOKENIZER), Tokenizer.from_file(path(tokenfiles.TOKENIZER))
    for i in range(20):
        text = f"start {'y' * 3000} often " + " ".join(f"w{i}x{j}" for j in range(50))
        ids, _ = encoder.encode_all(pa.array([text]), 2)
        assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]
        assert encoder.words.nbytes + encoder.coded.nbytes <= 4096 + 64 and len(encoder.words) == len(encoder.coded) == len(encoder.used)


def test_matches_without_the_pattern():
    parts = [q for t in ODD for q in pieces.pieces(t or "") if q] + [" a'", " a'b", " a.b", " a1.", " .", " 'll", " é!?", "a.", " a.\n"]
    assert pieces.all_matches(parts) == [pieces.SPLIT.findall(p) for p in parts]


@pytest.mark.parametrize("block", [7, 64, 2048, 4000])
def test_blocks_of_any_length(block):
    rng = np.random.default_rng(block)
    for ids in (rng.zipf(1.3, 9001) % 50_000, rng.integers(0, 1 << 32, 5000), np.zeros(4100), np.arange(4001), np.array([5])):
        image = coder.pack(ids.astype(np.uint32), block)
        assert (coder.unpack(image) == ids).all()
        for at in range(len(image) // 3, len(image), max(1, len(image) // 7)):
            with contextlib.suppress(ValueError):  # a bit that no id depends on may be lost
                assert (coder.unpack(image[:at] + bytes([image[at] ^ 90]) + image[at + 1 :]) == ids).all()


def test_slices_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(tokenfiles, "SLICE_BYTES", 10)
    texts = ["abc", None, "", "defghijklmnop", "q", "rstuvwxyz", "ab", "c", None]
    batches = [pa.record_batch([pa.array(range(a, a + 3)), pa.array(texts[a : a + 3], pa.string())], ["id", "text"]) for a in (0, 3, 6)]
    got = [list(zip(*(c.to_pylist() for c in some), strict=True)) for some in tokenfiles._slices(iter(batches))]
    assert [r for some in got for r in some] == list(enumerate(texts)) and all(len(some) == 1 or sum(len(t or "") for _, t in some) <= 10 for some in got)
    assert len(got) == 4
