"""Cases of the first round's review, each against brute force."""

import numpy as np
import pytest

from corpusmill.llm import bpe, coder, langid, pieces, simhash, tokenfiles


@pytest.mark.parametrize("lead", ['"', "12 ", "\n", "¿", "# ", "(["])
def test_language_reads_past_a_leading_non_letter(lead):
    for text in ("the house is on the hill with a zebra", "qué es lo que los niños hacen según ellos", "a"):
        assert langid.codes_of(lead + text).tolist() == langid.codes_of(text).tolist()
        assert (langid.text_vector(lead + text) == langid.text_vector(text)).all()
        assert np.count_nonzero(langid.codes_of(lead + text)) == sum(x.isalpha() for x in text)
    assert langid.text_vector(lead) is None


def test_one_row_of_each_component_stays(spark):
    """Null and shared ids: what stays is the least row of each component by brute force, not one row of each id."""
    texts = [" ".join(f"{c}{i}" for i in range(80)) for c in "abcdef"]
    near = texts[0] + " a79"
    rows = [(None, texts[1], "x"), (None, texts[2], "x"), (None, texts[2], "w"), (7, texts[3], "x"), (7, texts[4], "x"), (5, texts[0], "y"), (7, near, "x"), (None, texts[0], "x"), (9, texts[5], "z"), (9, texts[5], "b"), (9, None, "x"), (10, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    prints = [simhash.fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash.MAX_BITS:
                root = [root[j] if x == root[i] else x for x in root]
    assert root[6] == root[5] == root[7] and len(set(root)) == 7
    want = [min((r for r, x in zip(rows, root, strict=True) if x == k), key=lambda r: (r[0] is None, r[0] or 0, r[2])) for k in set(root)]
    assert sorted(map(str, (tuple(r) for r in simhash.keep_one(docs, words=3, scheme=simhash.BY_BITS).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("text", ["end <|endoftext|> next", "<|endoftext|>", " x\n\n  y\u00a0 z <|endoftext|>\n", "<|endoftext|><|endoftext|> a", "no literal <|endoftex|> here"])
def test_special_tokens_are_those_of_the_library(text):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path(tokenfiles.TOKENIZER)).encode(text, add_special_tokens=False).ids
    assert tokenfiles.encode_text(text).tolist() == plain
    if text == "end <|endoftext|> next":
        assert plain == [437, 220, 50256, 1306]


def test_many_different_ids_in_an_image():
    rng = np.random.default_rng(3)
    for n, most in ((200_000, 150_000), (70_000, 1 << 32)):
        ids = rng.integers(0, most, n).astype(np.uint32)
        assert len(np.unique(ids)) > 65_534 and (coder.unpack(coder.pack(ids)) == ids).all()


def test_compatible_neighbours_are_those_that_merging_leaves():
    c, rng = bpe.codec(bpe.RANKS), np.random.default_rng(8)
    for a, b in rng.integers(0, len(c.tokens), (20_000, 2)).tolist():
        assert c.fits(a, b) == (c.merged(c.tokens[a] + c.tokens[b]) == [c.tokens[a], c.tokens[b]])


def test_memo_is_bounded_and_forgets_nothing_wrong():
    memo, made = pieces.Memo(5000), []
    make = lambda parts: made.extend(parts) or [p.encode() for p in parts]
    for k in range(300):
        parts = [f"p{i}" for i in range(k, k + 20)] + ["x" * 500]
        assert memo.encode(parts, make) == "".join(parts).encode()
    assert memo.size <= 5000 and len(memo.young) + len(memo.old) < 70


def test_profiles_do_not_depend_on_what_the_store_holds(monkeypatch):
    """Bundles by brute force, with a store that starts anew all the time."""
    monkeypatch.setattr(langid, "KEPT", 40)
    monkeypatch.setattr(langid, "CHUNK", 16)
    langid.gram_store.cache_clear()
    letters = langid.letter_vectors().astype(np.int64)
    for text in ("the house is on the hill with a zebra", "Qué es lo que los niños hacen 12 según ellos", "aaaaaaaa", "日本語 text"):
        c = langid.codes_of(text).astype(int)
        want = sum(letters[2, c[i]] * letters[1, c[i + 1]] * letters[0, c[i + 2]] for i in range(len(c) - 2))
        for _ in range(2):
            assert (langid.text_vector(text) == want).all()
    langid.gram_store.cache_clear()
