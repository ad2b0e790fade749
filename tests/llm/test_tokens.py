"""Token files and packing: against the tokenizers library, and invariants."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratagraph.llm import packing, token_files
from stratagraph.llm.queries import FILE_TOKENS, PACKING_TOKENS, _tokenizer
from stratagraph.llm.tokenize import encoder


@pytest.fixture(scope="module", params=[PACKING_TOKENS, FILE_TOKENS], ids=["word", "byte"])
def both(request):
    path, space, _ = _tokenizer(request.param)
    return encoder(path, space), Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text("aB1' .\n\téİß\x1c\x85  <|>s", max_size=40)))
def test_encoder_gives_the_ids_of_the_library(both, text):
    enc, lib = both
    assert enc.known
    assert np.frombuffer(enc.encode(text), enc.kind).tolist() == lib.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("aB1' .\n\t\x85é<|>", max_size=40)), max_size=6), together=st.integers(1, 30))
def test_texts_encoded_together_have_their_own_ids(both, texts, together):
    enc, _ = both
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("stratagraph.llm.tokenize.TOGETHER", together)
        assert enc.encode_all(texts) == [enc.encode(t) for t in texts]


def test_added_tokens_and_small_caches(both, monkeypatch):
    enc, lib = both
    monkeypatch.setattr("stratagraph.llm.tokenize.KEPT_BYTES", 500)
    for t in ("a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<|ENDOFTEXT|> c", *(f"word{k} others and word{k % 3}" for k in range(40))):
        assert np.frombuffer(enc.encode(t), enc.kind).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_encoder_on_whole_table(both, texts):
    enc, lib = both
    for _, t in texts:
        assert np.frombuffer(enc.encode(t), enc.kind).tolist() == lib.encode(t or "", add_special_tokens=False).ids


def library_ids(name, texts, end):
    lib = Tokenizer.from_file(public_tokenizers.path(name))
    return {i: [*lib.encode(t or "", add_special_tokens=False).ids, end] for i, t in texts}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files_of_whole_table(spark, documents, texts, tmp_path):
    token_files.write_tokens(documents, str(tmp_path / "t"), *_tokenizer(FILE_TOKENS))
    got = {r["doc_id"]: tuple(r)[1:4] for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect()}
    start = 0
    for i, ids in sorted(library_ids(FILE_TOKENS[0], texts, FILE_TOKENS[2]).items()):
        assert got[i] == (start, len(ids), crc(ids))
        start += len(ids)


def test_file_edges(spark, make, edges, tmp_path):
    token_files.write_tokens(make(edges), str(tmp_path / "t"), *_tokenizer(FILE_TOKENS))
    rows = sorted(token_files.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert len(rows) == len(edges) and [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()
    assert [r["doc_id"] for r in rows if r["doc_id"]] == sorted(i for i, _ in edges if i)
    token_files.write_tokens(make([]), str(tmp_path / "e"), *_tokenizer(FILE_TOKENS))
    assert token_files.read_tokens(spark, str(tmp_path / "e")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1300), st.data())
def test_images_give_back_any_range(ids, data):
    image = token_files.Image(token_files.encode_image([1], [len(ids)], np.array(ids, np.uint32)))
    assert image.ids().tolist() == ids
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert image.ids(a, b).tolist() == ids[a:b]


def check_pieces(rows, want):
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        pieces[r["row_key"]].append((r["start"], ids, r["doc_id"], r["doc_tokens"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    whole = []
    for p in pieces.values():
        ids = [x for _, part, _, _ in sorted(p) for x in part]
        at = np.cumsum([0, *[len(x[1]) for x in sorted(p)]])
        assert [x[0] for x in sorted(p)] == at[:-1].tolist() and p[0][3] == len(ids)
        whole.append((p[0][2], ids))
    assert sorted(map(repr, whole)) == sorted(map(repr, want))
    for p in places.values():
        at = np.cumsum([0, *[n for _, n in sorted(p)]])
        assert [o for o, _ in sorted(p)] == at[:-1].tolist()
        assert at[-1] <= packing.WINDOW and at[-1] & (at[-1] - 1) == 0


def test_packing_of_whole_table(documents, texts):
    want = list(library_ids(PACKING_TOKENS[0], texts, PACKING_TOKENS[2]).items())
    check_pieces(packing.pack(documents, *_tokenizer(PACKING_TOKENS)).collect(), want)


def test_packing_edges(make, edges):
    lib = Tokenizer.from_file(public_tokenizers.path(PACKING_TOKENS[0]))
    want = [(i, [*lib.encode(t or "", add_special_tokens=False).ids, PACKING_TOKENS[2]]) for i, t in edges]
    check_pieces(packing.pack(make(edges), *_tokenizer(PACKING_TOKENS)).collect(), want)
    assert packing.pack(make([]), *_tokenizer(PACKING_TOKENS)).collect() == []


def test_a_seed_is_followed_by_what_is_most_like_it():
    rng = np.random.default_rng(6)
    docs = [np.unique(rng.integers(100 * t, 100 * t + 100, 60)) for t in range(4) for _ in range(5)]
    df = np.bincount(np.concatenate(docs), minlength=400)
    index = packing.Shard(docs, np.log1p((20 - df + 0.5) / (df + 0.5)), 50.0)
    near = [k for k in index.neighbours(7, np.ones(20, bool)) if k != 7]
    assert set(near) <= {5, 6, 8, 9} and near


def test_a_seed_is_scored_by_all_its_terms():
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 300, rng.integers(0, 200)) for _ in range(30)]
    # The rarest ids of the seed are its own; the others share common ones alone.
    docs[3] = np.concatenate([np.arange(400, 440), np.arange(300)])
    df = np.bincount(np.concatenate([np.unique(x) for x in docs]), minlength=440)
    idf = np.log1p((30 - df + 0.5) / (df + 0.5))
    want = {}
    for k, x in enumerate(docs):
        u, tf = np.unique(x, return_counts=True)
        w = idf[u] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / 90.0))
        if s := sum(v for t, v in zip(u, w, strict=True) if t in set(docs[3])):
            want[k] = s
    got = packing.Shard(docs, idf, 90.0).neighbours(3, np.ones(30, bool)).tolist()
    assert sorted(got) == sorted(want)
    assert np.allclose([want[k] for k in got], sorted(want.values(), reverse=True))
