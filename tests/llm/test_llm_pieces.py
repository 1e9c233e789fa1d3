"""Piece encoding against the library and against merging as it is defined."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sgspark.llm import pieces, queries
from test_llm_operators import frame

PATH = queries.piece_model()


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.vocabulary(PATH))


def expected(model, text):
    return model.model.encode(text or "", add_eos=True)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("  eetaoinshr▁.\n\x00é日🦙1A執")), max_size=60) | st.text(max_size=40))
def test_any_text(text):
    model = pieces.loaded(pieces.vocabulary(PATH))
    assert model.encoded(text).tolist() == expected(model, text)


def test_runs_of_marks_and_long_texts(model):
    for k in range(100):
        for text in (" " * k, " " * k + "the", "a" + " " * k + "b", "▁" * k):
            assert model.encoded(text).tolist() == expected(model, text)
    rng = random.Random(4)
    for text in ("ab" * 20000, "a" * 50001, " " * 50001, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))):
        assert model.encoded(text).tolist() == expected(model, text)


def test_random_pieces(model):
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice(model.text[259:]) for _ in range(rng.randrange(10)))
        assert model.encoded(text).tolist() == expected(model, text)


def test_walks_equal_merging(model):
    """The walk against merging itself, without cuts, remembered ids or the library."""
    rng = random.Random(6)
    for _ in range(1500):
        text = "".join(rng.choice("▁▁theriansoug") for _ in range(rng.randrange(1, 24)))
        assert [model.text[i] for i in model.walked(text)] == model.merged(text)


def test_forgetting_changes_nothing(model, monkeypatch):
    monkeypatch.setattr(pieces, "CUTS", 3)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    fresh = pieces.Pieces(pieces.vocabulary(PATH))
    text = "the rain in Spain stays mainly in the plain, the rain. " * 20
    assert fresh.encoded(text).tolist() == expected(model, text)


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(pieces.vocabulary(PATH))
    proto.trainer_spec.model_type = 1
    with pytest.raises(ValueError, match="merge-type"):
        pieces.Pieces(proto.SerializeToString())


def test_a_model_without_bytes():
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(pieces.vocabulary(PATH))
    proto.trainer_spec.byte_fallback = False
    for p in proto.pieces:
        if p.type == 6:
            p.type = 1
            p.score = -2e9
    plain = pieces.Pieces(proto.SerializeToString())
    for text in ("a 🦙🦙 b", "🦙", "x🦙🦙\x00\x00y"):
        assert plain.encoded(text).tolist() == expected(plain, text)


def test_marks_inside_pieces():
    """Where merges cross spaces, only characters outside the vocabulary cut a text."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(pieces.vocabulary(PATH))
    for k, (piece, score) in enumerate([("e▁t", -2.5), ("▁a▁", -3.5), ("n▁", -1.5)]):
        proto.pieces[31990 + k].piece, proto.pieces[31990 + k].score = piece, score
    crossing = pieces.Pieces(proto.SerializeToString())
    for text in ("the tea on a tin", "one 🦙 a nine ten", "  a  n n  e t", "n" * 40 + " t"):
        assert crossing.encoded(text).tolist() == expected(crossing, text)


def test_op11_rows(spark, model, tmp_path):
    rows = [(1, None), (2, ""), (3, "Hello  world\n\n🦙 naïve"), (3, "Hello  world\n\n🦙 naïve"), (None, " x"), (5, "word " * 60000)]
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in queries.op11_sentencepiece(spark, str(tmp_path)).collect()), key=str)
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text in rows:
        ids = expected(model, text)
        want.append((i, len(ids), hexed(" ".join(map(str, ids))), hexed(model.model.decode(ids))))
    assert got == sorted(want, key=str)
    clash = pieces.decoded(pieces.encoded(docs.withColumnRenamed("uid", "ids").withColumnRenamed("_key", "decoded"), PATH), PATH)
    assert clash.columns.count("ids") == clash.columns.count("decoded") == 1
    assert [r["decoded"] for r in clash.where("doc_id = 3").collect()] == [rows[2][1]] * 2
    assert pieces.encoded(docs.limit(0), PATH).count() == 0


def test_op11_equals_the_library(spark, sf_dir, model):
    docs = queries.table(spark, sf_dir, "documents").select("doc_id", "text")
    got = {r["doc_id"]: r["ids"] for r in pieces.encoded(docs, PATH).collect()}
    assert all(got[r["doc_id"]] == expected(model, r["text"]) for r in docs.collect())
