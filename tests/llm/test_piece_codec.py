import hashlib

import pytest
import sentencepiece

from litsearch.llm.piece_codec import PieceCodec, encode, model_path

TEXTS = ["", " ", "a", "  two  spaces ", "tab\tand\nline\r\n end", "▁mark ▁▁x", "日本語テキスト 😀 é",
         "<s> </s> <unk> <0x0A>", "x" * 5000, "naïve café " * 300, "\x00nul \x7f"]


def test_same_ids_and_text_as_the_library():
    codec = PieceCodec(model_path())
    for t in TEXTS:
        normal, source = codec.normalize(t)
        (units,) = codec.segment([normal.decode()])
        ids = codec.ids_of(units)
        assert ids == codec.whole.encode(t)
        assert codec.decode(ids) == codec.whole.decode(codec.whole.encode(t))
        ends = codec.ends(units, source)
        assert not len(ends) or ends[-1] == len(t.encode())
        assert all(a <= b for a, b in zip(ends, ends[1:]))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_character_map_agrees_with_the_library(tmp_path, rule, squeeze):
    from sentencepiece import sentencepiece_model_pb2 as pb
    model = pb.ModelProto()
    model.ParseFromString(open(model_path(), "rb").read())
    norm = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = pb.NormalizerSpec()
    proto = pb.ModelProto()
    proto.ParseFromString(norm.serialized_model_proto())
    spec = proto.normalizer_spec
    model.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    path = tmp_path / "m.model"
    path.write_bytes(model.SerializeToString())
    codec = PieceCodec(str(path))
    assert codec.map.units
    for t in TEXTS + ["ＡＢＣ　ｶﾞ ﬁn ① ½", "Ångstrom    x　"]:
        normal, source = codec.normalize(t)
        assert codec.ids_of(next(codec.segment([normal.decode()]))) == codec.whole.encode(t), t
        assert len(source) == len(normal) + 1


def test_frame_has_every_row_and_spans(spark):
    rows = [(1, "Hello wörld"), (1, "Hello wörld"), (None, None), (2, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    out = encode(docs).collect()
    assert len(out) == 4
    for r in out:
        if r.ids:
            data = "Hello wörld".encode()
            assert b"".join(data[b:e] for b, e in zip(r.begins, r.ends)) == data
            assert r.decoded == "Hello wörld"
    digest = encode(docs, digest=True).where("n_tokens = 0").collect()
    assert {r.ids_sha256 for r in digest} == {hashlib.sha256(b"").hexdigest()}
    assert encode(docs.limit(0)).count() == 0
