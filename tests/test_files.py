import json

from palimpsest.sources import files


def test_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\n\ncafé".encode("latin-1"))
    (tmp_path / "b.txt").write_bytes("two é".encode())
    (tmp_path / "c.txt").write_bytes(b"x\0y")
    got = {(r.doc_id.rsplit("/", 1)[1], r.seq, r.text) for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got == {("a.txt", 0, "one"), ("a.txt", 2, "café"), ("b.txt", 0, "two é")}


def test_annotated(spark, tmp_path):
    doc = {"document_id": "d", "blocks": [{"block_id": "b", "page": 1, "text": "t"}], "ground_truth_entities": [{"type": "SSN", "page": 1, "text_start": 0, "text_end": 1}]}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    blocks, truth = files.read_annotated(spark, str(tmp_path))
    assert [(r.doc_id, r.block_id, r.text) for r in blocks.collect()] == [("d", "b", "t")]
    assert [(r.doc_id, r.entity_type, r.text_end) for r in truth.collect()] == [("d", "SSN", 1)]
