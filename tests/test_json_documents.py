"""Answers of recognisers and parsed documents as JSON: layouts, defaults, clamps, and what is no JSON."""

import json

import pytest

from ledgerloom.operators import documents


def test_recognised_layouts(spark):
    words = lambda *c: {"blocks": [{"paragraphs": [{"words": [{"confidence": x} if x is not None else {} for x in c]}]}]}
    given = {
        1: {"responses": [{"fullTextAnnotation": {"text": "a b", "pages": [words(0.5, 1.0), {"confidence": 0.9}]}}, {"fullTextAnnotation": {"text": "c", "pages": [words(None)]}}]},
        2: {"pages": [{"text": "x" * 50}, {"text": ""}]}, 3: {"responses": [], "pages": [{"text": "t", "confidence": 0.25}]}, 4: {"pages": []}, 5: {"pages": [{"text": " ", "confidence": 1.0}]},
    }
    docs = spark.createDataFrame([(k, json.dumps(v)) for k, v in given.items()] + [(6, "no json"), (7, None)], "k int, j string")
    got = {r.k: (r.page_count, r.full_text, r.confidence, r.issues) for r in documents.recognised(docs, "k", "j").collect()}
    assert got[1] == (2, "a b\nc", pytest.approx(0.6), []) and got[2] == (2, "x" * 50, 0.1, []) and got[3] == (1, "t", 0.25, [])
    assert got[4] == got[6] == got[7] == (0, "", 0.0, ["VISION_LOW_CONFIDENCE", "SCANNED_PAGE_DETECTED"]) and got[5] == (1, " ", 1.0, ["SCANNED_PAGE_DETECTED"])


def test_parsed_documents(spark):
    given = {
        1: {"pages": [{"page_number": 7, "spans": [{"text": "a", "confidence": 2, "bbox": [1, 2, 3, 4]}, {"text": "", "confidence": 1}, {"text": "b", "bbox": [1]}], "tables": [{"rows": [["x", None], ["", "y"]]}, {"rows": []}]}, {"spans": [{"text": "z" * 3000, "confidence": -1}]}]},
        2: {"pages": [{"page_number": 0, "spans": [], "tables": [{"rows": [[str(i)] for i in range(50)]}]}]}, 3: {"pages": "none"},
    }
    docs = spark.createDataFrame([(k, json.dumps(v)) for k, v in given.items()] + [(4, "{broken"), (5, None)], "k int, j string")
    got = {r.k: r for r in documents.parsed_json(docs, "k", "j").collect()}
    assert [(s.page, s.text[:3], s.bbox, s.confidence) for s in got[1].spans] == [(7, "a", [1.0, 2.0, 3.0, 4.0], 1.0), (7, "b", None, 0.5), (2, "zzz", None, 0.0)] and len(got[1].spans[2].text) == 2000
    assert [(t.page, t.confidence) for t in got[1].tables] == [(7, 0.5)] and got[1].confidence == 0.0 and got[1].issues == []
    assert (len(got[2].tables[0].rows), got[2].tables[0].page, got[2].confidence, got[2].issues) == (40, 1, 0.0, ["SCANNED_PAGE_DETECTED"])
    assert got[3].page_count == 0 and got[4].issues == got[5].issues == ["PDF_JSON_PARSE_FAILED"]
