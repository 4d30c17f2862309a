import pytest

from trackloom.functions.text import BEHAVIORS
from trackloom.llm.canonical import distance, map_values

LABELS = ["dwelling", "nondwelling", "crawling", "turning", "other", "dwelling_old", "head casting", "stopping", "sideways drift", "digging"]
SHORT = ["DW", "ND", "CR", "TU", "OT", "DWO", "HC", "ST", "SD", "DG"]


def run(rows, typed):
    reference = rows("code int, label string, short_form string", [(i, a, b) for i, (a, b) in enumerate(zip(LABELS, SHORT, strict=True))])
    data = rows("annotation_id string, Behavior string, label string", [(str(i), t, "x") for i, t in enumerate(typed)] * 2)
    out = {}
    for r in map_values(data, reference, synonyms=BEHAVIORS).collect():
        assert int(r["annotation_id"]) not in out
        out[int(r["annotation_id"])] = r["label"]
    return out


def test_mapping(rows):
    cases = {
        "dwelling": None, None: None, "  ": None, "": None, " dwelling": "dwelling", "DWELLING": "dwelling", "dwekling??": "dwelling", "dw": "dwelling", "ND.": "nondwelling", "not dwelling": "nondwelling", "non-dwelling?": "nondwelling",
        "nonwdelling": "nondwelling", "crawls": "crawling", "run": "crawling", "old dwelling": "dwelling_old", "dwelling (old)": "dwelling_old", "Dewllin_gold": "dwelling_old", "headcast": "head casting", "casting head": "head casting",
        "hedac asting": "head casting", "headecasting": "head casting", "stopped": "stopping", "stops": "stopping", "digs": "digging", "drift sideways": "sideways drift", "otehr": "other", "moulting": "unmatched", "lamp flicker": "unmatched",
        "??": "unmatched", "x": "unmatched", "touching": "unmatched", "two animals touching": "unmatched",
    }
    found = run(rows, list(cases))
    assert found == {i: v for i, v in enumerate(cases.values()) if v is not None}


def test_very_long_value_and_empty_tables(rows):
    assert run(rows, ["dwelling " * 20_000, "y" * 200_000]) == {0: "dwelling", 1: "unmatched"}
    empty = rows("code int, label string, short_form string", [])
    data = rows("annotation_id string, Behavior string", [("a", "dwel")])
    assert [tuple(r) for r in map_values(data, empty).collect()] == [("a", "unmatched")]
    assert map_values(data.limit(0), empty).count() == 0


@pytest.mark.parametrize(("a", "b", "d"), [("", "abc", 3), ("abcd", "abdc", 1), ("turning", "turming", 0.9), ("turning", "turxing", 1), ("abc", "abc", 0)])
def test_distance(a, b, d):
    assert distance(a, b) == pytest.approx(d)
