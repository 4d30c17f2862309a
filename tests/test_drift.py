import json

from trackloom.operators.drift import KNOWN_ALIASES, changes, ingest, promote, propose_aliases

SCHEMA = "file_id long, series string, file_no int, line_no int, record string, source string"


def lines(*files):
    out = []
    for n, records in enumerate(files, 1):
        out += [(n * 10, "S", n, k, r if isinstance(r, str) or r is None else json.dumps(r), "x") for k, r in enumerate(records, 1)]
    return out


def test_changes(rows, got):
    data = lines(
        [{"source": "GA1", "T0": 1.5, "ID": 1}, {"source": "GA1", "T0": 2, "ID": 1}],
        [{"Source": "GA1", "t0_sec": "1,5", "rig": None}, '{"Source": "GA1", "conf'],
        [{"Source": "GA1", "t0_sec": "2", "rig": "R1"}],
        [{"Source": 3, "t0_sec": "2", "rig": 1, "ID": 2}, None],
    )
    expected = [(20, "ID", "removed"), (20, "rig", "added"), (20, "source", "renamed"), (20, "t0", "renamed"), (20, "t0", "retyped"), (40, "ID", "added"), (40, "rig", "retyped"), (40, "source", "retyped")]
    assert got(changes(rows(SCHEMA, data + data))) == sorted(expected)


def rescued(row):
    return {(e.get("field"), e["reason"]): e.get("text") for e in json.loads(row["rescued"] or "[]")}


def test_ingest_rescues_and_promote_replays(rows):
    data = lines([{"File": "GA1", "onset": "1:02.5", "t1": "63,25", "larva": "7", "Beh": 3, "tag_list": ["a;b", "c"], "confidence": 0.5, "AN": "none", "rig": None}])
    made = ingest(rows(SCHEMA, data + data))
    r = made.first()
    assert made.count() == 1
    assert (r["source"], r["t0"], r["t1"], r["ID"], r["Behavior"], r["tags"], r["AN"]) == ("GA1", 62.5, 63.25, 7, "3", '"a;b";c', None)
    assert rescued(r) == {("confidence", "unknown"): "0.5", ("AN", "uncastable"): "none", ("rig", "unknown"): None}
    assert ("t0", "onset", "string") in [tuple(w) for w in r["written"]]
    p = promote(made, {"confidence": "double", "rig": "string"}).first()
    assert p["confidence"] == 0.5 and p["rig"] is None and set(rescued(p)) == {("AN", "uncastable")}
    assert {w["field"] for w in p["written"]} >= {"confidence", "rig"}
    q = promote(made, {"AN": "string", "missing": "long"}).first()
    assert q["AN"] == "none" and q["missing"] is None and set(rescued(q)) == {("confidence", "unknown"), ("rig", "unknown")}


def test_every_line_is_kept(rows):
    """Rows in are rows out; what can't be read or placed is rescued with a reason."""
    whole = ['{"ID":1,"conf', "[1, 2]", "3", None, "", '{"ID":1}{"ID":2}', '{"ID":1},{"ID":2}', '{"n":{"b":1,"b":2}}', "{'ID':1}"]
    data = lines(whole + ['{"ID":1,"ID":2,"id":"3"}', "{}", ' {"t0": 1} '])
    made = {r["line_no"]: r for r in ingest(rows(SCHEMA, data)).collect()}
    assert len(made) == len(data)
    for n, text in enumerate(whole, 1):
        assert rescued(made[n]) == {(None, "unreadable"): text}
    last = len(whole)
    assert made[last + 1]["ID"] == 1 and [(e["key"], e["text"], e["reason"]) for e in json.loads(made[last + 1]["rescued"])] == [("ID", "2", "repeated"), ("id", "3", "repeated")]
    assert made[last + 2]["rescued"] is None and made[last + 3]["t0"] == 1.0
    # both spellings of a repeated column are present in the file
    assert got_changes(rows, [['{"ID":1,"id":2}'], ['{"ID":1}']]) == [(20, "ID", "renamed")]


def got_changes(rows, files):
    return sorted(tuple(r) for r in changes(rows(SCHEMA, lines(*files))).collect())


def test_proposed_aliases(rows):
    known = [{"source": "GA1", "ID": k, "t0": k * 10.5, "t1": k * 10.5 + 3} for k in range(1, 30)]
    other = [{"source": "GA1", "larva": str(k), "onset": k * 10.5, "t1": k * 10.5 + 3, "mood": "x"} for k in range(1, 30)]
    made = ingest(rows(SCHEMA, lines(known, other)), KNOWN_ALIASES)
    assert {(r["field"], r["column"]) for r in propose_aliases(made).collect()} == {("larva", "ID"), ("onset", "t0")}


def test_empty(rows):
    assert changes(rows(SCHEMA, [])).count() == 0 and ingest(rows(SCHEMA, [])).count() == 0
