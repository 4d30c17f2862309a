from trackloom.operators.packed import separator_scores, unpack

SCHEMA = "annotation_id string, source string, tags string, pos string, tag string"
PLAIN = ["slow", "fast", "lamp on", "edge", "don't use", "rig 2's lamp", "p<0.6", "re-check"]


def run(rows, fields):
    known = [(f"k{i}", "A", t, "", "") for i, t in enumerate(PLAIN * 2)]
    data = [(f"t{i}", "A", t, "", "") for i, t in enumerate(fields)]
    found = unpack(rows(SCHEMA, known + data + data)).collect()
    out = {}
    for r in sorted(found, key=lambda r: r["pos"]):
        out.setdefault(r["annotation_id"], []).append(r["tag"])
    return [out.get(f"t{i}", []) for i in range(len(fields))]


def test_separators_quotes_lists_and_blanks(rows):
    cases = {
        "slow;fast": ["slow", "fast"],
        " slow | lamp on ": ["slow", "lamp on"],
        "slow,fast;edge": ["slow", "fast", "edge"],
        "slow / fast/edge": ["slow", "fast", "edge"],
        "slow + fast": ["slow", "fast"],
        "slow\tfast\r\nedge": ["slow", "fast", "edge"],
        "slow；fast、edge": ["slow", "fast", "edge"],
        ";slow;;fast; ": ["slow", "fast"],
        "slow;slow": ["slow", "slow"],
        '"start, cut";fast': ["start, cut", "fast"],
        "'start; cut', fast": ["start; cut", "fast"],
        'slow; "the ""long"" one" ;fast': ["slow", 'the "long" one', "fast"],
        "don't use;rig 2's lamp": ["don't use", "rig 2's lamp"],
        '["slow", "start, cut"]': ["slow", "start, cut"],
        '"unclosed;fast': ['"unclosed', "fast"],
        "P<0.6;Fast": ["P<0.6", "Fast"],
        '""': [],
        ";": [],
        "": [],
        "  \t": [],
    }
    assert run(rows, list(cases)) == list(cases.values())


def test_a_sign_inside_values_scores_low(rows):
    data = [("A", f"left/right{i % 3}") for i in range(30)] + [("A", "slow;fast"), ("A", "slow"), ("A", "fast")] * 20
    scores = {r["sign"]: r["score"] for r in separator_scores(rows("src string, packed string", data)).collect()}
    assert scores[";"] > 0.6 > scores.get("/", 0)


def test_types_of_pieces_count(rows):
    """Values that stand nowhere else: those of the usual type are regular by half, those of another type aren't."""
    plain = [("A", t) for t in ("slow", "fast", "edge", "lamp on")] * 10
    usual = [("A", f"{'abcdefgh'[i]}x;{'abcdefgh'[i]}y") for i in range(8)]
    odd = [("A", f"{i}{i}/{i}-{i}") for i in range(8)]
    scores = {r["sign"]: r["regularity"] for r in separator_scores(rows("src string, packed string", plain + usual + odd), prior=0.001).collect()}
    assert abs(scores[";"] - 0.5) < 0.01 and scores["/"] < 0.01


def test_null_keys_sources_and_empty(rows, got):
    data = [(None, None, "slow;fast", "", ""), ("a", None, None, "", "")]
    assert got(unpack(rows(SCHEMA, data))) == [(None, 1, "slow"), (None, 2, "fast")]
    assert unpack(rows(SCHEMA, [])).count() == 0


def test_very_long_field(rows):
    assert unpack(rows(SCHEMA, [("a", "A", ";".join(["slow"] * 20_000), "", "")])).count() == 20_000
