import random

from trackloom.llm.personal import addresses, candidates, emails, entities, find, numbers, rates, sanitise

SCHEMA = "doc_id long, text string, kind string"


def cut(text, spans):
    return [text[a:b] for *_, a, b in spans]


def test_emails():
    found = {
        "write to a.b+c@x-y.example now": "a.b+c@x-y.example",
        "a_b @ blog.x.test.": "a_b @ blog.x.test",
        "A [at] x.test": "A [at] x.test",
        "a(at)m.x(dot)invalid, b": "a(at)m.x(dot)invalid",
        "reach a at shop.x dot test. Then": "a at shop.x dot test",
        "A＠B.EXAMPLE": "A＠B.EXAMPLE",
    }
    for text, expected in found.items():
        assert cut(text, emails(text)) == [expected]
    for text in ("3 for 2 @ 7.50.", "Follow @name for updates", "look at the dot on it", "@", "a@b"):
        assert not list(emails(text))


def test_numbers():
    phones = ["+33 1 99 00 94 86", "+15055550102", "01 99 00 75 30", "01.99.00.75.30", "0044 1632 960 703", "01632 960179", "030 / 23125 544", "+49 (0)30 23125-947", "(688) 555-0153", "512.555.0172", "451-555-0153", "020 7946 0072", "+1 252-555-0197"]
    for p in phones:
        assert list(numbers(f"call {p}, now")) == [("phone", 5, 5 + len(p))], p
    for p in ["988-00-4756", "938 08 7673", "540040-1684", "QY0785323", "53672234I", "64.681.112/W", "ZZ 76 5582 0332"]:
        assert list(numbers(f"no. {p}.")) == [("id_number", 4, 4 + len(p))], p
    for t in ["Node 192.0.2.66", "Catalogue 978-0-00-383256-7", "Frames 542031-421236", "Item 0380/96, 3", "Checksum 311629977828", "2325-71", "Draw of 17.4.2023: 1 55 36", "0000000000000000000"]:
        assert not list(numbers(t)), t


def test_addresses():
    found = {
        "at Flat 27, 203 Old Lane, Ovar Bay 80334; x": "Flat 27, 203 Old Lane, Ovar Bay 80334",
        "at 5b Elm St., Avel, KQ6 8BE, before": "5b Elm St., Avel, KQ6 8BE",
        "au 10 chemin Ravu, 83930 Emar Bay.": "10 chemin Ravu, 83930 Emar Bay",
        "an Ostweg 32, 59718 Umber.": "Ostweg 32, 59718 Umber",
        "in der Torstraße 65b.": "Torstraße 65b",
        "en Calle Dul n.º 8, 44086 Ask.": "Calle Dul n.º 8, 44086 Ask",
        "en C/ Dul 20. Y": "C/ Dul 20",
    }
    for text, expected in found.items():
        assert cut(text, addresses(text)) == [expected], text
    assert not list(addresses("The market on Korury Street is closed."))


def corpus(rows):
    lines = [f"{g} {s}, 01632 96{k:04d}, x{k}@y.test" for k, (g, s) in enumerate([(g, s) for g in ("Petra", "Søren", "Wanda") for s in ("Vellick", "Torham", "Holey-Marow")] * 3)]
    lines += [f"The Avel Institute met at Ovar Bay. Most people saw Ovar Bay and Old Mill. Number {k}." for k in range(30)]
    last = "Dr. Petra VELLICK and W. Torham wrote. HOLEY, Wanda replied. Passport 988-00-4756, issued to Søren K. Unseen. The Avel Institute in Ovar Bay. 𝄞 Posted by Wanda Torham on"
    return rows(SCHEMA, [(i, t, "x") for i, t in enumerate(lines)] + [(1000, last, "x"), (1000, last, "x"), (1001, None, ""), (1002, "", ""), (1003, " \n", "")]), last


def test_names_are_told_by_the_corpus(rows):
    df, last = corpus(rows)
    found = sorted((r["start_pos"], r["end_pos"], r["kind"]) for r in find(df).where("doc_id = 1000").collect())
    assert [(last[a:b], k) for a, b, k in found] == [
        ("Petra VELLICK", "name"), ("W. Torham", "name"), ("HOLEY, Wanda", "name"), ("988-00-4756", "id_number"), ("Søren K. Unseen", "name"), ("Wanda Torham", "name"),
    ]
    clean = {r["doc_id"]: r["text"] for r in sanitise(df.dropDuplicates()).collect()}
    assert clean[0] == "[NAME], [PHONE], [EMAIL]" and clean[1001] is None and clean[1002] == "" and clean[1003] == " \n"
    assert clean[1000].startswith("Dr. [NAME] and [NAME] wrote. [NAME] replied. Passport [ID_NUMBER], issued to [NAME]. The Avel Institute in Ovar Bay. 𝄞 Posted by [NAME] on")


def test_rates_come_from_the_corpus(rows):
    """A mixture with known rates is recovered, whatever the starting values."""
    r = random.Random(5)
    data = [("given", f"t{k}", n, sum(r.random() < (0.7 if k % 4 == 0 else 0.02) for _ in range(n))) for k, n in enumerate(r.randint(1, 120) for _ in range(3000))]
    counted = rows("role string, term string, n long, b long", data)
    for start in ({}, {"if_name": 0.9, "if_other": 0.2}):
        one, other = rates(counted, **start)
        assert abs(one - 0.7) < 0.03 and abs(other - 0.02) < 0.005
    assert rates(counted.limit(0)) == (0.4, 0.01)


def test_a_form_that_stands_alone_discloses_nothing(rows):
    """Numbers that look like phone numbers but never stand with anything personal are no cases; the others stay."""
    people = [f"Petra Vellick{k % 5 * 'x'}, 01632 96{k:04d}, p{k}@y.test" for k in range(40)]
    alone = [f"Article no. {200 + k}-555-01{k:02d} is sold out." for k in range(60)]
    found = find(rows(SCHEMA, [(i, t, "x") for i, t in enumerate(people + alone)])).collect()
    assert {r["doc_id"] for r in found} == set(range(40)) and sum(r["kind"] == "phone" for r in found) == 40


def test_long_words_are_read_from_their_start():
    local, given = "a" * 500, "A" + "b" * 120
    assert cut(f"x {local}@b.test", emails(f"x {local}@b.test")) == [f"{local}@b.test"]
    text = f"{given} Vellick"
    assert [c[:2] for c in candidates(text, [])] == [(0, len(text))]


def test_long_text_and_empty_table(rows):
    text = "word " * 100_000 + "mail a.b@c.test"
    assert entities(text) == [("email", len(text) - 10, len(text))]
    assert find(rows(SCHEMA, [])).count() == 0
