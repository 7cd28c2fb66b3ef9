import re

import regex

from quotelab.llm import pii
from quotelab.llm import queries as Q

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, mentions string, k1 int"
PLAIN = {
    "email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}", "phone": r"\+\d[\d ()-]{8,}\d",
    "card": r"(?<!\d)\d{16}(?!\d)", "secret": r"(?<![0-9a-z])[0-9a-f]{40}(?![0-9a-z])",
}


def _shape(text):
    return re.sub("[a-z]", "a", re.sub("[0-9]", "9", text))


def test_documents_keep_everything_but_their_entities(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in Q.op10_pii(spark, SF).collect()}
    assert got.keys() == docs.keys()
    maps = {k: {} for k in PLAIN}
    real = {k: {m for t in docs.values() for m in re.findall(p, t)} for k, p in PLAIN.items()}
    for d, text in docs.items():
        new, both = got[d].text, "|".join(f"(?:{p})" for p in PLAIN.values())
        assert re.split(both, text) == re.split(both, new)  # all between the entities is as it was
        assert got[d].n_entities == len(re.findall(both, text))
        for k, p in PLAIN.items():
            for a, b in zip(re.findall(p, text), re.findall(p, new), strict=True):
                assert maps[k].setdefault(a, b) == b and b not in real[k]
                assert k == "email" or (len(a) == len(b) if k == "secret" else _shape(a) == _shape(b))
    for k, m in maps.items():
        assert m and len(set(m.values())) == len(m), k


def test_types_layouts_and_coreference(spark):
    texts = [
        "Mail Jo.Doe+x@Corp.example.com or JO.DOE+X@CORP.EXAMPLE.COM, call +44 20 7946 0958 / +44-20-7946-0958.",
        "Card 4111 1111 1111 1111 and 4111111111111111; SSN 078-05-1120; IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013000.",
        "Mr John Smith met Mrs Jane Smith, then Mr. Smith left. Госпожа Иванова и господин Петров.",
        "Server 10.0.0.1, 192.168.100.200. Not: 1.2.3.4.5, 999.1.1.1, version 2024-01-02, 12345678.",
        f"key {'ab12' * 10} KEY {'AB12' * 10}", None, "", "nothing here", "x" * 200_000 + " a@b.co",
    ]
    rows = [(k, t, "m", 1) for k, t in enumerate(texts)] + [(None, texts[0], "m", 1), (0, texts[0], "m", 1)]
    got = [(r.row.doc_id, r.text, r.n_entities) for r in pii.pseudonymise(spark.createDataFrame(rows, DOC), "k").collect()]
    assert len(got) == len(rows)
    by = {d: (t, n) for d, t, n in got}
    assert by[5] == (None, 0) and by[6] == ("", 0) and by[7] == ("nothing here", 0)
    assert by[None] == by[0]
    a, b, c, d, e = (by[k][0] for k in range(5))
    mails = re.findall(r"\S+@[\w.]+", a)
    assert mails[0].lower() == mails[1].lower().rstrip(",") and mails[0].endswith(".example") and "oe" not in mails[0].split("@")[0][4:6]
    phones = re.findall(r"\+44[ \d-]+\d", a)
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) and "7946" not in a and by[0][1] == 4
    cards = re.search(r"Card (\d{4} \d{4} \d{4} \d{4}) and (\d{16});", b).groups()
    assert cards[0].replace(" ", "") == cards[1] and cards[1] != "4111111111111111"
    digits = [int(x) for x in cards[1][::-1]]
    assert sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(digits)) % 10 == 0
    ibans = re.search(r"IBAN (DE[\d ]+) or (DE\d+)\.", b).groups()
    assert ibans[0].replace(" ", "") == ibans[1] and len(ibans[1]) == 22 and "3704" not in b and "078-05" not in b
    names = regex.findall(r"(Mr\.?|Mrs|Госпожа|господин) (\p{Lu}\p{Ll}+)(?: (\p{Lu}\p{Ll}+))?", c)
    assert names[0][2] == names[2][1] == names[1][2] and "Smith" not in c  # one surname for one surname
    assert regex.fullmatch(r"\p{IsCyrillic}+", names[3][1]) and regex.fullmatch(r"[A-Z][a-z]+", names[0][1])
    assert names[1][1].endswith(tuple(pii.ENDINGS["f", "latin"]))
    assert "Not: 1.2.3.4.5, 999.1.1.1, version 2024-01-02, 12345678." in d and "10.0.0.1" not in d and by[3][1] == 2
    low, high = re.search(r"key ([0-9a-f]{40}) KEY ([0-9A-F]{40})", e).groups()
    assert low.upper() == high and by[8][1] == 1 and by[8][0].startswith("x" * 200_000)


def _replaced(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.row.doc_id: (r.text, r.n_entities) for r in pii.pseudonymise(rows, "k").collect()}


def test_names_are_replaced_wherever_they_stand(spark):
    texts = [
        "Mr John Smith wrote it. Smith said no. John left; SMITH's notes and Smith-Jones stayed, smithy and Johnson too.",
        "Dr Anna Lee met Mary-Jane. Mrs Mary-Jane O'Neil and Mr McDonald: O'Neil, McDonald, Mary, Jane, Lee.",
        "Prof. J. R. Lee wrote to Mr Martin Luther King. King answered.", "Smith alone, with no title, and John.",
        "Госпожа Иванова и господин Иванов. Иванова ушла, доктор Анна Иванова пришла.",
        "Mr Éric Dupont: Éric@x.com, Ana.Dupont@x.com and Dupont.", "Mr Smith",
    ]
    got = _replaced(spark, texts)
    # Brute force: no word of a titled name is left in its document, as a whole capitalised run of letters; all else stays.
    run, titled = r"(?<!\p{L})\p{Lu}\p{L}+", rf"(?<!\p{{L}})(?:{pii._TITLE})\.? (?:\p{{Lu}}\. ?)*((?:[\p{{Lu}}'’-]|\p{{L}}+| (?=\p{{Lu}}))+)"
    for d, text in enumerate(texts):
        words = {w.lower() for name in regex.findall(titled, text) for w in regex.findall(run, name)}
        new = got[d][0]
        assert words.isdisjoint(w.lower() for w in regex.findall(run, new)), (words, new)
        hide = lambda t: regex.sub(rf"\S+@\S+|{run}", "*", t)
        assert hide(new) == hide(text)
        keep = [w for w in regex.findall(run, regex.sub(r"\S+@\S+", "", text)) if w.lower() not in words]
        assert [w for w in regex.findall(run, regex.sub(r"\S+@\S+", "", new)) if w in keep] == keep
    a, b, e = got[0][0], got[1][0], got[4][0]
    first, last = regex.match(r"Mr (\p{L}+) (\p{L}+) wrote", a).groups()
    assert a == f"Mr {first} {last} wrote it. {last} said no. {first} left; {last.upper()}'s notes and {last}-Jones stayed, smithy and Johnson too."
    assert got[0][1] == 5 and got[3] == (texts[3], 0) and got[6][0] == f"Mr {last}"
    anna, lee, mary, jane, neil, mac = regex.match(r"Dr (\w+) (\w+) met .*Mrs (\w+)-(\w+) O'(\w+) and Mr (\w+):", b).groups()
    assert b == f"Dr {anna} {lee} met {mary}-{jane}. Mrs {mary}-{jane} O'{neil} and Mr {mac}: O'{neil}, {mac}, {mary}, {jane}, {lee}."
    assert mary.endswith(tuple(pii.ENDINGS["f", "latin"])) and len({anna, lee, mary, jane, neil, mac}) == 6
    assert got[2][0].startswith(f"Prof. J. R. {lee} wrote to Mr ")
    stem = regex.search(r"господин (\w+)\.", e)[1]
    assert len(regex.findall(rf"{stem}а\b", e)) == 3 and "Иванов" not in e
    assert "@x.com" not in got[5][0] and got[5][0].count("@") == 2


def test_keys_addresses_and_local_phones(spark):
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(["MIIEow" + "Ab1+" * 14] * 3) + "\nqQ==\n-----END RSA PRIVATE KEY-----"
    texts = [
        "Call 555-123-4567, 555.123.4567 or 020 7946 0958, not 2024-01-02 nor 10:20:30 nor std::cout abc::def.",
        f"AKIA{'Z9' * 8} ghp_{'aB3' * 12} sk-{'x1Y' * 8} task-force", f"before {pem} after", "-----BEGIN PRIVATE KEY----- and no more",
        "At 2001:db8::1, fe80::1:2 and 2001:DB8:0:0:8:800:200C:417A. Mail bob@mail.corp.co.uk or ann@mail.corp.co.uk.",
    ]
    got = _replaced(spark, texts)
    phones = re.fullmatch(r"Call (\d{3}-\d{3}-\d{4}), ([\d.]{12}) or (0\d\d \d{4} \d{4}), (not .*)", got[0][0]).groups()
    assert got[0][1] == 3 and re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) != "5551234567" and phones[3] == texts[0][texts[0].index("not "):]
    assert "7946" not in got[0][0]
    for shape in ("AKIA([A-Z][0-9]){8} ", "ghp_([a-z][A-Z][0-9]){12} ", "sk-([a-z][0-9][A-Z]){8} task-force$"):
        assert re.search(shape, got[1][0]), got[1][0]
    assert got[1][1] == 3 and not any(w in got[1][0] for w in texts[1].split()[:3])
    body = re.fullmatch(r"before -----BEGIN RSA PRIVATE KEY-----([\s\S]*)-----END RSA PRIVATE KEY----- after", got[2][0])[1]
    assert got[2][1] == 1 and "MIIEow" not in body and _shape(body.lower()) == _shape(pem[31:-29].lower())
    assert got[3][0] == texts[3]
    v6 = re.match(r"At (\S+), (\S+) and (\S+)\. Mail \w{3}@(\w{4}\.\w{4}\.\w{2})\.example or \w{3}@(\S+)\.example\.$", got[4][0]).groups()
    assert got[4][1] == 5 and v6[3] == v6[4] and [re.sub("[0-9]", "9", re.sub("[A-Fa-f]", "f", x)) for x in v6[:3]] == ["9999:ff9::9", "ff99::9:9", "9999:ff9:9:9:9:999:999f:999f"]
    assert not any(x.lower() in texts[4].lower() for x in v6[:1])


def test_surrogates_stay_apart_in_a_crowded_layout(spark):
    ips = [("ip", f"{a}.{b}.1.1") for a in range(10) for b in range(10)]
    names = [("name_m_latin", f"n{k}") for k in range(3000)]
    df = spark.createDataFrame(ips + names, "type string, entity string")
    got = pii.surrogates(df, "k").collect()
    assert len(got) == len(ips) + len(names) == len({(r.type, r.surrogate.lower()) for r in got})
    assert not {(r.type, r.surrogate) for r in got} & {*ips}
    assert pii.surrogates(df.limit(0), "k").count() == 0
    again = {(r.type, r.entity): r.surrogate for r in pii.surrogates(df, "other").collect()}
    assert sum(again[r.type, r.entity] == r.surrogate for r in got) < len(got) / 10


def test_empty_table(spark):
    assert pii.pseudonymise(spark.createDataFrame([], DOC), "k").count() == 0
