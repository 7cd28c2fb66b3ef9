from quotelab.llm import license_scan as L

INDEX = L.LicenseIndex(L.BASE, L.TEMPLATES, 5)


def test_every_place_of_a_template():
    text = L.TEMPLATES["isc-text"]
    n = len(L.terms(text.encode()))
    for between, gap in (("", 0), (" other words here ", 3)):
        found = [c for c in INDEX.scan(between.join([f"{text} "] * 3).encode())[2] if c["template"] == "isc-text"]
        assert [(c["start"], c["end"], c["coverage"]) for c in found] == [(k * (n + gap), k * (n + gap) + n, 1.0) for k in range(3)]


def test_many_places_of_a_short_template():
    found = INDEX.scan(b"Licensed under CC BY-NC 4.0. " * 2000)[2]
    assert sum(c["template"] == "cc-by-nc-4.0" for c in found) == 2000
