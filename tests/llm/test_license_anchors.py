from quotelab.llm import license_scan as L

INDEX = L.LicenseIndex(L.BASE, L.TEMPLATES, 5)


def _found(text, least=0.8):
    return {c["template"]: c for c in INDEX.scan(text.encode())[2] if c["coverage"] >= least}


def test_template_that_a_longer_one_continues():
    found = _found('Some words. Licensed under the Apache License, Version 2.0 (the "License") and then quite other text follows here.')
    c = found["apache-2.0-statement"]
    assert set(found) == {"apache-2.0-statement"} and c["coverage"] == 1 and (c["start"], c["end"]) == (2, 10)


def test_every_template_is_found_in_itself():
    for name, text in L.TEMPLATES.items():
        assert _found(f"before {text} after")[name]["coverage"] == 1
