import random
import re

from tallyloom.llm import pii


def brute(text):
    """The base kinds by whole patterns."""
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
             (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and pii.luhn(digits(s))),
             (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15)]
    for k, (pattern, good) in enumerate(rules):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if good(m[0])]
    return [(pii.BASE[k], a, b) for a, k, b in sorted(out)]


PARTS = ["a", "Zed", ".", "@", "-", "+", " ", "  ", "1", "4111 1111 1111 1111", "4380-5578-1234-5678", "192.168.0.1", "256.1.1.1",
         "9", "é", "𝄞", "mail.example.com", "x@y.co", "+1 (743) 555-3824", "(", ")", "00", "::", "%", "_", "\n", "1.2.3.4.5.6.7.8",
         "0000000000000000000", "79927398713", "٣"]


def test_base_kinds_equal_whole_patterns():
    draw = random.Random(2)
    for _ in range(20_000):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randrange(0, 14)))
        assert [s for s in pii.find(text) if s[0] in pii.BASE] == brute(text), text


def test_cued_kinds():
    text = ("IBAN: GB82 WEST 1234 5698 7654 32, account number 12345678; SSN 123-45-6789 and ssn 000-12-3456. "
            "ftp://joe:pw@host.example/x iban DE00 1234 5678 9012 3456 78")
    found = {k: text[a:b] for k, a, b in pii.find(text) if k in pii.MORE}
    assert found == {"iban": "GB82 WEST 1234 5698 7654 32", "account": "12345678", "ssn": "123-45-6789", "userinfo": "joe:pw"}


def test_iban_ends_where_the_number_does():
    for text, want in [
            ("IBAN: DE89 3704 0044 0532 0130 00 BIC: COBADEFF", ["DE89 3704 0044 0532 0130 00"]),
            ("IBAN: DE89370400440532013000 EUR 500", ["DE89370400440532013000"]), ("iban DE89370400440532013000 500", ["DE89370400440532013000"]),
            ("IBAN NO93 8601 1117 947 BIC DNBANOKK", ["NO93 8601 1117 947"]), ("iban GB82WEST12345698765432", ["GB82WEST12345698765432"]),
            ("IBAN GB82 WEST 1234 5698 7654 32 IBAN DE89 3704 0044 0532 0130 00 A", ["GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"]),
            ("IBAN DE00 1234 5678 IBAN DE89 3704 0044 0532 0130 00", ["DE89 3704 0044 0532 0130 00"]),
            ("IBAN: DE89370400440532013000EUR", []), ("IBAN: DE88 3704 0044 0532 0130 00 BIC", [])]:
        assert [text[a:b] for k, a, b in pii.find(text) if k == "iban"] == want, text
    assert pii.masked("IBAN: DE89370400440532013000 EUR 500") == "IBAN: [IBAN] EUR 500"


def test_cues_in_any_letter_case():
    for text, want in [("iBaN de, IbAn: GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 32"), ("aCCount NUMBER: 12345678", "12345678"),
                       ("\u0130\u0130 Social security Number 123-45-6789", "123-45-6789"), ("sSn 123-45-6789", "123-45-6789")]:
        assert [text[a:b] for k, a, b in pii.find(text) if k in pii.MORE] == [want], text
    assert len({chr(c).lower() for c in range(0x110000) if len(chr(c).lower()) > 1}) == 1, "one letter changes the length"


def test_userinfo_of_any_length():
    text = f"http://{'j' * 300}:{'p' * 100_000}@host.example/x"
    assert [(a, b) for k, a, b in pii.find(text) if k == "userinfo"] == [(7, 7 + 300 + 1 + 100_000)]


def test_query_and_redaction(spark):
    rows = [(1, "write to a@b.co, or 10.0.0.1", 28, "k"), (2, None, None, "k"), (3, "", 0, "k"), (4, "clean", 5, None),
            (5, "joe@x.org " * 20_000, 1, "k"), (5, "joe@x.org " * 20_000, 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, masked string").selectExpr("*", "1 AS doc")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "write to [EMAIL], or [IP]" and got[1].n_chars == 25 and got[1].masked == "k"
    assert got[2].text is None and got[2].n_chars is None and got[3].text == "" and got[4].text == "clean"
    assert got[5].text == "[EMAIL] " * 20_000 and out.count() == 6
    assert pii.redact(docs.limit(0)).count() == 0
    found = docs.select("doc_id", pii.spans(docs["text"]).alias("s")).collect()
    assert {r.doc_id: len(r.s) for r in found} == {1: 2, 2: 0, 3: 0, 4: 0, 5: 20_000}
