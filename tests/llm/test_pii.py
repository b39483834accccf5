import hashlib
import re

from costloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        d = [int(c) for c in s][::-1]
        return sum(d[0::2]) % 10 == sum(sum(divmod(2 * x, 10)) for x in d[1::2]) * -1 % 10

    tests = [
        ("email", EMAIL, lambda s: True),
        ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", CARD, lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", PHONE, lambda s: 9 <= len(digits(s)) <= 15),
    ]
    found = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(tests) for m in p.finditer(text) if ok(m[0])]
    return sorted(found)


CASES = [
    "a@b.co and c.d+e@f-g.example.org, x@y @z.com a@b.c@d.e .@-.- me@x..y",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.3.255 1.2.3 99999999.1.1.1",
    "4111 1111 1111 1111, 4111-1111-1111-1112; 4111  1111 1111 1111 0000000000000000",
    "+1 (743) 555-3824 +49 30 1234567 +1 2 +1((((((2 ++4912345678+4912345678 +123456789012345678",
    "+1 4111111111111111 a1@b2.c3 10.0.0.1@x.y 1.1.1.1@2.2.2.2",
    "é+1 743 555 3824é 😀 a@b.cd 😀",
    "",
    None,
]


def test_base_equals_the_patterns(docs, sample):
    rows = list(enumerate(CASES)) + [(100 + r.doc_id, r.text) for r in sample.collect()]
    got = {r.doc_id: r for r in pii.find_private(docs(rows)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = brute(text)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest(), text
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in want) for k in pii.BASE]
        if not r.n_added:
            assert r.spans == pii.joined(want)


def test_random_texts(docs):
    import random

    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("a.@+-1234567890 ()%x:/") for _ in range(rng.randrange(80)))) for i in range(400)]
    got = {r.doc_id: r.base_sha256 for r in pii.find_private(docs(rows)).collect()}
    for i, text in rows:
        assert got[i] == hashlib.sha256(pii.joined(brute(text)).encode()).hexdigest(), text


def test_added_kinds():
    m = pii.automaton()
    kinds = lambda t: [(s[2], t[s[0] : s[3]]) for s in pii.spans_of(t, m)]
    assert ("login", "ftp://joe:pw@host.example") in kinds("see ftp://joe:pw@host.example/x")
    assert kinds("see https://host.example/x") == []
    assert ("iban", "DE89 3704 0044 0532 0130 00") in kinds("IBAN: DE89 3704 0044 0532 0130 00.")
    assert kinds("iban DE00370400440532013000") == []
    assert ("account", "12345678") in kinds("account no 12345678")
    assert ("masked", "joe.doe (at) mail.example.com") in kinds("joe.doe (at) mail.example.com")


def test_cases(docs, clashing, spark):
    long = "word " * 200_000 + "a@b.co"
    out = pii.find_private(clashing([(1, None), (1, None), (None, ""), (2, long)])).collect()
    assert len(out) == 4 and sum(r.n_email for r in out) == 1
    assert pii.find_private(docs([])).collect() == []


def test_added_kinds_before_other_words():
    m = pii.automaton()
    kinds = lambda t: [(s[2], t[s[0] : s[3]]) for s in pii.spans_of(t, m) if s[2] in ("iban", "account")]
    assert kinds("IBAN DE89370400440532013000 BIC COBADEFF") == [("iban", "DE89370400440532013000")]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 Bitte") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("IBAN: NO93 8601 1117 947 5 DAYS") == [("iban", "NO93 8601 1117 947")]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 GBP") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert kinds("IBAN MT84 MALT 0110 0001 2345 MTLC AST0 01S") == [("iban", "MT84 MALT 0110 0001 2345 MTLC AST0 01S")]
    assert kinds("IBAN DE89 3704 0044 0532 0130 01 Bitte") == kinds("IBAN DE89 3704 0044 0532 0130") == []
    for cue in ("Account Number: ", "Account No. ", "ACCOUNT NO.: ", "Kontonummer ", "KONTONUMMER: ", "Konto-Nr."[:5] + " Nr. "):
        assert kinds(cue + "12345678") == [("account", "12345678")], cue


def test_secrets():
    machine = pii.automaton()
    found = lambda t: [(k, t[a:b]) for a, _, k, b in pii.spans_of(t, machine) if k == "secret"]
    h = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    assert found(f'x token = "{h}"### y') == found(f"Token: {h}") == found(f"API_KEY='{h}'") == [("secret", h)]
    assert found(f'"password":"{h[:12]}"') == [("secret", h[:12])]
    assert found("the token is new; secret = everything; password: 12345678; token = ab1") == []
