"""Base spans against the contract's expressions, the added ones on examples."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tarsia.llm.pii import BASE, find_pii, iban_valid, luhn, redact, spans_of

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("ab1290@@..+-% ()\nİé,"), max_size=60))
def test_base_spans(text):
    assert [s for s in spans_of(text) if s[2] in BASE] == brute(text)


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in find_pii(df).collect():
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(base)


def test_added():
    kinds = lambda t: [(k, t[a:b]) for a, b, k in spans_of(t)]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00 ok") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("Account no. 12345678") == [("account", "12345678")]
    assert ("login", "bob:secret@host.example") in kinds("see https://bob:secret@host.example/x")
    assert ("address", "12 Old Mill Road") in kinds("lives at 12 Old Mill Road, there")
    assert ("obfuscated", "bob [at] example [dot] org") in kinds("write bob [at] example [dot] org")
    token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    for given in (f'then token = "{token}" and', f"api_key: {token}", f"Password is Xk29-qqLm4zT", f"Authorization: Bearer {token}"):  # noqa: F541
        assert [k for k, _ in kinds(given)] == ["secret"]
    assert kinds("SSN: 123-45-6789") == [("identity", "123-45-6789")] and kinds("passport no. C01X00T47") == []
    assert kinds("Tel. (030) 123 4567") == [("telephone", "(030) 123 4567")]
    assert kinds("the token is gone, a secret of words: something, fax it, phone 12") == []
    assert iban_valid("GB82 WEST 1234 5698 7654 32") and not iban_valid("GB82 WEST 1234 5698 7654 33")
    assert redact("mail a@b.cd now") == "mail <email> now" and redact(None) is None


def test_recall_of_assigned_secrets(spark):
    """Every text of the given table with an assigned token of forty hexadecimal digits has it as a span, and no others have secrets."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = re.compile(r'token = "([0-9a-f]{40})"')
    rows = {r.doc_id: [m.span(1) for m in planted.finditer(r.text or "")] for r in df.collect()}
    assert sum(map(len, rows.values())) > 5
    for r in find_pii(df).collect():
        got = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("secret:")]
        assert got == rows[r.doc_id]


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "a@b.c", "c"), (3, "a@b.c " * 20000, None), (3, "1" * 100000 + "@" * 1000, None)], "doc_id long, text string, spans string")
    got = find_pii(df).collect()
    assert sorted(r.n_email for r in got) == [0, 0, 0, 1, 20000]
    assert find_pii(df.limit(0)).count() == 0


def test_a_long_secret_is_found_to_its_end(spark):
    secret = "".join(hashlib.sha256(b"%d" % i).hexdigest() for i in range(20))
    row = find_pii(spark.createDataFrame([(1, f"password: {secret} end")], "doc_id long, text string")).first()
    start = len("password: ")
    assert any(s.split(":")[1:] == [str(start), str(start + len(secret))] for s in row.spans.split(","))
