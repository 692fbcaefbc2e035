import hashlib
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from mnemotide.llm.pii_anchor import KINDS, all_spans, anchors, base_spans, luhn, personal_data, redacted

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", "@x.de", ".", "-", " ", "+", "12", "255", "256", "4", "4111111111111111", "4111 1111 1111 1111", "(", ")", "1.2.3.4", "0001.2.3.4.5.6.7.8", "é", "\n", "%"]), max_size=14))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert sorted(base_spans(text, [i for i, c in enumerate(text) if c == "@"]), key=lambda s: (s[0], KINDS.index(s[2]))) == _brute(text)


def test_anchors_add_and_keep():
    a = anchors()
    cases = {
        'x token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" y': ["account"],
        "see https://example.com/u/jo?x=1). Then": ["address"],
        "mail jörg@müller.de now": ["email"],
        "IBAN: DE44 5001 0517 5407 3249 31 ok": ["account"],
        "password=b7db7aa4a5fcc78305": ["account"],
        "write to a.b@mail1.example.com": ["email"],
        "the account was long and the token of it, a secret": [],
        "plain words only, at 10:30 in 2024": [],
        "password=hunter2 and": ["account"],
        "Password: correcthorsebattery.": ["account"],
        "{'api_key': 'abcdefghijklmnop'}": ["account"],
        "the secret: of it all": [],
        "a token = abcdefg": [],
        "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dozjgNryP4J3jVmN here": ["account"],
    }
    for text, kinds in cases.items():
        base, every = all_spans(text, a)
        assert set(base) <= set(every)
        assert [s[2] for s in every if s not in base] + [s[2] for s in base if s[2] == "email"] == kinds, (text, every)
    text = "see https://example.com/u/jo?x=1). Then"
    assert redacted(text, all_spans(text, a)[1]) == "see [ADDRESS]). Then"


def test_table(spark):
    rows = [(1, "a@b.de and 1.2.3.4", 9, "s"), (1, "a@b.de and 1.2.3.4", 9, "s"), (2, None, None, None), (3, "", 1, "s"), (None, "+1 (988) 555-2485", 2, "s"), (4, "x" * 200_000 + " 4111111111111111", 1, "s"), (5, "1" * 100_000 + "@" * 1000, 1, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_email int, spans string")
    got = personal_data(docs, keep=("spans",), redact=True).toPandas()
    assert len(got) == len(rows)
    one = got[got.doc_id == 1].iloc[0]
    assert one.n_email == 1 and one.n_ip == 1 and one.clean_text == "[EMAIL] and [IP]"
    assert one.base_sha256 == hashlib.sha256(b"email:0:6,ip:11:18").hexdigest()
    empty = got[got.doc_id == 2].iloc[0]
    assert empty.base_sha256 == hashlib.sha256(b"").hexdigest() and empty.clean_text is None
    assert got[got.doc_id == 4].iloc[0].n_card == 1 and got[got.doc_id.isna()].iloc[0].n_phone == 1
    assert personal_data(spark.createDataFrame([], docs.schema)).collect() == []


def test_added_spans_equal_the_rule_read_word_by_word():
    """Secrets behind password cues, by a plain search of the whole text for each cue and value."""
    rng, a = random.Random(5), anchors()
    parts = ["password", "pwd", "Passwd", "=", ":", " ", "  ", '"', "hunter2", "x", "longvalue", "abc", ".", ",", "word ", "1"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        want, done = [], 0
        for at in range(len(text)):
            cue = next((c for c in ("password", "passwd", "pwd") if text.lower().startswith(c, at)), None)
            if cue is None or at < done or (at and text[at - 1].isalnum()):
                continue
            m = re.match("[\"']?[ \t]{0,2}[:=][ \t]{0,2}[\"']?([^\\s\"'<>,;()\\[\\]{}]{6,})", text[at + len(cue) :])
            value = m and m.group(1).rstrip(".!?:")
            if value and len(value) >= 6:
                start = at + len(cue) + m.start(1)
                want.append((start, start + len(value), "account"))
                done = start + len(value)
        assert [s for s in all_spans(text, a)[1] if s[2] == "account"] == want, text


def test_many_emails_take_time_in_proportion():
    text, a = "a.b@mail.example.com x " * 16_000, anchors()
    began = time.perf_counter()
    base, every = all_spans(text, a)
    assert len(base) == len(every) == 16_000 and time.perf_counter() - began < 2


def test_long_identifiers_and_local_parts_are_covered_to_their_end():
    secret = "".join(f"aB{i % 10}" for i in range(40))
    for token in (secret, "x" * 100 + "1234", "a1" * 3000, "-".join(["ab12"] * 50)):
        text = f"the token: {token}, and more"
        at = text.index(token)
        every = all_spans(text, anchors())[1]
        assert every == [(at, at + len(token), "account")]
        assert redacted(text, every) == "the token: [ACCOUNT], and more"
    local = "é" + "b" * 100
    text = f"write to {local}@exämple.org now"
    assert redacted(text, all_spans(text, anchors())[1]) == "write to [EMAIL] now"


def test_runs_with_many_cues_take_one_pass():
    text = "/tokenx" * 60_000 + ": token 123456 " + "/passwordx" * 100 + " pwd=abc12345"
    assert [text[a:b] for a, b, _ in all_spans(text, anchors())[1]] == ["123456", "abc12345"]


def test_tokens_that_fail_cost_their_length_once():
    automaton = anchors()
    for text in ("eyJaaaaaaaaaaaaaa" * 60_000, "eyJaaaaaaaaaaaaaa." * 60_000, "eyJaaaaaaaaaaaaaa.eyJ" * 50_000):
        began = time.perf_counter()
        all_spans(text, automaton)
        assert time.perf_counter() - began < 3
    token = "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 8
    for before in ("eyJ! ", "eyj", "EYJx"):
        assert (len(before), len(before) + len(token), "account") in all_spans(before + token, automaton)[1]
