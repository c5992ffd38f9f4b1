import hashlib
import random
import re

from glossa.llm import secret_scan as S

KEY = "AKIA" + "Q" * 16


def plain(text):
    """The base rules read literally."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(x[2] for x in sorted(out))


def test_base_spans_equal_the_rules():
    rng = random.Random(3)
    bits = ["password", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdef", "0123456789abcdef0123456789", KEY, "AKIA", "é", "\n", "secret=", "x" * 7]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        base = S.base_spans(text)
        assert S.joined(base) == plain(text), text


def test_weak_parts_need_each_other():
    key = "wJalrXUtnFEMI0K7MDENGbPxRfiCYEXAMPLEKEYa"
    assert [k for k, *_ in S.linked_spans(f"{key} alone", [])] == []
    near = f"id X1Y2Z3A4B5C6D7 and {key}"
    assert sorted(k for k, *_ in S.linked_spans(near, S.base_spans(near))) == ["identifier", "secret_key"]
    far = f"id X1Y2Z3A4B5C6D7 {'w ' * 300} {key}"
    assert S.linked_spans(far, S.base_spans(far)) == []
    other_scope = f"id X1Y2Z3A4B5C6D7\n\n{key}"
    assert S.linked_spans(other_scope, S.base_spans(other_scope)) == []
    with_access = f"{KEY} {key}"
    assert [k for k, *_ in S.linked_spans(with_access, S.base_spans(with_access))] == ["secret_key"]
    url = "postgres://db.example.com token=abcdef123456"
    assert "endpoint" in [k for k, *_ in S.linked_spans(url, S.base_spans(url))]
    assert S.linked_spans("see http://example.com for more", []) == []


def test_weak_parts_within_a_long_strong_span_stay_out():
    key = "wJalrXUtnFEMI0K7MDENGbPxRfiCYEXAMPLEKEYa"
    text = "secret=" + "0123456789abcdef01234567." * 5 + key
    assert all(k in S.BASE_KINDS for k, *_ in S.linked_spans(text, S.base_spans(text)))


def test_links_equal_all_pairs():
    rng = random.Random(5)
    key, name = "wJalrXUtnFEMI0K7MDENGbPxRfiCYEXAMPLEKEYa", "X1Y2Z3A4B5C6D7"
    bits = [key, name, "https://a.example.com", "postgres://user@db", "secret=0123456789abcdef01234567.x.y.z", "token=abcdefgh", KEY, "w " * 20, "w " * 70, "\n\n", "0123456789abcdef0123456789"]
    seen = 0
    for _ in range(400):
        text = " ".join(rng.choice(bits) for _ in range(rng.randint(2, 14)))
        base = S.base_spans(text)
        weak = {(m.start(), m.end()): kind for kind, rule in (("id", S.IDENTIFIER), ("key", S.SECRET_KEY)) for m in rule.finditer(text)}
        free = {x: kind for x, kind in weak.items() if all(x[1] <= a or x[0] >= b for _, a, b, _ in base)}
        ids, keys = ([x for x, kind in free.items() if kind == which] for which in ("id", "key"))
        ends = [(m.start(), m.end()) for m in S.ENDPOINT.finditer(text)]
        all_keys = keys + [(s, e) for k, s, e, _ in base if k != "access"]
        marks = ids + ends + [(s, e) for k, s, e, _ in base if k == "access"]
        breaks = [m.start() for m in S.SCOPE_END.finditer(text)]

        def near(x, others):
            return any(max(x[0], y[0]) - min(x[1], y[1]) <= S.REACH and sum(b <= x[0] for b in breaks) == sum(b <= y[0] for b in breaks) for y in others)

        want = [("identifier", *x) for x in ids if near(x, all_keys)] + [("secret_key", *x) for x in keys if near(x, marks)] + [("endpoint", *x) for x in ends if near(x, all_keys)]
        got = S.linked_spans(text, base)
        assert sorted(g[:3] for g in got) == sorted(want), text
        seen += len(want)
    assert seen > 300


def test_redaction_masks_values_once():
    text = 'token = "0123456789abcdef0123456789abcdef" end'
    spans = S.base_spans(text)
    assert S.redact(text, spans) == 'token = "[ASSIGN]" end'


def test_operator_on_nulls_repeats_long_texts_and_clashing_columns(spark):
    long_ = "x " * 200_000 + "password=hunter22"
    docs = spark.createDataFrame([(1, "nothing", 0), (1, "nothing", 0), (2, None, 0), (None, "", 0), (5, long_, 0)], "doc_id long, text string, secret_spans int")
    rows = {(r.doc_id, r.spans) for r in S.digest(docs).collect()}
    assert rows == {(1, ""), (2, ""), (None, ""), (5, f"assign:400000:{len(long_)}")}
    assert S.digest(docs).where("doc_id = 2").first().base_sha256 == hashlib.sha256(b"").hexdigest()
    assert S.scan(docs, with_redacted=True).where("doc_id = 5").first().redacted.endswith("password=[ASSIGN]")
    assert S.digest(docs.limit(0)).count() == 0
