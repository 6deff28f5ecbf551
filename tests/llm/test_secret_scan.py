import hashlib
import re

import pytest

from focuslake.llm.secret_scan import BASE, RULES, Rule, digest, find_secrets, trigram_query

# The base rules of the contract, as written there.
KINDS = [("assign", re.compile(r'''(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''', re.I | re.A), 2, 8),
         ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32)]
TRICKY = [
    'PassWord = "abcdefgh"', "password=short token=longenough1", "api_key:x apikey = 12345678", "secret=''token=abcdefgh", "ſecret=abcdefgh",
    "toKen=abcdefgh", "AKIAABCDEFGHIJKL AKIASHORT", "é" * 5 + "0123456789abcdef" * 2, "0123456789abcdef" * 2 + "g" + "f" * 31, "tokentoken=a.b-c_d/e+f=",
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "xoxb-123456789012", "password: \n12345678"]


def brute(text):
    out = []
    for n, (kind, regex, group, least) in enumerate(KINDS):
        out += [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for m in regex.finditer(text or "") if len(m[group]) >= least]
    return ",".join(x[2] for x in sorted(out))


def test_spans_equal_brute_force(spark, documents, odd):
    rows = odd + [(100 + i, t) for i, t in enumerate(TRICKY)]
    got = digest(find_secrets(documents(rows, extra=True))).collect()
    key = lambda r: (repr(r[0]), r[1])
    assert sorted(((r.doc_id, r.base_sha256) for r in got), key=key) == sorted(
        ((i, hashlib.sha256(brute(t).encode()).hexdigest()) for i, t in rows), key=key)
    spans = {r.doc_id: r.spans for r in got}
    assert spans[110].startswith("private_key:0:") and "github:0:44" in spans[111] and spans[112].startswith("slack:0:")
    assert spans[3] == spans[4] == ""


def test_empty_table(spark, documents):
    assert digest(find_secrets(documents([]))).collect() == []


def holds(query, text):
    text = text.lower().encode()
    if query is True:
        return True
    kind, value = query
    if kind == "tri":
        return value.to_bytes(3, "big") in text
    return (all if kind == "and" else any)(holds(q, text.decode()) for q in value)


@pytest.mark.parametrize("pattern, text", [
    ("abc+d", "xabcccd"), ("(foo|ba[rz])qux", "bazqux"), ("a?bcd", "bcd"), ("x{2,3}yz", "xxyz"), ("(?:ab)+c", "ababc"), ("[^a]bcd", "zbcd"),
    ("ab.cd", "abxcd"), ("hello|[0-9]+", "7"), ("^abcd$", "abcd"), *[(r.pattern, t) for r in RULES for t in TRICKY if re.search(r.pattern, t)]])
def test_query_never_misses(pattern, text):
    assert re.search(pattern, text) and holds(trigram_query(pattern), text)


def test_rules_without_trigrams_scan_everything():
    assert trigram_query(BASE[2].pattern) is True and trigram_query("a|bcd") is True and trigram_query("(?i)abcdef") is True
    assert trigram_query(BASE[0].pattern) is not True and not holds(trigram_query(BASE[1].pattern), "ak ia")


def test_own_rules(spark, documents):
    row = find_secrets(documents([(1, "id:abc id:defg")]), [Rule("id", "id:([a-z]+)", 4, 1)]).first()
    assert [(s.kind, s.start, s.stop) for s in row.spans] == [("id", 7, 14)]
