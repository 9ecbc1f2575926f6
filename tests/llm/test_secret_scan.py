from __future__ import annotations

import hashlib
import random
import re

import pytest

from bidframe.llm.secret_scan import RULES, Rule, scan_secrets, trigram_query

from .helpers import documents

ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found)


def join(found):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)


def test_matches_brute_force(spark):
    rng = random.Random(6)
    parts = ["password", "PassWd", "secret", "Token", "api_key", "apikey", "API", "=", ": ", '"', "'", " ", "abc", "abcdef123", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "é", "\n", "0a", "x.y=z", "ghp_", "ſecret"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(1200)]
    rows += [(5000, None), (5001, ""), (None, "token=abcdefgh"), (None, "nothing"), (5000, "secret: hidden-value"), (5000, "secret: hidden-value"), (5002, "word " * 40_000 + "password = topsecret1"), (5003, "secret=token:abcdefgh")]
    got = scan_secrets(documents(spark, rows).withColumnRenamed("lang", "kinds").withColumnRenamed("source", "s0")).collect()
    assert len(got) == len(rows)
    want = sorted((d is not None, d or 0, hashlib.sha256(join(brute(t or "")).encode()).hexdigest(), *(sum(k == x for _, k, _ in brute(t or "")) for x in range(3))) for d, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in got) == want
    for r in got:
        base = [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_added_rules(spark):
    text = "é ghp_" + "a1B2" * 9 + " and xoxb-1234567890-abc then -----BEGIN RSA PRIVATE KEY-----"
    (got,) = scan_secrets(documents(spark, [(1, text)])).collect()
    assert got.n_added == 3
    assert [text[int(a) : int(b)][:4] for _, a, b in (s.split(":") for s in got.spans.split(","))] == ["ghp_", "xoxb", "----"]


def test_queries_never_miss_a_match():
    examples = {"assign": ["API_KEY = 'abcdefg'", "passwd:zzzzzz"], "access": ["AKIA" + "A" * 16], "github": ["gho_" + "a" * 36], "pem": ["-----BEGIN PRIVATE KEY-----"]}
    for rule in RULES:
        for text in examples.get(rule.kind, []):
            assert re.search(rule.regex, text)
            for clause in rule.clauses:
                assert any(all(g in text.lower() for g in alternative) for alternative in clause)
    assert Rule("x", "[0-9a-f]{24,}").clauses == [] and trigram_query("ab?c") == []


@pytest.mark.parametrize("rules", [[Rule("only", "[0-9]{5,}")], [Rule("word", "hello")]])
def test_own_rules_and_empty_table(spark, rules):
    assert scan_secrets(documents(spark, []), rules, 1).count() == 0
    (got,) = scan_secrets(documents(spark, [(1, "é hello 12345")]), rules, 1).collect()
    assert got.spans in ("only:8:13", "word:2:7")
