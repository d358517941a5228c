import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pii as P

from .conftest import ODD, prose

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute(x):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, x):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a.@1234 -+()%x5é\n0", max_size=50))
def test_base_spans_match_the_patterns(x):
    assert P.base_spans(x) == brute(x)


def test_known_values():
    x = "mail é a.b@c.example.com, 10.0.0.255 256.1.1.1, 4111 1111 1111 1111 +1 (377) 555-0271."
    assert [(P.KINDS[k], x[a:b]) for a, k, b in P.base_spans(x)] == [("email", "a.b@c.example.com"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (377) 555-0271")]


def test_long_runs_are_scanned_in_linear_time():
    began = time.perf_counter()
    for x in ("a" * 1_000_000, "1" * 1_000_000, "1." * 300_000 + "x", "+1 " * 200_000, "a@" * 200_000):
        P.base_spans(x)
    assert time.perf_counter() - began < 20


def revealing():
    """An owner's name far from an address, in many documents; one document with the name alone; ordinary words in all."""
    rows = [(k, f"{prose(k, 12)} Quindecim {prose(300 + k, 60)} near boss@corp.example.com said {prose(70 + k, 6)}") for k in range(6)]
    rows += [(50 + k, f"{prose(90 + k, 90)} near contact person{k}@mail.example.com today he said {prose(130 + k, 60)}") for k in range(60)]
    # Near copies of one text with an address: their common words prove nothing.
    copied = prose(7, 80) + " solitaire"
    rows += [(200 + k, f"extra{k} {copied} one@copies.example.com") for k in range(5)]
    return [*rows, (300, f"{prose(500, 30)} QUINDECIM! {prose(501, 20)}"), (301, None), (302, "")]


def test_disclosing_terms_go_everywhere_and_others_stay(make):
    for most in (1000, 0):
        out, name = P.scan(make(revealing(), clash=True), max_terms=most)
        rows = {r["doc_id"]: r for r in out.collect()}
        for k in (*range(6), 300):
            text, spans = rows[k]["text"], rows[k][name]["spans"]
            found = {text[s["start"] : s["end"]] for s in spans if s["kind"] == "term"}
            assert found == {"QUINDECIM" if k == 300 else "Quindecim"} and "[NAME]" in rows[k][name]["clean"] and "boss@" not in rows[k][name]["clean"]
        assert all(s["kind"] != "term" for k, r in rows.items() if k >= 50 and k != 300 for s in r[name]["spans"])


def test_pmi_matches_a_direct_count(make):
    import math
    from collections import Counter

    rows = revealing()
    n, ce, ct, both, where = len(rows), Counter(), Counter(), Counter(), {}
    for i, x in rows:
        spans = P.base_spans(x or "")
        bare = "".join(" " if any(a <= j < b for a, _, b in spans) else c for j, c in enumerate(x or ""))
        words = {w.lower() for w in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]{4,}", bare)}
        for w in {w.lower() for w in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]{4,}", x or "")}:
            ct[w] += 1
        for e in {P.entity_key(k, x[a:b]) for a, k, b in spans}:
            ce[e] += 1
            for w in words:
                both[e, w] += 1
                where.setdefault((e, w), set()).add("copies" if 200 <= i < 300 else i)
    want = {(e, w): (ce[e], ct[w], b) for (e, w), b in both.items() if len(where[e, w]) >= 3 and ce[e] < 0.1 * n and math.log(b * n / (ce[e] * ct[w])) >= 0.9 * math.log(n / ce[e]) - 1e-9}
    got = {(r["entity"], r["n_entity"], r["n_term"], r["n_both"]) for r in P.disclosing(make(rows)).collect()}
    assert got == {(P._hash(e), *v) for (e, _), v in want.items()} and {w for _, w in want} == {"quindecim"}


def test_query_matches_brute_force(spark, make, tmp_path):
    """base_sha256, counts and spans of the registered query, row by row."""
    import hashlib

    from tidemark.llm.registry import QUERIES

    rows = [(i, x) for i, x in revealing()] + [(900 + (i or 20), x) for i, x in ODD] + [(950, "a.b@c.example.com 10.0.0.255 256.1.1.1 4111 1111 1111 1111 +1 (377) 555-0271 é x@y.zz"), (951, "+1 (377) 555-0271 4111-1111-1111-1111")]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in QUERIES["op10_pii"](spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], r)
    for i, x in rows:
        base = brute(x or "")
        names = [P.KINDS[k] for _, k, _ in base]
        joined = ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in base)
        own = [(m.start(), 4, m.end()) for m in re.finditer("(?i)quindecim", x or "")]
        assert [got[i][f"n_{k}"] for k in P.KINDS[:4]] == [names.count(k) for k in P.KINDS[:4]]
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert got[i]["spans"] == ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + own))


def test_odd_rows_and_empty_table(make):
    docs = make(ODD, clash=True)
    out = P.sanitise(docs, length="n_chars")
    assert out.columns == docs.columns and out.count() == len(ODD)
    assert {(r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] in (1, 2, 4)} == {(1, None), (2, ""), (4, ODD[3][1])}
    assert P.sanitise(make([])).count() == 0


def test_generalise():
    x = "Ask Quin at a@b.cc now x7"
    assert P.generalise(x, [(4, 4, 8), (12, 0, 18), (23, 4, 25)]) == "Ask [NAME] at [EMAIL] now [NUMBER]"
