"""Secret scans: against a scan by hand, the ledger's increments, awkward rows."""

import hashlib
import string

import pytest
from data import SF, awkward, empty, rows_of

from carescope.llm import secret_scan as S
from carescope.llm.queries import QUERIES

WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
VALUE = set(string.ascii_letters + string.digits + "+/_.=-")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def assign_at(text, low, k):
    """End and value length of an assignment at k, by hand."""
    for word in WORDS:
        if not low.startswith(word, k):
            continue
        i = k + len(word)
        if text[i:i + 1] in ('"', "'") and text[i:i + 1]:
            i += 1
        while text[i:i + 1] == " ":
            i += 1
        if text[i:i + 1] not in (":", "=") or not text[i:i + 1]:
            continue
        i += 1
        while text[i:i + 1] == " ":
            i += 1
        if text[i:i + 1] in ('"', "'") and text[i:i + 1]:
            i += 1
        j = i
        while text[j:j + 1] and text[j] in VALUE:
            j += 1
        if j > i:
            return j, j - i
    return None


def runs(text, allowed, least, start=""):
    out, k = [], 0
    while k < len(text):
        if text.startswith(start, k) and text[k] in allowed:
            j = k + len(start)
            while j < len(text) and text[j] in allowed:
                j += 1
            if j > k + len(start):
                if j - k >= least:
                    out.append((k, j))
                k = j
                continue
        k += 1
    return out


def base_spans(text):
    low, out, k = lower(text), [], 0
    while k < len(text):
        hit = assign_at(text, low, k)
        if hit:
            if hit[1] >= 6:
                out.append((k, 0, hit[0], "assign"))
            k = hit[0]
        else:
            k += 1
    out += [(a, 1, b, "access") for a, b in runs(text, set(string.ascii_uppercase + string.digits), 20, "AKIA")]
    out += [(a, 2, b, "hex") for a, b in runs(text, set(string.digits + "abcdef"), 24)]
    return sorted(out)


def expected(doc_id, text):
    spans = base_spans(text or "")
    count = [sum(s[3] == kind for s in spans) for kind in ("assign", "access", "hex")]
    listed = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
    return doc_id, *count, hashlib.sha256(listed.encode()).hexdigest(), listed


HARD = ["token: token: abcdef", "Password='hunter22' api_key = \"a.b/c+d=e_f-g\" APIKEY:short", "paſſword=abcdefgh toKen:abcdefgh",
        "AKIA" + "A" * 16 + " AKIAAKIA" + "1" * 11 + " xAKIA" + "Z" * 20 + "z", "deadbeef" * 3 + "g" + "0" * 23 + " " + "f" * 24,
        "secret=" + "a1" * 30, "😀 token=abcdef1234", "AKIA", "token=", "secret = \n abcdefg", "SECRET:AKIA" + "0" * 24 + "abcdef" * 4]


def test_spans_by_hand(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in S.scan_documents(docs, rules=S.BASE).collect()}
    for k, text in enumerate(HARD):
        assert tuple(got[k]) == expected(k, text), text


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_over_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_secret_scan"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = expected(r.doc_id, texts[r.doc_id])
        assert tuple(r)[:5] == want[:5]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex", "")] == want[5].split(",")


def test_further_kinds():
    text = "-----BEGIN RSA PRIVATE KEY----- eyJhbGci.eyJzdWIi.sig_- postgres://me:pa55@host.org/x http://host:80/"
    by_name = {r.name: [text[s["start"]:s["end"]] for s in S.spans_of(text, r)] for r in S.MORE}
    assert by_name == {"private_key": ["-----BEGIN RSA PRIVATE KEY-----"], "jwt": ["eyJhbGci.eyJzdWIi.sig_-"],
                       "url_password": ["postgres://me:pa55@host.org"]}


def test_ledger_scans_only_unseen_pairs(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    history = spark.createDataFrame([("a.txt", 1, "token=abcdef"), ("a.txt", 2, "clean"), ("b.txt", 1, "token=abcdef")],
                                    "path string, version int, text string")
    one = S.update_ledger(history, folder, S.BASE[:2])
    assert one.count() == 4                                                     # two blobs, two rules
    later = history.union(spark.createDataFrame([("c.txt", 1, "token=abcdef"), ("a.txt", 3, "secret=ghijkl")], history.schema))
    todo = {r.text: list(r.todo) for r in S.unseen(later, one, S.BASE[:2]).collect()}
    assert todo == {"secret=ghijkl": ["assign@1", "access@1"]}                  # the new blob alone
    two = S.update_ledger(later, folder, S.BASE[:2])
    assert two.count() == 6
    newer = (S.Rule("assign", 2, "token", S.re.ASCII), S.BASE[1])
    assert {tuple(r.todo) for r in S.unseen(later, two, newer).collect()} == {("assign@2",)}
    three = S.update_ledger(later, folder, newer)
    assert three.count() == 9 and S.update_ledger(later, folder, newer).count() == 9
    got = {(r.path, r.version): [(s.kind, s.start, s.end) for s in r.found]
           for r in S.findings(later, three, newer, ("path", "version")).collect()}
    assert got == {("a.txt", 1): [("assign", 0, 5)], ("b.txt", 1): [("assign", 0, 5)], ("c.txt", 1): [("assign", 0, 5)],
                   ("a.txt", 2): [], ("a.txt", 3): []}


def test_equal_ledger_rows_count_once(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    docs = spark.createDataFrame([(1, "token=abcdef")], "doc_id bigint, text string")
    ledger = S.update_ledger(docs, folder)
    (row,) = S.findings(docs, ledger.union(ledger)).collect()
    assert [(s.start, s.end) for s in row.found] == [(0, 12)]


def test_awkward_rows(spark):
    docs = awkward(spark)
    extra = docs.withColumnsRenamed({"row": "blob", "fp": "found", "n_tokens": "spans"})
    want = sorted((expected(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert sorted((tuple(r) for r in S.scan_documents(extra).collect()), key=str) == want
    assert rows_of(S.scan_documents(empty(spark))) == []
