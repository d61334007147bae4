"""Packing, personal data and host trust, against plain Python."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from talentloom.llm import host_trust, packing, pii

# --- packing ---


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_pieces(pieces, want):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(want)
    for i, ps in by_doc.items():
        ids, at = np.array(want[i], "<u4"), 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            at += p.length
            assert p.ids_crc32 == zlib.crc32(ids[p.start:at].tobytes())
        assert at == len(ids)
    waste = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.WINDOW
        waste += packing.WINDOW - at
    return waste


def test_every_id_lies_in_one_piece(documents, tokenizer):
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in documents.collect()}
    waste = check_pieces(packing.packed(documents, with_ids=False).collect(), want)
    assert waste < packing.WINDOW * 2


def test_odd_texts_have_the_librarys_ids(docs, tokenizer):
    rows = [(1, None), (2, ""), (3, "a<|endoftext|>b<|endoftext|>"), (4, "  \n\n é漢字 👩‍👩‍👧 \u0000"), (5, "x" * 40_000), (6, "word " * 9_000), (7, "don't I'll 123 4५")]
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    check_pieces(packing.packed(docs(rows), with_ids=False).collect(), want)


def test_long_white_space_has_the_librarys_ids(docs, tokenizer):
    rows = [(1, "a" + " " * 2_000_000 + "b"), (2, "\n" * 3_000_000 + "7"), (3, "a<|endoftext|>" + "\u3000" * 1_200_000), (4, "\t" * 1_100_000 + "<|endoftext|>" + " \n" * 700_000 + "!"), (5, "x" * 2_000_000)]
    n = packing.LONG_RUN
    rows += [(10 + i, pre + w * k + post) for i, (w, k, pre, post) in enumerate((w, k, pre, post) for w in " \n\u00a0" for k in (n - 1, n, n + 1) for pre in ("", "a") for post in ("", "b", "\x1c"))]
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in rows}
    check_pieces(packing.packed(docs(rows), with_ids=False).collect(), want)


def test_packing_empty_repeated_and_null_ids(docs):
    assert packing.packed(docs([])).count() == 0
    got = packing.packed(docs([(None, "a"), (1, "b"), (1, "b")])).collect()
    assert len(got) == 3 and len({(p.sequence_id, p.offset) for p in got}) == 3


def test_full_windows_leave_best_fit():
    w = packing.Windows(0)
    out = [x for n in (1500, 600, 548, 1448, 2048) for x in w.add((n, 0, np.zeros(n, "<u4"), n))]
    assert [[p[0] for p in pieces] for _, pieces in out] == [[1500, 548], [600, 1448], [2048]] and not w.open


# --- personal data ---

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(text):
    text = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.findall("[0-9]", m[0])) <= 15]
    return out


def test_base_spans_equal_the_patterns(documents, docs):
    rng = np.random.default_rng(4)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+49 (30) 123-4567", "+1", "é", " ", "\n", "-", ".", "5", "5500005555555559", "_", "@b.c@d.e", "007.1.02.255", "%"]
    rows = [(i, "".join(rng.choice(parts, int(rng.integers(0, 30))))) for i in range(300)] + [(1000, None)]
    for df in (documents.select("doc_id", "text"), docs(rows)):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in pii.digest_rows(df).collect():
            base = brute_base(texts[r.doc_id])
            shown = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
            assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest(), texts[r.doc_id]
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in pii.BASE]
            spans = r.spans.split(",") if r.spans else []
            assert set(shown.split(",") if shown else []) <= set(spans)


def test_checksums_and_context_add_spans():
    kinds = lambda t: [(k, base) for k, _, _, _, base in pii.spans(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 ok") == [("iban", False)]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00 ok") == []
    assert kinds("my card: 378282246310005") == [("card", False)]
    assert kinds("number 378282246310005") == []
    assert kinds("call 555-123-4567") == [("phone", False)] and kinds("part 555-123-4567") == []
    assert kinds("ssn 123-45-6789") == [("ssn", False)] and kinds("ssn 000-45-6789") == []


def test_long_runs_are_linear_and_redaction_keeps_columns(spark):
    big = ["a" * 300_000, "1" * 300_000, "1." * 100_000, "@" * 100_000, "+1" + "(" * 200_000, "9 " * 100_000]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(big)] + [(9, "mail a@b.cd now", "k"), (10, None, "k")], "doc_id long, text string, found string")
    assert pii.digest_rows(df).count() == 8
    out = pii.redacted(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.filter("doc_id > 8").collect()} == {9: "mail [email] now", 10: None}


def test_pii_empty_table(docs):
    assert pii.digest_rows(docs([])).count() == 0


# --- host trust ---

URLS = [
    ("https://Shop.COM/a?x#y", "shop.com", "/a", "com/", "allow"), ("http://a.com", "a.com", "", None, "allow"), ("http://example.com/en/x", "example.com", "/en/x", "example.com/en/", "block"),
    ("http://b.example.com/en/", "b.example.com", "/en/", "example.com/en/", "block"), ("http://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://w.www.example.com/en/1", "w.www.example.com", "/en/1", "www.example.com/en/", "allow"), ("x://q.net/es/1", "q.net", "/es/1", "net/es/", "block"), ("x://q.net/esx", "q.net", "/esx", None, "block"),
    ("x://notcom/a", "notcom", "/a", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u[0], None) for i, u in enumerate(URLS)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in host_trust.verdict_rows(df).collect()}
    assert got == {i: u[1:4] for i, u in enumerate(URLS)}


def brute_rank(edges, seeds):
    """Power iteration with a matrix, until nothing moves."""
    hosts = sorted({h for s, t, _ in edges for h in (s, t)} | set(seeds))
    move = np.zeros((len(hosts), len(hosts)))
    for s, t, w in edges:
        move[hosts.index(t), hosts.index(s)] += w
    move = 0.85 * move / np.maximum(move.sum(0), 1)
    start = 0.15 * np.array([seeds.get(h, 0.0) for h in hosts])
    return dict(zip(hosts, np.linalg.solve(np.eye(len(hosts)) - move, start)))


def links(*hosts):
    return "".join(f'<a href="http://{h}/p">x</a><a href="/own">y</a>' for h in hosts)


WEB = [("http://good.com/", links("friend.org")), ("http://friend.org/", links("pal.org")), ("http://pal.org/", links("good.com")), ("http://bad.net/es/1", links("victim.org")),
       ("http://spam.org/", links("bad.net", "bad.net")), ("http://victim.org/", None), ("http://farm.org/", links("spam.org")), ("http://farm.org/", links("spam.org")), ("http://lone.org/", ""),
       ("http://mixed.org/", links("good.com", "bad.net", "friend.org")), ("http://half.net/fr/", ""), ("http://half.net/de/", ""), ("no host", links("bad.net"))]


def verdicts(spark, pages):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.host: r for r in host_trust.verdict_rows(df).filter("rule is null").collect()}


def test_trust_follows_links_and_distrust_goes_back(spark):
    got = verdicts(spark, WEB)
    edges = collections.Counter()
    pages = collections.Counter()
    for url, html in WEB:
        host = url.split("/")[2] if "://" in url else ""
        pages[host] += bool(host)
        for other in {h for h in re.findall(r"http://([^/]+)", html or "")}:
            if host and other != host:
                edges[host, other] += 1
    forth = [(s, t, w) for (s, t), w in edges.items()]
    back = [(t, s, w) for s, t, w in forth]
    share = lambda seeds: {h: n / sum(seeds.values()) for h, n in seeds.items()}
    allowed, blocked, everywhere = share({"good.com": 1}), share({"bad.net": 1, "half.net": 1}), share(pages)
    trust, distrust, base_forth, base_back = brute_rank(forth, allowed), brute_rank(back, blocked), brute_rank(forth, everywhere), brute_rank(back, everywhere)
    for h, r in got.items():
        assert r.trust == pytest.approx(trust.get(h, 0), abs=1e-5) and r.distrust == pytest.approx(distrust.get(h, 0), abs=1e-5)
        if h:
            suspect, trusted = distrust.get(h, 0) / base_back[h], trust.get(h, 0) / base_forth[h]
            assert r.verdict == ("block" if suspect > trusted * (1 + 1e-4) else "allow"), h
    assert {h for h, r in got.items() if r.verdict == "block"} >= {"spam.org", "farm.org", "half.net"}
    assert all(got[h].verdict == "allow" for h in ("friend.org", "pal.org", "victim.org", "lone.org", ""))


def test_verdicts_do_not_depend_on_the_size_of_the_table(spark):
    want = {h: r.verdict for h, r in verdicts(spark, WEB).items()}
    assert {h: r.verdict for h, r in verdicts(spark, WEB * 3).items()} == want
    others = [(f"http://other{i}.org/", links(f"other{(i + 1) % 40}.org")) for i in range(40)]
    more = {h: r.verdict for h, r in verdicts(spark, WEB + others).items()}
    assert {h: more[h] for h in want} == want and all(v == "allow" for h, v in more.items() if h.startswith("other"))


def test_hosts_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert host_trust.verdict_rows(df).count() == 0
    df = spark.createDataFrame([(1, "http://a.com/x", "", "old", 5)], "page_id long, url string, html string, host string, hit_ int")
    out = host_trust.judged(df).first()
    assert out.host == "a.com" and out.hit_ == 5
