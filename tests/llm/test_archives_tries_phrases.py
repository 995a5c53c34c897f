"""Archives, prefix tries and collocations against plain versions, on odd rows."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tallywise.llm import archives, collocations, tries

# ------------------------------------------------------------------ archives

LONG = "<p>" + "x y é " * 250_000
PAGES = [(1, "http://a.example/1", "<p>" + "é" * 600), (2, "http://a.example/b c", "<p>" + "é" * 600), (3, None, None),
         (4, "http://é.example/\n", ""), (5, "http://a.example/5", "short"), (6, "http://a.example/6", "short"),
         (2, "http://a.example/b c", "<p>" + "é" * 600), (None, "http://a.example/7", "<p>" + "é" * 600),
         (None, "http://a.example/8", LONG), (9, "http://a.example/9", LONG), (10, "x", "HTTP/1.1 200 OK\r\n\r\nWARC/1.0\r\n\r\n" * 60)]


def plain_pages(pages):
    kept, out = defaultdict(list), []
    payload = lambda h: (h or "").encode()
    for page, _, html in pages:
        if len(payload(html)) >= 1000:
            kept[payload(html)].append(page)
    top = {k: max((p for p in v if p is not None), default=None) for k, v in kept.items()}
    answered = set()
    for page, _, html in pages:
        body = payload(html)
        digest, first = hashlib.sha1(body).hexdigest(), body not in top or (top[body] == page and body not in answered)
        if body in top and first:
            answered.add(body)
        out.append((page, len(body), digest, "response" if first else "revisit", None if first else top[body]))
    return Counter(out)


def test_pages_survive_both_formats(spark):
    rows = [(*p, "a", 1, "b") for p in PAGES]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive string, at int, `my col` string").repartition(2)
    assert Counter(map(tuple, archives.round_trip(pages).collect())) == plain_pages(PAGES)
    assert archives.round_trip(pages.limit(0)).count() == 0


def test_many_copies_refer_to_one(spark):
    pages = [(i, "u:x", "<p>" + "same " * 300) for i in range(500)] + [(i, "u:y", f"<p>{i} " * 300) for i in range(500, 520)]
    got = archives.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5))
    assert Counter(map(tuple, got.collect())) == plain_pages(pages)


@pytest.mark.parametrize("version", [1, 2])
def test_lines_by_version_lengths_and_damage(version):
    http = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nfirst\nhttp://not.a/record 1.1.1.1 20010101000000 text/html 5\nx"

    def line(url, date, mime, block):
        values = [url, "192.0.2.9", date, mime] + (["200", "-", "-", "0", "f.arc"] if version == 2 else []) + [str(len(block))]
        return " ".join(values).encode() + b"\n" + block + b"\n"

    damaged = b"no record line at all\n\x00\xff\n"
    data = archives._filedesc("f.arc", version, "20010203040506") + line("http://a b/1", "20010203040507", "text/html", http) + \
        damaged + line("dns:a", "2001", "text/dns", b"20010203\na 1") + line("ftp://x/y", "garbage", "text/plain", b"plain") + \
        line("http://last/", "20019903040507", "text/html", b"HTTP/1.0 200 OK\n\nbody")[:-3]
    found = list(archives.arc_records("f.arc", data))
    good = [r for r in found if r["record_id"]]
    assert [r["type"] for r in good] == ["warcinfo", "response", "response", "resource", "response"]
    assert [r["block"] for r in good[1:4]] == [http, b"20010203\na 1", b"plain"]
    assert [r["date"] for r in good[1:]] == ["2001-02-03T04:05:07Z", "2001-01-01T00:00:00Z"] + ["2001-02-03T04:05:06Z"] * 2
    assert good[1]["url"] == "http://a b/1" and good[1]["block"][good[1]["body_at"]:].startswith(b"first\n")
    assert [r["problem"] for r in found] == [None, None, "no record line", None, None, "block ends early"]
    warc = archives._converted("f.arc", data, {})
    back = list(archives.warc_records("f.warc", warc + b"\r\n\r\n"))
    assert [r["block"] for r in back[1:]] == [r["block"] for r in good[1:]]
    assert [dict(r["headers"]).get("WARC-Truncated") for r in back] == [None] * 4 + ["length"]
    assert len({r["record_id"] for r in back}) == len(back) and back[0]["type"] == "warcinfo"
    assert archives._plain(gzip.compress(data[:50]) + gzip.compress(data[50:])) == data


def test_dates():
    assert archives.iso_date("19990102030405") == "1999-01-02T03:04:05Z"
    assert archives.iso_date("199901") == "1999-01-01T00:00:00Z"
    assert archives.iso_date("19991301", "2000") == "2000-01-01T00:00:00Z"
    assert archives.iso_date("-") is None


# --------------------------------------------------------------------- tries

def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            text, role = text or "", role or ""
            turns[conv].append(((turn is not None, turn or 0), role, hashlib.md5(text.encode()).hexdigest(), text))
    turns = {c: [(t[1], t[3]) for t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(turns.get(c - int(c / 100) * 100 and int(c / 100) * 100 or (c if c % 100 == 0 else int(c / 100) * 100), [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = Counter(k[:-1] for k in members if k)
    out = []
    for k, cs in members.items():
        below = [x for x in members if x[:len(k)] == k]
        ends = ",".join(map(str, sorted(c for c in cs if whole[c] == k)))
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), children[k], sum(not children[x] for x in below),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def conversations():
    rng = random.Random(4)
    rows = [(0, i, "user", f"turn {i}") for i in range(7)] + [(100, 0, None, None), (100, None, "user", "first"), (100, 1, "a", "é漢")]
    for c in [*range(1, 40), *range(101, 140), 205, 206, -3, -150]:
        rows += [(c, i, rng.choice(["user", None]), rng.choice(["a", "b", "", None, "long " * 2000])) for i in range(rng.randint(1, 9))]
    rows += [(301, i, "user", str(i % 3)) for i in range(150)] + [(302, i, "user", str(i % 3)) for i in range(140)]
    rows += [(c, i, "u", "same") for c in range(20_000, 20_400, 4) for i in range(8)]
    rows += [(7, 1, "user", "twice")] * 2 + [(None, 1, "user", "nobody"), (8, None, None, None)]
    return rows


def test_nodes_equal_a_plain_trie(spark):
    rows = conversations()
    table = spark.createDataFrame([(*r, "x", "y", 0) for r in rows],
                                  "conv_id long, turn long, role string, text string, pos string, name string, `my col` int").repartition(3)
    got = Counter(map(tuple, tries.shared_prefixes(table).collect()))
    assert got == plain_trie(rows)
    assert tries.shared_prefixes(table.limit(0)).count() == 0


def test_nodes_beside_their_last_turn(spark):
    table = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "v", "b"), (2, 0, "u", "a")], "conv_id long, turn long, role string, text string")
    turns = tries.turns_in_order(table)
    nodes = tries.trie(tries.symbols(turns), turns.select("conv_id").distinct())
    assert sorted((r.depth, r.n_convs, r.text) for r in tries.with_last_turns(nodes, turns).collect() if r.depth) == [(1, 2, "a"), (2, 1, "b")]


def test_blocks_of_ids_hash_as_one_list(spark):
    ids = [*range(-20_000, 20_000, 3), 10**12]
    paths = spark.createDataFrame([(i, b"n", True) for i in ids], "conv_id long, name binary, ends boolean").repartition(4)
    want = hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    assert [r.ends_sha256 for r in tries.ends_of(paths).collect()] == [want]


# -------------------------------------------------------------- collocations

def plain_phrases(docs, least, top):
    counts = defaultdict(Counter)
    for text, lang in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 6):
                counts["und" if lang is None else lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(a for p, a in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q[i:j] for q, b in found.items() for i in range(len(q)) for j in range(i + 1, len(q) + 1)
                if j - i < len(q) and 100 * b >= 100 * f[q[i:j]]}
        rows = []
        for p, a in found.items():
            if p not in gone:
                score, _, left, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, r))
        out += [(lang, i + 1, p.decode(), -a, left, r, n, -s) for i, (s, a, p, left, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def documents():
    rng = random.Random(9)
    vocabulary = [w for w in "a A b c dé É f g the of x\x0by 漢字 the".split(" ")] + [f"w{i}" for i in range(30)]
    passage = "in no way at all"
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) + rng.choice(["", ", ", "\n", "!? "]) + rng.choice([passage, ""]) +
             rng.choice([" ", "\t", "."]) + " ".join(rng.choices(vocabulary[:6], k=rng.randint(0, 20))) for _ in range(300)]
    langs = [rng.choice(["en", "en", "en", "de", None, ""]) for _ in texts]
    return [*zip(texts, langs), (None, "en"), ("", None), ("a a a a a a a", "de"), (texts[3], langs[3]), (texts[3], langs[3]),
            ("b c " * 30_000, "fr"), ("x" * 500_000, "fr")]


@pytest.mark.parametrize("sample", [2, 1000])
def test_phrases_equal_plain_counting(spark, sample):
    """A sample of one in a thousand proposes next to nothing: the expansion has to find all."""
    docs = documents()
    table = spark.createDataFrame([(i, t, x, "h", 1, 2) for i, (t, x) in enumerate(docs)],
                                  "doc_id long, text string, lang string, phrase string, m int, `my col` int").repartition(4)
    frequent = collocations.materialise(collocations.frequent_phrases(table, 8, sample, ("doc_id", "text")), "frequent")
    got = collocations.collocations(frequent, 50)
    assert sorted(map(tuple, got.collect())) == plain_phrases(docs, 8, 50)


def test_no_documents_have_no_phrases(spark):
    assert collocations.mine(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_a_full_filter_changes_no_count(spark, monkeypatch):
    """A filter that holds everything lets every phrase be counted, and nothing else changes."""
    docs = documents()[:120]
    table = spark.createDataFrame(docs, "text string, lang string")
    plain = collocations._with
    monkeypatch.setattr(collocations, "_with", lambda bits, hashes: plain(bits, hashes) | collocations.np.uint64(2**64 - 1))
    got = collocations.mine(table, 5, 20)
    assert sorted(map(tuple, got.collect())) == plain_phrases(docs, 5, 20)


def test_scores_pass_64_bits(spark):
    rows = [("en", "", 0, 10**13), ("en", "a", 1, 10**12), ("en", "b", 1, 10**12), ("en", "a b", 2, 10**11)]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, phrase string, m int, a long")).first()
    assert got.score == 1000 * 10**11 * 10**13 // 10**24
