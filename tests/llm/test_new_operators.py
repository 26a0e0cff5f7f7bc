"""Filter audit, vector codes and repeated strings against brute force on small rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulse.llm import filter_audit, queries, suffix_dedup, vector_codes

DOCS = "doc_id long, text string, source string, mask string, _n string"
LABELS = "doc_id long, quality int, toxic int"


def audit_of(spark, docs, labels):
    counts = filter_audit.failures(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    return {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(counts).collect()}


def brute_audit(docs, labels):
    import re

    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    rows = []
    for i, text, source, *_ in docs:
        text, words = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in docs),
        }
        rows.append((source or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[part, f] += len(gone)
                redundant = sum(f in r[1] for r in mine) - len(gone)
                unique = sum(r[1] == {f} for r in mine)
                out[part, "".join(order), step] = (len(left), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_brute_force(spark):
    rng = random.Random(5)
    long = " ".join(f"w{i}" for i in range(230))
    texts = [None, "", long, long + " #", "A B C", "a " * 250, "a " * 250 + "$", long.upper(), "é漢😀 x", " \t\n"]
    docs = [(i, rng.choice(texts), rng.choice(["s", "t", "", None]), "m", "n") for i in range(60)]
    docs += [(3, docs[3][1], "s", "m", "n"), docs[4], docs[4], (None, long, "s", "m", "n"), (None, "", "t", None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (999, 1, 1)]
    got = audit_of(spark, docs, labels)
    want = brute_audit(docs, labels)
    assert set(got) == set(want)
    for key, row in got.items():
        assert (row.kept, row.removed, row.redundant, row.unique_fails, row.good_lost, row.toxic_lost, row.shapley) == want[key]


def test_audit_of_an_empty_table(spark):
    assert audit_of(spark, [], []) == {}


def test_shapley_weights_are_those_of_the_formula():
    from math import comb

    for i, row in enumerate(filter_audit.shapley_weights()):
        for s, weight in enumerate(row):
            size = s.bit_count()
            inside = Fraction(1, 5 * comb(4, size - 1)) if s >> i & 1 else -Fraction(1, 5 * comb(4, size)) if size < 5 else 0
            # The empty coalition has the value 0, so its weight does not matter.
            assert weight == inside or s == 0


def brute_codes(vectors):
    """Codes, errors and codebooks of integer vectors in id order."""
    parts = vectors.reshape(len(vectors), 16, -1).transpose(1, 0, 2)
    books = parts[:, :64].copy()

    def nearest():
        return ((parts[:, :, None, :] - books[:, None, :, :]) ** 2).sum(-1)

    for _ in range(2):
        codes = nearest().argmin(-1)
        for p in range(16):
            for e in range(books.shape[1]):
                mine = parts[p][codes[p] == e]
                if len(mine):
                    books[p, e] = [sum(int(x) for x in mine[:, i]) // len(mine) for i in range(mine.shape[1])]
    apart = nearest()
    return apart.argmin(-1), apart.min(-1).sum(0), books


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string"


@pytest.mark.parametrize("kind", ["clustered", "tied", "few", "wide"])
def test_codes_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    n, width = {"clustered": (5_000, 64), "tied": (700, 16), "few": (20, 64), "wide": (300, 160)}[kind]
    if kind == "clustered":
        x = rng.normal(size=(12, width))[rng.integers(0, 12, n)] + rng.normal(scale=0.02, size=(n, width))
    elif kind == "tied":
        x = rng.integers(-3, 4, (n, width)) / 256
    else:
        x = rng.normal(size=(n, width))
    x = x.astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], None if i % 7 == 0 else i % 3, "c", "e") for i in range(n)]
    bad = [(-1, None, 1, "c", "e"), (-2, [float("nan")] * width, 1, "c", "e"), (-3, [None] * width, 1, "c", "e"), (-4, [float("inf")] + [0.0] * (width - 1), 1, "c", "e")]
    frame = spark.createDataFrame(rows + bad, VECTORS).repartition(5)
    got = {r.vec_id: r for r in vector_codes.with_label_errors(vector_codes.compress(frame)).collect()}
    codes, errors, books = brute_codes(np.floor(x.astype(np.float64) * 256).astype(np.int64))
    assert sorted(got) == list(range(n))
    sums = Counter()
    for i in range(n):
        sums[rows[i][2]] += int(errors[i])
    digest = hashlib.sha256(",".join(str(v) for v in books.reshape(-1)).encode()).hexdigest()
    for i in range(n):
        assert got[i].code == "".join(f"{c:02x}" for c in codes[:, i]) and got[i].error == errors[i]
        assert got[i].label_error == sums[rows[i][2]] and got[i].codebooks_sha256 == digest


def test_whole_nodes_are_assigned_from_cached_sums():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2_000, 2_000, (1, 64, 4))
    values = centres[:, rng.integers(0, 64, 4_096)] + rng.integers(-4, 5, (1, 4_096, 4))
    _, sums, counts, seen = vector_codes.assign(values, centres)
    assert counts.sum() == 4_096 and (sums.sum(1) == values.sum(1)).all()
    assert seen["whole"] > 60 and seen["compared"] < 4_096 * 64 / 4


def test_codes_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.with_label_errors(vector_codes.compress(empty)).count() == 0
    rows = [(1, [], None, "", ""), (None, [1.0, 2.0], 2, "", ""), (1, [0.5] * 17, 2, "", ""), (2, [3e38], 2, "", ""), (2, [3e38], 2, "", "")]
    got = vector_codes.compress(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == 5 and all(len(r.code) == 32 and r.error == 0 for r in got)


def brute_repeats(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé漢 ") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other, line = prose(80), prose(60), prose(30)
    texts = [None, "", "x" * 199, "x" * 200, "x" * 200, "y" * 3_000, "ab" * 700, "ab" * 150 + "c", passage, other * 3]
    texts += [prose(40) + passage + prose(30) for _ in range(12)]
    texts += [prose(5) + passage[i : i + 260] + prose(9) for i in range(0, 90, 7)]
    texts += [passage[:150] + "#" + passage[150:], passage[:220] + "#" + passage[220:], other, other, other + "!"]
    texts += [line + prose(60) + line + line + prose(3) for _ in range(4)]
    return texts + [prose(400) for _ in range(5)] + [texts[12]] * 3


def rows_of(spark, texts):
    ids = [None if i == 13 else 14 if i in (14, 15) else i for i in range(len(texts))]
    return spark.createDataFrame([(i, t, "s", "m", "n") for i, t in zip(ids, texts)], "doc_id long, text string, h string, d string, places string"), ids


@pytest.mark.parametrize("setting", ["whole", "small collections", "small pieces", "hot anchors"])
def test_repeats_against_brute_force(spark, monkeypatch, setting):
    texts = repeat_texts()
    if setting == "hot anchors":
        monkeypatch.setattr(suffix_dedup, "HOT", 3)
    docs, ids = rows_of(spark, texts)
    if setting == "whole":
        got = suffix_dedup.digests(docs).collect()
        want = brute_repeats(texts)
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((i, *w) for i, w in zip(ids, want))
    elif setting == "hot anchors":
        got = suffix_dedup.digests(docs).collect()
        assert Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in got) == Counter((i, w[1], w[3]) for i, w in zip(ids, brute_repeats(texts)))
    else:
        # The parts inside a task, with bounds far below the usual ones.
        monkeypatch.setattr(suffix_dedup, "CHUNK", 300 if setting == "small pieces" else 1 << 20)
        assert local_repeats(texts) == [w[1] for w in brute_repeats(texts)]


def local_repeats(texts):
    """Bytes removed from every text, by the functions that run inside tasks."""
    import pyarrow as pa

    column = pa.array([t or "" for t in texts])
    groups, places = {}, []
    for data, starts, ends, rows, offsets in suffix_dedup._pieces(column):
        text, window, n, h = suffix_dedup.segments_of(data, starts, ends)
        for t, w, m, key in zip(text, window, n, h.view(np.int64).tolist()):
            content = bytes(data[w : w + m + 199])
            groups.setdefault(key, Counter())[content] += 1
            places.append((int(rows[t]), int(w - starts[t] + offsets[t]), key, content))
    runs = {}
    for key, kinds in groups.items():
        distinct = list(kinds)
        for content, found in zip(distinct, suffix_dedup.repeated_windows([key] * len(distinct), distinct)):
            runs[key, content] = found if kinds[content] == 1 else [{"a": 0, "b": len(content) - 200}]
    held = [[] for _ in texts]
    for row, at, key, content in places:
        held[row].extend(at + r[x] for r in runs[key, content] for x in "ab")
    return [suffix_dedup.cut((t or "").encode(), np.array(p, np.int64))[1] for t, p in zip(texts, held)]


def test_columns_are_the_suffix_order_of_the_collection():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    built = suffix_dedup.Columns(texts)
    suffixes = sorted(((list(t[i:]) + [-1], n, i) for n, t in enumerate(texts) for i in range(len(t) + 1)), key=lambda x: ([c if c >= 0 else x[1] - 10**6 for c in x[0]]))
    before = [texts[n][i - 1] if i else suffix_dedup.END for _, n, i in suffixes]
    common = [0]
    for (a, _, _), (b, _, _) in zip(suffixes, suffixes[1:]):
        k = 0
        while a[k] == b[k] and a[k] >= 0:
            k += 1
        common.append(k)
    assert built.bwt.tolist() == before and built.lcp.tolist() == common


def test_repeats_of_an_empty_table(spark):
    docs, _ = rows_of(spark, [])
    assert suffix_dedup.digests(docs).count() == 0


def test_a_very_long_text_takes_pieces(spark):
    rng = random.Random(4)
    body = "".join(rng.choice("abcdefghij ") for _ in range(3_000_000))
    texts = [body, "z" + body[1_500_000:1_500_900] + "z"]
    got = {r.doc_id: r for r in suffix_dedup.digests(rows_of(spark, texts)[0]).collect()}
    assert got[0].n_removed == 900 and got[0].n_spans == 1 and got[1].n_removed == 900 and got[1].n_bytes == 902


def test_url_rules_against_brute_force(spark):
    """Rules with and without paths, nested hosts, equal lengths."""
    from pulse.llm import url_filters

    rng = random.Random(8)
    hosts = ["com", "b.com", "a.b.com", "net", "x.net", "b", "ab.com"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/b"]
    for round_ in range(4):
        rules = list({(rng.choice(hosts), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(9)}.items())
        rules = [(h, p, v) for (h, p), v in rules] + ([("com", "", "allow"), ("com", "/a", "block"), ("b.com", "/en/", "block")] if round_ == 0 else [])
        rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
        urls = ["http://" + rng.choice(["", "w.", "w.a."]) + rng.choice(hosts) + rng.choice(paths + ["/aa", "/a/bc", "/zz"]) for _ in range(60)]
        pages = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, "http://b.com" + "/a" * 5_000])], "page_id long, url string")
        got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(pages, url_filters.rules_frame(spark, rules)).collect()}
        for i, url in enumerate([*urls, "http://b.com" + "/a" * 5_000]):
            host, _, path = url[7:].partition("/")
            path = "/" + path if _ else ""
            fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if ("." + host).endswith("." + h) and path.startswith(p)]
            assert got[i] == (max(fits)[2:] if fits else (None, "allow")), url


def test_items_without_an_id(spark):
    from pulse.llm import decontamination

    leak = "Which of the seven quiet rivers runs north past the old mill? The green one does so."
    items = spark.createDataFrame([(None, leak), (2, leak), (2, leak), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " + leak + " after"), (None, leak)], "doc_id long, text string")
    found = Counter((r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect())
    assert set(found) == {(1, None), (1, 2), (None, None), (None, 2)}


def test_pages_take_time_in_proportion():
    import time

    from pulse.llm import warc

    for odd in ("<a ", "<script>", "<!-- ", "<", "<p", "</script", "<style><a href=x"):
        begin = time.time()
        warc.derive(1, "u", odd * (1_000_000 // len(odd)))
        assert time.time() - begin < 2, odd


def test_page_text_and_links():
    from pulse.llm import warc

    page = "<title>T</title><p>one <b>two</b><!-- no <a href=n> --><br>three &amp; <script>var x = '<a href=q>'</script >end<a class=k href='l1'>x</a><a href=l2>"
    assert warc.scan(page) == ("T\none two\nthree & endx", ["l1", "l2"])
    assert warc.scan("a < b <!-- open <p>c") == ("a < b c", []) and warc.scan("x <script>y") == ("x y", []) and warc.scan("a < b") == ("a < b", [])


def test_archive_records_against_the_page(spark, data):
    """Three linked records per page: lengths, digests and refers-to ids hold, payloads are the pages'."""
    import base64
    import hashlib as hl

    from pulse.llm import warc

    sha = lambda b: "sha1:" + base64.b32encode(hl.sha1(b).digest()).decode()
    pages = spark.read.parquet(f"{data}/pages.parquet").withColumn("record", F.lit(1))
    extra = spark.createDataFrame([(-1, None, None, 1), (-2, "u\r\nX: y", "", 1), (-2, "u\r\nX: y", "", 1)], pages.schema)
    by_page = {}
    for r in warc.derivatives(pages.unionByName(extra)).collect():
        by_page.setdefault(r.page_id, []).append(r)
    html = {r.page_id: r.html or "" for r in pages.unionByName(extra).collect()}
    assert set(by_page) == set(html) and all(len(v) == (6 if k == -2 else 3) for k, v in by_page.items())
    for page, records in by_page.items():
        source = next(r.record_id for r in records if r.warc_type == "response")
        for r in records:
            head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            block = rest[:-4]
            assert int(fields["Content-Length"]) == len(block) and fields["WARC-Block-Digest"] == sha(block)
            assert fields["WARC-Record-ID"] == r.record_id and rest.endswith(b"\r\n\r\n") and "X" not in fields
            if r.warc_type == "response":
                assert block.partition(b"\r\n\r\n")[2] == html[page].encode() and fields["WARC-Payload-Digest"] == sha(html[page].encode())
            else:
                assert fields["WARC-Refers-To"] == source
            if r.warc_type == "conversion":
                assert block.decode() == warc.plain_text(html[page]) and "<p" not in block.decode()
    assert warc.derivatives(pages.limit(0)).count() == 0


def test_new_queries_are_registered():
    assert {"op11_filter_audit", "op12_vector_codes", "op13_suffix_dedup"} <= set(queries.QUERIES) & set(queries.ORACLES)
