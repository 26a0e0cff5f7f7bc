"""The dealt operators against brute force on small rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import oracle
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pulse.llm import (
    byte_bpe,
    decontamination,
    language_id,
    license_scans,
    minhash_dedup,
    quality_rules,
    queries,
    token_ids,
    url_filters,
    warc,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "...", "a", "é漢😀 <|endoftext|> x", "word " * 3_000, "x" * 9_000]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, data, name):
    assert oracle.difference(queries.QUERIES[name](spark, data), oracle.database(data), queries.ORACLES[name]) is None


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES if n != "pipeline"} == set(range(1, 14))


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            inside.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed


def test_quality_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    texts = ODD + [r.text for r in docs] + ["a b c d e f g h i " * 3, "one two | three\none two | three\n"]
    for r in quality_rules.judge(frame(spark, texts)).collect():
        got = r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed
        assert got == brute_quality(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_quality_drops_bad_lines_and_keeps_clean_text(spark):
    prose = "\n".join(f"This plain{i} sentence number {i} has its{i} own words here." for i in range(9))
    menu = "Home | News | Sport | Contact | About | Help"
    rows = quality_rules.judge(frame(spark, [prose, prose + "\n" + menu, "\n".join(f"Home{i} | News{i} | Sport | About{i} | Help {i}" for i in range(9))])).collect()
    assert [r.kept for r in sorted(rows, key=lambda r: r.doc_id)] == [True, True, False]
    assert all(r.clean_text == prose for r in rows if r.doc_id < 2)


def test_quality_and_license_run_no_python(spark, data):
    for name in ("op4_quality_rules", "op6_url_filters", "op8_license_scans"):
        plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_language_by_all_segmentations():
    table = np.array([[0.5], [0.3], [0.2]])
    path = public_tokenizers.path("piece_bpe_32k.model")
    names = language_id.pieces_of(path)
    full = np.zeros((len(names), 1))
    for piece, p in zip(("▁a", "b", "▁ab"), table):
        full[names.index(piece)] = p
    score = float(np.exp(language_id.Scorer(path, full)._group(["▁ab"], 3)[0, 0]))
    assert score == pytest.approx(0.5 * 0.3 + 0.2, rel=1e-6)


def test_language_on_held_out_rows(spark, data):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    held = [r for r in queries.op5_language_id(spark, data).collect() if r.held_out]
    assert held and sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)


def test_language_edges(spark):
    docs = frame(spark, ODD)
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in range(4)) and got[7].lang_pred == "en"
    empty = docs.limit(0)
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(empty)).collect()} == {"und"}


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y", "http://net/es/", "http://a.net", "x://b.net/fr/1#z"]
    urls += ["http://notexample.com/en/", "http://a.www.example.com/en/", urls[4]]
    pages = spark.createDataFrame([(1 if i == 10 else i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rules = url_filters.rules_frame(spark, queries.RULES)
    got = Counter((r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages.union(pages), rules).collect())
    assert got == {
        ("", "", None, "allow"): 8,
        ("www.example.com", "/en/x", "www.example.com/en/", "allow"): 4,
        ("net", "/es/", "net/es/", "block"): 2,
        ("a.net", "", None, "allow"): 2,
        ("b.net", "/fr/1", "net/fr/", "block"): 2,
        ("notexample.com", "/en/", "com/", "allow"): 2,
        ("a.www.example.com", "/en/", "www.example.com/en/", "allow"): 2,
    }
    assert url_filters.judge(pages.limit(0), rules).count() == 0


def test_license_edges(spark):
    texts = ODD + ["Released under the MIT License. mit license, Apache-License", "mit xx license"]
    got = {r.doc_id: r for r in license_scans.scan(frame(spark, texts)).collect()}
    row = got[8]
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (9, 3, 3, 7)
    assert row.base_labels == "apache,mit" and row.labels == "apache,mit,mit-notice" and row.score == 1
    assert (got[9].n_base, got[9].first_word, got[9].labels, got[0].n_words) == (0, None, "", 0)


def test_license_near_misses(spark):
    """Usual words of a notice are no license; other notices of the same license are."""
    long = dict(t[:2] for t in license_scans.TEMPLATES)["bsd-text"]
    cases = [
        ("released under the apache license", "apache"),
        ("the album was released under the label", ""),
        ("under the terms of the gnu free documentation license", ""),
        ("under the terms of the gnu lesser general public license", "gpl"),
        ("licensed under the creative commons license version 2 0", ""),
        ("released under the x license of mit license fame", "mit"),
        ("distributed under the mit license", "mit,mit-notice"),
        ("licensed under the Apache License, Version 2.0", "apache,apache-notice"),
        ("version 2 of the GNU General Public License", "gnu-gpl,gpl,gpl-notice"),
        (long.replace("without modification", "without any modification"), "bsd-text"),
    ]
    got = {r.doc_id: r for r in license_scans.scan(frame(spark, [t for t, _ in cases])).collect()}
    assert {t: got[i].labels for i, (t, _) in enumerate(cases)} == dict(cases)
    short = [("x", "made under the blue license"), ("y", "one two three four five six seven eight nine ten eleven twelve thirteen")]
    texts = ["made under the blue license", "made under the red license", short[1][1].replace("ten ", "")]
    assert [r.labels for r in license_scans.scan(frame(spark, texts), templates=short).orderBy("doc_id").collect()] == ["x", "", "y"]


def brute_ids(texts):
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return encode, [encode.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_bpe_equals_the_library():
    rnd, bpe = random.Random(1), byte_bpe.codec(byte_bpe.default_path())
    parts = ["a", "é", "😀", " ", "  ", "\n", "\x1c", "\x85", "\u3000", "'s", "'", "<|endoftext|>", "1", "漢", "́", "!"]
    texts = ["".join(rnd.choices(parts, k=20)) for _ in range(300)]
    texts += ["".join(rnd.choices(p, k=6_000)) for p in (["a"], ["a", "b"], ["the", "ing"], ["é"], ["=", "-"], ["😀"], ["漢", "字"])]
    encode, want = brute_ids(texts)
    for text, ids in zip(texts, want):
        got = bpe.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == ids
        assert bpe.decode(got) == encode.decode(ids, skip_special_tokens=False)


def test_token_ids_against_brute_force(spark):
    _, want = brute_ids(ODD)
    start, expected = 0, set()
    for i, ids in enumerate(want):
        raw = np.asarray([*ids, 2], "<u4").tobytes()
        expected.add((i, start, len(ids) + 1, zlib.crc32(raw)))
        start += len(ids) + 1
    got = token_ids.round_trip(frame(spark, ODD)).collect()
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got} == expected
    assert token_ids.round_trip(frame(spark, ODD).limit(0)).count() == 0


def test_hash_index_is_minimal_and_perfect():
    keys = token_ids.numbered(sorted(random.Random(2).sample(range(-(10**12), 10**12), 3_000)) + ["a", "a", None, None])
    seeds, slots = token_ids.build(keys)
    assert sorted(slots) == list(range(3_004))
    with pytest.raises(ValueError):
        token_ids.build([(1, 0), (1, 0)])


@pytest.mark.parametrize("kind", ["long", "string", "date"])
def test_token_ids_of_any_key(spark, tmp_path, monkeypatch, kind):
    """Null, repeated and text ids in several shards: ascending order, and keyed reads across the shards."""
    import datetime

    monkeypatch.setattr(token_ids, "SHARD_BYTES", 300)
    make = {"long": lambda i: i - 20, "string": lambda i: f"k{i:03}", "date": lambda i: datetime.date(2020, 1, 1 + i % 28)}[kind]
    ids = [make(i) for i in range(60)] + [None, None, make(7), make(7)]
    texts = [" ".join(["word"] * (i % 37)) for i in range(60)] + [None, "x y z", "a b", "a b"]
    docs = spark.createDataFrame(list(zip(ids, texts, ["p"] * 64)), f"doc_id {kind}, text string, part string").repartition(5)
    shards = token_ids.write(docs, str(tmp_path / "shards"))
    _, want = brute_ids(texts)
    got = sorted(token_ids.read(shards).collect(), key=lambda r: r.start)
    keys = [r.doc_id for r in got]
    assert [k for k in keys if k is not None] == sorted(i for i in ids if i is not None) and keys[-2:] == [None, None]
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(w) + 1) for i, w in zip(ids, want))
    asked = [make(7), make(11), None]
    found = token_ids.fetch(shards, [*asked, make(7), {"long": 999, "string": "zz", "date": datetime.date(1999, 1, 1)}[kind]]).collect()
    plain = Counter((i, np.asarray([*w, 2], "<u4").tobytes()) for i, w in zip(ids, want) if i in asked)
    assert Counter((r.doc_id, bytes(r.ids)) for r in found) == plain


def test_hash_index_takes_few_hashes_per_key(monkeypatch):
    """A seed is given up at its first taken slot; all keys of a bucket were placed for every seed before."""
    from types import SimpleNamespace

    calls, plain = [0], token_ids.xxhash.xxh64_intdigest

    def counted(*args):
        calls[0] += 1
        return plain(*args)

    monkeypatch.setattr(token_ids, "xxhash", SimpleNamespace(xxh64_intdigest=counted))
    keys = token_ids.numbered(list(range(20_000)))
    seeds, slots = token_ids.build(keys)
    assert sorted(slots) == list(range(20_000)) and calls[0] < 80 * len(keys)


@pytest.mark.parametrize("size", [1, 100, 4 << 20])
def test_bpe_of_a_column_equals_the_library(monkeypatch, size):
    """Cuts by bytes are those of the library, next to any blank or sign, across texts and parts of a column."""
    monkeypatch.setattr(byte_bpe, "PART", size)
    rnd, bpe = random.Random(3), byte_bpe.ByteBpe(byte_bpe.default_path())
    parts = ["a", "Bc", " the", "é", "漢", "²", "५", "Ⅷ", "1", "_", "'s", "'", "(", ")", '"', *".,;:!?", *"      ", "\n", "\t", "\x1c"]
    parts += ["\x85", "\xa0", "\u1680", "\u2003", "\u205f", "\u3000", "\u200b", "’", "、", "\u0301", ", ", ".\n"]
    texts = [None, "", "", *("".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(3_000)), "", None, " " * 50, "word" * 20, "x" * 3_000]
    for more in (texts, [*texts[:50], "a<|endoftext|> b"], [None], []):
        _, want = brute_ids(more)
        column = pa.array(["left out", *more, "left out"], pa.string()).slice(1, len(more))
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_all(column)] == want


def test_token_ids_look_up_each_word_of_a_column_once(monkeypatch):
    """A word that comes again, with a sign or without, is no new lookup."""
    bpe, asked = byte_bpe.ByteBpe(byte_bpe.default_path()), []
    monkeypatch.setattr(bpe, "_word", lambda w, plain=bpe._word: asked.append(w) or plain(w))
    list(bpe.encode_all(pa.array([f"so wordy wordy{s} wordy wordy{s}\nso" for s in ".,;:!?"] * 50)))
    assert sorted(asked) == sorted(["so", " wordy", "\n", *".,;:!?"])


def test_token_ids_run_one_python_worker_per_task(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    shards = token_ids.write(docs, str(tmp_path / "shards"))
    plan = token_ids.read(shards)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_encoded_digests_against_brute_force(spark):
    encode, want = brute_ids(ODD)
    got = {r.doc_id: r for r in byte_bpe.digests(frame(spark, ODD + [ODD[5]])).collect()}
    for i, ids in enumerate([*want, want[5]]):
        decoded = encode.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert byte_bpe.digests(frame(spark, [])).count() == 0


def test_quality_filter_cuts_each_text_once(spark):
    """A filter on the verdict stays above the rules, so a long text takes time in proportion."""
    import time

    long = " ".join(f"w{i}" for i in range(20_000))
    docs = frame(spark, [long + ".", None, "short"]).withColumn("_words", F.lit("mine")).withColumn("kept", F.lit("old"))
    judged = quality_rules.judge(docs).where("kept")
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(quality_rules.WORD) == 1
    begin = time.time()
    assert [(r.doc_id, r._words) for r in judged.collect()] == [(0, "mine")]
    assert time.time() - begin < 20


def test_signatures_are_unbiased():
    rnd = random.Random(3)
    a = Counter({rnd.getrandbits(64): rnd.randint(1, 9) for _ in range(200)})
    b = Counter({k: max(1, v + rnd.randint(-2, 3)) for k, v in a.items() if rnd.random() < 0.9})
    same = np.mean(minhash_dedup.signature(a, 4_096) == minhash_dedup.signature(b, 4_096))
    assert same == pytest.approx(minhash_dedup.similarity(a, b), abs=0.03)


def test_groups_of_near_copies(spark):
    rnd = random.Random(4)
    make = lambda: [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    base, other = make(), make()
    near = [base, base, [*base[:60], "new", *base[61:]], [*base[:100], "more", *base[101:]], other]
    texts = ["", None, *(" ".join(x) for x in near)]
    bags = [minhash_dedup.shingles(t) for t in texts]
    assert all(minhash_dedup.similarity(bags[2], bags[i]) >= 0.8 for i in (3, 4, 5))
    got = {r.doc_id: r.class_id for r in minhash_dedup.classes(frame(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2, 5: 2, 6: 6}


def test_leaks_against_brute_force(spark, data):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    parts = [(r.item_id, decontamination.grams(decontamination.words_of(r.text))) for r in items.collect()]
    want = set()
    for r in docs.collect():
        mine = decontamination.grams_in(decontamination.words_of(r.text), {5})
        want |= {(r.doc_id, i) for i, g in parts if g and len(g & mine) >= 0.5 * len(g)}
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()}
    assert want and want <= got
    assert decontamination.leaks(frame(spark, ODD), items).count() == 0
    assert decontamination.leaks(docs, items.limit(0)).count() == 0


def test_leaks_of_quoted_spans_are_all_found(spark, data):
    """Answers, halves, spans and scattered pieces of items, alone and between other words: both branches."""
    rnd, items = random.Random(3), spark.read.parquet(f"{data}/benchmark.parquet")
    listed = [(r.item_id, r.text) for r in items.collect()] + [
        (900, "the the the the the the zebra crossing is wide. The road is the road."),
        (901, "one two three"),
        (902, "Which of them is it, the one of the first or of the last? Yes."),
    ]
    other = [w for _, t in listed for w in decontamination.words_of(t)]
    fill = lambda n: [rnd.choice(other) for _ in range(n)]
    texts = []
    for _, text in listed:
        words = decontamination.words_of(text)
        answer = decontamination.words_of(re.split(r"(?<=[.?!])\s+", text.strip())[-1])
        half = len(words) // 2
        quotes = [[answer], [words[:half]], [words[half:]], [words[: half + 5]], [words[i : i + 7] for i in range(0, len(words), 8)]]
        quotes += [[words[i : i + rnd.randrange(5, len(words) + 6)]] for i in (rnd.randrange(max(1, len(words) - 5)) for _ in range(6))]
        for quote in quotes:
            texts.append(" ".join(w for q in quote for w in [*q, *fill(150)]))
            texts.append(" ".join(w for q in quote for w in q))
    parts = []
    for i, text in listed:
        words = decontamination.words_of(text)
        sentences = [s for s in re.split(r"(?<=[.?!])\s+", text.strip()) if decontamination.words_of(s)]
        parts.append((i, decontamination.grams(words), decontamination.grams(decontamination.words_of(sentences[-1]))))
    want, by_answer = set(), 0
    for d, text in enumerate(texts):
        mine = decontamination.grams_in(decontamination.words_of(text), {1, 2, 3, 4, 5})
        for i, whole, answer in parts:
            q, a = len(whole & mine) / len(whole), len(answer & mine) / len(answer)
            if q >= 0.5 or (a >= 0.5 and q >= 0.25):
                want.add((d, i))
                by_answer += q < 0.5
    found = decontamination.leaks(frame(spark, texts), spark.createDataFrame(listed, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert by_answer and got == want


def test_archive_records_are_linked():
    rows = warc.derive(1, "http://a/", "<p>A&amp;B<script>x</script><a href='/c'>c</a></p>")
    (_, source, _), (_, _, meta), (_, _, text) = rows
    assert all(f"WARC-Refers-To: {source}".encode() in r for r in (meta, text))
    assert b"outlink: /c" in meta and text.endswith(b"\r\n\r\nA&B c\r\n\r\n")
    assert len(warc.derive(None, None, None)) == 3


def test_pipeline_runs_on_rows_with_nulls(spark, tmp_path):
    prose = " ".join(f"Word{i} and other{i}." for i in range(40))
    docs = frame(spark, [*ODD, prose, prose])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing like it at all.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [8]


def test_pipeline_keeps_rows_without_ids_and_repeats_once(spark, tmp_path):
    """No labelled row, null ids with and without copies, repeated rows, one id on two texts."""
    prose = lambda k: " ".join(f"Word{k}x{i} and other{k}y{i}." for i in range(40))
    leak = "Which of the seven quiet rivers runs north past the old mill? The green one does so."
    rows = [(None, prose(0)), (3, prose(1)), (3, prose(1)), (3, prose(1)), (None, prose(1)), (5, prose(1) + " end")]
    rows += [(None, prose(2)), (None, prose(2)), (7, prose(3)), (7, prose(4)), (None, prose(5) + " " + leak), (7, prose(6) + " " + leak), (-4, prose(3) + " end"), (9, "...")]
    docs = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in rows], DOCS)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, here = docs, str(tmp_path)
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, kept, here).write.parquet(f"{here}/{name}")
        kept = spark.read.parquet(f"{here}/{name}")
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert got == sorted([(0, prose(0)), (3, prose(1)), (0, prose(2)), (7, prose(4)), (-4, prose(3) + " end")])
    assert corpus_pipeline.run(spark, here).count() == 5


def test_groups_lose_no_link_of_unlike_neighbours(spark):
    """Chains, a shared passage and short texts: the same groups as all pairs compared."""
    rnd = random.Random(11)
    make = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    common, texts = make(150), []
    for _ in range(40):  # one passage shared by unlike texts, each with a near copy
        own = make(60)
        texts += [[*common, *own], [*common, *own[:-2]]]
    chain = make(100)
    for _ in range(25):  # each text is like the one before, the ends are unlike
        chain = [*chain[5:], *make(5)]
        texts.append(chain)
    texts += [["a", "b"], ["a", "b"], ["b", "a"], ["x"] * 300, ["x"] * 310, ["x"] * 600]
    rnd.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    bags = [minhash_dedup.shingles(t) for t in texts]
    want = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if minhash_dedup.similarity(bags[a], bags[b]) >= 0.8 and want[a] != want[b]:
                lo, hi = sorted((want[a], want[b]))
                want = [lo if w == hi else w for w in want]
    got = {r.doc_id: r.class_id for r in minhash_dedup.classes(frame(spark, texts)).collect()}
    assert got == dict(enumerate(want))


def test_groups_of_empty_tables_and_rows_without_ids(spark):
    assert minhash_dedup.classes(frame(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, None), (None, "a b"), (3, "a  b")], "doc_id long, text string")
    got = sorted(minhash_dedup.classes(rows).collect(), key=str)
    assert [(r.doc_id, r.class_id) for r in got] == [(3, 3), (None, 3), (None, None)]
