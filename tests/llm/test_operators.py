"""Each operator on small fixtures against brute force, with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.llm import decontam, media, neardup, packing, pii, sharding, suffixes, tokens, toxicity, warc
from meterline.llm.bytewords import NOT_BLANK, Words
from meterline.llm.words import Encoder

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 97} tail{i % 13}" for i in range(40_000))


def docs(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, [None, "", " ", "one", "Ünïcode é 😀 <|endoftext|> don't", LONG, LONG, "x" * 70_000, "a b c d e f g h"])


# ---- 1 ----

def removed(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for r in raw:
        for j in range(len(r) - length + 1):
            seen[r[j : j + length]] = seen.get(r[j : j + length], 0) + 1
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for j in range(len(r) - length + 1):
            if seen[r[j : j + length]] > 1:
                gone[j : j + length] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("gather", [suffixes.GATHER, 1])
def test_repeated_strings(spark, gather):
    rng = np.random.default_rng(3)
    base = "".join(map(chr, rng.integers(97, 101, 2500)))
    texts = [base[:500], base[100:299], base[100:300], base[150:800] + "x" + base[800:1200], "a" * 900, "ab" * 150, "ab" * 99, None, "", base[2000:2200] + "é" + base[2000:2200], "é" * 300, "zz" + base[1000:1250] + "yy", "qq" + base[1000:1250] + "pp", "abc" * 70 + base[3:220]]
    df = docs(spark, texts).withColumn("kept", F.lit("clash")).withColumn("k1", F.lit(1))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.remove_repeats(df, gather=gather).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts)


def test_repeated_rows_long_texts_and_empty_table(spark, odd):
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(odd).collect()}
    n = len(LONG.encode())
    assert got[5] == got[6] == (n, n) and got[7] == (70_000, 70_000) and got[0] == (0, 0)
    twice = docs(spark, ["q" + "".join(map(str, range(300)))])
    assert {r.n_removed for r in suffixes.remove_repeats(twice.unionByName(twice)).collect()} == {791}
    assert suffixes.remove_repeats(odd.limit(0)).count() == 0


# ---- 2 ----

def component(texts, k, t=80):
    sets = []
    for x in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    low = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return [(len(s), c) for s, c in zip(sets, low)]


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    base = list(rng.choice(words, 120))
    texts = [None, "", "one", "ONE", "one two", " ".join(base)]
    for edits in [0, 1, 2, 3, 4, 5, 6] * 5:
        w = list(base)
        for at in rng.choice(120, edits, replace=False):
            w[at] = f"n{rng.integers(1e6)}"
        texts.append(" ".join(w))
    texts += [" ".join(rng.choice(words, 60)) for _ in range(10)]
    df = docs(spark, texts).withColumn("component_id", F.lit("clash")).withColumn("node", F.lit(0))
    got = {r.doc_id: r for r in neardup.near_duplicates(df, shingle=4).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == component(texts, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert got[5].text == texts[5] and got[0].text is None and "node" in got[5].asDict()


def test_near_duplicates_of_odd_texts(spark, odd):
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(odd).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8}
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_sketches_bound_and_estimate():
    w = Words([" ".join(f"a{i}" for i in range(500)), " ".join(f"a{i}" for i in range(40, 500))], NOT_BLANK)
    a, b = neardup.shingle_sets(w, 5)
    pop = lambda x: sum(bin(int(v) & 0xFFFFFFFFFFFFFFFF).count("1") for v in x)
    p = neardup.set_parities([a, b])
    assert pop(p[0] ^ p[1]) <= len(np.setxor1d(a, b))
    s = neardup.odd_sketches(np.array([neardup.minhash(a), neardup.minhash(b)]))
    flips, m, k = pop(s[0] ^ s[1]), neardup.SKETCH_BITS, neardup.SAMPLES
    estimate = 1 + m / (4 * k) * np.log(1 - 2 * flips / m)
    assert estimate == pytest.approx(len(np.intersect1d(a, b)) / len(np.union1d(a, b)), abs=0.1)


def test_recall_of_bands_and_sketch():
    """Pairs of sets at exactly 0.8: nearly all share a band, and the sketch rejects none."""
    rng = np.random.default_rng(17)
    missed = rejected = 0
    for size in (9, 18, 45, 90):
        for _ in range(1500):
            each = size // 9  # 8 parts shared, 1 of its own on each side: 8 / 10
            x = rng.integers(0, 1 << 63, 10 * each, dtype=np.uint64)
            v = np.array([neardup.minhash(x[: 9 * each]), neardup.minhash(np.concatenate([x[: 8 * each], x[9 * each :]]))])
            bands, s = neardup.band_keys(v), neardup.odd_sketches(v)
            missed += not (bands[0] == bands[1]).any()
            rejected += int(np.bitwise_count((s[0] ^ s[1]).view(np.uint64)).sum()) > neardup.most_flips(0.8)
    assert missed <= 2 and rejected == 0


@pytest.mark.parametrize("part", [1, 3])
def test_large_buckets_are_dealt_by_parts(spark, monkeypatch, part):
    monkeypatch.setattr(neardup, "PART_ROWS", part)
    monkeypatch.setattr(neardup, "CENTRES", (1, None) if part == 1 else (1, 2, None))
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(300)]
    base = list(rng.choice(words, 100))
    texts = []
    for i in range(40):
        w = list(base)
        for at in rng.choice(100, rng.integers(0, 8), replace=False):
            w[at] = f"n{rng.integers(1e6)}"
        texts.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, texts), shingle=4).collect()}
    assert [got[i] for i in range(len(texts))] == component(texts, 4)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 20)] + [(50, 60)], "a long, b long")
    got = {r.node: r.label for r in neardup.components(edges).collect()}
    assert {got[i] for i in range(21)} == {0} and got[60] == 50


# ---- 3 and 8 ----

def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def test_token_counts_are_the_library_s(spark, odd):
    t = library()
    df = odd.withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()}
    want = [len(t.encode(x or "", add_special_tokens=False).ids) for x in (r.text for r in odd.orderBy("doc_id").collect())]
    assert [got[i] for i in range(9)] == want
    assert tokens.token_counts(odd.limit(0)).count() == 0
    assert [r.n_tokens for r in tokens.token_counts(docs(spark, ["plain words words"] * 3 + ["слово слово plain"]), entries=1).collect()] == [3, 3, 3, len(t.encode("слово слово plain").ids)]


def test_token_count_digest(spark):
    t = library()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in tokens.op3_token_counts(spark, DATA).collect():
        n = len(t.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_encoder_is_the_library_s():
    t, e = library(), Encoder(tokens.vocabulary_path(), False)
    odd = ["<|endoftext|> a <|ENDOFTEXT|>", "don't I'LL ''s !'s 12½ª² ǅ ŉ ß x\x85y\x1cz ΣΑΣ é́ ​", "İI", "x" * 3000 + " 1234567" * 10, "a\x00b", "…–—‘’“”€ „x", "'" * 50 + "s", "don’t\t\n  'RE we'Ve", "Ελλάδα Σ ΟΔΟΣ καλή-μέρα ПРИВЕТ мир’s don't", "漢字 かな a漢b 12漢 한국어 ", "a \u0301b e\u0301 \u0301", "x\u200by Ａ１ ﬁ \u2028z \u3000q", "🙂 a🙂's 'S🙂 مرحبا १२३"]
    rng = np.random.default_rng(11)
    signs = list("abZ'sS ,.1²é\u0301\u0327Σςσ漢🙂\u200d\xa0\u2003\x85\x1c\t\nİǅſK") + ["'re", " ", "  "]
    odd += ["".join(rng.choice(signs, rng.integers(1, 40))) for _ in range(3000)]
    for x, got in zip(odd, e.batch(odd)):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_packing_is_lossless_and_tight(spark, odd):
    t = library()
    rows = packing.pack_documents(odd.repartition(3), opened=2).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for r in odd.collect():
        want = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        parts = sorted(by_doc[r.doc_id], key=lambda p: p.start)
        assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == want
        assert {p.doc_tokens for p in parts} == {len(want)} and [p.start for p in parts] == np.cumsum([0] + [p.length for p in parts])[:-1].tolist()
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert packing.pack_documents(odd.limit(0)).count() == 0


# ---- 4 ----

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(n if i % 2 == 0 else 2 * n - 9 * (2 * n > 9) for i, n in enumerate(map(int, reversed(d))))
        return 16 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in FORMS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def test_base_spans(spark):
    texts = [
        "a@b.c_d@e.f x@y a@b..c %@a.b", "4111111111111111 4111-1111-1111-1111 x 4111 1111 1111 1111 1 41111111111111111111111", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.0255 1..2.3.4 5.6.7.8.",
        "+1 (017) 555-7713 +12 +1234567 +1.2.3.4.5.6.7.8.9.0 ++1 2345678- é+49 30 1234567", "é😀 a@b.co 4111111111111111😀+49 30 1234567", None, "", "@@a@b.c@d.e.f", "1" * 5000 + " a.b@" + "x" * 3000,
    ]
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(docs(spark, texts).withColumn("base", F.lit("clash")))).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i].spans == ",".join(want)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert got[i].n_email == sum(w.startswith("email") for w in want)


def test_contexts_find_what_forms_miss(spark):
    texts = [f"contact: user{i}@mail.com then" for i in range(30)] + [f"order: Q{i}77-x {i}" for i in range(9)] + ["the contact: Jane77-office here", "plain 123456 text"]
    out = {r.doc_id: r.spans for r in pii.digest(pii.find_pii(docs(spark, texts))).collect()}
    assert out[39] == "context:13:26" and out[40] == "" and all(out[i] == "" for i in range(30, 39))
    masked = {r.doc_id: r.text for r in pii.redact(pii.find_pii(docs(spark, texts))).collect()}
    assert masked[0] == "contact: [EMAIL] then" and masked[39] == "the contact: [CONTEXT] here" and masked[40] == texts[40]


def test_wider_contexts(spark):
    texts = [f"please write to my address user{i}@mail.com soon ok" for i in range(30)] + ["Please write to my address (jane-office-77) soon", "no address jane77-office here", "a b c reach me at +49 30 12345%02d now" % 1]
    texts += [f"you may reach me at +49 30 12345{i} today then" for i in range(10, 20)] + ["you may reach me at ext-5512-b today", "x" * 90 + "1 z", "please write to my address " + "y7" * 60]
    out = {r.doc_id: r.spans for r in pii.digest(pii.find_pii(docs(spark, texts))).collect()}
    assert out[30] == "context:28:42" and out[31] == "" and out[43] == "context:20:30" and out[44] == "" and out[45] == "context:27:147"


def graph(edges, rounds, support, confidence):
    """learn_contexts over (label, value, seed), in plain Python."""
    score = {}
    for _, v, s in edges:
        score[v] = max(score.get(v, 0.0), s)
    seeds, labels = dict(score), {}
    for lab, v, s in edges:
        labels.setdefault(lab, {})[v] = max(labels.get(lab, {}).get(v, 0.0), s)
    labels = {k: v for k, v in labels.items() if len(v) >= support}
    trust = {}
    for _ in range(rounds):
        trust = {k: sum(score[x] for x in vs) / len(vs) for k, vs in labels.items() if sum(score[x] >= 0.5 for x in vs) >= support}
        score = {x: max(seeds[x], 1 - float(np.prod([max(1e-9, 1 - trust[k]) for k in labels if k in trust and x in labels[k]]))) for x in seeds}
    return {(k, x) for k in labels for x, s in labels[k].items() if s == 0 and trust.get(k, 0) >= confidence and score[x] >= confidence}


def test_pattern_graph(spark):
    rng = np.random.default_rng(6)
    edges = [(f"p{rng.integers(12)}", f"v{rng.integers(60)}") for _ in range(400)]
    seed = {f"v{i}": float(i % 7 != 0) for i in range(60)}
    edges = [(a, b, seed[b]) for a, b in edges if not (a in ("p0", "p1") and seed[b])] + [("q", f"v{i}", seed[f"v{i}"]) for i in range(1, 7)] + [("q", "v7", 0.0)]
    got = pii.learn_contexts(spark.createDataFrame(edges, "label string, value string, seed double"), 3, 5, 0.8)
    want = graph(edges, 3, 5, 0.8)
    assert {(r.label, r.value) for r in got.collect()} == want and ("q", "v7") in want


def test_spans_of_odd_tables(spark):
    """Empty table, repeated rows, clashing names, very many matches, a text that begins with a byte-order mark."""
    many = " ".join(f"u{i}@m.de" for i in range(20_000))
    texts = [many, "\ufeffmail a@b.cd \ufeff😀 +49 30 1234567 end", None]
    df = docs(spark, texts).withColumns({"spans": F.lit(1), "value": F.lit("x"), "label": F.lit(2), "start": F.lit("s"), "__base": F.lit(0)})
    out = pii.digest(pii.find_pii(df.unionByName(df)))
    got = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_email").alias("e"), F.max("spans").alias("s"), F.max("label").alias("l")).collect()
    assert {r.doc_id: (r.n, r.e, r.l) for r in got} == {0: (2, 20_000, 2), 1: (2, 1, 2), 2: (2, 0, 2)}
    masked = {r.doc_id: r.text for r in pii.redact(pii.find_pii(df)).collect()}
    assert masked[1] == "\ufeffmail [EMAIL] \ufeff😀 [PHONE] end" and masked[0] == " ".join(["[EMAIL]"] * 20_000) and masked[2] is None
    assert pii.find_pii(df.limit(0)).count() == 0


def test_pii_plan_is_native(spark):
    plan = pii.op4_contextual_pii(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 5 ----

def test_toxicity_is_learned_and_calibrated(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(1600):
        w = list(rng.choice(words, 40))
        bad = i % 5 == 0
        if bad:
            for at in rng.choice(40, 3):
                w[at] = rng.choice(["vile", "scum", "rotten"])
        rows.append((i, " ".join(w), int(bad)))
    all_rows = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(all_rows.select("doc_id", "text"), all_rows.select("doc_id", "toxic"))
    assert set(model.lexicon.strong) >= {"vile", "scum", "rotten"}
    scored = model.score(all_rows.withColumn("score", F.lit("clash"))).where(toxicity.held_out()).collect()
    assert np.mean([r.predicted == r.toxic for r in scored]) > 0.97
    assert all(0 <= r.score <= 1 for r in scored)
    odd = model.score(docs(spark, [None, "", LONG, "vile scum rotten"])).orderBy("doc_id").collect()
    assert [r.predicted for r in odd] == [0, 0, 0, 1]
    assert model.score(docs(spark, ["x"]).limit(0)).count() == 0


def test_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, ["a"]), none)
    assert [r.score for r in model.score(docs(spark, ["a", None])).collect()] == [0.0, 0.0]


# ---- 6 ----

def test_warc_round_trip(spark, tmp_path):
    same = "<p>" + "é" * 600
    pages = [(1, "u1", same), (2, "u2", same), (3, "u\r\nX: y", same), (4, None, None), (5, "u5", ""), (6, "u6", "short"), (7, "u7", "short"), (None, "u8", same), (9, "u9", "z" * 300_000), (9, "u9", "z" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op6_warc(spark, str(tmp_path)).collect())
    want = []
    for p, _, h in pages:
        raw = (h or "").encode()
        again = h == same and p != 3
        want.append((p or 0, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want, key=lambda x: x[:2])


def test_warc_skips_payloads_and_pushes_filters(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    records = spark.createDataFrame([(f"<urn:{i}>", "response" if i % 2 else "revisit", "t", "d", None, f"sha1:{i}", b"p" * i) for i in range(50)], warc.SCHEMA)
    warc.write_warc(records, path)
    heads = warc.read_warc(spark, path, ["record_id", "record_type"]).where("record_type = 'revisit'")
    assert heads.count() == 25 and heads.columns == ["record_id", "record_type"]
    one = warc.read_warc(spark, path).where(F.col("record_id") == "<urn:7>").collect()
    assert [bytes(r.payload) for r in one] == [b"p" * 7]
    seen = []
    reader = warc.WarcReader(heads.schema, path, 1 << 20)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("record_id",), "a")]))
    assert len(left) == 1 and reader.wanted == {"record_type": {"revisit"}} and not seen
    warc.write_warc(records.limit(0), f"{path}0")
    assert warc.read_warc(spark, f"{path}0").count() == 0


def foreign(number, kind="response", body=b"", http=True, extra=()):
    block = (b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n" if http else b"") + body
    lines = [b"WARC/1.0", b"warc-type:" + kind.encode(), b"WARC-Record-ID: <urn:x:%d>" % number, *extra, b"Content-Type: " + (b"application/http; msgtype=response" if http else b"text/plain"), b"content-length:  %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    import gzip

    big, head = bytes(range(256)) * 2000, b"X-Long: " + b"h" * 9000
    rows = [foreign(0, "warcinfo", b"software: x", False), foreign(1, body=b"one\r\n\r\ntwo"), foreign(2, body=big, extra=[head]), foreign(3, "revisit"), foreign(4, body=b""), foreign(5, "resource", big[::-1], False)]
    want = {0: b"software: x", 1: b"one\r\n\r\ntwo", 2: big, 3: None, 4: b"", 5: big[::-1]}
    forms = {"a.warc": b"".join(rows), "b.warc.gz": b"".join(gzip.compress(r) for r in rows), "c.warc.gz": gzip.compress(b"".join(rows)), "d.warc.gz": b"".join(warc.member(r) if i % 2 else gzip.compress(r) for i, r in enumerate(rows)), "e.warc": b"", "note.txt": b"no archive"}
    for name, data in forms.items():
        (tmp_path / name).write_bytes(data)
    for where, times in ((tmp_path, 4), (tmp_path / "*.warc.gz", 3), (tmp_path / "a.warc", 1)):
        got = warc.read_warc(spark, f"file://{where}", ["record_id", "payload"]).collect()
        pairs = [(r.record_id, None if r.payload is None else bytes(r.payload)) for r in got]
        assert sorted(pairs, key=str) == sorted([(f"<urn:x:{i}>", want[i]) for i in want for _ in range(times)], key=str)
    heads = warc.read_warc(spark, f"file://{tmp_path}", ["record_id", "record_type"]).where("record_type = 'response'").collect()
    assert sorted(r.record_id for r in heads) == sorted(f"<urn:x:{i}>" for i in (1, 2, 4) for _ in range(4))
    two = warc.read_warc(spark, f"file://{tmp_path}").where("record_id = '<urn:x:2>'").collect()
    assert [bytes(r.payload) for r in two] == [big] * 4
    (tmp_path / "bad.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\n\r\n")
    with pytest.raises(Exception, match="without Content-Length"):
        warc.read_warc(spark, f"file://{tmp_path}/bad.warc").collect()


def test_op6_of_odd_pages(spark, tmp_path):
    """An empty table, and columns that have the names of outputs."""
    kinds = "page_id long, url string, html string, payload string, record_type string"
    spark.createDataFrame([], kinds).write.parquet(str(tmp_path / "none/pages.parquet"))
    assert warc.op6_warc(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([(1, "u", "é" * 900, "x", "y"), (2, "u", "é" * 900, None, "z")], kinds).write.parquet(str(tmp_path / "two/pages.parquet"))
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op6_warc(spark, str(tmp_path / "two")).collect()) == [(1, 1800, "revisit", 2), (2, 1800, "response", None)]


# ---- 7 ----

def hits(text, items):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w = words(text)
    hit, found = [False] * len(w), set()
    for i, t in items:
        x = words(t)
        n = min(13, len(x))
        for j in range(len(x) - n + 1 if n else 0):
            for a in range(len(w) - n + 1):
                if w[a : a + n] == x[j : j + n]:
                    hit[a : a + n] = [True] * n
                    found.add(i)
    return len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_decontamination(spark, most):
    rng = np.random.default_rng(9)
    words = [f"v{i}" for i in range(30)]
    items = [(100 + i, " ".join(rng.choice(words, n))) for i, n in enumerate([1, 2, 3, 5, 8, 12, 13, 14, 20, 30, 40, 13])] + [(200, None), (201, "  "), (202, "for " * 15), (7, "Ünï CODE, é-x")]
    items.append((300, items[8][1]))
    texts = [None, "", "for " * 40, "ünÏ code é x"] + [" ".join(rng.choice(words, 50)) for _ in range(20)]
    for k in (6, 8, 9, 10):
        x = items[k][1].split()
        texts += [" ".join([*rng.choice(words, 30), *x[:13], *rng.choice(words, 5)]), " ".join(["q", *x[1:14]]), " ".join(x[:12]), " - ".join(x).upper()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, texts).withColumns({"hits": F.lit("clash"), "k1": F.lit("clash"), "items": F.lit(None)})
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontam.digest(decontam.contamination(df, bench, broadcast_bytes=most)).collect()}
    assert [got[i] for i in range(len(texts))] == [hits(t, items) for t in texts]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_decontamination_of_odd_tables(spark, odd, most):
    bench = spark.createDataFrame([(1.5, " ".join(LONG.split()[500:520]))], "item_id double, text string")
    out = decontam.contamination(odd.unionByName(odd), bench, broadcast_bytes=most)
    got = {r.doc_id: (r.n_hit, r.n_words) for r in decontam.digest(out).collect()}
    assert got[5] == got[6] > (0, 0) and got[0] == (0, 0) and got[7] == (0, 1)
    assert out.count() == 18 and out.where("size(items) > 0").select("items").first().items == [1.5]
    assert decontam.contamination(odd, bench.limit(0), broadcast_bytes=most - 1).count() == 9
    assert decontam.contamination(odd.limit(0), bench, broadcast_bytes=most).count() == 0


def test_a_benchmark_as_large_as_the_documents(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    bench = d.where("doc_id % 2 = 0").selectExpr("doc_id as item_id", "text").unionByName(spark.read.parquet(f"{DATA}/benchmark.parquet").selectExpr("cast(-1 as bigint) as item_id", "text"))
    both = [sorted(map(tuple, decontam.digest(decontam.contamination(d, bench, broadcast_bytes=n)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256").collect())) for n in (0, 1 << 30)]
    assert both[0] == both[1] and sum(r[2] for r in both[0]) > 0


# ---- 9 ----

def adpcm(b):
    """A block of IMA ADPCM, code by code."""
    value, index = int(np.array(b[:2], np.uint8).view("<i2")[0]), b[2]
    want = [value]
    for byte in b[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + int(media.INDEX_SHIFT[code & 7])))
            want.append(value)
    return want


def slow_double(plain):
    """Twice the rate, sample by sample."""
    h, out = media.filters(2, 1).tolist(), []
    x = [int(plain[0])] * 3 + plain.tolist() + [int(plain[-1])] * 4
    for i in range(len(plain)):
        for p in range(2):
            acc = sum((x[i + k] * h[p][k]) >> 4 for k in range(8))
            out.append(max(-32768, min(32767, (acc + 512) >> 10)))
    return np.array(out, np.int16)


def test_media_round_trip(spark, odd):
    made = media.describe_pcm(media.decode_media(media.encode_media(odd.withColumns({"media": F.lit("clash"), "feature": F.lit(1)}))))
    out = {r.doc_id: r for r in made.collect()}
    for r in odd.collect():
        raw = (r.text or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert bytes(out[r.doc_id].payload) == padded and out[r.doc_id].n_bytes == len(raw)
        tag = (media.MULAW, media.ALAW, media.IMA)[len(padded) // 192 % 3]
        if tag == media.IMA:
            blocks = np.frombuffer(padded, np.uint8).reshape(-1, 192)
            plain = np.concatenate([adpcm([0, 0, 0, 0, *b]) for b in blocks.tolist()]).astype(np.int16)
        else:
            plain = (media.mulaw_table() if tag == media.MULAW else media.alaw_table())[np.frombuffer(padded, np.uint8)]
        want = slow_double(plain) if len(padded) < 2000 else media.resample(plain, 2, 1, media.filters(2, 1))
        got, rate = media.unpack_pcm(bytes(out[r.doc_id].pcm))
        assert rate == 16000 and got.tolist() == want.tolist()
        wide = want.astype(float)
        turns = sum((a < 0) != (b < 0) for a, b in zip(want[1:].tolist(), want[:-1].tolist()))
        assert out[r.doc_id].feature == f"{media.NAMES[tag]}:{len(want)}:{int(np.sqrt((wide * wide).mean()))}:{int(np.abs(wide).max())}:{turns}:{zlib.crc32(want.astype('<i2').tobytes()):08x}"
    assert out[5].feature == out[6].feature and media.pcm_wave(bytes(out[0].pcm))[:4] == b"RIFF"
    bad = spark.createDataFrame([(None,), (b"nothing",)], "media binary")
    assert [(r.payload, r.pcm, r.feature) for r in media.describe_pcm(media.decode_media(bad)).collect()] == [(None, None, None)] * 2
    assert media.encode_media(odd.limit(0)).count() == 0


def test_codec_tables_and_adpcm():
    mu, a = media.mulaw_table(), media.alaw_table()
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (5, 20)).astype(np.uint8)
    blocks[:, 2] %= 89
    got = media.decode_ima(blocks)
    for b, row in zip(blocks.tolist(), got.tolist()):
        assert row == adpcm(b)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 3000])
def test_packed_pcm_gives_its_samples_back(n):
    rng = np.random.default_rng(n)
    x = rng.integers(-32768, 32768, n).astype(np.int16)
    for up, down in ((2, 1), (3, 2), (1, 2), (1, 1)):
        y = media.resample(x, up, down, media.filters(up, down))
        assert y.tolist() == media.resample(x, up, down, media.filters(up, down), part=7).tolist()
        for plane in (1, 2, 3):
            for pcm in (y, x, (x // 1000 * 1000).astype(np.int16)):
                assert media.unpack_pcm(media.pack_pcm(pcm, 16000, plane))[0].tolist() == pcm.tolist()


def test_resampling_keeps_a_tone():
    t = np.arange(800)
    tone = (8000 * np.sin(2 * np.pi * 300 * t / 8000)).astype(np.int16)
    up = media.resample(tone, 2, 1, media.filters(2, 1))
    want = 8000 * np.sin(2 * np.pi * 300 * np.arange(1600) / 16000)
    assert len(up) == 1600 and np.abs(up - want)[20:-20].max() < 120


# ---- 10 ----

def test_shards_are_even_and_gapless(spark):
    rng = np.random.default_rng(4)
    texts = ["x" * int(n) for n in rng.integers(0, 60, 2000)] + ["hot" * 20] * 1000 + [None, ""]
    df = docs(spark, texts).withColumn("slot", F.lit("clash")).withColumn("k", F.lit(0))
    out = sharding.histogram_shards(df, sharding.content_key(), F.coalesce(F.octet_length("text"), F.lit(0)) + 8, shards=6, range_bytes=4000)
    rows = out.collect()
    assert len(rows) == len(texts)
    size, slots = {}, {}
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 8
        size[r.shard] = size.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(size) == list(range(6)) and max(size.values()) - min(size.values()) <= 2 * 68 + 0.001 * sum(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_few_and_no_rows(spark, odd):
    three = sharding.histogram_shards(odd.limit(3), sharding.content_key(), F.lit(8)).collect()
    assert len({(r.shard, r.slot) for r in three}) == 3
    assert sharding.histogram_shards(odd.limit(0), sharding.content_key(), F.lit(8)).count() == 0
    tied = sharding.histogram_shards(odd, F.lit(5).cast("long"), F.lit(8)).collect()
    assert sorted(r.slot for r in tied) == list(range(9)) and len({r.shard for r in tied}) == 1


def test_digest_columns(spark):
    r = media.op9_telephony_audio(spark, "/root/testdata/sf0.001").first()
    assert r.payload_bytes % 192 == 0 and 0 <= r.tail_crc32 < 2**32
    p = sharding.op10_histogram_sort(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"), "doc_id").first()
    assert p.text_crc32 == zlib.crc32(p.text.encode())


def test_resampled_pcm_is_stored(spark, monkeypatch):
    """Every document's PCM is in the shared folder, two samples for each coded one, and the features come from there."""
    tables, real = [], media.stage
    monkeypatch.setattr(media, "stage", lambda *a, **b: tables.append(real(*a, **b)) or tables[-1])
    out = {r.doc_id: r for r in media.op9_telephony_audio(spark, DATA).collect()}
    rows = tables[-1].select("doc_id", "pcm").collect()
    assert tables[-1].inputFiles() and sorted(r.doc_id for r in rows) == sorted(out)
    for r in rows:
        codec, n = out[r.doc_id].feature.split(":")[:2]
        pcm, rate = media.unpack_pcm(bytes(r.pcm))
        assert rate == 16000 and len(pcm) == int(n) == out[r.doc_id].payload_bytes // 192 * (2 * 385 if codec == "ima" else 2 * 192)


def test_frequent_pre_tokens_of_all_texts(spark):
    """The texts behind the first 2,000 count as well."""
    texts = [(i, f"alpha{chr(97 + i % 26)}" if i < 2000 else "zebra zebra") for i in range(3000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    table = tokens.frequent_lengths(df, "text", tokens.vocabulary_path(), entries=1)
    assert set(table) == {"zebra"}
    assert tokens.frequent_lengths(df.limit(0), "text", tokens.vocabulary_path()) == {}
