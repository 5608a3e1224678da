import collections
import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import byte_cnn, chat, common, decontaminate, minhash, outliers, pfair, substring, toxicity, url_reputation, warc

WORD = r"[^\x20\x09-\x0D]+"


def documents(spark, n=120, seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, rows = text(60), []
    for i in range(n):
        t = text(r.randint(3, 90))
        if i % 4 == 1 and i > 8:
            w = rows[i - 5][1].split()
            w[r.randrange(len(w)) if w else 0 :][:1] = []
            t = " ".join([*w, "tail"])
        if i % 5 == 0:
            t += "\n" + passage
        rows.append([i, t, "en" if i % 3 else None, f"s{i % 2}", len(t)])
    rows[7][1], rows[8][1], rows[9][1] = None, "", " \n\t"
    rows[11][1] = rows[3][1]
    rows.append([None, passage, "en", "s0", 1])
    rows.append(list(rows[20]))
    rows.append([n, "é ü " * 5000, "en", None, 1])
    return spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, n string")


def words_of(t):
    return re.findall(WORD, t or "")


def test_words():
    texts = ["a bb  c", "", None, "x y\tz", "bb"]
    w = common.Words(*common.bytes_of(pa.array(texts)), piece=4)
    assert np.diff(w.ptr).tolist() == [3, 0, 0, 2, 1]
    assert w.hashes[1] == w.hashes[5] and len(set(w.hashes.tolist())) == 5


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (3, 9), (5, 6), (7, 6)], "a long, b long")
    assert {(r.id, r.component) for r in common.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (9, 1), (5, 5), (6, 5), (7, 5)}
    assert common.components(e.limit(0)).count() == 0


def test_components_on_driver_and_executors(spark, monkeypatch):
    """Both ways give the same; a few edges take no rounds of jobs, however long their paths are."""
    r = np.random.RandomState(3)
    walk = r.permutation(60) * 1_000_003 - 5
    edges = [(int(a), int(b)) for a, b in zip(walk, walk[1:])] + [(int(a), int(b)) for a, b in r.randint(1 << 40, (1 << 40) + 80, (50, 2))] + [(7, 7), (1 << 60, 8)] * 2
    df = spark.createDataFrame(edges, "a long, b long")
    cuts, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda *a: cuts.append(1) or cut(*a))
    near = {(x.id, x.component) for x in common.components(df).collect()}
    assert len(cuts) <= 2
    far = common.components(df, most=0).collect()
    assert len(far) == len(near) and {(x.id, x.component) for x in far} == near
    assert {c for i, c in near if i in set(walk.tolist())} == {-5} and (1 << 60, 8) in near and 7 not in {i for i, _ in near}


def test_substring(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    first = {}
    for r in rows:
        w = words_of(r.text)
        for i in range(len(w) - 12):
            if r.doc_id is not None:
                k = tuple(w[i : i + 13])
                first[k] = min(first.get(k, 1 << 60), r.doc_id)
    want = []
    for r in rows:
        w = words_of(r.text)
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if r.doc_id is not None and first[tuple(w[i : i + 13])] < r.doc_id:
                gone[i : i + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((r.doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substring.deduplicate(docs).collect()]
    assert collections.Counter(got) == collections.Counter(want) and sum(x[2] for x in want) > 500
    texts = {r.doc_id: r.text for r in substring.remove_repeats(docs).collect()}
    for d, _, gone, sha in want:
        if d in texts:
            assert hashlib.sha256(" ".join(words_of(texts[d])).encode()).hexdigest() == sha
    assert substring.deduplicate(docs.limit(0)).count() == 0


def test_near_duplicates(spark):
    docs = documents(spark)
    sets = {}
    for r in docs.where("doc_id is not null").collect():
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, words=2).collect()}
    assert got.pop(None)[1:] == (None, False)
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in sets} and sum(find(i) != i for i in sets) > 5


def test_outliers(spark):
    docs = documents(spark)
    got = collections.defaultdict(list)
    for r in outliers.judge(docs).collect():
        got[r.doc_id].append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
    for r in docs.where("doc_id is not null").collect():
        t, w = r.text or "", words_of(r.text)
        c, hit = collections.Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if c[tuple(w[i : i + 3])] > 1:
                hit |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if words_of(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert set(got[r.doc_id]) == {want}
    assert outliers.judge(docs.limit(0)).count() == 0


def test_outliers_reject(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(3, 7)))
    rows = [(i, " ".join(word() for _ in range(r.randint(60, 200))), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(word() + "###" for _ in range(80)), "en", "s") for i in range(5)]
    got = {x.doc_id: x.kept for x in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(5))


def test_byte_cnn():
    r = random.Random(2)
    good = ["".join(r.choice("abcdefgh ,.") for _ in range(r.randint(1, 900))) for _ in range(150)]
    bad = [x + " $$$ ||| " + x for x in good]
    enc = [t.encode() for t in good + bad]
    y = np.array([1.0] * 150 + [0.0] * 150)
    model = byte_cnn.train(enc[:100] + enc[150:250], np.array([1.0] * 100 + [0.0] * 100), epochs=40)
    test = enc[100:150] + enc[250:] + [b""]
    s = byte_cnn.scores(model, model.paired(), np.frombuffer(b"".join(test), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in test])]))
    assert ((s[:-1] >= 0.5) == np.concatenate([y[100:150], y[250:]])).mean() > 0.95 and 0 <= s[-1] <= 1


def test_toxicity_exact():
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    texts, labels = [], []
    for i in range(300):
        t = [r.choice(vocabulary) for _ in range(r.randint(1, 40))]
        if i % 2:
            t[r.randrange(len(t))] = r.choice(["badword", "scoundrel", "villain"])
        texts.append(" ".join(t))
        labels.append(i % 2)
    ix = toxicity.Index(texts, np.array(labels, float), 0.5, least_df=2).open()
    vectors = ix.vectors(pa.array(texts))
    dense = np.zeros((300, len(ix.vocab)))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i, (t, w) in enumerate(vectors[:60]):
        if len(t):
            want = np.sort((dense @ dense[i]).astype(np.float32))[::-1][: ix.k]
            got = ix.nearest(t, w)[1]
            assert np.allclose(got, want[want > 0][: len(got)], atol=1e-5) and len(got) == min(ix.k, (want > 1e-9).sum())
    scores = np.array([ix.score(*ix.nearest(t, w)) if len(t) else ix.none for t, w in vectors])
    assert ((scores >= 0.5) == np.array(labels)).mean() > 0.95


def test_warc(spark, tmp_path):
    trap = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    long = "é" * 60
    rows = [(1, "http://a/", "x" + trap + long), (2, None, None), (3, "u\r\nv", long), (4, "d", long), (5, "e", "short"), (6, "f", "short"), (None, "n", "none"), (7, "g", trap * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: tuple(r)[1:] for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        b = (h or "").encode()
        assert got[i] == (len(b), hashlib.sha256(b).hexdigest(), "revisit" if i == 4 else "response", 3 if i == 4 else None)
    warc.write(pages, f"file://{tmp_path}/w")
    small = warc.read(spark, f"file://{tmp_path}/w", range_bytes=64, with_payload=True)
    assert sorted(bytes(r.payload or b"") for r in small.collect()) == sorted([(h or "").encode() for i, _, h in rows if i != 4] + [b""])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_long_urls(spark):
    rows = [(i, "http://a/" + ("x" * 70_000 if i % 3 == 0 else "ü" * 200_000 if i == 4 else f"{i}/WARC/1.1"), f"page {i}") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.payload_digest for r in warc.round_trip(pages).collect()}
    assert got == {i: hashlib.sha256(h.encode()).hexdigest() for i, _, h in rows}


def test_warc_file_sizes(spark, tmp_path):
    """Archives keep within the bytes asked for, or hold one record; sizes lie at and beside the borders of classes."""
    sizes = [0, 3071, 3072, 3073, 1000, 15_359, 15_360, 15_361, 100_000, 63_487, 63_488, 63_489] * 4
    pages = spark.createDataFrame([(i, None if n % 2 else "u", f"{i:04}" + "x" * (n - 4) if n else None) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, f"file://{tmp_path}/w", file_bytes=20_000, record_bytes=4096, step=4)
    got = warc.read(spark, f"file://{tmp_path}/w").select("file", "payload_bytes").collect()
    assert sorted(r.payload_bytes for r in got) == sorted(sizes)
    of = {}
    for r in got:
        of.setdefault(r.file, []).append(r.payload_bytes)
    for file, held in of.items():
        assert len(held) == 1 or os.path.getsize(file.removeprefix("file:").replace("//", "/")) <= 20_000
    assert len(of) < len(sizes)


def test_warc_headers():
    """As if each candidate were parsed by itself, also where magic stands within headers."""
    r, seen = random.Random(6), 0
    parts = [b"WARC/1.1\r\n", b"WARC-Type: response\r\n", b"WARC-Type: resource\r\n", b"Content-Length: 0\r\n", b"Content-Length: 10\r\n", b"\r\n", b"\r\n\r\n", b"x"]
    for _ in range(3000):
        content = b"".join(r.choice(parts) for _ in range(r.randint(1, 30)))
        heads = warc.Heads(content)
        for m in warc.MAGIC.finditer(content):
            want, end = None, content.find(b"\r\n\r\n", m.start())
            if end >= 0:
                fields = {k.lower(): v for k, v in warc.FIELD.findall(content[m.start() : end])}
                after = end + 4 + int(fields.get(b"content-length", b"-1"))
                if b"content-length" in fields and b"warc-type" in fields and content[after : after + 4] == b"\r\n\r\n":
                    want = (end + 4, after + 4, {k: v for k, v in fields.items() if k in warc.KEYS})
            assert heads.parse(m.start()) == want
            seen += want is not None
    assert seen > 100


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/a?x"), (2, "https://m.example.com/en/"), (3, "http://a.net/es/1#t"), (4, None), (5, "no scheme"), (6, "http://b.org"), (7, "http://notcom/"), (8, "http://a.net/fr")]
    outcomes = spark.createDataFrame([(100 + i, 1) for i in range(20)] + [(200 + i, 0) for i in range(80)] + [(1, None)], "page_id long, bad int")
    pages = spark.createDataFrame(rows + [(100 + i, f"http://spam.org/{i}") for i in range(20)] + [(200 + i, f"http://h{i % 9}.org/") for i in range(80)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge(pages, outcomes).collect()}
    assert got[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow") and got[2][2:] == ("example.com/en/", "block")
    assert got[3][2:] == ("net/es/", "block") and got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow") and got[8][2:] == (None, "allow")
    assert got[100][3] == "block" and got[200][3] == "allow" and got[6] == ("b.org", "", None, "allow")
    assert url_reputation.judge(pages.limit(0), outcomes.limit(0)).count() == 0


def test_pfair(spark):
    weights = {"a": 5, "b": 3, "c": 1, "d": 7}
    q = pfair.integer_weights(weights, 64)
    seq, seen = pfair.period(q), collections.Counter()
    for t, s in enumerate(seq, 1):
        seen[s] += 1
        assert all(abs(seen[k] - t * q[k] / len(seq)) < 1 for k in q)
    assert seen == q
    rows = [(i, "abc"[i % 7 % 3], "t") for i in range(3000)] + [(None, None, None), (5, "a", "t")]
    df = spark.createDataFrame(rows, "doc_id long, source string, block string")
    got = pfair.mix(df, {"a": 1.0, "b": 2.0, "c": 3.0}, block=16, slots=32).collect()
    assert len(got) == len(rows) and len({r.position for r in got}) == len(rows)
    slots = sorted({(r.slot, r.source) for r in got}, key=lambda x: x[0])
    assert [s for s, _ in slots] == list(range(len(slots)))
    assert pfair.mix(df.limit(0)).count() == 0 and pfair.mix(df, whole=True).count() == len(rows)


def test_pfair_target_weights(spark):
    """Less than one block off the weights as given: in a long stream, with more than 1024 sources, as columns of mix."""
    for blocks, weights in [({"hot": 40_000} | {f"s{i}": 9_000 for i in range(20)}, {"hot": 139.8} | {f"s{i}": 44.21 for i in range(20)}), ({i: 60 if i else 3_000 for i in range(1100)}, {i: 1.0 if i else 100.0 for i in range(1100)})]:
        slots, total = pfair.plan(blocks, weights), sum(weights.values())
        assert {k: len(x) for k, x in slots.items()} == blocks and sorted(t for x in slots.values() for t in x) == list(range(sum(blocks.values())))
        end = min(x[-1] for x in slots.values())
        for k, x in slots.items():
            t, w = np.array([y for y in x if y <= end]), weights[k] / total
            before, n = t * w, np.arange(len(t))
            assert (np.abs(n - before) < 1).all() and (np.abs(n + 1 - before - w) < 1).all()
    rows = [(i, f"s{i % 1100}" if i % 3 else "hot") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = pfair.mix(df, {"hot": 1100.0} | {f"s{i}": 1.0 for i in range(1100)}, block=1).collect()
    assert sorted(r.position for r in got) == list(range(9000))
    assert abs(sum(r.source == "hot" for r in got if r.slot < 2200) - 1100) <= 1


def test_decontaminate(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    item = [word() for _ in range(40)]
    edited = [w if r.random() > 0.15 else word() for w in item]
    fill = lambda k: [word() for _ in range(k)]
    rows = [(i, " ".join(fill(200))) for i in range(30)]
    rows += [(100, " ".join(fill(50) + item + fill(9))), (101, " ".join(fill(5) + edited).upper()), (102, None), (103, ""), (None, " ".join(item))]
    docs = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "two words"), (None, "x y z w")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {100, 101} and got[100].score == 1.0 and (got[100].start_word, got[100].end_word) == (50, 90)
    assert decontaminate.clean(docs, bench).count() == len(rows) - 2 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontaminate_hot_edited_copy(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    item = [word() for _ in range(38)]
    edited = " ".join(word() if i % 5 == 4 else w for i, w in enumerate(item))
    docs = spark.createDataFrame([(i, edited if i < 1001 else " ".join(word() for _ in range(60))) for i in range(1010)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {x.doc_id: x.score for x in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == set(range(1001)) and 0.7 < min(got.values()) and max(got.values()) < 0.75


def test_align():
    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        return max(map(max, h))

    r = np.random.RandomState(0)
    for _ in range(50):
        a, b = r.randint(0, 4, r.randint(1, 12)), r.randint(0, 4, r.randint(1, 15))
        assert decontaminate.align(a, b)[0] == plain(a.tolist(), b.tolist())


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "who"), (1, 3, None, "who"), (None, 1, "x", "y"), (2, None, "x", "y"), (1, 2500, "ann", "late ü")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seg = chat.rotate(df)
    text = {r.perspective: r for r in chat.render(seg).collect()}
    assert set(text) == {"ann", "bob", "unknown"}
    assert text["ann"].text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user name=unknown\nwho<|im_end|>\n<|im_start|>assistant\nlate ü<|im_end|>\n"
    assert [text["ann"].text[m.start : m.stop] for m in text["ann"].masks] == ["hi<|im_end|>", "late ü<|im_end|>"]
    assert {r.copies for r in seg.where("turn = 3").collect()} == {2} and chat.rotate(df.limit(0)).count() == 0


@pytest.mark.parametrize("module", [byte_cnn, toxicity])
def test_classifiers_in_spark(spark, module):
    docs = documents(spark)
    label = "quality" if module is byte_cnn else "toxic"
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], f"doc_id long, {label} int")
    got = module.score(docs, module.fit(docs, labels))
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    none = module.fit(docs, labels.limit(0))
    assert module.score(docs.limit(0), none).count() == 0 and module.score(docs, none).count() == docs.count()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = documents(spark)
    base = f"file://{tmp_path}"
    docs.where("doc_id is not null").dropDuplicates(["doc_id"]).drop("n").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 > 0)) for i in range(60)], "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, "not in any of these documents at all")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    out = corpus_pipeline.run(spark, base)
    rows = out.collect()
    assert 0 < len(rows) < docs.count() and len({r.position for r in rows}) == len(rows)
