"""The ten operators on small fixtures: brute force, round trips, held-out accuracy, and odd rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import byte_bpe, decontaminate, embeddings, languageid, linededup, minhash, quality, queries, repeats, shared, toxicity, warc

DOC = "doc_id long, text string, component_id string, spans int, kept string"
WORDS = [f"w{i}" for i in range(400)]


def docs(spark, texts):
    """Rows with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts], DOC)


def corpus():
    rng = random.Random(4)
    out = []
    for i in range(40):
        base = [rng.choice(WORDS) for _ in range(60)]
        out.append(" ".join(base))
        for _ in range(i % 4):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(60)] = rng.choice(WORDS)
            out.append(" ".join(copy))
    texts = list(enumerate(out)) + [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE Two"), (905, "w1 " * 5000)]
    return texts + [texts[0]]  # a repeated row


def groups(links, ids):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_minhash_equals_brute_force(spark):
    texts = corpus()
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(links, ids)
    rows = minhash.near_duplicates(docs(spark, texts), 4).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}


def test_pruning_keeps_pairs_at_the_threshold():
    least = minhash.least_matches(0.8, 1e-6)
    assert (least <= 0.8 * np.arange(16, minhash.K + 1, 16)).all() and least[-1] > 0.5 * minhash.K


def test_minhash_of_nothing(spark):
    assert minhash.near_duplicates(docs(spark, []), 4).count() == 0


def test_toxicity(spark):
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(400):
        w = [rng.choice(WORDS) for _ in range(30)]
        if i % 4 == 0:
            w[rng.randrange(30)] = rng.choice(["grubworm", "grubworms", "sn0lly", "ѕnolly"])
        texts.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    d = docs(spark, [*texts, (900, None), (901, ""), (902, "GRUBW0RM! " + "w1 " * 3000), (903, "the Snolly")])
    model = toxicity.fit(d, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, y in labels) / 400 > 0.99
    assert got[900] == got[901] < 0.5 < got[903]
    none = toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.score("grubworm") < 0.5


def test_short_texts_are_learned_from_each_on_its_own(spark):
    """Texts of fewer than five words have no shingle; copies of one still count once."""
    words = [f"calm{i}" for i in range(200)]
    texts = [(i, f"you grubworm {words[i]}" if i % 2 else f"you {words[i]} friend") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, texts), labels)
    assert model.score("grubworm") >= 0.5 > model.score("calm3 friend")
    copies = [(i, "you grubworm" if i % 2 else "you friend") for i in range(200)]
    assert toxicity.fit(docs(spark, copies), labels).weights == {}  # one text of each label


def test_phrases_take_whole_words():
    long = "x" * 90
    assert toxicity.phrases(f" one  two   {long} z", 5)[2] == f"two {long}" and toxicity.phrases(" two ", 0)[2] == "two "


def test_toxicity_exceptions():
    m = toxicity.Model({" trash": 5.0}, frozenset({"trash can"}))
    assert m.matches(toxicity.fold("a Trash can")) == {} and m.matches(toxicity.fold("tr4sh!"))


def test_warc_round_trip_over_small_ranges(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"r{i}", "response", f"u{i}", None, "x", rng.randbytes(rng.choice([0, 900, 3000])) + warc.MAGIC * rng.choice([0, 1, 3]) + rng.randbytes(600)) for i in range(40)]
    df = spark.createDataFrame(rows, "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload binary")
    path = str(tmp_path / "w")
    warc.write(df.repartition(2), path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = {r.record_id: bytes(r.payload) for r in warc.records(spark, path).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {r[0]: r[5] for r in rows}


#: A record's member, found by search: 1F 8B 08 is at byte 50, within the code lengths, before any content comes out.
EARLY = base64.b64decode("H4sIAAAAAAAAA0WO4UuDQBjGvwv+D4duLWS3O42ZXtMVnoulQYhrEFEc89LAdHg3mEEfiwj6n7MygufDw48fz/uuz5IAmROsKuuuwbTdcgIaLrZ1JXgPE76pmwwuKQEzzpqy9f9s1uRcwlWyJGDXM8pkt2C6xxhis0uKMfnJTS9csbasWQbpY86FJEAUzCR7VQnqSvJKwphXuSwIcO1/9vuW5HuJCvlUnoBNwRrBpbeTD9BRFVWxUIxgGIcf0Jjr2ugieLWPrnX9MPBERN9GB6Y7vSX2vaYNw/lzRN9nTobhwnO4hSLbSseG3y0MBxM0pgPdsK3V+elLJ5Dpne8Wl4vP7xtfTthqsSwBAAA=")


def test_warc_magic_before_content(spark, tmp_path):
    assert EARLY.find(warc.MAGIC, 3) == 50 and zlib.decompressobj(31).decompress(EARLY[:50]) == b""
    # Another writer's member: the magic bytes are in the header's extra field and in its time.
    other = zlib.compressobj(6, zlib.DEFLATED, -15)
    content = warc.record("extra", "response", "u", None, "x", b"p" * 700)
    extra = warc.MAGIC + b"\x04" + warc.MAGIC + b"\x00\x00\x03" + b"\x05\x00" + b"a" + warc.MAGIC + b"b" + other.compress(content) + other.flush()
    extra += zlib.crc32(content).to_bytes(4, "little") + len(content).to_bytes(4, "little")
    rows = [warc.member(warc.record(f"r{i}", "response", "u", None, "x", hashlib.sha512(b"%d" % i).digest() * (1 + i % 7))) for i in range(12)]
    # A truncated member and a start that is none go before good ones.
    data = EARLY + rows[0] + EARLY + extra + rows[1][:70] + rows[2] + EARLY[:20] + rows[3] + warc.MAGIC * 2 + b"".join(rows[4:]) + EARLY + extra
    want = sorted(["early"] * 3 + ["extra"] * 2 + [f"r{i}" for i in range(12) if i != 1])
    whole = [m["record_id"] for k, m in warc.assemble(iter(data[3:].split(warc.MAGIC)), True, True) if k == "record"]
    assert sorted(whole) == want
    path = tmp_path / "a.warc"
    path.write_bytes(data)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in (40, 61, 97, 333, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            assert sorted(r.record_id for r in warc.records(spark, str(path)).collect()) == want, size
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_warc_revisits(spark, tmp_path):
    long, short = "é" * 600, "x" * 999
    pages = spark.createDataFrame([(1, "http://a", long, 7), (5, "http://b", long, 7), (3, None, long, 7), (2, "u", short, 7), (4, "u", short, 7), (6, "u\nv", None, 7)], "page_id long, url string, html string, payload int")
    path = str(tmp_path / "w")
    warc.archive_pages(pages, path)
    got = {r.record_id: r for r in warc.records(spark, path).collect()}
    assert {k.rpartition(":")[2] for k, r in got.items() if r.record_type == "revisit"} == {"1", "3"}
    assert got["urn:page:3"].refers_to == "urn:page:5" and got["urn:page:6"].content_length == 0
    assert bytes(got["urn:page:5"].payload).decode() == long


def test_repeats_equal_brute_force(spark):
    rng = random.Random(2)
    shared = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (49, 60, 200)]
    texts = [(i, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 150))) + rng.choice(shared) + rng.choice(shared)) for i in range(60)]
    texts += [(900, None), (901, ""), (902, "q" * 300), (903, "q" * 300), texts[7]]
    seen, want = {}, {}
    for i, t in sorted(set(texts)):
        b = (t or "").encode()
        m = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], i) < i:
                m[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, x in zip(b, m) if not x)
        want[i] = (len(b), len(b) - len(kept), sum(1 for j in range(len(m)) if m[j] and (not j or not m[j - 1])), hashlib.sha256(kept).hexdigest())
    rows = repeats.remove_repeats(docs(spark, texts), 50).collect()
    assert len(rows) == len(texts) and {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


def test_quality(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(WORDS) for _ in range(50)) if i % 3 else "### $$$ " * 40) for i in range(300)] + [(900, None), (901, "")]
    d = docs(spark, texts).withColumn("source", F.when(F.col("doc_id") < 150, "h1")).withColumn("lang", F.lit("en"))
    y = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(d, y).collect()}
    assert len(got) == 302 and all((got[i] >= 0.5) == bool(i % 3) for i in range(300))
    assert quality.score(d, y.limit(0)).where("score != 0.5").count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        v = rng.standard_normal(16) if i % 3 == 0 else np.array(rows[-1][1]) * 2 + rng.standard_normal(16) * rng.choice([0, 0.1, 0.3])
        rows.append((i, v.tolist(), i // 100))
    bad = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None, 1.0], 0), (904, [], 0), (905, rows[0][1], None), (906, [1.0, 2.0], 0)]
    x = {i: np.array(v) for i, v, _ in rows}
    cos = lambda a, b: x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b]))
    links = [(a, b) for a in x for b in x if a < b and rows[a][2] == rows[b][2] and cos(a, b) >= 0.98]
    want = groups(links, list(x))
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")).collect()}
    assert {i: (got[i].n_links, got[i].component_id) for i in x} == {i: (sum(i in p for p in links), want[i]) for i in x}
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 907))


def test_language_id(spark):
    rng = random.Random(6)
    made = {"aa": "abcde", "bb": "vwxyz"}
    rows = [(i, " ".join("".join(rng.choice(made[k]) for _ in range(5)) for _ in range(20)), k) for i, k in enumerate(["aa", "bb"] * 100)]
    d = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !", None), (902, "", "bb")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in languageid.predict(d, languageid.fit(d, d.where("doc_id < 100"))).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows if i >= 100)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert languageid.predict(d, languageid.fit(d, d.limit(0))).where("lang_pred != 'und'").count() == 0


def test_byte_bpe_equals_tiktoken(spark):
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["", "'", "it's 'tis don't'll ''s x 's", "  a  ", "\n\n a \n", "tail  ", "x" * 5000, "<|endoftext|>"] + ["".join(rng.choice("ab's'tré  \n\t.,!12ⅷ٣一'll've\x1c\x85𝔘😀") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    d = docs(spark, [*enumerate(texts), (9000, None)])
    rows = {r.doc_id: r for r in byte_bpe.encode(d, path).collect()}
    assert all(list(rows[i].ids) == enc.encode_ordinary(t) and bytes(rows[i].decoded).decode() == t for i, t in enumerate(texts))
    assert rows[9000].n_tokens == 0
    back = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(byte_bpe.encode(d, path), path).collect()}
    assert all(back[i].decode() == t for i, t in enumerate(texts))


def test_long_words_equal_tiktoken():
    """Words around and far above the length from which one is merged by itself, one of a million letters among them."""
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    v = byte_bpe.Vocabulary(path)
    for n in (999, 1000, 1001, 1002, 5000, 40_000, 1_000_000):
        for letters in ("ab", "etaoinshrdlu", "e", "tré一ж"):
            if n > 40_000 and letters != "etaoinshrdlu":
                continue
            text = "".join(rng.choice(letters) for _ in range(n))
            raw = np.frombuffer(text.encode(), np.uint8)
            ids, at = v.encode(raw, np.array([0, len(raw)]))
            assert ids.tolist() == enc.encode_ordinary(text), (n, letters)
            assert v.decode(ids).tobytes() == text.encode()


def test_line_dedup(spark):
    line = " ".join(WORDS[:40])
    near = line.replace("w7 ", "w8 ")
    d = docs(spark, [(1, f"{line}\nshort one\n"), (2, f"Own words of the second text\n{line.upper()}\nshort one"), (3, None), (4, ""), (5, f"{line}\n{line}"), (1, f"{line}\nshort one\n")])
    got = {r.doc_id: r for r in linededup.dedup_lines(d).collect()}
    assert got[1].n_removed == 0 and got[2].text == "Own words of the second text\nshort one" and got[5].text == ""
    assert got[3].text is None and got[4].text == "" and got[2].n_lines == 3
    assert linededup.distance(line, near, 10) == 1 and linededup.distance("abc", "xyz", 1) == 2
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


def edited(rng, line):
    """line with words replaced, or characters changed, within an edit similarity of 0.9."""
    while True:
        if rng.random() < 0.5:
            w = line.split()
            for _ in range(rng.randint(1, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            x = " ".join(w)
        else:
            x = list(line)
            for _ in range(rng.randint(1, max(1, len(line) // 25))):
                x[rng.randrange(1, len(x) - 1)] = rng.choice("abcxyz")
            x = "".join(x)
        most = int(0.1 * max(len(x), len(line)) + 1e-9)
        if x != line and linededup.distance(line, x, most) <= most:
            return x


def deduplicated(texts, least=1):
    """Brute force over all pairs of lines of `least` words and more: what is left of each text, and the number of linked pairs."""
    norm = lambda x: " ".join(x.lower().split())
    at = [(i, k, norm(x)) for i, t in texts for k, x in enumerate((t or "").split("\n")) if len(norm(x).split()) >= least]
    lines = sorted({x for _, _, x in at})
    most = lambda a, b: int(0.1 * max(len(a), len(b)) + 1e-9)
    links = [(a, b) for a in lines for b in lines if a < b and abs(len(a) - len(b)) <= most(a, b) and linededup.distance(a, b, most(a, b)) <= most(a, b)]
    of = groups(links, lines)
    first = {}
    for i, k, x in sorted(at):
        first.setdefault(of[x], (i, k))
    gone = {(i, k) for i, k, x in at if first[of[x]] != (i, k)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts}, len(links)


def line_texts():
    rng = random.Random(8)
    base = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (5, 6, 7, 8, 10, 15, 20, 20, 30, 50, 50, 120) for _ in range(4)]
    lines = [x for b in base for x in (b, edited(rng, b), edited(rng, edited(rng, b)), b.upper())]
    lines += [" ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 60))) for _ in range(60)]
    rng.shuffle(lines)
    return [(i, "\n".join(lines[k : k + 5])) for i, k in enumerate(range(0, len(lines), 5))] + [(900, None), (901, "")]


def test_line_dedup_equals_brute_force(spark):
    texts = line_texts()
    want, links = deduplicated(texts, 5)
    assert links > 100
    assert {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, texts)).collect()} == want


def test_op9_and_pipeline_remove_short_lines(spark, tmp_path):
    han = "".join(chr(0x4E00 + 7 * i) for i in range(30))
    texts = [(1, f"les.\n{han}\nall rights reserved."), (2, f"own one\nles.\n\nAll  rights reserved."), (3, f"{han}\nown two\n{han[:20]}x{han[21:]}")]
    spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_chars", F.length("text")).write.parquet(str(tmp_path / "documents.parquet"))
    want = {1: texts[0][1], 2: "own one\n", 3: "own two"}
    got = {r.doc_id: r for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert {i: r.kept_sha256 for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, queries.table(spark, str(tmp_path), "documents"), str(tmp_path)).collect()} == want


def test_components_settle_or_fail(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in shared.components(path, "a", "b").collect()} == {0}
    with pytest.raises(RuntimeError):
        shared.components(path, "a", "b", max_rounds=1)


def test_decontamination(spark):
    item = " ".join(WORDS[:30])
    other = " ".join(WORDS[100:118])
    items = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "tiny item")], "item_id long, text string")
    edited = item.replace("w29", "zz")
    d = docs(spark, [(1, f"pre fix {item} post"), (2, f"{edited} more"), (3, "w1 w2 w3 w4 w5 w6"), (4, None), (5, ""), (6, f"a {other.upper()}"), (7, "a tiny item here"), (1, f"pre fix {item} post")])
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(d, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (6, 2), (7, 4)} and got[1, 1].start == 2 and got[1, 1].similarity == 1 and 0.8 <= got[2, 1].similarity < 1
    assert decontaminate.contaminated(d, items.limit(0)).count() == 0


def test_connect_in_a_bucket_of_many_blocks(spark):
    """Chains within one large bucket, mostly apart from its hub, beside many small buckets: as a union-find over all pairs has it."""
    from tracewright.llm.linking import connect

    def value(i):
        return (i * 37) % 701 // 3 * 10 + i % 2

    def parse(column):
        return np.array([[int(x)] for x in column.to_pylist()], np.int64).reshape(-1, 1)

    def stay(x, y, i, j):
        return np.flatnonzero(np.abs(x[i, 0] - y[j, 0]) <= 1)

    def keys(x):
        return np.column_stack([np.full(len(x), 7), 1000 + x[:, 0] // 10])

    def linked(x, y, mask):
        a, b = (np.array([int(v) for v in w]) for w in (x, y))
        return *np.nonzero(mask & (np.abs(a[:, None] - b[None, :]) <= 1)), None

    ids = list(range(700))
    sig = spark.createDataFrame([(i, str(value(i)).encode()) for i in ids], "id long, sig binary")
    keyed = spark.createDataFrame([(k, i) for i in ids for k in (7, 1000 + value(i) // 10)], "key long, id long")
    got = connect(keyed, sig, parse, stay, keys, lambda pairs: shared.cut(pairs, "links"), lambda need: need.join(sig, "id").select("id", F.col("sig").alias("content")), linked)
    groups = {}
    for i in ids:
        groups.setdefault(value(i) // 10, []).append(i)
    want = {i: min(g) for g in groups.values() if len(g) > 1 for i in g}
    assert {r.id: r.component for r in got.collect()} == want
