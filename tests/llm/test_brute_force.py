"""Operators that SQL cannot express, and the pipeline, against plain Python over all rows, windows and pairs."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import WORDS, deduplicated, docs, groups

import corpus_pipeline
from tracewright.llm import decontaminate, languageid, quality, toxicity

BLANKS = r"[\x20\x09-\x0D]+"


def words_of(text):
    return [w for w in re.split(BLANKS, (text or "").lower()) if w]


def shingles_of(w, size=5):
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def held_items(texts, items, threshold=0.8, cut=False):
    """{(doc_id, item_id): (similarity, start)} of the best of all windows of an item's length (or the whole of a shorter text).

    cut: also those that begin before the text or end after it, as far as they lie in the text.
    """
    bags = {i: Counter(shingles_of(words_of(t))) for i, t in items if words_of(t)}
    df = Counter(s for b in bags.values() for s in b)
    out = {}
    for i, t in items:
        if i not in bags:
            continue
        n, bag = len(words_of(t)), bags[i]
        idf = {s: math.log1p(len(bags) / df[s]) for s in bag}
        rare, own = max(idf.values()), sum(c * idf[s] for s, c in bag.items())
        for d, text in texts:
            w = words_of(text)
            if not set(bag) & set(shingles_of(w)) and n >= 5:
                continue
            for start in range(1 - n, len(w)) if cut else range(max(1, len(w) - n + 1)):
                got = Counter(shingles_of(w[max(0, start) : start + n]))
                low = sum(min(c, got[s]) * idf[s] for s, c in bag.items())
                similarity = low / (own + sum(c * idf.get(s, rare) for s, c in got.items()) - low)
                if similarity >= threshold - 1e-12:
                    out[d, i] = max(out.get((d, i), (0, 0)), (similarity, -start))
    return {k: (s, -at) for k, (s, at) in out.items()}


def changed(rng, w, edits):
    """Words after so many replacements, insertions and removals."""
    w = list(w)
    for _ in range(edits):
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        w[at : at + (kind != 1)] = [rng.choice(WORDS)] if kind < 2 else []
    return w


def test_decontamination_equals_all_windows(spark):
    rng = random.Random(21)
    stock = [rng.choice(WORDS) for _ in range(12)]  # a passage that many items share
    items = [(i, " ".join([rng.choice(WORDS) for _ in range(rng.choice([3, 5, 9, 25, 40, 60]))] + (stock if i % 3 == 0 else []))) for i in range(45)]
    texts = []
    for i, t in items:
        for edits in range(4):
            w = changed(rng, words_of(t), edits)
            texts.append((len(texts), " ".join([rng.choice(WORDS) for _ in range(rng.randint(0, 40))] + w + [rng.choice(WORDS) for _ in range(rng.randint(0, 40))])))
    texts += [(900, None), (901, ""), (902, " ".join(stock)), (903, "w1 " * 20_000 + items[4][1])]
    want, most = held_items(texts, items), held_items(texts, items, cut=True)
    d = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.contaminated(docs(spark, texts), d).collect()}
    # Windows cut at an end are sought only where a tile of the item places them.
    assert len(want) > 60 and set(want) <= set(got) <= set(most)
    assert all(want.get(k, (0.8,))[0] - 1e-9 <= s <= most[k][0] + 1e-9 for k, (s, _) in got.items())


def plain_toxicity(model, text):
    """The score by trying every entry at the beginning of every word."""
    folded = toxicity.fold(text)
    found = {}
    for m in re.finditer(r" (?=[^ ])", folded):
        at, best = m.start(), None
        for k, w in model.weights.items():
            if folded.startswith(k, at) and (best is None or w > best[1]):
                best = (k, w)
        if best:
            parts = folded[at + 1 :].split(" ")
            before, after = folded[:at].split(), folded[at + 1 + len(parts[0]) :].split()
            word = parts[0]
            near = {word, f"{before[-1] if before else ''} {word}", f"{word} {after[0] if after else ''}"}
            if not near & model.exceptions:
                found[at] = best
    x = [0.0, 0.0, 0.0]
    if found:
        total = sum(w for _, w in found.values())
        x = [math.log1p(total), total / math.sqrt(10 + folded.count(" ")), math.log1p(len({k for k, _ in found.values()}))]
    z = sum(a * b for a, b in zip(model.coefficients, [*x, 1.0], strict=True))
    return 1 / (1 + math.exp(-min(40.0, max(-40.0, z))))


def test_toxicity_equals_plain_scoring(spark):
    rng = random.Random(22)
    model = toxicity.Model({" grub": 2.5, " grubworm ": 4.0, " snoi": 3.0, " trash ": 5.0}, frozenset({"trash can", "city trash"}), (0.7, 1.3, 0.4, -3.0))
    odd = ["grubworm", "GRUBW0RM", "grubby", "sn0lly", "ѕnоlly", "trash", "Trash,", "can", "city", "tr4sh", "gr​ub", "l1i"]
    texts = [(i, " ".join(rng.choice(odd if rng.random() < 0.3 else WORDS) + rng.choice(["", ".", "  ", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    texts += [(900, None), (901, ""), (902, "trash"), (903, "trash can"), (904, "w1 " * 200_000 + "trash"), texts[3]]
    want = {i: plain_toxicity(model, t) for i, t in texts}
    rows = toxicity.score(docs(spark, texts).withColumn("score", F.lit("clash")), model).collect()
    assert len(rows) == len(texts) and all(abs(r.score - want[r.doc_id]) < 1e-12 for r in rows)
    assert len({round(x, 6) for x in want.values()}) > 100


def plain_language(model, text):
    """(language, probability) from a dict of n-gram columns; hashing with whole Python numbers."""
    mask, mix = (1 << 64) - 1, 0xBF58476D1CE4E5B9
    low = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) for c in text or ""]
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    count = Counter()
    for i in range(len(low)):
        g = 0
        for k in range(min(3, len(low) - i)):
            g = (g * 0x9E3779B97F4A7C15 + (low[i + k] + 1 + k) * 0xD6E8FEB86659FD93) & mask
            count[(((g ^ (g >> 29)) * mix) & mask) >> (64 - 13)] += 1
    x = {f: math.log1p(c) * float(model.idf[f]) for f, c in count.items()}
    length = math.sqrt(sum(v * v for v in x.values()))
    a = [sum(v / length * float(model.weights[f, k]) for f, v in x.items()) + float(model.weights[-1, k]) for k in range(len(model.languages))]
    e = [math.exp((v - max(a)) / model.temperature) for v in a]
    return model.languages[e.index(max(e))], max(e) / sum(e)


def test_language_equals_plain_scoring(spark):
    rng = np.random.default_rng(23)
    model = languageid.Model(["aa", "bb", "cc"], rng.uniform(1, 5, languageid.DIM).astype(np.float32), rng.standard_normal((languageid.DIM + 1, 3)).astype(np.float32), 0.3)
    pick = random.Random(23)
    texts = [(i, "".join(pick.choice("abcé ЖßÄ12.\n") for _ in range(pick.randint(0, 80)))) for i in range(200)]
    texts += [(900, None), (901, ""), (902, "12 !"), (903, "x"), (904, "ab cd " * 30_000), texts[5]]
    want = {i: plain_language(model, t) for i, t in texts}
    d = docs(spark, texts).withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("clash"))
    rows = languageid.predict(d, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert abs(r.score - want[r.doc_id][1]) < 1e-4
        assert r.lang_pred == want[r.doc_id][0] or abs(want[r.doc_id][1] - 0.5) < 1e-3


def plain_quality(rows, labels):
    """{doc_id: (evidence, host_posterior, path_posterior, score)}; rows: (doc_id, bins, host, path)."""
    logit = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    known = [(b, labels[i]) for i, b, _, _ in rows if i in labels]
    prior = sum(y for _, y in known) / len(known)
    ratio = {}
    for f in range(len(quality.FIGURES)):
        good, poor = (Counter(b[f] for b, y in known if y == k) for k in (1, 0))
        seen = good.keys() | poor.keys()
        for b in seen:
            ratio[f, b] = math.log((good[b] + 1) / (sum(good.values()) + len(seen))) - math.log((poor[b] + 1) / (sum(poor.values()) + len(seen)))
    raw = {i: sum(ratio.get(x, 0.0) for x in enumerate(b)) for i, b, _, _ in rows}

    def likelihood(t):
        p = [(sigmoid(logit(prior) + t * raw[i]), labels[i]) for i, _, _, _ in rows if i in labels]
        return sum(math.log(max(q if y else 1 - q, 1e-9)) for q, y in p) / len(p)

    temper = max([0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0], key=likelihood)
    evidence = {i: temper * x for i, x in raw.items()}

    def strength(sites, parent):
        m = sum(g for g, _ in sites.values()) / sum(n for _, n in sites.values())
        v, n, q = m * (1 - m), sum(n for _, n in sites.values()), sum(n * (g / n - parent(k)) ** 2 for k, (g, n) in sites.items())
        between = max(1e-4, min(0.5, (q - len(sites) * v) / (n * v))) if n * v > 0 else 1e-4
        return 1 / between - 1

    paths, hosts = {}, {}
    for i, _, h, p in rows:
        w = 1.0 if i in labels else quality.SOFT
        y = labels[i] if i in labels else sigmoid(logit(prior) + evidence[i])
        for sites, k in ((paths, (h, p)), (hosts, h)):
            g, n = sites.get(k, (0.0, 0.0))
            sites[k] = (g + w * y, n + w)
    total = sum(g for g, _ in hosts.values()) / sum(n for _, n in hosts.values())
    s = strength(hosts, lambda k: total)
    host = {k: (g + s * total) / (n + s) for k, (g, n) in hosts.items()}
    s = strength(paths, lambda k: host[k[0]])
    path = {k: (g + s * host[k[0]]) / (n + s) for k, (g, n) in paths.items()}
    return {i: (evidence[i], host[h], path[h, p], sigmoid(logit(path[h, p]) + evidence[i])) for i, _, h, p in rows}


def test_quality_equals_plain_scoring(spark):
    rng = random.Random(24)
    texts = [(i, " ".join(rng.choice(WORDS if i % 3 else ["###", "$$", "12", "w1"]) for _ in range(rng.randint(1, 90)))) for i in range(400)]
    texts += [(900, None), (901, ""), (902, "w1 " * 100_000)]
    site = {i: (None if i % 11 == 0 else f"h{i % 5}", "en" if i % 2 else None) for i, _ in texts}
    rows = [(i, t, *site[i], "clash", 1) for i, t in texts]
    d = spark.createDataFrame([*rows, rows[7]], "doc_id long, text string, source string, lang string, label string, bins int")
    labels = {i: int(i % 3 > 0 and rng.random() < 0.9) for i in range(0, 300, 2)}
    y = spark.createDataFrame([*labels.items(), (None, 1), (5, None)], "doc_id long, quality int")
    raw = [(t or "").encode() for _, t in texts]
    bins = quality.binned(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])).tolist()
    plain = [(i, b, *site[i]) for (i, _), b in zip(texts, bins, strict=True)]
    want = plain_quality([*plain, plain[7]], labels)
    got = quality.score(d, y).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert np.allclose((r.evidence, r.host_posterior, r.path_posterior, r.score), want[r.doc_id], atol=1e-9)
    assert len({round(w[3], 6) for w in want.values()}) > 50


def pipeline_tables(spark, path):
    rng = random.Random(25)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    shared = [say(9), say(30), "All rights reserved."]
    texts = []
    for i in range(160):
        lines = [say(rng.randint(6, 25)) for _ in range(4)]
        if i % 4 == 1:
            lines[rng.randrange(4)] += " grubworm " + rng.choice(WORDS)
        if i % 5 == 2:
            lines.insert(rng.randint(0, 4), rng.choice(shared))
        texts.append("\n".join(lines))
    items = [(k, say(rng.choice([20, 40]))) for k in range(6)]
    for k, t in items:
        w = words_of(t)
        texts.append(f"{say(20)} {t} {say(20)}")
        texts.append(f"{say(10)} {' '.join(w[:9] + ['zz'] + w[10:])} {say(30)}")
    for i in (0, 4, 8, 12):
        w = " ".join(texts[i].split("\n")).split()
        for at in (20, 33):
            # A near copy on lines of its own: other breaks, so that only the document as a whole is near.
            texts.append("\n".join(" ".join(w[k : k + at]) for k in range(0, len(w), at)) + f"\n{rng.choice(WORDS)}q")
    texts += [shared[0], texts[6], None, "", " \n\t", "you grubworm you"]
    table = list(enumerate(texts)) + [(3, texts[3])]
    d = spark.createDataFrame([(i, t, "en", "s1" if i % 3 else None, None if t is None else len(t)) for i, t in table], "doc_id long, text string, lang string, source string, n_chars int")
    d.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i % 4 == 1)) for i in range(150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return table, items


def test_pipeline_equals_brute_force(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    texts, items = pipeline_tables(spark, tmp_path)
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    model = toxicity.fit(read("documents"), read("labels").where(~corpus_pipeline.held_out(5, 0)))
    left = {"all": texts}
    left["toxicity"] = [(i, t) for i, t in texts if plain_toxicity(model, t) < 0.5]
    kept, _ = deduplicated(left["toxicity"])
    left["line_dedup"] = [(i, kept[i]) for i, t in left["toxicity"] if kept[i] == t or (kept[i] or "").strip()]
    sets = {i: set(shingles_of(words_of(t))) for i, t in left["line_dedup"]}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    of = groups(links, sorted(sets))
    left["minhash_near_dedup"] = [(i, t) for i, t in left["line_dedup"] if of[i] == i]
    gone = {d for d, _ in held_items(left["minhash_near_dedup"], items)}
    left["benchmark_decontamination"] = [(i, t) for i, t in left["minhash_near_dedup"] if i not in gone]
    sizes = [len(x) for x in left.values()]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == 5, sizes  # each stage takes some
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in left["benchmark_decontamination"]:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
