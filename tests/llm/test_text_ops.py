"""op2, op4, op5 and op6 against brute force, on the given tables and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import components, fingerprints, jaccard_join, language_id, queries, substring_dedup
from ledgerloom.llm.shingles import sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def shingle_set(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    own = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in own}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(own)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if own[a] and own[b]:
                n = len(own[a] & own[b])
                if 100 * n >= 75 * (len(own[a]) + len(own[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(own[i]), find(i)) for i in ids}


def made_texts():
    """Chains of edits around the threshold, exact copies, a passage that all share, and odd texts."""
    rng, out = random.Random(5), {}
    words = ["w%d" % i for i in range(400)]
    shared = rng.choices(words, k=40)
    for i in range(0, 120, 4):
        base = rng.choices(words, k=rng.choice([8, 30, 60, 120])) + (shared if i % 3 == 0 else [])
        for j in range(4):
            out[i + j] = " ".join(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                base[rng.randrange(len(base))] = rng.choice(words)
    out |= {200: None, 201: "", 202: " \t\n", 203: "one two", 204: "ONE two", 205: "two one", 206: "x", 207: "a b c d e", 208: "A B\x0bC d\x0ce", 209: "É b c d e", 210: "é b c d e", 211: "z" * 20000}
    return out


@pytest.mark.parametrize("limits", [None, (4, 300)])
def test_jaccard_join(spark, limits, monkeypatch):
    if limits:
        monkeypatch.setattr(jaccard_join, "MEMBERS", limits[0])
        monkeypatch.setattr(jaccard_join, "SHINGLES", limits[1])
    rows = made_texts()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows.items()], "doc_id long, text string, component_id long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, bucket_bytes=2000).collect()}
    assert got == brute_components(rows)


def test_jaccard_query_and_odd_tables(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_jaccard_join(spark, sf_dir).collect()}
    assert got == brute_components(texts)
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, None), (5, "a b c d e f"), (5, "a b c d e f"), (7, "q r s t u v")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.join(docs).collect()), key=str) == sorted([(None, 2, None), (None, 0, None), (5, 2, 5), (5, 2, 5), (7, 2, 7)], key=str)
    assert jaccard_join.join(docs.limit(0)).count() == 0


def test_tree_finds_all_links():
    rng = np.random.default_rng(2)
    own = []
    for _ in range(30):
        base = rng.integers(0, 1 << 62, rng.integers(3, 200)).astype(np.uint64)
        for _ in range(rng.integers(1, 8)):
            keep = base[rng.random(len(base)) > 0.12]
            own.append(np.unique(np.r_[keep, rng.integers(0, 1 << 62, 3).astype(np.uint64)]))
    want = [(i, j) for i in range(len(own)) for j in range(i) if jaccard_join.similar(own[i], own[j])]
    groups = lambda pairs: sorted(sorted(map(sorted, _groups(len(own), pairs))))
    assert groups(jaccard_join.tree_links(own, list(range(len(own))))) == groups(want)


def _groups(n, pairs):
    links = jaccard_join.Links(list(range(n)))
    for a, b in pairs:
        a, b = links.find(a), links.find(b)
        links.parent[max(a, b)] = min(a, b)
    out = defaultdict(list)
    for i in range(n):
        out[links.find(i)].append(i)
    return out.values()


def test_shingles_equal_tuples():
    rows = list(made_texts().values())
    assert [len(s) for s in sets(rows)] == [len(shingle_set(t)) for t in rows]
    a, b = sets(["p q r s t u v w", "Q r s T u v w x"])
    assert len(np.intersect1d(a, b)) == len(shingle_set("p q r s t u v w") & shingle_set("Q r s T u v w x"))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40, 60)] + [(100, i) for i in range(101, 140)] + [(1, 1), (7, 3), (3, 9)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 40 for i in range(40, 61)} | {i: 100 for i in range(100, 140)} | {3: 3, 7: 3, 9: 3}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_marks(hashes):
    """Winnowing over given run hashes: positions of each window's rightmost minimum."""
    w, out = fingerprints.WINDOW, []
    for i in range(max(1, len(hashes) - w + 1)):
        part = hashes[i : i + w]
        at = max(k for k, h in enumerate(part) if h == min(part)) + i
        if not out or out[-1] != at:
            out.append(at)
    return sorted(set(out))


def test_fingerprints(spark, texts):
    odd = {-1: None, -2: "", -3: "  ", -4: "a", -5: "a b c d", -6: "a b c d e", -7: "same " * 300, -8: " ".join(texts[0].split()[:12])}
    rows = {k: texts[k] for k in sorted(texts)[:40]} | odd
    df = fingerprints.fingerprints(spark.createDataFrame(list(rows.items()), "doc_id long, text string").withColumn("hashes", F.lit("clash")))
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " ")), " ")
    for r in df.withColumn("h", F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(fingerprints.PRIME)))).collect():
        if not (r.text or "").strip():
            assert r.hashes == [] and r.positions == []
            continue
        h, runs = r.h, []
        for i in range(max(1, len(h) - fingerprints.K + 1)):
            part, total = h[i : i + fingerprints.K], None
            if len(h) < fingerprints.K:
                total = 1
            for x in part:
                total = x if total is None else (total * fingerprints.BASE + x) % fingerprints.PRIME
            runs.append(total)
        want = brute_marks(runs)
        assert r.positions == want and r.hashes == list(dict.fromkeys(runs[i] for i in want))


def test_fingerprint_query(spark, sf_dir, texts):
    got = {r.doc_id: r for r in queries.op2_fingerprints(spark, sf_dir).collect()}
    ids = sorted(texts)
    prints = defaultdict(set)
    for k, i in enumerate(ids):
        t, follower = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + follower[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints[t].add(got[i].fingerprint)
        a, b, c = (set(x.split("-")) - {""} for x in (got[i].fingerprint, got[i].edited_fingerprint, got[ids[(k + 1) % len(ids)]].fingerprint))
        assert got[i].near_edited == pytest.approx(len(a & b) / len(a | b)) and got[i].near_next == pytest.approx(len(a & c) / len(a | c))
    assert all(len(p) == 1 for p in prints.values())


def test_fingerprint_followers(spark):
    docs = spark.createDataFrame([(3, "c c c c"), (1, "a a"), (2, None), (2, None), (None, "n n n n")], "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.edited) for r in fingerprints.edited(docs).collect())
    assert got == [(False, 0, "n n a a"), (True, 1, "a "), (True, 2, ""), (True, 2, ""), (True, 3, "c c n n")]
    assert fingerprints.edited(docs.limit(0)).count() == 0
    many = spark.range(0, 30000).selectExpr("id * 3 as id", "id as h")
    led = fingerprints.followers(many, range_rows=1000)
    assert led.where("next_id <> (id + 3) % 90000").count() == 0 and led.count() == 30000


PASSAGE = "The long passage that several documents carry was written once. It holds more than fifty words in all, so that its copies have to be found. Each copy stands inside other text, before it and after it, and no line break helps. Only the first one in order may keep it, while others lose it and everything else stays as it was before. "


def test_substring_dedup(spark):
    rows = {1: f"alpha beta starts. {PASSAGE}Tail one is here.", 2: f"Gamma delta with other words {PASSAGE}tail two", 3: "Clean text. The end. Of it.", 4: None, 5: "", 6: "line of many words that repeats itself here\nown words six\nline of many words that repeats itself here", 7: "Other own words seven\nLINE of many words  that repeats itself here"}
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows.items()], "doc_id long, text string, removed string").withColumnRenamed("removed", "batch")
    for batch_bytes in (1 << 20, 300):
        got = {r.doc_id: r for r in substring_dedup.dedup(docs, batch_bytes=batch_bytes, bucket_bytes=500).collect()}
        assert got[1].kept_text == rows[1] and got[3].kept_text == rows[3] and got[4].kept_text is None and got[5].kept_text == ""
        assert "has to be found" not in got[2].kept_text and "while others lose it" not in got[2].kept_text and got[2].kept_text.startswith("Gamma delta") and got[2].kept_text.endswith("tail two")
        assert got[6].kept_text == "line of many words that repeats itself here\nown words six" and got[7].kept_text == "Other own words seven"
        for i, r in got.items():
            assert r.batch == "c" and all(0 <= s.start < s.end <= len(rows[i]) for s in r.removed)
    assert substring_dedup.dedup(docs.limit(0)).count() == 0


def test_substring_dedup_keeps_unique_text(spark):
    """Short unique lines or unspaced text between repeated lines, and phrases each of another document, stay."""
    head, foot = "Price list of our own shop", "See you in the shop again"
    lists = {i: "\n".join([head, *(f"n{i}x{j} {i * 7000 + j}" for j in range(200)), foot]) for i in (1, 2)}
    han = {i: "\n".join([head, "".join(chr(0x4E00 + (i * 997 + j * j * 31) % 20000) for j in range(300)), foot]) for i in (3, 4)}
    phrases = [f"It was p{k} said then" for k in range(12)]
    single = {10 + k: f"Some q{k} other words. {p}. More q{k} follows here." for k, p in enumerate(phrases)}
    passage = "".join(chr(0x5000 + j * j * 17 % 9000) for j in range(120))
    rows = lists | han | single | {50: ". ".join(phrases) + ".", 60: f"\u4e00\u3002{passage}\u3002", 61: f"\u4e8c\u4e09\u3002{passage}\u3002\u56db"}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in substring_dedup.dedup(docs, batch_bytes=4000, bucket_bytes=3000).collect()}
    assert {i for i in rows if got[i] != rows[i]} == {61} and got[61] == "\u4e8c\u4e09\u3002\u56db"


def test_substring_dedup_against_brute_force(spark):
    """Each word that goes lies in a line or in 25 words that stand in an earlier place; passages of 40 words go."""
    rng = random.Random(9)
    vocabulary = ["the", "of", "and", "River", "mountain", "walked", "to", "In", "small.", "yes!", "no\n", "Somewhere"]
    made = lambda n: " ".join(rng.choice(vocabulary) + ("" if rng.random() < 0.8 else str(rng.randrange(300))) for _ in range(n))
    shared = [made(n) for n in (20, 24, 30, 40, 60)]
    rows = {i: " ".join([made(30), rng.choice(shared), made(rng.choice([1, 10])), rng.choice(shared), made(20)]) for i in range(40)}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.dedup(docs, batch_bytes=3000, bucket_bytes=2000).collect()}
    seen, n_gone = set(), 0
    for i in sorted(rows):
        words = [(m.start(), m.group().lower()) for m in re.finditer(r"\S+", rows[i])]
        held = set()
        for k in range(len(words) - 24):
            window = tuple(w for _, w in words[k : k + 25])
            if window in seen:
                held |= set(range(k, k + 25))
            seen.add(window)
        at = 0
        for line in rows[i].split("\n"):
            own = tuple(line.lower().split())
            if len(own) >= 8:
                if ("line", own) in seen:
                    held |= set(range(at, at + len(own)))
                seen.add(("line", own))
            at += len(own)
        gone = {k for k, (a, _) in enumerate(words) if any(s.start <= a < s.end for s in got[i].removed)}
        assert gone <= held
        n_gone += len(gone)
    assert n_gone > 0
    first = {p: min(i for i in rows if p in rows[i]) for p in shared if len(p.split()) >= 40}
    for p, i in first.items():
        middle = " ".join(p.split()[12:28])
        assert all(middle not in " ".join(got[j].kept_text.split()) for j in rows if j > i)


def test_substring_dedup_on_documents(spark, sf_dir, texts):
    """No passage of 50 words is left twice, against a scan of all windows; what is kept is what the spans leave."""
    got = {r.doc_id: r for r in queries.op5_substring_dedup(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    seen, again = {}, 0
    for i in sorted(texts):
        assert got[i].text == substring_dedup.cut(texts[i], [(s.start, s.end) for s in got[i].removed])
        w = got[i].text.split()
        for k in range(len(w) - 49):
            if len(set(w[k : k + 50])) >= 20:
                again += seen.setdefault(" ".join(w[k : k + 50]), i) != i
    assert again == 0


def test_language_id(spark, sf_dir):
    rows = queries.op6_language_id(spark, sf_dir.replace("0.001", "0.01")).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_id_odd_rows(spark):
    labelled = spark.createDataFrame([("the cat and the dog and the bird", "en"), ("der hund und die katze und der vogel", "de"), (None, "en"), ("x", None)] * 3, "text string, lang string")
    model = language_id.train(labelled)
    assert model.languages == ["de", "en"]
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 -- ! \u00b2 \u00bd \u2167"), (4, "the birds"), (5, "Katzen und"), (None, "zzz qqq"), (4, "the birds")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = [(r.doc_id, r.language.lang_pred, r.score) for r in language_id.predict(docs, model).collect()]
    assert Counter(got)[4, "en", "clash"] == 2 and (1, "und", "clash") in got and (2, "und", "clash") in got and (3, "und", "clash") in got and (5, "de", "clash") in got
    nothing = language_id.train(labelled.limit(0))
    assert {r.language.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_language_names_and_long_texts(spark):
    """Names with a backtick, a dot or quotes are learned like others, and a long text is scored whole."""
    names = ["d`e", "e.n", "f'r\"", ""]
    rows = [(f"{w}a {w}b {w}c", n) for w, n in zip(("kat", "dog", "oiseau", "vog"), names)]
    model = language_id.train(spark.createDataFrame(rows * 3, "text string, lang string"))
    assert model.languages == sorted(names)
    docs = spark.createDataFrame([(n, f"{t} " * 20_000) for t, n in rows] + [("d`e", "doga " * 10_000 + "kata " * 10_001)], "want string, text string")
    assert all(r.want == r.language.lang_pred for r in language_id.predict(docs, model).collect())


def test_language_id_of_few_rows(spark):
    """A language of few rows beside large ones is learned; a text copied into many rows is neither all in nor all out."""
    rng = random.Random(3)
    vocabulary = {x: ["".join(rng.choices(letters, k=6)) for _ in range(200)] for x, letters in (("aa", "abcdefgh"), ("bb", "ijklmnop"), ("cc", "qrstuvwxyz"))}
    text = lambda x: " ".join(rng.choices(vocabulary[x][:40] if x == "cc" else vocabulary[x], k=20))
    rows = [(i, text("aa"), "aa") for i in range(2000)] + [(i, "copied words", "bb") for i in range(2000, 4000)] + [(i, text("bb"), "bb") for i in range(4000, 5000)] + [(i, text("cc"), "cc") for i in range(5000, 5006)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(labelled, sample_rows=100, words=60, grams=300)
    assert model.languages == ["aa", "bb", "cc"] and {"copied", "words"} <= set(model.words)
    assert all(sum(w in vocabulary[x] for w in model.words) >= 12 for x in vocabulary)
    docs = spark.createDataFrame([(x, text(x)) for x in vocabulary for _ in range(10)], "want string, text string")
    assert all(r.want == r.language.lang_pred for r in language_id.predict(docs, model).collect())
    assert language_id.bounds({"a": 5, "b": 1000, "c": 50}, 100) == {"a": 5, "c": 47, "b": 48}


def test_language_score_equals_brute_force(spark):
    rows = [("the cat and the dog", "en"), ("the bird sat", "en"), ("der hund und die katze", "de"), ("der vogel sa\u00df", "de")]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    words, grams = {x: Counter() for x in ("de", "en")}, {x: Counter() for x in ("de", "en")}
    for text, x in rows:
        for w in text.split():
            words[x][w] += 1
            p = f" {w} "
            grams[x].update(p[i : i + n] for n in range(1, 6) for i in range(len(p) - n + 1) if p[i : i + n] != " ")

    def frequencies(counts):
        entries = set(counts["de"]) | set(counts["en"])
        sums = {x: sum(c.values()) for x, c in counts.items()}
        floor = 0.5 / max(sums.values())
        return {e: {x: math.log((counts[x][e] / sums[x] + floor) / (1 + floor * len(entries))) for x in counts} for e in entries}

    word, gram = frequencies(words), frequencies(grams)

    def score(text):
        total = Counter()
        for w in text.lower().split():
            found = [word[w]] if w in word else []
            for n in range(5, 0, -1) if not found else ():
                p = f" {w} "
                found = found or [gram[p[i : i + n]] for i in range(len(p) - n + 1) if p[i : i + n] in gram]
            for x in ("de", "en"):
                total[x] += sum(f[x] for f in found) / max(1, len(found))
        best = max(("de", "en"), key=lambda x: total[x])
        return best, 1 / sum(math.exp(total[x] - total[best]) for x in total)

    texts = ["The cats", "hunde und katzen", "bird der", "xyzzy", "the der", "\u00dfa\u00df"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in language_id.predict(docs, model).collect():
        want = score(r.text)
        assert r.language.lang_pred == want[0] and abs(r.language.score - want[1]) < 1e-9
