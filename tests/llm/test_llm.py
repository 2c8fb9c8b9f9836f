"""Operators of the training-data pipeline against brute force, round trips and held-out labels."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaquery.llm import bpe, embeddings, langid, linededup, lm, packing, quality, queries, simhash, toxicity, warc
from mediaquery.llm.components import connected_components

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same same same"), (5, "same same same"), (None, "no id"), (6, "x " * 30_000)]
ODD_DDL = "doc_id long, text string"


def odd(spark, extra=True):
    df = spark.createDataFrame(ODD, ODD_DDL)
    return df.withColumns({"n_words": F.lit(1), "key": F.lit("k"), "a": F.lit(2)}) if extra else df


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# ---- 1: byte-level BPE ------------------------------------------------------------------------------

def test_bpe_parts_and_round_trip(spark):
    path, pattern = queries.rank_file("byte_bpe_multi_50k.tiktoken"), queries.split_pattern()
    enc = bpe.encoding(path, pattern)
    rng = random.Random(1)
    for _ in range(40):
        text = "".join(rng.choice("ab1é漢 \n\t'.!s") for _ in range(400))
        parts = list(bpe.safe_parts(text, 20, pattern))
        assert "".join(parts) == text
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    for text in ("ab\n" * 100_000, "漢字、" * 40_000, "a" * 70_000 + " \n \n b" * 9_000):
        parts = list(bpe.safe_parts(text, 5_000, pattern))
        assert len(parts) > 2 and [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    long = [(70, "word, and\n\n more's 12 漢字。" * 45_000), (71, "\n" * 70_000 + "x"), (72, "ab\n" * 40_000)]
    rows = odd(spark).where("doc_id is not null").select("doc_id", "text").unionByName(spark.createDataFrame(long, ODD_DDL))
    got = {r["doc_id"]: r for r in bpe.digest_table(rows, path, pattern).collect()}
    for key, text in ODD + long:
        if key is not None:
            ids = enc.encode_ordinary(text or "")
            assert got[key]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
            assert got[key]["n_tokens"] == len(ids)
            assert got[key]["ids_sha256"] == hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest()
    tokens = bpe.encode_table(odd(spark), path, pattern, keep=("doc_id", "a"))
    raw = bpe.decode_table(tokens, path, pattern)
    assert sorted(r["raw"].decode() for r in raw.collect()) == sorted(t or "" for _, t in ODD)
    assert bpe.decode_bytes(enc, enc.encode_ordinary("漢")[:1]) == "漢".encode()[: len(enc.decode_bytes(enc.encode_ordinary("漢")[:1]))]
    assert bpe.digest_table(odd(spark).limit(0), path, pattern).count() == 0


# ---- 2: toxicity ------------------------------------------------------------------------------------

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_matcher_is_exact():
    entries = [("abcab", False), ("abc", True), ("bcabcabca", False), ("cab", False), ("caacb", False)]
    matcher, rng = toxicity.Matcher(entries), random.Random(2)
    for _ in range(5_000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 11)))
        near = [distance(word, t) for t, o in entries if not o and distance(word, t) <= toxicity.allowed(t, o)]
        near += [0 for t, o in entries if o and word.startswith(t)]
        found = matcher.match(word)
        assert (found is None) == (not near) and (found is None or found[1] == min(near))


def test_toxicity_scores(spark):
    model = toxicity.Model(entries=[("badword", False)], precision={(0, 0): 0.95, (0, 1): 0.88}, base=0.01)
    df = odd(spark).select("doc_id", "text", "a").unionByName(spark.createDataFrame([(10, "you badword", 1), (11, "you badwrd", 1), (12, 'she said "badwrd" once', 1)], "doc_id long, text string, a int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_table(df, model).collect()}
    assert got[10] >= got[11] >= 0.7 > got[12] > got[1] == got[2] == got[4] == 0.01
    kept = toxicity.filter_documents(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, 12} and 10 not in {r["doc_id"] for r in kept.collect()}
    none = toxicity.learn(spark.createDataFrame([], "text string, y int"))
    assert none.entries == [] and toxicity.score_table(df.limit(0), none).count() == 0
    words = [(f"fine words here number{i % 7} and more", 0) for i in range(200)] + [(f"what a grumblork thing number{i} is", 1) for i in range(100)]
    learned = toxicity.learn(spark.createDataFrame(words, "text string, y int"))
    assert ("grumblork", False) in learned.entries or any(o and "grumblork".startswith(t) for t, o in learned.entries)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_table(spark.createDataFrame([(1, "a grumblork"), (2, "fine words")], ODD_DDL), learned).collect()}
    assert scored[1] >= 0.7 > scored[2]


def test_rare_and_ambiguous_terms_are_learned(spark):
    """Sixty terms that mark a sixtieth of the toxic texts each, and one that clean texts quote as often."""
    rng = random.Random(4)
    names = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(60)]
    rows = [(f"some {names[i % 60]} here number{i}", 1) for i in range(1_200)] + [(f"fine words here number{i}", 0) for i in range(5_000)]
    rows += [(f"you zorgblat number{i}", 1) for i in range(300)] + [(f'he wrote "zorgblat" number{i}', 0) for i in range(300)]
    model = toxicity.learn(spark.createDataFrame(rows, "text string, y int"))
    matcher = toxicity.Matcher(model.entries)
    score = lambda text: toxicity.score(model, toxicity.hits(matcher, text))
    assert all(score(f"such {n} again") >= 0.7 for n in names)
    assert score("you zorgblat again") >= 0.7 > score('he wrote "zorgblat" again')


def test_learned_stems_keep_misspellings(spark):
    """Two forms make a stem; edits inside its letters are found as before."""
    words = [(f"fine words here number{i % 7} and more", 0) for i in range(200)] + [(f"what grumblork{'s' * (i % 2)} thing number{i}", 1) for i in range(100)]
    matcher = toxicity.Matcher(toxicity.learn(spark.createDataFrame(words, "text string, y int")).entries)
    assert any(o and "grumblork".startswith(t) for t, o in matcher.entries) and matcher.match("grumblorky")[1] == 0
    assert all(matcher.match(w) and matcher.match(w)[1] >= 1 for w in ("grunblork", "rgumblork", "gumblorks", "grvmblork"))


# ---- 3: language model ------------------------------------------------------------------------------

def test_language_model_prefers_its_corpus(spark):
    rng = random.Random(3)
    names = [[f"{c}{i}" for i in range(5)] for c in "abcd"]
    text = lambda n: " ".join(rng.choice(names[k % 4]) for k in range(n))
    corpus = spark.createDataFrame([(i, text(200)) for i in range(400)], ODD_DDL).repartition(4)
    model = lm.train(corpus)
    assert len(model.words.hashes) == 20
    mixed = text(400).split()
    rng.shuffle(mixed)
    garbled = " ".join(w[::-1] for w in text(400).split())
    rows = spark.createDataFrame([(1, text(400)), (2, " ".join(mixed)), (3, None), (4, ""), (5, garbled)], ODD_DDL)
    got = {r["doc_id"]: r for r in lm.score(rows, model).collect()}
    assert got[1]["pll_per_token"] > got[2]["pll_per_token"] + 0.3 and got[1]["n_tokens"] == 400
    assert got[2]["pll_per_token"] > got[5]["pll_per_token"], "letters in another order are other words"
    assert got[3]["pll"] == got[4]["pll"] == 0 and got[3]["pll_per_token"] is None
    assert lm.score(rows.limit(0), lm.train(rows.limit(0))).count() == 0
    assert lm.score(rows, lm.train(rows.where("doc_id in (3, 4)"))).count() == 5


def test_vocabulary_is_a_word_count_that_grows_with_the_corpus(spark):
    rng = random.Random(5)
    size = {}
    for n in (200, 4_000):
        texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 5_000}" for _ in range(50)) for _ in range(n)]
        df = spark.createDataFrame([*((i, t) for i, t in enumerate(texts)), (-1, None)], ODD_DDL).repartition(3)
        counts = Counter(w for t in texts for w in t.split())
        least = max(lm.LEAST, math.ceil(math.sqrt(sum(counts.values())) / 2))
        frequent = [w for w, c in counts.items() if c >= least]
        found = lm.vocabulary(df)
        assert sorted(found.hashes.tolist()) == sorted(int(lm.word_hashes([w])[0][0]) for w in frequent)
        assert len(frequent) <= 2 * math.sqrt(sum(counts.values())), "the stated bound"
        assert found.rare == max(1.0, (len(counts) - len(frequent)) / found.buckets)
        ids = {w: int(found.tokens([w])[0][0]) for w in counts}
        by_id = sorted(frequent, key=ids.get)
        assert [ids[w] for w in by_id] == list(range(len(frequent))) and all(counts[a] >= counts[b] for a, b in zip(by_id, by_id[1:]))
        assert all(len(frequent) <= ids[w] < found.size for w in counts if w not in frequent)
        size[n] = len(frequent)
    assert size[4_000] > 1.5 * size[200]


def test_words_of_long_texts_are_cut_in_pieces(monkeypatch):
    texts = ["a b" * 50, None, "", "long" * 30 + " x\ty\x0bz \u00e9\U0001f600 ", " "]
    words, counts = lm.word_hashes(texts)
    want = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    same = {}
    for w, h in zip([w for ws in want for w in ws], words.tolist(), strict=True):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)
    monkeypatch.setattr(lm, "PIECE", 7)
    again, cut = lm.word_hashes(texts)
    assert again.tolist() == words.tolist() and cut.tolist() == counts.tolist()


def small_model(size=23, width=5):
    hashes = np.sort(lm.word_hashes([" ".join(f"w{k}" for k in range(size - 3))])[0])
    words = lm.Vocabulary(hashes, np.random.default_rng(2).permutation(len(hashes)).astype(np.int32), 3, 4.0)
    net = lm.Network(words.size, width)
    rng = np.random.default_rng(4)
    for x in net.w.values():
        x += np.where(x == -30, 0, rng.normal(0, 0.3, x.shape)).astype(np.float32)
    return words, net


def test_pseudo_likelihood_equals_a_softmax_over_all_words(monkeypatch):
    monkeypatch.setattr(lm, "BRANCHES", 3)
    words, net = small_model()
    assert net.depth == 3 and net.base == 3
    texts = ["w1 w2 unknown w3 w1", None, "", "w5", " ".join(f"w{k % 29}" for k in range(60))]
    got, counts = lm.score_texts(net, words, texts)
    for text, total, n in zip(texts, got, counts, strict=True):
        ids = words.tokens([text])[0].tolist()
        assert n == len(ids)
        want = 0.0
        for k, token in enumerate(ids):
            around = [ids[k + o] if 0 <= k + o < len(ids) else net.size for o in lm.OFFSETS]
            hidden = np.tanh(sum(net.w["embed"][j][t].astype(float) for j, t in enumerate(around)) + net.w["bias"])
            chance = {}
            for leaf in range(net.size):
                digits, rest = [], leaf
                for _ in range(net.depth):
                    digits.insert(0, rest % net.base)
                    rest //= net.base
                p, prefix = 1.0, 0
                for level, d in enumerate(digits):
                    node = net.w["node"][sum(net.base**q for q in range(level)) + prefix].astype(float)
                    z = np.exp((hidden + node[: net.width]) @ net.w["branch"][level] + node[net.width :])
                    p *= z[d] / z.sum()
                    prefix = prefix * net.base + d
                chance[leaf] = p
            assert abs(sum(chance.values()) - 1) < 1e-6, "one distribution over all words and buckets"
            want += math.log(chance[token]) - (math.log(words.rare) if token >= len(words.hashes) else 0)
        assert abs(total - want) < 1e-4 * max(1, n)
    assert np.allclose(got, [lm.score_texts(net, words, [t])[0][0] for t in texts], atol=1e-3)


def test_gradients_equal_differences_of_the_loss(monkeypatch):
    monkeypatch.setattr(lm, "BRANCHES", 3)
    words, net = small_model()
    net.w = {k: x.astype(np.float64) for k, x in net.w.items()}
    ids, counts = words.tokens(["w1 w2 w2 unknown w3", "w9 w1 w7"])
    around = lm.windows(ids, counts, net.size)
    whole = {k: np.zeros_like(x) for k, x in net.w.items()}
    for name, at, grad in lm.Trainer(net).gradients(around, ids):
        whole[name][at] += grad
    loss = lambda: -net.forward(around, ids)[0].mean()
    for name, x in net.w.items():
        for at in np.ndindex(x.shape):
            if abs(x[at]) >= 29:
                continue
            kept = x[at]
            x[at] = kept + 1e-5
            high = loss()
            x[at] = kept - 1e-5
            low = loss()
            x[at] = kept
            assert abs((high - low) / 2e-5 - whole[name][at]) < 1e-6, (name, at)


# ---- 4: WARC ----------------------------------------------------------------------------------------

def test_warc_round_trip(spark, tmp_path):
    big = "é\r\n\r\nWARC/1.1\r\n" * 3_000
    rows = [(1, "http://a", "x"), (2, "http://b", big), (3, None, None), (4, "http://c\r\nX: y", ""), (5, "u", "x"), (6, "v", big), (7, "w", "tail\r\n"), (8, "w", "\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = str(tmp_path / "warc")
    warc.write_archive(pages, path, size=1_000)
    segments = warc.read_archive(spark, path)
    got = {r["record_id"]: r for r in warc.records(segments).collect()}
    import base64

    for key, _, html in rows:
        raw = (html or "").encode()
        assert got[key]["payload_bytes"] == len(raw)
        assert got[key]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {k: r["refers_to"] for k, r in got.items() if r["record_type"] == "revisit"} == {1: 5, 2: 6, 3: 4}
    bodies = segments.where("record_id = 6").orderBy("chunk").collect()
    assert b"".join(bytes(r["body"]) for r in bodies) == big.encode() and len(bodies) > 10 and max(len(r["body"]) for r in bodies) <= 1_000
    small = {r["page_id"]: r["_first"] for r in warc.record_types(pages, min_bytes=2).collect()}
    assert small == {1: 1, 2: 6, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}
    nameless = spark.createDataFrame([(None, "a", "x"), (None, None, "alone"), (3, "b", "x")], "page_id long, url string, html string")
    warc.write_archive(nameless, str(tmp_path / "nameless"), size=2)
    read = warc.records(warc.read_archive(spark, str(tmp_path / "nameless"))).collect()
    assert sorted((r["record_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in read) == [(0, "response", None, 5), (0, "revisit", 3, 1), (3, "response", None, 1)]
    warc.write_archive(pages.limit(0), str(tmp_path / "none"))
    assert warc.records(warc.read_archive(spark, str(tmp_path / "none"))).count() == 0


# ---- 5: packing -------------------------------------------------------------------------------------

def test_packing_is_whole_and_tight(spark, docs):
    from tokenizers import Tokenizer

    path = queries.rank_file("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    marked = ["<|endoftext|> it's  x", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "x <|endoftext| y", "  <|endoftext|>  \n<|endoftext|>"]
    all_docs = docs + [(10_000 + i, t) for i, (_, t) in enumerate(ODD)] + [(20_000 + i, t) for i, t in enumerate(marked)]
    df = spark.createDataFrame(all_docs, ODD_DDL).repartition(5)
    rows = packing.pack(df, path, queries.split_pattern()).collect()
    import zlib
    from collections import defaultdict

    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for key, text in all_docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        mine = sorted(by_doc[key], key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == [0, *np.cumsum([r["length"] for r in mine])[:-1]] and sum(r["length"] for r in mine) == len(ids)
        assert all(r["length"] == 1024 for r in mine[1:])
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= np.ceil(total / 1024) * 1.02 + 1
    assert packing.pack(df.limit(0), path, queries.split_pattern()).count() == 0


def test_plan_uses_every_piece():
    rng = np.random.default_rng(4)
    for n in (1, 50, 20_000):
        lengths = np.clip(rng.lognormal(5.5, 1.2, n).astype(int), 1, 1024)
        histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
        groups, seen = packing.plan(histogram), {}
        for chosen, times in groups:
            assert sum(chosen) <= 1024 and times > 0
            for x in chosen:
                seen[x] = seen.get(x, 0) + times
        assert seen == histogram
        assert sum(t for _, t in groups) <= np.ceil(lengths.sum() / 1024) * 1.01 + 1


# ---- 6: SimHash -------------------------------------------------------------------------------------

def test_simhash_groups_equal_all_pairs(spark, docs):
    rows = docs + [(10_000 + i, t) for i, (k, t) in enumerate(ODD)]
    got = {r["doc_id"]: r for r in simhash.groups(spark.createDataFrame(rows, ODD_DDL).withColumn("fp", F.lit(1))).collect()}
    marks = []
    for _, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        import xxhash

        hashes = [xxhash.xxh64_intdigest(x, seed=42) for x in shingles]
        marks.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    assert [got[k]["fp"] & (2**64 - 1) for k, _ in rows] == marks
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 3]
    assert [got[k]["component_id"] for k, _ in rows] == [rows[r][0] for r in roots(len(rows), links)]


def test_near_duplicates_equal_all_pairs(spark, docs):
    rows = docs + [(10_000 + i, t) for i, (k, t) in enumerate(ODD)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, ODD_DDL).withColumn("key", F.lit(1))).collect()}
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert [got[k] for k, _ in rows] == [rows[r][0] for r in roots(len(rows), links)]


def test_links_behind_failed_links_are_found(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):  # copies of one text whose similarities lie on both sides of the threshold
        words = list(base)
        for at in rng.sample(range(120), rng.randint(0, 5)):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, ODD_DDL)).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert [got[k] for k, _ in rows] == roots(len(rows), links)
    # rows 0 and 2 link, but 1 is nearer to both and similar to neither
    hashes = [np.arange(10, dtype=np.uint64), np.arange(100, 110, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64)]
    marks, every = np.array([[0b0001], [0b0000], [0b1110]], dtype=np.uint64), np.arange(3)
    assert {frozenset(x) for x in simhash.late_links(marks, [0, 1, 2], hashes, every, every, 4, 0.8, True)} == {frozenset((0, 2))}
    assert simhash.late_links(marks, [0, 1, 0], hashes, every, every, 4, 0.8, True) == []


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 340)] + [(400, i) for i in range(401, 500)]
    want = roots(500, links)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: want[x] for a, b in links if a != b for x in (a, b)}
    for local in (0, 3):  # star steps, to the end or until few edges are left
        stepped = connected_components(spark.createDataFrame(links, "a long, b long").repartition(4), local=local)
        assert {r["node"]: r["component"] for r in stepped.collect()} == got and stepped.count() == len(got)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 7: embeddings ----------------------------------------------------------------------------------

def test_embedding_links(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 16))
    group = base[0] + rng.normal(size=(60, 16)) * 0.05
    vectors = [*base, *(base[100:140] + rng.normal(size=(40, 16)) * 0.05), *group, base[5], base[5], base[5] * 2]
    rows = [(i, [float(np.float32(x)) for x in v], i % 3 if i < 300 else {k: 0 for k in range(400)}.get(i, 0)) for i, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] * 16, 1), (n + 4, rows[0][1], None), (n + 5, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"rep": F.lit(1), "s": F.lit(2)})
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    links = []
    for i in range(n):
        for j in range(i):
            x, y = np.array(rows[i][1]), np.array(rows[j][1])
            if rows[i][2] == rows[j][2] and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links.append((i, j))
    degree = np.bincount(np.array(links).ravel(), minlength=n)
    found = sum(got[i]["n_links"] for i in range(n))
    assert found >= 0.95 * degree.sum() and all(got[i]["n_links"] <= degree[i] for i in range(n))
    want = roots(n, links)
    assert np.mean([got[i]["component_id"] == want[i] for i in range(n)]) >= 0.98
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(n, len(rows)))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def two_clusters():
    """Two tight clusters with links between single members only, and what all pairs give."""
    rng = np.random.default_rng(3)
    axis = np.eye(32)
    angle = np.arccos(0.92)
    heads = [axis[0], np.cos(angle) * axis[0] + np.sin(angle) * axis[1]]
    x = np.concatenate([h + rng.normal(size=(300, 32)) * 0.011 for h in heads]).astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.93
    assert linked[:300, :300].all() and linked[300:, 300:].all() and 0 < linked[:300, 300:].mean() < 0.3
    np.fill_diagonal(linked, False)
    return [(i, [float(v) for v in row], 0) for i, row in enumerate(x)], linked.sum(axis=1)


@pytest.mark.parametrize("few", [embeddings.FEW, 0])
def test_links_between_full_lists(spark, monkeypatch, few):
    enlarge = embeddings.enlarge
    monkeypatch.setattr(embeddings, "enlarge", lambda *a: enlarge(*a, few=few))
    rows, degree = two_clusters()
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert all(r["component_id"] == 0 and r["kept"] == (i == 0) for i, r in got.items())
    assert [got[i]["n_links"] for i in range(len(rows))] == degree.tolist()


def test_short_audit_ends_in_exact_blocks(spark, monkeypatch):
    descend = embeddings.descend
    monkeypatch.setattr(embeddings, "descend", lambda *a: descend(*a, rounds=0).limit(0))
    monkeypatch.setattr(embeddings, "TRIES", 1)
    rows, degree = two_clusters()
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert {r["component_id"] for r in got.values()} == {0} and [got[i]["n_links"] for i in range(len(rows))] == degree.tolist()


# ---- 8: line dedup ----------------------------------------------------------------------------------

def plain_runs(rows, least):
    """Lines of runs with ``least`` words or more that start earlier too, by looking at every run."""
    found, first, gone = [], {}, {}
    for d, (_, text) in enumerate(rows):
        lines = [(i, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, x in enumerate((text or "").split("\n"))]
        lines = [x for x in lines if x[2]]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(x[2] for x in lines[a : b + 1]) >= least:
                    found.append((d, lines[a][0], lines[b][0], tuple(x[1] for x in lines[a : b + 1])))
    for d, a, b, body in sorted(found):
        first.setdefault(body, (d, a))
        if first[body] != (d, a):
            gone.setdefault(d, set()).update(range(a, b + 1))
    return ["\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) if t is not None else None for d, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("most", [2, 5])
def test_line_runs_equal_brute_force(spark, most):
    rng = random.Random(7)
    rows = [(i, "\n".join(" ".join([f"w{k}"] * min(k, most)) for k in (rng.randint(0, 5) for _ in range(rng.randint(1, 14))))) for i in range(50)]
    rows += [(100, None), (101, ""), (102, "\n\n")]
    df = spark.createDataFrame(rows, ODD_DDL).withColumns({"d": F.lit(1), "pos": F.lit(2), "n_lines": F.lit(3)})
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df.withColumn("N_Deleted", F.lit(4)), 7).collect()}
    assert [got[k] for k, _ in rows] == plain_runs(rows, 7)
    kept = linededup.dedup_documents(df, 7)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for (k, t), new in zip(rows, plain_runs(rows, 7), strict=True) if new == t or new.strip()}


def test_line_dedup_odd_rows(spark):
    out = linededup.dedup_lines(odd(spark, extra=False))
    assert out.count() == len(ODD) and out.where("n_deleted > 0").count() == 0
    assert linededup.dedup_lines(odd(spark, extra=False).limit(0)).count() == 0


# ---- 9: quality rules -------------------------------------------------------------------------------

def test_quality_measures(spark, docs):
    rows = docs + [(10_000 + i, t) for i, (k, t) in enumerate(ODD[:-1])] + [(20_000, "a b c d e " * 4), (20_001, "x\ny\nx\n \n")]
    got = {r["doc_id"]: r for r in quality.ledger(spark.createDataFrame(rows, ODD_DDL).withColumn("n_words", F.lit(9))).collect()}
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = {}
        for i in range(len(words) - 4):
            windows.setdefault(tuple(words[i : i + 5]), []).append(i)
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len({j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}))
        r = got[key]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert bool(r["failed"] & 3) == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_quality_policies(spark, docs):
    df = spark.createDataFrame(docs, ODD_DDL).withColumn("n_words", F.lit("clash"))
    book = quality.ledger(df)
    kept = quality.filter_documents(df)
    assert kept.columns == df.columns and kept.count() == book.where(quality.passes("v1")).count()
    rows = {r["rule"]: r for r in quality.ablations(book).collect()}
    alone = book.where(F.col("failed") == quality.BIT["symbols"]).count()
    assert rows["symbols"]["only_this_rule"] == alone and rows["few_words"]["documents"] == len(docs)
    assert quality.ablations(book.limit(0)).first()["rejected"] == 0


# ---- 10: language ---------------------------------------------------------------------------------

def test_viterbi_is_best_path():
    rng = np.random.default_rng(8)
    scores = rng.normal(size=(7, 3)).astype(np.float32)
    import itertools

    best = max(itertools.product(range(3), repeat=7), key=lambda p: sum(scores[i, k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
    assert langid.viterbi(scores[:, None, :], np.array([7]), 1.5)[0].tolist() == list(best)


def test_language_predictions(spark):
    full = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = full.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    model = langid.learn(train)
    held = full.join(train, "doc_id", "left_anti")
    right = langid.predict(held, model).join(full.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.97
    some = {r["lang"]: r["text"] for r in train.where("n_chars between 400 and 900").dropDuplicates(["lang"]).collect()}
    mixed = spark.createDataFrame([(1, some["de"] + " " + some["fr"]), (2, None), (3, "12 ... 3")], ODD_DDL).withColumn("score", F.lit(1))
    spans = langid.spans(mixed, model).where("doc_id = 1" if "doc_id" in langid.spans(mixed, model).columns else "id = 1").orderBy("first_word").collect()
    assert {r["lang"] for r in spans} >= {"de", "fr"} and len(spans) < 12
    got = {r["doc_id"]: r for r in langid.predict(mixed, model).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[2]["score"] == 0
    none = langid.learn(train.limit(0))
    assert {r["lang_pred"] for r in langid.predict(mixed, none).collect()} == {"und"}


def test_every_language_is_learned(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for k in range(270):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(6)]
        rows += [(k, " ".join(words), f"l{k:03d}")] * (1 if k >= 250 else 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    model = langid.learn(df)
    assert len(model.langs) == 270
    assert all(r["lang_pred"] == f"l{r['doc_id']:03d}" for r in langid.predict(df, model).collect())
    monkeypatch.setattr(langid, "LANGUAGES", 269)
    with pytest.raises(ValueError):
        langid.learn(df)


# ---- queries and pipeline ---------------------------------------------------------------------------

def plain_rows(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for view in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM read_parquet('{SF}/{view}.parquet')")
    rel = con.execute(queries.ORACLES[name])
    names = [d[0] for d in rel.description]
    rows = rel.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert plain_rows(got) == sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_has_all_rows(spark, name):
    table = {"op4_warc": "pages", "op7_embedding_dedup": "embeddings"}.get(name, "documents")
    key = {"pages": "page_id", "embeddings": "vec_id"}.get(table, "doc_id")
    rows = queries.QUERIES[name](spark, SF)
    assert rows.select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as P

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = queries.toxicity_model(spark, SF)
    matcher = toxicity.Matcher(model.entries)
    book = {r["doc_id"]: r["failed"] for r in quality.ledger(frame).collect()}
    rows = [(k, t) for k, t in docs if not book[k] & quality.mask("v1")]
    rows = [(k, t) for k, t in rows if toxicity.score(model, toxicity.hits(matcher, t)) < 0.7]
    rows = [(k, new) for (k, t), new in zip(rows, plain_runs(rows, 50), strict=True) if new == t or new.split()]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t in rows)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    kept = {rows[r][0] for r in roots(len(rows), links)}
    packed = P.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept
    stage = frame
    for _, step in P.STAGES[:-1]:
        stage = step(spark, stage, SF)
        assert stage.columns == frame.columns
    empty = frame.limit(0)
    for _, step in P.STAGES:
        assert step(spark, empty, SF).count() == 0
