"""Hard negatives, chat formatting and vector codes against brute force, on small and awkward tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediaquery.llm import chat, hardneg, simhash, toxicity, vqcode

NAN, INF = float("nan"), float("inf")
VECTORS_DDL = "vec_id long, label int, embedding array<double>, id int, q string, code int"


def vectors(n=230, seed=3):
    """Ties, repeated rows and ids, unequal lengths, and every kind of null."""
    rng = random.Random(seed)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None]), [rng.randrange(-3, 4) / 4 for _ in range(rng.choice([20, 20, 20, 7, 0]))], 1, "x", 2) for i in range(n)]
    rows += [rows[0], rows[n // 2], (100, 2, [0.5] * 20, 1, "x", 2), (None, 1, [1.0] * 20, 1, "x", 2), (n, 1, None, 1, "x", 2), (n + 1, 2, [NAN] + [1.0] * 19, 1, "x", 2)]
    return rows + [(n + 2, 2, [INF], 1, "x", 2), (n + 3, 1, [None, 1.0], 1, "x", 2), (-100, 1, [0.25] * 33, 1, "x", 2)]


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# ---- 11: hard negatives -----------------------------------------------------------------------------

@settings(max_examples=25, deadline=None)
@given(st.integers(0, 37), st.integers(0, 29), st.integers(0, 41), st.integers(1, 5))
def test_strassen_is_exact(n, k, m, leaf):
    rng = np.random.default_rng(n * 1000 + k * 50 + m)
    a, b = rng.integers(-(1 << 28), 1 << 28, (n, k)), rng.integers(-(1 << 28), 1 << 28, (k, m))
    assert (hardneg.strassen(a, b, leaf) == a @ b).all()
    assert (hardneg.strassen(a, b, leaf) == np.array([[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b.T] for r in a]).reshape(n, m)).all()


def test_heaps_merge():
    rng = np.random.default_rng(5)
    row, score, ident = rng.integers(0, 6, 300), rng.integers(-4, 4, 300), rng.integers(0, 50, 300)
    heaps = hardneg.Heaps(6, 4)
    for at in range(0, 300, 70):
        heaps.push(row[at : at + 70], score[at : at + 70], ident[at : at + 70])
    for r in range(6):
        want = sorted(zip(-score[row == r], ident[row == r]))[:4]
        assert [(-s, i) for s, i in zip(heaps.score[r], heaps.ident[r])] == want


def mined(rows, label=lambda i, x: x, k=5):
    able = [(i, label(i, x), [math.floor(256 * c) for c in v]) for i, x, v, *_ in rows if i is not None and x is not None and fine(v)]
    out = []
    for i, own, v in able:
        if i % 100:
            continue
        score = [(-sum(a * b for a, b in zip(v, w)), j, x) for j, x, w in able if j != i]
        for p, j, _ in sorted(s for s in score if s[2] == own)[:k]:
            found = sorted(s for s in score if s[2] != own and 80 * -p <= 100 * -s[0] <= 100 * -p)[:k]
            out += [(i, j, r + 1, m, -p, -s) for r, (s, m, _) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, small):
    if small:  # several blocks and slices
        monkeypatch.setattr(hardneg, "BLOCK_VALUES", 48)
        monkeypatch.setattr(hardneg, "LEAST_SLICE", 32)
    rows = vectors()
    got = hardneg.mine(spark.createDataFrame(rows, VECTORS_DDL).repartition(5), F.col("id") % 100 == 0)
    want = mined(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_hard_negatives_of_empty_and_large(spark):
    empty = spark.createDataFrame([], VECTORS_DDL)
    assert hardneg.mine(empty, F.col("id") % 100 == 0).count() == 0
    lone = spark.createDataFrame([(100, 1, [1.0], 1, "x", 2)], VECTORS_DDL)
    assert hardneg.mine(lone, F.col("id") % 100 == 0).count() == 0
    large = spark.createDataFrame([(100, 1, [1e30], 1, "x", 2), (1, 1, [1e30], 1, "x", 2)], VECTORS_DDL)
    with pytest.raises(Exception, match="too large"):
        hardneg.mine(large, F.col("id") % 100 == 0).collect()


# ---- 12: chat formatting ----------------------------------------------------------------------------

PIECES = st.text(alphabet=st.sampled_from(list("\\#</turn> \n:aé漢")), max_size=25) | st.sampled_from(["</turn>", "###", "####\\", "\\### Assistant: </turn> ok", " </turn>\n### user: "])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_template_is_reversible(turns):
    assert chat.parse(chat.template(turns)) == turns
    assert chat.unescape(chat.escape("".join(t for _, t in turns))) == "".join(t for _, t in turns)
    for (role, text), (piece, keep, start, end, rewrites) in zip(turns, chat.spans(turns, loss=[r for r, _ in turns])):
        assert keep is None and not rewrites and chat.unescape(piece[start:end]) == text
        assert chat.parse(piece) == [(role, text)]


def forgetful(turns):
    """Keeps what an assistant thinks only in the last turn."""
    return "".join(f"<{r}>{t if k == len(turns) - 1 else t.split('!')[-1]}\n" for k, (r, t) in enumerate(turns))


def numbered(turns):
    return "".join(f"{k % 2}{r}[{t.upper()}]" for k, (r, t) in enumerate(turns))


def test_rewriting_templates_are_found():
    turns = [("user", "hi"), ("assistant", "hm!yes"), ("user", "so"), ("assistant", "no")]
    found = list(chat.spans(turns, forgetful))
    assert [x[4] for x in found] == [False, False, True, False]
    text = ""
    for piece, keep, *_ in found:
        text = (text if keep is None else text[:keep]) + piece
    assert text == forgetful(turns)
    assert [x[2:4] for x in found] == [(None, None), (11, 17), (None, None), (11, 13)]
    assert all(x[2] is None or x[0][x[2] : x[3]] == t[1].upper() for x, t in zip(chat.spans(turns, numbered), turns))


def conversations():
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "ok", "a </turn> b", "\\", "###\n", "漢é"])) for c in range(9) for t in range(rng.choice([1, 2, 5]))]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(150)]
    rows += [(60, 1, "assistant", "same"), (60, 1, "assistant", "same"), (60, None, "user", "first"), (None, 0, "assistant", "no id"), (0, 99, "assistant", "x" * 300_000)]
    rng.shuffle(rows)
    return rows


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted([(-1 if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c])
        said = "".join(x for _, r, x in own if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[c] = (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(said), sha(said), len(chat.template([(r, x) for _, r, x in own])), False)
    return out


@pytest.mark.parametrize("chunk", [3, 32])
def test_chat_digests(spark, chunk):
    rows = conversations()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"at": F.lit(1), "chunk": F.lit("c"), "n": F.lit(2), "key": F.lit(0)})
    pieces = chat.format_turns(turns.repartition(4), chunk=chunk)
    assert {r[0]: tuple(r)[1:] for r in chat.digests(pieces).collect()} == expected(rows)
    dropping = lambda turns: "".join(f"<{r}>{t if k == len(turns) - 1 else t[:2]}\n" for k, (r, t) in enumerate(turns))
    rewritten = chat.format_turns(turns.where("conv_id = 50"), dropping, chunk=chunk)
    assert rewritten.where("rewrites").count() == 149 and rewritten.count() == 150
    assert chat.digests(chat.format_turns(turns.limit(0))).count() == 0


# ---- 13: vector codes -------------------------------------------------------------------------------

@settings(max_examples=40, deadline=None)
@given(st.integers(1, 30), st.integers(1, 12), st.integers(1, 4), st.integers(1, 6), st.integers(0, 10_000))
def test_ball_assignment_is_exact(n, k, width, spread, seed):
    rng = np.random.default_rng(seed)
    x, entries = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-spread, spread + 1, (k, width))
    far = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    for start in (np.zeros(n, np.int64), rng.integers(0, k, n)):
        code, near = vqcode.assign(x, entries, start)
        assert (code == far.argmin(axis=1)).all() and (near == far.min(axis=1)).all()


def compressed(rows, parts=16, entries=64, rounds=2):
    kept = [(i, x, [math.floor(256 * c) for c in v]) for i, x, v, *_ in rows if fine(v)]
    width = max(1, -(-max(len(v) for *_, v in kept) // parts))
    kept = [(i, x, v, np.array(v + [0] * (parts * width - len(v))).reshape(parts, width)) for i, x, v in kept]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = np.array([r[3] for r in seeds]).transpose(1, 0, 2)
    q = np.array([r[3] for r in kept])

    def near():
        far = ((q[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return far.argmin(axis=2), far.min(axis=2).sum(axis=1)

    for _ in range(rounds):
        code, _ = near()
        books = books.copy()
        for p in range(parts):
            for k in range(books.shape[1]):
                mine = q[code[:, p] == k, p]
                if len(mine):
                    books[p, k] = mine.sum(axis=0) // len(mine)
    code, error = near()
    total = {}
    for (_, x, *_), e in zip(kept, error):
        total[x] = total.get(x, 0) + int(e)
    digest = hashlib.sha256(",".join(str(c) for c in books.ravel()).encode()).hexdigest()
    return sorted(((r[0], bytes(c.tolist()).hex(), int(e), total[r[1]], digest) for r, c, e in zip(kept, code, error)), key=str)


@pytest.mark.parametrize("n", [230, 3])
def test_vector_codes_equal_brute_force(spark, n):
    rows = vectors(n)
    got = vqcode.compress(spark.createDataFrame(rows, VECTORS_DDL).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == compressed(rows)


def test_vector_codes_of_empty_and_large(spark):
    assert vqcode.compress(spark.createDataFrame([], VECTORS_DDL)).count() == 0
    assert vqcode.compress(spark.createDataFrame([(1, None, [], 1, "x", 2)], VECTORS_DDL)).select("code", "error").collect() == [("00" * 16, 0)]
    with pytest.raises(Exception, match="smaller scale"):
        vqcode.compress(spark.createDataFrame([(1, 1, [1e30], 1, "x", 2)], VECTORS_DDL)).collect()


def test_quotation_marks_are_not_apostrophes():
    matcher = toxicity.Matcher([("idiot", False)])
    quoted = lambda text: [h.quoted for h in toxicity.hits(matcher, text)]
    assert quoted("don't be an idiot, it's bad") == [False]
    assert quoted("they said 'idiot' to me") == quoted('he wrote "you idiot" again') == quoted("«idiot»") == [True]
    assert quoted("it's 'an idiot' they'd say") == [True] and quoted("idiot'") == [False]
    assert quoted('"one" two three four five six idiot "no"') == [False], "the first pair stands outside the window"


def test_near_dedup_keeps_one_row_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    long = " ".join(f"word{k}" for k in range(60))
    near = long + " more"
    rows = [(None, "a text of its own with some words", 1), (7, long, 2), (7, long, 2), (3, near, 3), (None, long, 4), (9, "twice the very same text here", 5), (9, "twice the very same text here", 5),
            (None, "nobody knows whose text this one is", 6), (None, "nobody knows whose text this one is", 6), (4, None, 7), (2, "", 8), (5, "one id and", 9), (5, "two other texts of few words", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int").withColumn("key", F.lit("k"))
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r["component_id"] for r in out.collect()) == [1, 3, 5, 6, 8, 9, 10]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_near_duplicates_on_the_boundary(spark):
    """Links of 4 in 5 and of 12 in 15 shingles, just at 0.8: all found, and pairs just below stay apart."""
    def pair(n, words, more):
        text = [f"w{n}x{k}" for k in range(words + more)]
        return " ".join(text[:words]), " ".join(text)

    kinds = [(8, 1, True), (16, 3, True), (7, 1, False), (15, 3, False)]
    rows, want = [], {}
    for k, (words, more, linked) in enumerate(kinds):
        for n in range(1_500):
            a = 2 * (k * 1_500 + n)
            short, long = pair(a, words, more)
            rows += [(a, short), (a + 1, long)]
            want |= {a: a, a + 1: a if linked else a + 1}
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
